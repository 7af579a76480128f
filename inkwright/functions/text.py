"""Scalar text functions: pure column expressions, inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: runs of ASCII letters and digits with inner apostrophes and hyphens.
TOKEN = "[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)*"
#: Fixed value: the separators of a line split, CR LF first.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
CLOSING = ".,;:!?)]}'\""



def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def splitlines(text: Column) -> Column:
    """Lines without their ends; a line end at the very end opens no further line."""
    parts = F.split(text, LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def is_nonword(token: Column) -> Column:
    """No ASCII letter at all."""
    return ~token.rlike("[A-Za-z]")


def match_case(source: Column, target: Column) -> Column:
    """``target`` in the case of ``source``: all capitals (if longer than one), first capital, or as it is."""
    first = F.substring(source, 1, 1)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    return (
        F.when((F.upper(source) == source) & (F.lower(source) != source) & (F.length(source) > 1), F.upper(target))
        .when(capital & (target != ""), F.concat(F.upper(F.substring(target, 1, 1)), F.substr(target, F.lit(2))))
        .otherwise(target)
    )


def clamp(confidence: Column) -> Column:
    """Not a number counts as 0; else within 0 and 1."""
    return F.when(F.isnan(confidence), 0.0).otherwise(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)))


def join_tokens(tokens: Column) -> Column:
    """Tokens joined by spaces, with none before a non-word that begins with a closing sign."""
    first = lambda t: F.substring(t, 1, 1)
    tight = lambda t: is_nonword(t) & ((t == "") | F.lit(CLOSING).contains(first(t)))
    return F.array_join(F.transform(tokens, lambda t, i: F.when((i == 0) | tight(t), t).otherwise(F.concat(F.lit(" "), t))), "")


def truncate(text: Column, limit: int = 400) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def replace_first(text: Column, old: Column, new: Column) -> Column:
    at = F.position(old, text)
    return F.when((at == 0) | (old == ""), text).otherwise(F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old))))


def parse_id(text: Column) -> Column:
    """A positive 64-bit number, or null."""
    n = F.when(text.rlike("^[+]?[0-9]+$"), text.try_cast("bigint"))
    return F.when(n > 0, n)


def changed_lines(before: Column, after: Column) -> Column:
    """Array of (predicted, corrected).

    As many lines on either side: the lines that differ, without pairs that have a blank side. Else one
    pair of the whole texts, unless one is blank.
    """
    a, b = F.split(before, "\n", -1), F.split(after, "\n", -1)
    pair = lambda x, y: F.struct(x.alias("predicted"), y.alias("corrected"))
    blank = lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) == ""
    zipped = F.zip_with(a, b, pair)
    differing = F.filter(zipped, lambda p: (p["predicted"] != p["corrected"]) & ~blank(p["predicted"]) & ~blank(p["corrected"]))
    none = F.filter(F.array(pair(before, after)), lambda p: F.lit(False))
    return F.when(F.size(a) == F.size(b), differing).when(blank(before) | blank(after), none).otherwise(F.array(pair(before, after)))


def page_number(path: Column) -> Column:
    """The digits after the last hyphen up to the first non-digit; 0 if there are none."""
    return F.coalesce(F.regexp_extract(path, r"-(\d*)[^-]*$", 1).try_cast("int"), F.lit(0))


def rounded(value: Column, digits: int) -> Column:
    """To ``digits`` places, ties to even, by the binary value: the part after the point is scaled by itself, which keeps its bits."""
    scale = float(10**digits)
    whole = F.floor(value)
    return F.bround(whole + F.rint((value - whole) * scale) / scale, digits)
