"""Layout: words to lines, lines to paragraphs, strike-outs, reading order, and text with offsets."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Fixed values.
BAND, FALLBACK_HEIGHT = 0.6, 20.0
GAP_FACTOR, GAP_SHARE, TYPICAL_SHARE = 1.8, 0.3, 0.4
STRIKE_OVERLAP, STRIKE_BAND = 0.6, 0.25


def upper_median(values: Column) -> Column:
    """The middle of a sorted array without nulls, the higher of two; no interpolation."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def nearest_rank(values: Column, share: float) -> Column:
    return F.get(F.sort_array(values), F.floor(F.size(values) * share).cast("int"))


def typical_height(heights: Column) -> Column:
    """The middle of the heights above 0; 20 without any."""
    known = F.filter(heights, lambda h: h > 0)
    return F.coalesce(upper_median(known), F.lit(FALLBACK_HEIGHT))


def median_heights(words: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, height): of the heights above 0; 20 without any."""
    return words.groupBy(page).agg(F.collect_list(F.col("y1") - F.col("y0")).alias("h")).select(page, typical_height(F.col("h")).alias("height"))


@F.arrow_udf(ArrayType(IntegerType()))
def line_numbers(y0: pa.Array, y1: pa.Array, height: pa.Array) -> pa.Array:
    """The running line of each word of a page whose words go by their middles: one pass, nothing is copied."""
    lines, ends = [], [0]
    for tops, bottoms, typical in zip(y0.to_pylist(), y1.to_pylist(), height.to_pylist(), strict=True):
        line, top, bottom, most = -1, math.nan, math.nan, BAND * typical
        for a, b in zip(tops, bottoms, strict=True):
            known = a is not None and b is not None
            if known and abs((a + b) / 2 - (top + bottom) / 2) <= most:
                top, bottom = min(top, a), max(bottom, b)
            else:
                line, top, bottom = line + 1, a if known else math.nan, b if known else math.nan
            lines.append(line)
        ends.append(len(lines))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(lines, pa.int32()))


def group_lines(words: DataFrame, page: str = "page_id") -> DataFrame:
    """``words`` (page, ord, text, confidence, x0, y0, x1, y1) with ``line_index`` and ``line_order``.

    Words by the middle of their height join the running line if they are within 0.6 of the median
    height of its band's middle; the band then grows over them. The band depends on all words before,
    so it is a fold over the page's sorted words, which carry all their columns along: a page is one row
    there, and nothing is joined back. Within a line words go by x0.
    """
    rest = [c for c in words.columns if c not in (page, "ord")]
    item = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("mid"), F.col("ord"), *rest)
    pages = words.groupBy(page).agg(F.sort_array(F.collect_list(item)).alias("w"))
    pages = pages.withColumn("height", typical_height(F.transform("w", lambda w: w["y1"] - w["y0"])))
    side = lambda c: F.transform("w", lambda w: w[c].cast("double"))
    pages = pages.withColumn("line", line_numbers(side("y0"), side("y1"), F.col("height").cast("double")))
    each = pages.select(page, F.explode(F.arrays_zip("w", "line")).alias("p"))
    placed = each.select(*[F.col(c) if c == page else F.col(f"p.w.{c}") for c in words.columns], F.col("p.line").alias("line_index"))
    return placed.withColumn("line_order", F.row_number().over(Window.partitionBy(page, "line_index").orderBy("x0", "ord")) - 1)


def line_boxes(placed: DataFrame, page: str = "page_id") -> DataFrame:
    return placed.groupBy(page, "line_index").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"))


def paragraphs(lines: DataFrame, heights: DataFrame, page: str = "page_id") -> DataFrame:
    """``lines`` (page, line_index, top, bottom) with ``para_index``: a paragraph ends where a gap is over 1.8 typical gaps and 0.3 heights."""
    order = Window.partitionBy(page).orderBy("line_index")
    gaps = lines.withColumn("gap", F.col("top") - F.lag("bottom").over(order)).join(heights, page)
    quartile = nearest_rank(F.collect_list("gap").over(Window.partitionBy(page)), 0.25)
    limit = GAP_FACTOR * F.when(F.coalesce(quartile, F.lit(0.0)) > 0, quartile).otherwise(TYPICAL_SHARE * F.col("height")) + GAP_SHARE * F.col("height")
    breaks = gaps.withColumn("limit", limit).withColumn("b", F.when(F.col("gap") > F.col("limit"), 1).otherwise(0))
    return breaks.withColumn("para_index", F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).select(*lines.columns, "para_index")


def with_paragraphs(placed: DataFrame, paras: DataFrame, page: str = "page_id") -> DataFrame:
    """``placed`` words with the ``para_index`` of their line; a page's lines meet its words as one array, so all stays dealt by page."""
    known = F.transform(F.sort_array(F.collect_list(F.struct("line_index", "para_index"))), lambda p: p["para_index"])
    by_page = paras.groupBy(page).agg(known.alias("_paras"))
    return placed.join(by_page, page).withColumn("para_index", F.get("_paras", F.col("line_index"))).drop("_paras")


def bisects(rx0: Column, ry0: Column, rx1: Column, ry1: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A rule strikes a box out: it covers 60 % of the width and passes within a quarter height of the middle."""
    width, height = x1 - x0, y1 - y0
    left, right = F.least(rx0, rx1), F.greatest(rx0, rx1)
    overlap = F.least(right, x1) - F.greatest(left, x0)
    centre = (x0 + x1) / 2
    slope = F.try_divide(ry1 - ry0, rx1 - rx0)
    at = F.when(rx1 == rx0, ry0).otherwise(ry0 + slope * (centre - rx0))
    return (width > 0) & (height > 0) & (overlap >= STRIKE_OVERLAP * width) & (F.abs(at - (y0 + y1) / 2) <= STRIKE_BAND * height)


def strike_out(words: DataFrame, rules: DataFrame, page: str = "page_id") -> DataFrame:
    """``words`` with ``struck``; a struck word's text is blank and its own text is kept as ``original``.

    A page's rules meet each of its words as one array, so a word under two rules stays one row.
    """
    names = ("x0", "y0", "x1", "y1")
    by_page = rules.groupBy(page).agg(F.collect_list(F.struct(*names)).alias("_rules"))
    struck = F.coalesce(F.exists("_rules", lambda r: bisects(*[r[c] for c in names], *map(F.col, names))), F.lit(False))
    marked = words.join(by_page, page, "left").withColumn("struck", struck).drop("_rules")
    return marked.withColumn("original", F.col("text")).withColumn("text", F.when(F.col("struck"), "").otherwise(F.col("text")))


def reading_order(placed: DataFrame, page: str = "page_id") -> DataFrame:
    """Words that aren't struck, with ``decode_index`` from 0."""
    order = Window.partitionBy(page).orderBy("line_index", "line_order")
    return placed.filter(~F.col("struck")).withColumn("decode_index", F.row_number().over(order) - 1)


def assemble(tokens: DataFrame, page: str = "page_id") -> DataFrame:
    """``tokens`` (page, line_index, line_order, para_index, text, struck) with idx, start and end offsets.

    Words are joined by a space, lines by a line end, paragraphs by two; struck tokens have no width and
    no separator. Offsets are UTF-8 bytes; ``char_start`` and ``char_end`` count characters.
    """
    order = Window.partitionBy(page).orderBy("line_index", "line_order")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    shown = ~F.col("struck") & (F.col("text") != "")
    last = lambda c: F.last(F.when(shown, F.col(c)), ignorenulls=True).over(before)
    separator = F.when(~shown | F.col("_line").isNull(), "").when(F.col("_para") != F.col("para_index"), "\n\n").when(F.col("_line") != F.col("line_index"), "\n").otherwise(" ")
    rows = tokens.withColumn("_line", last("line_index")).withColumn("_para", last("para_index")).withColumn("_sep", separator).withColumn("_text", F.when(shown, F.col("text")).otherwise(""))
    rows = rows.withColumn("idx", F.row_number().over(order) - 1)
    for name, size in (("", F.octet_length), ("char_", F.length)):
        end = F.sum(size("_sep") + size("_text")).over(upto).cast("int")
        rows = rows.withColumn(f"{name or ''}{'end' if name else 'end_offset'}", end).withColumn(f"{name}start" if name else "start_offset", end - size("_text"))
    return rows.withColumn("piece", F.concat("_sep", "_text")).drop("_line", "_para", "_sep", "_text")


def page_texts(assembled: DataFrame, page: str = "page_id") -> DataFrame:
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("idx", "piece"))), lambda p: p["piece"])
    return assembled.groupBy(page).agg(F.array_join(pieces, "").alias("text"))


def spans(tokens: DataFrame) -> DataFrame:
    """The tokens that an editor marks."""
    return tokens.filter((F.col("tier") != "none") & ~F.col("struck") & (F.col("start_offset") < F.col("end_offset")))


def tier_counts(tokens: DataFrame, page: str = "page_id") -> DataFrame:
    return tokens.groupBy(page).agg(F.count_if(F.col("tier") == "red").alias("red"), F.count_if(F.col("tier") == "amber").alias("amber"))


def sort_reading_order(words: Column) -> Column:
    """An array of boxes by the pairwise rule: more than half of the lower height in common goes by x0, else by y0.

    The rule isn't a strict weak order, so long arrays may come out in any of several orders.
    """

    def compare(a: Column, b: Column) -> Column:
        overlap = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
        height = F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
        sign = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
        return F.when((height > 0) & (overlap > 0.5 * height), sign(a["x0"], b["x0"])).otherwise(sign(a["y0"], b["y0"]))

    return F.array_sort(words, compare)
