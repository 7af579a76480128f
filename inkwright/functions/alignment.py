"""Edit distance, error rates and alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import edit_paths

#: Fixed value: an error span with a longer side is left out.
MAX_SPAN = 4
#: Characters of pairs whose operations are counted together.
CHARACTERS = 1 << 19
OPS = "array<struct<kind:string,source:string,target:string,si:int,ti:int>>"
SPANS = "array<struct<observed:string,truth:string>>"


def within(a: Column, b: Column, limit: int) -> Column:
    """At most ``limit`` edits apart; the built-in gives up early."""
    return F.levenshtein(a, b, limit) >= 0


def error_rate(truth: Column, observed: Column) -> Column:
    """Edits over the length of the truth; for an empty truth 0 or 1."""
    return F.when(F.length(truth) == 0, F.when(F.length(observed) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(observed, truth) / F.length(truth))


def line_distance(a: Column, b: Column) -> Column:
    """Edit distance of two word arrays joined by spaces.

    With as many words on either side it is at most the sum of the distances word by word, so only a
    band of that width is looked at: a line of many words costs its length times its errors.
    """
    most = F.aggregate(F.zip_with(a, b, lambda x, y: F.levenshtein(x, y)), F.lit(0), lambda n, d: n + d)
    left, right = F.array_join(a, " "), F.array_join(b, " ")
    return F.when(F.size(a) == F.size(b), F.call_function("levenshtein", left, right, most)).otherwise(F.levenshtein(left, right))


def line_error_rate(truth: Column, observed: Column) -> Column:
    """``error_rate`` of two word arrays joined by spaces."""
    n, m = F.length(F.array_join(truth, " ")), F.length(F.array_join(observed, " "))
    return F.when(n == 0, F.when(m == 0, 0.0).otherwise(1.0)).otherwise(line_distance(observed, truth) / n)


def pooled_error_rate(truth: Column, observed: Column) -> Column:
    """Aggregate: all edits over all lengths."""
    return F.coalesce(F.try_divide(F.sum(F.levenshtein(observed, truth)), F.sum(F.length(truth))), F.lit(0.0))


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two word arrays: each distinct word of the pair becomes one character of the planes from U+10000 on.

    There are 1,048,576 of them; a pair with more distinct words is an error.
    """
    def sign(place: Column) -> Column:
        k = place + 0xFFFF
        six = lambda bits: F.lit(0x80).bitwiseOR(F.shiftright(k, bits).bitwiseAND(F.lit(63)))
        utf8 = F.shiftleft(F.lit(0xF0).bitwiseOR(F.shiftright(k, 18)), 24) + F.shiftleft(six(12), 16) + F.shiftleft(six(6), 8) + six(0)
        return F.unhex(F.hex(utf8)).cast("string")

    def distance(known: Column) -> Column:
        places = lambda x: F.transform(x, lambda w: F.array_position(known, w))
        coded = lambda x: F.array_join(F.transform(places(x), sign), "")
        too_many = F.raise_error(F.lit("word_distance: over 1,048,576 distinct words")).cast("int")
        return F.when(F.size(known) > 1 << 20, too_many).otherwise(F.levenshtein(coded(a), coded(b)))

    # Bound to a name, the distinct words are found once, not once a word.
    both = F.array_distinct(F.concat(a, b))
    return F.when(both.isNotNull(), F.transform(F.array(both), distance)[0])


def word_error_rate(truth: Column, observed: Column) -> Column:
    return F.when(F.size(truth) == 0, F.when(F.size(observed) == 0, 0.0).otherwise(1.0)).otherwise(word_distance(truth, observed) / F.size(truth))


def align_pair(source: str, target: str) -> list[tuple]:
    """Operations (kind, source, target, si, ti) that turn ``source`` into ``target``."""
    _, kind, si, ti, _, _, _ = edit_paths.paths([source], [target])
    left = ["" if k == edit_paths.DEL else source[i] for k, i in zip(kind.tolist(), si.tolist(), strict=True)]
    right = ["" if k == edit_paths.INS else target[j] for k, j in zip(kind.tolist(), ti.tolist(), strict=True)]
    return list(zip([edit_paths.KINDS[k] for k in kind], left, right, si.tolist(), ti.tolist(), strict=True))


def _signs(codes: np.ndarray) -> pa.Array:
    """Code points as strings of one character; 0 is the empty string."""
    distinct, inverse = np.unique(codes, return_inverse=True)
    return pa.DictionaryArray.from_arrays(inverse.astype(np.int32), pa.array([chr(c) if c else "" for c in distinct.tolist()], pa.string())).cast(pa.string())


def _spans(sources: list[str], targets: list[str], kind: np.ndarray, si: np.ndarray, ti: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, list[str], list[str]]:
    """(pair, observed, truth) of the maximal runs of errors, both sides at most ``MAX_SPAN`` long."""
    bad = kind != edit_paths.MATCH
    new = bad.copy()
    new[1:] &= ~bad[:-1] | (pair[1:] != pair[:-1])
    first, run = np.flatnonzero(new), np.cumsum(new) - 1
    taken = lambda none: np.bincount(run[bad & (kind != none)], minlength=len(first))
    a, b = taken(edit_paths.DEL), taken(edit_paths.INS)
    some = (a <= MAX_SPAN) & (b <= MAX_SPAN)
    first, a, b = first[some], a[some], b[some]
    cut = lambda texts, at, size: [texts[p][i : i + k] for p, i, k in zip(pair[first].tolist(), at[first].tolist(), size.tolist(), strict=True)]
    return pair[first], cut(sources, si, a), cut(targets, ti, b)


def align(source: Column | str, target: Column | str) -> Column:
    """Struct (ops, spans) by an Arrow function: the dynamic program that expressions can't state well.

    ``ops`` are the operations in order, ``spans`` (observed, truth) the runs of errors of at most
    ``MAX_SPAN`` characters a side; null where a side is null.
    """

    @F.arrow_udf(f"struct<ops:{OPS},spans:{SPANS}>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            null = np.logical_or(left.is_null().to_numpy(zero_copy_only=False), right.is_null().to_numpy(zero_copy_only=False))
            sources, targets = (["" if x is None else x for x in side.to_pylist()] for side in (left, right))
            offsets, kind, si, ti, a, b, pair = edit_paths.paths(sources, targets)
            fields = [pa.array(edit_paths.KINDS).take(pa.array(kind)), _signs(a), _signs(b), pa.array(si, pa.int32()), pa.array(ti, pa.int32())]
            ops = pa.StructArray.from_arrays(fields, ["kind", "source", "target", "si", "ti"])
            whose, observed, truth = _spans(sources, targets, kind, si, ti, pair)
            spans = pa.StructArray.from_arrays([pa.array(observed, pa.string()), pa.array(truth, pa.string())], ["observed", "truth"])
            ends = np.searchsorted(whose, np.arange(len(sources) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values) for at, values in ((offsets, ops), (ends, spans))]
            yield pa.StructArray.from_arrays(lists, ["ops", "spans"], mask=pa.array(null))

    return run(source, target)


def distinct_pairs(pairs: DataFrame, source: str = "predicted", target: str = "corrected") -> DataFrame:
    """(predicted, corrected, n): ``n`` is how often a pair occurs."""
    return pairs.groupBy(F.col(source).alias("predicted"), F.col(target).alias("corrected")).agg(F.count("*").alias("n"))


def align_counted(distinct: DataFrame) -> DataFrame:
    """(predicted, corrected, n, ops, spans) of ``distinct_pairs``."""
    return distinct.withColumn("_a", align("predicted", "corrected")).select("predicted", "corrected", "n", "_a.ops", "_a.spans")


def aligned(pairs: DataFrame, source: str = "predicted", target: str = "corrected") -> DataFrame:
    """(predicted, corrected, n, ops, spans): each distinct pair is aligned once, ``n`` is how often it occurs."""
    return align_counted(distinct_pairs(pairs, source, target))


def count_operations(sources: list[str], targets: list[str], n: list[int]) -> dict[tuple[str, str, str], int]:
    """Count of each (kind, a, b) of pairs that occur ``n`` times, as of ``operation_counts``."""
    weight = np.array(n, dtype=np.int64)
    _, kind, si, ti, a, b, pair = edit_paths.paths(sources, targets)
    whose, observed, truth = _spans(sources, targets, kind, si, ti, pair)
    kind = np.where(kind == edit_paths.MATCH, edit_paths.SUB, kind)
    key, inverse = np.unique((kind.astype(np.int64) << 42) | (b.astype(np.int64) << 21) | a.astype(np.int64), return_inverse=True)
    counts = np.zeros(len(key), dtype=np.int64)
    np.add.at(counts, inverse, weight[pair])
    sign = lambda code: chr(code) if code else ""
    found = {(edit_paths.KINDS[k >> 42], sign(k >> 21 & 0x1FFFFF), sign(k & 0x1FFFFF)): c for k, c in zip(key.tolist(), counts.tolist(), strict=True)}
    for x, y, c in zip(observed, truth, weight[whose].tolist(), strict=True):
        found["span", x, y] = found.get(("span", x, y), 0) + c
    return found


def count_rows(found: dict[tuple[str, str, str], int]) -> pa.RecordBatch:
    """(kind, a, b, count)."""
    sides = [[k[i] for k in found] for i in range(3)]
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in sides), pa.array(list(found.values()), pa.int64())], names=["kind", "a", "b", "count"])


def operation_counts(distinct: DataFrame) -> DataFrame:
    """(kind, a, b, count) of ``distinct_pairs``: sub (truth, observed) with matches, del (truth, ''), ins ('', observed), span (observed, truth).

    Operations are counted where the pairs are aligned, so a batch gives a row for each confusion and not for each character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if row[0] is None or row[1] is None:
                    continue
                rows.append(row)
                size += len(row[0]) + len(row[1])
                if size >= CHARACTERS:
                    yield count_rows(count_operations(*map(list, zip(*rows, strict=True))))
                    rows, size = [], 0
            if rows:
                yield count_rows(count_operations(*map(list, zip(*rows, strict=True))))

    return distinct.select("predicted", "corrected", "n").mapInArrow(run, "kind string, a string, b string, count long").groupBy("kind", "a", "b").agg(F.sum("count").alias("count"))


def error_spans(alignments: DataFrame) -> DataFrame:
    """(observed, truth, count) of maximal runs of errors, both sides at most ``MAX_SPAN`` long."""
    return alignments.select("n", F.explode("spans").alias("s")).groupBy("s.observed", "s.truth").agg(F.sum("n").alias("count"))
