"""Evaluation: synthetic samples, error rates, flag quality, hold-out splits and sweeps."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.alignment import count_rows, pooled_error_rate, word_error_rate
from ..functions.misreading import ErrorModel, tokens
from .decode import Models, Thresholds, decode

#: Shape confusions of the synthetic error model.
CONFUSIONS = {
    "a": ["o", "u"],
    "o": ["a", "e"],
    "e": ["c", "o"],
    "c": ["e"],
    "i": ["l", "e"],
    "l": ["i", "t"],
    "t": ["l", "f"],
    "n": ["r", "h"],
    "m": ["rn"],
    "rn": ["m"],
    "s": ["5"],
    "5": ["s", "S"],
    "S": ["5"],
    "u": ["v", "a"],
    "v": ["u"],
    "g": ["q", "y"],
    "h": ["b", "n"],
    "0": ["o", "O"],
    "1": ["l", "I"],
}
ERROR_RATE, SEED, CONFIDENTLY_WRONG = 0.08, 11, 0.25
SWEEP = (0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 6.0, 9.0, 15.0)


def unit(*parts: Column, at: int = 1) -> Column:
    """A number in [0, 1) from eight hex digits of the MD5 of the parts: no running state, so it runs in parallel."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), at, 8), 16, 10).cast("double") / 4294967296.0


def corrupt(word: Column, key: Column, rate: float = ERROR_RATE) -> Column:
    """``word`` with characters misread at ``rate``; the pair rn is tried before single characters."""
    single = {k: v for k, v in CONFUSIONS.items() if len(k) == 1}
    table = F.create_map(*[x for k, v in single.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    signs = F.lit("".join(single))

    def draws(i: Column) -> Column:
        return F.md5(F.concat_ws("|", key, i.cast("string")).cast("binary"))

    def number(digest: Column, at: int) -> Column:
        return F.conv(F.substring(digest, at, 8), 16, 10).cast("double") / 4294967296.0

    def fires(i: Column) -> Column:
        return (F.substr(word, i, F.lit(2)) == "rn") & (number(draws(i), 1) < rate)

    def out(i: Column) -> Column:
        c, d = F.substr(word, i, F.lit(1)), draws(i)
        options = F.try_element_at(table, c)
        pick = F.get(options, F.floor(number(d, 17) * F.size(options)).cast("int"))
        misread = signs.contains(c) & (number(d, 9) < rate)
        # A pair can't overlap another pair, so whether the one before fired is known without a scan.
        return F.when(fires(i), "m").when((i > 1) & fires(i - 1), "").when(misread, pick).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(word)), out), "")


def confidence(truth: Column, observed: Column, key: Column) -> Column:
    """.88 to .99 where right; wrong readings have a quarter in .87 to .97, the rest in .30 to .80."""
    u, v = unit(key, F.lit("c")), unit(key, F.lit("c"), at=9)
    return F.when(observed == truth, 0.88 + 0.11 * u).when(v < CONFIDENTLY_WRONG, 0.87 + 0.10 * u).otherwise(0.30 + 0.50 * u)


def _named(docs: DataFrame, key: str, text: str, seed: int) -> DataFrame:
    return docs.select(key, F.col(text).alias("_text"), F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).alias("_k"))


def synthesize(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = ERROR_RATE, seed: int = SEED) -> DataFrame:
    """(key, line, idx, truth, observed, confidence): every token of every line that has any.

    Equal to ``corrupt`` and ``confidence`` of each token under the key seed|key|line|idx, worked out in arrays.
    """
    named = _named(docs, key, text, seed)
    fields = [named.schema[key], *T.StructType.fromDDL("line int, idx int, truth string, observed string, confidence double").fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors = ErrorModel(CONFUSIONS, rate)
        for batch in batches:
            for row, line, idx, words, draws in tokens(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                truth, observed = errors.read(words, draws)
                u, v, _ = draws.of(np.arange(len(words)), None)
                right = pc.equal(truth, observed).to_numpy(zero_copy_only=False)
                sure = np.where(right, 0.88 + 0.11 * u, np.where(v < CONFIDENTLY_WRONG, 0.87 + 0.10 * u, 0.30 + 0.50 * u))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(line), pa.array(idx.astype(np.int32)), truth, observed, pa.array(sure)], names=[f.name for f in fields])

    return named.mapInArrow(read, T.StructType(fields))


def misread_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = ERROR_RATE, seed: int = SEED) -> DataFrame:
    """(predicted, corrected, n): the distinct pairs (observed, truth) of ``synthesize``, counted where the text is read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors = ErrorModel(CONFUSIONS, rate)
        for batch in batches:
            for *_, words, draws in tokens(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                truth, observed = errors.read(words, draws)
                counted = pa.table({"predicted": observed, "corrected": truth}).group_by(["predicted", "corrected"], use_threads=False).aggregate([([], "count_all")])
                yield from counted.select([0, 1, 2] if counted.column_names[0] == "predicted" else [1, 2, 0]).rename_columns(["predicted", "corrected", "n"]).combine_chunks().to_batches()

    some = _named(docs, key, text, seed).mapInArrow(read, "predicted string, corrected string, n long")
    return some.groupBy("predicted", "corrected").agg(F.sum("n").alias("n"))


def misread_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = ERROR_RATE, seed: int = SEED) -> DataFrame:
    """(kind, a, b, count): the operations of ``misread_pairs``, counted where the text is read; no pair is shuffled."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors, found = ErrorModel(CONFUSIONS, rate), Counter()
        for batch in batches:
            for *_, words, draws in tokens(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found.update(errors.counts(words, draws))
        if found:
            yield count_rows(found)

    some = _named(docs, key, text, seed).mapInArrow(read, "kind string, a string, b string, count long")
    return some.groupBy("kind", "a", "b").agg(F.sum("count").alias("count"))


def misread_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = ERROR_RATE, seed: int = SEED) -> DataFrame:
    """(key, line, predicted, corrected) of the lines of ``synthesize`` that differ, joined where the text is read."""
    named = _named(docs, key, text, seed)
    fields = [named.schema[key], *T.StructType.fromDDL("line int, predicted string, corrected string").fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors = ErrorModel(CONFUSIONS, rate)
        for batch in batches:
            for row, line, idx, words, draws in tokens(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                first = np.flatnonzero(idx == 0)
                ends = pa.array(np.append(first, len(idx)).astype(np.int32))
                truth, observed = (pc.binary_join(pa.ListArray.from_arrays(ends, side), " ") for side in errors.read(words, draws))
                found = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first])), pa.array(line[first]), observed, truth], names=[f.name for f in fields])
                yield found.filter(pc.not_equal(observed, truth))

    return named.mapInArrow(read, T.StructType(fields))


def as_lines(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys, truth, observed): the tokens of a line as two arrays in order."""
    both = F.array_sort(F.collect_list(F.struct("idx", "truth", "observed")))
    grouped = tokens.groupBy(*keys).agg(both.alias("t"))
    return grouped.select(*keys, F.transform("t", lambda x: x["truth"]).alias("truth"), F.transform("t", lambda x: x["observed"]).alias("observed"))


def correction_pairs(lines: DataFrame) -> DataFrame:
    """(predicted, corrected) of lines that differ."""
    pairs = lines.select(*[c for c in lines.columns if c not in ("truth", "observed")], F.array_join("observed", " ").alias("predicted"), F.array_join("truth", " ").alias("corrected"))
    return pairs.filter("predicted <> corrected")


def split_samples(lines: DataFrame, share: float, seed: int, *keys: str) -> DataFrame:
    """``lines`` with ``part``: train for exactly floor(n * share) of them, in a seeded order by MD5.

    Equal to numbering all lines in that order, but without a sort of everything in one task: lines
    are counted by the first three digits of their MD5, and only the digit group at the cut is numbered.
    """
    named = lines.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))).withColumn("_g", F.substring("_h", 1, 3))
    groups = named.groupBy("_g").agg(F.count("*").alias("_n"))
    bounds = groups.select("_g", (F.sum("_n").over(Window.orderBy("_g")) - F.col("_n")).alias("_before"), F.floor(F.sum("_n").over(Window.partitionBy(F.lit(0))) * share).alias("_cut"))
    numbered = named.join(F.broadcast(bounds), "_g").withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_g").orderBy("_h", *keys)))
    return numbered.withColumn("part", F.when(F.col("_r") <= F.col("_cut"), "train").otherwise("test")).drop("_h", "_g", "_before", "_cut", "_r")


def error_rates(lines: DataFrame) -> DataFrame:
    """One row: cer pooled over all lines, wer as the mean over lines."""
    joined = lambda c: F.array_join(c, " ")
    return lines.agg(pooled_error_rate(joined("truth"), joined("observed")).alias("cer"), F.coalesce(F.avg(word_error_rate(F.col("truth"), F.col("observed"))), F.lit(0.0)).alias("wer"))


def flag_quality(decoded: DataFrame, *keys: str) -> DataFrame:
    """One row (a row by ``keys``) from (truth, observed, text, tier, substituted): tier counts, helped, hurt, precision, recall, F1.

    A flag is right if the text after decoding is still wrong; case doesn't count.
    """
    low = lambda c: F.lower(F.col(c))
    flagged, wrong, was_wrong = F.col("tier") != "none", low("text") != low("truth"), low("observed") != low("truth")
    n = decoded.groupBy(*keys).agg(
        F.count("*").alias("tokens"), F.count_if(F.col("tier") == "red").alias("red"), F.count_if(F.col("tier") == "amber").alias("amber"), F.count_if("substituted").alias("substituted"),
        F.count_if(F.col("substituted") & was_wrong & ~wrong).alias("helped"), F.count_if(F.col("substituted") & ~was_wrong & wrong).alias("hurt"),
        F.count_if(flagged & wrong).alias("tp"), F.count_if(flagged & ~wrong).alias("fp"), F.count_if(~flagged & wrong).alias("fn"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def cer_reduction(baseline: Column, cer: Column) -> Column:
    return F.when(baseline > 0, (baseline - cer) / baseline).otherwise(0.0)


def evaluate(decoded: DataFrame, *line: str) -> DataFrame:
    """One row from decoded tokens (line, idx, truth, original, text, tier, substituted): error rates before and after, and flag quality."""
    named = decoded.withColumn("observed", F.col("original"))
    before = error_rates(as_lines(named, *line)).select(F.col("cer").alias("baseline_cer"), F.col("wer").alias("baseline_wer"))
    after = error_rates(as_lines(named.withColumn("observed", F.col("text")), *line))
    rates = before.crossJoin(after).withColumn("cer_reduction", cer_reduction(F.col("baseline_cer"), F.col("cer")))
    return rates.crossJoin(flag_quality(named))


def sweep_margin(tokens: DataFrame, truth: DataFrame, models: Models, values: tuple[float, ...] = SWEEP, limits: Thresholds | None = None, page: str = "page_id") -> DataFrame:
    """(margin, flag quality) for each margin: what is substituted changes the context, so every margin is a decode of its own.

    All are decoded at once, as pages of their own: candidates and their prices are made once.
    """
    margin = F.explode(F.array(*[F.lit(float(v)) for v in values])).alias("substitute_nats")
    every = tokens.select(*tokens.columns, margin).withColumn(page, F.struct(F.col(page).alias("page"), F.col("substitute_nats").alias("margin")))
    done = decode(every, models, limits or Thresholds(), page=page).select(F.col(f"{page}.page").alias(page), F.col(f"{page}.margin").alias("margin"), "idx", "text", F.col("original").alias("observed"), "tier", "substituted")
    return flag_quality(done.join(truth.select(page, "idx", "truth"), [page, "idx"]), "margin")


def differing_words(before: Column, after: Column) -> Column:
    """How many words differ, line by line and place by place, as far as both sides go."""
    a, b = F.split(before, "\n", -1), F.split(after, "\n", -1)
    words = lambda line: F.filter(F.split(F.coalesce(line, F.lit("")), r"\s+"), lambda w: w != "")
    per_line = F.zip_with(a, b, lambda x, y: F.size(F.filter(F.zip_with(words(x), words(y), lambda p, q: F.coalesce(p != q, F.lit(False))), lambda d: d)))
    return F.aggregate(per_line, F.lit(0), lambda s, n: s + n)
