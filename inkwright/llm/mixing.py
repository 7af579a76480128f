"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import cut

SPACES = r"[\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    parts = F.split(F.col(text), SPACES)
    size = F.size(parts) - F.when(F.element_at(parts, 1) == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.when(F.col(text).isNull(), F.lit(0)).otherwise(size).cast("long")


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, alike in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, source: str, size: str, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """One row a source: ``source, source_size, target``.

    Weights go to the sources in order of their name (by code point, null last), over and over.
    ``share`` times all words are dealt by weight; a target stops at ``ceiling`` times its source's
    size, and what is over goes to the rest by weight. That fixed point is a water level: with the
    sources in order of ceiling / weight, all up to some point stop, and the rest get level * weight.
    """
    by = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    every = Window.partitionBy(F.lit(0))  # as many rows as sources
    named = by.withColumn("_rank", F.row_number().over(every.orderBy(F.col(source).asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    named = named.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(ceiling)))
    order = every.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        named.withColumn("_total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(order), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(order), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_left"))
    )
    # The level rises while sources stop and falls after the first that doesn't: the greatest holds.
    target = F.least(F.col("_cap"), F.max("_level").over(every) * F.col("_w"))
    return filled.select(F.col(source), "source_size", target.alias("target"))


def _row_digest(key: str, text: str) -> Column:
    """MD5 of a row's key and text: rows that share it are alike to the mix."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit(""))).cast("binary"))


def _tag(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), F.col(source).cast("string")), F.lit("null"))


def _laid(docs: DataFrame, *, key: str, source: str, text: str, weights: Sequence[float], share: float, ceiling: float, seed: str) -> DataFrame:
    """A narrow row for each document: ``key, source, digest, size, source_size, target, rate, offset, upto``; upto is its place in its source, from 1."""
    # Only ids, names and counts are kept: one scan of the texts, all later steps on narrow rows.
    sized = cut(
        docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"), _row_digest(key, text).alias("digest"))
        .withColumn("bits", F.length(F.bin("size")))
        .withColumn("lead", F.substring(F.bin("size"), 1, 5))
        .withColumn("sub", F.substring("digest", 1, 2))
    )
    bins = ["source", "bits", "lead", "sub"]
    # Running counts in two levels: over the sizes of a source (some hundreds), and over the bins of a size.
    counted = sized.groupBy(*bins).agg(F.count("*").alias("n"))
    before = lambda by, order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = counted.groupBy(*bins[:3]).agg(F.sum("n").alias("all")).withColumn("smaller", F.coalesce(F.sum("all").over(before(bins[:1], bins[1:3])), F.lit(0)))
    sizes = sizes.select(F.col("source").alias("z_source"), F.col("bits").alias("z_bits"), F.col("lead").alias("z_lead"), "smaller")
    alike = counted["source"].eqNullSafe(sizes["z_source"]) & (counted["bits"] == sizes["z_bits"]) & (counted["lead"] == sizes["z_lead"])
    within = F.coalesce(F.sum("n").over(before(bins[:3], bins[3:])), F.lit(0))
    starts = counted.withColumn("within", within).join(sizes, alike).select(*bins, (F.col("smaller") + F.col("within")).alias("before"))
    place = (
        source_targets(sized, "source", "size", weights, share, ceiling)
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("offset", _unit(F.lit(seed), _tag("source")))
        .withColumnRenamed("source", "s")
    )
    starts = starts.join(place, starts["source"].eqNullSafe(place["s"])).drop("s")
    renamed = starts.select(*[F.col(c).alias(f"b_{c}") for c in bins], "before", "source_size", "target", "rate", "offset")
    same = sized["source"].eqNullSafe(renamed["b_source"])
    for c in bins[1:]:
        same = same & (sized[c] == renamed[f"b_{c}"])
    numbered = sized.withColumn("row", F.row_number().over(Window.partitionBy(*bins).orderBy("digest", F.col("key").asc_nulls_first(), "size")))
    return numbered.join(renamed, same).select("key", "source", "digest", "size", "source_size", "target", "rate", "offset", (F.col("before") + F.col("row")).alias("upto"))


def _crossed(upto: Column) -> Column:
    """Whole numbers that the stretch of the row at this place crosses."""
    end, begin = upto * F.col("rate") + F.col("offset"), (upto - 1) * F.col("rate") + F.col("offset")
    return (F.floor(end) - F.floor(begin)).cast("long")


def copies(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: str = "mix") -> DataFrame:
    """How often the mix takes each row: ``key, source, size, source_size, target, copies, taken``.

    Within a source every document is expected ``target / source_size`` times. Documents are laid
    one after another in the order of (bits of the size, its leading five bits, MD5 of key and text,
    key); their expected copies are summed up, one seeded offset is added for the source, and a
    document is taken once for every whole number that its stretch crosses: floor or ceiling of the
    expected copies. The order by size makes each stretch of the sum hold like sizes, so the words
    taken come near the target whatever the offset.

    The running count has levels: counts are summed over the sizes of a source, then over small bins of
    a size, and rows are numbered within a bin, so no task holds a source, nor the rows of one key. Null keys and
    texts count as empty in the MD5, and a null text has no words; repeated rows are laid and taken
    each by itself; a null source is a source, the last one; one without words has target 0; an empty
    table gives no rows. Other columns are not read and may have any name.
    """
    laid = _laid(docs, key=key, source=source, text=text, weights=weights, share=share, ceiling=ceiling, seed=seed)
    return laid.withColumn("copies", _crossed(F.col("upto"))).select("key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, each as often as ``copies`` says, with unchanged columns.

    Rows meet their places by source and MD5 of key and text, not by key: rows that share a key are
    drawn each by itself, and rows alike in all of these take the places that they hold one after
    another. Columns may have any name.
    """
    laid = _laid(docs, key=key, source=source, text=text, weights=weights, share=share, ceiling=ceiling, seed=seed)
    places = laid.groupBy(F.concat("digest", _tag("source")).alias("at")).agg(F.min("upto").alias("first"), F.first("rate").alias("rate"), F.first("offset").alias("offset"))
    rows = docs.select(F.concat(_row_digest(key, text), _tag(source)).alias("id"), F.struct(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(docs.columns)]).alias("row"))
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("id").orderBy("id")))
    taken = rows.join(places, F.col("id") == F.col("at")).withColumn("copies", _crossed(F.col("first") + F.col("again") - 1)).filter("copies > 0")
    each = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(*[F.col(f"row.f{i}").alias(c) for i, c in enumerate(docs.columns)])
