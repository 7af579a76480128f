"""N-gram Jaccard join: MinHash banding proposes, full n-gram sets decide.

Texts with the same n-gram set are one set from the start, so copies cost nothing further. Sets that
share a band hash are candidates. Before anything is chained, the sets of a band are compared with the
band's least one (the pivot): as 1 - Jaccard is a metric, two sets at the threshold t of which one is
that near to the pivot both have at least 2 t - 1 with it, so only such neighbours are kept together.
Sets that aren't near the pivot go on with the next one, and after some rounds are compared within
their band. Connected components are built from these verified links alone, and compared there,
blockwise. No list of pairs is ever made: each set gets its number of links, and each block a spanning
forest, from which the classes follow.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import cut, shuffle_partitions
from .components import components
from .textbytes import Spans, chain_hashes, mix64, slices, window_starts, words

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
#: Sets of a component that are compared at a time; larger components are dealt out as pairs of blocks.
BLOCK = 1024
#: Sets that are compared with a pivot at a time: its own set is sent once to so many.
PIVOT_BLOCK = 128
#: Pivots a band that are tried one after another.
ROUNDS = 2
#: Components with at least this share of the sets are broadcast with their size: by their share, that many at most.
HOT = 1000
#: Bytes of sets that are compared in one group of tasks' rows, on average.
GROUP_BYTES = 32 << 20
#: n-grams that more sets than this hold are counted by matrix product, the others pair by pair.
DENSE = 24


def choose_bands(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band with which ``threshold`` is still found at ``recall`` within ``max_hashes``.

    Where even bands of one row need more hashes than that, so many are taken: the recall is kept.
    """
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError(f"choose_bands: threshold {threshold}, recall {recall}")
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold**rows
        bands = math.ceil(math.log1p(-recall) / math.log1p(-p)) if p < 1 else 1
        # Bands never get fewer with the rows: no later count fits either.
        if best and bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def _multipliers(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingle_hashes(spans: Spans, size: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each n-gram; a text of fewer words than ``size`` has one n-gram: all its words."""
    hashes = spans.hashes(lane=lane)
    at = window_starts(spans, size)
    parts, rows = [chain_hashes(hashes, at, size, lane)], [spans.row[at]]
    for n in range(1, size):
        short = np.flatnonzero(spans.counts == n)
        parts.append(chain_hashes(hashes, spans.first[short], n, lane))
        rows.append(short)
    return np.concatenate(parts), np.concatenate(rows)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[list[np.ndarray], list[tuple[int | None, int | None]]]:
    """The sorted distinct n-gram hashes of each row, and 128 bits that tell the sets apart.

    The digest covers two independent hashes of each n-gram; an empty set has none.
    """
    spans = words(data, offsets)
    h, row = shingle_hashes(spans, size)
    order = np.argsort(row, kind="stable")
    h, second = h[order], mix64(shingle_hashes(spans, size, 1)[0][order])
    ends = np.cumsum(np.bincount(row, minlength=len(offsets) - 1))
    sets, digests = [], []
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        found, at = np.unique(h[a:b], return_index=True)
        sets.append(found)
        both = hashlib.blake2b(found.tobytes() + second[a:b][at].sum(dtype=np.uint64).tobytes(), digest_size=16).digest()
        digests.append(struct.unpack("<qq", both) if len(found) else (None, None))
    return sets, digests


def band_hashes(sets: np.ndarray, multipliers: np.ndarray, rows: int) -> np.ndarray:
    least = np.empty(len(multipliers), dtype=np.uint64)
    for i in range(0, len(sets), 4096):
        part = np.multiply.outer(multipliers, sets[i : i + 4096]).min(axis=1)
        least = part if i == 0 else np.minimum(least, part)
    bands = least.reshape(-1, rows)
    out = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for k in range(rows):
        out = mix64(out ^ bands[:, k]) + np.uint64(k + 1)
    return out


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """left x right: which sets have a Jaccard similarity of ``threshold`` or more. Exact on the full sets."""
    both = np.concatenate([left, right])
    sizes = np.array([len(sets[i]) for i in both], dtype=np.int64)
    owner = np.repeat(np.arange(len(both)), sizes)
    column = np.unique(np.concatenate([sets[i] for i in both]), return_inverse=True)[1]
    order = np.lexsort((owner, column))
    column, owner = column[order], owner[order]
    n = len(left)
    is_left = owner < n
    width = column[-1] + 1
    in_left, in_right = np.bincount(column[is_left], minlength=width), np.bincount(column[~is_left], minlength=width)
    common = np.zeros(n * len(right), dtype=np.int64)
    useful = (in_left > 0) & (in_right > 0)
    dense = useful & (in_left * in_right > DENSE * DENSE)
    sparse = useful & ~dense
    # Rare n-grams: each left holder with each right holder.
    some = sparse[column]
    c, o, of_left = column[some], owner[some], is_left[some]
    lc, lo, rc, ro = c[of_left], o[of_left], c[~of_left], o[~of_left] - n
    begin = np.searchsorted(rc, lc)
    times = np.searchsorted(rc, lc, "right") - begin
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    common += np.bincount(np.repeat(lo, times) * len(right) + ro[np.repeat(begin, times) + step], minlength=len(common))
    common = common.reshape(n, len(right))
    # Frequent ones: products of 0/1 matrices, some columns at a time.
    ids = np.flatnonzero(dense)
    slot = np.full(width, -1)
    for i in range(0, len(ids), 2048):
        part = ids[i : i + 2048]
        slot[:] = -1
        slot[part] = np.arange(len(part))
        here = slot[column] >= 0
        matrix = np.zeros((len(both), len(part)), dtype=np.float32)
        matrix[owner[here], slot[column[here]]] = 1
        common += (matrix[:n] @ matrix[n:].T).astype(np.int64)
    total = sizes[:n, None] + sizes[None, n:]
    return common * (1 + threshold) >= threshold * total - 1e-9


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = np.minimum(after, after[after])
        if np.array_equal(after, label):
            return label
        label = after


def _near_pivot(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    """The greatest Jaccard similarity of each set with any of the pivot's sets (a key with several texts has several)."""
    best = np.zeros(len(sets))
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    flat, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    for pivot in pivots:
        slot = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
        common = np.bincount(owner[pivot[slot] == flat], minlength=len(sets))
        best = np.maximum(best, common / (sizes + len(pivot) - common))
    return best


def _groups(spark: SparkSession, n_bytes: int) -> int:
    """Number of groups that keeps each within ``GROUP_BYTES`` on average."""
    return max(4 * shuffle_partitions(spark), -(-n_bytes // GROUP_BYTES))


def _with_pivots(open_: DataFrame, blobs: DataFrame, threshold: float, block: int, n_bytes: int) -> DataFrame:
    """(node, pivot, near, beside) of every pair of a set and its band's least set.

    near: at the threshold; beside: no set at the threshold from a near one is farther away. A pivot's
    sets are dealt out in blocks, its own set goes to each of them.
    """
    spark = open_.sparkSession
    pairs = open_.filter("rep <> least").select(F.col("rep").alias("node"), F.col("least").alias("pivot")).distinct()
    blocks = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(min(block, PIVOT_BLOCK))).cast("int").alias("n"))
    dealt = pairs.join(blocks, "pivot").select("node", "pivot", F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("part"))
    own = blocks.select(F.col("pivot").alias("node"), "pivot", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    sets = blobs.select("node", "blob")
    group = F.pmod(F.xxhash64("pivot", "part"), F.lit(_groups(spark, n_bytes))).alias("g")
    rows = dealt.union(own).join(sets, "node").select(group, "node", "pivot", "part", "blob")

    def compare(table: pa.Table) -> pa.Table:
        node, pivot, part = (table.column(c).to_numpy() for c in ("node", "pivot", "part"))
        blobs, out = table.column("blob"), [[], [], []]
        order = np.lexsort((node, part, pivot))
        cuts = np.flatnonzero((np.diff(pivot[order]) != 0) | (np.diff(part[order]) != 0)) + 1
        for some in np.split(order, cuts):
            sets = [np.frombuffer(blobs[int(x)].as_buffer(), dtype="<u8") for x in some]
            is_pivot = node[some] == pivot[some]
            others = np.flatnonzero(~is_pivot)
            if not len(others) or not is_pivot.any():
                continue
            best = _near_pivot([sets[i] for i in others], [sets[i] for i in np.flatnonzero(is_pivot)])
            for column, value in zip(out, (node[some][others], pivot[some][others], best), strict=True):
                column.append(value)
        columns = [np.concatenate(x) if x else np.zeros(0, dtype=kind) for x, kind in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table(dict(zip(("node", "pivot", "j"), columns, strict=True)))

    found = rows.groupBy("g").applyInArrow(compare, "node long, pivot long, j double").groupBy("node", "pivot").agg(F.max("j").alias("j"))
    return cut(found.select("node", "pivot", (F.col("j") >= threshold - 1e-9).alias("near"), (F.col("j") >= 2 * threshold - 1 - 1e-9).alias("beside")))


def _compared(members: DataFrame, blobs: DataFrame, threshold: float, block: int, n_bytes: int) -> DataFrame:
    """(node, root, links): all sets (node) of a group (component) compared with each other, blockwise; rows for linked sets only."""
    spark = members.sparkSession
    sizes = members.groupBy("component").agg(F.count("*").alias("k")).withColumn("n", F.ceil(F.col("k") / F.lit(block)).cast("int"))
    # The few components with a large share of all sets are broadcast, so none is gathered in one task.
    hot = F.broadcast(sizes.filter(F.col("k") * HOT > members.count()))
    often, seldom = members.join(hot, "component"), members.join(hot.select("component"), "component", "left_anti").join(sizes, "component")
    placed = often.unionByName(seldom).drop("k").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    other = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("i", F.least("own", "_o")).withColumn("j", F.greatest("own", "_o"))
    group = F.pmod(F.xxhash64("component", "i", "j"), F.lit(_groups(spark, n_bytes))).alias("g")
    dealt = other.join(blobs, "node").select(group, "node", "component", "own", "i", "j", "m", "blob")

    def verify(table: pa.Table) -> pa.Table:
        node, component, own, i, j, m = (table.column(c).to_numpy() for c in ("node", "component", "own", "i", "j", "m"))
        blobs = table.column("blob")
        out: list[list[np.ndarray]] = [[], [], []]
        order = np.lexsort((node, j, i, component))
        cuts = np.flatnonzero((np.diff(component[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
        for part in np.split(order, cuts):
            sets = [np.frombuffer(blobs[int(x)].as_buffer(), dtype="<u8") for x in part]
            at = np.arange(len(part))
            if i[part[0]] == j[part[0]]:
                left = right = at
            else:
                left, right = at[own[part] == i[part[0]]], at[own[part] == j[part[0]]]
            if not len(left) or not len(right):
                continue
            linked = _links(sets, left, right, threshold)
            if left is right:
                np.fill_diagonal(linked, False)
            weight = m[part]
            links = np.zeros(len(part), dtype=np.int64)
            links[left] += linked @ weight[right]
            if left is not right:
                links[right] += linked.T @ weight[left]
            a, b = np.nonzero(linked)
            root = _forest(len(part), left[a], right[b])
            some = links > 0
            out[0].append(node[part][some])
            out[1].append(node[part][root][some])
            out[2].append(links[some])
        columns = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out]
        return pa.table(dict(zip(("node", "root", "links"), columns, strict=True)))

    return dealt.groupBy("g").applyInArrow(verify, "node long, root long, links long")


def _shared(by_band: DataFrame) -> DataFrame:
    """(band, rep, least) of the bands that more than one set has."""
    least = by_band.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least <> most").select("band", "least")
    return cut(by_band.join(least, "band"))


def jaccard_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """One row a document: ``key, class_id, n_links``.

    ``n_links`` is the number of other documents whose set of ``size``-word n-grams (words as they are,
    split at ASCII white space) has a Jaccard similarity of ``threshold`` or more; ``class_id`` is the
    least key of the documents reachable over links. Bands and rows are chosen so that a pair exactly
    at the threshold is proposed with probability ``recall`` (surely so for equal sets); what is
    proposed is decided on the full sets. A text of fewer words has one n-gram, all its words; one
    without words (null, empty) has no links and is its own class. Keys are integers; rows with the
    same key are one document, and a null key is a class of its own without links; an empty table
    gives no rows. Other columns are not read. Sets are told apart by 128 bits over two hashes of each
    n-gram, n-grams within a comparison by 64 bits.

    ``rounds`` pivots a band are tried before what is left of a band is compared within itself; they
    decide where the work is done, not the result.
    """
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, recall)
    multipliers = _multipliers(bands * rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                sets, digests = shingle_sets(data, offsets, size)
                keys = [band_hashes(s, multipliers, rows).view(np.int64).tolist() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)), pa.array(keys, pa.list_(pa.int64()))], names=["id", "d1", "d2", "bands"])

    signed = cut(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("_text")).mapInArrow(sign, "id long, d1 long, d2 long, bands array<long>"))
    has = signed.filter("d1 is not null and id is not null")
    # Equal sets: the least document stands for them all, with their number. Band hashes follow from the set.
    sets = cut(has.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("m")))
    stands = has.join(sets.select(F.col("rep"), F.col("d1").alias("_1"), F.col("d2").alias("_2")), (F.col("id") == F.col("rep")) & (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")))
    open_ = _shared(stands.select("rep", F.explode("bands").alias("band")))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("_text")):
                found, digests = shingle_sets(data, offsets, size)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("m"), *(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)), pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())], names=["node", "m", "d1", "d2", "blob"])

    # The whole sets of those texts that have a candidate, once; a repeated row is one document.
    wanted = open_.select("rep").distinct().join(sets.groupBy("rep").agg(F.sum("m").alias("m")), "rep")
    texts = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("_text")).join(wanted, F.col("node") == F.col("rep"))
    blobs = cut(texts.select("node", "m", "_text").mapInArrow(sets_of, "node long, m long, d1 long, d2 long, blob binary").filter("d1 is not null").dropDuplicates(["node", "d1", "d2"]).drop("d1", "d2"))
    n_bytes = int(blobs.agg(F.sum(F.octet_length("blob"))).first()[0] or 0)
    edges = None
    for _ in range(rounds):
        met = _with_pivots(open_, blobs, threshold, block, n_bytes)
        kept = met.filter("beside").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        edges = kept if edges is None else edges.union(kept)
        far = met.filter("not near").select(F.col("node").alias("_n"), F.col("pivot").alias("_p"))
        open_ = _shared(open_.join(far, (F.col("rep") == F.col("_n")) & (F.col("least") == F.col("_p"))).select("rep", "band"))
        if open_.isEmpty():
            break
    else:
        # What no pivot took: compared within the band; bands of the same sets are compared once.
        alike = open_.groupBy("band").agg(F.count("*").alias("k"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("h"), F.min("rep").alias("l")).groupBy("k", "h", "l").agg(F.min("band").alias("band"))
        rest = _compared(open_.join(alike.select("band"), "band").select(F.col("rep").alias("node"), F.col("band").alias("component")), blobs, threshold, block, n_bytes)
        rest = rest.select(F.col("node").alias("a"), F.col("root").alias("b"))
        edges = rest if edges is None else edges.union(rest)
    found = cut(_compared(components(edges), blobs, threshold, block, n_bytes))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    rep = sets.join(links, F.col("rep") == links["node"], "left").drop("node").join(classes, F.col("rep") == classes["node"], "left")
    rep = rep.select(F.col("d1").alias("_1"), F.col("d2").alias("_2"), F.coalesce("component", "rep").alias("_class"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("_links"))
    done = signed.join(rep, (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")) & F.col("id").isNotNull(), "left")
    return done.select(F.col("id").alias(key), F.coalesce("_class", "id").alias("class_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose document is the least of its class; a null key stays."""
    classes = jaccard_classes(docs, key=key, **options).filter(F.col(key) != F.col("class_id")).select(F.col(key).alias("_gone")).distinct()
    return docs.join(classes, docs[key] == classes["_gone"], "left_anti")
