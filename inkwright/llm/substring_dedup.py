"""Substring dedup with difference-cover anchors.

Two equal windows of ``window`` words start anywhere in their documents. Anchors are taken only at
places that are in a difference cover modulo a period p: for any two places i and j some shift d < p
brings both i + d and j + d into the cover. So equal windows share an anchor of ``window - p + 1``
words that starts at the same place in both, and it is enough to hash those. Where such an anchor
occurs twice, the windows around it are hashed whole (the extension), and equal ones are found exactly.

Both groupings are by hash and combine first within a task: a hash goes to its group once a task,
with its first place; later places of the same task are already known to be repeats. So a passage that
a third of all documents share costs its group one entry a task.

Repeated rows are entered once: a window doesn't repeat itself. Where rows of one key differ in text,
a tag tells their texts apart, so what is found in one text isn't removed from another; all others
have the tag 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut, shuffle_partitions, small_or_shuffled
from .textbytes import chain_hashes, slices, window_starts, words

#: Perfect difference sets, by period. Each difference modulo the period occurs.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
WINDOW = 20
FLUSH = 1 << 20
#: Bytes of text whose entries make a group: a group's entries take about as much.
GROUP_BYTES = 16 << 20
#: Keys with more than one text: up to so many are broadcast.
FEW = 1 << 17
_MISSING = np.iinfo(np.int64).min
GROUP_SCHEMA = "g int, a binary, b binary"


def period_for(window: int) -> int:
    """The longest period that leaves an anchor of at least a third of the window; 1 (all places) for short windows."""
    return max([p for p in COVERS if window - p + 1 >= max(4, window // 3)], default=1)


def _six(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6]


def _from_six(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b), 8), dtype=np.uint8)
    out[:, :6] = b
    return out.view(np.uint64).ravel()


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the entry before; the first entry does."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return new


def _runs(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals in order of document, tag and start, merged where they touch."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], (start + length)[order]
    other = _changes(doc, tag)
    rank = np.cumsum(other) << 40
    reach = np.maximum.accumulate(rank + end)
    new = other.copy()
    new[1:] |= (rank + start)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], tag[first], start[first], (reach - rank)[last] - start[first]


def _by(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by target, and first and end of each target's stretch."""
    order = np.argsort(target, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(target[order]) != 0]))
    return order, first, np.concatenate([first[1:], [len(order)]])


def _interval_rows(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, length: np.ndarray, groups: int) -> pa.RecordBatch:
    """A row for each of the groups that documents are dealt to: its documents' merged intervals."""
    doc, tag, start, length = _runs(doc, tag, start, length)
    mixed = (doc.astype(np.uint64) ^ tag.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    target = (mixed >> np.uint64(24)).astype(np.int64) % groups
    order, first, end = _by(target)
    doc, tag, start, length = doc[order].astype("<i8"), tag[order].astype("<i8"), start[order].astype("<i4"), length[order].astype("<i4")
    a = [doc[x:y].tobytes() + tag[x:y].tobytes() for x, y in zip(first, end, strict=True)]
    b = [start[x:y].tobytes() + length[x:y].tobytes() for x, y in zip(first, end, strict=True)]
    return _rows(groups + target[order][first], a, b)


def _read_intervals(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    whose = [np.frombuffer(x, dtype="<i8").reshape(2, -1) for x in table.column("a").to_pylist()]
    both = [np.frombuffer(x, dtype="<i4").reshape(2, -1).astype(np.int64) for x in table.column("b").to_pylist()]
    return (*np.concatenate(whose, axis=1), *np.concatenate(both, axis=1))


def _rows(g: np.ndarray, a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["g", "a", "b"])


def _entry_rows(h: np.ndarray, h2: np.ndarray, doc: np.ndarray, place: np.ndarray, tag: np.ndarray, groups: int) -> pa.RecordBatch:
    """Rows (group, -, hashes, documents with tags and places) of entries."""
    # Dealt by bits that the entry itself keeps but for 16: over 2**32 groups are in reach.
    g = ((h >> np.uint64(24)) % np.uint64(groups)).astype(np.int64)
    order, first, last = _by(g)
    g, h, h2, doc, place, tag = g[order], h[order], h2[order], doc[order], place[order], tag[order]
    a, b = [], []
    for s, e in zip(first, last, strict=True):
        by_doc = np.lexsort((tag[s:e], doc[s:e]))
        ids, tags = doc[s:e][by_doc], tag[s:e][by_doc]
        new = _changes(ids, tags)
        index = np.empty(e - s, dtype=np.int64)
        index[by_doc] = np.cumsum(new) - 1
        ids, tags = ids[new], tags[new]
        wide = "<u2" if len(ids) < 1 << 16 and place[s:e].max() < 1 << 16 else "<u4"
        head = np.array([e - s, len(ids), 2 if wide == "<u2" else 4], dtype="<i8").tobytes()
        a.append(head + _six(h[s:e]).tobytes() + _six(h2[s:e]).tobytes())
        b.append(ids.astype("<i8").tobytes() + tags.astype("<i8").tobytes() + index.astype(wide).tobytes() + place[s:e].astype(wide).tobytes())
    return _rows(g[first], a, b)


def _read_entries(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, ids, width = np.frombuffer(a, dtype="<i8", count=3)
    hashes = np.frombuffer(a, dtype=np.uint8, offset=24).reshape(-1, 6)
    docs, tags = np.frombuffer(b, dtype="<i8", count=2 * ids).reshape(2, -1)
    rest = np.frombuffer(b, dtype=f"<u{width}", offset=16 * ids).astype(np.int64)
    return _from_six(hashes[:n]), _from_six(hashes[n:]), docs[rest[:n]], rest[n:], tags[rest[:n]]


class _Combiner:
    """Entries of a task: (hash, hash, doc, place, tag), first places to the groups and repeats apart."""

    def __init__(self, groups: int, length: int, back: int, first_repeats: bool):
        #: Intervals cover ``back`` places before a repeat, ``length`` in all; first_repeats: the first place of a repeated hash counts too.
        self.groups, self.length, self.back, self.first_repeats = groups, length, back, first_repeats
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *entry: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(entry)
        self.size += len(entry[0])
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        held = [np.concatenate(x) for x in zip(*self.held, strict=True)]
        self.held, self.size = [], 0
        entries, first, repeat = _grouped(*held, self.first_repeats)
        if repeat.any():
            _, _, doc, place, tag = (x[repeat] for x in entries)
            yield _interval_rows(doc, tag, place - self.back, np.full(len(doc), self.length), self.groups)
        yield _entry_rows(*(x[first] for x in entries), self.groups)


def _grouped(h: np.ndarray, h2: np.ndarray, doc: np.ndarray, place: np.ndarray, tag: np.ndarray, first_too: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The different entries in order, which stand at their hash's first (doc, place), and which repeat.

    Repeats are the entries at a later (doc, place) and, if first_too, the first ones that have a later one.
    """
    order = np.lexsort((tag, place, doc, h2, h) if tag.any() else (place, doc, h2, h))
    entries = [x[order] for x in (h, h2, doc, place, tag)]
    once = _changes(*entries)
    if not once.all():
        entries = [x[once] for x in entries]
    h, h2, doc, place, _ = entries
    group = np.cumsum(_changes(h, h2)) - 1
    begin = np.flatnonzero(_changes(group))[group]
    first = (doc == doc[begin]) & (place == place[begin])
    if not first_too:
        return entries, first, ~first
    several = np.zeros(group[-1] + 1, dtype=bool)
    several[group[~first]] = True
    return entries, first, several[group]


def _find(entries: DataFrame, groups: int, length: int, back: int, first_repeats: bool) -> DataFrame:
    """(doc, tag, intervals) of repeated places, a row a text, from entries and intervals known already."""

    def group(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= groups:
            return table
        parts = [_read_entries(a, b) for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True)]
        entries, _, repeat = _grouped(*(np.concatenate(x) for x in zip(*parts, strict=True)), first_repeats)
        if not repeat.any():
            return table.slice(0, 0)
        _, _, doc, place, tag = (x[repeat] for x in entries)
        return pa.Table.from_batches([_interval_rows(doc, tag, place - back, np.full(len(doc), length), groups)])

    def gather(table: pa.Table) -> pa.Table:
        doc, tag, start, length = _runs(*_read_intervals(table))
        first = np.flatnonzero(_changes(doc, tag))
        blobs = [np.concatenate([start[x:y], length[x:y]]).astype("<i4").tobytes() for x, y in zip(first, [*first[1:], len(doc)], strict=True)]
        return pa.table({"d2": doc[first], "t2": tag[first], "spans": pa.array(blobs, pa.binary())})

    # Enough partitions for the groups, whatever the session's number is.
    parts = max(shuffle_partitions(entries.sparkSession), groups // 4)
    found = entries.repartition(parts, "g").groupBy("g").applyInArrow(group, GROUP_SCHEMA)
    return found.repartition(parts, "g").groupBy("g").applyInArrow(gather, "d2 long, t2 long, spans binary")


def _marked(spans: bytes | None, n: int) -> np.ndarray:
    """Which of n places the intervals cover."""
    if not spans:
        return np.zeros(n, dtype=bool)
    change = np.zeros(n + 1, dtype=np.int64)
    start, length = np.frombuffer(spans, dtype="<i4").reshape(2, -1).astype(np.int64)
    np.add.at(change, np.clip(start, 0, n), 1)
    np.add.at(change, np.clip(start + length, 0, n), -1)
    return np.cumsum(change[:-1]) > 0


def dedup_substrings(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` plus ``n_words, n_removed, kept_text``.

    Words are split at ASCII white space and compared as they are. A word is removed if it lies in a
    window of ``window`` words whose word sequence also starts earlier: in a document of a smaller
    integer ``key``, or in the same document at an earlier place. Windows are judged on the input.
    ``kept_text`` holds the other words, joined by one space.

    Null and empty texts have no words; a null key comes before all others; texts under ``window`` words
    lose nothing; an empty table gives no rows. Rows with the same key are one document: where such rows
    hold the same text, they keep the same words; where their texts differ, each counts its own places.
    Columns named like the three results are replaced, all others may have any name. Windows are told
    apart by 96 bits over two independent hashes of each word, different texts of one key by 64 bits.

    The number of groups that entries are dealt to follows from the counted bytes of all texts.
    """
    spark = docs.sparkSession
    period = period_for(window)
    cover = np.zeros(period, dtype=bool)
    cover[list(COVERS.get(period, (0,)))] = True
    anchor = window - period + 1
    results = ("n_words", "n_removed", "kept_text")
    kept = [c for c in docs.columns if c not in results]
    rest = [c for c in kept if c != text]

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Combiner(groups, period, period - 1, True)
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, data, offsets in slices(batch.column(2)):
                spans = words(data, offsets)
                at = window_starts(spans, anchor)
                row = spans.row[at]
                place = at - spans.first[row]
                some = cover[place % period] & (spans.counts[row] >= window)
                at, row, place = at[some], row[some], place[some]
                h = chain_hashes(spans.hashes(), at, anchor)
                yield from out.add(h, h & np.uint64(0), ids[a:b][row], place, tags[a:b][row])
        yield from out.flush()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Combiner(groups, window, 0, False)
        for batch in batches:
            ids, tags, marks = batch.column("d").to_numpy(), batch.column("t").to_numpy(), batch.column("spans")
            for a, b, data, offsets in slices(batch.column("x")):
                spans = words(data, offsets)
                at = window_starts(spans, window)
                marked = np.concatenate([np.zeros(0, dtype=bool), *(_marked(marks[a + r].as_py(), n) for r, n in enumerate(spans.counts))])
                at = at[marked[at]]
                row = spans.row[at]
                # Two hashes of each word, each chained over the window: 96 bits of them tell windows apart.
                h, h2 = (chain_hashes(spans.hashes(lane=lane), at, window, lane) for lane in (0, 1))
                yield from out.add(h, h2, ids[a:b][row], at - spans.first[row], tags[a:b][row])
        yield from out.flush()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_of, texts = batch.column("spans"), batch.column("x")
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, min(512, batch.num_rows - a))
                n_words, n_removed, left = [], [], []
                for i in range(part.num_rows):
                    tokens = (texts[a + i].as_py() or "").encode().split()
                    spans = spans_of[a + i].as_py()
                    n_words.append(len(tokens))
                    if spans:
                        removed = _marked(spans, len(tokens))
                        tokens = [w for w, r in zip(tokens, removed.tolist(), strict=True) if not r]
                    n_removed.append(n_words[-1] - len(tokens))
                    left.append(b" ".join(tokens).decode())
                inner = part.column("r")
                columns = [part.column("x") if c == text else inner.field(rest.index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.string())], names=[*kept, *results])

    # Own names for all columns, the others' by number within a struct: theirs may be any.
    tag = F.xxhash64(F.col(f"`{text}`"))
    whole = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_MISSING)).alias("d"), tag.alias("t"), F.col(f"`{text}`").alias("x"), F.struct(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(rest)]).alias("r"))
    # Keys with more than one text, seldom any: only their texts keep a tag.
    by_key = cut(whole.groupBy("d").agg(F.min("t").alias("least"), F.max("t").alias("most"), F.sum(F.octet_length("x")).alias("size")))
    groups = max(1, -(-int(by_key.agg(F.sum("size")).first()[0] or 0) // GROUP_BYTES))
    several = small_or_shuffled(by_key.filter("least <> most").select(F.col("d").alias("s")), FEW)
    whole = whole.join(several, F.col("d") == F.col("s"), "left").withColumn("t", F.when(F.col("s").isNull(), 0).otherwise(F.col("t"))).drop("s")
    near = _find(whole.select("d", "t", "x").mapInArrow(anchors, GROUP_SCHEMA), groups, period, period - 1, True)
    # The same exchange of the texts serves both joins.
    whole = whole.repartition(shuffle_partitions(spark), "d", "t")
    same = (F.col("d") == F.col("d2")) & (F.col("t") == F.col("t2"))
    around = whole.join(near.hint("shuffle_hash"), same).select("d", "t", "x", "r", "spans")
    again = _find(around.mapInArrow(windows, GROUP_SCHEMA), groups, window, 0, False)
    joined = whole.join(again.hint("shuffle_hash"), same, "left").select("x", "r", "spans")
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return joined.mapInArrow(keep, schema)
