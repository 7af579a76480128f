"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions (a node of 255 for each byte context). Every decision, in every
context of 0 to D bytes, has a Krichevsky-Trofimov estimate from its counts (a, b), and
``P(s) = 1/2 KT(s) + 1/2 prod P(c s)`` weights a context s against its longer ones. With the counts of
the whole training text at hand, the weights between depths are ``beta(s) = KT(s) / prod P(c s)`` and
the probability of a bit is ``(beta kt + p_deeper) / (beta + 1)`` from depth D up to 0. A path ends at
the deepest context in which that decision was seen in training (beyond it CTW would say 1/2).

The text scored is the token stream: words in lower-case A-Z, each followed by a space, then a
line end, the end of the text. Contexts before a text's first byte are line ends.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut, fresh_path, shuffle_partitions
from .textbytes import LOWER, mix64, slices, words

DEPTH = 5
#: Bytes of text that make a block: what a block asks of the whole corpus it asks once.
BLOCK_BYTES = 24 << 20
#: Bytes of text whose n-grams and words are summed together, on average.
GROUP_BYTES = 16 << 20
#: n-grams whose tree nodes are worked out together, on average.
GROUP_GRAMS = 1 << 18
#: Bytes of text that are read, counted, stored and scored at a time.
CHUNK = 1 << 18
#: Bytes of a row group of the blocks' file.
ROW_GROUP = 8 << 20
#: n-grams that are held unmerged.
MERGE = 1 << 19
END = b"\n"
TEXTS, GRAMS, WORDS, TOTALS = range(4)
ROW = "block long, kind int, g int, a binary, b binary"


# --- counts -----------------------------------------------------------------------------------


def held_out(doc_id: object) -> bool:
    """crc32 of the id as text modulo 10 is 0; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def stream(text: str | None) -> bytes:
    folded = (text or "").encode().translate(LOWER).split()
    return b"".join(w + b" " for w in folded) + END if folded else END


def grams(streams: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of each scored byte as ``prev .. prev_depth byte``, number by stream), for contexts nearest first."""
    pad = END * depth
    joined = pad + pad.join(streams)
    data = np.frombuffer(joined, dtype=np.uint8).astype(np.uint64)
    n = len(data) - depth
    keys = np.zeros(n, dtype=np.uint64)
    for back in range(1, depth + 1):
        keys = (keys << np.uint64(8)) | data[depth - back : depth - back + n]
    keys = (keys << np.uint64(8)) | data[depth:]
    counts = np.array([len(s) for s in streams], dtype=np.int64)
    begins = np.cumsum(counts + depth) - (counts + depth)
    keep = np.ones(n, dtype=bool)
    for i in range(depth):  # the paddings between streams aren't scored
        at = begins[1:] - depth + i
        keep[at] = False
    return keys[keep], counts


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[at], np.diff(np.concatenate([at, [len(keys)]]))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all parts in order, with the sums of their numbers."""
    if len(parts) == 1:
        return parts[0]
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    del order
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def _give_back() -> None:
    """Hand freed memory back to the system: a worker lives on, and the executor's other processes need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


# --- blocks -----------------------------------------------------------------------------------


def _squeeze(numbers: np.ndarray) -> bytes:
    """Whole numbers, 0 or more, as compressed differences: small where they are sorted."""
    steps = np.diff(numbers.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unsqueeze(blob: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(np.uint64).ravel(), dtype=np.uint64)


def _squeeze_words(found: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(b" " if w == END else w for w in found))


def _unsqueeze_words(blob: bytes) -> list[bytes]:
    return [END if w == b" " else w for w in zstandard.ZstdDecompressor().decompress(blob).split(b"\n")]


def _store(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


class Block:
    """Texts of a task with what they ask: their n-grams and words, each once, with its number in training texts."""

    def __init__(self, depth: int, groups: int):
        self.depth, self.groups = depth, groups
        # Any number will do that no other block has: it is written with the block's rows.
        self.number = int.from_bytes(os.urandom(8), "little", signed=True)
        self.size, self.texts, self.words = 0, [], Counter()
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        train = [not held_out(k) for k in ids.to_pylist()]
        streams = [stream(t) for t in texts.to_pylist()]
        for kind in (True, False):
            some = [s for s, t in zip(streams, train, strict=True) if t == kind]
            if not some:
                continue
            keys, n = _unique(grams(some, self.depth)[0])
            self.parts.append((keys, n if kind else np.zeros_like(n)))
            for s in some:
                self.words.update(s.split() if kind else dict.fromkeys(s.split(), 0))
            self.words[END] += len(some) if kind else 0
        # Merged when what came since is more than what was merged: few merges, and little beside the result.
        if sum(len(keys) for keys, _ in self.parts[1:]) > max(MERGE, len(self.parts[0][0])):
            self.parts = [_merge(self.parts)]
            _give_back()
        self.texts.append(_store(pa.table({"id": ids, "x": texts})))
        self.size += sum(map(len, streams))

    def rows(self) -> Iterator[pa.RecordBatch]:
        yield _row_batch([(self.number, TEXTS, 0, t, None) for t in self.texts])
        keys, n = _merge(self.parts)
        g = (mix64(keys) % np.uint64(self.groups)).astype(np.int64)
        order = np.argsort(g, kind="stable")
        cuts = np.searchsorted(g[order], np.arange(self.groups + 1))
        spans = [(i, order[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < b]
        yield _row_batch([(self.number, GRAMS, i, _squeeze(keys[at]), _squeeze(n[at])) for i, at in spans])
        dealt: dict[int, list[bytes]] = {}
        for w in sorted(self.words):
            dealt.setdefault(zlib.crc32(w) * self.groups >> 32, []).append(w)
        yield _row_batch([(self.number, WORDS, i, _squeeze_words(found), _squeeze(np.array([self.words[w] for w in found]))) for i, found in dealt.items()])


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "kind": pa.int32(), "g": pa.int32(), "a": pa.binary(), "b": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def blocks(docs: DataFrame, *, depth: int, key: str, text: str, block_bytes: int, groups: int) -> DataFrame:
    """Rows (block, kind, g, a, b), written once: a block's texts, and by group the n-grams and words that it asks for."""
    path = fresh_path(docs.sparkSession, "lm-blocks")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(depth, groups)
        for batch in batches:
            for a, b, _, _ in slices(batch.column(1), CHUNK):
                block.add(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a))
                if block.size >= block_bytes:
                    yield from block.rows()
                    block = Block(depth, groups)
                    _give_back()
        if block.texts:
            yield from block.rows()
        del block
        _give_back()

    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("x")).mapInArrow(gather, ROW)
    # Readers hold a row group at a time, and these rows are large.
    rows.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    return docs.sparkSession.read.schema(ROW).parquet(path)


def gram_totals(asked: DataFrame) -> DataFrame:
    """(gram, n) over all blocks."""

    def add(table: pa.Table) -> pa.Table:
        keys, n = _merge([(_unsqueeze(a), _unsqueeze(b).astype(np.int64)) for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True)])
        return pa.table({"gram": keys.view(np.int64), "n": n})

    return asked.groupBy("g").applyInArrow(add, "gram long, n long")


def gram_replies(asked: DataFrame, scores: DataFrame, groups: int) -> DataFrame:
    """Rows of what blocks asked for, with the scores (doubles) in the same order."""

    def look_up(table: pa.Table, known: pa.Table) -> pa.Table:
        gram, value = known.column("gram").to_numpy().view(np.uint64), known.column("log10p").to_numpy()
        order = np.argsort(gram)
        gram, value = gram[order], value[order]
        out = []
        for block, a in zip(table.column("block").to_pylist(), table.column("a").to_pylist(), strict=True):
            keys = _unsqueeze(a)
            at = np.minimum(np.searchsorted(gram, keys), len(gram) - 1)
            if not np.array_equal(gram[at], keys):
                raise KeyError("an n-gram without a score")
            out.append((block, GRAMS, 0, a, value[at].tobytes()))
        _give_back()
        return pa.Table.from_batches([_row_batch(out)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = (mix64(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(groups)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(g), *batch.columns], names=["g", "gram", "log10p"])

    dealt = scores.mapInArrow(deal, "g int, gram long, log10p double")
    return asked.groupBy("g").cogroup(dealt.groupBy("g")).applyInArrow(look_up, ROW)


def word_replies(asked: DataFrame) -> DataFrame:
    """Rows of what blocks asked for, with the words' numbers in all training texts; and a row a group with its sum and its number of known words."""

    def add(table: pa.Table) -> pa.Table:
        found = [(block, a, _unsqueeze_words(a), _unsqueeze(b).astype(np.int64).tolist()) for block, a, b in zip(*(table.column(c).to_pylist() for c in ("block", "a", "b")), strict=True)]
        total: Counter[bytes] = Counter()
        for _, _, words, n in found:
            for w, k in zip(words, n, strict=True):
                total[w] += k
        rows = [(block, WORDS, 0, a, _squeeze(np.array([total[w] for w in words]))) for block, a, words, _ in found]
        _give_back()
        both = np.array([sum(total.values()), sum(map(bool, total.values()))], dtype="<i8")
        return pa.Table.from_batches([_row_batch([*rows, (None, TOTALS, 0, both.tobytes(), None)])])

    return asked.groupBy("g").applyInArrow(add, ROW)


# --- the tree ---------------------------------------------------------------------------------


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    """ln Gamma(n + 1/2) for whole n >= 0."""
    return _lgamma(n + 0.5)


def _lgamma(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma_half(zeros) + _lgamma_half(ones) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


@dataclass
class Nodes:
    """Nodes of one depth: key = context << 8 | decision, with the counts of its two ways."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray

    @property
    def kt(self) -> np.ndarray:
        """Estimated probability of a 0."""
        return (self.zeros + 0.5) / (self.zeros + self.ones + 1.0)

    @property
    def seen(self) -> np.ndarray:
        return self.zeros + self.ones > 0


def parent_keys(keys: np.ndarray) -> np.ndarray:
    """The same decision in the context without its farthest byte."""
    return ((keys >> np.uint64(16)) << np.uint64(8)) | (keys & np.uint64(255))


def leaves(gram: np.ndarray, n: np.ndarray) -> tuple[Nodes, list[np.ndarray], np.ndarray]:
    """Nodes of the full depth from n-grams; for each of eight decisions the node of each n-gram; the bits."""
    byte, context = gram & np.uint64(255), gram >> np.uint64(8)
    keys, bits = [], []
    for i in range(8):
        decision = (np.uint64(1) << np.uint64(i)) | (byte >> np.uint64(8 - i))
        keys.append((context << np.uint64(8)) | decision)
        bits.append((byte >> np.uint64(7 - i)) & np.uint64(1))
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    one, weight = np.concatenate(bits).astype(bool), np.tile(n, 8).astype(np.float64)
    zeros = np.bincount(inverse, weights=np.where(one, 0.0, weight), minlength=len(every))
    ones = np.bincount(inverse, weights=np.where(one, weight, 0.0), minlength=len(every))
    return Nodes(every, zeros, ones), np.split(inverse, 8), np.array(bits, dtype=bool)


def weights(zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ln P, share of the own estimate, share of the deeper ones) of nodes with children: shares are beta / (beta + 1) and 1 / (beta + 1)."""
    own = log_kt(zeros, ones)
    beta = np.exp(np.clip(own - children, -700, 700))
    return math.log(0.5) + np.logaddexp(own, children), beta / (beta + 1.0), 1.0 / (beta + 1.0)


def through(nodes: Nodes, own: np.ndarray, deeper: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, c) of nodes from those of their parents.

    What a path makes of the probability p that it brings up to a node is linear: ``a + b p``; ``c`` is
    what it makes of a path that has seen nothing below the node.
    """
    return a + b * own * nodes.kt, b * deeper, np.where(nodes.seen, a + b * nodes.kt, c)


class Deep:
    """The levels of a group of n-grams from the leaves up: all n-grams of a context at the upper level must be here."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, levels: int):
        leaf, self.at, self.bits = leaves(gram, n)
        self.nodes, self.shares, self.parents = [leaf], [], []
        #: Sums of the children's ln P, for the nodes above the last level here.
        log_p = log_kt(leaf.zeros, leaf.ones)
        for level in range(levels + 1):
            below = self.nodes[-1]
            keys, parent = np.unique(parent_keys(below.keys), return_inverse=True)
            total = lambda x: np.bincount(parent, weights=x, minlength=len(keys))  # noqa: B023, E731
            node, children = Nodes(keys, total(below.zeros), total(below.ones)), total(log_p)
            self.parents.append(parent)
            if level == levels:
                self.above, self.children = node, children
            else:
                log_p, own, deeper = weights(node.zeros, node.ones, children)
                self.nodes.append(node)
                self.shares.append((own, deeper))

    def scores(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each n-gram, from (a, b, c) of the nodes above."""
        order = np.argsort(keys)
        at = order[np.searchsorted(keys[order], self.above.keys)]
        abc = a[at], b[at], c[at]
        for level in range(len(self.nodes) - 1, 0, -1):
            abc = through(self.nodes[level], *self.shares[level - 1], *(x[self.parents[level]] for x in abc))
        leaf = self.nodes[0]
        a, b, c = (x[self.parents[0]] for x in abc)
        p = np.clip(np.where(leaf.seen, a + b * leaf.kt, c), 1e-300, 1.0)
        out = np.zeros(len(self.at[0]))
        for node, bit in zip(self.at, self.bits, strict=True):
            out += np.log10(np.where(bit, np.maximum(1.0 - p[node], 1e-300), p[node]))
        return out


def _top(one: pa.Table) -> pa.Table:
    """(key, a, b, c) at depth 1, from the sums there: at most 256 contexts of 255 decisions."""
    keys, zeros, ones, children = (one.column(x).to_numpy() for x in ("key", "zeros", "ones", "p"))
    keys = keys.astype(np.uint64)
    log_p, own, deeper = weights(zeros, ones, children)
    decisions, parent = np.unique(keys & np.uint64(255), return_inverse=True)
    total = lambda x: np.bincount(parent, weights=x, minlength=len(decisions))
    root = Nodes(decisions, total(zeros), total(ones))
    _, root_own, root_deeper = weights(root.zeros, root.ones, total(log_p))
    # Above the root p stays as it is; where nothing at all was seen it is 1/2.
    n = len(decisions)
    abc = through(root, root_own, root_deeper, np.zeros(n), np.ones(n), np.full(n, 0.5))
    a, b, c = through(Nodes(keys, zeros, ones), own, deeper, *(x[parent] for x in abc))
    return pa.table({"k": keys.astype(np.int64), "a": a, "b": b, "c": c})


def cells(counts: DataFrame, *, depth: int, group_grams: int = GROUP_GRAMS) -> DataFrame:
    """(gram, log10p) of every n-gram in (gram, n).

    The deepest levels are worked out in groups of n-grams: a group holds whole contexts of
    ``depth - 2`` bytes (one at least), at most 2**24 n-grams each. Every level above is a table of
    nodes, summed up from the level below with a combine in each task; on the way down each level meets
    its parents by key. Depths 1 and 0 have 65,535 nodes at most.
    """
    if depth < 2 or depth > 7:
        raise ValueError("depth: 2 to 7 bytes")
    spark = counts.sparkSession
    counts = cut(counts)
    groups = max(shuffle_partitions(spark), -(-counts.count() // group_grams))
    deal = lambda context: F.pmod(F.xxhash64(context), F.lit(groups)).cast("int").alias("g")
    local = 1 if depth > 2 else 0  # levels between the leaves and the first table

    def sums(table: pa.Table) -> pa.Table:
        deep = Deep(*_gram_columns(table), local)
        return pa.table({"key": deep.above.keys.view(np.int64), "zeros": deep.above.zeros, "ones": deep.above.ones, "p": deep.children})

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, zeros, ones, children = (batch.column(c).to_numpy() for c in ("key", "zeros", "ones", "p"))
            log_p, own, deeper = weights(zeros, ones, children)
            nodes = Nodes(keys, zeros, ones)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parent_keys(keys.view(np.uint64)).view(np.int64)), *map(pa.array, (zeros, ones, log_p, own, deeper, nodes.kt, nodes.seen))], names=[c.split()[0] for c in level_schema.split(", ")])

    level_schema = "key long, parent long, zeros double, ones double, log_p double, own double, deeper double, kt double, seen boolean"
    node_schema = "key long, zeros double, ones double, p double"
    grouped = counts.select(deal(F.shiftrightunsigned("gram", 16 + 8 * local)), "gram", "n").groupBy("g")
    level, levels = grouped.applyInArrow(sums, node_schema), []
    for _ in range(depth - 1 - local, 1, -1):
        levels.append(cut(level.mapInArrow(weigh, level_schema)))
        level = levels[-1].groupBy(F.col("parent").alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_p").alias("p"))
    above = F.broadcast(spark.createDataFrame(_top(level.select("key", "zeros", "ones", "p").toArrow()), "k long, a double, b double, c double"))
    for level in reversed(levels):
        met = level.join(above, F.col("parent") == F.col("k"))
        start = F.when(F.col("seen"), F.col("a") + F.col("b") * F.col("kt")).otherwise(F.col("c"))
        above = met.select(F.col("key").alias("k"), (F.col("a") + F.col("b") * F.col("own") * F.col("kt")).alias("a"), (F.col("b") * F.col("deeper")).alias("b"), start.alias("c"))

    def score(table: pa.Table, nodes: pa.Table) -> pa.Table:
        abc = (nodes.column(c).to_numpy() for c in "abc")
        scores = Deep(*_gram_columns(table), local).scores(nodes.column("k").to_numpy().view(np.uint64), *abc)
        return pa.table({"gram": table.column("gram"), "log10p": scores})

    dealt = above.select(deal(F.shiftrightunsigned("k", 8)), "k", "a", "b", "c").groupBy("g")
    return grouped.cogroup(dealt).applyInArrow(score, "gram long, log10p double")


def _gram_columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()


class CellTable:
    """Open-addressed table of n-grams and their scores, read in whole arrays."""

    def __init__(self, gram: np.ndarray, score: np.ndarray):
        bits = max(4, int(2 * max(1, len(gram)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.scores = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits)
        used = np.zeros(1 << bits, dtype=bool)
        left, slot = np.arange(len(gram)), self._slot(gram)
        while len(left):
            open_ = ~used[slot]
            at, first = np.unique(slot[open_], return_index=True)
            put = left[open_][first]
            self.keys[at], self.scores[at], used[at] = gram[put], score[put], True
            rest = np.ones(len(left), dtype=bool)
            rest[np.flatnonzero(open_)[first]] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask
        self.used = used

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __getitem__(self, gram: np.ndarray) -> np.ndarray:
        """Scores; an n-gram that isn't in the table is an error."""
        slot = self._slot(gram)
        out = self.scores[slot]
        wrong = np.flatnonzero((self.keys[slot] != gram) | ~self.used[slot])
        while len(wrong):
            if not self.used[slot[wrong]].all():
                raise KeyError("an n-gram without a score")
            slot[wrong] = (slot[wrong] + 1) & self.mask
            out[wrong] = self.scores[slot[wrong]]
            wrong = wrong[(self.keys[slot[wrong]] != gram[wrong]) | ~self.used[slot[wrong]]]
        return out


class WordTable:
    """A block's words by hash, with their numbers and logarithms; no two words of the block share a hash."""

    def __init__(self, lists: list[bytes], counts: list[bytes], denominator: float):
        parts, numbers, end = [], [], 0
        for a, b in zip(lists, counts, strict=True):
            a, n = zstandard.ZstdDecompressor().decompress(a), _unsqueeze(b).astype(np.int64)
            if a[:1] == b" ":  # the end of a text comes before all words
                end, a, n = int(n[0]), a[1:], n[1:]
            parts.append(a)
            numbers.append(n)
        data = np.frombuffer(b"\n".join(parts), dtype=np.uint8)
        spans, count = words(data, np.array([0, len(data)])), np.concatenate(numbers)
        for self.lane in range(8):
            h = spans.hashes(lane=self.lane)
            order = np.argsort(h)
            h = h[order]
            if not (h[1:] == h[:-1]).any():
                break
        else:
            raise ValueError("words of one hash")
        self.hashes, self.count = h, count[order]
        self.logs = np.log10(self.count + 0.1) - denominator
        self.end_known, self.end_log = end > 0, math.log10(end + 0.1) - denominator

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, sum of logarithms) of each row, its end included."""
        spans = words(data, offsets)
        h = spans.hashes(lane=self.lane)
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        if len(h) and not (len(self.hashes) and np.array_equal(self.hashes[at], h)):
            raise KeyError("a word without a number")
        rows = len(offsets) - 1
        base = np.bincount(spans.row, weights=self.logs[at] if len(h) else None, minlength=rows)
        known = np.bincount(spans.row, weights=(self.count[at] > 0) if len(h) else None, minlength=rows).astype(np.int64)
        return spans.counts + 1, known + self.end_known, base + self.end_log


# --- scores -----------------------------------------------------------------------------------


def score_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES, group_grams: int = GROUP_GRAMS) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_stream_bytes, bits_per_byte`` for every row.

    Counts come from all documents that aren't held out. ``base_score`` is the smoothed unigram sum,
    ``score`` the log10 probability that the tree gives to the text's token stream, ``bits_per_byte``
    its code length over the stream's bytes. Null and empty texts hold the end alone. Without any
    training document N and V are 0 and every decision has probability 1/2. Rows with equal ids are
    scored each, a null id counts as an empty text; an empty table gives no rows. Other columns are not
    read and may have any name.

    Each task gathers its texts into blocks. A block names each of its n-grams and words once, with its
    counts; the sums over all blocks make the tree and the vocabulary, and a block gets back what it
    named. So no table that grows with the corpus is sent to the driver or to every worker, no key and
    no group of copies makes a block, and memory is bounded by a block (or one very long text).
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    groups = max(shuffle_partitions(spark), -(-int(size) // group_bytes))
    rows = blocks(docs, depth=depth, key=key, text=text, block_bytes=block_bytes, groups=groups)
    asked = rows.filter(F.col("kind") == GRAMS)
    vocabulary = cut(word_replies(rows.filter(F.col("kind") == WORDS)))
    n_train = n_types = 0
    for r in vocabulary.filter(F.col("kind") == TOTALS).select("a").toLocalIterator():  # a row a group
        n, v = np.frombuffer(r["a"], dtype="<i8").tolist()
        n_train, n_types = n_train + n, n_types + v
    replies = gram_replies(asked, cells(gram_totals(asked), depth=depth, group_grams=group_grams), groups)
    every = rows.filter(F.col("kind") == TEXTS).union(vocabulary.filter(F.col("kind") == WORDS)).union(replies)
    denominator = math.log10(n_train + 0.1 * (n_types + 1))
    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_stream_bytes", "bits_per_byte"]
    schema = docs.select(F.col(f"`{key}`")).schema
    for name, kind in zip(names[1:], ("boolean", "long", "long", "long", "double", "double", "long", "double"), strict=True):
        schema = schema.add(name, kind)

    def score(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        blob = lambda column, k: [table.column(column)[i].as_py() for i in np.flatnonzero(kind == k).tolist()]
        lookup = CellTable(np.concatenate([_unsqueeze(x) for x in blob("a", GRAMS)]), np.concatenate([np.frombuffer(x) for x in blob("b", GRAMS)]))
        known = WordTable(blob("a", WORDS), blob("b", WORDS), denominator)
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
        done = []
        for stored in blob("a", TEXTS):
            part = pa.ipc.open_stream(stored).read_all()
            streams = [stream(t) for t in part.column("x").to_pylist()]
            found, sizes = grams(streams, depth)
            ends = np.cumsum(sizes)
            sums = np.concatenate([[0.0], np.cumsum(lookup[found])])
            scores = sums[ends] - sums[ends - sizes]
            n_tokens, n_known, base = known.sums(np.frombuffer(b"".join(streams), dtype=np.uint8), np.concatenate([[0], ends]))
            held = [held_out(k) for k in part.column("id").to_pylist()]
            out = (held, n_tokens, n_known, np.full(len(held), n_train), base, scores, sizes, -scores / math.log10(2) / sizes)
            done.append(pa.table([part.column("id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names))
        _give_back()
        return pa.concat_tables(done)

    return every.groupBy("block").applyInArrow(score, schema)
