"""Token-id output: best-fit-decreasing packing of token ids into rows of one length."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids that a task gathers before it packs them: the bound on its memory and on the search.
BLOCK_TOKENS = 1 << 21


class FreeSpace:
    """Segment tree over capacities: the least capacity of at least a size that some open row has."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, capacity: int, row: int) -> None:
        if capacity:
            self.rows[capacity].append(row)
            i = capacity + self.leaves
            while i and not self.tree[i]:
                self.tree[i] = 1
                i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(capacity, row) of the best fit; the row leaves the tree."""
        i = size + self.leaves
        while not self.tree[i]:
            while i & 1:  # up until there is a right-hand neighbour
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            self.tree[i] = 0
            while i > 1 and not (self.tree[i] or self.tree[i ^ 1]):
                i >>= 1
                self.tree[i] = 0
        return capacity, row


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of item numbers, each of at most ``length`` in all. Items of size 0 are left out; equal sizes keep their order."""
    free, rows = FreeSpace(length), []
    for i in sorted((i for i, s in enumerate(sizes) if s), key=lambda i: -sizes[i]):
        if sizes[i] > length:
            raise ValueError("split first")
        if (found := free.take(sizes[i])) is None:
            found = length, len(rows)
            rows.append([])
        capacity, row = found
        rows[row].append(i)
        free.put(capacity - sizes[i], row)
    return rows


def split_lengths(n: int, length: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces of a document of n ids: whole rows, then the rest."""
    return ((a, min(n, a + length)) for a in range(0, n, length))


class _Memo(dict):
    """Ids of a space and what follows it up to the next space; worked out at the first question."""

    LIMIT = 400_000

    def __init__(self, encode):
        super().__init__()
        self.encode, self.unsafe = encode, set()

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        if word[:1].isspace():
            self.unsafe.add(word)
        ids = self[word] = tuple(self.encode(" " + word))
        return ids


class WordIds:
    """Ids of texts by a ``tiktoken`` rank file, memorised by word.

    The pattern puts a single space to the word after it, so a text falls apart before each space
    unless a run of white space goes on behind it: texts with two spaces in a row, or with other white
    space after a space, are encoded whole. Special strings are ordinary text.
    """

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo = _Memo(self.encoding.encode_ordinary)

    def encode(self, text: str, end: tuple[int, ...] = ()) -> np.ndarray:
        words = text.split(" ")
        first = self.encoding.encode_ordinary(words[0])
        memo = self.memo
        if "  " not in text:
            ids = np.fromiter(chain(first, chain.from_iterable(map(memo.__getitem__, words[1:])), end), dtype=np.uint32)
            if not memo.unsafe or memo.unsafe.isdisjoint(words):
                return ids
        return np.array([*self.encoding.encode_ordinary(text), *end], dtype=np.uint32)


@lru_cache(maxsize=2)
def word_ids(path: str, pattern: str) -> WordIds:
    """One for each worker process, so that its memory of words serves all of its tasks."""
    return WordIds(path, pattern)


def vocabulary_size(tokenizer: str, end_id: int | None) -> int:
    """One more than the greatest id: rank files have a line for each id."""
    with open(tokenizer, "rb") as f:
        n = sum(1 for _ in f)
    return max(n, -1 if end_id is None else end_id + 1)


def pack(docs: DataFrame, *, tokenizer: str, pattern: str, length: int = 2048, end_id: int | None = 50256, key: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS, id_bytes: int = 4, position_bytes: int = 4) -> DataFrame:
    """Rows of a packed matrix from all texts.

    ``pack_id`` (unique), ``n_tokens`` used, ``doc_ids`` and ``doc_starts`` (the document of each
    segment and the segment's first place in that document's ids), ``cu_seqlens`` (cumulative segment
    lengths, from 0), ``resets`` (places where positions start again at 0), the little-endian rows
    ``input_ids`` and ``position_ids`` of ``length`` numbers each, 0 after n_tokens, and the bytes of such
    a number, ``id_bytes`` and ``position_bytes`` (2 or 4, as asked; too few for the vocabulary or the
    length is an error).

    Each text is followed by ``end_id`` (none if None). Documents over ``length`` are split into whole
    rows and a rest, nothing is cut off; the pieces tell document and place, so texts come back exactly.
    Packing is by block of a task's rows: no shuffle, and memory bounded by ``block_tokens`` plus the
    longest document. Blocks leave at most a few open rows each. Null and empty texts hold their
    ``end_id`` alone, or nothing; keys may be null; repeated rows are packed each; an empty table gives no
    rows. Other columns are not read and may have any name.
    """
    for what, most, width in (("id", vocabulary_size(tokenizer, end_id), id_bytes), ("position", length, position_bytes)):
        if width not in (2, 4) or most > 1 << 8 * width:
            raise ValueError(f"pack: {width} bytes for {most} values of {what}")
    id_type = docs.schema[key].dataType
    schema = f"pack_id long, n_tokens int, doc_ids array<{id_type.simpleString()}>, doc_starts array<int>, cu_seqlens array<int>, resets array<int>, input_ids binary, position_ids binary, id_bytes int, position_bytes int"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        wide, far = f"<u{id_bytes}", f"<u{position_bytes}"
        words, serial = word_ids(tokenizer, pattern), TaskContext.get().partitionId() << 32
        block: list[tuple[object, np.ndarray]] = []

        def packed(arrow_key: pa.DataType) -> pa.RecordBatch:
            nonlocal serial
            items = [(i, a, b) for i, (_, ids) in enumerate(block) for a, b in split_lengths(len(ids), length)]
            rows = best_fit_decreasing([b - a for _, a, b in items], length)
            matrix, position = np.zeros((len(rows), length), dtype=wide), np.zeros((len(rows), length), dtype=far)
            columns: list[list] = [[] for _ in names]
            for r, row in enumerate(rows):
                at, ends = 0, [0]
                for item in row:
                    i, a, b = items[item]
                    matrix[r, at : at + b - a] = block[i][1][a:b]
                    position[r, at : at + b - a] = np.arange(b - a)
                    at += b - a
                    ends.append(at)
                values = (serial + r, at, [block[items[x][0]][0] for x in row], [items[x][1] for x in row], ends, ends[:-1], matrix[r].tobytes(), position[r].tobytes(), id_bytes, position_bytes)
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            serial += len(rows)
            block.clear()
            kinds = [pa.int64(), pa.int32(), pa.list_(arrow_key), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        held, kind = 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            for i, k in enumerate(keys):
                ids = words.encode(batch.column(1)[i].as_py() or "", () if end_id is None else (end_id,))
                block.append((k, ids))
                held += len(ids)
                if held >= block_tokens:
                    yield packed(kind)
                    held = 0
        if block:
            yield packed(kind)

    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, schema)


def unpack(packs: DataFrame) -> DataFrame:
    """(doc_id, start, ids, id_bytes) of every segment, ids of ``id_bytes`` bytes each: the way back from ``pack``."""
    width = F.col("id_bytes")
    numbers = F.transform(F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda i: F.struct(F.get("doc_ids", i).alias("doc_id"), F.get("doc_starts", i).alias("start"), F.substring(F.col("input_ids"), F.get("cu_seqlens", i) * width + 1, (F.get("cu_seqlens", i + 1) - F.get("cu_seqlens", i)) * width).alias("ids")))
    return packs.filter(F.size("doc_ids") > 0).select(F.explode(numbers).alias("s"), "id_bytes").select("s.doc_id", "s.start", "s.ids", "id_bytes")
