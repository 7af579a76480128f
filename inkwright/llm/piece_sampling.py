"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has an arc for every vocabulary piece that matches a stretch of it, and arcs for
single bytes where a character has no piece. A forward pass sums the weights of all ways to reach each
place; a backward pass draws the last arc by its share, then the one before, and so on: an exact
sample from all segmentations, each with probability in proportion to the product of its weights.

No piece crosses from a sign to a following space mark, so the lattice falls apart there: distinct
stretches are solved once a slice, and all their occurrences are sampled in step. Each draw is a hash
of (seed, row key, place), so a row's segmentation doesn't depend on its neighbours or on the machine.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import LOW, eights, equal_spans, mix64, slices, span_hashes, span_ids

MARK = "▁".encode()
#: Weight of a byte arc: less than any piece's.
BYTE_RANK = 1 << 20
#: Stretches over so many bytes are solved one by one: in step with others each byte would cost a pass.
LONG_STRETCH = 512
#: Bytes of text that are solved together: equal words share a lattice.
SLICE = 1 << 21


class Pieces:
    """The vocabulary as byte strings with log weights.

    The file's scores are ranks of merges, which aren't log probabilities; as a frequency falls about
    as 1/rank, a piece of rank r weighs ``(r + 1) ** -power``; power is the inverse temperature.
    """

    def __init__(self, model: str, power: float = 1.0):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        n = p.get_piece_size()
        self.byte_id = np.full(256, -1, dtype=np.int64)
        # Stored forms: a space instead of the mark, the byte itself for byte pieces.
        self.raw: list[bytes] = [b""] * n
        rank, ids = 0, []
        self.log_weight = np.full(n, -np.inf)
        for i in range(n):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
                self.log_weight[i] = -power * np.log(BYTE_RANK + 1)
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                raw = piece.encode().replace(MARK, b" ")
                if b" " in raw.lstrip(b" ") or any(c in raw for c in b"\n\0"):
                    raise ValueError(f"piece {piece!r} crosses a word's end")
                self.raw[i] = raw
                self.log_weight[i] = -power * np.log(rank + 1)
                ids.append(i)
                rank += 1
        if (self.byte_id < 0).any():
            raise ValueError("decoding needs a piece for every byte")
        self.lengths = np.array([len(r) for r in self.raw], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.begin = np.cumsum(self.lengths) - self.lengths
        ids_ = np.array(ids)
        # Most stretches are no piece: a bit for the first eight bytes and the length tells them apart before any search.
        self.maybe = np.zeros(1 << 22, dtype=bool)
        first = eights(self.flat)[self.begin[ids_]]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n_bytes in np.unique(self.lengths[ids_]).tolist():
            some = np.flatnonzero(self.lengths[ids_] == n_bytes)
            head = first[some] & LOW[min(n_bytes, 8)]
            self.maybe[self.bit(head, n_bytes)] = True
            begin = self.begin[ids_[some]]
            keys = head if n_bytes <= 8 else span_hashes(self.flat, begin, begin + n_bytes)
            order = np.argsort(keys)
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two pieces of one form or hash")
            self.by_length[n_bytes] = keys[order], ids_[some][order]

    @staticmethod
    def bit(head: np.ndarray, length: int) -> np.ndarray:
        return mix64(head + np.uint64(length * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(42)

    def matches(self, data: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece id) of every piece that the bytes hold within ``room`` bytes of a place."""
        heads, places, found = eights(data), [], []
        for length, (keys, of) in self.by_length.items():
            at = np.flatnonzero(room >= length)
            key = heads[at] & LOW[min(length, 8)]
            some = np.flatnonzero(self.maybe[self.bit(key, length)])
            at, key = at[some], key[some]
            if not len(at):
                continue
            if length > 8:
                key = span_hashes(data, at, at + length)
            slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero(keys[slot] == key)
            at, ids = at[hit], of[slot[hit]]
            if length > 8:  # up to eight bytes the key is the piece itself
                sure = equal_spans(np.concatenate([data, self.flat]), at, len(data) + self.begin[ids], np.full(len(at), length))
                at, ids = at[sure], ids[sure]
            places.append(at)
            found.append(ids)
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate(places), np.concatenate(found)) if places else (none, none)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        at = np.repeat(self.begin[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.flat[at].tobytes()


@lru_cache(maxsize=2)
def load_pieces(model: str, power: float = 1.0) -> Pieces:
    """One for each worker process."""
    return Pieces(model, power)


def _char_starts(data: np.ndarray) -> np.ndarray:
    return np.flatnonzero((data & 0xC0) != 0x80)


def _forward_alone(start: int, end: int, first: np.ndarray, begin: np.ndarray, log_w: np.ndarray, share: np.ndarray) -> None:
    """Running shares of the arcs of one stretch, node after node."""
    a0, bounds = int(first[start]), first[start : end + 1].tolist()
    back, weight = (begin[a0 : bounds[-1]] - start).tolist(), log_w[a0 : bounds[-1]].tolist()
    out, total, exp = [0.0] * len(back), [0.0] + [-math.inf] * (end - start), math.exp
    for node in range(end - start):
        a, b = bounds[node] - a0, bounds[node + 1] - a0
        if a == b:
            continue
        values = [weight[i] + total[back[i]] for i in range(a, b)]
        most = max(values)
        if most == -math.inf:
            continue
        parts = [exp(v - most) for v in values]
        whole, run = sum(parts), 0.0
        total[node + 1] = most + math.log(whole)
        for i, part in zip(range(a, b), parts, strict=True):
            run += part
            out[i] = run / whole
    share[a0 : bounds[-1]] = out


class Lattice:
    """Arcs and forward sums of many stretches at once: their bytes lie one after another in ``data``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, pieces: Pieces):
        n = len(data)
        stretch_end = np.concatenate([starts[1:], [n]])
        room = np.repeat(stretch_end, stretch_end - starts) - np.arange(n)  # bytes left in the stretch
        begin, ids = pieces.matches(data, room)
        end = begin + pieces.lengths[ids]
        # Characters that no piece stands for alone: an arc for each byte.
        chars = _char_starts(data)
        char_end = np.concatenate([chars[1:], [n]])
        width = np.zeros(n, dtype=np.int64)
        width[chars] = char_end - chars
        known = np.zeros(n, dtype=bool)
        known[begin[end - begin == width[begin]]] = True
        bare = ~np.repeat(known[chars], char_end - chars)
        at = np.flatnonzero(bare)
        begin, end, ids = np.concatenate([begin, at]), np.concatenate([end, at + 1]), np.concatenate([ids, pieces.byte_id[data[at]]])
        # Forward sums place by place: all stretches at the same distance from their start at once.
        # Node e (1 .. length) of a stretch is index start + e - 1.
        distance = np.arange(n) - np.repeat(starts, stretch_end - starts)
        order = np.argsort((end << 6) + np.minimum(end - begin, 63), kind="stable")
        begin, end, ids = begin[order], end[order], ids[order]
        node = end - 1
        log_w = pieces.log_weight[ids]
        first = np.searchsorted(node, np.arange(n + 1))
        total = np.full(n + 1, -np.inf)  # last: before the start of any stretch
        share = np.zeros(len(node))
        short = np.flatnonzero(np.repeat(stretch_end - starts <= LONG_STRETCH, stretch_end - starts))
        by_distance = short[np.argsort(distance[short], kind="stable")]
        bounds = np.searchsorted(distance[by_distance], np.arange(distance[short].max() + 2 if len(short) else 1))
        is_start = np.zeros(n, dtype=bool)
        is_start[starts] = True
        for d in range(len(bounds) - 1):
            nodes = by_distance[bounds[d] : bounds[d + 1]]
            counts = first[nodes + 1] - first[nodes]
            arcs = np.repeat(first[nodes] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            if not len(arcs):
                continue
            before = begin[arcs]
            value = log_w[arcs] + np.where(is_start[before], 0.0, total[before - 1])
            of = np.repeat(np.arange(len(nodes)), counts)
            most = np.full(len(nodes), -np.inf)
            np.maximum.at(most, of, value)
            most = np.where(np.isfinite(most), most, 0.0)
            part = np.exp(value - most[of])
            sums = np.bincount(of, weights=part, minlength=len(nodes))
            with np.errstate(divide="ignore"):
                total[nodes] = np.log(sums) + most
            # Arcs of a node: running shares.
            run = np.cumsum(part)
            base = np.concatenate([[0.0], run])[np.cumsum(counts) - counts]
            share[arcs] = np.where(sums[of] > 0, (run - base[of]) / np.where(sums[of] > 0, sums[of], 1.0), 0.0)
        for i in np.flatnonzero(stretch_end - starts > LONG_STRETCH).tolist():
            _forward_alone(int(starts[i]), int(stretch_end[i]), first, begin, log_w, share)
        last = np.zeros(len(node), dtype=bool)
        last[first[1:][first[1:] > first[:-1]] - 1] = True
        share[last] = 2.0  # over any u
        self.begin, self.ids, self.first, self.share = begin, ids, first, share

    def walk(self, start: int, u: np.ndarray) -> tuple[list[int], list[int]]:
        """Arcs of one stretch from its end back to its start, and their first places within it; u by place."""
        end = start + len(u)
        a0, bounds = int(self.first[start]), self.first[start : end + 1].tolist()
        share, back, draws = self.share[a0 : bounds[-1]].tolist(), (self.begin[a0 : bounds[-1]] - start).tolist(), u.tolist()
        arcs, places, at = [], [], len(u)
        while at:
            i = bounds[at - 1] - a0
            while share[i] <= draws[at - 1]:
                i += 1
            at = back[i]
            arcs.append(a0 + i)
            places.append(at)
        return arcs, places

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An arc into each node, by shares: the first whose running share is over u. Nodes have few arcs."""
        arc = self.first[node]
        left = np.flatnonzero(self.share[arc] <= u)
        while len(left):
            arc[left] += 1
            left = left[self.share[arc[left]] <= u[left]]
        return arc


def row_seed(key: object, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}|{'' if key is None else key}".encode(), digest_size=8).digest(), "little")


def _draws(seeds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each place of a text."""
    return (mix64(seeds + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53


def sample_segmentations(data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of all rows one after another, their number by row)."""
    rows = len(offsets) - 1
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(rows, dtype=np.int64)
    # Stretches: begin at a row's start, at a space after another sign, and around line ends and zero bytes.
    space, alone = data == 32, (data == 10) | (data == 0)
    cut = np.zeros(n, dtype=bool)
    cut[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    ends = np.concatenate([starts[1:], [n]])
    kind, example = span_ids(data, starts, ends)
    length = ends - starts
    own = length[example]
    own_start = np.cumsum(own) - own
    at = np.repeat(starts[example] - own_start, own) + np.arange(int(own.sum()))
    lattice = Lattice(data[at], own_start, pieces)
    # Backward, all occurrences in step. place: bytes of the stretch not yet segmented.
    row = np.searchsorted(offsets, starts, "right") - 1
    seed_of, into = seeds[row], starts - offsets[row]
    place, live = length.copy(), np.flatnonzero(length <= LONG_STRETCH)
    begins, ids = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for i in np.flatnonzero(length > LONG_STRETCH).tolist():
        arcs, places = lattice.walk(int(own_start[kind[i]]), _draws(seed_of[i], into[i] + np.arange(1, length[i] + 1)))
        begins.append(starts[i] + np.array(places))
        ids.append(lattice.ids[np.array(arcs)])
    while len(live):
        p = place[live]
        u = _draws(seed_of[live], into[live] + p)
        arc = lattice.draw(own_start[kind[live]] + p - 1, u)
        left = lattice.begin[arc] - own_start[kind[live]]
        begins.append(starts[live] + left)
        ids.append(lattice.ids[arc])
        place[live] = left
        live = live[left > 0]
    begins, ids = np.concatenate(begins), np.concatenate(ids)
    order = np.argsort(begins)
    return ids[order], np.diff(np.searchsorted(begins[order], offsets))


def sample_pieces(docs: DataFrame, *, model: str, key: str = "doc_id", text: str = "text", seed: int = 1, power: float = 1.0) -> DataFrame:
    """``key, n_bytes, n_pieces, piece_ids, lossless`` for every row.

    ``piece_ids`` is one sampled segmentation, the same for the same key, text and seed; ``lossless``
    says that decoding these ids gave back the text's bytes. Spaces, repeated spaces and line ends are
    kept as they are; a space mark in the text is encoded by its bytes. Null and empty texts have no
    pieces; a null key counts as an empty one; rows with equal key and text get equal pieces.
    ``model`` is a file that all machines have at the same path.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_bytes", "n_pieces", "piece_ids", "lossless"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(model, power)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, data, offsets in slices(batch.column(1), SLICE):
                seeds = np.array([row_seed(k, seed) for k in keys[a:b]], dtype=np.uint64)
                ids, n = sample_segmentations(data, offsets, seeds, pieces)
                ends = np.cumsum(n)
                back = np.frombuffer(pieces.decode(ids), dtype=np.uint8)
                sizes = np.concatenate([[0], np.cumsum(pieces.lengths[ids])])
                same_place = np.array_equal(sizes[np.concatenate([[0], ends])], offsets) and len(back) == len(data)
                wrong = np.concatenate([[0], np.cumsum(back != data)])[offsets] if same_place else None
                lossless = np.diff(wrong) == 0 if same_place else np.zeros(b - a, dtype=bool)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(n.astype(np.int64)), lists, pa.array(lossless)], names=names)

    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_pieces long, piece_ids array<int>, lossless boolean")


def decode_pieces(rows: DataFrame, *, model: str, ids: str = "piece_ids", text: str = "text") -> DataFrame:
    """``rows`` with the text that their ids stand for; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(model)
        for batch in batches:
            texts = [None if x is None else pieces.decode(np.array(x, dtype=np.int64)).decode() for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, text])

    kept = [c for c in rows.columns if c != text]
    return rows.select(*kept).mapInArrow(run, rows.select(*kept).schema.add(text, "string"))
