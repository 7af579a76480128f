"""Quality classifier: ordinal cumulative-link regression on hashed text.

Grades are ordered (0 harmful, 1 poor, 2 good for the labels at hand). One weight vector over hashed
text gives a score s; ordered thresholds t_0 < t_1 < ... give P(grade <= k) = sigmoid(t_k - s).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import LOWER_TABLE, mix64, runs, slices, span_hashes

BITS = 18
#: Bound on the labelled rows that a fit uses: the first by MD5 of their key.
MAX_LABELLED = 12_000
MIN_DOCS = 4
#: Entries (a feature of a row) that a step of the fit works on at a time.
CHUNK = 1 << 18
PREFIXES = (4, 5)


def _statistics(data: np.ndarray, offsets: np.ndarray, spans, kind: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """Shares of a text, each as eighths 0 to 8: signs among runs, repeats of the run before, capitals among letters."""
    rows = len(offsets) - 1
    n = np.maximum(spans.counts, 1)
    signs = np.bincount(spans.row[kind == 3], minlength=rows)
    letters = kind == 1
    row, h = spans.row[letters], hashes[letters]
    again = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
    n_letters = np.maximum(np.bincount(row, minlength=rows), 1)
    repeats = np.bincount(row[1:][again], minlength=rows)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    capital = sums((data >= 65) & (data <= 90))
    letter = np.maximum(sums(((data | 32) >= 97) & ((data | 32) <= 122)), 1)
    return [np.ceil(8 * signs / n).astype(np.int64), np.ceil(8 * repeats / n_letters).astype(np.int64), np.ceil(8 * capital / letter).astype(np.int64)]


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids of all rows one after another, their number by row).

    Each distinct hashed run once, the first four and five bytes of longer words (their forms differ
    in the ending), and the shares.
    """
    spans, kind = runs(data, offsets)
    lower = LOWER_TABLE[data]
    hashes = span_hashes(lower, spans.starts, spans.ends)
    ids = [(hashes >> np.uint64(64 - bits)).astype(np.int64)]
    row = [spans.row]
    for size in PREFIXES:
        long = np.flatnonzero((kind == 1) & (spans.ends - spans.starts > size))
        prefix = mix64(span_hashes(lower, spans.starts[long], spans.starts[long] + size, 1) ^ np.uint64(size))
        ids.append((prefix >> np.uint64(64 - bits)).astype(np.int64))
        row.append(spans.row[long])
    for i, level in enumerate(_statistics(data, offsets, spans, kind, hashes)):
        for step in range(1, 9):
            has = np.flatnonzero(level >= step)
            ids.append(np.full(len(has), int(mix64(np.array([1000 + 16 * i + step], dtype=np.uint64))[0] >> np.uint64(64 - bits)), dtype=np.int64))
            row.append(has)
    both = np.unique((np.concatenate(row) << bits) | np.concatenate(ids))
    return both & ((1 << bits) - 1), np.bincount(both >> bits, minlength=len(offsets) - 1)


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def at_most(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade <= k) by row and threshold k."""
        ids, n = features(data, offsets, self.bits)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[ids].astype(np.float64))])
        ends = np.cumsum(n)
        score = sums[ends] - sums[ends - n]
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def _segment_sums(values: np.ndarray, of: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values[of]`` over the segments of ``of`` that end at ``ends``, some segments at a time."""
    out, at, entry = np.zeros(len(ends)), 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, entry + CHUNK, "right")))
        starts = np.concatenate([[entry], ends[at : to - 1]])
        some = np.flatnonzero(ends[at:to] > starts)  # an empty segment has no sum of its own
        if len(some):
            out[at + some] = np.add.reduceat(values.take(of[entry : ends[to - 1]], mode="clip"), starts[some] - entry)
        at, entry = to, int(ends[to - 1])
    return out


@dataclass(frozen=True)
class Sample:
    """Labelled rows: the feature slots of each row, the rows of each slot, and the rows' grades."""

    slots: np.ndarray
    row_ends: np.ndarray
    rows: np.ndarray
    slot_ends: np.ndarray
    grades: np.ndarray
    n_grades: int

    @classmethod
    def of(cls, slots: np.ndarray, row_ends: np.ndarray, n_slots: int, grades: np.ndarray, n_grades: int) -> Sample:
        rows = np.repeat(np.arange(len(grades)), np.diff(row_ends, prepend=0))
        rows = rows[np.argsort(slots, kind="stable")]
        return cls(slots.astype(np.int64), row_ends, rows, np.cumsum(np.bincount(slots, minlength=n_slots)), grades, n_grades)


def _thresholds(x: np.ndarray, n_slots: int) -> np.ndarray:
    """Thresholds of a state: the first as it is, the gaps to the next ones by their logarithms."""
    return x[n_slots] + np.concatenate([[0.0], np.cumsum(np.exp(x[n_slots + 1 :]))])


def loss_and_gradient(x: np.ndarray, sample: Sample) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood of the grades and its gradient, for weights, first threshold and log gaps ``x``."""
    n_slots, n, k = len(sample.slot_ends), len(sample.grades), sample.n_grades - 1
    th, rows = _thresholds(x, n_slots), np.arange(n)
    score = _segment_sums(x[:n_slots], sample.slots, sample.row_ends)
    cdf = 1 / (1 + np.exp(-np.clip(th[None, :] - score[:, None], -40, 40)))
    full = np.pad(cdf, ((0, 0), (1, 1)), constant_values=((0, 0), (0, 1)))
    p = np.maximum(full[rows, sample.grades + 1] - full[rows, sample.grades], 1e-12)
    slope = np.pad(cdf * (1 - cdf), ((0, 0), (1, 1)))
    up, down = slope[rows, sample.grades + 1] / p / n, slope[rows, sample.grades] / p / n
    g_th = np.bincount(sample.grades, weights=-up, minlength=k + 1)[:k] + np.bincount(sample.grades, weights=down, minlength=k + 1)[1:]
    tail = np.cumsum(g_th[::-1])[::-1]
    g_w = _segment_sums(up - down, sample.rows, sample.slot_ends)
    return -float(np.log(p).mean()), np.concatenate([g_w, tail[:1], tail[1:] * np.exp(x[n_slots + 1 :])])


def fit_ordinal(ids: np.ndarray, counts: np.ndarray, grades: np.ndarray, n_grades: int, *, bits: int = BITS, min_docs: int = MIN_DOCS, l1: float = 0.05, steps: int = 300, rate: float = 0.05) -> OrdinalModel:
    """Maximum likelihood with an L1 term of ``l1 / sqrt(rows)`` by proximal Adam over all given rows at once: no random choices.

    The L1 term keeps words that tell nothing at 0, so a long text isn't judged by the sum of its noise.

    Without rows, or with one grade alone, weights are 0 and thresholds follow the (smoothed) shares.
    """
    n = len(grades)
    share = np.cumsum(np.bincount(grades, minlength=n_grades)[: n_grades - 1] + 0.5) / (n + 0.5 * n_grades)
    thresholds = np.log(share / (1 - share))
    weights = np.zeros(1 << bits, dtype=np.float32)
    if n == 0 or len(set(grades.tolist())) < 2:
        return OrdinalModel(weights, thresholds, bits)
    used = np.flatnonzero(np.bincount(ids, minlength=1 << bits) >= min_docs)
    slot_of = np.full(1 << bits, -1, dtype=np.int32)
    slot_of[used] = np.arange(len(used), dtype=np.int32)
    slots = slot_of[ids]
    known = slots >= 0
    ends = np.concatenate([[0], np.cumsum(known)])[np.cumsum(counts)]
    m_used = len(used)
    sample = Sample.of(slots[known], ends, m_used, grades, n_grades)
    x = np.concatenate([np.zeros(m_used), thresholds[:1], np.log(np.maximum(np.diff(thresholds), 1e-3))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = loss_and_gradient(x, sample)[1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        size = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        x = x - size * (m / (1 - 0.9**t))
        w = x[:m_used]
        x[:m_used] = np.sign(w) * np.maximum(np.abs(w) - size[:m_used] * l1 / np.sqrt(n), 0.0)
    weights[used] = x[:m_used]
    return OrdinalModel(weights, _thresholds(x, m_used), bits)


def fit(labelled: DataFrame, *, key: str, text: str, grade: str, n_grades: int, max_rows: int = MAX_LABELLED) -> OrdinalModel:
    """Fit on at most ``max_rows`` rows of ``labelled`` (null grades left out), the first by MD5 of the key and by grade.

    The sample is fitted in one task, on four bytes for each distinct feature of each of its rows, and
    only the weights (four bytes for each of the 2**bits features) come to the driver. A null key counts
    as an empty one; a repeated row counts as often as it comes; null and empty texts have no features
    but count for the thresholds.
    """
    rows = (
        labelled.filter(F.col(grade).isNotNull())
        .select(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("_order"), F.col(grade).cast("int").alias("_grade"), F.col(text).alias("_text"))
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("_text")):
                ids, n = features(data, offsets)
                ends = np.cumsum(n)
                blobs = [ids[e - c : e].astype("<i4").tobytes() for e, c in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("_order").slice(a, b - a), batch.column("_grade").slice(a, b - a), pa.array(blobs, pa.binary())], names=["_order", "_grade", "_ids"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, grades = [np.zeros(0, dtype="<i4")], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for batch in batches:
            blobs = batch.column("_ids")
            ids.append(np.frombuffer(b"".join(x.as_buffer() for x in blobs), dtype="<i4"))
            counts.append(pc.binary_length(blobs).to_numpy().astype(np.int64) // 4)
            grades.append(batch.column("_grade").to_numpy().astype(np.int64))
        model = fit_ordinal(np.concatenate(ids), np.concatenate(counts), np.concatenate(grades), n_grades)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("<f4").tobytes()], pa.binary()), pa.array([model.thresholds.tolist()], pa.list_(pa.float64()))], names=["weights", "thresholds"])

    sample = rows.mapInArrow(extract, "_order string, _grade int, _ids binary").orderBy("_order", "_grade", "_ids").limit(max_rows)
    done = sample.mapInArrow(train, "weights binary, thresholds array<double>").first()
    if done is None:  # no labelled row at all
        return fit_ordinal(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), n_grades)
    return OrdinalModel(np.frombuffer(done["weights"], dtype="<f4"), np.array(done["thresholds"]))


def grade_texts(docs: DataFrame, model: OrdinalModel, *, text: str = "text", tail: int | None = None) -> DataFrame:
    """``docs`` with ``expected_grade`` and ``p_tail`` = P(grade >= tail), tail being the best grade by default.

    The model is a fixed 2**bits weights, so sending it to every worker is bounded. Null and empty
    texts get the thresholds' own probabilities; columns of these two names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("expected_grade", "p_tail")]
    schema = docs.select(*kept).schema.add("expected_grade", "double").add("p_tail", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        k = len(model.thresholds) if tail is None else tail
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(text)):
                cdf = model.at_most(data, offsets)
                columns = [pa.array((1 - cdf).sum(axis=1)), pa.array(1 - cdf[:, k - 1])]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *columns], names=[*kept, "expected_grade", "p_tail"])

    return docs.select(*kept).mapInArrow(score, schema)
