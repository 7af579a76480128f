"""Quality rules: text counts, and a hashed n-gram log-likelihood ratio of trusted against raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import LOWER_TABLE, mix64, runs, slices, span_ids, window_hashes, window_starts, words

BUCKET_BITS = 16
#: A document passes at this mean log ratio (nats per n-gram) or above.
LEAST_RATIO = -0.30
#: Trusted ids are broadcast up to this many (a checked count); beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000

_SIGN = np.zeros(256, dtype=bool)
_SIGN[list(b"#*$%&|<>")] = True


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])


def _triples(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each three ids in a row; equal numbers mean equal ids."""
    if ids.max() < 1 << 21:
        return (ids[at] << 42) | (ids[at + 1] << 21) | ids[at + 2]
    pairs = np.unique((ids[at] << 31) | ids[at + 1], return_inverse=True)[1]
    return (pairs << 31) | ids[at + 2]


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """By row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    spans = words(data, offsets)
    rows = len(offsets) - 1
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[spans.starts] += 1
    np.subtract.at(inside, spans.ends, 1)
    inside = np.cumsum(inside[:-1]).astype(bool) if len(data) else inside[:-1].astype(bool)
    word_chars = _sums(inside & ((data & 0xC0) != 0x80), offsets)
    # Lines with a word; equal to an earlier line of the same row.
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[:-1] = data == 10
    cuts = np.flatnonzero(edge)
    starts = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    starts = starts[starts < len(data)]
    ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
    ends = ends - (data[ends - 1] == 10) if len(starts) else ends
    seen = np.searchsorted(spans.starts, ends) > np.searchsorted(spans.starts, starts)
    starts, ends = starts[seen], ends[seen]
    line_row = np.searchsorted(offsets, starts, "right") - 1
    dup = np.zeros(rows, dtype=np.int64)
    if len(starts):
        key = span_ids(data, starts, ends)[0]
        order = np.lexsort((key, line_row))
        same = (key[order][1:] == key[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
        dup = np.bincount(line_row[order][1:][same], minlength=rows)
    # Words in windows of three words that the row holds more than once.
    repeat = np.zeros(rows, dtype=np.int64)
    at = window_starts(spans, 3)
    if len(at):
        row, h = spans.row[at], _triples(span_ids(data, spans.starts, spans.ends)[0], at)
        order = np.lexsort((h, row))
        same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(spans.starts), dtype=bool)
        for k in range(3):
            covered[at[twice] + k] = True
        repeat = np.bincount(spans.row[covered], minlength=rows)
    return {"n_words": spans.counts, "word_chars": word_chars, "n_symbols": _sums(_SIGN[data], offsets), "n_dup_lines": dup, "n_repeat_words": repeat}


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each run of letters, digits or signs (lower case) and each pair of runs."""
    spans, _ = runs(data, offsets)
    h = spans.hashes(LOWER_TABLE[data])
    at, pair = window_hashes(h, spans, 2)
    both = np.concatenate([h, mix64(pair ^ np.uint64(0xA5A5))])
    return (both >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([spans.row, spans.row[at]])


def _bucket_counts(texts: DataFrame, bits: int) -> np.ndarray:
    """Counts of all buckets over all rows: summed in each task, then by bucket; 2**bits numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                total += np.bincount(ngram_buckets(data, offsets, bits)[0], minlength=1 << bits)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    table = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, dtype=np.int64)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


def log_ratios(raw: np.ndarray, trusted: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """ln of trusted over raw probability by bucket; both smoothed; all 0 where there is no trusted text."""
    if not trusted.sum():
        return np.zeros(len(raw))
    a = (trusted + smoothing) / (trusted.sum() + smoothing * len(trusted))
    b = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
    return np.log(a / b)


def fit_log_ratios(docs: DataFrame, trusted: DataFrame, *, key: str = "doc_id", text: str = "text", bits: int = BUCKET_BITS) -> np.ndarray:
    """Log ratios from the texts of all ``docs`` (raw) and of those whose key is in ``trusted``."""
    ids = trusted.select(F.col(key)).distinct()
    count = ids.limit(BROADCAST_IDS + 1).count()
    ids = F.broadcast(ids) if count <= BROADCAST_IDS else ids
    return log_ratios(_bucket_counts(docs.select(text), bits), _bucket_counts(docs.join(ids, key, "left_semi").select(text), bits))


def judge(docs: DataFrame, ratios: np.ndarray, *, key: str = "doc_id", text: str = "text", least_ratio: float = LEAST_RATIO, bits: int = BUCKET_BITS) -> DataFrame:
    """``key``, the counts of ``text_counts``, ``log_ratio`` (mean over the text's n-grams), ``base_failed`` and ``kept``.

    Null and empty texts have no words: log_ratio 0, base_failed true, kept false. Every row is judged by itself,
    so repeated rows get repeated results.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, {', '.join(f'{c} long' for c in counts)}, log_ratio double, base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = sent.value
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                c = text_counts(data, offsets)
                bucket, row = ngram_buckets(data, offsets, bits)
                n = np.maximum(np.bincount(row, minlength=b - a), 1)
                mean = np.bincount(row, weights=ratios[bucket], minlength=b - a) / n
                failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
                kept = ~failed & (mean >= least_ratio)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(c[k].astype(np.int64)) for k in counts), pa.array(mean), pa.array(failed), pa.array(kept)],
                    names=[key, *counts, "log_ratio", "base_failed", "kept"],
                )

    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, schema)
