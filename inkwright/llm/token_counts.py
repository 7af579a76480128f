"""Token counts through a digest cache: only texts that the cache doesn't know are encoded, once each."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import cut

#: Pieces that a worker keeps in mind, twice: those of late, and those of the time before that.
MEMO = 250_000
#: Digests with at least this share of the rows are broadcast: as shares sum to 1, so many at most.
HOT = 2000
CACHE_SCHEMA = "version string, digest string, n_tokens long"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def read_rules(path: str) -> dict:
    import json

    with open(path, encoding="utf-8") as f:
        return json.load(f)


def cuts_by_word(rules: dict) -> bool:
    """If a tokenizer file's normaliser folds white space and its splitter drops it."""
    steps = (rules.get("normalizer") or {}).get("normalizers", [])
    cuts = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        any(s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} for s in steps)
        and any(c["type"] == "Split" and c["behavior"] == "Removed" and c["invert"] and "\\s" not in c["pattern"]["Regex"].replace(r"[^\s", "") for c in cuts)
        and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or any(ch.isspace() for ch in x["content"]) for x in rules.get("added_tokens", []))
    )


class PieceCounter:
    """Token counts of texts by a ``tokenizers`` file whose rules never look across white space.

    Text is cut at ASCII white space, each distinct piece is encoded once by the library and counted.
    ``by_word`` says if the file allows this. Otherwise whole texts go to the library.
    """

    def __init__(self, path: str):
        import os

        # One task, one core: threads of the library would each keep memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = cuts_by_word(read_rules(path))
        self.memo: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return [n for i in range(0, len(texts), 64) for n in self._encode(texts[i : i + 64])]
        out = []
        for i in range(0, len(texts), 128):
            pieces = [t.encode().split() for t in texts[i : i + 128]]
            if len(self.memo) > MEMO:
                self.memo, self.older = {}, self.memo
            memo, older = self.memo, self.older
            new = {p for ps in pieces for p in ps if p not in memo}
            memo.update((p, older[p]) for p in new if p in older)
            fresh = [p for p in new if p not in memo]
            for k in range(0, len(fresh), 4096):
                part = fresh[k : k + 4096]
                memo.update(zip(part, self._encode([p.decode() for p in part]), strict=True))
            get = memo.__getitem__
            out += [sum(map(get, ps)) for ps in pieces]
        return out


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    """One for each worker process."""
    return PieceCounter(path)


def _digest(text: str, by_word: bool):
    # Alike up to white space is alike to a tokenizer that cuts by word, and to no other; null counts as empty.
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.sha2(F.trim(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", " ")) if by_word else whole, 256)


def stored_counts(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; none where it doesn't exist yet. A pair stored twice (a repeated append) counts once."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).groupBy("version", "digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, *, tokenizer: str, cache: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row.

    ``cache`` is a folder of (version, digest, n_tokens); this call appends what it lacked. Copies of a
    text are combined within each task before any text moves, so each distinct text that the cache
    doesn't know is sent and encoded once. Counts go back to the rows by digest; the few digests with a
    large share of all rows are broadcast with their counts, so no task gets all copies of a text.
    ``tokenizer`` is a file that all machines have at the same path. Null and empty texts have 0
    bytes and tokens; rows keep their number, repeated ones too, keys may be null; an empty table gives
    no rows. Other columns are not read and may have any name.
    """
    spark = docs.sparkSession
    by_word = cuts_by_word(read_rules(tokenizer))
    # Older caches hold counts by folded digests: where white space matters, those are another version's.
    version = tokenizer_version(tokenizer) + ("" if by_word else "-whole")
    known = stored_counts(spark, cache).filter(F.col("version") == version).select("digest", "n_tokens")
    whole = F.coalesce(F.col(text), F.lit(""))
    distinct = docs.select(_digest(text, by_word).alias("digest"), whole.alias("_text")).groupBy("digest").agg(F.first("_text").alias("_text"))
    misses = distinct.join(known, "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(tokenizer)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                n = counter.count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    found = misses.mapInArrow(encode, "digest string, n_tokens long")
    found.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    stored = stored_counts(spark, cache).filter(F.col("version") == version).select("digest", "n_tokens")
    rows = cut(docs.select(F.col(key).alias("key"), _digest(text, by_word).alias("digest"), F.octet_length(whole).cast("long").alias("n_bytes")))
    total = rows.count()
    # At most HOT digests can have that share of the rows.
    hot = rows.groupBy("digest").count().filter(F.col("count") * HOT > total).select(F.col("digest").alias("h"))
    hot = stored.join(F.broadcast(hot), F.col("digest") == F.col("h")).select("h", F.col("n_tokens").alias("hot_tokens"))
    rows = rows.join(F.broadcast(hot), F.col("digest") == F.col("h"), "left")
    often = rows.filter("h is not null").select("key", "n_bytes", F.col("hot_tokens").alias("n_tokens"))
    seldom = rows.filter("h is null").select("key", "n_bytes", "digest").join(stored, "digest", "left").select("key", "n_bytes", "n_tokens")
    return often.union(seldom).select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
