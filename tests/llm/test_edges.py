"""Every operator and stage on one awkward table: nulls, empty and very long texts, ties, repeated rows, clashing names."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkwright.llm import jaccard_join, lm_scoring, media, mixing, packing, piece_sampling, quality_classifier, quality_rules, substring_dedup, token_counts
from inkwright.llm import queries as q
from inkwright.llm.token_counts import tokenizer_file

LONG = " ".join(f"w{i * i % 99991}" for i in range(800_000))  # about 5 MB
UNCUT = "ab" * 200_000 + "字" * 50_000  # no spaces
COMMON = "the quick brown fox jumps over the lazy dog and " * 12
ROWS = [(None, None, "a"), (None, "", "a"), (None, COMMON, None), (1, COMMON, "a"), (1, COMMON, "a"), (2, COMMON, "b"), (3, LONG, "b"), (4, UNCUT, "b"), (5, "", None), (6, " \n\t ", "a"), (7, "one", "b"), (7, "one", "b"), (8, "two", "a")]
#: What the operators call things inside.
NAMES = [
    "_text", "_doc", "_spans", "_rest", "_tag", "_d", "_t", "d", "t", "x", "r", "s", "d2", "t2", "spans", "id", "row", "at", "again", "copies", "first", "rate", "offset", "upto", "digest", "size", "key", "g", "a", "b",
    "block", "kind", "gram", "word", "n", "node", "rep", "m", "bands", "band", "d1", "component", "h", "hot_tokens", "n_tokens", "n_bytes", "held_out", "score", "class_id", "_gone", "_order", "_grade", "_ids", "p_tail", "f0", "lang", "n_chars",
]


def awkward(spark, clash):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return docs.select("*", *[F.lit(f"clash {n}").alias(n) for n in NAMES]) if clash else docs


def graded(docs):
    model = quality_classifier.fit(docs.withColumn("grade_", F.when(F.col("doc_id") < 3, 2).when(F.col("doc_id") < 6, 0)), key="doc_id", text="text", grade="grade_", n_grades=3)
    out = quality_classifier.grade_texts(docs, model)
    return out.select("doc_id", F.round("expected_grade", 9).alias("e"), F.round("p_tail", 9).alias("p"))


def ruled(docs):
    ratios = quality_rules.fit_log_ratios(docs, docs.filter("doc_id = 1").select("doc_id"))
    return quality_rules.judge(docs, ratios).withColumn("log_ratio", F.round("log_ratio", 9))


def carved(docs):
    out = media.sniff_media(docs.withColumn("body", F.encode("text", "utf-8")), content="body", declared="source")
    return out.select("doc_id", "media_type", "corrected", F.size("media").alias("objects"))


def deduped(docs):
    return substring_dedup.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.md5(F.col("kept_text").cast("binary")).alias("kept"))


def packed(docs):
    packs = packing.pack(docs.coalesce(1), tokenizer=tokenizer_file("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, length=512, id_bytes=2, position_bytes=2)
    return packing.unpack(packs).groupBy("doc_id").agg(F.sum(F.length("ids")).alias("bytes"), F.count("*").alias("pieces"))


def scored(docs):
    out = lm_scoring.score_documents(docs, depth=3)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.round("base_score", 3).alias("base"), F.round("score", 3).alias("score"))


@pytest.fixture
def cache(spark):
    from inkwright.llm.cluster import fresh_path

    return lambda: fresh_path(spark, "edge-cache")


OPERATORS = {
    "op1": lambda docs, cache: mixing.copies(docs).select("key", "source", "size", F.round("target", 6).alias("target"), "copies"),
    "op1_rows": lambda docs, cache: mixing.mix(docs).select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"), "source"),
    "op2": lambda docs, cache: scored(docs),
    "op3": lambda docs, cache: token_counts.token_counts(docs, tokenizer=tokenizer_file("word_bpe_49k.json"), cache=cache()),
    "op4": lambda docs, cache: deduped(docs),
    "op5": lambda docs, cache: piece_sampling.sample_pieces(docs, model=tokenizer_file("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_pieces", "lossless", F.hash("piece_ids").alias("ids")),
    "op6": lambda docs, cache: jaccard_join.jaccard_classes(docs),
    "op7": lambda docs, cache: ruled(docs),
    "op8": lambda docs, cache: graded(docs),
    "op9": lambda docs, cache: media.text_media(docs),
    "op9_media": lambda docs, cache: carved(docs),
    "op10": lambda docs, cache: packed(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_an_awkward_table(spark, cache, name):
    """Other columns, whatever their names, change nothing; repeated rows get one result each; an empty table gives no rows."""
    run = OPERATORS[name]
    clash = Counter(map(tuple, run(awkward(spark, True).repartition(3), cache).collect()))
    plain = Counter(map(tuple, run(awkward(spark, False), cache).collect()))
    assert clash == plain
    if name not in ("op1_rows", "op10"):
        assert Counter(k[0] for k in plain.elements()) == Counter(r[0] for r in ROWS)
    if name == "op5":
        assert all(k[3] for k in plain)
    if name not in ("op8", "op7"):
        assert run(awkward(spark, True).limit(0), cache).collect() == []


def test_stages_on_an_awkward_table(spark, sf_dir, tmp_path):
    """Clean texts stay in a stage, copies go where they should, columns are those of documents; empty stays empty."""
    docs = awkward(spark, True).withColumn("n_chars", F.length("text").cast("long"))
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    now = docs.select(*corpus_pipeline.COLUMNS)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        if name == "quality classifier":  # these texts are none that its labels know
            stage(spark, docs, sf_dir).count()
        else:
            stage(spark, now, sf_dir).write.parquet(f"file://{tmp_path}/{i}")
            after = spark.read.parquet(f"file://{tmp_path}/{i}")
            ids = Counter(r.doc_id for r in after.select("doc_id").collect())
            if name == "n-gram Jaccard join":  # 2 is a copy of 1; rows of one id stay together
                assert ids == Counter([None] * 3 + [1, 1, 3, 4, 5, 6, 7, 7, 8])
            if name == "substring dedup":  # what 1 holds, the null id holds before it
                assert 3 in ids and 4 in ids and 1 not in ids and ids[7] == 2
            now = after
        assert stage(spark, empty, sf_dir).count() == 0


def test_repeated_magic_and_pipeline_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "mixing", "SentencePiece sampling"]
    assert set(q.ORACLE_SQL) <= set(q.QUERIES)
