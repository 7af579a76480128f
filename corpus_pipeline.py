"""From raw documents to sampled pieces: five stages, each written as Parquet and read by the next.

All stages take any ``documents`` table that has the five columns; what other columns it has, under
whatever names, the first stage leaves behind. An empty table stays empty through all stages. Null ids,
sources and texts, empty and very long texts and repeated rows go through; what becomes of them is said
at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwright.llm import jaccard_join, mixing, piece_sampling, quality_classifier, substring_dedup
from inkwright.llm import queries as q
from inkwright.llm.cluster import fresh_path
from inkwright.llm.token_counts import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the best grade is at least one half stay.

    Each row is graded by its text alone, so repeated rows share their fate; null and empty texts have
    the shares of the grades as their chances. Without labels no text is better than another: the three
    grades have a third each, and nothing stays.
    """
    model = q.fit_classifier(docs, q.table(spark, sf_dir, "labels"))
    return quality_classifier.grade_texts(docs.select(*COLUMNS), model).filter(F.col("p_tail") >= q.LEAST_TAIL).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id stays.

    Rows with that id all stay, repeated ones too; rows with a null id and texts without words have no
    copies and stay.
    """
    return jaccard_join.one_of_each(docs).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeat an earlier passage go; a document that has nothing else left goes with them.

    Repeated rows are one document and repeat nothing of each other; a null id comes before all others;
    a text that loses nothing, null and empty ones among them, stays as it was, byte by byte.
    """
    rows = substring_dedup.dedup_substrings(docs.select(*COLUMNS))
    some = rows.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return some.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their weights; a document comes as often as the mix takes it.

    Rows are drawn each by itself, repeated ones and those with a null id too; a null source is the
    last source; texts without words are drawn like others but fill no target.
    """
    return mixing.mix(docs, weights=q.WEIGHTS, share=q.SHARE, ceiling=q.CEILING).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sampled segmentation of each document, under its id; null and empty texts have no pieces, repeated rows get equal ones."""
    return piece_sampling.sample_pieces(docs, model=tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", one_of_near_copies),
    ("substring dedup", without_repeats),
    ("mixing", mixed),
    ("SentencePiece sampling", pieces),
]

#: The classifier and the sampled pieces are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` of ``sf_dir``: one for each document that the mix takes, as often as it takes it.

    Every stage is written to the shared folder before the next reads it, so a lost executor costs at
    most the work of one stage.
    """
    docs = q.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
