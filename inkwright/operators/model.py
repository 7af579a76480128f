"""Model fitting as plain aggregations: confusion counts, lexicon, word and character n-grams.

All counts are sums, so models merge by union and sum, and a delta can be learned by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import word_grams
from ..functions.text import splitlines, tokenize

#: The boundary word, the character order, the floors of the two alphabets.
BOUNDARY = "\x02"
CHAR_ORDER = 4
ALPHABET_FLOOR = 64
CHAR_ALPHABET_FLOOR = 32
BACKGROUND_WEIGHT = 1


# --- confusion counts ---------------------------------------------------------------------------


def confusion_counts(alignments: DataFrame) -> DataFrame:
    """(kind, a, b, count) of character operations: sub (truth, observed) with matches, del (truth, ''), ins ('', observed)."""
    op = alignments.select("n", F.explode("ops").alias("op"))
    kind = F.when(F.col("op.kind") == "match", "sub").otherwise(F.col("op.kind"))
    return op.groupBy(kind.alias("kind"), F.col("op.target").alias("a"), F.col("op.source").alias("b")).agg(F.sum("n").alias("count"))


def channel_counts(alignments: DataFrame) -> DataFrame:
    """(kind, a, b, count) of ``confusion_counts`` and, as kind span (observed, truth), of the error spans: all in one pass."""
    kind = lambda o: F.when(o["kind"] == "match", "sub").otherwise(o["kind"]).alias("kind")
    ops = F.transform("ops", lambda o: F.struct(kind(o), o["target"].alias("a"), o["source"].alias("b")))
    spans = F.transform("spans", lambda s: F.struct(F.lit("span").alias("kind"), s["observed"].alias("a"), s["truth"].alias("b")))
    each = alignments.select("n", F.explode(F.concat(ops, spans)).alias("c"))
    return each.groupBy("c.kind", "c.a", "c.b").agg(F.sum("n").alias("count"))


def split_counts(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(confusion counts, error spans) of ``channel_counts``."""
    return counts.filter("kind <> 'span'"), counts.filter("kind = 'span'").select(F.col("a").alias("observed"), F.col("b").alias("truth"), "count")


def true_totals(confusion: DataFrame) -> DataFrame:
    """(a, total): how often each true character was read at all, or dropped."""
    return confusion.filter(F.col("kind").isin("sub", "del")).groupBy("a").agg(F.sum("count").alias("total"))


def confusion_totals(confusion: DataFrame) -> DataFrame:
    """One row: alphabet (distinct characters, at least 64), ins_total, sub_total."""
    chars = F.explode(F.array_distinct(F.array("a", "b"))).alias("ch")
    alphabet = confusion.filter(F.col("kind").isin("sub", "del", "ins")).select(chars).filter("ch <> ''").agg(F.greatest(F.countDistinct("ch"), F.lit(ALPHABET_FLOOR)).alias("alphabet"))
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("count"))), F.lit(0))
    return confusion.agg(total("ins").alias("ins_total"), total("sub").alias("sub_total")).crossJoin(alphabet)


def top_confusions(confusion: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent substitutions with their rate; ties by truth and observed."""
    wrong = confusion.filter("kind = 'sub' and a <> b").join(true_totals(confusion), "a")
    return wrong.select(F.col("a").alias("truth"), F.col("b").alias("observed"), "count", (F.col("count") / F.col("total")).alias("rate")).orderBy(F.desc("count"), F.desc("rate"), "truth", "observed").limit(limit)


# --- lexicon ------------------------------------------------------------------------------------


def word_stream(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word): every token in lower case."""
    return docs.select(F.explode(F.transform(tokenize(F.col(text)), F.lower)).alias("word"))


def lexicon(docs: DataFrame, text: str = "text") -> DataFrame:
    return word_stream(docs, text).groupBy("word").agg(F.count("*").alias("count"))


def background(words: DataFrame, column: str) -> DataFrame:
    """(word, count) of a word list: trimmed, lower case, letters alone, each row of weight 1."""
    word = F.lower(F.trim(F.col(column)))
    return words.select(word.alias("word")).filter(F.col("word").rlike(r"^\p{L}+$")).groupBy("word").agg((F.count("*") * BACKGROUND_WEIGHT).alias("count"))


def merge(*models: DataFrame, count: str = "count") -> DataFrame:
    """Sum of models with equal columns."""
    both = models[0]
    for m in models[1:]:
        both = both.unionByName(m)
    return both.groupBy(*[c for c in both.columns if c != count]).agg(F.sum(count).alias(count))


def most_common(words: DataFrame, limit: int) -> DataFrame:
    return words.orderBy(F.desc("count"), "word").limit(limit)


# --- n-grams ------------------------------------------------------------------------------------


def line_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(words): lower-case tokens of each line that has any."""
    lines = docs.select(F.explode(splitlines(F.col(text))).alias("line"))
    return lines.select(F.transform(tokenize(F.col("line")), F.lower).alias("words")).filter(F.size("words") > 0)


def word_ngrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(w2, w1, word, count) of all trigrams of lines padded ``B B words B``.

    One pass: lower orders are sums of it, since each position counts once in every order.
    """
    padded = F.concat(F.array(F.lit(BOUNDARY), F.lit(BOUNDARY)), F.col("words"), F.array(F.lit(BOUNDARY)))
    at = lambda i: F.element_at("p", i)
    grams = F.transform(F.sequence(F.lit(3), F.size("p")), lambda i: F.struct(at(i - 2).alias("w2"), at(i - 1).alias("w1"), at(i).alias("word")))
    return line_words(docs, text).select(padded.alias("p")).select(F.explode(grams).alias("g")).select("g.*").groupBy("w2", "w1", "word").agg(F.count("*").alias("count"))


def bigrams(trigrams: DataFrame) -> DataFrame:
    return trigrams.groupBy("w1", "word").agg(F.sum("count").alias("count"))


def unigrams(trigrams: DataFrame) -> DataFrame:
    return trigrams.groupBy("word").agg(F.sum("count").alias("count"))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``unigrams`` of ``word_ngrams`` in one pass without them: (word, count) of all words, and of the boundary that ends each line. Without it they are the ``lexicon``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in word_grams.chunks(batches):
            words, found = word_grams.word_counts(data)
            if len(words):
                yield pa.RecordBatch.from_arrays([words, pa.array(found.astype(np.int64))], names=["word", "count"])

    return docs.select(text).mapInArrow(count, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


def char_ngrams(words: DataFrame) -> DataFrame:
    """(context, ch, count): each word type once, weighted by its count."""
    pad = F.lit(BOUNDARY * (CHAR_ORDER - 1))
    padded = F.concat(pad, F.col("word"), F.lit(BOUNDARY))
    grams = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.struct(F.substr("p", i, F.lit(CHAR_ORDER - 1)).alias("context"), F.substr("p", i + CHAR_ORDER - 1, F.lit(1)).alias("ch")))
    return words.select(padded.alias("p"), "word", "count").select("count", F.explode(grams).alias("g")).groupBy("g.context", "g.ch").agg(F.sum("count").alias("count"))


def context_totals(grams: DataFrame, *context: str) -> DataFrame:
    return grams.groupBy(*context).agg(F.sum("count").alias("total"))


def language_totals(uni: DataFrame, chars: DataFrame) -> DataFrame:
    """One row: words (all unigrams with boundaries), vocabulary (at least 1), char_alphabet (at least 32)."""
    a = uni.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("words"), F.greatest(F.count("*"), F.lit(1)).alias("vocabulary"))
    b = chars.agg(F.greatest(F.countDistinct("ch"), F.lit(CHAR_ALPHABET_FLOOR)).alias("char_alphabet"))
    return a.crossJoin(b)


