"""Queries over model fitting: lexicon, n-grams, contexts, confusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignment
from ..operators import channel, evaluate, model
from ..shared import settled
from .common import ALIGN, CHARS, LEXICON, NGRAMS, SAMPLES, conversations, documents, fitted, lines_sql, misread, register, samples, table, token_alignments, tokens_sql


@register(f"WITH {LEXICON} SELECT word, count FROM lexicon ORDER BY count DESC, word LIMIT 100")
def lexicon_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.most_common(model.lexicon(documents(spark, sf_dir)), 100)


@register(f"WITH {LEXICON} SELECT word, count FROM lexicon")
def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.lexicon(documents(spark, sf_dir))


@register(f"WITH {LEXICON} SELECT count(*)::BIGINT AS types, sum(count)::BIGINT AS total, max(length(word))::BIGINT AS longest FROM lexicon")
def lexicon_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.lexicon(documents(spark, sf_dir)).agg(F.count("*").alias("types"), F.sum("count").alias("total"), F.max(F.length("word")).cast("long").alias("longest"))


@register(f"""WITH {LEXICON}, asked AS (SELECT DISTINCT lower(unnest({tokens_sql()})) AS word FROM conversations)
  SELECT a.word, coalesce(l.count, 0)::BIGINT AS count, l.count IS NOT NULL AS known FROM asked a LEFT JOIN lexicon l ON a.word = l.word""")
def lexicon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = model.word_stream(conversations(spark, sf_dir)).distinct()
    found = asked.join(model.lexicon(documents(spark, sf_dir)), "word", "left")
    return found.select("word", F.coalesce("count", F.lit(0)).alias("count"), F.col("count").isNotNull().alias("known"))


@register(f"WITH {NGRAMS} SELECT word, count FROM uni")
def unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.unigrams(model.word_ngrams(documents(spark, sf_dir)))


@register(f"WITH {NGRAMS} SELECT w1, word, count FROM bi")
def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.bigrams(model.word_ngrams(documents(spark, sf_dir)))


@register(f"WITH {NGRAMS} SELECT w2, w1, word, count FROM tri")
def trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.word_ngrams(documents(spark, sf_dir))


@register(f"WITH {NGRAMS}, {LEXICON}, {CHARS} SELECT context, ch, count FROM chars")
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.char_ngrams(model.lexicon(documents(spark, sf_dir)))


@register(f"WITH {NGRAMS} SELECT w2, w1, sum(count)::BIGINT AS total FROM tri GROUP BY ALL UNION ALL SELECT '' AS w2, w1, sum(count)::BIGINT FROM bi GROUP BY ALL")
def context_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tri = model.word_ngrams(documents(spark, sf_dir))
    one = model.context_totals(model.bigrams(tri), "w1").select(F.lit("").alias("w2"), "w1", "total")
    return model.context_totals(tri, "w2", "w1").union(one)


@register(f"WITH {NGRAMS}, {LEXICON}, {CHARS} SELECT words, vocabulary, char_alphabet FROM totals")
def lm_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return model.language_totals(model.unigrams(model.word_ngrams(docs)), model.char_ngrams(model.lexicon(docs)))


@register(f"""WITH {LEXICON}, more AS (SELECT lower(unnest({tokens_sql()})) AS word FROM conversations)
  SELECT word, sum(count)::BIGINT AS count FROM (SELECT word, count FROM lexicon UNION ALL SELECT word, count(*)::BIGINT FROM more GROUP BY word) GROUP BY word""")
def merge_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.merge(model.lexicon(documents(spark, sf_dir)), model.lexicon(conversations(spark, sf_dir)))


@register(f"""WITH {lines_sql("conversations", "conv_id")} SELECT conv_id, sum(len({tokens_sql("body")}))::BIGINT AS words FROM lines GROUP BY conv_id""")
def ingest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).select("conv_id", "text")
    from ..functions.text import splitlines, tokenize

    lines = rows.select("conv_id", F.explode(splitlines(F.col("text"))).alias("line"))
    return lines.groupBy("conv_id").agg(F.sum(F.size(tokenize(F.col("line")))).cast("long").alias("words"))


@register(f"WITH {SAMPLES} SELECT doc_id, count(*)::BIGINT AS n, count_if(observed <> truth)::BIGINT AS misread, round(avg(confidence), 6) AS confidence, sum(length(observed))::BIGINT AS chars FROM samples GROUP BY doc_id")
def synth_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).groupBy("doc_id")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("observed") != F.col("truth")).alias("misread"), F.round(F.avg("confidence"), 6).alias("confidence"), F.sum(F.length("observed")).cast("long").alias("chars"))


@register(f"WITH RECURSIVE {ALIGN} SELECT kind, a, b, count FROM confusion")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir)[0]


@register(f"WITH RECURSIVE {ALIGN} SELECT observed, truth, n, count(*)::BIGINT AS ops, count_if(kind <> 'match')::BIGINT AS errors FROM ops GROUP BY ALL")
def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_alignments(spark, sf_dir).filter(F.size("ops") > 0)
    return rows.select(F.col("predicted").alias("observed"), F.col("corrected").alias("truth"), "n", F.size("ops").cast("long").alias("ops"), F.size(F.filter("ops", lambda o: o["kind"] != "match")).cast("long").alias("errors"))


@register(f"WITH RECURSIVE {ALIGN} SELECT a, total FROM true_totals")
def true_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.true_totals(fitted(spark, sf_dir)[0])


@register(f"WITH RECURSIVE {ALIGN} SELECT ins_total, sub_total, alphabet, (SELECT sum(count) FROM spans)::BIGINT AS corrections FROM sums")
def confusion_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    confusion, spans = fitted(spark, sf_dir)
    return model.confusion_totals(confusion).crossJoin(spans.agg(F.sum("count").alias("corrections")))


@register(f"""WITH RECURSIVE {ALIGN} SELECT c.a AS truth, c.b AS observed, c.count, round(c.count / t.total, 9) AS rate FROM confusion c JOIN true_totals t USING (a)
  WHERE kind = 'sub' AND a <> b ORDER BY c.count DESC, c.count / t.total DESC, truth, observed LIMIT 20""")
def top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.top_confusions(fitted(spark, sf_dir)[0]).withColumn("rate", F.round("rate", 9))


@register(f"WITH RECURSIVE {ALIGN} SELECT observed, truth, count FROM spans")
def error_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.error_spans(token_alignments(spark, sf_dir))


_DENOMINATOR = "ln(coalesce(t.total, 0) + 25.0::DOUBLE + 0.05::DOUBLE * (s.alphabet + 1))"


@register(f"""WITH RECURSIVE {ALIGN} SELECT c.a, c.b, c.count, round(ln(c.count + 0.05::DOUBLE + CASE WHEN c.a = c.b THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END) - {_DENOMINATOR}, 6) AS log_sub
  FROM confusion c JOIN true_totals t USING (a) CROSS JOIN sums s WHERE kind = 'sub'""")
def channel_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channel.substitution_costs(fitted(spark, sf_dir)[0]).withColumn("log_sub", F.round("log_sub", 6))


@register(f"""WITH RECURSIVE {ALIGN}, seen AS (SELECT DISTINCT ch FROM (SELECT unnest([a, b]) AS ch FROM confusion) WHERE ch <> ''),
  v AS (SELECT ch, t.total, s.*, greatest(s.sub_total + s.ins_total, 1) AS m,
    coalesce((SELECT count FROM confusion c WHERE kind = 'del' AND c.a = ch), 0) AS d, coalesce((SELECT count FROM confusion c WHERE kind = 'ins' AND c.b = ch), 0) AS i
    FROM seen LEFT JOIN true_totals t ON t.a = ch CROSS JOIN sums s)
  SELECT ch, round(ln(d + 0.05::DOUBLE) - ln(coalesce(total, 0) + 25.0::DOUBLE + 0.05::DOUBLE * (alphabet + 1)), 6) AS log_del,
    round(ln(least(greatest((ins_total + 0.02::DOUBLE * m) / (m * 1.02::DOUBLE), 0.0001::DOUBLE), 0.5::DOUBLE)) + ln((i + 0.05::DOUBLE) / (ins_total + 0.05::DOUBLE * alphabet)), 6) AS log_ins FROM v""")
def edit_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channel.character_costs(fitted(spark, sf_dir)[0]).select("ch", F.round("log_del", 6).alias("log_del"), F.round("log_ins", 6).alias("log_ins"))


_SOURCES = f"""sources AS (SELECT b AS observed, a AS truth, row_number() OVER (PARTITION BY b ORDER BY ln(c.count + 0.05::DOUBLE) - {_DENOMINATOR} DESC, a) AS rank
  FROM confusion c JOIN true_totals t USING (a) CROSS JOIN sums s WHERE kind = 'sub' AND a <> b)"""


@register(f"WITH RECURSIVE {ALIGN}, {_SOURCES} SELECT observed, truth, rank::INT AS rank FROM sources WHERE rank <= 4")
def likely_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channel.likely_sources(fitted(spark, sf_dir)[0]).select("observed", "truth", "rank")


@register(f"""WITH RECURSIVE {ALIGN}, {_SOURCES},
  tokens AS (SELECT DISTINCT lower(observed) AS token FROM samples),
  places AS (SELECT token, i FROM tokens, unnest(range(1, length(token) + 1)) AS t(i)),
  learned AS (SELECT observed, truth, row_number() OVER (PARTITION BY observed ORDER BY count DESC, truth) AS rank FROM spans WHERE observed <> ''),
  made AS (SELECT token, substr(token, 1, i - 1) || truth || substr(token, i + 1) AS variant FROM places JOIN sources ON substr(token, i, 1) = observed WHERE rank <= 4
    UNION SELECT token, substr(token, 1, i - 1) || truth || substr(token, i + length(observed)) FROM places JOIN learned ON substr(token, i, length(observed)) = observed WHERE rank <= 3)
  SELECT token, count(*)::BIGINT AS variants, min(variant) AS first_variant, max(variant) AS last_variant FROM made WHERE variant <> token GROUP BY token""")
def inverse_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = misread(spark, sf_dir)
    confusion, spans = fitted(spark, sf_dir, pairs)
    tokens = pairs.select(F.lower("predicted").alias("token")).distinct()
    every = channel.inverse_variants(tokens, confusion, spans, limit=None)
    return every.groupBy("token").agg(F.count("*").alias("variants"), F.min("variant").alias("first_variant"), F.max("variant").alias("last_variant"))


@register(f"""WITH {SAMPLES} SELECT doc_id, line, string_agg(observed, ' ' ORDER BY idx) AS predicted, string_agg(truth, ' ' ORDER BY idx) AS corrected FROM samples
  GROUP BY doc_id, line HAVING string_agg(observed, ' ' ORDER BY idx) <> string_agg(truth, ' ' ORDER BY idx)""")
def correction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.correction_pairs(evaluate.as_lines(samples(spark, sf_dir), "doc_id", "line"))


@register()
def learned_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row and count sums of the four tables after learning all correction pairs."""
    from ..sources.sinks import TABLES
    from ..streaming.progress import learn

    # Each of the tables is counted from these lines: they are made once.
    pairs = settled(evaluate.misread_lines(documents(spark, sf_dir)).select("predicted", "corrected"))
    empty = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    out = None
    for name, df in learn(spark, pairs, empty).items():
        row = df.agg(F.lit(name).alias("model"), F.count("*").alias("rows"), F.sum("count").alias("total"))
        out = row if out is None else out.union(row)
    return out
