"""Queries over distances, language scores, candidates and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignment
from ..operators import candidates, decode, evaluate, language, model
from ..shared import packed, settled
from .common import CHARS, LEXICON, NGRAMS, SAMPLES, B, conversation_lines, conversations, documents, fitted, lines_sql, register, samples, table, tokens_sql

_NO_QUOTE = "replace({}, '’', chr(1))"  # DuckDB counts bytes, so a longer character is made one byte


def _distance(a: str, b: str) -> str:
    return f"levenshtein({_NO_QUOTE.format(a)}, {_NO_QUOTE.format(b)})"


_LINES = f"{SAMPLES}, joined AS (SELECT doc_id, line, string_agg(observed, ' ' ORDER BY idx) AS o, string_agg(truth, ' ' ORDER BY idx) AS t FROM samples GROUP BY doc_id, line)"


@register(f"WITH {SAMPLES} SELECT round(sum({_distance('observed', 'truth')}) / sum(length(truth)), 9) AS cer, sum({_distance('observed', 'truth')})::BIGINT AS edits FROM samples")
def cer_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    return rows.agg(F.round(alignment.pooled_error_rate(F.col("truth"), F.col("observed")), 9).alias("cer"), F.sum(F.levenshtein("observed", "truth")).alias("edits"))


@register(f"WITH {_LINES} SELECT doc_id, line, round({_distance('o', 't')} / length(t), 9) AS cer FROM joined")
def cer_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = evaluate.as_lines(samples(spark, sf_dir), "doc_id", "line")
    return lines.select("doc_id", "line", F.round(alignment.line_error_rate(F.col("truth"), F.col("observed")), 9).alias("cer"))


@register()
def wer_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = evaluate.as_lines(samples(spark, sf_dir), "doc_id", "line")
    return lines.select("doc_id", "line", F.round(alignment.word_error_rate(F.col("truth"), F.col("observed")), 9).alias("wer"))


@register(f"WITH {SAMPLES} SELECT doc_id, line, idx, {_distance('observed', 'truth')} <= 1 AS within_one FROM samples")
def bounded_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("doc_id", "line", "idx", alignment.within(F.col("observed"), F.col("truth"), 1).alias("within_one"))


_ASKED = f"""{lines_sql("conversations", "conv_id, turn", "held")},
  _hw AS (SELECT conv_id, turn, line, {tokens_sql("body")} AS w FROM held),
  asked AS (SELECT conv_id, turn, line, i - 1 AS idx, CASE WHEN i > 2 THEN lower(w[i - 2]) ELSE {B} END AS w2, CASE WHEN i > 1 THEN lower(w[i - 1]) ELSE {B} END AS w1, lower(w[i]) AS word
    FROM _hw, unnest(range(1, len(w) + 1)) AS t(i))"""
_PRICED = f"""{NGRAMS}, {LEXICON}, {CHARS}, {_ASKED},
  ctx AS (SELECT context, sum(count)::BIGINT AS ctx FROM chars GROUP BY context),
  types AS (SELECT DISTINCT word, {B} || {B} || {B} || word || {B} AS p FROM asked),
  spots AS (SELECT word, substr(p, i, 3) AS context, substr(p, i + 3, 1) AS ch FROM types, unnest(range(1, length(word) + 2)) AS t(i)),
  charlp AS (SELECT word, sum(ln(coalesce(c.count, 0) + 0.1::DOUBLE) - ln(coalesce(x.ctx, 0) + 0.1::DOUBLE * char_alphabet)) / greatest(length(word), 1) * 5.0::DOUBLE AS char_log_prob
    FROM spots LEFT JOIN chars c USING (context, ch) LEFT JOIN ctx x USING (context) CROSS JOIN totals GROUP BY word),
  t3 AS (SELECT w2, w1, sum(count)::BIGINT AS t FROM tri GROUP BY ALL), t2 AS (SELECT w1, sum(count)::BIGINT AS t FROM bi GROUP BY ALL),
  priced AS (SELECT a.*, ln(greatest(0.55::DOUBLE * coalesce(tri.count / t3.t, 0) + 0.28::DOUBLE * coalesce(bi.count / t2.t, 0)
      + 0.13::DOUBLE * (coalesce(uni.count, 0) + 0.5::DOUBLE) / (totals.words + 0.5::DOUBLE * vocabulary) + 0.04::DOUBLE * exp(char_log_prob), 1e-300::DOUBLE)) AS log_prob
    FROM asked a LEFT JOIN tri USING (w2, w1, word) LEFT JOIN t3 ON t3.w2 = a.w2 AND t3.w1 = a.w1 LEFT JOIN bi ON bi.w1 = a.w1 AND bi.word = a.word LEFT JOIN t2 ON t2.w1 = a.w1
    LEFT JOIN uni ON uni.word = a.word JOIN charlp ON charlp.word = a.word CROSS JOIN totals)"""


def _models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = documents(spark, sf_dir)
    tri, chars = model.word_ngrams(docs), model.char_ngrams(model.lexicon(docs))
    return tri, chars, model.language_totals(model.unigrams(tri), chars)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.text_log_probs(conversations(spark, sf_dir), documents(spark, sf_dir), "conv_id", "turn")


@register(f"WITH {_PRICED} SELECT word, round(char_log_prob, 6) AS char_log_prob FROM charlp")
def char_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = language.context_positions(conversation_lines(spark, sf_dir), "words", "conv_id")
    _, chars, totals = _models(spark, sf_dir)
    return language.char_log_probs(positions, chars, totals).select("word", F.round("char_log_prob", 6).alias("char_log_prob"))


@register(f"WITH {_PRICED} SELECT conv_id, turn, line, idx, word, round(log_prob, 6) AS log_prob FROM priced")
def ngram_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("conv_id", "turn", "line", "idx", "word", F.round("log_prob", 6).alias("log_prob"))


@register(f"WITH {_PRICED} SELECT conv_id, turn, round(avg(-log_prob / ln(2.0::DOUBLE)), 6) AS mean_bits, round(max(-log_prob / ln(2.0::DOUBLE)), 6) AS most_bits FROM priced GROUP BY conv_id, turn")
def surprisal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = _scored(spark, sf_dir).withColumn("bits", language.surprisal(F.col("log_prob")))
    return bits.groupBy("conv_id", "turn").agg(F.round(F.avg("bits"), 6).alias("mean_bits"), F.round(F.max("bits"), 6).alias("most_bits"))


@register(f"""WITH {LEXICON}, types AS (SELECT DISTINCT lower(unnest({tokens_sql()})) AS token FROM conversations),
  asked AS (SELECT token, {_NO_QUOTE.format('token')} AS t, CASE WHEN length(token) <= 4 THEN 1 ELSE 2 END AS k, unnest(range(length(token) - 2, length(token) + 3)) AS n FROM types),
  known AS (SELECT word, count, {_NO_QUOTE.format('word')} AS w, length(word) AS n FROM lexicon),
  near AS (SELECT token, word, count FROM asked JOIN known USING (n) WHERE t <> w AND levenshtein(t, w) <= k)
  SELECT token, word, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY count DESC, word)::INT AS rank FROM near) WHERE rank <= 64""")
def lexicon_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Both sides are cut into keys in several ways: they are made once.
    asked = settled(model.word_stream(conversations(spark, sf_dir)).select(F.col("word").alias("token")).distinct())
    return candidates.lexicon_candidates(asked, settled(model.lexicon(documents(spark, sf_dir)))).select("token", "word", "count", "rank")


_ALT_JSON = """[to_json('x' || event_type)::VARCHAR, '{"text":"' || event_type || '","confidence":0.25}', '{"text":""}', '{"text":"z"}']"""


@register("""WITH e AS (SELECT event_id, event_type, least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS c FROM events),
  a AS (SELECT event_id, unnest(['x' || event_type, event_type, 'z']) AS text, unnest([greatest(1.0::DOUBLE - c, 0.0::DOUBLE) / 4, 0.25::DOUBLE, greatest(1.0::DOUBLE - c, 0.0::DOUBLE) / 4]) AS confidence FROM e)
  SELECT event_id, text, round(confidence, 9) AS confidence FROM a""")
def alternatives_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    raw = F.array(F.concat(F.lit('"x'), kind, F.lit('"')), F.concat(F.lit('{"text":"'), kind, F.lit('","confidence":0.25}')), F.lit('{"text":""}'), F.lit('{"text":"z"}'))
    parsed = candidates.parse_alternatives(raw, F.least(F.col("value") / 100.0, F.lit(1.0)))
    return events.select("event_id", F.explode(parsed).alias("a")).select("event_id", "a.text", F.round("a.confidence", 9).alias("confidence"))


@register(f"WITH {SAMPLES} SELECT doc_id, line, idx, CASE WHEN confidence < 0.55::DOUBLE THEN 'red' ELSE 'none' END AS tier FROM samples")
def fallback_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("doc_id", "line", "idx", decode.fallback_tier(F.col("confidence")).alias("tier"))


@register("""WITH e AS (SELECT l_orderkey, l_linenumber, l_tax * 12.5::DOUBLE AS conf, l_quantity AS bits, l_discount * 20.0::DOUBLE AS margin, l_returnflag = 'A' AS sub, l_returnflag <> 'N' AS is_new, l_linestatus AS obs FROM lineitem)
  SELECT l_orderkey, l_linenumber, CASE WHEN conf < 0.55::DOUBLE THEN 'red' WHEN sub THEN 'amber' WHEN is_new AND margin < 1.5::DOUBLE THEN 'amber' WHEN conf < 0.86::DOUBLE AND bits > 9.0::DOUBLE THEN 'amber' ELSE 'none' END AS tier,
    CASE WHEN conf < 0.55::DOUBLE THEN 'low recognition confidence' WHEN sub THEN 'rescored from ''' || obs || '''' WHEN is_new AND margin < 1.5::DOUBLE THEN 'close call with ''best'''
      WHEN conf < 0.86::DOUBLE AND bits > 9.0::DOUBLE THEN 'unsettled recognition and weak context support' ELSE '' END AS reason FROM e""")
def classify_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    verdict = decode.classify(F.col("l_tax") * 12.5, F.col("l_quantity"), F.col("l_discount") * 20.0, F.col("l_returnflag") == "A", F.col("l_returnflag") != "N", F.col("l_linestatus"), F.lit("best"), decode.Thresholds())
    return rows.select("l_orderkey", "l_linenumber", verdict.alias("v")).select("l_orderkey", "l_linenumber", "v.tier", "v.reason")


_SCORED = "(SELECT c_nationkey AS k, c_name AS candidate, c_acctbal AS score FROM customer)"


@register(f"""SELECT k, candidate, score, round(score - next, 6) AS margin FROM (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS next FROM {_SCORED} WINDOW w AS (PARTITION BY k ORDER BY score DESC, candidate)) WHERE r = 1""")
def best_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("candidate"), F.col("c_acctbal").alias("score"))
    return decode.rank_readings(rows, "k").withColumn("margin", F.round("margin", 6))


def held_out_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as recognised pages: a page is a conversation, its tokens in order."""
    rows = conversations(spark, sf_dir)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"]), "\n")
    pages = rows.groupBy("conv_id").agg(text.alias("text"))
    read = evaluate.synthesize(pages, "conv_id")
    order = F.array_sort(F.collect_list(F.struct("line", "idx", "truth", "observed", "confidence")))
    tokens = read.groupBy("conv_id").agg(order.alias("t")).select("conv_id", F.posexplode("t").alias("idx", "t"))
    alt = "array<struct<text:string,confidence:double>>"
    offered = F.when(F.col("t.confidence") < 0.55, F.array(F.struct(F.col("t.truth").alias("text"), (F.col("t.confidence") * 0.5).alias("confidence")))).otherwise(F.array().cast(alt))
    # Tokens, histories and truths are all taken from these rows: they are made once.
    return packed(tokens.select(F.col("conv_id").alias("page_id"), "idx", F.col("t.truth").alias("truth"), F.col("t.observed").alias("observed"), F.col("t.confidence").alias("confidence"), offered.alias("alternatives")))


def page_models(spark: SparkSession, sf_dir: str) -> decode.Models:
    """Models of the documents, with the confusions of their synthetic recognition."""
    docs = documents(spark, sf_dir)
    confusion, spans = fitted(spark, sf_dir)
    # Every round of a decode reads them all: they are made once.
    return decode.Models.of(confusion, spans, packed(model.lexicon(docs)), packed(model.word_ngrams(docs)))


@register()
def decode_round1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.first_round(held_out_pages(spark, sf_dir).drop("truth"), page_models(spark, sf_dir)).select("page_id", "idx", "text", "original", "tier", "reason", "substituted", "suggestion")


@register()
def decode_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decode.decode(held_out_pages(spark, sf_dir).drop("truth"), page_models(spark, sf_dir))
    return done.select("page_id", "idx", "text", "original", "confidence", "tier", "reason", F.round("surprisal", 2).alias("surprisal"), F.round("margin", 3).alias("margin"), "substituted", "suggestion")


@register()
def flag_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = held_out_pages(spark, sf_dir)
    done = decode.decode(pages.drop("truth"), page_models(spark, sf_dir))
    return evaluate.flag_quality(done.withColumn("observed", F.col("original")).join(pages.select("page_id", "idx", "truth"), ["page_id", "idx"]))


@register(f"""WITH {SAMPLES}, d AS (SELECT *, CASE WHEN confidence < 0.55::DOUBLE THEN 'red' ELSE 'none' END AS tier, lower(observed) <> lower(truth) AS wrong FROM samples),
  n AS (SELECT count(*)::BIGINT AS tokens, count_if(tier = 'red')::BIGINT AS red, count_if(tier <> 'none' AND wrong)::BIGINT AS tp, count_if(tier <> 'none' AND NOT wrong)::BIGINT AS fp, count_if(tier = 'none' AND wrong)::BIGINT AS fn FROM d)
  SELECT *, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 9) AS f1 FROM n""")
def fallback_flag_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("text", F.col("observed")).withColumn("tier", decode.fallback_tier(F.col("confidence"))).withColumn("substituted", F.lit(False))
    return evaluate.flag_quality(rows).select("tokens", "red", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@register(f"""WITH {SAMPLES}, l AS (SELECT doc_id, line, md5('11|' || doc_id || '|' || line) AS h FROM samples GROUP BY doc_id, line)
  SELECT doc_id, line, CASE WHEN row_number() OVER (ORDER BY substr(h, 1, 3), h, doc_id, line) <= floor((SELECT count(*) FROM l) * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM l""")
def split_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = samples(spark, sf_dir).select("doc_id", "line").distinct()
    return evaluate.split_samples(lines, 0.7, evaluate.SEED, "doc_id", "line").select("doc_id", "line", "part")


@register("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN round((l_tax - l_discount) / l_tax, 9) ELSE 0.0 END AS reduction FROM lineitem")
def cer_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(evaluate.cer_reduction(F.col("l_tax"), F.col("l_discount")), 9).alias("reduction"))


@register("""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS a, unnest(string_split(replace(replace(text, 'the ', 'teh '), '. ', ' ')|| '', chr(10))) AS b FROM conversations),
  z AS (SELECT conv_id, turn, list_filter(string_split_regex(a, '\\s+'), lambda x: x <> '') AS x, list_filter(string_split_regex(b, '\\s+'), lambda x: x <> '') AS y FROM w)
  SELECT conv_id, turn, sum(len(list_filter(list_zip(x, y, true), lambda p: p[1] <> p[2])))::BIGINT AS wrong FROM z GROUP BY conv_id, turn""")
def diff_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.replace(F.replace("text", F.lit("the "), F.lit("teh ")), F.lit(". "), F.lit(" "))
    return conversations(spark, sf_dir).groupBy("conv_id", "turn").agg(F.sum(evaluate.differing_words(F.col("text"), after)).cast("long").alias("wrong"))
