"""Queries over scalar text functions and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import model
from ..sources import readers
from .common import LEXICON, documents, lines_sql, register, table, tokens_sql


@register(f"SELECT doc_id, len({tokens_sql()})::BIGINT AS n_tokens, len(list_distinct(list_transform({tokens_sql()}, lambda x: lower(x))))::BIGINT AS n_types FROM documents")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("w", t.tokenize(F.col("text")))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct(F.transform("w", F.lower))).cast("long").alias("n_types"))


@register("SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::BIGINT AS n_words FROM documents")
def whitespace_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.size(t.split_words(F.col("text"))).cast("long").alias("n_words"))


@register(f"WITH {lines_sql()} SELECT doc_id, count(*)::BIGINT AS n_lines, max(length(body))::BIGINT AS longest FROM lines GROUP BY doc_id")
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = documents(spark, sf_dir).select("doc_id", F.explode(t.splitlines(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).cast("long").alias("longest"))


@register(f"""SELECT token, CASE WHEN upper(token) = token AND lower(token) <> token AND length(token) > 1 THEN upper(target)
    WHEN upper(token[1]) = token[1] AND lower(token[1]) <> token[1] THEN upper(target[1]) || substr(target, 2) ELSE target END AS cased
  FROM (SELECT token, 'x' || lower(token) AS target FROM (SELECT DISTINCT unnest({tokens_sql()}) AS token FROM documents))""")
def match_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = documents(spark, sf_dir).select(F.explode(t.tokenize(F.col("text"))).alias("token")).distinct()
    return tokens.select("token", t.match_case(F.col("token"), F.concat(F.lit("x"), F.lower("token"))).alias("cased"))


@register("""SELECT word, count(*)::BIGINT AS count FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS word FROM documents)
  WHERE word <> '' AND NOT regexp_matches(word, '[A-Za-z]') GROUP BY word""")
def nonword_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select(F.explode(t.split_words(F.col("text"))).alias("word"))
    return words.filter(t.is_nonword(F.col("word"))).groupBy("word").agg(F.count("*").alias("count"))


@register("""SELECT event_id, CASE WHEN isnan(v) THEN 0.0 ELSE least(greatest(v, 0.0), 1.0) END AS confidence
  FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN 'NaN'::DOUBLE ELSE value / 40.0 - 0.5 END AS v FROM events)""")
def clamp_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_type") == "click", float("nan")).otherwise(F.col("value") / 40.0 - 0.5)
    return table(spark, sf_dir, "events").select("event_id", t.clamp(v).alias("confidence"))


_EDIT = "replace(text, 'tion', 'sion')"


@register(f"""WITH e AS (SELECT conv_id, turn, text AS a, CASE WHEN role = 'user' THEN {_EDIT} ELSE {_EDIT} || chr(10) || 'one more' END AS b FROM conversations),
  s AS (SELECT *, string_split(a, chr(10)) AS x, string_split(b, chr(10)) AS y FROM e)
  SELECT conv_id, turn, p AS predicted, c AS corrected FROM (SELECT conv_id, turn, unnest(x) AS p, unnest(y) AS c FROM s WHERE len(x) = len(y))
    WHERE p <> c AND regexp_matches(p, '\\S') AND regexp_matches(c, '\\S')
  UNION ALL SELECT conv_id, turn, a, b FROM s WHERE len(x) <> len(y) AND regexp_matches(a, '\\S') AND regexp_matches(b, '\\S')""")
def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = F.replace("text", F.lit("tion"), F.lit("sion"))
    after = F.when(F.col("role") == "user", edited).otherwise(F.concat(edited, F.lit("\none more")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(t.changed_lines(F.col("text"), after)).alias("p")).select("conv_id", "turn", "p.*")


@register("SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END AS message FROM documents")
def truncate_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", t.truncate(F.col("text")).alias("message"))


@register("""SELECT event_id, CASE WHEN regexp_full_match(s, '[+]?[0-9]+') AND try_cast(s AS BIGINT) > 0 THEN try_cast(s AS BIGINT) END AS id
  FROM (SELECT event_id, CASE event_type WHEN 'click' THEN event_id::VARCHAR WHEN 'view' THEN '-' || event_id WHEN 'error' THEN event_id || 'x' WHEN 'purchase' THEN '99999999999999999999' ELSE '0' || event_id END AS s FROM events)""")
def parse_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    kind = F.col("event_type")
    raw = F.when(kind == "click", n).when(kind == "view", F.concat(F.lit("-"), n)).when(kind == "error", F.concat(n, F.lit("x"))).when(kind == "purchase", F.lit("99999999999999999999")).otherwise(F.concat(F.lit("0"), n))
    return table(spark, sf_dir, "events").select("event_id", t.parse_id(raw).alias("id"))


def _rounded(value: str, digits: int) -> str:
    scale = f"1e{digits}::DOUBLE"
    return f"round(floor({value}) + round_even(({value} - floor({value})) * {scale}, 0) / {scale}, {digits})"


@register(f"SELECT l_orderkey, l_linenumber, {_rounded('(l_extendedprice / 64.0::DOUBLE)', 3)} AS score, {_rounded('(l_discount / 3.0::DOUBLE)', 4)} AS rate, {_rounded('(l_tax / 7.0::DOUBLE)', 5)} AS cer FROM lineitem")
def rounded_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", t.rounded(F.col("l_extendedprice") / 64.0, 3).alias("score"), t.rounded(F.col("l_discount") / 3.0, 4).alias("rate"), t.rounded(F.col("l_tax") / 7.0, 5).alias("cer"))


@register(f"""WITH {LEXICON}, words AS (SELECT lower(trim(w)) AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)),
  both_ AS (SELECT word, count FROM lexicon UNION ALL SELECT word, count(*)::BIGINT FROM words WHERE regexp_full_match(word, '\\p{{L}}+') GROUP BY word)
  SELECT word, sum(count)::BIGINT AS count FROM both_ GROUP BY word""")
def background_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    return model.merge(model.lexicon(documents(spark, sf_dir)), model.background(names, "w"))


@register("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents)
  SELECT doc_id, coalesce(list_aggregate(list_transform(w, lambda x, i: CASE WHEN i = 1 OR (NOT regexp_matches(x, '[A-Za-z]') AND contains('.,;:!?)]}''"', x[1])) THEN x ELSE ' ' || x END), 'string_agg', ''), '') AS joined FROM w""")
def join_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", t.join_tokens(t.split_words(F.col("text"))).alias("joined"))


@register("SELECT doc_id, CASE WHEN instr(text, 'e') = 0 THEN text ELSE substr(text, 1, instr(text, 'e') - 1) || 'c' || substr(text, instr(text, 'e') + 1) END AS misread FROM documents")
def replace_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", t.replace_first(F.col("text"), F.lit("e"), F.lit("c")).alias("misread"))


_NAMES = """(SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'O' THEN 'scan/page-' || lpad(l_linenumber::VARCHAR, 2, '0') || '.png' ELSE 'scan/page' || l_linenumber || '.png' END AS path FROM lineitem)"""


@register(f"SELECT l_orderkey, l_linenumber, coalesce(try_cast(regexp_extract(path, '-(\\d*)[^-]*$', 1) AS INTEGER), 0) AS page_number FROM {_NAMES}")
def page_number_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("string")
    path = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("scan/page-"), F.lpad(n, 2, "0"), F.lit(".png"))).otherwise(F.concat(F.lit("scan/page"), n, F.lit(".png")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t.page_number(path).alias("page_number"))


@register("""SELECT doc_id, CASE WHEN pdf THEN 'split' WHEN ext = '' THEN '.png' WHEN ext IN ('.png', '.jpg', '.jpeg', '.bmp', '.tga') THEN ext ELSE 'error' END AS route FROM (
  SELECT doc_id, lang = 'de' AS pdf, lower(regexp_extract(CASE lang WHEN 'fr' THEN 'A.JPG' WHEN 'es' THEN 'dir.v2/name' ELSE 'x.tiff' END, '(\\.[^./]*)$', 1)) AS ext FROM documents)""")
def upload_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = F.when(F.col("lang") == "de", F.concat(F.lit("%PDF-"), F.col("text"))).otherwise(F.concat(F.lit("x"), F.col("text"))).cast("binary")
    name = F.when(F.col("lang") == "fr", "A.JPG").when(F.col("lang") == "es", "dir.v2/name").otherwise("x.tiff")
    return docs.select("doc_id", readers.upload_route(name, content).alias("route"))


@register("""SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS truth, len(list_filter(string_split_regex(replace(text, 'tion', 'sion'), '\\s+'), lambda x: x <> ''))::INT AS n_observed FROM documents""")
def read_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    observed = F.replace("text", F.lit("tion"), F.lit("sion"))
    full = F.transform(t.split_words(observed), lambda w: F.struct(w.alias("text"), F.lit(0.5).alias("confidence")))
    json = F.when(F.length("text") > 600, F.to_json(F.struct(F.col("text").alias("truth"), observed.alias("observed")))).otherwise(F.to_json(F.struct(F.col("text").alias("truth"), full.alias("observed"))))
    return readers.read_samples(docs.select("doc_id", json.alias("value")), "value", "doc_id").select("doc_id", "truth", F.size("observed").alias("n_observed"))


@register("SELECT doc_id, text AS predicted, replace(text, 'tion', 'sion') AS corrected FROM documents")
def read_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    json = F.to_json(F.struct(F.col("text").alias("predicted"), F.replace("text", F.lit("tion"), F.lit("sion")).alias("corrected")))
    return readers.read_corrections(docs.select("doc_id", json.alias("value")), "value", "doc_id")
