"""Queries over whole user actions: uploads, page edits, job life cycle, snapshots, statistics, fallback, adaptation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import service
from ..operators import candidates, channel, evaluate, model, store
from ..shared import fresh_path, packed
from ..sources import sinks
from ..streaming.progress import text_delta
from .common import ALIGN, CHARS, LEXICON, NGRAMS, SAMPLES, conversations, documents, fitted, misread, register, samples, table
from .score_plans import held_out_pages, page_models
from .store_plans import _JOBS, jobs, scan_pages

_UPLOADS = """uploads AS (SELECT doc_id AS id, CASE lang WHEN 'fr' THEN 'A.JPG' WHEN 'es' THEN 'dir.v2/name' WHEN 'de' THEN 'b.pdf' ELSE 'x.tiff' END AS name, source AS title, lang = 'de' AS pdf, doc_id % 3 AS n, doc_id % 7 = 0 AS blank FROM documents)"""


def _ingested(spark: SparkSession, sf_dir: str) -> service.Ingested:
    docs = documents(spark, sf_dir, "lang", "source")
    lang = F.col("lang")
    content = F.when(F.col("doc_id") % 7 == 0, F.lit("")).when(lang == "de", F.concat(F.lit("%PDF-"), F.col("text"))).otherwise(F.concat(F.lit("x"), F.col("text"))).cast("binary")
    name = F.when(lang == "fr", "A.JPG").when(lang == "es", "dir.v2/name").when(lang == "de", "b.pdf").otherwise("x.tiff")
    split = F.when(lang == "de", F.slice(F.array(F.lit("p-1.png"), F.lit("p-2.png")), F.lit(1), (F.col("doc_id") % 3).cast("int")))
    return service.ingest_documents(docs.select(F.col("doc_id").alias("id"), name.alias("name"), F.col("source").alias("title"), content.alias("content"), split.alias("split")))


@register(f"""WITH {_UPLOADS}, made AS (SELECT *, CASE WHEN pdf THEN n WHEN name = 'x.tiff' THEN 0 ELSE 1 END AS k FROM uploads WHERE NOT blank)
  SELECT id, CASE WHEN trim(coalesce(title, '')) = '' THEN name ELSE trim(title) END AS title, CASE WHEN k = 0 THEN 'failed' ELSE 'running' END AS status,
    CASE WHEN name = 'x.tiff' THEN 'cannot read files of this kind: x.tiff' WHEN k = 0 THEN 'the document has no pages' END AS error, k::INT AS page_count FROM made""")
def uploaded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).documents.select("id", "title", "status", "error", "page_count")


@register(f"""WITH {_UPLOADS}, made AS (SELECT *, CASE WHEN pdf THEN n WHEN name = 'x.tiff' THEN 0 ELSE 1 END AS k FROM uploads WHERE NOT blank)
  SELECT id * 1048576 + i AS id, id AS document_id, CASE WHEN pdf THEN 'p-' || (i + 1) || '.png' WHEN name = 'A.JPG' THEN id || '.jpg' ELSE id || '.png' END AS source_path, 'queued' AS state, 0 AS attempts FROM made, unnest(range(k)) AS t(i)""")
def uploaded_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _ingested(spark, sf_dir)
    return made.jobs.join(made.pages.select("id", "source_path"), "id").select("id", "document_id", "source_path", "state", "attempts")


_EDITED = "CASE WHEN role = 'user' THEN replace(text, 'the ', 'teh ') ELSE text END"


@register(f"""WITH p AS (SELECT conv_id * 1000 + turn AS page_id, text AS a, {_EDITED} AS b FROM conversations),
  l AS (SELECT page_id, a <> b AS changed, unnest(string_split(a, chr(10))) AS x, unnest(string_split(b, chr(10))) AS y FROM p)
  SELECT page_id, changed, count_if(x <> y AND trim(x) <> '' AND trim(y) <> '')::INT AS pairs FROM l GROUP BY ALL""")
def page_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "role")
    edits = rows.select(F.col("id").alias("page_id"), F.when(F.col("role") == "user", F.replace("text", F.lit("the "), F.lit("teh "))).otherwise(F.col("text")).alias("text"))
    return service.apply_corrections(rows.select("id", "text"), edits).results


_FELL_BACK = "doc_id % 5 = 0"


@register(f"""WITH {SAMPLES} SELECT doc_id AS page_id, line * 100000 + idx AS idx, CASE WHEN {_FELL_BACK} THEN observed ELSE upper(observed) END AS text,
  CASE WHEN {_FELL_BACK} THEN CASE WHEN confidence < 0.55::DOUBLE THEN 'red' ELSE 'none' END ELSE 'amber' END AS tier FROM samples""")
def fallback_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth page's reply lacks its first line."""
    observed = samples(spark, sf_dir).select(F.col("doc_id").alias("page_id"), (F.col("line") * 100000 + F.col("idx")).alias("idx"), "observed", "confidence")
    first = F.min("idx").over(Window.partitionBy("page_id"))
    reply = observed.withColumn("first", first).filter("page_id % 5 <> 0 or idx <> first").drop("first")
    reply = reply.select("page_id", "idx", F.upper("observed").alias("text"), F.col("observed").alias("original"), "confidence", F.lit("amber").alias("tier"), F.lit("").alias("reason"), F.lit(None).cast("string").alias("suggestion"))
    return service.with_fallback(observed, reply).select("page_id", "idx", "text", "tier")


@register(f"""WITH {_JOBS}, d AS (SELECT DISTINCT id AS k FROM jobs WHERE state = 'running')
  SELECT id, CASE WHEN k IS NULL THEN state WHEN id % 3 = 0 THEN 'failed' ELSE 'done' END AS state, CASE WHEN k IS NULL THEN error WHEN id % 3 = 0 THEN 'bad page' END AS error FROM jobs LEFT JOIN d ON k = id""")
def job_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = jobs(spark, sf_dir)
    done = every.filter("state = 'running'").select("id", F.when(F.col("id") % 3 == 0, "bad page").alias("error")).distinct()
    return store.finish(every, done).select("id", "state", "error")


@register(f"""WITH {_JOBS} SELECT CASE state WHEN 'running' THEN 'queued' ELSE state END AS state, count(*)::BIGINT AS n, (SELECT count_if(state = 'running') FROM jobs)::BIGINT AS affected FROM jobs GROUP BY 1""")
def job_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, affected = store.requeue_running(jobs(spark, sf_dir))
    return after.groupBy("state").agg(F.count("*").alias("n")).crossJoin(affected)


@register(f"""WITH {_JOBS} SELECT state, count(*)::BIGINT AS n, sum(attempts)::BIGINT AS attempts FROM (SELECT state, attempts FROM jobs UNION ALL SELECT 'queued', 0 FROM orders) GROUP BY state""")
def job_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select((-F.col("o_orderkey")).alias("id"), F.col("o_orderkey").alias("document_id"), F.col("o_orderkey").alias("page_id"))
    return store.enqueue(jobs(spark, sf_dir), pages).groupBy("state").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


@register("SELECT o_orderkey AS id, o_orderstatus AS status, coalesce(string_agg(l_returnflag || l_linenumber, ' ' ORDER BY l_linenumber, l_returnflag), '') AS tokens FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    tokens = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("idx"), F.col("l_returnflag").alias("text"))
    both = store.page_with_tokens(pages, tokens)
    return both.select("id", "status", F.array_join(F.transform("tokens", lambda t: F.concat(t["text"], t["idx"].cast("string"))), " ").alias("tokens"))


@register("SELECT l_linenumber AS idx, l_partkey AS part FROM lineitem WHERE l_orderkey = 7")
def tokens_of_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").alias("part"))
    return store.tokens_of_page(tokens, 7).select("idx", "part")


@register("SELECT event_id AS id, event_type AS predicted FROM events ORDER BY event_id LIMIT 50")
def corrections_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.corrections_in_order(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("predicted")), 50)


@register("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS skew_deg, o_orderpriority AS clean_path FROM orders")
def preprocess_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0.0).alias("skew_deg"), F.col("o_orderpriority").alias("clean_path"))
    found = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.lit(1.5).alias("skew_deg"), F.lit(None).cast("string").alias("clean_path"))
    return store.set_preprocessed(pages, found)


@register(f"""WITH {_JOBS} SELECT (SELECT count(*) FROM orders)::BIGINT AS documents, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))::BIGINT AS pages,
  (SELECT count_if(state IN ('queued', 'running')) FROM jobs)::BIGINT AS pending, (SELECT count_if(state = 'failed') FROM jobs)::BIGINT AS failed, (SELECT count(*) FROM conversations)::BIGINT AS corrections""")
def service_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.document_status(table(spark, sf_dir, "orders"), scan_pages(spark, sf_dir), jobs(spark, sf_dir), table(spark, sf_dir, "conversations"))


@register(f"""WITH {_JOBS}, known AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F')
  SELECT document_id, 'snapshot' AS type, count_if(state IN ('done', 'failed'))::BIGINT AS completed, 1::BIGINT AS n FROM jobs WHERE document_id IN (SELECT id FROM known) GROUP BY document_id
  UNION ALL SELECT user_id, event_type, NULL, count(*)::BIGINT FROM events WHERE user_id IN (SELECT id FROM known) GROUP BY ALL""")
def snapshot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("ts").alias("at"), F.col("event_type").alias("type"))
    rows = store.snapshot_then_events(docs, jobs(spark, sf_dir), events)
    return rows.groupBy("document_id", "type").agg(F.max("completed").alias("completed"), F.count("*").alias("n"))


def _learned(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four tables: the documents' text, and the confusions of their synthetic recognition."""
    confusion, spans = fitted(spark, sf_dir)
    spans = spans.select(F.lit("span").alias("kind"), F.col("observed").alias("a"), F.col("truth").alias("b"), "count")
    return {"confusion": confusion.unionByName(spans)} | text_delta(documents(spark, sf_dir))


@register(f"""WITH RECURSIVE {ALIGN}, {LEXICON} SELECT (SELECT count(*) FROM lexicon)::BIGINT AS lexicon_words, (SELECT sum(count) FROM lexicon)::BIGINT AS lexicon_tokens,
  (SELECT count(*) FROM confusion WHERE kind = 'sub')::BIGINT AS confusion_pairs, (SELECT count(*) FROM spans)::BIGINT AS confusion_spans, (SELECT count(*) FROM conversations)::BIGINT AS corrections, 0.55::DOUBLE AS low_confidence""")
def model_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = service.model_stats(_learned(spark, sf_dir), table(spark, sf_dir, "conversations"))
    return row.select("lexicon_words", "lexicon_tokens", "confusion_pairs", "confusion_spans", "corrections", "low_confidence")


@register(f"""WITH {NGRAMS}, {LEXICON}, {CHARS} SELECT 'char_ngrams' AS model, count(*)::BIGINT AS rows, sum(count)::BIGINT AS total FROM chars UNION ALL SELECT 'lexicon', count(*)::BIGINT, sum(count)::BIGINT FROM lexicon
  UNION ALL SELECT 'ngrams', count(*)::BIGINT, sum(count)::BIGINT FROM (SELECT count FROM tri UNION ALL SELECT count FROM bi UNION ALL SELECT count FROM uni)
  UNION ALL SELECT 'words', 1::BIGINT, sum(count)::BIGINT FROM lexicon""")
def ingested_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = {name: spark.createDataFrame([], schema) for name, schema in sinks.TABLES.items()}
    after, words = service.ingest_text(spark, documents(spark, sf_dir), empty)
    out = words.select(F.lit("words").alias("model"), F.lit(1).cast("long").alias("rows"), F.col("words").alias("total"))
    for name in ("char_ngrams", "lexicon", "ngrams"):
        out = out.union(after[name].agg(F.lit(name).alias("model"), F.count("*").alias("rows"), F.sum("count").alias("total")))
    return out


@register(f"WITH {LEXICON}, more AS (SELECT word, count FROM lexicon UNION ALL SELECT word, count FROM lexicon) SELECT word, sum(count)::BIGINT AS count FROM more GROUP BY word")
def model_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved, loaded, ingested once more and saved again: the last snapshot's lexicon."""
    root = fresh_path(spark, "model")
    for _ in range(2):
        after, _ = service.ingest_text(spark, documents(spark, sf_dir), sinks.load_model(spark, root))
        sinks.save_model(spark, root, after)
    return sinks.load_model(spark, root)["lexicon"]


@register("""SELECT l_orderkey AS page_id, l_partkey AS idx, 'old' AS text FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
  UNION ALL SELECT o_orderkey, 0, 'new' FROM orders WHERE o_orderstatus = 'F'""")
def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages saved, some of them saved again, all read back."""
    path = fresh_path(spark, "page-results")
    old = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("idx"), F.lit("old").alias("text"))
    new = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("page_id"), F.lit(0).cast("long").alias("idx"), F.lit("new").alias("text"))
    sinks.save_page_results(old, path)
    sinks.save_page_results(new, path)
    return sinks.load_page_results(spark, path, old.schema)


@register()
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every distinct token of the conversations' synthetic recognition."""
    # Of the language model a pool needs the words' counts alone: no n-gram is made.
    confusion, spans = fitted(spark, sf_dir)
    unigrams = packed(model.word_counts(documents(spark, sf_dir)))
    lexicon = unigrams.filter(F.col("word") != model.BOUNDARY)
    tokens = held_out_pages(spark, sf_dir).select(F.lower("observed").alias("token"), "alternatives")
    return candidates.candidate_pool(tokens, lexicon, unigrams, confusion, spans, cut=packed).select("token", "candidate", "alt_confidence", "is_self")


@register()
def channel_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel's price of each distinct (observed, truth) of the documents' synthetic recognition."""
    pairs = misread(spark, sf_dir)
    asked = pairs.select(F.col("predicted").alias("observed"), F.col("corrected").alias("candidate"))
    return channel.log_channels(asked, channel.Channel.of(fitted(spark, sf_dir, pairs)[0])).withColumn("log_channel", F.round("log_channel", 6))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.synthesize(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id")


@register()
def adapted_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates and flags on held-out lines of the benchmark passages, before and after learning the others' corrections."""
    return service.adapted_evaluation(spark, _passages(spark, sf_dir), "item_id", "line")


@register()
def margin_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag quality by substitution margin on the benchmark passages, with models of the documents' lexicon and confusions."""
    rows = _passages(spark, sf_dir).select(F.struct("item_id", "line").alias("page_id"), "idx", "truth", "observed", "confidence", F.lit(None).cast("array<struct<text:string,confidence:double>>").alias("alternatives"))
    return evaluate.sweep_margin(rows.drop("truth"), rows, page_models(spark, sf_dir))
