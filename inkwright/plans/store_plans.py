"""Queries over the store: lists, roll-ups, the queue, texts, streams. Orders stand in for documents and line items for pages and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..shared import fresh_path
from ..sources import sinks
from ..streaming import progress as streams
from .common import register, table

_STATE = "CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'done' ELSE CASE l_linestatus WHEN 'O' THEN 'queued' ELSE 'running' END END"
_JOBS = f"""jobs AS (SELECT l_orderkey * 100000 + l_partkey * 8 + l_linenumber AS id, l_orderkey AS document_id, l_linenumber AS page_id, {_STATE} AS state, (l_quantity::INT % 5)::INT AS attempts,
  CASE l_returnflag WHEN 'R' THEN 'e' || l_partkey END AS error FROM lineitem)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    state = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "done").otherwise(F.when(F.col("l_linestatus") == "O", "queued").otherwise("running"))
    key = F.col("l_orderkey") * 100000 + F.col("l_partkey") * 8 + F.col("l_linenumber")
    error = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("e"), F.col("l_partkey").cast("string")))
    return rows.select(key.alias("id"), F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_id"), state.alias("state"), (F.col("l_quantity").cast("int") % 5).alias("attempts"), error.alias("error"))


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("updated_at"), F.col("o_custkey").alias("source"))


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"))
    return rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_index"), F.concat(F.lit("page "), F.col("part").cast("string")).alias("text"))


_PAGES = "pages_ AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS document_id, l_linenumber AS page_index, 'page ' || max(l_partkey) AS text FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@register("SELECT o_orderkey AS id, o_orderpriority AS title, o_orderstatus AS status FROM orders ORDER BY o_orderkey DESC LIMIT 200")
def doc_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.newest(scan_documents(spark, sf_dir), 200).select("id", "title", "status")


@register("SELECT o_orderkey AS id, o_orderpriority AS title, o_orderstatus AS status FROM orders WHERE o_orderkey = 7")
def doc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.by_id(scan_documents(spark, sf_dir), 7).select("id", "title", "status")


@register(f"WITH {_PAGES} SELECT id, page_index, text FROM pages_ WHERE document_id = 7 ORDER BY page_index")
def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pages(spark, sf_dir).filter("document_id = 7").orderBy("page_index").select("id", "page_index", "text")


@register("SELECT o_custkey AS source, arg_max(o_orderstatus, o_totalprice) AS status, arg_max(o_orderpriority, o_totalprice) AS title, max(o_totalprice) AS updated_at FROM orders GROUP BY o_custkey")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(scan_documents(spark, sf_dir), "source", "status", "title")


@register(f"WITH {_PAGES} SELECT o_orderkey AS id, coalesce(n, 0)::INT AS page_count FROM orders LEFT JOIN (SELECT document_id, count(*) AS n FROM pages_ GROUP BY document_id) ON document_id = o_orderkey")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page_counts(scan_documents(spark, sf_dir), scan_pages(spark, sf_dir)).select("id", "page_count")


@register(f"""WITH {_PAGES} SELECT document_id, count(*)::BIGINT AS n, min(page_index)::INT AS first_index FROM (SELECT document_id, page_index FROM pages_ UNION ALL SELECT o_orderkey, 9 FROM orders) GROUP BY document_id""")
def insert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = scan_pages(spark, sf_dir)
    new = scan_documents(spark, sf_dir).select((F.col("id") * 8).alias("id"), F.col("id").alias("document_id"), F.lit(9).alias("page_index"), F.lit("new").alias("text"))
    return store.insert_pages(pages, new).groupBy("document_id").agg(F.count("*").alias("n"), F.min("page_index").cast("int").alias("first_index"))


@register(f"WITH {_PAGES} SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY page_index) AS text FROM pages_ GROUP BY document_id")
def doc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.document_text(scan_pages(spark, sf_dir))


@register("""SELECT l_orderkey AS page_id, l_partkey AS idx, 'old' AS text FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
  UNION ALL SELECT o_orderkey, 0, 'new' FROM orders WHERE o_orderstatus = 'F'""")
def replace_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("idx"), F.lit("old").alias("text"))
    new = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("page_id"), F.lit(0).cast("long").alias("idx"), F.lit("new").alias("text"))
    return store.replace_tokens(old, new)


@register(f"""WITH {_JOBS}, c AS (SELECT id FROM jobs WHERE state = 'queued' ORDER BY id LIMIT 5)
  SELECT id, document_id, CASE WHEN id IN (SELECT id FROM c) THEN 'running' ELSE state END AS state, attempts + CASE WHEN id IN (SELECT id FROM c) THEN 1 ELSE 0 END AS attempts FROM jobs""")
def job_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.claim(jobs(spark, sf_dir), 5).select("id", "document_id", "state", "attempts")


@register(f"WITH {_JOBS} SELECT id, row_number() OVER (ORDER BY id)::BIGINT AS turn FROM jobs WHERE state = 'queued'")
def job_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.claims_in_order(jobs(spark, sf_dir)).select("id", F.col("turn").cast("long").alias("turn"))


@register(f"""WITH {_JOBS} SELECT id, CASE WHEN state = 'running' AND attempts >= 3 THEN 'failed' WHEN state = 'running' THEN 'queued' ELSE state END AS state,
  CASE WHEN state = 'running' AND attempts >= 3 THEN 'gave up after ' || attempts || ' attempts: the service stopped while processing this page each time' ELSE error END AS error FROM jobs""")
def job_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.recover(jobs(spark, sf_dir)).select("id", "state", "error")


@register(f"WITH {_JOBS} SELECT document_id, count_if(state IN ('queued', 'running'))::BIGINT AS pending FROM jobs GROUP BY document_id")
def pending_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.pending(jobs(spark, sf_dir))


@register(f"WITH {_JOBS} SELECT document_id, state, count(*)::BIGINT AS n FROM jobs GROUP BY ALL")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).groupBy("document_id", "state").agg(F.count("*").alias("n"))


@register(f"""WITH {_JOBS} SELECT document_id, CASE WHEN count_if(state IN ('queued', 'running')) > 0 THEN 'running' WHEN count_if(state = 'failed') > 0 THEN 'failed' ELSE 'done' END AS status,
  count_if(state IN ('done', 'failed'))::BIGINT AS completed, count(*)::BIGINT AS total, arg_min(error, id) FILTER (state = 'failed') AS error FROM jobs GROUP BY document_id""")
def doc_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.roll_up(jobs(spark, sf_dir))


@register(f"""WITH {_PAGES}, dead AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F')
  SELECT 'documents' AS name, count(*)::BIGINT AS n FROM orders WHERE o_orderkey NOT IN (SELECT id FROM dead)
  UNION ALL SELECT 'pages', count(*) FROM pages_ WHERE document_id NOT IN (SELECT id FROM dead)
  UNION ALL SELECT 'tokens', count(*) FROM lineitem WHERE l_orderkey * 8 + l_linenumber NOT IN (SELECT id FROM pages_ WHERE document_id IN (SELECT id FROM dead))""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = scan_documents(spark, sf_dir), scan_pages(spark, sf_dir)
    tokens = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("page_id"))
    left = store.cascade_delete(docs, pages, {"tokens": tokens}, docs.filter("status = 'F'").select("id"))
    out = None
    for name in ("documents", "pages", "tokens"):
        row = left[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = row if out is None else out.union(row)
    return out


@register("SELECT conv_id, count(*)::BIGINT AS corrections FROM conversations WHERE role = 'user' GROUP BY conv_id")
def correction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("corrections"))


@register("""SELECT 'event: ' || event_type || chr(10) || 'data: {"type":"' || event_type || '","page_id":' || event_id || '}' || chr(10) || chr(10) AS frame FROM events""")
def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.col("event_id").alias("page_id"))
    return sinks.event_stream_text(events)


@register("SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def progress_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.progress(table(spark, sf_dir, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("value", 4).alias("value"))


@register("SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    out = streams.run_to_table(streams.progress(stream), fresh_path(spark, "progress"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("value", 4).alias("value"))


@register("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
  SELECT user_id, epoch_us(min(ts))::BIGINT AS session_start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def edit_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.edit_sessions(table(spark, sf_dir, "events"))
    return out.select("user_id", F.unix_micros("session_start").alias("session_start"), "n")


@register("SELECT user_id AS document_id, event_id % 7 AS page_id, arg_max(event_type, (epoch_us(ts), event_type)) AS type FROM events GROUP BY ALL")
def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), (F.col("event_id") % 7).alias("page_id"), F.col("event_type").alias("type"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return streams.page_status(events)
