"""The document store as DataFrames: append-only logs, latest-wins folds, roll-ups, the job queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
MAX_ATTEMPTS, LIST_LIMIT = 3, 100
ABANDONED = "gave up after %d attempts: the service stopped while processing this page each time"


class NotFound(LookupError):
    pass


def by_id(table: DataFrame, value: int, column: str = "id") -> DataFrame:
    """The row with this id; raises ``NotFound`` if there is none."""
    row = table.filter(F.col(column) == value)
    if row.isEmpty():
        raise NotFound(value)
    return row


def newest(documents: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    return documents.orderBy(F.desc("id")).limit(limit if limit > 0 else LIST_LIMIT)


def latest(log: DataFrame, key: str, *columns: str, at: str = "updated_at", number: str = "id") -> DataFrame:
    """The last non-null value of each column by ``at``: an update is a further row of the log.

    Of rows with equal ``at`` the one with the least ``number`` holds, in whatever order rows are read.
    """
    place = F.struct(F.col(at), -F.col(number))
    return log.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull() & F.col(at).isNotNull(), place)).alias(c) for c in columns], F.max(at).alias(at))


def insert_pages(pages: DataFrame, new: DataFrame) -> DataFrame:
    """Union; raises if (document_id, page_index) isn't unique afterwards."""
    both = pages.unionByName(new)
    if not both.groupBy("document_id", "page_index").count().filter("count > 1").isEmpty():
        raise ValueError("page index taken")
    return both


def page_counts(documents: DataFrame, pages: DataFrame) -> DataFrame:
    counts = pages.groupBy("document_id").agg(F.count("*").cast("int").alias("page_count"))
    return documents.drop("page_count").join(counts, documents["id"] == counts["document_id"], "left").drop("document_id").fillna(0, ["page_count"])


def replace_tokens(tokens: DataFrame, new: DataFrame) -> DataFrame:
    """Tokens of the pages in ``new`` are replaced as a whole."""
    return tokens.join(new.select("page_id").distinct(), "page_id", "left_anti").unionByName(new)


def document_text(pages: DataFrame, document: str = "document_id", index: str = "page_index", text: str = "text") -> DataFrame:
    """Pages in order, a blank line between."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(text).alias("t")))), lambda p: p["t"])
    return pages.groupBy(document).agg(F.array_join(ordered, "\n\n").alias("text"))


def claim(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` oldest queued jobs become running, with one attempt more."""
    chosen = jobs.filter("state = 'queued'").orderBy("id").limit(n).select(F.col("id").alias("_id"))
    mine = F.col("_id").isNotNull()
    marked = jobs.join(F.broadcast(chosen), F.col("id") == F.col("_id"), "left")
    return marked.withColumn("state", F.when(mine, "running").otherwise(F.col("state"))).withColumn("attempts", F.col("attempts") + F.when(mine, 1).otherwise(0)).drop("_id")


def recovered_state(state: Column, attempts: Column) -> Column:
    """At start-up: running jobs that had all attempts fail, other running ones go back to the queue."""
    return F.when((state == "running") & (attempts >= MAX_ATTEMPTS), "failed").when(state == "running", "queued").otherwise(state)


def recover(jobs: DataFrame) -> DataFrame:
    lost = (F.col("state") == "running") & (F.col("attempts") >= MAX_ATTEMPTS)
    return jobs.withColumn("error", F.when(lost, F.format_string(ABANDONED, "attempts")).otherwise(F.col("error"))).withColumn("state", recovered_state(F.col("state"), F.col("attempts")))


def pending(jobs: DataFrame, document: str = "document_id") -> DataFrame:
    return jobs.groupBy(document).agg(F.count_if(F.col("state").isin("queued", "running")).alias("pending"))


def roll_up(jobs: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, status, completed, total, error): running while anything is pending, else failed if a job failed, else done."""
    return jobs.groupBy(document).agg(
        F.when(F.count_if(F.col("state").isin("queued", "running")) > 0, "running").when(F.count_if(F.col("state") == "failed") > 0, "failed").otherwise("done").alias("status"),
        F.count_if(F.col("state").isin("done", "failed")).alias("completed"),
        F.count("*").alias("total"),
        F.min_by("error", F.when(F.col("state") == "failed", F.col("id"))).alias("error"),
    )


def cascade_delete(documents: DataFrame, pages: DataFrame, tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the documents in ``gone`` (id), their pages, and what hangs on those pages."""
    dead = gone.select(F.col("id").alias("_id"))
    dead_pages = pages.join(dead, F.col("document_id") == F.col("_id"), "left_semi").select(F.col("id").alias("_page"))
    left = {"documents": documents.join(dead, F.col("id") == F.col("_id"), "left_anti"), "pages": pages.join(dead, F.col("document_id") == F.col("_id"), "left_anti")}
    return left | {name: t.join(dead_pages, F.col("page_id") == F.col("_page"), "left_anti") for name, t in tables.items()}


def claims_in_order(jobs: DataFrame, blocks: int = 64) -> DataFrame:
    """(id, turn) of queued jobs: the order in which claims take them.

    Ids are cut into blocks of about the same number of jobs by approximate quantiles; jobs are
    numbered within a block, and the blocks' counts summed up, so no task sorts all of them, however
    the ids are spread.
    """
    queued = jobs.filter("state = 'queued'").select("id")
    bounds = sorted(set(queued.approxQuantile("id", [i / blocks for i in range(1, blocks)], 1 / (4 * blocks))))
    at = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b <= F.col("id"))) if bounds else F.lit(0)
    placed = queued.withColumn("_b", at)
    counts = placed.groupBy("_b").agg(F.count("*").alias("n"))
    first = counts.select("_b", (F.sum("n").over(Window.orderBy("_b")) - F.col("n")).alias("_before"))
    return placed.join(F.broadcast(first), "_b").select("id", (F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("id"))).alias("turn"))


def enqueue(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """``jobs`` with a queued one, without attempts, for each of ``pages`` (id, document_id, page_id)."""
    new = pages.select("id", "document_id", "page_id", F.lit("queued").alias("state"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))
    return jobs.unionByName(new, allowMissingColumns=True)


def finish(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs named in ``done`` (id, error) are done, or failed at once where there is an error; a failed job isn't tried again."""
    marks = done.select(F.col("id").alias("_id"), F.col("error").alias("_error"))
    both = jobs.join(marks, F.col("id") == F.col("_id"), "left")
    named = F.col("_id").isNotNull()
    state = F.when(named & F.col("_error").isNotNull(), "failed").when(named, "done").otherwise(F.col("state"))
    return both.withColumn("state", state).withColumn("error", F.when(named, F.col("_error")).otherwise(F.col("error"))).drop("_id", "_error")


def requeue_running(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs with all running ones back in the queue, one row with how many they were)."""
    running = F.col("state") == "running"
    return jobs.withColumn("state", F.when(running, "queued").otherwise(F.col("state"))), jobs.agg(F.count_if(running).alias("affected"))


def tokens_of_page(tokens: DataFrame, page: int) -> DataFrame:
    return tokens.filter(F.col("page_id") == page).orderBy("idx")


def page_with_tokens(pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each page with its tokens as an array in order; pages without tokens have an empty one."""
    rest = [c for c in tokens.columns if c != "page_id"]
    ordered = F.array_sort(F.collect_list(F.struct("idx", *[c for c in rest if c != "idx"])))
    by_page = tokens.groupBy(F.col("page_id").alias("_page")).agg(ordered.alias("tokens"))
    both = pages.join(by_page, F.col("id") == F.col("_page"), "left").drop("_page")
    return both.withColumn("tokens", F.coalesce("tokens", F.array().cast(both.schema["tokens"].dataType)))


def corrections_in_order(log: DataFrame, limit: int | None = None) -> DataFrame:
    rows = log.orderBy("id")
    return rows.limit(limit) if limit else rows


def set_preprocessed(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``pages`` with the preprocessing fields of ``found`` (id and any of skew, width, height, image); pages it doesn't name keep theirs."""
    fields = [c for c in found.columns if c != "id"]
    new = found.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in fields])
    both = pages.join(new, F.col("id") == F.col("_id"), "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in pages.columns])


def status(documents: DataFrame, pages: DataFrame, jobs: DataFrame, corrections: DataFrame) -> DataFrame:
    """One row: how many documents, pages, pending and failed jobs, corrections."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    state = jobs.agg(F.count_if(F.col("state").isin("queued", "running")).alias("pending"), F.count_if(F.col("state") == "failed").alias("failed"))
    return count(documents, "documents").crossJoin(count(pages, "pages")).crossJoin(state).crossJoin(count(corrections, "corrections"))


def snapshot_then_events(documents: DataFrame, jobs: DataFrame, events: DataFrame) -> DataFrame:
    """(document_id, at, type, completed, total): where each document stands, at its first place, then what happened since."""
    now = roll_up(jobs).select("document_id", F.lit(None).cast("timestamp").alias("at"), F.lit("snapshot").alias("type"), "completed", "total")
    later = events.select("document_id", F.col("at").cast("timestamp").alias("at"), "type", F.lit(None).cast("long").alias("completed"), F.lit(None).cast("long").alias("total"))
    known = documents.select(F.col("id").alias("_id"))
    return now.unionByName(later).join(known, F.col("document_id") == F.col("_id"), "left_semi")
