"""Small helpers about the session: checkpoints, partition counts, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that all machines share: ``spark.checkpoint.dir``.

    Only a session on one machine (tests) that names none gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir()
    if not isinstance(named, str):
        named = named.get() if named.isDefined() else None
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="inkwright-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_or_shuffled(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast if a count shows at most ``max_rows`` rows; else it is joined by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df.hint("merge")
