"""The folder that all machines share: where lineage is cut and results of one step wait for the next."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session on one machine (tests) may name none and gets a temporary folder."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="inkwright-")
    if known.isEmpty():
        sc.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(df: DataFrame) -> DataFrame:
    """As ``settled``, but in compressed batches of columns: a checkpoint of many rows takes a fraction of the disk."""
    schema = df.schema

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in batch.column(0):
                yield from pa.ipc.open_stream(held.as_buffer())

    return settled(df.mapInArrow(pack, "batch binary")).mapInArrow(unpack, schema)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """As ``settled``, in Parquet: smaller than a checkpoint where there are many rows, and read by ``by`` or columns alone."""
    path = fresh_path(df.sparkSession, "stored")
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
