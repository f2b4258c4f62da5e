"""Batches of a stream, stored so that a reader sees each batch whole or not at all.

``path/data`` holds what was written, a folder per attempt; ``path/commits`` a small file per batch that names
the attempt that counts. It is renamed into place after the write, so a job that dies before leaves an
attempt that nobody reads, and a batch that is replayed after its commit is not written again. Nothing that
was committed is ever overwritten."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "query string, batch_id long, attempt string"


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def running_query(spark: SparkSession) -> str:
    """Id of the stream whose batch this is: it stays the same when the stream resumes from its checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def is_committed(spark: SparkSession, path: str, query: str, batch_id: int) -> bool:
    where, files = _located(spark, f"{path}/commits/{query}.{batch_id}.json")
    return files.exists(where)


def commit(spark: SparkSession, path: str, query: str, batch_id: int, attempt: str) -> None:
    draft, files = _located(spark, f"{path}/commits/_{attempt}")
    out = files.create(draft, True)
    try:
        out.write(bytearray(json.dumps({"query": query, "batch_id": batch_id, "attempt": attempt}), "utf-8"))
    finally:
        out.close()
    final, _ = _located(spark, f"{path}/commits/{query}.{batch_id}.json")
    if not files.rename(draft, final):
        raise OSError(f"batch {batch_id} was committed by another attempt: {final}")


def write_once(write: Callable[[DataFrame, str], None], path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that stores each batch by ``write(batch, folder)`` exactly once."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = running_query(spark)
        if is_committed(spark, path, query, batch_id):
            return
        attempt = f"a{uuid.uuid4().hex}"
        write(batch, f"{path}/data/batch_id={batch_id}/attempt={attempt}")
        commit(spark, path, query, batch_id, attempt)
    return run


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all committed batches, with ``batch_id``. Spark skips the folders of other attempts."""
    done = spark.read.schema(MANIFEST).json(f"{path}/commits").select("attempt")
    rows = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    return rows.join(done, "attempt", "left_semi").drop("attempt")
