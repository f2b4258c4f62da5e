"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores: str = "8", app: str = "tidewire", **conf: str) -> SparkSession:
    """Single-machine session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names storage every executor sees.
    Only where nothing is set (tests on one machine) a temporary one is made.
    """
    base = spark.conf.get(CHECKPOINT_SETTING, None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="tidewire-")
        spark.sparkContext.setCheckpointDir(base)
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame, purpose: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage before a result is used several times; the table outlives any executor."""
    path = shared_folder(df.sparkSession, purpose)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    schema = df.schema
    back = df.sparkSession.read.schema(schema).parquet(path)
    return back.select(*schema.names)


def settle(df: DataFrame, columns: list[str]) -> DataFrame:
    """Compute ``columns`` once per row.

    Catalyst pushes filters below projections by copying the expressions of the columns they use.
    Columns that build on each other in many steps would grow without end; a generator over a single
    row is a step it does not copy through."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*columns))))
