"""Per-second rates, gauges and stage durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Sample types and the units they are stored with.
RATE = "FLOW_AGGREGATION_RATE"
GAUGES = {"SYSTEM_CPU": "%", "SYSTEM_RAM": "%"}


def metric_rows(samples: DataFrame, window: str = "1 second", truncate: bool = False) -> DataFrame:
    """Samples ``type, value, ts`` to one row per type and window: rates are summed, gauges averaged.

    ``truncate`` cuts samples to whole numbers first."""
    return finish_sums(window_sums(samples, window, truncate))


def window_sums(samples: DataFrame, window: str, truncate: bool = False) -> DataFrame:
    """Sum and number of the samples per type and window. Sums of parts of the samples can be added up later."""
    value = F.col("value")
    if truncate:
        value = value.cast("long").cast("double")
    return (
        samples.groupBy(F.window("ts", window).alias("w"), "type")
        .agg(F.sum(value).alias("total"), F.count(value).alias("samples"))
        .select("type", F.unix_millis("w.start").alias("timestamp"), "total", "samples")
    )


def finish_sums(sums: DataFrame) -> DataFrame:
    """Metric rows of ``window_sums``, several rows per type and window added up."""
    gauge = F.col("type").isin(*GAUGES)
    unit = F.when(F.col("type") == RATE, "packets/s").when(gauge, "%").otherwise("")
    mean = F.when(F.col("samples") > 0, F.col("total") / F.col("samples")).otherwise(0.0)
    return (
        sums.groupBy("type", "timestamp").agg(F.sum("total").alias("total"), F.sum("samples").alias("samples"))
        .select("type", F.when(gauge, mean).otherwise(F.col("total")).alias("rate"), unit.alias("unit"), "timestamp")
    )


def rate_per_second(samples: DataFrame, window: str = "1 second") -> DataFrame:
    return metric_rows(samples.where(F.col("type") == RATE), window)


def gauge_avg_per_second(samples: DataFrame, window: str = "1 second", truncate: bool = False) -> DataFrame:
    return metric_rows(samples.where(F.col("type") != RATE), window, truncate)


def stage_duration(stages: DataFrame, name: str, start_ns: Column, end_ns: Column) -> DataFrame:
    """Milliseconds from the earliest start to the latest end of each stage."""
    return stages.groupBy(name).agg(
        F.min(start_ns).alias("start_ns"), F.max(end_ns).alias("end_ns")
    ).withColumn("duration_ms", (F.col("end_ns") - F.col("start_ns")) / 1e6)
