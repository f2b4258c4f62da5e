"""Counts, profiles and newest-first lists over flows and packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewire.operators.ordered import exact_percentiles, sliced_running_sum

SKIPPED_SEVERITY = "Unknown (ARP)"


def counted(df: DataFrame, value: Column, name: str, count: str = "flows") -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias(count))


def severity_counts(flows: DataFrame) -> DataFrame:
    """Flows per severity; "No risk" is NoRisk, ARP flows are left out."""
    severity = F.when(F.col("risk_severity") == "No risk", "NoRisk").otherwise(F.col("risk_severity"))
    return counted(flows.where(F.col("risk_severity") != SKIPPED_SEVERITY), severity, "severity")


def risk_counts(flows: DataFrame) -> DataFrame:
    """Flows per single risk label."""
    labels = F.filter(F.split("risk_label", ", "), lambda x: F.trim(x) != "")
    return counted(flows.select(F.explode(labels).alias("risk")), F.col("risk"), "risk")


def packet_volume(packets: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Packets and bytes per protocol and time bucket."""
    w = F.window(F.timestamp_millis("ts_ms"), bucket)
    return (
        packets.groupBy(w.alias("w"), F.coalesce("protocol", F.lit("UNKNOWN")).alias("protocol"))
        .agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("length").cast("long")).alias("bytes"))
        .select(F.unix_millis("w.start").alias("bucket_ms"), "protocol", "packets", "bytes")
    )


def latest_per_group(df: DataFrame, group: str, order: list[Column], k: int = 1000) -> DataFrame:
    """Newest ``k`` rows per group.

    A group may hold a third of all rows, so it is first cut into hash slices, each ranked on its own;
    at most ``k`` rows per slice go on to the final ranking. Nothing within the first ``k`` can be lost."""
    columns = df.columns
    salted = df.withColumn("__s", F.pmod(F.xxhash64(*columns), F.lit(64)))
    first = Window.partitionBy(group, "__s").orderBy(*order)
    last = Window.partitionBy(group).orderBy(*order)
    return (
        salted.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= k)
        .withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= k)
        .select(*columns)
    )


def live_delay_mean(delays: DataFrame, k: int = 30) -> DataFrame:
    """Mean of the per-flow mean delay over the newest ``k`` flows."""
    newest = delays.orderBy(F.col("last_seen_ms").desc(), "flow_key", "flow_seq").limit(k)
    return newest.agg(F.count(F.lit(1)).alias("flows"), F.avg("mean_delay").alias("mean_delay"))


def dataset_profile(df: DataFrame, label: str) -> DataFrame:
    """Rows, columns, nulls, duplicates, column kinds and label shares as ``item, detail, value``."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in
               ("byte", "short", "integer", "long", "float", "double", "decimal")]

    def missing(c: str) -> Column:
        hit = F.col(c).isNull()
        if df.schema[c].dataType.typeName() in ("float", "double"):
            hit = hit | F.isnan(c)
        return F.count_if(hit)

    wide = df.agg(F.count(F.lit(1)).alias("rows"),
                  *[missing(c).alias(f"m{i}") for i, c in enumerate(df.columns)])
    by_column = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("detail"), F.col(f"m{i}").cast("double").alias("value"))
        for i, c in enumerate(df.columns)])).alias("r")).select("r.*")
    total = sum((F.col(f"m{i}") for i in range(len(df.columns))), F.lit(0))
    facts = wide.select(F.explode(F.array(*[
        F.struct(F.lit(item).alias("item"), F.lit("").alias("detail"), value.cast("double").alias("value"))
        for item, value in [
            ("rows", F.col("rows")), ("columns", F.lit(len(df.columns))), ("missing_total", total),
            ("numeric_columns", F.lit(len(numeric))), ("other_columns", F.lit(len(df.columns) - len(numeric)))]
    ])).alias("r")).select("r.*")
    duplicates = (
        df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("double").alias("value"))
        .select(F.lit("duplicate_rows").alias("item"), F.lit("").alias("detail"), "value"))
    labels = df.groupBy(F.col(label).cast("string").alias("detail")).agg(F.count(F.lit(1)).alias("n"))
    rows = wide.select("rows").scalar()
    shares = labels.select(F.explode(F.array(
        F.struct(F.lit("label_count").alias("item"), "detail", F.col("n").cast("double").alias("value")),
        F.struct(F.lit("label_percent").alias("item"), "detail",
                 F.round(F.col("n") / rows * 100, 2).alias("value")))).alias("r")).select("r.*")
    worst = (by_column.where("value > 0").orderBy(F.col("value").desc(), "detail").limit(10)
             .select(F.lit("missing_by_column").alias("item"), "detail", "value"))
    return facts.unionByName(duplicates).unionByName(shares).unionByName(worst)


def _long(df: DataFrame, aggregates: dict[str, callable], columns: list[str]) -> DataFrame:
    wide = df.agg(*[f(F.col(c).cast("double")).alias(f"{a}{i}")
                    for i, c in enumerate(columns) for a, f in aggregates.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{a}{i}").alias(a) for a in aggregates])
                     for i, c in enumerate(columns)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def feature_describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, sample deviation, minimum and maximum per feature, in one pass."""
    return _long(df, {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}, columns)


def feature_drift(train: DataFrame, test: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """Features whose mean moved most, in percent of the training mean (0 when that is 0)."""
    a = _long(train, {"train_mean": F.avg}, columns)
    b = _long(test, {"test_mean": F.avg}, columns)
    change = F.when(F.col("train_mean") == 0, 0.0).otherwise(
        F.abs((F.col("test_mean") - F.col("train_mean")) / F.col("train_mean")) * 100)
    return (
        a.join(b, "feature").withColumn("diff_percent", change)
        .orderBy(F.col("diff_percent").desc(), "feature").limit(top)
    )


def class_feature_means(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Mean per feature for NORMAL and ANOMALY rows and their distance."""
    def mean(name):
        return lambda c: F.avg(F.when(F.col(label) == name, c))

    out = _long(df, {"normal_mean": mean("NORMAL"), "anomaly_mean": mean("ANOMALY")}, columns)
    return out.withColumn("diff", F.abs(F.col("anomaly_mean") - F.col("normal_mean")))


def attack_type_summary(df: DataFrame) -> DataFrame:
    """Detections and scores per attack type."""
    return df.groupBy("attack_type").agg(
        F.count_if(F.col("label") == "ANOMALY").alias("detections"),
        F.avg("score").alias("score_mean"), F.min("score").alias("score_min"), F.max("score").alias("score_max"),
        F.count(F.lit(1)).alias("total"),
        F.round(F.count_if(F.col("label") == "ANOMALY") / F.count(F.lit(1)) * 100, 2).alias("detection_percent"))


# The percentiles reported for scores.
SCORE_PERCENTILES = [1, 5, 10, 25, 50, 75, 90, 95, 99]


def score_percentiles(df: DataFrame, score: str) -> DataFrame:
    """Exact percentiles and minimum, mean, median, maximum, population deviation: ``name, value``."""
    marks = exact_percentiles(df, score, [p / 100 for p in SCORE_PERCENTILES])
    name = F.concat(F.lit("p"), F.round(F.col("p") * 100).cast("int").cast("string"))
    names = F.when(F.col("p") == 0.5, F.array(name, F.lit("median"))).otherwise(F.array(name))
    named = marks.select(F.explode(names).alias("name"), "value")
    stats = df.agg(F.min(score).alias("min"), F.avg(score).alias("mean"), F.max(score).alias("max"),
                   F.stddev_pop(score).alias("std"))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("min", "mean", "max", "std")])
    return named.unionByName(stats.select(F.explode(rows).alias("r")).select("r.*"))


def ingest_counters(packets: DataFrame, bucket_ms: int = 1000, queued: Column | None = None) -> DataFrame:
    """Packets received so far at the end of each time bucket, and the queue depth if known."""
    per = packets.groupBy((F.floor(F.col("ts_ms") / bucket_ms) * bucket_ms).cast("long").alias("bucket_ms")).agg(
        F.count(F.lit(1)).alias("received"),
        *([F.max(queued).alias("queue")] if queued is not None else []))
    per = per.withColumn("day", F.floor(F.col("bucket_ms") / (bucket_ms * 3600)).cast("long"))
    return sliced_running_sum(per, [], "day", ["bucket_ms"], {"received_total": "received"}).drop("day")


def packet_delta(packets: DataFrame, file: str, idx: str, slice_rows: int = 100_000) -> DataFrame:
    """Milliseconds since the previous packet of the capture, and the replay delay (at least 1).

    Packets are sliced by index. The first packet of a slice follows the last one of the nearest earlier slice that
    holds any, so the numbers may have gaps and no file lies in one task."""
    previous = F.coalesce(F.col("previous"), F.col("ts_ms"))
    return (
        _with_previous(packets, [file], idx, "ts_ms", slice_rows)
        .withColumn("delta_ms", F.col("ts_ms") - previous).drop("previous")
        .withColumn("replay_ms", F.greatest(F.col("delta_ms"), F.lit(1)))
    )


def _with_previous(rows: DataFrame, keys: list[str], order: str, value: str, slice_rows: int) -> DataFrame:
    """Add ``previous``: the ``value`` of the row before in the group; one small row per group and slice is stitched."""
    sliced = rows.withColumn("__slice", F.floor(F.col(order) / slice_rows).cast("long"))
    local = Window.partitionBy(*keys, "__slice").orderBy(order)
    last = sliced.groupBy(*keys, "__slice").agg(F.max_by(value, order).alias("__last"))
    before = last.select(*keys, "__slice", F.lag("__last").over(
        Window.partitionBy(*keys).orderBy("__slice")).alias("__before"))
    previous = F.coalesce(F.lag(value).over(local), F.col("__before"))
    return sliced.join(before, [*keys, "__slice"]).withColumn("previous", previous).drop("__slice", "__before")


def regressions(rows: DataFrame, keys: list[str], order: str, value: str, strict: bool,
                slice_rows: int = 100_000) -> DataFrame:
    """Rows whose ``value`` falls below (``strict``: does not rise above) the previous one of their group.

    The order column is an arrival number; it is sliced like in ``packet_delta``."""
    out = _with_previous(rows, keys, order, value, slice_rows)
    return out.where(F.col(value) <= F.col("previous") if strict else F.col(value) < F.col("previous"))


def merge_sorted(tables: list[DataFrame], order: list[str]) -> DataFrame:
    """All rows of all tables, missing columns null, in one global order (range partitioned)."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.orderBy(*order)
