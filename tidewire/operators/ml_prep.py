"""Labels, features, splits and scaling for the flow models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidewire.operators.ordered import exact_percentiles, sliced_rank, sliced_running_sum
from tidewire.session import settle

# The model's base and derived features.
BASE_FEATURES = [
    "bytes", "packet_count", "min_packet_length", "max_packet_length", "mean_packet_length",
    "stddev_packet_length", "bytes_per_second", "packets_per_second", "total_bytes_upstream",
    "total_bytes_downstream", "total_packets_upstream", "total_packets_downstream",
    "inter_arrival_time_mean", "inter_arrival_time_stddev", "inter_arrival_time_min",
    "inter_arrival_time_max", "syn_count", "fin_count", "rst_count", "ack_count", "psh_count",
    "flow_duration_ms", "syn_rate", "fin_rate", "rst_rate", "ack_rate", "psh_rate", "duration_ms",
]
DERIVED_FEATURES = ["avg_packet_interval_ms", "syn_fin_diff", "ack_rate_per_ms", "iat_max_to_mean_ratio"]
MODEL_FEATURES = BASE_FEATURES + DERIVED_FEATURES
SMALL = 1e-6
# By preparation version, what a zero is replaced with, where, and which columns get log1p.
ZERO_RULES = {
    "v2": (SMALL, ["flow_duration_ms", "inter_arrival_time_mean", "total_packets_upstream",
                   "total_packets_downstream"]),
    "v1": (1.0, ["flow_duration_ms", "inter_arrival_time_mean"]),
}
V1_LOG_COLUMNS = ["bytes_per_second", "packets_per_second", "avg_packet_interval_ms"]
CLIP = 1e8


def label_by_ip(flows: DataFrame, attackers: list[str] | DataFrame, default: Column) -> DataFrame:
    """MALICIOUS when either end is an attacker, else the default.

    A list becomes a literal test; a table (column ``ip``) two left joins Spark may broadcast by size."""
    if isinstance(attackers, list):
        hit = F.col("src_ip").isin(attackers) | F.col("dst_ip").isin(attackers)
        return flows.withColumn("label", F.when(hit, "MALICIOUS").otherwise(default))
    known = attackers.select("ip").distinct()
    out = flows
    for side in ("src", "dst"):
        out = out.join(known.select(F.col("ip").alias(f"{side}_ip"), F.lit(True).alias(f"__{side}")),
                       f"{side}_ip", "left")
    hit = F.coalesce("__src", "__dst", F.lit(False))
    return out.withColumn("label", F.when(hit, "MALICIOUS").otherwise(default)).drop("__src", "__dst")


def _finite(c: Column) -> Column:
    # Zero times a number is zero, times NaN or an infinity it is NaN.
    return F.when(c * 0 == 0, c).otherwise(0.0)


def clean_features(df: DataFrame, columns: list[str] | None = None, final: bool = True) -> DataFrame:
    """Missing columns 0, other text 0, NaN 0, negatives 0 and, when ``final``, infinities 0."""
    out = {}
    for c in columns or BASE_FEATURES:
        value = F.col(c).try_cast("double") if c in df.columns else F.lit(0.0)
        value = F.greatest(F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
        out[c] = _finite(value) if final else value
    return df.withColumns(out)


def derived_features(df: DataFrame, version: str = "v2") -> DataFrame:
    """The four derived features; zeros in the divisors are replaced first, by version."""
    replacement, columns = ZERO_RULES[version]
    df = df.withColumns({c: F.when(F.col(c) == 0, replacement).otherwise(F.col(c).cast("double")) for c in columns})
    packets = F.col("total_packets_upstream") + F.col("total_packets_downstream")
    return df.withColumns({
        "avg_packet_interval_ms": F.col("flow_duration_ms") / (packets + SMALL),
        "syn_fin_diff": (F.col("syn_count") - F.col("fin_count")).cast("double"),
        "ack_rate_per_ms": F.col("ack_count") / (F.col("flow_duration_ms") + SMALL),
        "iat_max_to_mean_ratio": F.col("inter_arrival_time_max") / (F.col("inter_arrival_time_mean") + SMALL),
    })


def log_clip(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Clip to [0, 1e8], then log1p."""
    return df.withColumns({
        c: F.log1p(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(CLIP))) for c in columns or MODEL_FEATURES})


def log_v1(df: DataFrame) -> DataFrame:
    """The first preparation: log1p of three columns, nothing clipped."""
    return df.withColumns({c: F.log1p(F.col(c)) for c in V1_LOG_COLUMNS})


def prepare(flows: DataFrame) -> DataFrame:
    """Published flow features to model features, one shared list for fitting and scoring."""
    named = flows.withColumn("flow_duration_ms", F.col("duration_ms"))
    clean = settle(clean_features(named, final=False), BASE_FEATURES)
    ready = settle(derived_features(clean), MODEL_FEATURES)
    return settle(ready.withColumns({c: _finite(F.col(c)) for c in MODEL_FEATURES}), MODEL_FEATURES)


def order_hash(*columns: str, seed: int) -> Column:
    """Repeatable pseudo-random order of rows."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def stratified_split(df: DataFrame, ids: list[str], label: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """Add ``part`` train or test with exact shares per label, the same on every run.

    Rows are ranked per label by the hash of their id; the leading hash digits cut a label into
    slices, so no label is ranked in one task."""
    hashed = df.withColumn("__h", order_hash(*ids, seed=seed)).withColumn("__s", F.left("__h", F.lit(4)))
    ranked = sliced_rank(hashed, [label], "__s", ["__h", *ids], "__r")
    sizes = df.groupBy(label).agg(F.floor(F.count(F.lit(1)) * share).alias("__n"))
    return (
        ranked.join(sizes, label)
        .withColumn("part", F.when(F.col("__r") < F.col("__n"), "train").otherwise("test"))
        .select(*df.columns, "part")
    )


def bounded_sample(df: DataFrame, ids: list[str], k: int, seed: int = 42) -> DataFrame:
    """At most ``k`` rows without replacement: those with the smallest id hash.

    Rows are first counted by their leading hash digits; only rows up to the digits that reach ``k``
    are sorted, so the sort sees little more than ``k`` rows however large the table is."""
    hashed = df.withColumn("__h", order_hash(*ids, seed=seed)).withColumn("__p", F.left("__h", F.lit(5)))
    counts = hashed.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).withColumn("__s", F.left("__p", F.lit(2)))
    reached = sliced_running_sum(counts, [], "__s", ["__p"], {"c": "n"})
    last = reached.where(F.col("c") >= k).agg(F.min("__p")).scalar()
    return (
        hashed.where(F.col("__p") <= F.coalesce(last, F.lit("g")))
        .orderBy("__h", *ids).limit(k).drop("__h", "__p")
    )


@dataclass(frozen=True)
class Scaling:
    """``(x - shift) / width`` per column; the few fitted numbers live on the driver."""

    shift: dict[str, float]
    width: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - self.shift[c]) / self.width[c] for c in self.shift})


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("c")).select("c.*")


def quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact ``q1, median, q3`` per feature, all features in one pass."""
    marks = exact_percentiles(_long(df, columns), "value", [0.25, 0.5, 0.75], keys=["feature"])
    return marks.groupBy("feature").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
          for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])


def fit_robust(df: DataFrame, columns: list[str]) -> Scaling:
    """Median and interquartile range; a range of 0 scales by 1."""
    rows = quartiles(df, columns).collect()  # one row per feature
    return Scaling({r.feature: r.median for r in rows}, {r.feature: (r.q3 - r.q1) or 1.0 for r in rows})


def fit_minmax(df: DataFrame, columns: list[str]) -> Scaling:
    """Range of the training rows; a range of 0 scales by 1."""
    row = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns)
                   for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return Scaling({c: row[f"lo{i}"] for i, c in enumerate(columns)},
                   {c: (row[f"hi{i}"] - row[f"lo{i}"]) or 1.0 for i, c in enumerate(columns)})


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight``: negatives over positives (each at least 1) for positive rows, else 1."""
    ratio = df.agg((F.greatest(F.count_if(F.col(label) == 0), F.lit(1))
                    / F.greatest(F.count_if(F.col(label) == 1), F.lit(1))).alias("r")).scalar()
    return df.withColumn("weight", F.when(F.col(label) == 1, ratio).otherwise(1.0))
