"""Differences between the packet and flow tables of two tools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: relative difference in percent up to which two numbers are equal.
TOLERANCE_PERCENT = 0.0001


def dedupe_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row per key in ``order``; combined before the shuffle, so a hot key costs no sort."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")
        .select(*df.columns)
    )


def count_duplicates(df: DataFrame) -> DataFrame:
    """Rows that equal an earlier row in all columns."""
    return (
        df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    )


def key_except(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys found on one side only: ``key, side``."""
    sides = (a.select(key, F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
             .unionByName(b.select(key, F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))))
    return (
        sides.groupBy(key).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
        .where("in_a <> in_b")
        .select(key, F.when(F.col("in_a") == 1, "only_a").otherwise("only_b").alias("side"))
    )


def flow_presence_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Totals, missing counts and percentages in one row. Both sides are combined per key in one shuffle."""
    sides = (a.select(key, F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
             .unionByName(b.select(key, F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))))
    per_key = sides.groupBy(key).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    counts = per_key.agg(
        F.coalesce(F.sum("in_a"), F.lit(0)).alias("total_a"),
        F.coalesce(F.sum("in_b"), F.lit(0)).alias("total_b"),
        F.count_if(F.expr("in_a = 1 and in_b = 0")).alias("missing_in_b"),
        F.count_if(F.expr("in_a = 0 and in_b = 1")).alias("missing_in_a"))

    def percent(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.round(F.col(part) / F.col(whole) * 100, 2))

    return counts.select(
        "*",
        percent("missing_in_b", "total_a").alias("missing_in_b_percent"),
        (100 - percent("missing_in_b", "total_a")).alias("success_a_percent"),
        percent("missing_in_a", "total_b").alias("missing_in_a_percent"),
        (100 - percent("missing_in_a", "total_b")).alias("success_b_percent"))


def diff_samples(diff: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The first ``n`` keys of each side."""
    sides = [diff.where(F.col("side") == side).orderBy(key).limit(n) for side in ("only_a", "only_b")]
    return reduce(DataFrame.unionByName, sides)


def differs(a: Column, b: Column) -> Column:
    """Zero against non-zero always differs; otherwise the relative difference decides."""
    return (
        F.when(a == b, False).when((a == 0) | (b == 0), True)
        .otherwise(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)) * 100 > TOLERANCE_PERCENT)
    )


def _paired(a: DataFrame, b: DataFrame, key: str, metrics: list[str], order: str) -> DataFrame:
    """One row per key of both sides: the last row of each side in ``order``, so repeated keys make no pairs."""
    last = [dedupe_by_key(side.select(key, order, *[m for m in metrics if m != order]), key, order) for side in (a, b)]
    return last[0].alias("a").join(last[1].alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"))


def feature_diff(a: DataFrame, b: DataFrame, key: str, metrics: list[str], order: str) -> DataFrame:
    """Differing cells of rows with equal keys: ``key, metric, a, b, difference``.

    Where a key repeats, its last row in ``order`` counts."""
    def clean(side: str, m: str) -> Column:
        return F.nanvl(F.coalesce(F.col(f"{side}.{m}").cast("double"), F.lit(0.0)), F.lit(0.0))

    joined = _paired(a, b, key, metrics, order)
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), clean("a", m).alias("a"), clean("b", m).alias("b"))
                      for m in metrics])
    # Equal cells are dropped before the rows are multiplied.
    return (
        joined.select(F.col(f"a.{key}").alias(key),
                      F.explode(F.filter(cells, lambda c: differs(c["a"], c["b"]))).alias("c"))
        .select(key, "c.metric", "c.a", "c.b", F.round(F.col("c.a") - F.col("c.b"), 4).alias("difference"))
    )


def feature_diff_summary(a: DataFrame, b: DataFrame, key: str, metrics: list[str], order: str) -> DataFrame:
    """Differences and their percentage per metric, among the keys compared."""
    def clean(side: str, m: str) -> Column:
        return F.nanvl(F.coalesce(F.col(f"{side}.{m}").cast("double"), F.lit(0.0)), F.lit(0.0))

    joined = _paired(a, b, key, metrics, order)
    wide = joined.agg(F.count(F.lit(1)).alias("compared"),
                      *[F.count_if(differs(clean("a", m), clean("b", m))).alias(f"d{i}")
                        for i, m in enumerate(metrics)])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"d{i}").alias("differences"))
                     for i, m in enumerate(metrics)])
    return wide.select("compared", F.explode(rows).alias("r")).select(
        "r.metric", "compared", "r.differences",
        F.when(F.col("compared") > 0, F.round(F.col("r.differences") / F.col("compared") * 100, 2))
        .alias("percent"))


def packet_positional_diff(a: DataFrame, b: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """Row i of A against row i of B: rows, differing rows and cells, accuracy in percent.

    Unequal row counts are reported with ``comparable = false`` and no accuracy."""
    def cell(side: str, c: str) -> Column:
        return F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit("0"))

    joined = a.alias("a").join(b.alias("b"), F.col(f"a.{position}") == F.col(f"b.{position}"), "full")
    cells = [(~cell("a", c).eqNullSafe(cell("b", c))).cast("int") for c in columns]
    diff = reduce(lambda x, y: x + y, cells)
    out = joined.agg(
        F.count(f"a.{position}").alias("rows_a"), F.count(f"b.{position}").alias("rows_b"),
        F.count_if(diff > 0).alias("different_rows"), F.sum(diff).alias("different_cells"))
    same = F.col("rows_a") == F.col("rows_b")
    return out.select(
        "rows_a", "rows_b", same.alias("comparable"),
        F.when(same, F.col("different_rows")).alias("different_rows"),
        F.when(same, F.col("different_cells")).alias("different_cells"),
        F.when(same & (F.col("rows_a") > 0),
               F.round((F.col("rows_a") - F.col("different_rows")) / F.col("rows_a") * 100, 4)).alias("accuracy"))
