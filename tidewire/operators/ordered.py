"""Running sums, ranks and exact quantiles over groups of any size.

A plain window puts a whole group into one task. Here a group is cut into
slices by a value of the row itself (a time bucket, an id range, a score
range): the window runs inside a slice, and only one small row per slice is
stitched over the group. Slices come from the data, not from the physical
partitioning, so a recomputed task gives the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewire.session import materialize

#: Distinct values per slice that ``cumulate`` aims at, and the bounds of its number of slices.
SLICE_VALUES, MIN_SLICES, MAX_SLICES = 250_000, 128, 8_192
CUT_RUN = 64


def sliced_running_sum(df: DataFrame, keys: list[str], slice_col: str, order: list[str],
                       values: dict[str, str | Column], inclusive: bool = True) -> DataFrame:
    """Add, for each ``out: value`` of ``values``, the running sum in the order (slice, order).

    ``slice_col`` must be a non-decreasing function of ``order`` inside a group."""
    values = {o: F.col(v) if isinstance(v, str) else v for o, v in values.items()}
    totals = df.groupBy(*keys, slice_col).agg(*[F.sum(v).alias(f"__{o}") for o, v in values.items()])
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, slice_col,
        *[F.coalesce(F.sum(f"__{o}").over(before), F.lit(0)).alias(f"__{o}") for o in values])
    local = Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    return (
        df.select("*", *[F.coalesce(F.sum(v).over(local), F.lit(0)).alias(o) for o, v in values.items()])
        .join(offsets, [*keys, slice_col])
        .withColumns({o: F.col(o) + F.col(f"__{o}") for o in values})
        .drop(*[f"__{o}" for o in values])
    )


def sliced_rank(df: DataFrame, keys: list[str], slice_col: str, order: list[str], out: str) -> DataFrame:
    """``row_number`` minus one in the order (slice, order) inside each group."""
    return sliced_running_sum(df, keys, slice_col, order, {out: F.lit(1)}, inclusive=False)


def time_rank(df: DataFrame, keys: list[str], ts: str, row_id: str, slice_ms: int, out: str) -> DataFrame:
    """Position (from 0) of each row of a group in the order (time, id), for groups of any size.

    Rows are counted per millisecond before the shuffle; the running count of milliseconds is
    stitched over time slices, and inside a millisecond rows are ranked by slices of their id.
    Ids are unique whole numbers."""
    per_ms = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__s", F.floor(F.col(ts) / slice_ms))
    before = sliced_running_sum(per_ms, keys, "__s", [ts], {"__before": "__n"}, inclusive=False).select(
        *keys, ts, "__before")
    ranked = sliced_rank(df.withColumn("__s", F.floor(F.col(row_id) / 65536)), [*keys, ts], "__s", [row_id], "__r")
    return ranked.join(before, [*keys, ts]).select(
        *df.columns, (F.col("__before") + F.col("__r")).cast("long").alias(out))


def value_counts(df: DataFrame, value: str, sums: dict[str, Column] | None = None,
                 keys: list[str] | None = None) -> DataFrame:
    """Distinct values with their number ``cnt`` and further sums, written once: the only read of ``df``."""
    keys = keys or []
    return materialize(
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias(value))
        .agg(*[F.sum(c).alias(n) for n, c in {"cnt": F.lit(1), **(sums or {})}.items()]), "value-counts")


def cumulate(counts: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Add to ``value_counts`` the cumulative and total sums ``cum_s, total_s`` of each sum, without a global sort.

    The distinct values of a key are cut at approximate quantiles (a bounded sketch), so every slice is
    of like size whatever the shape of the distribution; a wrong cut costs balance, never correctness. There are
    as many slices as values need: about ``SLICE_VALUES`` in each."""
    keys = keys or []
    sums = [c for c in counts.columns if c not in (*keys, value)]
    slices = min(MAX_SLICES, max(MIN_SLICES, counts.count() // SLICE_VALUES))
    facts = counts.groupBy(*keys).agg(
        F.percentile_approx(value, [i / slices for i in range(1, slices)], 16 * slices).alias("__cuts"),
        *[F.sum(n).alias(f"total_{n}") for n in sums])
    if keys:
        joined = counts.join(facts, keys)
    else:
        names = ["__cuts", *[f"total_{n}" for n in sums]]
        joined = counts.withColumn("__f", facts.select(F.struct(*names)).scalar()).select("*", "__f.*").drop("__f")
    # Cuts below the value: whole runs of cuts first, then those of one run.
    runs = F.size(F.filter(F.sequence(F.lit(1), F.lit((slices - 1) // CUT_RUN)),
                           lambda i: F.get("__cuts", i * CUT_RUN - 1) < F.col(value)))
    joined = joined.withColumn("__run", runs * CUT_RUN)
    in_run = F.size(F.filter(F.slice("__cuts", F.col("__run") + 1, F.lit(CUT_RUN)), lambda c: c < F.col(value)))
    sliced = joined.withColumn("__slice", F.col("__run") + in_run).drop("__cuts", "__run")
    return sliced_running_sum(
        sliced, keys, "__slice", [value], {f"cum_{n}": n for n in sums}).drop("__slice")


def distribution(df: DataFrame, value: str, sums: dict[str, Column] | None = None,
                 keys: list[str] | None = None) -> DataFrame:
    """Distinct values with their counts and cumulative counts, exactly.

    Returns ``keys, value, cnt, cum_cnt, total_cnt`` and, for each extra sum ``s``, ``s, cum_s, total_s``."""
    return cumulate(value_counts(df, value, sums, keys), value, keys)


def exact_percentiles(df: DataFrame, value: str, probs: list[float], keys: list[str] | None = None) -> DataFrame:
    """Percentiles by linear interpolation between order statistics: rows ``keys, p, value``."""
    return percentiles_of(value_counts(df, value, keys=keys), value, probs, keys)


def percentiles_of(counts: DataFrame, value: str, probs: list[float], keys: list[str] | None = None) -> DataFrame:
    """``exact_percentiles`` of counted values."""
    keys = keys or []
    ranked = cumulate(counts.select(*keys, value, "cnt"), value, keys)
    points = F.array(*[F.struct(F.lit(float(p)).alias("p"),
                                (F.lit(float(p)) * (F.col("total_cnt") - 1)).alias("pos")) for p in probs])
    first, end = F.col("cum_cnt") - F.col("cnt"), F.col("cum_cnt")

    # A value covers the ranks [first, end); it counts for p if it holds the rank below or above.
    def held(rank: Column) -> Column:
        return (rank >= first) & (rank < end)

    hits = F.filter(points, lambda q: held(F.floor(q["pos"])) | held(F.ceil(q["pos"])))
    return (
        ranked.select(*keys, F.explode(hits).alias("q"), F.col(value).alias("v"))
        .groupBy(*keys, F.col("q.p").alias("p"), F.col("q.pos").alias("pos"))
        .agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        .select(*keys, "p",
                (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("pos") - F.floor("pos"))).alias("value"))
    )
