"""Metrics, thresholds and histograms of scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewire.operators.ordered import distribution, exact_percentiles, percentiles_of, value_counts


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2 * tp, 2 * tp + fp + fn)


def binary_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 (0 where a divisor is 0) in one row."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    counts = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                    F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "*", _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"), _f1(tp, fp, fn).alias("f1"))


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Per class and as macro and weighted means: ``name, precision, recall, f1, support``."""
    pairs = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # From here on the data is one row per pair of classes.
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("claimed")))).alias("s")).select("s.*")
    classes = sides.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("tp", "support", "claimed")]).select(
        F.col("c").cast("string").alias("name"),
        _ratio(F.col("tp"), F.col("claimed")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("claimed") + F.col("support")).alias("f1"), "support")
    values = ("precision", "recall", "f1")
    macro = classes.agg(*[F.avg(v).alias(v) for v in values], F.sum("support").alias("support"))
    weighted = classes.agg(*[(F.sum(F.col(v) * F.col("support")) / F.sum("support")).alias(v) for v in values],
                           F.sum("support").alias("support"))
    return (
        classes.unionByName(macro.withColumn("name", F.lit("macro avg")))
        .unionByName(weighted.withColumn("name", F.lit("weighted avg")))
    )


def roc_pr_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve and average precision, exactly; NaN when there is one class only."""
    d = distribution(df, score, {"pos": F.col(label).cast("long")})
    neg, neg_total = F.col("cnt") - F.col("pos"), F.col("total_cnt") - F.col("total_pos")
    neg_before = F.col("cum_cnt") - F.col("cum_pos") - neg
    flagged = F.col("total_cnt") - (F.col("cum_cnt") - F.col("cnt"))
    hits = F.col("total_pos") - (F.col("cum_pos") - F.col("pos"))
    sums = d.agg(
        F.sum(F.col("pos") * (neg_before + neg / 2)).alias("pairs"),
        F.sum(F.col("pos") * hits / flagged).alias("precision_sum"),
        F.max("total_pos").alias("p"), F.max(neg_total).alias("n"))
    two = (F.col("p") > 0) & (F.col("n") > 0)
    nan = float("nan")
    return sums.select(
        F.when(two, F.col("pairs") / (F.col("p").cast("double") * F.col("n"))).otherwise(nan).alias("roc_auc"),
        F.when(two, F.col("precision_sum") / F.col("p")).otherwise(nan).alias("average_precision"))


# Percentiles tried as thresholds.
THRESHOLD_PERCENTILES = [80, 85, 90, 95, 97, 98, 99, 99.5, 99.9]


def f1_by_threshold(df: DataFrame, label: str, score: str, steps: int = 200, inclusive: bool = True) -> DataFrame:
    """F1 of "score >= thr" (``inclusive``) or "score > thr" for each candidate threshold.

    Candidates are nine percentiles and ``steps`` evenly spaced scores. Rows are counted per score once, and
    scores into the gaps between candidates; all candidates are then judged from those few counts."""
    counts = value_counts(df, score, {"pos": F.col(label).cast("long")})
    ends = counts.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    even = ends.select(F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)),
        lambda i: F.when(i == steps - 1, F.col("hi"))
        .otherwise(F.col("lo") + i * ((F.col("hi") - F.col("lo")) / (steps - 1))))).alias("thr"))
    marks = percentiles_of(counts, score, [p / 100 for p in THRESHOLD_PERCENTILES])
    candidates = even.unionByName(marks.select(F.col("value").alias("thr"))).agg(
        F.array_sort(F.collect_set("thr")).alias("t"))
    below = F.filter(F.col("t"), lambda t: (t <= F.col(score)) if inclusive else (t < F.col(score)))
    gaps = (
        counts.withColumn("t", candidates.scalar()).groupBy(F.size(below).alias("gap"))
        .agg(F.sum("cnt").alias("cnt"), F.sum("pos").alias("pos"))
    )
    # At most ``steps`` + 10 rows from here on.
    rows = candidates.select(F.posexplode("t").alias("gap", "thr")).select(
        (F.col("gap") + 1).alias("gap"), "thr", *[F.lit(0).cast("long").alias(c) for c in ("cnt", "pos")])
    above = Window.orderBy(F.col("gap").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    everywhere = Window.orderBy(F.col("gap").desc()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    judged = (
        rows.unionByName(gaps.select("gap", F.lit(None).cast("double").alias("thr"), "cnt", "pos"))
        .select("thr", F.sum("cnt").over(above).alias("flagged"), F.sum("pos").over(above).alias("tp"),
                F.sum("pos").over(everywhere).alias("total_pos"))
        .where(F.col("thr").isNotNull())
    )
    fp, fn = F.col("flagged") - F.col("tp"), F.col("total_pos") - F.col("tp")
    return judged.select(
        "thr", _f1(F.col("tp"), fp, fn).alias("f1"), _ratio(F.col("tp"), F.col("flagged")).alias("precision"),
        _ratio(F.col("tp"), F.col("total_pos")).alias("recall"))


def best_f1_threshold(df: DataFrame, label: str, score: str, steps: int = 200, inclusive: bool = True) -> DataFrame:
    """The lowest candidate with the best F1."""
    return f1_by_threshold(df, label, score, steps, inclusive).orderBy(F.col("f1").desc(), "thr").limit(1)


def score_histogram(df: DataFrame, label: str, score: str, bins: int = 70) -> DataFrame:
    """Density per class in equal bins over the range of the class: ``label, bin, lo, n, density``."""
    ends = df.groupBy(label).agg(F.min(score).cast("double").alias("lo"), F.max(score).cast("double").alias("hi"),
                                 F.count(F.lit(1)).alias("total"))
    # Counted per score first, so that a hot class is small before it meets its ends.
    counts = df.groupBy(label, score).agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col(score) - F.col("lo")) / width), F.lit(bins - 1)))
    return (
        counts.join(ends, label).withColumn("bin", at.cast("int"))
        .groupBy(label, "bin").agg(F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("lo", "hi", "total")])
        .select(label, "bin", (F.col("lo") + F.col("bin") * width).alias("lo"), "n",
                F.when(width == 0, F.lit(None)).otherwise(F.col("n") / (F.col("total") * width)).alias("density"))
    )


def class_medians(df: DataFrame, label: str, score: str) -> DataFrame:
    return exact_percentiles(df, score, [0.5], keys=[label]).select(label, F.col("value").alias("median"))


def sigma_threshold(train: DataFrame, rows: DataFrame, error: str, sigmas: float = 3.0) -> DataFrame:
    """Flag rows whose error is above mean + 3 population deviations of the training errors."""
    limit = train.agg((F.avg(error) + sigmas * F.stddev_pop(error)).alias("t")).scalar()
    return rows.withColumn("threshold", limit).withColumn("anomaly", F.col(error) > F.col("threshold"))


def percentile_threshold(train: DataFrame, rows: DataFrame, score: str, percentile: float = 1.0) -> DataFrame:
    """ANOMALY below the given percentile of the training scores, else NORMAL."""
    limit = exact_percentiles(train, score, [percentile / 100]).select("value").scalar()
    return rows.withColumn("threshold", limit).withColumn(
        "verdict", F.when(F.col(score) < F.col("threshold"), "ANOMALY").otherwise("NORMAL"))


def sign_verdict(sign: Column) -> Column:
    """-1 is ANOMALY, 1 is NORMAL."""
    return F.when(sign == -1, "ANOMALY").otherwise("NORMAL")
