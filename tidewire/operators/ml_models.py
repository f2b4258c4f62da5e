"""Isolation forest, reconstruction error, density noise, projection and the flow classifier."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tidewire.operators.boosting import TRAIN_ROWS, BoostedTrees, Growth, fit_boosted
from tidewire.operators.ml_prep import bounded_sample, order_hash
from tidewire.operators.ordered import exact_percentiles
from tidewire.session import materialize

TREE_ROWS = 256
TREE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth double"


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _grow_tree(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    x = np.vstack(pdf.sort_values("slot")["x"].to_list())
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes, todo = [], [(0, np.arange(len(x)), 0)]
    nodes.append([0, -1, 0.0, -1, -1, 0.0])
    while todo:
        node, rows, depth = todo.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes[node][5] = depth + _average_path(len(rows))
            continue
        feature = int(rng.choice(usable))
        cut = float(low[feature] + (high[feature] - low[feature]) * rng.random())
        if not cut < high[feature]:  # rounded up between neighbours, or a width beyond the numbers: both sides get rows
            cut = float(low[feature])
        left_side = x[rows, feature] <= cut
        left, right = len(nodes), len(nodes) + 1
        nodes += [[left, -1, 0.0, -1, -1, 0.0], [right, -1, 0.0, -1, -1, 0.0]]
        nodes[node][1:5] = [feature, cut, left, right]
        todo += [(left, rows[left_side], depth + 1), (right, rows[~left_side], depth + 1)]
    out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "depth"])
    out.insert(0, "tree", tree)
    return out


@dataclass
class IsolationForest:
    """Trees of at most 511 nodes each; ``threshold`` is the training percentile of the scores."""

    columns: list[str]
    trees: list[tuple]
    rows_per_tree: int
    threshold: float | None = None

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Add the score: minus the usual anomaly score, so that low is anomalous."""
        trees = df.sparkSession.sparkContext.broadcast(self.trees)
        scale = _average_path(self.rows_per_tree)

        @F.pandas_udf("double")
        def path_score(rows: pd.Series) -> pd.Series:
            x = np.vstack(rows.to_list())
            total = np.zeros(len(x))
            each = np.arange(len(x))
            for feature, cut, left, right, depth in trees.value:
                at = np.zeros(len(x), dtype=np.int64)
                inner = feature[at] >= 0
                while inner.any():
                    go_left = x[each, np.maximum(feature[at], 0)] <= cut[at]
                    at = np.where(inner, np.where(go_left, left[at], right[at]), at)
                    inner = feature[at] >= 0
                total += depth[at]
            return pd.Series(-(2.0 ** (-(total / len(trees.value)) / scale)))

        return df.withColumn(out, path_score(F.array(*[F.col(c).cast("double") for c in self.columns])))

    def label(self, df: DataFrame, score: str = "score") -> DataFrame:
        """-1 for scores below the threshold, else 1."""
        return df.withColumn("sign", F.when(F.col(score) < self.threshold, -1).otherwise(1))


def fit_isolation_forest(df: DataFrame, ids: list[str], columns: list[str], trees: int = 300,
                         contamination: float = 0.001, seed: int = 42) -> IsolationForest:
    """Fit trees side by side, each on 256 rows drawn by id hash.

    The pool holds at most ``trees * 256`` rows; row r fills the slots r, r + pool, ... of the trees."""
    slots = trees * TREE_ROWS
    x = F.array(*[F.col(c).cast("double") for c in columns]).alias("x")
    pool = materialize(
        bounded_sample(df.select(*ids, x), ids, slots, seed)
        .select("x", order_hash(*ids, seed=seed).alias("h")), "forest-pool")
    size = pool.count()
    ranked = pool.select("x", F.expr("row_number() over (order by h) - 1").alias("r"))  # bounded pool
    filled = ranked.select("x", F.explode(F.sequence(F.col("r").cast("long"), F.lit(slots - 1).cast("long"),
                                                     F.lit(size).cast("long"))).alias("slot"))
    nodes = (
        filled.withColumn("tree", F.floor(F.col("slot") / TREE_ROWS).cast("int"))
        .groupBy("tree").applyInPandas(lambda pdf: _grow_tree(pdf, seed), TREE_SCHEMA)
        .toPandas()  # at most trees * 511 nodes
    )
    packed = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        packed.append(tuple(t[c].to_numpy() for c in ("feature", "cut", "left", "right", "depth")))
    forest = IsolationForest(columns, packed, min(TREE_ROWS, size))
    forest.threshold = exact_percentiles(forest.score(df), "score", [contamination]).first()["value"]
    return forest


def _vector(df: DataFrame, columns: list[str]) -> DataFrame:
    doubles = df.withColumns({c: F.col(c).cast("double") for c in columns})
    return VectorAssembler(inputCols=columns, outputCol="features").transform(doubles)


def reconstruction_error(train: DataFrame, rows: DataFrame, columns: list[str], k: int = 8) -> DataFrame:
    """Mean squared error after projection on ``k`` principal components of the training rows and back.

    The components (columns x k) and the means are small; tasks project whole batches of rows. The training rows are read
    several times, so they should be stored ones."""
    means_row = train.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    pc = PCA(k=k, inputCol="features", outputCol="p").fit(_vector(train, columns)).pc.toArray()
    means = np.array([means_row[c] for c in columns], dtype=float)

    @F.pandas_udf("double")
    def error(batch: pd.DataFrame) -> pd.Series:
        centered = batch.to_numpy(dtype=float) - means
        return pd.Series(((centered - centered @ pc @ pc.T) ** 2).mean(axis=1))

    return rows.withColumn("error", error(F.struct(*[F.col(c).cast("double").alias(c) for c in columns])))


def pca_2d(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[float]]:
    """Two principal components per row, and the share of variance each explains."""
    data = _vector(df, columns)
    model = PCA(k=2, inputCol="features", outputCol="pca").fit(data)
    out = model.transform(data).withColumn("__a", vector_to_array("pca"))
    return (
        out.withColumns({"pc1": F.col("__a")[0], "pc2": F.col("__a")[1]}).drop("features", "pca", "__a"),
        [float(v) for v in model.explainedVariance.toArray()],
    )


def density_noise(df: DataFrame, ids: list[str], x: str, y: str, eps: float = 0.5, min_rows: int = 5) -> DataFrame:
    """Add ``noise`` in the sense of density clustering in two dimensions, exactly.

    Rows are counted into cells whose diagonal is ``eps``: all rows of a cell with ``min_rows`` rows
    are core. Only rows of thinner cells are compared, with the distinct points of the 24 cells
    around, so a crowded cell is never compared with itself."""
    side = eps / math.sqrt(2)
    points = df.groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(
        F.count(F.lit(1)).alias("n"))
    points = points.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    points = materialize(points, "density-points")
    cells = points.groupBy("cx", "cy").agg(F.sum("n").alias("cell_n"))
    points = points.join(cells, ["cx", "cy"]).withColumn("dense", F.col("cell_n") >= min_rows)
    around = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"))
                       for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4])

    def near(thin: DataFrame, others: DataFrame) -> DataFrame:
        probes = thin.select("x", "y", "cx", "cy", F.explode(around).alias("d")).select(
            "x", "y", (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"))
        pairs = probes.join(
            others.select("cx", "cy", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("n").alias("on")),
            ["cx", "cy"])
        apart = F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2)
        return pairs.where(apart <= eps * eps)

    thin = points.where("not dense")
    counted = near(thin, points).groupBy("x", "y").agg(F.sum("on").alias("near"))
    core_thin = materialize(
        thin.join(counted, ["x", "y"]).where(F.col("near") >= min_rows).select("x", "y", "cx", "cy", "n"),
        "density-core")
    core = points.where("dense").select("x", "y", "cx", "cy", "n").unionByName(core_thin)
    kept = near(thin.join(core_thin, ["x", "y"], "left_anti"), core).select("x", "y").distinct()
    noise = (
        thin.join(core_thin, ["x", "y"], "left_anti").join(kept, ["x", "y"], "left_anti")
        .select(F.col("x").alias("__x"), F.col("y").alias("__y"), F.lit(True).alias("__noise")))
    return (
        df.join(noise, (F.col(x).cast("double") == F.col("__x")) & (F.col(y).cast("double") == F.col("__y")), "left")
        .withColumn("noise", F.coalesce("__noise", F.lit(False))).drop("__x", "__y", "__noise")
    )


def train_classifier(df: DataFrame, columns: list[str], label: str, ids: list[str] | None = None, rounds: int = 600,
                     depth: int = 8, rate: float = 0.05, seed: int = 42, most_rows: int = TRAIN_ROWS) -> BoostedTrees:
    """Boosted trees with row and column sampling and weighted positives, fitted on at most ``most_rows`` rows."""
    how = Growth(rounds=rounds, depth=depth, rate=rate, seed=seed)
    return fit_boosted(df, columns, label, ids or ["flow_key", "flow_seq"], how, most_rows)


def feature_importance(model: BoostedTrees, df: DataFrame, top: int = 15) -> DataFrame:
    """The ``top`` largest importances as rows."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(v).alias("importance"))
                     for c, v in model.importances().items()])
    one = df.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")
    return one.orderBy(F.col("importance").desc(), "feature").limit(top)


def flow_verdict(probability: Column, protocol: Column) -> Column:
    """MALICIOUS from one half up, BENIGN below, ARP for ARP flows, UNKNOWN when there is no score."""
    return (
        F.when(protocol == "ARP", "ARP").when(probability.isNull() | F.isnan(probability), "UNKNOWN")
        .when(probability >= 0.5, "MALICIOUS").otherwise("BENIGN")
    )


def score_flows(model: BoostedTrees, flows: DataFrame) -> DataFrame:
    """Label flows; a missing or NaN feature counts as 0."""
    features = [F.col(c) if c in flows.columns else F.lit(0.0) for c in model.columns]
    scored = flows.withColumn("probability", model.probability(*features))
    return scored.withColumn("label", flow_verdict(F.col("probability"), F.col("protocol")))
