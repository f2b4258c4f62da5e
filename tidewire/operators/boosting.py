"""Gradient-boosted trees on histograms of binned features.

Features are cut at quantiles into at most ``BINS`` bins once; from then on a row is one byte per feature. Trees grow level
by level: per node and bin the slopes of the logistic loss are summed, the better half of a pair of nodes is the parent less
its sibling, and the best cut by gain splits a node. What a labelled row adds to a fit soon vanishes, so the fit takes at most
``most_rows`` labelled rows, picked by the hash of their id (all of them below that bound): a few bytes a row, held by
one task. The rounds are divided into blocks; after each the trees and the margins of the rows are written to the shared
folder, so a lost executor costs one block. Scoring runs over all rows in Arrow batches, wherever they are.

A fitted model is a small table of nodes that can be stored, read again and broadcast: its size is bounded by rounds
and depth."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewire.operators.ml_prep import bounded_sample, class_weight, order_hash
from tidewire.session import materialize

#: Labelled rows that a fit looks at; bins per feature; rounds between two writes; quantile sketch.
TRAIN_ROWS, BINS, ROUNDS_AT_ONCE, SKETCH = 200_000, 256, 100, 20_000
ROWS_PER_NODE = 64
NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, value double, gain double"


@dataclass
class Growth:
    """How trees grow. ``rows`` and ``columns``: shares drawn for each tree; ``shrink``: weight of the squared leaf values;
    ``least``: curvature that a node must hold."""

    rounds: int = 600
    depth: int = 8
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    shrink: float = 1.0
    least: float = 1.0
    seed: int = 42


def _histogram(codes: np.ndarray, slot: np.ndarray, slopes: np.ndarray, n_slots: int) -> np.ndarray:
    """Sums of both slopes per (slot, feature, bin): ``codes`` has one row per feature."""
    out = np.empty((2, n_slots, len(codes), BINS))
    base = slot * BINS
    for f, code in enumerate(codes):
        at = base + code
        for k in range(2):
            out[k, :, f] = np.bincount(at, slopes[k], n_slots * BINS).reshape(n_slots, BINS)
    return out


def grow_tree(codes: np.ndarray, slopes: np.ndarray, how: Growth) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (feature, bin, left, right, value, gain) and the leaf of each row.

    ``codes``: one row per feature; ``slopes``: first and second slope of the loss per row."""
    n = codes.shape[1]
    nodes: list[list[float]] = [[-1, 0, -1, -1, 0.0, 0.0]]
    leaf = np.zeros(n, np.int64)
    rows, slot, ids = np.arange(n), np.zeros(n, np.int64), [0]
    sums = _histogram(codes, slot, slopes, 1)
    for depth in range(how.depth + 1):
        total = sums[:, :, 0].sum(2)
        for i, node in enumerate(ids):
            nodes[node][4] = -how.rate * total[0, i] / (total[1, i] + how.shrink)
        if depth == how.depth:
            break
        low = sums.cumsum(3)[..., :-1]
        high = total[:, :, None, None] - low
        gain = (low[0] ** 2 / (low[1] + how.shrink) + high[0] ** 2 / (high[1] + how.shrink)
                - (total[0] ** 2 / (total[1] + how.shrink))[:, None, None])
        gain[(low[1] < how.least) | (high[1] < how.least)] = 0
        flat = gain.reshape(len(ids), -1)
        best = flat.argmax(1)
        worth = flat[np.arange(len(ids)), best] > 1e-9
        if not worth.any():
            break
        feature, cut = best // (BINS - 1), best % (BINS - 1)
        child, new_ids = np.full(len(ids), -1), []
        for i in np.flatnonzero(worth).tolist():
            child[i] = len(new_ids)
            left = len(nodes)
            nodes[ids[i]][:4] = [int(feature[i]), int(cut[i]), left, left + 1]
            nodes[ids[i]][5] = float(flat[i, best[i]])
            nodes += [[-1, 0, -1, -1, 0.0, 0.0], [-1, 0, -1, -1, 0.0, 0.0]]
            new_ids += [left, left + 1]
        inside = worth[slot]
        rows, slot = rows[inside], slot[inside]
        slot = child[slot] + (codes[feature[slot], rows] > cut[slot])
        leaf[rows] = np.asarray(new_ids)[slot]
        if depth + 1 < how.depth:
            parents = np.flatnonzero(worth)
            sizes = np.bincount(slot, minlength=len(new_ids)).reshape(-1, 2)
            small = sizes.argmin(1)
            mine = slot % 2 == small[slot // 2]
            part = _histogram(codes[:, rows[mine]], slot[mine] // 2, slopes[:, rows[mine]], len(parents))
            rest = sums[:, parents] - part
            sums = np.empty((2, len(new_ids), *part.shape[2:]))
            sums[:, 2 * np.arange(len(parents)) + small] = part
            sums[:, 2 * np.arange(len(parents)) + 1 - small] = rest
        else:  # the last level needs totals only
            sums = np.zeros((2, len(new_ids), 1, 1))
            for k in range(2):
                sums[k, :, 0, 0] = np.bincount(slot, slopes[k, rows], len(new_ids))
        ids = new_ids
    return np.array(nodes), leaf


def boost(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, margin: np.ndarray, rounds: range, how: Growth
          ) -> Iterator[tuple[int, np.ndarray]]:
    """Trees of the given rounds; ``margin`` is moved on in place. A round depends on its number and the margins only."""
    n_features, n = codes.shape
    for turn in rounds:
        rng = np.random.default_rng([how.seed, turn])
        p = 1 / (1 + np.exp(-margin))
        slopes = np.stack([weight * (p - y), weight * p * (1 - p)])
        taken = rng.random(n) < how.rows
        drawn, rest = np.flatnonzero(taken), np.flatnonzero(~taken)
        features = np.sort(rng.choice(n_features, max(1, round(how.columns * n_features)), replace=False))
        nodes, leaf = grow_tree(codes[features].take(drawn, axis=1), slopes[:, drawn], how)
        inner = nodes[:, 0] >= 0
        nodes[inner, 0] = features[nodes[inner, 0].astype(int)]
        # The leaf of a drawn row is known from the growth.
        margin[drawn] += nodes[leaf, 4]
        margin[rest] += nodes[_walk(nodes, lambda f, at: codes[f, rest], len(rest)), 4]
        yield turn, nodes


def _walk(nodes: np.ndarray, value, n: int) -> np.ndarray:
    """Leaf of each of ``n`` rows; ``value(features, rows)`` gives what is compared with the cuts."""
    at = np.zeros(n, np.int64)
    feature, cut, left = nodes[:, 0].astype(np.int64), nodes[:, 1], nodes[:, 2].astype(np.int64)
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return at
        at = np.where(inner, left[at] + (value(np.maximum(f, 0), at) > cut[at]), at)


def _add_leaves(nodes: np.ndarray, columns: np.ndarray, margin: np.ndarray) -> None:
    """Adds to ``margin`` the leaf value of each row; ``columns``: one line per feature.

    Where a tree has few nodes for its rows, they are parted node by node, which reads each value once."""
    if len(nodes) * ROWS_PER_NODE > len(margin):
        each = np.arange(len(margin))
        margin += nodes[_walk(nodes, lambda f, at: columns[f, each], len(margin)), 4]
        return
    todo = [(0, np.arange(len(margin)))]
    while todo:
        at, rows = todo.pop()
        feature, cut, left, _, value = nodes[at, :5].tolist()
        if feature < 0:
            margin[rows] += value
            continue
        above = columns[int(feature)].take(rows) > cut
        for child, side in ((int(left), rows[~above]), (int(left) + 1, rows[above])):
            if len(side):
                todo.append((child, side))


@dataclass
class BoostedTrees:
    """Trees as arrays (feature, cut, left, right, value, gain): a row goes left if its value is not above the cut."""

    columns: list[str]
    trees: list[np.ndarray]

    def probability(self, *features: Column) -> Column:
        """Probability of label 1, from the features in the order of ``columns``; null or NaN counts as 0."""
        spark = SparkSession.getActiveSession()
        trees = spark.sparkContext.broadcast(self.trees)  # bounded by rounds and depth

        @F.pandas_udf("double")
        def score(rows: pd.Series) -> pd.Series:
            margin = np.zeros(len(rows))
            if len(rows):
                x = np.nan_to_num(np.vstack(rows.to_list()).astype(float), nan=0.0, posinf=np.inf, neginf=-np.inf)
                columns = np.ascontiguousarray(x.T)
                for nodes in trees.value:
                    _add_leaves(nodes, columns, margin)
            return pd.Series(1 / (1 + np.exp(-margin)))

        return score(F.array(*[F.coalesce(f.try_cast("double"), F.lit(0.0)) for f in features]))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, i, int(n[0]), float(n[1]), int(n[2]), int(n[3]), float(n[4]), float(n[5]))
                for t, tree in enumerate(self.trees) for i, n in enumerate(tree)]
        return spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")]), NODE_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        names = spark.createDataFrame([(i, c) for i, c in enumerate(self.columns)], "feature int, name string")
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        names.coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        columns = [r["name"] for r in spark.read.parquet(f"{path}/columns").orderBy("feature").collect()]
        nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes").toPandas()
        return cls(columns, [t[["feature", "cut", "left", "right", "value", "gain"]].to_numpy(float)
                             for _, t in nodes.sort_values(["tree", "node"]).groupby("tree")])

    def importances(self) -> dict[str, float]:
        """Mean gain of the cuts on each feature, as shares of one."""
        inner = np.concatenate([t[t[:, 0] >= 0] for t in self.trees]) if self.trees else np.empty((0, 6))
        feature = inner[:, 0].astype(int)
        count = np.bincount(feature, minlength=len(self.columns))
        mean = np.bincount(feature, inner[:, 5], len(self.columns)) / np.maximum(count, 1)
        return dict(zip(self.columns, (mean / (mean.sum() or 1)).tolist()))


def bin_edges(df: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """Per feature at most ``BINS - 1`` values of the rows that cut them into bins of like size."""
    marks = [i / BINS for i in range(1, BINS)]
    row = df.agg(*[F.percentile_approx(F.col(c), marks, SKETCH).alias(f"e{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.array(row[i] or [0.0], float)) for i in range(len(columns))]


def fit_boosted(df: DataFrame, columns: list[str], label: str, ids: list[str], how: Growth | None = None,
                most_rows: int = TRAIN_ROWS) -> BoostedTrees:
    """Fit on at most ``most_rows`` rows; positives weigh the ratio of negatives to positives of all rows."""
    how = how or Growth()
    features = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)]
    rows = class_weight(df.where(F.col(label).isNotNull()), label).select(
        *ids, F.col(label).cast("double").alias("y"), F.col("weight").cast("double").alias("weight"), *features)
    names = [f"x{i}" for i in range(len(columns))]
    sample = materialize(bounded_sample(rows, ids, most_rows, how.seed).select(
        "y", "weight", *names, order_hash(*ids, seed=how.seed).alias("h")), "boost-rows")
    edges = bin_edges(sample, names)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.searchsorted(e, batch.column(f"x{i}").to_numpy()).astype(np.uint8) for i, e in enumerate(edges)], 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("y"), batch.column("weight"), pa.array([r.tobytes() for r in x], pa.binary()),
                 pa.array(np.zeros(len(x)))], ["h", "y", "weight", "codes", "margin"])

    layout = "h string, y double, weight double, codes binary, margin double"
    nothing = ", ".join(["h string", "y double", "weight double", "codes binary", "margin double", NODE_SCHEMA])
    state = materialize(sample.mapInArrow(code, layout), "boost-state")
    fields = [f.split() for f in NODE_SCHEMA.split(", ")]
    kinds = {"int": pa.int32(), "double": pa.float64()}
    trees: list[np.ndarray] = []
    for begin in range(0, how.rounds, ROUNDS_AT_ONCE):
        block = range(begin, min(how.rounds, begin + ROUNDS_AT_ONCE))

        def advance(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held)
            n = table.num_rows
            codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(n, len(columns)).T.copy()
            margin = table["margin"].to_numpy().copy()
            grown = []
            for turn, nodes in boost(codes, table["y"].to_numpy(), table["weight"].to_numpy(), margin, block, how):
                grown.append(np.column_stack([np.full(len(nodes), turn), np.arange(len(nodes)), nodes]))
            nodes = np.concatenate(grown)
            m = len(nodes)
            yield pa.RecordBatch.from_arrays(
                [*(table[c].combine_chunks() for c in ("h", "y", "weight", "codes")), pa.array(margin),
                 *(pa.nulls(n, kinds[k]) for _, k in fields)], names=[*table.schema.names, *(c for c, _ in fields)])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.string()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.binary()),
                 pa.nulls(m, pa.float64()), *(pa.array(nodes[:, i]).cast(kinds[k]) for i, (_, k) in enumerate(fields))],
                names=[*table.schema.names, *(c for c, _ in fields)])

        # Bounded rows in one task, in a fixed order, so that draws of rows are the same on every run.
        done = materialize(state.repartition(1).sortWithinPartitions("h", "codes", "y").mapInArrow(advance, nothing), "boost-state")
        state = done.where("tree IS NULL").select("h", "y", "weight", "codes", "margin")
        grown = done.where("tree IS NOT NULL").select(*[c for c, _ in fields]).toPandas()  # nodes of one block
        for _, t in grown.sort_values(["tree", "node"]).groupby("tree"):
            tree = t[["feature", "cut", "left", "right", "value", "gain"]].to_numpy(float)
            inner = tree[:, 0] >= 0
            # Bin k holds values up to edge k.
            tree[inner, 1] = [edges[int(f)][min(int(b), len(edges[int(f)]) - 1)] for f, b in tree[inner, :2]]
            trees.append(tree)
    return BoostedTrees(list(columns), trees)
