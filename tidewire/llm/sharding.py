"""Resharding by minimum-cost flow (operator 1).

The present shards offer their bytes, the new shards ask for their capacities, and a flow of least cost
between them says how many bytes go from where to where; bytes that stay cost nothing, so as few as
possible move. The flow has one amount per pair of shards and is solved on the driver from one row per shard.

Documents are then dealt to the flows. Inside an old shard they are placed on a line by running sums of sizes
and the line is cut at the amounts. Since a document is not cut, this is done in tiers, large documents
first: each tier's cuts make up for what the whole documents of the tiers before missed or exceeded, so
new sizes differ from their capacities by about one small document.

Defined results: a null text counts as empty; null and repeated ids are rows of their own; an empty table gives an
empty result; extra columns are carried along, but for those named like a result."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidewire.operators.ordered import sliced_rank, sliced_running_sum
from tidewire.session import materialize

OVERHEAD = 16
TIER_SHARES = (0.9, 0.5)  # large: above the first quantile of sizes; small: up to the last
SLICE_ROWS = 4000


def moved(old: int, new: int) -> float:
    """Cost of a byte that goes from one shard to another: none if it stays."""
    return float(old != new)


def least_cost_flow(supply: list[int], demand: list[int], cost: Callable[[int, int], float] = moved) -> np.ndarray:
    """Amounts from each supply to each demand (equal sums) of least total cost.

    Successive cheapest paths in the residual graph; the graph has a node per shard and nothing per document."""
    m, n = len(supply), len(demand)
    price = np.array([[cost(i, j) for j in range(n)] for i in range(m)], float).reshape(m, n)
    flow = np.zeros((m, n), np.int64)
    left, need = np.array(supply, np.int64), np.array(demand, np.int64)
    while left.any():
        to_old, to_new = np.where(left > 0, 0.0, np.inf), np.full(n, np.inf)
        from_old, from_new = np.full(n, -1), np.full(m, -1)
        for _ in range(m + n):  # shortest paths by rounds over all arcs
            offer = to_old[:, None] + price
            best = offer.argmin(0)
            nearer = offer[best, np.arange(n)] < to_new - 1e-12
            to_new[nearer], from_old[nearer] = offer[best, np.arange(n)][nearer], best[nearer]
            back = np.where(flow > 0, to_new[None, :] - price, np.inf)
            best = back.argmin(1)
            closer = back[np.arange(m), best] < to_old - 1e-12
            to_old[closer], from_new[closer] = back[np.arange(m), best][closer], best[closer]
            if not closer.any():
                break
        j = int(np.where(need > 0, to_new, np.inf).argmin())
        path, amount = [], int(need[j])
        while True:
            i = int(from_old[j])
            path.append((i, j, 1))
            if from_new[i] < 0:
                amount = min(amount, int(left[i]))
                break
            j = int(from_new[i])
            path.append((i, j, -1))
            amount = min(amount, int(flow[i, j]))
        for i, j, way in path:
            flow[i, j] += way * amount
        left[path[-1][0]] -= amount
        need[path[0][1]] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def present_shard(row_id: Column, shards: int) -> Column:
    """The layout before: by hash of the id."""
    return F.pmod(F.xxhash64(row_id), F.lit(shards)).cast("int")


def _cut(flows: list[dict[int, float]], have: dict[int, int]) -> dict[int, list[tuple[float, float, int]]]:
    """Cuts of each old shard's line of ``have`` bytes in proportion to what its flows still want."""
    out = {}
    for i, wants in enumerate(flows):
        positive = {j: w for j, w in wants.items() if w > 0} or {j: 1.0 for j in wants}
        scale, at, cuts = have.get(i, 0) / sum(positive.values()) if positive else 0.0, 0.0, []
        for j, w in positive.items():
            cuts.append((at, at + w * scale, j))
            at += w * scale
        if cuts:
            cuts[-1] = (cuts[-1][0], float("inf"), cuts[-1][2])
            out[i] = cuts
    return out


def reshard(rows: DataFrame, size: str, old: str, capacities: Callable[[int], list[int]], row_id: str = "doc_id",
            old_shards: int = 32, cost: Callable[[int, int], float] = moved) -> DataFrame:
    """``rows`` with ``shard`` (the new one), ``slot`` (gapless from 0 in it) and ``block`` (a file's worth of an old
    shard). ``capacities`` gives the new shards' bytes from the bytes of all; they are scaled to sum up to it."""
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot", "block")
    names = rows.columns
    rows = materialize(rows.withColumn("__big", F.floor(F.log2(F.greatest(F.col(size), F.lit(1)))).cast("int")), "reshard")
    facts = rows.groupBy(F.col(old).alias("i")).agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    supply = [0] * old_shards  # one row per old shard
    for fact in facts:
        supply[fact["i"]] = fact["s"]
    n_rows, total = sum(f["n"] for f in facts), sum(supply)
    wanted = capacities(total)
    ends = [round(total * c) for c in np.cumsum(wanted) / max(1, sum(wanted))] if sum(wanted) != total else list(
        np.cumsum(np.array(wanted, dtype=object)))
    wanted = [int(b - a) for a, b in zip([0, *ends], ends)]
    flow = least_cost_flow(supply, wanted, cost)
    # A shard's own part first: the largest documents of a tier stay where they are.
    left = [{j: float(flow[i, j]) for j in sorted(np.flatnonzero(flow[i]).tolist(), key=lambda j: (j != i, j))}
            for i in range(old_shards)]
    levels = rows.select(F.percentile_approx(size, list(TIER_SHARES), 1000)).first()[0] or [0] * len(TIER_SHARES)
    tier = F.lit(len(TIER_SHARES))
    for k in reversed(range(len(levels))):
        tier = F.when(F.col(size) > levels[k], k).otherwise(tier)
    slices = max(1, n_rows // (SLICE_ROWS * max(1, len(facts))))
    line = rows.withColumns({
        "__tier": tier, "__slice": (64 - F.col("__big")) * slices + F.pmod(F.xxhash64(row_id, F.lit(3)), F.lit(slices))})
    line = materialize(sliced_running_sum(line, [old, "__tier"], "__slice", [F.xxhash64(row_id, F.lit(5)), row_id, size],
                                          {"__at": size}, inclusive=False), "reshard-line")
    bytes_of = {(r["i"], r["t"]): r["s"] for r in line.groupBy(F.col(old).alias("i"), F.col("__tier").alias("t")).agg(
        F.sum(size).alias("s")).collect()}  # old shards times tiers
    placed = None
    for t in range(len(TIER_SHARES) + 1):
        cuts = _cut(left, {i: s for (i, k), s in bytes_of.items() if k == t})
        part = line.where(F.col("__tier") == t)
        kind = "i int, cuts array<struct<lo:double,hi:double,j:int>>"
        table = F.broadcast(spark.createDataFrame(list(cuts.items()), kind))  # a row per old shard
        middle = F.col("__at") + F.col(size) / 2
        part = part.join(table, F.col(old) == F.col("i")).withColumn("shard", F.element_at(F.filter(
            "cuts", lambda c: (c["lo"] <= middle) & (middle < c["hi"])), 1)["j"]).drop("i", "cuts")
        if t < len(TIER_SHARES):
            for r in part.groupBy(F.col(old).alias("i"), F.col("shard").alias("j")).agg(F.sum(size).alias("s")).collect():
                left[r["i"]][r["j"]] -= r["s"]
        placed = part if placed is None else placed.unionByName(part)
    per_shard = max(1, n_rows // (SLICE_ROWS * max(1, len(wanted))))
    placed = placed.withColumn("__part", F.pmod(F.xxhash64(row_id, F.lit(11)), F.lit(per_shard)))
    ranked = sliced_rank(placed, ["shard"], "__part", ["__at", row_id, size], "slot")
    return ranked.select(*[f"`{c}`" for c in names], F.col("shard").cast("int").alias("shard"),
                         F.col("slot").cast("long").alias("slot"),
                         (F.col("__tier") * (1 << 40) + F.col("__slice")).alias("block"))


def place_documents(docs: DataFrame, shards: int = 40, old_shards: int = 32, text: str = "text",
                    row_id: str = "doc_id") -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``old_shard``, ``law``, ``shard``, ``slot``, ``grown_shard``, ``block``."""
    rows = docs.select(F.col(row_id).alias("doc_id"), text_size(F.col(text)).alias("size"),
                       F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
                       present_shard(F.col(row_id), old_shards).alias("old_shard"))
    placed = reshard(rows, "size", "old_shard", lambda total: equal_capacities(total, shards), "doc_id", old_shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "old_shard", "block")


def rewrite_affected(placed: DataFrame, folder: str, generation: int = 1) -> DataFrame:
    """Write only what changed. A block of an old shard is a file's worth of rows: one that keeps all its rows
    is left alone; of the others the rows that stay are written as a new version, and rows that move are
    written into their new shard. Returns ``shard, block, action, n_rows, n_bytes`` of every block."""
    blocks = placed.groupBy("old_shard", "block").agg(F.max((F.col("shard") != F.col("old_shard")).cast("int")).alias("__hit"))
    rows = placed.join(blocks, ["old_shard", "block"])
    action = F.when(F.col("shard") != F.col("old_shard"), "moved").when(F.col("__hit") == 1, "rewritten").otherwise("kept")
    rows = rows.withColumn("action", action).drop("__hit")
    out = rows.where("action <> 'kept'").withColumn("__to", F.col("shard"))
    path = os.path.join(folder, f"generation={generation}")
    out.repartition("__to", "block").write.partitionBy("__to").mode("overwrite").parquet(path)
    return rows.groupBy("shard", "old_shard", "block", "action").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"))
