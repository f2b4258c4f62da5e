"""Mixing sources to target weights (operator 4).

The mix takes ``share`` times the words of all sources. Targets follow the weights; none is above ``most`` times
its source, and what that cuts off goes to the others by weight. Blocks of equal numbers of words are then
apportioned by Sainte-Laguë: shard after shard receives the next highest quotients target / (2k - 1), so every
shard holds whole numbers of blocks of each source, and any first shards are as close to the targets as whole
blocks can be. A block is a small part of the smallest target, so that small sources are met as well beside
very large ones. The documents of a source lie in a seeded order on a ring that is cut into blocks; the
shards take their blocks of the source one after another from a seeded block on.

A block never needs a row of its own: what a run of blocks takes of a document follows from the document's place
on the ring. Quotients are ranked only where they can still change the result: with m sources and N blocks, the
seats that the divisors of N - m and N + m blocks both give are certain, and at most 3m stay open.
Only DataFrame functions are used.

Defined results: a null text has size 0; a null source is a source of its own, last in order; repeated rows
and ids are rows of their own; an empty table gives an empty result; extra columns are carried along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewire.llm.common import WORD
from tidewire.operators.ordered import sliced_running_sum
from tidewire.session import materialize

WEIGHTS = (5, 2, 1)
BLOCKS = 1 << 16  # of the mix at least
LEAST_BLOCKS = 1000  # of the smallest target, down to blocks of a word
SHARDS = 64
SLICE_ROWS = 4000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """``sizes`` (source, source_size) with ``rank`` (from 0 by code point, null last), ``weight`` and ``target``.

    Sources are capped in the order of limit / weight; the first at which the level of the rest lies within
    the limit ends it, so one running sum replaces the rounds of sharing out again."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod("rank", F.lit(len(weights))) + 1))
    listed = listed.withColumn("limit", F.col("source_size") * most)
    filling = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before, here_on = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = ((F.sum("source_size").over(whole) * share - F.coalesce(F.sum("limit").over(before), F.lit(0)))
             / F.sum("weight").over(here_on))
    listed = listed.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level"))
    listed = listed.withColumn("level", F.max(fits).over(whole))  # the first that fits: they fall from there on
    target = F.least(F.col("limit").cast("double"), F.coalesce("level", F.lit(float("inf"))) * F.col("weight"))
    return listed.select("source", "source_size", "rank", "weight", target.alias("target"))


def apportion(targets: DataFrame, blocks: int, shards: int) -> DataFrame:
    """Blocks of each source by highest quotients, shard after shard.

    ``targets`` has ``rank`` and ``target``; returns ``round, rank, held``: the blocks that the first ``round``
    shards hold of a source."""
    every = targets.where("target > 0").withColumns({
        "m": F.count(F.lit(1)).over(Window.partitionBy()), "v": F.sum("target").over(Window.partitionBy())})
    every = every.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    every = every.withColumn("blocks_so_far", F.floor(F.col("round") * blocks / shards))
    n = F.col("blocks_so_far")

    def certain(seats: Column) -> Column:
        return F.when(seats > 0, F.round(F.col("target") * seats / F.col("v"))).otherwise(0).cast("long")

    every = every.withColumn("low", F.greatest(certain(n - F.col("m")) - 1, F.lit(0))).withColumn(
        "high", certain(n + F.col("m")) + 1)
    seats = every.select("round", "rank", "low", "blocks_so_far", "target",
                         F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("seat"))
    open_seats = F.col("blocks_so_far") - F.sum("low").over(Window.partitionBy("round"))
    lows = every.select("round", "rank", "low", open_seats.alias("open"))
    ranked = seats.withColumn("place", F.row_number().over(
        Window.partitionBy("round").orderBy((F.col("target") / (2 * F.col("seat") - 1)).desc(), "rank", "seat")))
    won = ranked.join(lows.select("round", "rank", "open"), ["round", "rank"]).where("place <= open").groupBy(
        "round", "rank").agg(F.count(F.lit(1)).alias("won"))
    return lows.join(won, ["round", "rank"], "left").select(
        "round", "rank", (F.col("low") + F.coalesce("won", F.lit(0))).alias("held"))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", row_id: str = "doc_id",
                weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, blocks: int = BLOCKS,
                shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` (of the source), ``taken`` (words the mix takes, repeats
    counted), ``times`` (how often the mix takes its first word) and ``shard`` (of the first taking; null: none)."""
    # Beside the id the text decides, so that rows without an id, or with one id, do not stand in one place.
    rows = docs.withColumn("__size", word_count(F.col(text))).withColumn("__mix", F.md5(F.concat_ws(
        ":", F.lit(str(seed)), F.col(row_id).cast("string"), F.xxhash64(text).cast("string"))))
    carried = [c for c in docs.columns if c != text and c.lower() not in RESULT]
    light = materialize(rows.select(*[f"`{c}`" for c in carried], "__size", "__mix"), "mix-sizes")
    sizes = light.groupBy(F.col(source).alias("source")).agg(
        F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    facts = sizes.agg(F.sum("source_size"), F.sum("__rows")).first()  # one row
    total, n_rows = facts[0] or 0, facts[1] or 0
    targets = materialize(source_targets(sizes.drop("__rows"), weights, share, most), "mix-targets")
    least = targets.where("target > 0").agg(F.min("target")).first()[0] or 0  # one row
    block = max(1, min(round(total * share / blocks), int(least) // LEAST_BLOCKS))
    n_blocks = round(total * share / block)
    quotas = apportion(targets, n_blocks, shards)
    ring = F.ceil(F.col("source_size") / block)
    start = F.pmod(F.xxhash64("rank", F.lit(seed)), F.greatest(ring, F.lit(1)))
    held = quotas.groupBy("rank").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("round", "held"))), lambda q: q["held"]).alias("held"))
    plan = targets.join(held, "rank", "left").select(
        F.col("source").alias("__source"), F.col("rank").alias("__rank"), F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"), start.alias("__start"),
        ring.cast("long").alias("__ring"), F.coalesce("held", F.array().cast("array<bigint>")).alias("__held"))
    plan = materialize(plan, "mix-plan")

    slices = max(1, n_rows // SLICE_ROWS)
    with_plan = light.join(plan, F.col(f"`{source}`").eqNullSafe(F.col("__source"))).drop("__source")
    placed = sliced_running_sum(
        with_plan.withColumn("__slice", F.floor(F.conv(F.left("__mix", F.lit(8)), 16, 10).cast("long") * slices / (1 << 32))),
        ["__rank"], "__slice", ["__mix", f"`{row_id}`", "__size"], {"__end": "__size"})
    first = F.col("__end") - F.col("__size")

    def words_before(b: Column) -> Column:
        """Words on the ring, laps included, before block number ``b``."""
        lap = F.floor(b / F.col("__ring"))
        return lap * F.col("__source_size") + F.least((b - lap * F.col("__ring")) * block, F.col("__source_size"))

    def of_document(words: Column, at: Column, n: Column | int) -> Column:
        """How many of the first ``words`` words of the unrolled ring fall on [at, at + n)."""
        lap = F.floor(words / F.col("__source_size"))
        rest = words - lap * F.col("__source_size") - at
        return lap * n + F.greatest(F.lit(0), F.least(rest, F.lit(n) if isinstance(n, int) else n))

    last = F.least(F.coalesce(F.element_at(F.col("__held"), -1), F.lit(0)), most * F.col("__ring"))
    some = (F.col("__size") > 0) & (F.size("__held") > 0)
    begin, end = words_before(F.col("__start")), words_before(F.col("__start") + last)

    def over(n: Column | int) -> Column:
        return F.when(some, of_document(end, first, n) - of_document(begin, first, n)).otherwise(0).cast("long")

    # First lap of the run in which the document's first word is taken, and the shard whose blocks hold it.
    at = F.floor(first / block)
    turns = F.when(at >= F.col("__start"), at - F.col("__start")).otherwise(at - F.col("__start") + F.col("__ring"))
    shard = F.when(some & (turns < last), F.size(F.filter("__held", lambda h: h <= turns)))
    return placed.select(*[f"`{c}`" for c in carried], F.col("__size").alias("size"),
                         F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), over(F.col("__size")).alias("taken"), over(1).alias("times"),
                         shard.cast("int").alias("shard"))


RESULT = ("size", "source_size", "target", "taken", "times", "shard")


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", row_id: str = "doc_id",
                  **how) -> DataFrame:
    """The rows of the mix: each document as often as the mix takes its first word, whole; the columns of ``docs``.

    Rows that repeat an id, a source and a text are taken alike."""
    key = ["__key", "__key2"]
    keyed = docs.withColumns({"__key": F.xxhash64(row_id, source, text), "__key2": F.xxhash64(text, source, row_id, F.lit(1))})
    mixed = mix_sources(keyed.select(f"`{row_id}`", f"`{source}`", f"`{text}`", *key), text, source, row_id, **how)
    times = mixed.where("times > 0").groupBy(*key).agg(F.max("times").alias("__times"))
    return keyed.join(times, key).withColumn(
        "__turn", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[f"`{c}`" for c in docs.columns])
