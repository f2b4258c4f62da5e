"""Prefix trie of conversations by count-min screening (operator 13).

A node of depth d is a distinct sequence of first d turns (role, text); the root (d = 0) has no turn. Members of a node
are the conversations that start with it.

A turn is 128 bits of its content. The digest of a prefix is the exclusive or of two 64-bit hashes of each (position,
turn), so a prefix of any length is a running aggregate: positions and digests are computed per slice of a conversation
and stitched with one small row per slice; no conversation is held as a whole. Texts never move.

Every prefix is counted in a count-min sketch of two rows of saturating cells (none, one, more). An estimate of one
proves that a prefix has one member; then all longer prefixes of that conversation have only that member too, and the
whole tail is emitted where it is, without a shuffle of its rows. Only prefixes before that depth are grouped exactly.
What the sketch cannot tell apart is grouped with the rest: its size costs speed, never correctness. Its width follows
the number of prefixes up to ``MOST_CELLS`` cells a row; what leaves the cluster for the driver and is broadcast is one
bit a cell, 16 MB at most.

Each conversation owns the nodes whose smallest member it is: a stretch from some depth to its end. Sums over subtrees
are running sums along that stretch, plus the total of the stretch for the prefixes above it, added up by digest.
Members that end in a node are hashed in order of their ids, in pieces of ``ID_SLICE`` ids, as a stream.

Defined results: turns are ordered by turn (null first), then by the content's digest; a null role or text is empty;
repeated rows are turns of their own; rows without a conversation id belong to no conversation and are left out; an empty
table has no node; a conversation may have no turn (after a rewrite): it is a member of the root only; extra columns are
not carried, whatever their names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewire.llm.common import mix
from tidewire.operators.ordered import sliced_rank, sliced_running_sum
from tidewire.session import materialize

#: Turns of a conversation that are put in order at once; ids of one piece of a list of members.
TURN_SLICE, ID_SLICE = 1024, 4096
#: Cells a prefix, most cells and cells of a block, for each of the two rows of the sketch.
CELLS_A_PREFIX, MOST_CELLS, BLOCK = 8, 1 << 26, 1 << 15
FIRST_TURN = -(1 << 62)
NODE = ["a", "b", "depth"]


def _turn_digest() -> Column:
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place`` (from 0), ``digest`` and ``chars`` of every turn."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(FIRST_TURN)).alias("turn"),
        _turn_digest().alias("digest"), F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("chars"))
    turns = turns.withColumn("slice", F.floor(F.col("turn") / TURN_SLICE))
    return sliced_rank(turns, ["conv_id"], "slice", ["turn", "digest"], "place").select(
        "conv_id", "place", "digest", "chars")


def share_first_turns(turns: DataFrame) -> DataFrame:
    """Conversation c starts with the first h turns of conversation c - c % 100, then its own after its first h.

    h = crc32 of the decimal id, modulo 6. Every conversation stays, if need be with no turn: ``place`` is then null."""
    shared = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("long")
    leader = F.col("conv_id") - F.col("conv_id") % 100
    heads = (turns.where((F.col("conv_id") % 100 == 0) & (F.col("place") < 5))
             .groupBy(F.col("conv_id").alias("leader"))
             .agg(F.array_sort(F.collect_list(F.struct("place", "digest", "chars"))).alias("head")))
    convs = (turns.select("conv_id").distinct()
             .select("conv_id", shared.alias("h"), leader.alias("leader"))
             .join(heads, "leader", "left")
             .select("conv_id", "h", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int")).alias("head")))
    own = turns.withColumn("h", shared).where("place >= h").join(
        convs.select("conv_id", F.size("head").alias("k")), "conv_id").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("k")).alias("place"), "digest", "chars")
    return own.unionByName(convs.select("conv_id", F.inline_outer("head")))


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth``, the digests ``a, b`` of the prefix and ``up_a, up_b`` of the one above, and ``chars``.

    The row of depth 0 is there for every conversation; written once."""
    placed = turns.where("place IS NOT NULL").select(
        "conv_id", (F.col("place") + 1).alias("depth"), "chars",
        F.xxhash64("place", "digest").alias("x"), F.xxhash64("digest", "place", F.lit(7)).alias("y"),
        F.floor(F.col("place") / TURN_SLICE).alias("slice"))
    totals = placed.groupBy("conv_id", "slice").agg(F.bit_xor("x").alias("tx"), F.bit_xor("y").alias("ty"))
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "slice", F.coalesce(F.bit_xor("tx").over(before), F.lit(0)).alias("ox"),
                           F.coalesce(F.bit_xor("ty").over(before), F.lit(0)).alias("oy"))
    local = Window.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.select("*", F.bit_xor("x").over(local).alias("rx"), F.bit_xor("y").over(local).alias("ry"))
    rows = running.join(totals, ["conv_id", "slice"]).select(
        "conv_id", "depth", F.expr("rx ^ ox").alias("a"), F.expr("ry ^ oy").alias("b"),
        F.expr("rx ^ ox ^ x").alias("up_a"), F.expr("ry ^ oy ^ y").alias("up_b"), "chars")
    zero = F.lit(0).cast("long")
    roots = turns.select("conv_id").distinct().select(
        "conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("up_a"), zero.alias("up_b"), zero.alias("chars"))
    return materialize(rows.unionByName(roots), "prefixes")


def _cells(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Cell of each prefix in both rows of the sketch; the second row follows the first."""
    keys = np.stack([mix(a.view(np.uint64)), mix(b.view(np.uint64))])
    return (keys & np.uint64(width - 1)).astype(np.int64) + np.array([[0], [width]])


def sketch(rows: DataFrame, width: int) -> np.ndarray:
    """One bit a cell: set where more than one prefix was counted."""
    block = min(BLOCK, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, more = (np.zeros(2 * width, bool) for _ in range(2))
        for batch in batches:
            for cells in _cells(batch.column("a").to_numpy(), batch.column("b").to_numpy(), width):
                cells, times = np.unique(cells, return_counts=True)
                more[cells[(times > 1) | one[cells]]] = True
                one[cells] = True
        for k in np.flatnonzero(one.reshape(-1, block).any(axis=1)).tolist():
            part = slice(k * block, (k + 1) * block)
            yield pa.RecordBatch.from_pydict({"block": [k], "one": [np.packbits(one[part]).tobytes()],
                                              "more": [np.packbits(more[part]).tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: dict[int, np.ndarray] = {}
        more: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x, y in zip(*(batch.column(c).to_pylist() for c in ("block", "one", "more"))):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                more[k] = more[k] | y | (one[k] & x) if k in one else y
                one[k] = one[k] | x if k in one else x
        for k, bits in more.items():
            if bits.any():
                yield pa.RecordBatch.from_pydict({"block": [k], "more": [bits.tobytes()]})

    blocks = (rows.select("a", "b").mapInArrow(count, "block long, one binary, more binary")
              .repartition("block").mapInArrow(merge, "block long, more binary").collect())
    out = np.zeros((2 * width // block, block // 8), np.uint8)
    for row in blocks:
        out[row.block] = np.frombuffer(row.more, np.uint8)
    return out.reshape(-1)


def screen(rows: DataFrame) -> DataFrame:
    """Add ``alone``: the estimate of the prefix is one. False says nothing."""
    deep = rows.where("depth > 0")
    width = 1 << max(3, min(MOST_CELLS, CELLS_A_PREFIX * max(1, deep.count())).bit_length() - 1)
    bits = rows.sparkSession.sparkContext.broadcast(sketch(deep, width))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _cells(batch.column("a").to_numpy(), batch.column("b").to_numpy(), width)
            crowded = (bits.value[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1
            alone = (crowded.min(axis=0) == 0) & (batch.column("depth").to_numpy() > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone)], [*batch.schema.names, "alone"])

    return rows.mapInArrow(estimate, ", ".join(f"{c} long" for c in rows.columns) + ", alone boolean")


def _ends(shared: DataFrame) -> DataFrame:
    """``a, b, depth, ends_sha256``: members that have no further turn, by id, for nodes that have such."""
    pieces = (shared.where("is_end").groupBy(*NODE, F.floor(F.col("conv_id") / ID_SLICE).alias("piece"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if key == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip([*NODE, "ends_sha256"], map(list, zip(*done)))))
        if node is not None:
            yield pa.RecordBatch.from_pydict({**{c: [v] for c, v in zip(NODE, node)}, "ends_sha256": [state.hexdigest()]})

    return (pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids")
            .mapInArrow(digest, "a long, b long, depth long, ends_sha256 string"))


def trie(turns: DataFrame) -> DataFrame:
    """All nodes of the trie over ``turns`` (conv_id, place, digest, chars; place null: a conversation without turns).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (over the subtree: members but one, times characters of the last text), ``ends_sha256``."""
    rows = prefixes(turns)
    screened = screen(rows)
    facts = screened.groupBy("conv_id").agg(
        F.max("depth").alias("last"), F.min(F.when(F.col("alone"), F.col("depth"))).alias("single"))
    facts = materialize(facts.select("conv_id", "last", F.coalesce("single", F.col("last") + 1).alias("single")), "screen")

    # Tails: every node is its conversation's own, nothing is grouped. The first one hangs on a node of the exact part.
    known = rows.join(facts, "conv_id")
    nothing = F.sha2(F.lit(""), 256)
    tails = known.where("depth >= single").select(
        "conv_id", "depth", "a", "b", "up_a", "up_b", (F.col("depth") == F.col("single")).alias("first"),
        F.lit(1).cast("long").alias("n_convs"), F.when(F.col("depth") < F.col("last"), 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("depth") == F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"))

    shared = materialize(known.where("depth < single").select(
        "conv_id", "depth", "a", "b", "up_a", "up_b", "chars", (F.col("depth") == F.col("last")).alias("is_end"),
        (F.col("single") <= F.col("last")).alias("has_tail"),
        ((F.col("depth") + 1 == F.col("single")) & (F.col("single") <= F.col("last"))).alias("tail_here")), "shared")
    groups = materialize(shared.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"),
        F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"),
        F.sum(F.col("has_tail").cast("long")).alias("tail_leaves"), F.sum(F.col("tail_here").cast("long")).alias("tail_children")), "nodes")
    children = groups.where("depth > 0").groupBy(
        F.col("up_a").alias("a"), F.col("up_b").alias("b"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n"))
    nodes = groups.join(children, NODE, "left").withColumn("n_children", F.col("tail_children") + F.coalesce("n", F.lit(0)))
    nodes = materialize(nodes.select(
        *NODE, "up_a", "up_b", "conv_id", "n_convs", "n_children", "tail_leaves",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "nodes")

    # Along the stretch that a conversation owns: sums from a node to the end of the stretch.
    stretch = nodes.select("conv_id", *NODE, "leaf", "saved", F.floor(F.col("depth") / TURN_SLICE).alias("slice"))
    totals = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.sum("leaf").alias("all_leaves"), F.sum("saved").alias("all_saved"))
    own = (sliced_running_sum(stretch, ["conv_id"], "slice", ["depth"], {"leaves_above": "leaf", "saved_above": "saved"}, inclusive=False)
           .join(totals, "conv_id")
           .select(*NODE, (F.col("all_leaves") - F.col("leaves_above")).alias("leaves"),
                   (F.col("all_saved") - F.col("saved_above")).alias("saved")))
    above = (shared.select("conv_id", *NODE).join(totals.where("all_leaves > 0 OR all_saved > 0"), "conv_id").where("depth < top")
             .select(*NODE, F.col("all_leaves").alias("leaves"), F.col("all_saved").alias("saved")))
    subtree = own.unionByName(above).groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved_tokens"))

    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("depth").alias("up_depth"),
                           F.col("conv_id").alias("parent_conv_id"))
    exact = (nodes.drop("saved").join(subtree, NODE).join(_ends(shared), NODE, "left")
             .withColumn("n_leaves", F.col("tail_leaves") + F.col("leaves"))
             .withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    hanging = exact.select("conv_id", "depth", "up_a", "up_b", *columns[3:]).unionByName(
        tails.where("first").select("conv_id", "depth", "up_a", "up_b", *columns[3:]))
    hung = hanging.withColumn("up_depth", F.col("depth") - 1).join(parents, ["up_a", "up_b", "up_depth"], "left")
    return hung.select(*columns).unionByName(
        tails.where("NOT first").withColumn("parent_conv_id", F.col("conv_id")).select(*columns))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    return trie(ordered_turns(conversations))
