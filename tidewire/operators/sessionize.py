"""Packets to flows.

A flow is a run of packets of one two-way key. It ends when the next packet of
the key comes ``idle`` or more after the last one, or ``max_age`` or more after
the first one, or when a TCP close (RST, or a FIN handshake answered from both
sides) is seen while all packets of the flow lie in one millisecond. A longer
TCP flow stays live after its close marks; that is how the stored data reads.
The last flow of a key ends with the input.

How it scales. No step sorts or holds a whole key:

1. Packets are counted up per (key, millisecond) before any shuffle. These
   *ticks* carry all sums the flow features need, so packets are never moved.
2. Idle breaks: a window per (key, time slice). Ticks near the end of a slice
   are copied into the next one, so each break is seen inside one slice.
3. Ticks shrink to one *fragment* per slice and session; only fragments meet per
   key. Sessions that cannot break inside are flows already.
4. The other sessions (older than ``max_age``, or with a close in their first
   millisecond) need a walk, because every start depends on the one before.
   Sessions are cut into blocks of ``BLOCK_TICKS`` ticks. What a block does to the
   live flow is a monotone step function: from the start of the flow that
   enters (or none) to the start of the flow that leaves. Functions of
   neighbours are composed in pairs, level by level, then entries are handed
   down the same tree, and all blocks are walked in parallel with their entry
   known. A flow that enters began within one age before the block, so a
   function, of a block or of any number of them, has at most as many steps as
   there are ticks within one age.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewire.functions.keys import flow_key_bilateral, flow_key_directed
from tidewire.operators.ordered import sliced_rank, sliced_running_sum
from tidewire.session import materialize

IDLE, AGE, RST, FIN, DONE = (
    "Inactivity Timeout", "Max Age Exceeded", "TCP RST", "TCP FIN", "PCAP_DONE")

#: Ticks of a session that one array holds and one call walks.
BLOCK_TICKS = 65_536
#: No live flow.
NONE = -(1 << 62)
#: Packets of a key that ``assign_packets`` sorts at once, about.
PACKETS_AT_ONCE = 500_000

# Protocol classes as small numbers: limits are looked up without taking the key text apart.
CLASSES = {"TCP": 0, "UDP": 1, "OTHER": 2}


def class_of(protocol: Column) -> Column:
    """The class depends on the protocol's name."""
    return (F.when(protocol == "TCP", CLASSES["TCP"]).when(protocol == "UDP", CLASSES["UDP"])
            .otherwise(CLASSES["OTHER"]))


@dataclass(frozen=True)
class FlowRules:
    """Limits per protocol class. ``slice_ms`` bounds what one task sorts for one key."""

    idle_ms: dict[str, int] = field(default_factory=lambda: {"TCP": 5_000, "UDP": 5_000, "OTHER": 5_000})
    max_age_ms: dict[str, int] = field(
        default_factory=lambda: {"TCP": 300_000, "UDP": 300_000, "OTHER": 300_000})
    slice_ms: int = 60_000

    def __post_init__(self):
        if self.slice_ms < max(self.idle_ms.values()):
            raise ValueError("slice_ms must not be below the idle limit")

    def _by_class(self, limits: dict[str, int], kind: Column) -> Column:
        return (
            F.when(kind == CLASSES["TCP"], F.lit(limits["TCP"]).cast("long"))
            .when(kind == CLASSES["UDP"], F.lit(limits["UDP"]).cast("long"))
            .otherwise(F.lit(limits["OTHER"]).cast("long"))
        )

    def idle(self, kind: Column) -> Column:
        """Idle limit by protocol class (``class_of``)."""
        return self._by_class(self.idle_ms, kind)

    def max_age(self, kind: Column) -> Column:
        return self._by_class(self.max_age_ms, kind)


def key_part(i: int) -> Column:
    return F.split(F.col("flow_key"), "_", 5)[i]


def protocol_of_key() -> Column:
    return key_part(4)

# What a tick adds up, and how ticks add up to fragments and flows.
SUMS = ["n", "bytes", "sumsq", "fwd_n", "fwd_bytes", "syn", "fin", "rst", "ack", "psh", "tcp_n", "udp_n"]
SESSION_COLUMNS = ["flow_key", *SUMS, "min_len", "max_len", "gap_sumsq", "gap_min", "gap_max", "many",
                   "first_ms", "last_ms", "first_code"]


def keyed_packets(packets: DataFrame) -> DataFrame:
    """Packets with ``flow_key``, the direction bit ``fwd`` and ``l4_kind``."""
    if "flow_key" not in packets.columns:
        packets = packets.withColumn("flow_key", flow_key_bilateral())
    if "l4_kind" not in packets.columns:
        packets = packets.withColumn(
            "l4_kind", F.when(F.col("protocol").isin("TCP", "UDP"), F.col("protocol")).otherwise("OTHER"))
    return packets.withColumn("fwd", (flow_key_directed() == F.col("flow_key")).cast("long"))


def _packet_sums() -> list[Column]:
    length = F.col("length").cast("long")
    flags = [F.sum(F.col(f).cast("long")).alias(f) for f in ("syn", "fin", "rst", "ack", "psh")]
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(length).alias("bytes"),
        F.sum(F.col("length").cast("double") * F.col("length")).alias("sumsq"),
        F.sum("fwd").alias("fwd_n"),
        F.sum(F.col("fwd") * length).alias("fwd_bytes"),
        *flags,
        F.sum((F.col("l4_kind") == "TCP").cast("long")).alias("tcp_n"),
        F.sum((F.col("l4_kind") == "UDP").cast("long")).alias("udp_n"),
        F.min(length).alias("min_len"),
        F.max(length).alias("max_len"),
        # First packet and its direction in one number, so that the buffer stays a plain long.
        F.min(F.col("packet_id") * 2 + F.col("fwd")).alias("first_code"),
        F.max("packet_id").alias("last_id"),
    ]


def ticks(packets: DataFrame) -> DataFrame:
    """One row per (flow_key, ts_ms) with the sums of its packets."""
    pure_ack = F.col("ack") & ~F.col("fin")
    two_sided = (
        (F.max(F.when(F.col("fin"), F.col("fwd"))) > F.min(F.when(F.col("fin"), F.col("fwd"))))
        & (F.max(F.when(pure_ack, F.col("fwd"))) > F.min(F.when(pure_ack, F.col("fwd"))))
    ) if _has_numbers(packets) else F.lit(False)
    return packets.groupBy("flow_key", "ts_ms").agg(
        *_packet_sums(),
        F.min(class_of(F.col("protocol"))).alias("kind"),
        F.max(F.when(F.col("rst"), F.col("packet_id"))).alias("last_rst"),
        F.coalesce(two_sided, F.lit(False)).alias("fin_cand"),
    )


def _has_numbers(packets: DataFrame) -> bool:
    return {"seq", "ack_no"} <= set(packets.columns)


def _with_idle_breaks(t: DataFrame, rules: FlowRules) -> DataFrame:
    """Ticks with ``slice``, ``brk`` (starts an idle session), ``gap`` and ``seg`` (running breaks)."""
    own = F.floor(F.col("ts_ms") / rules.slice_ms).cast("long")
    idle = rules.idle(F.col("kind"))
    near_end = F.pmod(F.col("ts_ms"), F.lit(rules.slice_ms)) >= rules.slice_ms - idle
    w = Window.partitionBy("flow_key", "slice").orderBy("ts_ms")
    gap = F.col("ts_ms") - F.lag("ts_ms").over(w)
    return (
        t.withColumn("slice", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))))
        .withColumn("gap", gap)
        .where(F.col("slice") == own)
        .withColumn("brk", F.col("gap").isNull() | (F.col("gap") >= idle))
        .withColumn("seg", F.sum(F.col("brk").cast("long")).over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )


def _add_up(start: Column) -> list[Column]:
    """Sums of ticks (or sub-ticks); ``start`` marks the tick a flow or session starts with."""
    gap = F.when(~start, F.col("gap"))
    return [
        *[F.sum(c).alias(c) for c in SUMS],
        F.min("min_len").alias("min_len"),
        F.max("max_len").alias("max_len"),
        F.sum(gap.cast("double") * gap).alias("gap_sumsq"),
        F.min(gap).alias("gap_min"),
        F.max(gap).alias("gap_max"),
        F.max(F.col("n") > 1).alias("many"),
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
        F.min(F.when(start, F.col("first_code"))).alias("first_code"),
    ]


def _sessions(t: DataFrame) -> DataFrame:
    """Idle sessions per key, from the fragments of each slice."""
    start = F.col("brk")
    fragments = t.groupBy("flow_key", "slice", "seg").agg(
        *_add_up(start),
        F.min("kind").alias("kind"),
        F.count(F.lit(1)).alias("n_ticks"),
        F.max(F.when(start, F.col("rst") > 0)).alias("start_rst"),
        F.max(F.when(start, F.col("fin_cand"))).alias("start_fin"),
        F.max(F.when(start, F.col("n"))).alias("start_n"),
    )
    by_key = Window.partitionBy("flow_key")
    numbered = fragments.withColumn(
        "session", F.sum((F.col("seg") > 0).cast("long")).over(
            by_key.orderBy("first_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).withColumn("is_last", F.col("session") == F.max("session").over(by_key))
    return numbered.groupBy("flow_key", "session").agg(
        *[F.sum(c).alias(c) for c in [*SUMS, "gap_sumsq", "n_ticks"]],
        *[F.min(c).alias(c) for c in ("min_len", "gap_min", "first_ms", "first_code", "kind")],
        *[F.max(c).alias(c) for c in ("max_len", "gap_max", "last_ms", "many", "is_last",
                                      "start_rst", "start_fin", "start_n")],
    )


def _fin_closings(packets: DataFrame, where: DataFrame) -> DataFrame:
    """Packets that complete a FIN handshake inside one millisecond of a flow that starts in it.

    Only the control packets of milliseconds with FINs and plain ACKs from both sides are looked at."""
    control = (
        packets.where(F.col("fin") | F.col("rst") | F.col("ack"))
        .select("flow_key", "ts_ms", "packet_id", "fwd", "fin", "rst", "ack", "seq", "ack_no",
                (F.col("src_ip") == F.col("dst_ip")).alias("same_host"))
        .join(where, ["flow_key", "ts_ms"], "left_semi")
    )

    def closings(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("packet_id")
        fin_seq, acked, out = {}, set(), []
        for row in pdf.itertuples(index=False):
            side = int(row.fwd)
            if row.fin:
                fin_seq[side] = row.seq
            elif row.ack:
                for other in (0, 1):
                    if other in fin_seq and row.ack_no == fin_seq[other] + 1 and (side != other or row.same_host):
                        acked.add(other)
            done = len(acked) == 2
            if done or row.rst:
                if done:
                    out.append(row.packet_id)
                fin_seq, acked = {}, set()
        return pd.DataFrame({"flow_key": [pdf.flow_key.iloc[0]] * len(out),
                             "ts_ms": [pdf.ts_ms.iloc[0]] * len(out), "packet_id": out})

    return control.groupBy("flow_key", "ts_ms").applyInPandas(
        closings, "flow_key string, ts_ms long, packet_id long")


def _next_starts(ts: np.ndarray, ends: np.ndarray, max_age: int) -> np.ndarray:
    """For a flow that starts at tick i, the tick at which the next one starts."""
    nxt = np.searchsorted(ts, ts + max_age, side="left")
    here = np.arange(len(ts)) + 1
    return np.where(ends, here, nxt)


def _steps(bounds: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same function with one step per run of equal values."""
    last = np.append(values[1:] != values[:-1], True)
    return bounds[last], values[last]


def _block_steps(ts: pd.Series, ends: pd.Series, age: pd.Series) -> pd.DataFrame:
    """What a block does to the live flow: a flow that began at or before ``bounds[i]`` (but after the bound before) is
    over within the block, and ``values[i]`` is the start of the flow that leaves; a later one leaves as it came."""
    bounds, values = [], []
    for t, e, a in zip(ts, ends, age):
        t, e, a = np.asarray(t, dtype=np.int64), np.asarray(e, dtype=bool), int(a)
        nxt = _next_starts(t, e, a)
        jump = np.where(nxt < len(t), nxt, np.arange(len(t)))
        while not np.array_equal(far := jump[jump], jump):
            jump = far
        k = int(np.searchsorted(t - a, t[0] - 1)) + 1  # a flow that enters began before the block
        b, v = _steps((t - a)[:k], np.where(e[jump], NONE, t[jump])[:k])
        bounds.append(b)
        values.append(v)
    return pd.DataFrame({"bounds": bounds, "values": values})


def _leaving(bounds: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    at = np.searchsorted(bounds, starts)
    return np.where(at < len(bounds), values[np.minimum(at, len(bounds) - 1)], starts)


def _compose(first: pd.Series, bounds: pd.Series, values: pd.Series, then_bounds: pd.Series, then_values: pd.Series
             ) -> pd.DataFrame:
    """The function of two neighbours from those of each; ``first``: the first tick of the left one."""
    out_b, out_v = [], []
    for t, b, v, gb, gv in zip(first, bounds, values, then_bounds, then_values):
        b, v = np.asarray(b, np.int64), np.asarray(v, np.int64)
        if gb is not None:
            gb, gv = np.asarray(gb, np.int64), np.asarray(gv, np.int64)
            v = _leaving(gb, gv, v)
            if b[-1] < t - 1:  # flows that pass through the left one untouched
                more = slice(int(np.searchsorted(gb, b[-1], "right")), int(np.searchsorted(gb, t - 1)) + 1)
                b, v = np.concatenate([b, gb[more]]), np.concatenate([v, gv[more]])
            b, v = _steps(b, v)
        out_b.append(b)
        out_v.append(v)
    return pd.DataFrame({"bounds": out_b, "values": out_v})


def _leaves(bounds: pd.Series, values: pd.Series, live: pd.Series) -> pd.Series:
    return pd.Series([int(_leaving(np.asarray(b), np.asarray(v), np.int64(s))) for b, v, s in zip(bounds, values, live)],
                     dtype="int64")


def _entries(functions: DataFrame) -> DataFrame:
    """``flow_key, session, block, live``: the start of the flow that enters each block (``NONE``: none).

    ``functions``: ``flow_key, session, node`` (blocks of a session from 0), ``first, bounds, values``."""
    key = ["flow_key", "session"]
    compose = F.pandas_udf(_compose, "bounds array<long>, values array<long>")
    leaves = F.pandas_udf(_leaves, "long")
    levels = [materialize(functions, "steps")]
    last = levels[0].agg(F.max("node")).first()[0] or 0
    while last:
        side = F.struct("node", "first", "bounds", "values")
        pairs = levels[-1].groupBy(*key, F.floor(F.col("node") / 2).alias("pair")).agg(
            F.sort_array(F.collect_list(side)).alias("c"))  # one or two
        left, right = F.col("c")[0], F.get("c", 1)
        pairs = pairs.select(*key, F.col("pair").alias("node"), left["first"].alias("first"), compose(
            left["first"], left["bounds"], left["values"], right["bounds"], right["values"]).alias("f"))
        levels.append(materialize(pairs.select(*key, "node", "first", "f.bounds", "f.values"), "steps"))
        last //= 2
    entry = levels[-1].select(*key, "node", F.lit(NONE).cast("long").alias("live"))
    for level in reversed(levels[:-1]):
        left = level.where(F.col("node") % 2 == 0).select(*key, (F.col("node") / 2).cast("long").alias("node"), "bounds", "values")
        both = entry.join(left, [*key, "node"]).select(*key, F.explode(F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("live").alias("live")),
            F.struct((2 * F.col("node") + 1).alias("node"), leaves("bounds", "values", "live").alias("live")))).alias("e"))
        entry = materialize(both.select(*key, "e.*"), "entries")
    return entry.withColumnRenamed("node", "block")


def _flow_starts(ts: pd.Series, ends: pd.Series, age: pd.Series, live: pd.Series) -> pd.Series:
    """Per block: the start of the flow each tick belongs to."""
    out = []
    for t, e, a, s in zip(ts, ends, age, live):
        t, e = np.asarray(t, dtype=np.int64), np.asarray(e, dtype=bool)
        nxt = _next_starts(t, e, int(a))
        at = 0 if s == NONE else int(np.searchsorted(t, s + int(a), side="left"))
        starts = np.empty(len(t), dtype=np.int64)
        starts[:at] = s
        while at < len(t):
            to = int(nxt[at])
            starts[at:to] = t[at]
            at = to
        out.append(starts)
    return pd.Series(out)


def _ticks_of(sessions: DataFrame, t: DataFrame, rules: FlowRules) -> DataFrame:
    slices = sessions.select(
        "flow_key", "session", F.col("first_ms").alias("s_first"), F.col("last_ms").alias("s_last"), "is_last",
        "n_ticks", F.explode(F.sequence(F.floor(F.col("first_ms") / rules.slice_ms).cast("long"),
                             F.floor(F.col("last_ms") / rules.slice_ms).cast("long"))).alias("slice"))
    return t.join(slices, ["flow_key", "slice"]).where(F.col("ts_ms").between(F.col("s_first"), F.col("s_last")))


def _place_ticks(inside: DataFrame, rules: FlowRules, long_ones: bool) -> DataFrame:
    """Ticks of sessions that may break, with the start ``flow_ms`` of the flow each belongs to.

    ``long_ones``: some session has more than one block."""
    key = ["flow_key", "session"]
    age = rules.max_age(F.col("kind"))
    ticks_ = inside.select(*key, "slice", "ts_ms", "ends", "kind", "n_ticks")
    cut = ticks_.where(F.col("n_ticks") <= BLOCK_TICKS).withColumn("block", F.lit(0).cast("long"))
    if long_ones:
        ranked = sliced_rank(ticks_.where(F.col("n_ticks") > BLOCK_TICKS), key, "slice", ["ts_ms"], "at")
        cut = cut.unionByName(ranked.withColumn("block", F.floor(F.col("at") / BLOCK_TICKS).cast("long")).drop("at"))
    blocks = (
        cut.groupBy(*key, "block")
        .agg(F.sort_array(F.collect_list(F.struct("ts_ms", "ends"))).alias("t"), F.min("kind").alias("kind"),
             F.max("n_ticks").alias("n_ticks"))
        .select(*key, "block", "n_ticks", F.col("t.ts_ms").alias("ts"), F.col("t.ends").alias("ends"), age.alias("max_age"))
    )
    if long_ones:
        blocks = materialize(blocks, "blocks")
        steps = F.pandas_udf(_block_steps, "bounds array<long>, values array<long>")
        functions = blocks.where(F.col("n_ticks") > BLOCK_TICKS).select(
            *key, F.col("block").alias("node"), F.col("ts")[0].alias("first"), steps("ts", "ends", "max_age").alias("f"))
        entries = _entries(functions.select(*key, "node", "first", "f.bounds", "f.values"))
        blocks = blocks.join(entries, [*key, "block"], "left")
    else:
        blocks = blocks.withColumn("live", F.lit(None).cast("long"))
    starts_of = F.pandas_udf(_flow_starts, "array<long>")
    starts = (
        blocks.select("flow_key", "ts", starts_of("ts", "ends", "max_age", F.coalesce("live", F.lit(NONE).cast("long"))).alias("starts"))
        .select("flow_key", F.explode(F.arrays_zip("ts", "starts")).alias("z"))
        .select("flow_key", F.col("z.ts").alias("ts_ms"), F.col("z.starts").alias("flow_ms"))
    )
    return inside.join(starts, ["flow_key", "ts_ms"])


def _split_sessions(packets: DataFrame, inside: DataFrame, rules: FlowRules, long_ones: bool) -> DataFrame:
    """Flows of the sessions that may break inside."""
    with_fin = _has_numbers(packets)
    last_close = F.col("last_rst")
    if with_fin:
        fins = materialize(_fin_closings(packets, inside.where("fin_cand").select("flow_key", "ts_ms")), "fins")
        inside = inside.join(
            fins.groupBy("flow_key", "ts_ms").agg(F.max("packet_id").alias("last_fin")),
            ["flow_key", "ts_ms"], "left")
        last_close = F.greatest(F.col("last_rst"), F.col("last_fin"))
    inside = inside.withColumn("closes", last_close.isNotNull()).withColumn(
        "ends", F.coalesce(last_close == F.col("last_id"), F.lit(False)))
    placed = materialize(_place_ticks(inside, rules, long_ones), "placed-ticks")
    at_start = F.col("ts_ms") == F.col("flow_ms")
    mixed = at_start & F.col("closes") & (F.col("n") > 1)

    columns = ["flow_key", "ts_ms", "flow_ms", "s_last", "is_last", "sub", "why", "gap", "first_code",
               "min_len", "max_len", *SUMS]
    parts = placed.where(~mixed).select(
        *[c for c in columns if c not in ("sub", "why")], F.lit(0).cast("long").alias("sub"),
        F.when(at_start & F.col("closes"), 1).alias("why")).select(*columns)
    facts = placed.where(mixed).select("flow_key", "ts_ms", "flow_ms", "s_last", "is_last")
    if not facts.isEmpty():
        sub_ticks = _split_ticks(packets, facts, fins if with_fin else None)
        parts = parts.unionByName(sub_ticks.select(*columns))
    flows = (
        parts.groupBy("flow_key", "flow_ms", "sub", "s_last", "is_last")
        .agg(*_add_up(at_start), F.max("why").alias("why"))
    )
    reason = (
        F.when(F.col("why") == 2, FIN).when(F.col("why") == 1, RST)
        .when(F.col("last_ms") < F.col("s_last"), AGE)
        .when(F.col("is_last"), DONE).otherwise(IDLE)
    )
    return flows.select(*SESSION_COLUMNS, reason.alias("end_reason"))


def _split_ticks(packets: DataFrame, facts: DataFrame, fins: DataFrame | None) -> DataFrame:
    """Milliseconds in which a flow starts and closes among other packets, split after each close.

    ``sub`` is 0 for the packets after the last close: they go on as the live flow."""
    split = packets.join(facts, ["flow_key", "ts_ms"])
    close, why = F.col("rst"), F.when(F.col("rst"), 1)
    if fins is not None:
        split = split.join(fins.withColumn("by_fin", F.lit(True)), ["flow_key", "ts_ms", "packet_id"], "left")
        close = F.coalesce("by_fin", F.col("rst"))
        why = F.when(F.col("by_fin"), 2).when(F.col("rst"), 1)
    split = materialize(
        split.withColumn("id_slice", F.floor(F.col("packet_id") / 65536))
        .withColumn("close", close.cast("long")).withColumn("close_kind", why), "split-ticks")
    split = sliced_running_sum(split, ["flow_key", "ts_ms"], "id_slice", ["packet_id"], {"sub": "close"},
                               inclusive=False)
    return (
        split.groupBy("flow_key", "ts_ms", "flow_ms", "s_last", "is_last", "sub")
        .agg(*_packet_sums(), F.max("close_kind").alias("why"))
        .withColumn("sub", F.when(F.col("why").isNotNull(), F.col("sub") + 1).otherwise(0))
        .withColumn("gap", F.lit(None).cast("long"))
    )


def flow_sums(packets: DataFrame, rules: FlowRules | None = None) -> DataFrame:
    """One row per flow with its additive sums and ``end_reason``."""
    rules = rules or FlowRules()
    packets = keyed_packets(packets).where(F.col("flow_key").isNotNull() & F.col("ts_ms").isNotNull())
    # Read twice: by all sessions, then by those that break. A lost block is computed again.
    t = _with_idle_breaks(ticks(packets), rules).persist(StorageLevel.DISK_ONLY)
    try:
        sessions = _sessions(t)
        close_at_start = (F.col("start_rst") | F.col("start_fin")) & (
            (F.col("n_ticks") > 1) | (F.col("start_n") > 1))
        old = F.col("last_ms") - F.col("first_ms") >= rules.max_age(F.col("kind"))
        reason = F.when(F.col("start_rst") & (F.col("n") == 1), RST).when(F.col("is_last"), DONE).otherwise(IDLE)
        sessions = materialize(
            sessions.select(*SESSION_COLUMNS, "session", "is_last", "n_ticks", reason.alias("end_reason"),
                            F.when(close_at_start | old, "breaks").otherwise("whole").alias("fate")),
            "sessions", "fate")
        flows = sessions.where("fate = 'whole'").select(*SESSION_COLUMNS, "end_reason")
        broken = sessions.where("fate = 'breaks'")
        longest = broken.agg(F.max("n_ticks")).first()[0]
        if longest:
            flows = flows.unionByName(_split_sessions(packets, _ticks_of(broken, t, rules), rules, longest > BLOCK_TICKS))
        return flows
    finally:
        t.unpersist()


def sessionize_flows(packets: DataFrame, rules: FlowRules | None = None) -> DataFrame:
    """Flows with endpoints, ``flow_seq`` per key and the additive sums."""
    rules = rules or FlowRules()
    flows = flow_sums(packets, rules).withColumn(
        "flow_slice", F.floor(F.col("first_ms") / rules.slice_ms).cast("long"))
    flows = sliced_rank(flows, ["flow_key"], "flow_slice", ["first_ms", "first_code"], "flow_seq")
    fwd = F.pmod(F.col("first_code"), F.lit(2)) == 1

    def end(a: int, b: int) -> Column:
        return F.when(fwd, key_part(a)).otherwise(key_part(b))

    return flows.select(
        "flow_key", F.col("flow_seq").cast("long").alias("flow_seq"),
        end(0, 1).alias("src_ip"), end(1, 0).alias("dst_ip"),
        end(2, 3).try_cast("int").alias("src_port"), end(3, 2).try_cast("int").alias("dst_port"),
        protocol_of_key().alias("protocol"),
        F.col("first_ms").alias("first_seen_ms"), F.col("last_ms").alias("last_seen_ms"), "end_reason",
        F.floor(F.col("first_code") / 2).cast("long").alias("first_packet_id"), fwd.alias("first_fwd"),
        *[c for c in SESSION_COLUMNS if c not in ("flow_key", "first_ms", "last_ms", "first_code")],
    )


def assign_packets(packets: DataFrame, flows: DataFrame, rules: FlowRules | None = None) -> DataFrame:
    """Packets with the ``flow_seq`` of their flow.

    The flows of a key are runs of its packets in the order (time, id), so a packet belongs
    to the last flow that started at or before it. Flow starts are laid between the packets,
    once per time slice the flow covers, and carried forward inside the slice. Slices are as short
    as the idle limit; a slice of a busy key is cut further, into parts of about ``PACKETS_AT_ONCE`` packets."""
    rules = rules or FlowRules()
    slice_ms = max(rules.idle_ms.values())
    packets = keyed_packets(packets)
    columns = [c for c in packets.columns if c != "flow_key"]

    def slice_of(c) -> Column:
        return F.floor(F.col(c) / slice_ms).cast("long")

    counts = packets.groupBy("flow_key", slice_of("ts_ms").alias("slice")).agg(F.count(F.lit(1)).alias("n"))
    busy = counts.where(F.col("n") > PACKETS_AT_ONCE).select(
        "flow_key", "slice", F.ceil(F.col("n") / PACKETS_AT_ONCE).cast("long").alias("parts"))
    busy = materialize(busy, "busy-slices")

    def cut(rows: DataFrame) -> DataFrame:
        return rows.join(busy, ["flow_key", "slice"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))

    def part_of(c: str) -> Column:
        return F.floor(F.pmod(F.col(c), F.lit(slice_ms)) * F.col("parts") / slice_ms).cast("long")

    begun = slice_of("first_seen_ms")
    marks = cut(flows.select(
        "flow_key", "flow_seq", "first_seen_ms", "last_seen_ms", "first_packet_id", begun.alias("begun"),
        F.explode(F.sequence(begun, slice_of("last_seen_ms"))).alias("slice")))
    first_part = F.when(F.col("slice") == F.col("begun"), part_of("first_seen_ms")).otherwise(0)
    last_part = F.when(F.col("slice") == slice_of("last_seen_ms"), part_of("last_seen_ms")).otherwise(F.col("parts") - 1)
    marks = marks.withColumn("first_part", first_part).withColumn("part", F.explode(F.sequence("first_part", last_part)))
    first = (F.col("slice") == F.col("begun")) & (F.col("part") == F.col("first_part"))
    marks = marks.select(
        "flow_key", "slice", "part",
        F.when(first, F.col("first_seen_ms")).otherwise(F.col("slice") * slice_ms).alias("at_ms"),
        F.when(first, F.col("first_packet_id")).otherwise(-1).alias("at_id"),
        "flow_seq", F.lit(None).cast(packets.select(F.struct(*columns)).schema[0].dataType).alias("p"))
    rows = cut(packets.withColumn("slice", slice_of("ts_ms"))).select(
        "flow_key", "slice", part_of("ts_ms").alias("part"), F.col("ts_ms").alias("at_ms"),
        F.col("packet_id").alias("at_id"), F.lit(None).cast("long").alias("flow_seq"),
        F.struct(*columns).alias("p"))
    w = (Window.partitionBy("flow_key", "slice", "part").orderBy("at_ms", "at_id", F.col("p").isNotNull())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        marks.unionByName(rows)
        .withColumn("flow_seq", F.last("flow_seq", ignorenulls=True).over(w))
        .where(F.col("p").isNotNull())
        .select("flow_key", "flow_seq", "p.*")
    )
