"""Flows from a packet stream, with state per flow key.

The state of a key is the sums of its live flow, whatever the number of packets; with
``lateness_ms`` it also holds the packets younger than the watermark, so that late
ones are put in order before they are counted. A flow ends

* when the key's next packet breaks it (idle limit, age limit, TCP close), or
* when the watermark passes its idle limit: an event-time timer closes it, so the cost
  does not depend on the number of live flows.

A key without a live flow and without waiting packets has no state and no timer. Flows are known by key and first
packet; their numbers are given where they are read (``number_flows``).

A flow that is over age but silent is judged like in batch: by its own next packet, or by
the idle limit, whichever is first. So flows and reasons do not depend on other keys' packets
or on how the input is cut into micro-batches.

Packets that wait, and packets of a key that come in several chunks, lie in the state store as pieces of like
times, each written once and taken out once. A task holds the pieces around one point in time, not a whole key.

Most keys have few packets, so what counts is the cost per key. Packets come to the state, and flows leave it, packed
as bytes; whole Arrow batches are packed and unpacked at a time.

Event time is packet time. No packet is dropped for being late: it joins the live
flow, as far back as it may lie. What is still live at the end is read from the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewire.operators.features import flow_features
from tidewire.operators.ordered import time_rank
from tidewire.operators.sessionize import AGE, DONE, FIN, IDLE, RST, FlowRules, key_part, keyed_packets, protocol_of_key

_WHOLE = ["ts_ms", "packet_id", "length", "fwd", "seq", "ack_no"]
_FLAGS = ["syn", "fin", "rst", "ack", "psh", "tcp", "udp", "same_host"]
#: A packet as it waits in the state.
PACKET = np.dtype([(c, np.int64) for c in _WHOLE] + [(c, np.bool_) for c in _FLAGS])
PIECE_ROWS = 256  # a piece of a chunk is not cut before it has so many packets
CHUNK_ROWS = 10_000  # packets of a key come in chunks of about so many
SUM_COLUMNS = ["n", "bytes", "fwd_n", "fwd_bytes", "syn", "fin", "rst", "ack", "psh", "tcp_n", "udp_n"]
STATE = (", ".join(f"{c} long" for c in SUM_COLUMNS)
         + ", sumsq double, min_len long, max_len long, gap_sumsq double, gap_min long, gap_max long, many boolean,"
           " first_ms long, last_ms long, first_code long, fin0 long, fin1 long, acked0 boolean, acked1 boolean")
STATE_COLUMNS = [c.split()[0] for c in STATE.split(", ")]
OUTPUT = "flow_key string, " + STATE + ", end_reason string"
REASONS = [IDLE, AGE, FIN, RST]
_TYPES = {"long": np.int64, "double": np.float64, "boolean": np.bool_}
#: A closed flow as it leaves the state; ``reason`` is the place in REASONS.
FLOW = np.dtype([(c, _TYPES[kind]) for c, kind in (f.split() for f in STATE.split(", "))] + [("reason", np.int64)])


def _new_flow() -> dict:
    flow = dict.fromkeys(SUM_COLUMNS, 0)
    flow.update(sumsq=0.0, min_len=1 << 62, max_len=0, gap_sumsq=0.0, gap_min=-1, gap_max=-1, many=False,
                first_ms=-1, last_ms=-1, first_code=0, fin0=-1, fin1=-1, acked0=False, acked1=False)
    return flow


def in_order(*parts: np.ndarray) -> np.ndarray:
    """Packets of the parts by time and id."""
    rows = np.concatenate(parts) if parts else np.empty(0, PACKET)
    return rows[np.lexsort((rows["packet_id"], rows["ts_ms"]))]


def packet_array(rows: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(rows), PACKET)
    for c in PACKET.names:
        out[c] = rows[c].to_numpy()
    return out


def pack_packets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per key of a batch: its packets as bytes."""
    for pdf in batches:
        codes, keys = pd.factorize(pdf["flow_key"], use_na_sentinel=False)
        data = packet_array(pdf)[np.argsort(codes, kind="stable")].tobytes()
        ends = (np.cumsum(np.bincount(codes, minlength=len(keys))) * PACKET.itemsize).tolist()
        yield pd.DataFrame({"flow_key": np.asarray(keys, object),
                            "packets": [data[a:b] for a, b in zip([0, *ends], ends)]})


def packet_chunks(rows: Iterator[Row]) -> Iterator[np.ndarray]:
    held, n = [], 0
    for row in rows:
        held.append(np.frombuffer(bytes(row["packets"]), PACKET))
        n += len(held[-1])
        if n >= CHUNK_ROWS:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def unpack_flows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = np.frombuffer(b"".join(pdf["flows"]), FLOW)
        out = pd.DataFrame({c: rows[c] for c in STATE_COLUMNS})
        out.insert(0, "flow_key", np.repeat(pdf["flow_key"].to_numpy(), [len(f) // FLOW.itemsize for f in pdf["flows"]]))
        out["end_reason"] = np.array(REASONS, object)[rows["reason"]]
        yield out


def pieces(rows: np.ndarray, width: int) -> list[np.ndarray]:
    """Ordered packets, cut where time steps over a multiple of ``width`` and PIECE_ROWS have gathered."""
    out, at = [], 0
    for step in (np.flatnonzero(np.diff(rows["ts_ms"] // width)) + 1).tolist():
        if step - at >= PIECE_ROWS:
            out.append(rows[at:step])
            at = step
    return [*out, rows[at:]] if at < len(rows) else out


class FlowProcessor(StatefulProcessor):
    """Keeps one live flow per key."""

    def __init__(self, idle_ms: dict, max_age_ms: dict, lateness_ms: int):
        self.idle_ms, self.max_age_ms, self.lateness_ms = idle_ms, max_age_ms, lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", STATE)
        self.early = handle.getMapState("early", "start long, part long", "packets binary")
        self.names = handle.getValueState("names", "names binary")

    def close(self) -> None:
        pass

    # -- the fold

    def _limits(self, key: str) -> tuple[int, int]:
        kind = key.split("_", 4)[4]
        kind = kind if kind in ("TCP", "UDP") else "OTHER"
        return self.idle_ms[kind], self.max_age_ms[kind]

    @staticmethod
    def _close_at(flow: dict, p: dict, start: int, stop: int) -> tuple[int, str | None]:
        """First packet of [start, stop) that closes a flow all of whose packets share its millisecond."""
        control = np.flatnonzero(p["tcp"][start:stop] & (p["rst"][start:stop] | p["fin"][start:stop]
                                                         | p["ack"][start:stop])) + start
        for i in control:
            side = int(p["fwd"][i])
            if p["fin"][i]:
                flow[f"fin{side}"] = int(p["seq"][i])
            elif p["ack"][i]:
                for other in (0, 1):
                    asked = flow[f"fin{other}"]
                    if asked >= 0 and p["ack_no"][i] == asked + 1 and (side != other or p["same_host"][i]):
                        flow[f"acked{other}"] = True
            if flow["acked0"] and flow["acked1"]:
                return int(i), FIN
            if p["rst"][i]:
                return int(i), RST
        return stop, None

    @staticmethod
    def _add(flow: dict, p: dict, start: int, stop: int) -> None:
        ts, size = p["ts_ms"][start:stop], p["length"][start:stop]
        gaps = np.diff(ts)
        if flow["n"]:
            gaps = np.concatenate([[abs(int(ts[0]) - flow["last_ms"])], gaps])
        else:
            flow["first_ms"] = flow["last_ms"] = int(ts[0])
            flow["first_code"] = int(p["packet_id"][start]) * 2 + int(p["fwd"][start])
        part = slice(start, stop)
        flow["n"] += stop - start
        flow["bytes"] += int(size.sum())
        flow["sumsq"] += float((size.astype(float) ** 2).sum())
        flow["fwd_n"] += int(p["fwd"][part].sum())
        flow["fwd_bytes"] += int((p["fwd"][part] * size).sum())
        for flag in ("syn", "fin", "rst", "ack", "psh"):
            flow[flag] += int(p[flag][part].sum())
        flow["tcp_n"] += int(p["tcp"][part].sum())
        flow["udp_n"] += int(p["udp"][part].sum())
        flow["min_len"] = min(flow["min_len"], int(size.min()))
        flow["max_len"] = max(flow["max_len"], int(size.max()))
        if len(gaps):
            flow["gap_sumsq"] += float((gaps.astype(float) ** 2).sum())
            low = int(gaps.min())
            flow["gap_min"] = low if flow["gap_min"] < 0 else min(flow["gap_min"], low)
            flow["gap_max"] = max(flow["gap_max"], int(gaps.max()))
        flow["first_ms"] = min(flow["first_ms"], int(ts.min()))
        flow["last_ms"] = max(flow["last_ms"], int(ts.max()))

    def _fold(self, key: str, flow: dict | None, rows: np.ndarray, closed: list) -> dict | None:
        """Apply ordered packets; adds the flows that end to ``closed`` and returns the live one."""
        idle, age = self._limits(key)
        p = {c: np.ascontiguousarray(rows[c]) for c in PACKET.names}
        ts = p["ts_ms"]
        breaks = np.flatnonzero(np.diff(ts) >= idle) + 1
        at = 0
        while at < len(ts):
            if flow is not None:
                if ts[at] - flow["last_ms"] >= idle:
                    flow = self._end(key, flow, IDLE, closed)
                elif ts[at] - flow["first_ms"] >= age:
                    flow = self._end(key, flow, AGE, closed)
            if flow is None:
                flow = _new_flow()
            first = flow["first_ms"] if flow["n"] else int(ts[at])
            k = int(np.searchsorted(breaks, at, side="right"))
            stop = min(int(breaks[k]) if k < len(breaks) else len(ts),
                       max(int(np.searchsorted(ts, first + age, side="left")), at + 1))
            reason = None
            if (not flow["n"] or flow["first_ms"] == flow["last_ms"]) and ts[at] == first:
                same = min(stop, int(np.searchsorted(ts, first, side="right")))
                close, reason = self._close_at(flow, p, at, same)
                if reason:
                    stop = close + 1
            self._add(flow, p, at, stop)
            at = stop
            if reason:
                flow = self._end(key, flow, reason, closed)
        return flow

    @staticmethod
    def _end(key: str, flow: dict, reason: str, closed: list) -> None:
        closed.append((*[flow[c] for c in STATE_COLUMNS], REASONS.index(reason)))

    # -- state

    def _put(self, parts: list[np.ndarray], taken: set) -> None:
        """Pieces into the store, under names that are not ``taken``."""
        for rows in parts:
            start, part = int(rows["ts_ms"][0]), 0
            while (start, part) in taken:
                part += 1
            taken.add((start, part))
            self.early.updateValue((start, part), (rows.tobytes(),))

    def _due(self, names: set, watermark: int | None) -> Iterator[np.ndarray]:
        """Packets up to the watermark (None: all) in order, taken out of the store piece after piece; holds the pieces
        that overlap. What is left of a piece goes back."""
        held, order = np.empty(0, PACKET), sorted(names)
        for i, name in enumerate(order):
            if watermark is not None and name[0] > watermark:
                break
            rows = np.frombuffer(bytes(self.early.getValue(name)[0]), PACKET)
            self.early.removeKey(name)
            names.discard(name)
            following = order[i + 1][0] if i + 1 < len(order) else None
            until = watermark + 1 if watermark is not None else None
            if following is not None:
                until = following if until is None else min(until, following)
            held = in_order(held, rows)
            cut = len(held) if until is None else int(np.searchsorted(held["ts_ms"], until))
            if cut:
                yield held[:cut]
                held = held[cut:]
        if len(held):
            self._put([held], names)

    def _waiting(self) -> set:
        """Names of the pieces in the store. They are kept beside them: a call that lists costs far more than one that gets."""
        known = self.names.get() if self.lateness_ms else None
        return set() if known is None else set(map(tuple, np.frombuffer(bytes(known[0]), np.int64).reshape(-1, 2).tolist()))

    def _remember(self, names: set, before: set) -> None:
        if not names and before:
            self.names.clear()
        elif names != before:
            self.names.update((np.array(sorted(names), np.int64).tobytes(),))

    def _load(self) -> dict | None:
        state = self.flow.get()
        return None if state is None else dict(zip(STATE_COLUMNS, state))

    def _advance(self, key: str, chunks: Iterator[np.ndarray], watermark: int) -> Iterator[Row]:
        before = self._load()
        flow, closed, waits = dict(before) if before else None, [], None
        # The timers follow from the state as it was left.
        there = set() if before is None else {before["last_ms"] + self._limits(key)[0]}
        head = next(chunks, None)
        more = next(chunks, None) if head is not None else None
        if not self.lateness_ms and more is None:
            if head is not None:
                flow = self._fold(key, flow, in_order(head), closed)
        else:
            names = self._waiting()
            waited = set(names)
            if waited:
                there.add(min(waited)[0])
            width = max(1, self.lateness_ms // 16 or min(self.idle_ms.values()) // 4)
            while head is not None:
                self._put(pieces(in_order(head), width), names)
                head, more = more, next(chunks, None) if more is not None else None
            for rows in self._due(names, watermark if self.lateness_ms else None):
                flow = self._fold(key, flow, rows, closed)
                yield from self._rows(key, closed)
                closed.clear()
            self._remember(names, waited)
            waits = min(names)[0] if names else None
        idle_at = None
        if flow is not None:
            idle_at = flow["last_ms"] + self._limits(key)[0]
            if idle_at <= watermark:
                flow = self._end(key, flow, IDLE, closed)
                idle_at = None
        if flow is None and before is not None:
            self.flow.clear()
        elif flow is not None and flow != before:
            self.flow.update(tuple(flow[c] for c in STATE_COLUMNS))
        wanted = {int(t) for t in (waits, idle_at) if t is not None}
        for timer in there - wanted:
            if timer > watermark:  # Spark deletes those that fire
                self.handle.deleteTimer(timer)
        for timer in wanted - there:
            self.handle.registerTimer(timer)
        yield from self._rows(key, closed)

    @staticmethod
    def _rows(key: str, closed: list) -> Iterator[Row]:
        if closed:
            yield Row(flow_key=key, flows=np.array(closed, FLOW).tobytes())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._advance(key[0], packet_chunks(rows), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key[0], iter(()), timerValues.getCurrentWatermarkInMs())


def stream_sessionize(packets: DataFrame, rules: FlowRules | None = None, lateness_ms: int = 0) -> DataFrame:
    """Closed flows (sums as in batch) from a stream of packets."""
    rules = rules or FlowRules()
    packets = keyed_packets(packets)
    number = {c: F.col(c).cast("long") if c in packets.columns else F.lit(-1).cast("long") for c in ("seq", "ack_no")}
    timed = packets.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark(
        "event_time", f"{lateness_ms} milliseconds")
    # Without the event time column Spark has nothing to call late, so no packet is dropped.
    narrow = timed.select(
        "flow_key", "ts_ms", "packet_id", F.col("length").cast("long").alias("length"), "fwd",
        *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in ("syn", "fin", "rst", "ack", "psh")],
        (F.col("l4_kind") == "TCP").alias("tcp"), (F.col("l4_kind") == "UDP").alias("udp"),
        *[F.coalesce(number[c], F.lit(-1)).cast("long").alias(c) for c in ("seq", "ack_no")],
        F.coalesce(F.col("src_ip") == F.col("dst_ip"), F.lit(False)).alias("same_host"))
    packed = narrow.mapInPandas(pack_packets, "flow_key string, packets binary")
    closed = packed.groupBy("flow_key").transformWithState(
        statefulProcessor=FlowProcessor(rules.idle_ms, rules.max_age_ms, lateness_ms),
        outputStructType="flow_key string, flows binary", outputMode="append", timeMode="EventTime")
    return closed.mapInPandas(unpack_flows, OUTPUT)


def number_flows(rows: DataFrame, slice_ms: int = 86_400_000) -> DataFrame:
    """Output or state rows with ``flow_seq``, the number of the flow within its key, as in batch.

    Needs all flows of the keys so far: those that ended come before the live one."""
    known = rows.withColumn("__id", F.floor(F.col("first_code") / 2).cast("long"))
    return time_rank(known, ["flow_key"], "first_ms", "__id", slice_ms, "flow_seq").drop("__id")


def state_to_flows(rows: DataFrame) -> DataFrame:
    """Output or state rows with endpoints and all features; ``flow_seq`` is null where it is not known."""
    fwd = F.pmod(F.col("first_code"), F.lit(2)) == 1

    def end(a: int, b: int):
        return F.when(fwd, key_part(a)).otherwise(key_part(b))

    gap = {c: F.when(F.col(c) >= 0, F.col(c)) for c in ("gap_min", "gap_max")}
    number = F.col("flow_seq") if "flow_seq" in rows.columns else F.lit(None)
    return flow_features(rows.withColumns({
        "src_ip": end(0, 1), "dst_ip": end(1, 0), "src_port": end(2, 3).try_cast("int"),
        "dst_port": end(3, 2).try_cast("int"), "protocol": protocol_of_key(), "flow_seq": number.cast("long"),
        "first_seen_ms": F.col("first_ms"), "last_seen_ms": F.col("last_ms"),
        "first_packet_id": F.floor(F.col("first_code") / 2).cast("long"), "first_fwd": fwd, **gap}))


def _state(spark: SparkSession, checkpoint: str, **options) -> DataFrame:
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "flow")
    return reader.options(**options).load()


def live_flows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Flows that are live in the state of a stopped or running query, as flow rows.

    This is the live snapshot, and after the end of input the rows to flush."""
    rows = _state(spark, checkpoint).select(F.col("key.flow_key").alias("flow_key"), "value.*")
    return rows.withColumn("end_reason", F.lit(DONE))


def changed_flows(spark: SparkSession, checkpoint: str, first_batch: int, last_batch: int) -> DataFrame:
    """What the batches ``first_batch`` to ``last_batch`` did to the live flows: one row per key whose live flow is another
    one, or another size, than before. ``live`` is false where the key has no live flow any more; the sums are null
    then.

    Read from the change feed of the state store, so the cost follows the changes and not the live flows. The store
    must keep change logs: ``spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled``."""
    feed = _state(spark, checkpoint, readChangeFeed=True, changeStartBatchId=first_batch, changeEndBatchId=last_batch)
    rows = feed.select(F.col("key.flow_key").alias("flow_key"), "batch_id",
                       F.struct((F.col("change_type") != "delete").alias("live"), "value.*").alias("r"))
    # Within a batch a key is written once: no timer is left that could fire after its packets.
    return rows.groupBy("flow_key").agg(F.max_by("r", "batch_id").alias("r")).select("flow_key", "r.*")
