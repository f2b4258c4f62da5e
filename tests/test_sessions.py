"""Flow building: edge cases, random histories against the plain rules, skew, order, conservation."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from fold import COLUMNS, flows_of, packet, reply
from tidewire.operators.features import flow_features, flow_lists, flows_with_features
from tidewire.operators.sessionize import FlowRules, assign_packets, sessionize_flows
from tidewire.session import shared_folder
from tidewire.streaming import jobs, sessions

DEFAULT = FlowRules()


def same(ms):
    return {"TCP": ms, "UDP": ms, "OTHER": ms}


def run(spark, rows, rules=DEFAULT):
    flows = sessionize_flows(spark.createDataFrame(rows, COLUMNS), rules).orderBy("flow_key", "flow_seq").collect()
    return [(f.flow_key, f.first_seen_ms, f.last_seen_ms, f.n, f.bytes, f.end_reason, f.src_ip) for f in flows]


def named(case, rows):
    """Give each case its own address, so that all cases go through one run."""
    old, new = "10.0.0.", f"10.{case}.0."
    return [tuple(v.replace(old, new) if isinstance(v, str) else v for v in r) for r in rows]


U = dict(proto="UDP")
CASES = {
    "one packet": ([packet(0, 0, **U)], [(0, 0, 1, "PCAP_DONE")]),
    "gap just below": ([packet(0, 0, **U), packet(1, 4999, **U)], [(0, 4999, 2, "PCAP_DONE")]),
    "gap exact": ([packet(0, 0, **U), packet(1, 5000, **U)],
                  [(0, 0, 1, "Inactivity Timeout"), (5000, 5000, 1, "PCAP_DONE")]),
    "max age exact": ([packet(i, i * 4000, **U) for i in range(76)],
                      [(0, 296000, 75, "Max Age Exceeded"), (300000, 300000, 1, "PCAP_DONE")]),
    "equal times": ([packet(i, 7, **U) for i in range(3)], [(7, 7, 3, "PCAP_DONE")]),
    "lone reset": ([packet(0, 0, flags="R"), packet(1, 1, flags="A")],
                   [(0, 0, 1, "TCP RST"), (1, 1, 1, "PCAP_DONE")]),
    "later reset": ([packet(0, 0, flags="S"), packet(1, 10, flags="R"), packet(2, 20, flags="A")],
                    [(0, 20, 3, "PCAP_DONE")]),
    "fin in one ms": ([packet(0, 0, flags="F", seq=100), reply(1, 0, flags="A", ack_no=101),
                       reply(2, 0, flags="F", seq=200), packet(3, 0, flags="A", ack_no=201)], [(0, 0, 4, "TCP FIN")]),
    "fin and ack combined": ([packet(0, 0, flags="F", seq=100), reply(1, 0, flags="FA", seq=200, ack_no=101),
                              packet(2, 0, flags="A", ack_no=201)], [(0, 0, 3, "PCAP_DONE")]),
    "fin over several ms": ([packet(0, 0, flags="F", seq=100), reply(1, 1, flags="A", ack_no=101),
                             reply(2, 2, flags="F", seq=200), packet(3, 3, flags="A", ack_no=201)],
                            [(0, 3, 4, "PCAP_DONE")]),
    "two directions": ([packet(0, 0, **U), reply(1, 5, **U)], [(0, 5, 2, "PCAP_DONE")]),
    "no ports": ([packet(0, 0, ap=None, bp=None, proto="ICMPv4")], [(0, 0, 1, "PCAP_DONE")]),
    "resets in one ms": ([packet(i, 0, flags="R") for i in range(3)] + [packet(3, 0), packet(4, 9)],
                         [(0, 0, 1, "TCP RST")] * 3 + [(0, 9, 2, "PCAP_DONE")]),
}


def test_edge_cases(spark):
    rows, expected = [], {}
    for case, (name, (packets, flows)) in enumerate(CASES.items(), start=1):
        fixed = [(r[0].replace("None", "null"), case * 1000 + r[1], *r[2:]) for r in named(case, packets)]
        rows += fixed
        expected[name] = (fixed[0][0], flows)
    got = run(spark, rows)
    for name, (key, flows) in expected.items():
        assert [(f[1], f[2], f[3], f[5]) for f in got if f[0] == key] == flows, name


def test_both_limits_reads_inactivity(spark):
    rules = FlowRules(max_age_ms=same(6000))
    rows = [packet(0, 0, **U), packet(1, 4000, **U), packet(2, 10000, **U)]
    assert run(spark, rows, rules)[0][5] == "Inactivity Timeout"


def features(spark, rows):
    return flows_with_features(spark.createDataFrame(rows, COLUMNS)).first()


def test_features_of_one_packet(spark):
    f = features(spark, [packet(0, 0, **U)])
    assert math.isnan(f.stddev_packet_length) and f.bytes_per_second == 0 and f.duration_ms == 0
    assert (f.ratio_bytes_up_down, f.ratio_packets_up_down, f.flow_symmetry) == (1.0, 1.0, 0.0)
    assert (f.inter_arrival_time_min, f.inter_arrival_time_max, f.inter_arrival_time_stddev) == (0, 0, 0.0)
    assert (f.udp_fraction, f.syn_rate, f.psh_rate) == (1.0, 0.0, -1.0)


def test_features_of_two_packets(spark):
    f = features(spark, [packet(0, 0, length=100, **U), reply(1, 1000, length=50, **U)])
    assert (f.bytes, f.mean_packet_length, f.bytes_per_second, f.packets_per_second) == (150, 75.0, 150.0, 2.0)
    assert f.stddev_packet_length == pytest.approx(35.35533905932738)
    assert (f.ratio_bytes_up_down, f.ratio_packets_up_down, f.flow_symmetry) == (2.0, 1.0, 0.5)
    assert f.inter_arrival_time_mean == 1000 and math.isnan(f.inter_arrival_time_stddev)


def test_one_host_is_all_upstream(spark):
    rows = [packet(0, 0, a="10.0.0.1", b="10.0.0.1", **U), packet(1, 1, a="10.0.0.1", b="10.0.0.1", ap=80, bp=1000, **U)]
    f = features(spark, rows)
    assert (f.total_packets_upstream, f.total_packets_downstream) == (2, 0)


def histories(seed, keys=60, most=90):
    """Random packets of many keys: ties, resets, answered and unanswered FINs, long and short gaps."""
    rnd = random.Random(seed)
    rows, pid = [], 0
    for k in range(keys):
        proto = rnd.choice(["TCP", "TCP", "UDP"])
        ts = rnd.randrange(0, 50)
        for _ in range(rnd.randrange(1, most)):
            ts += rnd.choice([0, 0, 0, 1, 2, 3, 7, 9, 10, 30]) if rnd.random() < 0.9 else rnd.randrange(0, 60)
            flags = rnd.choice(["", "", "A", "A", "F", "F", "S", "R", "FA"]) if proto == "TCP" else ""
            make = rnd.choice([packet, reply])
            row = make(pid, ts, proto=proto, length=rnd.randrange(54, 1500), flags=flags,
                       seq=rnd.choice([100, 101]), ack_no=rnd.choice([101, 102]))
            rows.append(named(k % 250, [row])[0])
            pid += 1
    return rows


@pytest.mark.parametrize("seed,idle,age,piece", [(1, 10, 25, 10), (2, 10, 12, 40), (3, 31, 60, 31), (4, 5, 1000, 7)])
def test_random_histories(spark, seed, idle, age, piece):
    rows = histories(seed)
    rules = FlowRules(same(idle), same(age), piece)
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    got = run(spark, shuffled, rules)
    assert got == flows_of(rows, idle, age)
    assert sum(f[3] for f in got) == len(rows) and sum(f[4] for f in got) == sum(r[8] for r in rows)


def test_one_flood_key_over_many_blocks(spark):
    """One key holds nearly all packets and its session covers many blocks of ages."""
    rnd = random.Random(7)
    ts, rows = 0, []
    for i in range(6000):
        ts += rnd.choice([0, 1, 1, 2, 5])
        rows.append(packet(i, ts, flags=rnd.choice(["", "A", "R", "S"])))
    rows += [packet(10_000 + i, i * 100, a="10.9.9.9", **U) for i in range(50)]
    rules = FlowRules(same(6), same(40), 50)
    assert run(spark, rows, rules) == flows_of(rows, 6, 40)


@pytest.mark.parametrize("ticks", [1, 8])
def test_blocks_of_any_size_give_the_same_flows(spark, monkeypatch, ticks):
    """Step functions of blocks shorter and longer than an age, composed over up to ten levels."""
    from tidewire.operators import sessionize
    monkeypatch.setattr(sessionize, "BLOCK_TICKS", ticks)
    rng = random.Random(ticks)
    rows, at = [], {}
    for i in range(900):
        key = rng.choice(["1", "1", "1", "2", "3"])
        at[key] = at.get(key, -40) + rng.choice([0, 1, 1, 2, 3, 9, 25])
        flags = rng.choice(["", "", "", "", "", "R", "R"]) if key != "3" else ""
        rows += named(key, [packet(i, at[key], flags=flags)])
    for age in (40, 300):
        rules = FlowRules(same(25), same(age), 60)
        assert run(spark, rows, rules) == flows_of(rows, 25, age)


def test_composed_steps_equal_one_block():
    import numpy as np
    import pandas as pd
    from tidewire.operators import sessionize as z

    rng = np.random.default_rng(1)
    for _ in range(300):
        t = np.cumsum(rng.choice([1, 1, 2, 5, 30], rng.integers(2, 60)))
        e = rng.random(len(t)) < rng.choice([0, 0.1, 0.5])
        age, k = int(rng.integers(1, 60)), int(rng.integers(1, len(t)))

        def steps(a, b):
            return z._block_steps(pd.Series([t[a:b]]), pd.Series([e[a:b]]), pd.Series([age])).iloc[0]

        left, right, whole = steps(0, k), steps(k, len(t)), steps(0, len(t))
        both = z._compose(pd.Series([t[0]]), *(pd.Series([f[c]]) for f in (left, right) for c in ("bounds", "values"))).iloc[0]
        entering = np.append(np.arange(t[0] - age - 5, t[0]), z.NONE)
        assert (z._leaving(both.bounds, both["values"], entering) == z._leaving(whole.bounds, whole["values"], entering)).all()
        assert len(both.bounds) <= (t < t[0] + age).sum() + 1


def test_busy_slices_are_cut_further(spark, monkeypatch):
    from tidewire.operators import sessionize
    monkeypatch.setattr(sessionize, "PACKETS_AT_ONCE", 7)
    rng = random.Random(4)
    rows = [packet(i, rng.randrange(-200, 3000), flags=rng.choice(["", "", "R"])) for i in range(500)]
    df, rules = spark.createDataFrame(rows, COLUMNS), FlowRules(same(90), same(200), 100)
    flows = sessionize_flows(df, rules)
    placed = assign_packets(df, flows, rules).groupBy("flow_seq").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    assert {(r.flow_seq, r.n, r.bytes) for r in placed.collect()} == {(f.flow_seq, f.n, f.bytes) for f in flows.collect()}


def test_packets_find_their_flow(spark):
    rows = histories(11, keys=25)
    rules = FlowRules(same(10), same(25), 20)
    df = spark.createDataFrame(rows, COLUMNS)
    flows = sessionize_flows(df, rules)
    placed = assign_packets(df, flows, rules).groupBy("flow_key", "flow_seq").agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), F.min("ts_ms").alias("first"))
    want = {(f.flow_key, f.flow_seq): (f.n, f.bytes, f.first_seen_ms) for f in flows.collect()}
    assert {(p.flow_key, p.flow_seq): (p.n, p.bytes, p["first"]) for p in placed.collect()} == want


def test_long_lists_go_on_in_parts(spark):
    rows = [packet(i, i // 3, **U) for i in range(50)]
    parts = flow_lists(spark.createDataFrame(rows, COLUMNS), FlowRules(same(10), same(1000), 10),
                       F.col("packet_id"), "ids", part_size=20).orderBy("part").collect()
    assert [len(p.ids) for p in parts] == [20, 20, 10]
    assert [i for p in parts for i in p.ids] == list(range(50))


def test_only_packets_of_long_flows_are_numbered(spark, monkeypatch):
    from tidewire.operators import features
    ranked, time_rank = [], features.time_rank
    monkeypatch.setattr(features, "time_rank", lambda df, *more: ranked.append(df.count()) or time_rank(df, *more))
    rows = [packet(i, 10 - i // 3, **U) for i in range(30)] + [packet(100 + i, i // 2, bp=90 + i % 2) for i in range(9)]
    df, rules = spark.createDataFrame(rows, COLUMNS), FlowRules(same(20), same(1000), 20)
    for size, numbered in ((100, []), (7, [30])):
        parts = flow_lists(df, rules, F.col("packet_id"), "ids", part_size=size).collect()
        got = {}
        for p in sorted(parts, key=lambda p: p.part):
            assert len(p.ids) <= size
            got.setdefault((p.flow_key, p.flow_seq), []).extend(p.ids)
        assert ranked == numbered and sorted(map(len, got.values())) == [4, 5, 30]
        order = {r[1]: (r[2], r[1]) for r in rows}
        assert all(ids == sorted(ids, key=order.get) for ids in got.values())


def stream(spark, steps, rules, lateness=0):
    source, out, cp = (shared_folder(spark, n) for n in ("src", "out", "cp"))
    for rows in steps:
        spark.createDataFrame(rows, COLUMNS).write.mode("append").parquet(source)
        packets = spark.readStream.schema(COLUMNS).parquet(source)
        jobs.run_available(sessions.stream_sessionize(packets, rules, lateness), out, cp)
    closed = jobs.read_batches(spark, out).drop("batch_id")
    return sessions.number_flows(closed.unionByName(sessions.live_flows(spark, cp)))


def test_stream_equals_batch(spark):
    rows = histories(21, keys=20)
    rules = FlowRules(same(10), same(25), 40)
    ordered = sorted(rows, key=lambda r: r[2])
    cut = len(ordered) // 2
    flows = stream(spark, [ordered[:cut], ordered[cut:]], rules).collect()
    got = sorted((f.flow_key, f.flow_seq, f.first_ms, f.last_ms, f.n, f.bytes) for f in flows)
    batch = sessionize_flows(spark.createDataFrame(rows, COLUMNS), rules).collect()
    assert got == sorted((f.flow_key, f.flow_seq, f.first_seen_ms, f.last_seen_ms, f.n, f.bytes) for f in batch)


@pytest.mark.parametrize("lateness", [0, 5000])
def test_late_packet_joins_its_flow(spark, lateness):
    steps = [[packet(0, 3000, **U)], [packet(1, 1000, **U)]]
    flows = stream(spark, steps, DEFAULT, lateness)
    if lateness:
        # Both packets still wait for the watermark; a far packet of another key lets them through.
        flows = stream(spark, [*steps, [packet(9, 60_000, a="10.7.7.7", **U)]], DEFAULT, lateness)
    f = sessions.state_to_flows(flows.where("flow_key like '10.0.0%'")).first()
    assert (f.packet_count, f.first_seen_ms, f.last_seen_ms) == (2, 1000, 3000)
    assert (f.inter_arrival_time_min, f.inter_arrival_time_max) == (2000, 2000)


def run_stream(spark, steps, rules, lateness, folders):
    source, out, cp = folders
    for rows in steps:
        spark.createDataFrame(rows, COLUMNS).write.mode("append").parquet(source)
        packets = spark.readStream.schema(COLUMNS).parquet(source)
        jobs.run_available(sessions.stream_sessionize(packets, rules, lateness), out, cp)


@pytest.mark.parametrize("lateness", [0, 5])
def test_state_is_empty_when_all_flows_have_closed(spark, lateness):
    folders = [shared_folder(spark, n) for n in ("src", "out", "cp")]
    rules = FlowRules(same(10), same(25), 40)
    rows = sorted(histories(31, keys=15), key=lambda r: r[2])
    steps = [rows[:len(rows) // 2], rows[len(rows) // 2:]]
    run_stream(spark, steps, rules, lateness, folders)
    # A packet of far later times closes all; it is the only one left.
    run_stream(spark, [[packet(10 ** 6, 10 ** 9, a="10.250.0.1", **U)]], rules, lateness, folders)
    left = [r.flow_key for r in sessions.live_flows(spark, folders[2]).collect()]
    assert left == ([] if lateness else ["10.0.0.2_10.250.0.1_80_1000_UDP"])
    def state(option, value):
        return spark.read.format("statestore").option("path", folders[2]).option(option, value).load()

    assert state("stateVarName", "early").count() == (1 if lateness else 0)
    assert state("readRegisteredTimers", True).count() == 1
    closed = sorted((f.flow_key, f.first_ms, f.last_ms, f.n, f.bytes) for f in jobs.read_batches(spark, folders[1]).collect())
    assert closed == sorted(f[:5] for f in flows_of(rows, 10, 25))


@pytest.mark.parametrize("lateness", [0, 300])
def test_a_hot_key_in_many_chunks(spark, monkeypatch, lateness):
    """All packets of one key, out of order, in Arrow batches of 50 rows; pieces are cut and taken out in order."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    monkeypatch.setattr(sessions, "PIECE_ROWS", 4)
    try:
        rnd = random.Random(5)
        ts, rows = 0, []
        for i in range(1500):
            ts += rnd.choice([0, 0, 1, 2, 5, 30])
            rows.append(packet(i, ts, length=60 + i % 9, flags=rnd.choice(["", "A", "R", "S"])))
        near = [rows[i] for i in sorted(range(len(rows)), key=lambda i: i + rnd.randrange(40))]
        end = [packet(10 ** 6, 10 ** 8, a="10.250.0.1", **U)]
        folders = [shared_folder(spark, n) for n in ("src", "out", "cp")]
        steps = [near[:700], near[700:], end, [packet(10 ** 6 + 1, 10 ** 8 + 1, a="10.250.0.1", **U)]] if lateness else [near, end]
        run_stream(spark, steps, FlowRules(same(25), same(200), 40), lateness, folders)
        got = jobs.read_batches(spark, folders[1]).where("flow_key like '10.0.0.1%'").collect()
        want = [f[:5] for f in flows_of(rows, 25, 200)]
        assert sorted((f.flow_key, f.first_ms, f.last_ms, f.n, f.bytes) for f in got) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_packets_and_flows_travel_packed():
    import numpy as np
    import pandas as pd
    rows = np.zeros(9, sessions.PACKET)
    rows["packet_id"] = np.arange(9)
    pdf = pd.DataFrame({c: rows[c] for c in sessions.PACKET.names}).assign(flow_key=list("abacbaabc"))
    packed = next(sessions.pack_packets(iter([pdf])))
    back = {k: np.frombuffer(b, sessions.PACKET)["packet_id"].tolist() for k, b in zip(packed["flow_key"], packed["packets"])}
    assert back == {"a": [0, 2, 5, 6], "b": [1, 4, 7], "c": [3, 8]}
    flow, closed = {**sessions._new_flow(), "n": 7, "sumsq": 0.5, "acked0": True}, []
    sessions.FlowProcessor._end("k", flow, sessions.AGE, closed)
    row = next(sessions.FlowProcessor._rows("k", closed))
    out = next(sessions.unpack_flows(iter([pd.DataFrame([row.asDict()])])))
    assert out.to_dict("records") == [{"flow_key": "k", **flow, "end_reason": sessions.AGE}]


def test_a_key_in_chunks_has_no_other_flows(spark, monkeypatch):
    monkeypatch.setattr(sessions, "CHUNK_ROWS", 50)
    test_a_hot_key_in_many_chunks(spark, monkeypatch, 300)


def test_pieces_keep_all_packets_in_order():
    import numpy as np
    rng = np.random.default_rng(3)
    rows = np.zeros(3000, sessions.PACKET)
    rows["ts_ms"], rows["packet_id"] = np.sort(rng.integers(0, 900, 3000)), np.arange(3000)
    parts = sessions.pieces(rows, 50)
    assert (np.concatenate(parts) == rows).all() and min(map(len, parts[:-1])) >= sessions.PIECE_ROWS
    assert all(a["ts_ms"][-1] // 50 < b["ts_ms"][0] // 50 for a, b in zip(parts, parts[1:]))
    assert sessions.pieces(rows[:0], 50) == []


def test_changed_flows_between_batches(spark):
    setting = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
    spark.conf.set(setting, "true")
    try:
        folders = [shared_folder(spark, n) for n in ("src", "out", "cp")]
        rules = FlowRules(same(1000), same(10 ** 6), 10 ** 5)
        first = [packet(0, 0, a="10.1.0.1", **U), packet(1, 0, a="10.1.0.2", **U), packet(2, 0, a="10.1.0.3", **U)]
        run_stream(spark, [first], rules, 0, folders)
        before = jobs.last_batch(spark, folders[2])
        # One grows, one is new, one ends by its own next packet and begins again, one is left as it is.
        run_stream(spark, [[packet(3, 900, a="10.1.0.1", **U), packet(4, 900, a="10.1.0.4", **U)]], rules, 0, folders)
        middle = jobs.last_batch(spark, folders[2])
        got = {r.flow_key.split("_")[1]: (r.live, r.n) for r in
               sessions.changed_flows(spark, folders[2], before + 1, middle).collect()}
        assert got == {"10.1.0.1": (True, 2), "10.1.0.4": (True, 1)}
        run_stream(spark, [[packet(5, 1500, a="10.1.0.1", **U)]], rules, 0, folders)
        got = {r.flow_key.split("_")[1]: (r.live, r.n) for r in
               sessions.changed_flows(spark, folders[2], middle + 1, jobs.last_batch(spark, folders[2])).collect()}
        assert got == {"10.1.0.1": (True, 3), "10.1.0.2": (False, None), "10.1.0.3": (False, None)}
    finally:
        spark.conf.unset(setting)


def test_a_job_that_dies_before_the_commit_adds_and_loses_nothing(spark, monkeypatch):
    from tidewire.streaming import commits
    source, out, cp, cp2 = (shared_folder(spark, n) for n in ("src", "out", "cp", "cp"))
    spark.range(60).repartition(3).write.parquet(source)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    whole, died = commits.commit, []

    def dies(spark, path, query, batch_id, attempt):
        # Once before the commit and once after it.
        if batch_id == 1 and len(died) < 2:
            died.append(query)
            if len(died) == 2:
                whole(spark, path, query, batch_id, attempt)
            raise RuntimeError("lost")
        whole(spark, path, query, batch_id, attempt)

    monkeypatch.setattr(commits, "commit", dies)
    for _ in range(2):
        with pytest.raises(Exception):
            jobs.run_available(stream, out, cp)
        half = [r.id for r in jobs.read_batches(spark, out).collect()]
        assert len(half) == len(set(half)) and 20 * len(died) == len(half)
    jobs.run_available(stream, out, cp)
    assert sorted(r.id for r in jobs.read_batches(spark, out).collect()) == list(range(60))
    assert len(set(died)) == 1 and died[0] != "batch"
    # Another stream into the same folder counts its batches for itself.
    jobs.run_available(stream, out, cp2)
    assert jobs.read_batches(spark, out).count() == 120


def test_a_stream_keeps_few_stores(spark, tmp_path):
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.createDataFrame([packet(i, i) for i in range(5)], COLUMNS).write.parquet(source)
    before = spark.conf.get(jobs.PARTITIONS)
    try:
        spark.conf.set(jobs.PARTITIONS, "200")
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        jobs.run_available(sessions.stream_sessionize(stream), out, cp)
        assert spark.conf.get(jobs.PARTITIONS) == "200"
    finally:
        spark.conf.set(jobs.PARTITIONS, before)
    stores = [f for f in (tmp_path / "cp" / "state" / "0").iterdir() if f.name.isdigit()]
    assert len(stores) == jobs.STORES_PER_CORE * spark.sparkContext.defaultParallelism
    assert sessions.live_flows(spark, cp).count() == 1


def test_flow_files_grow_in_number_and_not_in_size(spark, monkeypatch):
    from tidewire.plans import stream_queries
    rows = shared_folder(spark, "rows")
    spark.range(4000).repartition(3).write.parquet(rows)
    rows = spark.read.parquet(rows)
    assert stream_queries.flow_files(rows)[1] == 1
    monkeypatch.setattr(stream_queries, "FILE_BYTES", 500)
    path, files = stream_queries.flow_files(rows)
    back = spark.read.parquet(path)
    assert files > 1 and len(back.inputFiles()) == 4 * files and back.distinct().count() == 4000
