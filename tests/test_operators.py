"""Ordered helpers, lookups, density, captures, decoding, splits and scores against brute force."""

from __future__ import annotations

import ipaddress
import math
import os
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.functions.addresses import ip_sort_key, is_valid_ip, normalize_ip
from tidewire.functions.decode import decode_frames, ip_packets
from tidewire.functions.risk import max_severity, risk_labels
from tidewire.functions.text import safe_double
from tidewire.operators import compare, enrich, ml_eval, ml_models, ml_prep, rollups
from tidewire.operators.ordered import exact_percentiles, sliced_rank
from tidewire.plans.inputs import RISKS
from tidewire.session import shared_folder
from tidewire.sources import captures, readers, sinks

SF = "/root/testdata/sf0.001"


def test_sliced_rank_on_one_hot_group(spark):
    rnd = random.Random(1)
    values = rnd.sample(range(100_000), 3000)
    df = spark.createDataFrame([("hot", v) for v in values] + [("cold", 5)], "k string, v long")
    got = sliced_rank(df.withColumn("s", F.floor(F.col("v") / 700)), ["k"], "s", ["v"], "r").where("k = 'hot'")
    order = {v: i for i, v in enumerate(sorted(values))}
    assert {r.v: r.r for r in got.collect()} == order


def test_exact_percentiles_with_heavy_ties(spark):
    rnd = np.random.default_rng(2)
    data = np.concatenate([np.full(2000, 3.5), rnd.lognormal(0, 5, 1500), [-1e9, 1e12]])
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    df = spark.createDataFrame([("a", float(x)) for x in data] + [("b", float(i)) for i in range(10)], "k string, x double")
    got = {(r.k, r.p): r.value for r in exact_percentiles(df, "x", probs, keys=["k"]).collect()}
    for p in probs:
        assert got["a", p] == pytest.approx(np.quantile(data, p), rel=1e-9)
        assert got["b", p] == pytest.approx(np.quantile(np.arange(10.0), p))


def test_range_lookup_v4_and_v6(spark):
    rnd = random.Random(3)
    edges = sorted(rnd.sample(range(1 << 32), 400))
    ranges = [(str(ipaddress.ip_address(a)), str(ipaddress.ip_address(b)), f"r{i}")
              for i, (a, b) in enumerate(zip(edges[::2], edges[1::2]))]
    ranges += [("2001:db8::", "2001:db8:0:ffff::", "v6")]
    ips = [str(ipaddress.ip_address(rnd.randrange(1 << 32))) for _ in range(500)] + [r[0] for r in ranges] + [
        r[1] for r in ranges] + ["2001:db8:0:5::1", "2001:db8:1::", "2001:db9::1"]
    table = spark.createDataFrame(ranges, "start_ip string, end_ip string, country string")
    got = {r.ip: r.country for r in enrich.range_lookup(
        spark.createDataFrame([(i,) for i in set(ips)], "ip string"), table, "country").collect()}

    def want(ip):
        at = ipaddress.ip_address(ip)
        for a, b, name in ranges:
            lo, hi = ipaddress.ip_address(a), ipaddress.ip_address(b)
            if lo.version == at.version and lo <= at <= hi:
                return name
        return None

    assert got == {ip: want(ip) for ip in set(ips)}


def test_country_answers(spark):
    geo = spark.createDataFrame([("8.8.8.0", "8.8.8.255", "X")], "start_ip string, end_ip string, country string")
    ips = spark.createDataFrame([("8.8.8.8",), ("10.1.1.1",), ("9.9.9.9",), ("host",)], "ip string")
    got = {r.ip: r.country for r in enrich.enrich_country(ips, geo).collect()}
    assert got == {"8.8.8.8": "X", "10.1.1.1": "Private IP", "9.9.9.9": "Private IP", "host": "Invalid IP"}


def test_whois_double_parse(spark):
    ips = spark.createDataFrame([("a", "RANGE"), ("b", "RANGE")], "ip string, asn_org string")
    whois = spark.createDataFrame([("a", "OrgName: Org A")], "ip string, raw string")
    def orgs(**k):
        return {r.ip: r.org for r in enrich.enrich_whois_org(ips, whois, **k).collect()}
    assert orgs() == {"a": "Org A", "b": "RANGE"}
    assert orgs(double_parse=True)["a"] == "RANGE"


def test_density_noise_against_all_pairs(spark):
    rnd = np.random.default_rng(5)
    points = np.vstack([rnd.normal(0, 0.1, (300, 2)), rnd.uniform(-4, 4, (250, 2)), np.repeat([[3.9, 3.9]], 4, axis=0)])
    near = ((points[:, None, :] - points[None, :, :]) ** 2).sum(-1) <= 0.25
    core = near.sum(1) >= 5
    want = ~core & ~(near & core[None, :]).any(1)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, x double, y double")
    got = {r.id: r.noise for r in ml_models.density_noise(df, ["id"], "x", "y").collect()}
    assert [got[i] for i in range(len(points))] == want.tolist() and 0 < want.sum() < len(points)


def test_isolation_forest_finds_the_far_rows(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, *map(float, rnd.normal(0, 1, 3))) for i in range(400)] + [(400 + i, 30.0, -30.0, 30.0 + i) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    forest = ml_models.fit_isolation_forest(df, ["id"], ["a", "b", "c"], trees=40, contamination=0.0075)
    flagged = {r.id for r in forest.label(forest.score(df)).where("sign = -1").collect()}
    assert {400, 401, 402} <= flagged and len(flagged) <= 5


def test_isolation_cuts_leave_rows_on_both_sides():
    for low, high in ((1.0, float(np.nextafter(1.0, 2.0))), (-1.7e308, 1.7e308)):
        for tree in range(8):
            rows = pd.DataFrame({"tree": [tree] * 2, "slot": [0, 1], "x": [[low], [high]]})
            grown = ml_models._grow_tree(rows, 42)
            assert low <= grown["cut"][0] < high and grown["depth"].tolist() == [0.0, 1.0, 1.0]


def test_split_has_exact_shares(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "m").otherwise("b").alias("label"))
    once = ml_prep.stratified_split(df, ["id"], "label")
    assert {(r.label, r.part): r["count"] for r in once.groupBy("label", "part").count().collect()} == {
        ("m", "train"): 70, ("m", "test"): 30, ("b", "train"): 630, ("b", "test"): 270}
    again = ml_prep.stratified_split(df.repartition(7), ["id"], "label")
    assert once.exceptAll(again).isEmpty()


def test_bounded_sample_is_exact(spark):
    df = spark.range(5000)
    assert ml_prep.bounded_sample(df, ["id"], 700).count() == 700
    assert ml_prep.bounded_sample(df, ["id"], 9000).count() == 5000


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double")
    assert math.isnan(ml_eval.roc_pr_auc(df, "y", "s").first().roc_auc)


def _cap(records, magic=0xA1B2C3D4, order="<", unit=1000):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for ms, data in records:
        out += struct.pack(order + "IIII", ms // 1000, ms % 1000 * unit + unit // 2, len(data), len(data)) + data
    return out


def test_captures_in_both_orders_and_cut_short(spark, tmp_path):
    rnd = random.Random(8)
    records = [(1_700_000_000_000 + i, bytes(rnd.randrange(256) for _ in range(rnd.randrange(0, 80)))) for i in range(500)]
    (tmp_path / "a.pcap").write_bytes(_cap(records))
    (tmp_path / "b.pcap").write_bytes(_cap(records, 0xA1B23C4D, ">", 1_000_000))
    (tmp_path / "c.pcap").write_bytes(_cap(records) + b"\1" * 20)
    rows = captures.read_captures(spark, str(tmp_path), split_bytes=1000).collect()
    for name in "abc":
        mine = sorted((r.idx, r.ts_ms, bytes(r.frame)) for r in rows if r.file.endswith(f"{name}.pcap"))
        assert mine == [(i, ms, data) for i, (ms, data) in enumerate(records)]
    merged = captures.merge_captures(spark, str(tmp_path)).limit(3).collect()
    assert [r.file[-6] for r in merged] == ["a", "b", "c"]


def _v4(proto, payload, total=None, frag=0, ihl=5):
    size = ihl * 4 + len(payload) if total is None else total
    head = bytes([0x40 | ihl, 0]) + struct.pack(">HHHBBH", size, 0, frag, 64, proto, 0) + bytes([1, 2, 3, 4, 5, 6, 7, 8])
    return bytes(12) + b"\x08\x00" + head + bytes(max(0, ihl - 5) * 4) + payload


def _v6(kind, payload):
    return bytes(12) + b"\x86\xdd" + bytes([0x60, 0, 0, 0]) + struct.pack(">HBB", len(payload), kind, 64) + (
        ipaddress.ip_address("2001:db8::1").packed + ipaddress.ip_address("fe80::ab").packed) + payload


TCP = struct.pack(">HHIIBB", 1000, 80, 7, 8, 0x50, 0x12) + bytes(6)


def test_decode_odd_frames(spark):
    cases = {
        0: _v4(6, TCP), 1: _v4(6, TCP, ihl=7), 2: _v4(6, TCP, frag=0x2000), 3: _v4(6, TCP[:10]), 4: _v4(6, TCP, ihl=2),
        5: _v6(6, TCP), 6: _v6(0, bytes([6, 0]) + bytes(6) + TCP), 7: _v6(44, bytes([6, 0, 0, 0]) + bytes(4) + TCP),
        8: bytes(10), 9: bytes(12) + b"\x88\xcc", 10: _v4(1, bytes([99, 0]) + bytes(6)), 11: _v4(6, TCP, total=10),
        12: _v6(60, bytes([0, 120]) + bytes(966) + bytes([6, 0]) + bytes(6) + TCP),
        13: _v6(60, (bytes([60, 0]) + bytes(6)) * 40 + bytes([6, 0]) + bytes(6) + TCP), 14: _v6(60, bytes([60, 0])), 15: b"",
    }
    rows = [(i, 0, bytearray(f)) for i, f in cases.items()] + [(16, 0, None)]
    df = spark.createDataFrame(rows, "packet_id long, ts_ms long, frame binary")
    got = {r.packet_id: r for r in decode_frames(df).collect()}
    assert (got[0].src_ip, got[0].dst_ip, got[0].src_port, got[0].syn, got[0].ack, got[0].fin, got[0].seq) == (
        "1.2.3.4", "5.6.7.8", 1000, True, True, False, 7)
    assert got[1].dst_port == 80 and got[1].ack_no == 8
    assert got[2].src_port is None and not got[2].syn and got[2].protocol == "TCP"
    assert got[3].src_port is None and got[3].decode_error is None
    assert got[4].decode_error == "Not an IP packet" and got[11].decode_error == "Not an IP packet"
    assert (got[5].src_ip, got[5].dst_ip, got[5].src_port) == (
        "2001:db8:0:0:0:0:0:1", "fe80:0:0:0:0:0:0:ab", 1000)
    assert got[6].src_port is None and got[6].syn and got[6].l4_kind == "TCP"
    assert got[6].protocol == "IPv6 Hop-by-Hop Option" and got[7].l4_kind == "TCP"
    assert got[12].syn and got[12].l4_kind == "TCP" and got[12].seq == 7
    assert got[13].seq == 7 and got[13].l4_kind == "TCP" and got[14].l4_kind == "OTHER" and got[14].seq is None
    assert got[15].decode_error and got[15].src_mac is None and got[16].length is None and got[16].src_ip is None
    assert got[8].decode_error and got[9].decode_error == "Unsupported EtherType: 0x88cc"
    assert got[10].protocol == "ICMPv4" and got[10].l4_kind == "OTHER"
    assert ip_packets(decode_frames(df)).where("flow_key is null").isEmpty()


def test_addresses_and_numbers(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("256.1.1.1",), ("::1",), ("2001:DB8::a",), ("x",), ("1:2:3",), ("::",),
                                ("1::2::3",), ("1:2:3:4:5:6:7:8",)], "ip string")
    got = {r.ip: (r.ok, r.n) for r in df.select("ip", is_valid_ip("ip").alias("ok"), normalize_ip("ip").alias("n")).collect()}

    def valid(text):
        try:
            return bool(ipaddress.ip_address(text))
        except ValueError:
            return False

    assert {ip: ok for ip, (ok, _) in got.items()} == {ip: valid(ip) for ip in got}
    assert got["2001:DB8::a"][1] == "2001:db8::a" and got["x"][1] == "x"
    rnd = random.Random(4)
    packed = [bytes(b for _ in range(8) for b in rnd.choice([(0, 0), (0, 0), (0, 7), (rnd.randrange(256), 0xAB)]))
              for _ in range(300)]
    texts = [str(ipaddress.IPv6Address(p)) for p in packed] + [ipaddress.IPv6Address(p).exploded.upper() for p in packed]
    texts += ["1::10.0.255.1", "::", "1:2:3:4:5:6:7::", "a b:c", ":::", "1.2.3.4", "::1.2.3.400", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", normalize_ip("t").alias("c"), normalize_ip("t", "exploded").alias("e"), ip_sort_key("t").alias("k")).collect()
    for r in rows:
        try:
            address = ipaddress.ip_address(r.t)
        except ValueError:
            assert (r.c, r.e, r.k) == (r.t, r.t, None)
            continue
        mapped = address.version == 4 and b"\0" * 10 + b"\xff\xff" or b""
        assert (r.e, r.k) == (address.exploded, (mapped + address.packed).hex())
        if address.version == 4 or address.ipv4_mapped is None:
            assert r.c == address.compressed
    nums = spark.createDataFrame([(None,), (" 3.5 ",), ("NaN",), ("-infinity",), ("x",)], "t string")
    values = [r.v for r in nums.select(safe_double("t", 9.0).alias("v")).collect()]
    assert values[:2] == [9.0, 3.5] and math.isnan(values[2]) and values[3:] == [-math.inf, 9.0]


def test_risk_masks(spark):
    df = spark.createDataFrame([(0b1010,), (0b100001,), (0,), (0b100000,)], "m long")
    got = [(r.l, r.s) for r in df.select(risk_labels("m", RISKS).alias("l"), max_severity("m", RISKS).alias("s")).collect()]
    assert got == [("TLS suspicious, Malformed packet", "High"), ("Known proto on non-std port, Unlisted", "Medium"),
                   ("No risk", "No risk"), ("Unlisted", "Unknown severity")]


def test_positional_diff_needs_equal_rows(spark):
    a = spark.range(1, 6).select(F.col("id").alias("i"), F.lit(1).alias("v"))
    row = compare.packet_positional_diff(a, a.where("i < 5"), "i", ["v"]).first()
    assert (row.rows_a, row.rows_b, row.comparable, row.accuracy) == (5, 4, False, None)


def test_latest_per_group_on_a_hot_group(spark):
    df = spark.range(5000).select(F.lit("hot").alias("g"), F.col("id").alias("t"))
    got = sorted(r.t for r in rollups.latest_per_group(df, "g", [F.col("t").desc()], 50).collect())
    assert got == list(range(4950, 5000))


def test_frame_numbers_and_limit(spark, tmp_path):
    df = spark.range(900).select(
        F.col("id").alias("packet_id"), (F.lit(1000) - F.floor(F.col("id") / 7)).alias("ts_ms"), F.lit("a").alias("src_ip"),
        F.lit("b").alias("dst_ip"), F.lit(None).cast("int").alias("src_port"), F.lit(1).alias("dst_port"), F.lit(60).alias("length"))
    got = [r.packet_id for r in sinks.numbered_packets(df, 10).orderBy("frame_no").collect()]
    assert got == [r.packet_id for r in df.orderBy("ts_ms", "packet_id").collect()]
    sinks.export_packet_csv(df, str(tmp_path / "csv"), limit=10, slice_ms=10)
    rows = readers.read_packet_csv(spark, str(tmp_path / "csv")).collect()
    assert len(rows) == 10 and {r.src_port for r in rows} == {"0"}


def test_packet_json_arrays(spark, tmp_path):
    (tmp_path / "p.json").write_text('[\n {"srcIp": "a", "dstIp": "b", "protocol": "TCP", "bytes": 5},\n'
                                     ' {"srcIp": "c", "dstIp": "d", "protocol": "UDP", "bytes": 6}\n]')
    assert [(r.srcIp, r.bytes) for r in readers.read_packet_json(spark, str(tmp_path)).collect()] == [("a", 5), ("c", 6)]


def test_replay_writes_the_same_ids(spark):
    row = spark.createDataFrame([("k", 1, 0, 5)], "flow_key string, first_seen_ms long, flow_seq long, bytes long")
    ids = {sinks.stored_flow_rows(row).first().id for _ in range(2)}
    assert len(ids) == 1 and shared_folder(spark, "x") != shared_folder(spark, "x")


def test_failures_of_enrichment_and_scoring(spark, tmp_path):
    from tidewire.plans.inputs import reference_tables
    from tidewire.streaming import jobs
    tables = reference_tables(spark)
    flows = spark.createDataFrame(
        [("k", "8.8.8.8", "10.0.0.1", "TCP", 0.1), ("m", "8.8.8.8", None, "TCP", 0.9), ("u", "x", "10.0.0.1", "UDP", None)],
        "flow_key string, src_ip string, dst_ip string, protocol string, p double")

    def score(rows):
        return rows.withColumn("probability", F.col("p"))

    jobs.enrich_and_score(tables, score)(flows, str(tmp_path / "out"))
    got = {r.flow_key: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: r.label for k, r in got.items()} == {"k": "BENIGN", "m": "MALICIOUS", "u": "UNKNOWN"}
    assert got["m"].dst_country == "N/A" and got["u"].dst_country == "Private IP"
    tables["geo"] = tables["geo"].withColumn("country", F.raise_error(F.lit("no table")).cast("string"))
    with pytest.raises(Exception, match="no table"):
        jobs.enrich_and_score(tables, score)(flows, str(tmp_path / "out2"))


def test_ranges_are_made_ready_once_for_all_batches(spark, tmp_path, monkeypatch):
    from tidewire.plans.inputs import reference_tables
    from tidewire.streaming import jobs
    made, prefixes = [], enrich.prefixes
    monkeypatch.setattr(enrich, "prefixes", lambda ranges, value: made.append(value) or prefixes(ranges, value))
    flows = spark.createDataFrame([("8.8.8.8", "172.40.0.5", "TCP", 0.1)],
                                  "src_ip string, dst_ip string, protocol string, probability double")
    write = jobs.enrich_and_score(reference_tables(spark), lambda rows: rows)
    for i in range(3):
        write(flows, str(tmp_path / f"out{i}"))
        row = spark.read.parquet(str(tmp_path / f"out{i}")).first()
        assert (row.src_country, row.dst_country, row.dst_org) == ("United States", "Canada", "ORG-D")
    assert made == ["country", "org"]


def test_a_failed_sink_is_replayed(spark, tmp_path):
    from pyspark.errors import StreamingQueryException
    from tidewire.streaming import jobs
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.range(200).repartition(4).write.parquet(source)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(source)
    failed = []

    def write(batch, path):
        jobs.overwrite_parquet(batch, path)
        if not failed:
            failed.append(path)
            raise RuntimeError("write reported as failed")

    with pytest.raises(StreamingQueryException):
        jobs.run_available(stream, out, cp, write=write)
    jobs.run_available(stream, out, cp, write=write)
    assert sorted(r.id for r in jobs.read_batches(spark, out).collect()) == list(range(200))


def test_late_samples_count(spark, tmp_path):
    from tidewire.operators.metrics import metric_rows
    from tidewire.streaming import jobs
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    samples = spark.range(300).select(
        F.when(F.col("id") % 2 == 0, "SYSTEM_CPU").otherwise("FLOW_AGGREGATION_RATE").alias("type"),
        F.when(F.col("id") % 11 > 0, F.col("id").cast("double")).alias("value"),
        F.timestamp_seconds((F.lit(1000) - F.col("id")) % 20).alias("ts"))
    for i in range(3):
        samples.where(F.floor(F.col("value").cast("long") / 100) == i).write.mode("append").parquet(source)
    stored = spark.read.parquet(source)
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.run_available(stream, out, cp, write=jobs.write_metric_sums())
    assert sorted(jobs.read_metrics(spark, out).collect()) == sorted(metric_rows(stored).collect())


def test_previous_packet_across_gaps(spark):
    idx = [3, 4, 17, 18, 95, 96, 100, 250]
    df = spark.createDataFrame([("f", i, i * i) for i in idx], "file string, idx long, ts_ms long")
    got = {r.idx: (r.delta_ms, r.replay_ms) for r in rollups.packet_delta(df, "file", "idx", slice_rows=10).collect()}
    assert got == {i: (i * i - j * j, max(1, i * i - j * j)) for j, i in zip([3, *idx], idx)}


def test_last_row_of_a_repeated_signature_counts(spark):
    a = spark.createDataFrame([("k", 1, 5.0), ("k", 2, 6.0), ("z", 1, 1.0)], "k string, t long, m double")
    b = spark.createDataFrame([("k", 9, 6.0), ("k", 3, 7.0), ("y", 1, 1.0)], "k string, t long, m double")
    assert compare.feature_diff(a, b, "k", ["m"], "t").count() == 0
    row = compare.feature_diff_summary(a, b, "k", ["m"], "t").first()
    assert (row.compared, row.differences) == (1, 0)


def test_registered_classifier_has_all_rounds(spark, monkeypatch):
    from tidewire.operators import boosting
    from tidewire.plans import inputs, ml_queries

    asked = []

    def noted(df, columns, label, ids, how, most_rows):  # notes what is asked for and trains less of it
        asked.append((how.rounds, how.depth, how.rows, how.columns))
        return boosting.fit_boosted(df, columns, label, ids, boosting.Growth(rounds=1, depth=1), most_rows)

    rows = spark.createDataFrame([(str(i), i, i % 2, "train" if i < 16 else "test") for i in range(20)],
                                 "flow_key string, flow_seq int, y int, part string")
    rows = rows.selectExpr("*", *[f"CAST(y AS DOUBLE) AS `{c}`" for c in ml_prep.MODEL_FEATURES])
    monkeypatch.setattr(ml_models, "fit_boosted", noted)
    monkeypatch.setattr(inputs, "_FITTED", {})
    monkeypatch.setattr(ml_queries, "_ruled", lambda spark, sf: rows)
    ml_queries._classifier(spark, "")
    ml_queries._classifier(spark, "")
    assert asked == [(600, 8, 0.8, 0.8)]  # once for all queries


def _plain_tree(codes, slopes, how, depth=0):
    """The same tree by trying every cut on the rows themselves."""
    g, h = slopes.sum(1)
    best = (1e-9, None)
    if depth < how.depth:
        for f in range(len(codes)):
            for cut in np.unique(codes[f])[:-1]:
                low = codes[f] <= cut
                (gl, hl), (gh, hh) = slopes[:, low].sum(1), slopes[:, ~low].sum(1)
                if hl >= how.least and hh >= how.least:
                    gain = gl ** 2 / (hl + how.shrink) + gh ** 2 / (hh + how.shrink) - g ** 2 / (h + how.shrink)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut))
    if best[1] is None:
        return np.full(codes.shape[1], -how.rate * g / (h + how.shrink))
    f, cut = best[1]
    low, out = codes[f] <= cut, np.empty(codes.shape[1])
    for side in (low, ~low):
        out[side] = _plain_tree(codes[:, side], slopes[:, side], how, depth + 1)
    return out


def test_trees_from_histograms_equal_trees_from_rows():
    from tidewire.operators import boosting

    rng = np.random.default_rng(3)
    for depth in (0, 1, 2, 4):
        codes = rng.integers(0, 12, (5, 400)).astype(np.uint8)
        y = ((codes[0] > 5) ^ (codes[3] < 4) ^ (rng.random(400) < 0.1)).astype(float)
        slopes = np.stack([0.4 - y + rng.normal(0, 0.01, 400), rng.uniform(0.2, 0.25, 400)])
        how = boosting.Growth(depth=depth)
        nodes, leaf = boosting.grow_tree(codes, slopes, how)
        assert np.allclose(nodes[leaf, 4], _plain_tree(codes, slopes, how))
        assert (leaf == boosting._walk(nodes, lambda f, at: codes[f, np.arange(400)], 400)).all()


def test_parted_rows_reach_the_leaves_of_a_walk(monkeypatch):
    from tidewire.operators import boosting
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 40, (5, 3000)).astype(np.uint8)
    y = (codes[0] % 7 > 2).astype(float)
    columns, want = codes.astype(float), np.zeros(3000)
    trees = [n for _, n in boosting.boost(codes, y, np.ones(3000), np.zeros(3000), range(12), boosting.Growth(depth=5))]
    for nodes in trees:
        want += nodes[boosting._walk(nodes, lambda f, at: columns[f, np.arange(3000)], 3000), 4]
    for per_node in (0, 10 ** 9):
        monkeypatch.setattr(boosting, "ROWS_PER_NODE", per_node)
        got = np.zeros(3000)
        for nodes in trees:
            boosting._add_leaves(nodes, columns, got)
        assert (got == want).all()
    # What growth moves on equals a walk of all rows.
    margin = np.zeros(3000)
    assert len(list(boosting.boost(codes, y, np.ones(3000), margin, range(12), boosting.Growth(depth=5)))) == 12
    assert (margin == want).all()


def test_boosted_trees_learn_are_stored_and_score_alike(spark, tmp_path):
    from tidewire.operators import boosting

    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b), None if i % 50 == 0 else float(c), int((a > 3) != (b > 2)))
            for i, (a, b, c) in enumerate(zip(rng.integers(0, 8, 900), rng.integers(0, 6, 900), rng.normal(size=900)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y int").repartition(3)
    how = boosting.Growth(rounds=30, rate=0.3, columns=1.0)
    model = boosting.fit_boosted(df, ["a", "b", "c"], "y", ["id"], how)
    assert len(model.trees) == 30 and all(len(t) <= 511 for t in model.trees)
    scored = df.withColumn("p", model.probability(df.a, df.b, df.c)).collect()
    assert sum((r.p >= 0.5) == (r.y == 1) for r in scored) == 900
    model.save(spark, str(tmp_path / "m"))
    again = boosting.BoostedTrees.load(spark, str(tmp_path / "m"))
    assert again.columns == model.columns
    assert {r.id: r.p for r in df.withColumn("p", again.probability(df.a, df.b, df.c)).collect()} == {r.id: r.p for r in scored}
    weights = model.importances()
    assert abs(sum(weights.values()) - 1) < 1e-9 and min(weights["a"], weights["b"]) > weights["c"]
    same = boosting.fit_boosted(df.repartition(5), ["a", "b", "c"], "y", ["id"], how)
    assert all(np.array_equal(x, y) for x, y in zip(model.trees, same.trees))  # order and files of the rows do not matter
    few = boosting.fit_boosted(df, ["a", "b", "c"], "y", ["id"], boosting.Growth(rounds=2), most_rows=40)
    assert len(few.trees) == 2
    assert boosting.fit_boosted(df.limit(0), ["a"], "y", ["id"], boosting.Growth(rounds=2)).trees == []


def test_ranges_of_any_length(spark):
    import ipaddress
    import random

    rng, taken, ranges = random.Random(6), [], []
    for i in range(120):
        bits = rng.choice([3, 8, 13, 20, 31, 60, 100, 127, 128])
        low = rng.getrandbits(bits) << (128 - bits)
        high = min(2 ** 128 - 1, low + rng.choice([0, 1, 6, 2 ** (128 - bits) - 1, rng.getrandbits(129 - bits)]))
        if low >> 32 != 0xFFFF and all(high < a or b < low for a, b in taken):
            taken.append((low, high))
            ranges.append((str(ipaddress.IPv6Address(low)), str(ipaddress.IPv6Address(high)), f"six{i}"))
    four = []
    for i in range(60):
        low = rng.getrandbits(32)
        high = min(2 ** 32 - 1, low + rng.choice([0, 5, 255, 2 ** 16, 2 ** 26]))
        if all(high < a or b < low for a, b, _ in four):
            four.append((low, high, f"four{i}"))
    ranges += [(str(ipaddress.IPv4Address(a)), str(ipaddress.IPv4Address(b)), v) for a, b, v in four]
    asked = {}
    for a, b, v in ranges:
        for at in {0, 1, -1}:
            for end in (a, b):
                ip = ipaddress.ip_address(end)
                if 0 <= int(ip) + at < 2 ** ip.max_prefixlen:
                    asked[str(type(ip)(int(ip) + at))] = None
    for ip in asked:
        n = ipaddress.ip_address(ip)
        asked[ip] = next((v for a, b, v in ranges if type(n) is type(ipaddress.ip_address(a))
                          and ipaddress.ip_address(a) <= n <= ipaddress.ip_address(b)), None)
    got = enrich.range_lookup(spark.createDataFrame([(ip,) for ip in asked] + [("no address",), (None,)], "ip string"),
                              spark.createDataFrame(ranges + [(None, "1.1.1.1", "x"), ("bad", "1.1.1.1", "x")],
                                                    "start_ip string, end_ip string, country string"), "country")
    assert {r.ip: r.country for r in got.collect()} == asked
    nested = spark.createDataFrame([("10.0.0.0", "10.255.255.255", "wide"), ("10.1.0.0", "10.1.255.255", "narrow"),
                                    ("10.1.0.0", "10.1.255.255", "a twin")], "start_ip string, end_ip string, country string")
    got = enrich.range_lookup(spark.createDataFrame([("10.1.2.3",), ("10.2.0.0",)], "ip string"), nested, "country")
    assert {r.ip: r.country for r in got.collect()} == {"10.1.2.3": "narrow", "10.2.0.0": "wide"}
    assert got.where("country = 'none'").count() == 0
    assert enrich.range_lookup(got.select("ip"), nested.limit(0), "country").where("country is not null").count() == 0


def test_prefixes_are_spelled_in_whole_digits():
    low = int(ipaddress.ip_address("2001:db8::"))
    rows = [(f"{low >> n << n:032x}", f"{(low >> n << n) + (1 << n) - 1:032x}", str(n)) for n in range(129)]
    out = next(enrich._cover(iter([pd.DataFrame(rows, columns=["start", "end", "value"])])))
    assert out["digits"].nunique() == 33 and (out["prefix"].str.len() == out["digits"]).all()
    assert out.groupby("value").size().max() == 8
    for n, block in out.groupby(out["value"].astype(int)):
        assert (block["bits"] == 128 - n).all()
        starts = sorted(int(p.ljust(32, "0"), 16) for p in block["prefix"])
        assert starts[0] == low >> n << n and len(starts) * (1 << (128 - 4 * int(block["digits"].iloc[0]))) == 1 << n


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", ["reconstruction_anomaly", "pca_2d", "isolation_scores"])
def test_flows_are_prepared_once(spark, monkeypatch, name):
    from tidewire.plans import QUERIES, ml_queries
    seen = spark.sparkContext.accumulator(0)

    def count(size):
        seen.add(1)
        return size

    flows = ml_queries.stored_flows(spark, SF)
    counted = flows.withColumn("bytes", F.udf(count, "long").asNondeterministic()("bytes"))
    monkeypatch.setattr(ml_queries, "stored_flows", lambda spark, sf: counted)
    rows = QUERIES[name](spark, "").collect()
    assert len(rows) == flows.count() and seen.value == len(rows)


def test_reconstruction_error_by_hand(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 5)) + rng.normal(size=(60, 5)) / 10
    names = list("abcde")
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *names])
    got = {r.i: r.error for r in ml_models.reconstruction_error(df.where("i < 40"), df, names, k=2).collect()}
    centered = x - x[:40].mean(axis=0)
    parts = np.linalg.svd(centered[:40])[2][:2]
    wanted = ((centered - centered @ parts.T @ parts) ** 2).mean(axis=1)
    assert np.allclose([got[i] for i in range(60)], wanted, rtol=1e-9)
