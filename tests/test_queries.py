"""Registered queries against their SQL at the smallest scale.

All of them run with TIDEWIRE_ALL=1 (about ten minutes); otherwise a part that touches each module."""

from __future__ import annotations

import os
import random

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

SF = "/root/testdata/sf0.001"
PART = ["top_talkers", "packet_summaries", "decode_frames", "quarantine_malformed", "enrich_flows", "feature_diff",
        "score_percentiles", "stratified_split", "best_f1_threshold", "roc_pr_auc", "scan_pcap", "write_flows",
        "stream_malformed", "at_least_once_sink", "end_of_input_flush"]
NAMES = list(entry.queries()) if os.environ.get("TIDEWIRE_ALL") else PART


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name in entry.oracle_sql():
        assert check.compare(got, check.connect(SF).execute(entry.oracle_sql()[name]).df()) is None
    else:
        assert len(got)


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_numbers_of_odd_events(spark, tmp_path):
    rows = [(None, 1.5, "view"), (None, None, None), (-1, 2.5, "view"), (-2, None, "view"), (-6, 2.5, "view"), (0, 3.0, "view"),
            (1, None, "view"), (1, 4.0, "view"), (7, float("inf"), "view"), (13, 1e-7, "view"), (2, 1.0, "view"),
            (3, 1.0, "view"), (4, 1.0, "12"), (4, 1.0, None), (5, 1.0, "view")]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "event_id long, value double, event_type string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = entry.queries()["safe_double"](spark, str(tmp_path)).toPandas()
    assert check.compare(got, con.execute(entry.oracle_sql()["safe_double"]).df()) is None


def test_a_flow_ended_by_age_is_current_while_only_resets_follow(spark, tmp_path):
    hour, rng = 3_600_000, random.Random(5)
    aged = [(h, "view") for h in (662, 672, 682, 692, 702, 709)]
    # Ended by age, then a reset; a reset and a live flow; two resets; longer ago than the idle limit. The last sets the time.
    own = {0: [*aged, (711, "error")], 1: [*aged, (711, "error"), (712, "view")], 4: [*aged, (711, "error"), (713, "error")],
           5: [(h - 12, kind) for h, kind in [*aged, (711, "error")]], 8: [(0, "view"), (720, "view")]}
    rows = [(user, h * hour, kind) for user, packets in own.items() for h, kind in packets]
    for user in range(12, 600):
        at = rng.uniform(640, 670) * hour
        while at < 720 * hour:
            rows.append((user, int(at), "error" if rng.random() < 0.3 else "view"))
            at += rng.expovariate(1 / 5) * hour
    path, start = str(tmp_path / "events.parquet"), 1_704_067_200_000
    events = [(i, user, start + at, kind, float(i % 50)) for i, (user, at, kind) in enumerate(rows)]
    spark.createDataFrame(events, "event_id long, user_id long, ms long, event_type string, value double").selectExpr(
        "event_id", "CAST(timestamp_millis(ms) AS TIMESTAMP_NTZ) AS ts", "user_id", "event_type",
        "value").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = entry.queries()["changed_current_flows"](spark, str(tmp_path)).toPandas()
    assert {u: got["packets"][got["flow_key"].str.contains(f"10[.]0[.]{u}[.]10_")].tolist() for u in own} == {
        0: [6], 1: [1], 4: [6], 5: [], 8: [1]}
    assert check.compare(got, con.execute(entry.oracle_sql()["changed_current_flows"]).df()) is None
