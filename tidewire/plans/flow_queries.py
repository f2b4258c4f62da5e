"""Queries over flows: building them, rollups, enrichment, comparison and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions.addresses import normalize_ip
from tidewire.functions.keys import flow_signature
from tidewire.functions.risk import highest_severity
from tidewire.functions.text import format_ts_ms, row_contains
from tidewire.operators import compare, enrich, rollups
from tidewire.operators.features import FEATURES, flow_lists, flows_with_features
from tidewire.operators.ml_prep import BASE_FEATURES, label_by_ip
from tidewire.operators.sessionize import assign_packets, class_of, sessionize_flows
from tidewire.functions.keys import packet_label
from tidewire.plans.checks import PACKETS, sql
from tidewire.plans.inputs import (
    ATTACKERS, EVENT_RULES, first_tool, labelled_flows, packets, reference_tables, risky_flows, second_tool, stored_flows,
    table)
from tidewire.plans.registry import query, r6, text
from tidewire.session import shared_folder
from tidewire.sources import sinks

DOUBLES = ["mean_packet_length", "stddev_packet_length", "bytes_per_second", "packets_per_second",
           "ratio_bytes_up_down", "ratio_packets_up_down", "flow_symmetry", "inter_arrival_time_mean",
           "inter_arrival_time_stddev", "tcp_fraction", "udp_fraction", "other_fraction", "syn_rate", "fin_rate",
           "rst_rate", "ack_rate", "psh_rate"]
FLOW_ID = ["flow_key", "flow_seq"]
# Gaps of hours have deviations of 1e7: fewer digits are exact there.
DIGITS = {"inter_arrival_time_stddev": 2, "inter_arrival_time_mean": 3}


def _features_sql(source: str = "flows") -> str:
    shown = ", ".join(f"round({c}, {DIGITS.get(c, 6)}) AS {c}" if c in DOUBLES else c for c in FEATURES)
    return f"SELECT flow_key, flow_seq, {shown} FROM {source}"


@query("top_talkers", sql("flows", """
SELECT src_ip, dst_ip, protocol, end_reason, count(*) AS flows, sum(bytes)::BIGINT AS bytes,
  sum(packet_count)::BIGINT AS packets, sum(duration_ms)::BIGINT AS duration_ms FROM flows GROUP BY ALL"""))
def top_talkers(spark, sf):
    flows = flows_with_features(packets(spark, sf), EVENT_RULES)
    return flows.groupBy("src_ip", "dst_ip", "protocol", "end_reason").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("bytes").alias("bytes"), F.sum("packet_count").alias("packets"),
        F.sum("duration_ms").alias("duration_ms"))


@query("sessionize_flows", sql("flows", """
SELECT flow_key, flow_seq, src_ip, dst_ip, coalesce(src_port::VARCHAR, 'none') AS src_port,
  coalesce(dst_port::VARCHAR, 'none') AS dst_port, protocol, first_seen_ms, last_seen_ms, end_reason,
  packet_count, bytes FROM flows ORDER BY flow_key, flow_seq"""))
def _(spark, sf):
    return sessionize_flows(packets(spark, sf), EVENT_RULES).select(
        "flow_key", "flow_seq", "src_ip", "dst_ip", text("src_port"), text("dst_port"), "protocol",
        "first_seen_ms", "last_seen_ms", "end_reason", F.col("n").alias("packet_count"), "bytes")


@query("flow_features", sql("flows", _features_sql()))
def _(spark, sf):
    flows = flows_with_features(packets(spark, sf), EVENT_RULES)
    return flows.select("flow_key", "flow_seq", *[
        F.round(c, DIGITS.get(c, 6)).alias(c) if c in DOUBLES else F.col(c) for c in FEATURES])


@query("assign_packets", sql("placed", "SELECT packet_id, flow_key, flow_seq FROM placed"))
def _(spark, sf):
    rows = packets(spark, sf)
    return assign_packets(rows, sessionize_flows(rows, EVENT_RULES), EVENT_RULES).select(
        "packet_id", "flow_key", "flow_seq")


# Lists of a flow go on in parts; the part belongs to the key of their rows.
_PARTS = """parts AS (SELECT *, ((row_number() OVER (PARTITION BY flow_key, flow_seq ORDER BY rn) - 1) // 10000)::BIGINT
  AS part FROM placed)"""


@query("packet_summaries", sql("placed", """
SELECT flow_key, flow_seq, part, string_agg(concat_ws('_', 'P', src_ip, dst_ip, protocol,
  CASE WHEN rst THEN 'RST' WHEN fin THEN 'FIN' WHEN syn THEN 'SYN' WHEN ack THEN 'ACK' ELSE '' END,
  ts_ms::VARCHAR), ',' ORDER BY rn) AS summaries FROM parts GROUP BY flow_key, flow_seq, part""", _PARTS))
def _(spark, sf):
    lists = flow_lists(packets(spark, sf), EVENT_RULES, packet_label(), "summary")
    return lists.select(*FLOW_ID, "part", F.array_join("summary", ",").alias("summaries"))


_DELAYS = """delays AS (SELECT flow_key, flow_seq, max(ts_ms) AS last_seen_ms,
  string_agg((60 - packet_id % 50)::VARCHAR, ',' ORDER BY rn) AS delays, avg(60 - packet_id % 50) AS mean_delay
  FROM placed GROUP BY flow_key, flow_seq)"""


def _delayed(spark, sf):
    return packets(spark, sf).withColumn("delay", (F.lit(60) - F.col("packet_id") % 50).cast("long"))


@query("flow_treatment_delays", sql("placed", """
SELECT flow_key, flow_seq, part, string_agg((60 - packet_id % 50)::VARCHAR, ',' ORDER BY rn) AS delays,
  round(any_value(mean_delay), 6) AS mean_delay
FROM parts JOIN (SELECT flow_key, flow_seq, mean_delay FROM delays) USING (flow_key, flow_seq)
GROUP BY flow_key, flow_seq, part""", _DELAYS, _PARTS))
def _(spark, sf):
    lists = flow_lists(_delayed(spark, sf), EVENT_RULES, F.col("delay"), "delay")
    # The mean of a flow is the mean over all its parts.
    per_part = lists.select(*FLOW_ID, "part", F.array_join("delay", ",").alias("delays"),
                            F.aggregate("delay", F.lit(0).cast("long"), lambda a, x: a + x).alias("s"),
                            F.size("delay").alias("k"))
    means = per_part.groupBy(*FLOW_ID).agg((F.sum("s") / F.sum("k")).alias("mean_delay"))
    return per_part.join(means, FLOW_ID).select(*FLOW_ID, "part", "delays", r6("mean_delay").alias("mean_delay"))


@query("stored_flow_lists", sql("placed", """
SELECT flow_key, flow_seq, part, string_agg(concat_ws('_', 'P', src_ip, dst_ip, protocol,
  CASE WHEN rst THEN 'RST' WHEN fin THEN 'FIN' WHEN syn THEN 'SYN' WHEN ack THEN 'ACK' ELSE '' END,
  ts_ms::VARCHAR), ',' ORDER BY rn) AS "packetSummaries",
  string_agg((60 - packet_id % 50)::VARCHAR, ',' ORDER BY rn) AS "treatmentDelay"
FROM parts GROUP BY flow_key, flow_seq, part""", _PARTS))
def _(spark, sf):
    # Packets are taken in up to 49 ms after their time and are done with 60 ms after it.
    rows = packets(spark, sf).withColumn("ingested_at_ms", F.col("ts_ms") + F.col("packet_id") % 50)
    path = shared_folder(spark, "flow-lists")
    sinks.stored_flow_lists(rows, EVENT_RULES, F.col("ts_ms") + 60).write.parquet(path)
    return spark.read.parquet(path).select(
        *FLOW_ID, "part", F.array_join("packetSummaries", ",").alias("packetSummaries"),
        F.array_join(F.col("treatmentDelay").cast("array<string>"), ",").alias("treatmentDelay"))


@query("live_delay_mean", sql("placed", """
SELECT count(*) AS flows, round(avg(mean_delay), 6) AS mean_delay
FROM (SELECT * FROM delays ORDER BY last_seen_ms DESC, flow_key, flow_seq LIMIT 30)""", _DELAYS))
def _(spark, sf):
    rows = _delayed(spark, sf)
    placed = assign_packets(rows, sessionize_flows(rows, EVENT_RULES), EVENT_RULES)
    delays = placed.groupBy(*FLOW_ID).agg(F.max("ts_ms").alias("last_seen_ms"), F.avg("delay").alias("mean_delay"))
    return rollups.live_delay_mean(delays).withColumn("mean_delay", r6("mean_delay"))


@query("inter_arrival", sql("placed", """
SELECT flow_key, flow_seq, packet_id, coalesce(gap, -1) AS gap_ms FROM placed"""))
def _(spark, sf):
    from pyspark.sql import Window
    rows = packets(spark, sf)
    placed = assign_packets(rows, sessionize_flows(rows, EVENT_RULES), EVENT_RULES)
    # Inside a flow neighbours are less than the idle limit apart: slices with a copied edge see them.
    size = EVENT_RULES.slice_ms
    own = F.floor(F.col("ts_ms") / size).cast("long")
    edge = F.pmod("ts_ms", F.lit(size)) >= size - EVENT_RULES.idle(class_of(F.col("protocol")))
    w = Window.partitionBy("flow_key", "flow_seq", "slice").orderBy("ts_ms", "packet_id")
    return (
        placed.withColumn("slice", F.explode(F.when(edge, F.array(own, own + 1)).otherwise(F.array(own))))
        .withColumn("gap_ms", F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(w), F.lit(-1)))
        .where(F.col("slice") == own).select(*FLOW_ID, "packet_id", "gap_ms")
    )


# ---- projections on flows

@query("flow_defaults", sql("flows", """
SELECT first_packet_id, CASE WHEN first_packet_id % 3 = 0 THEN 1700000000000 ELSE first_seen_ms END AS first_seen_ms,
  CASE WHEN first_packet_id % 3 = 0 THEN 1700000000000 ELSE last_seen_ms END AS last_seen_ms,
  CASE WHEN first_packet_id % 3 = 1 THEN '0.0.0.0' ELSE src_ip END AS src_ip,
  CASE WHEN first_packet_id % 3 = 1 THEN 'UNKNOWN' ELSE protocol END AS protocol,
  CASE WHEN first_packet_id % 3 = 1 THEN 'N/A' ELSE flow_key END AS flow_key,
  CASE WHEN first_packet_id % 3 = 2 THEN 0 ELSE bytes END AS bytes,
  CASE WHEN first_packet_id % 3 = 0 THEN 0 ELSE duration_ms END AS duration_ms, 'N/A' AS src_country, 'N/A' AS label
FROM flows"""))
def _(spark, sf):
    from tidewire.sources.sinks import flow_defaults
    slot = F.col("first_packet_id") % 3
    sparse = stored_flows(spark, sf).select(
        "first_packet_id",
        *[F.when(slot != 0, F.col(c)).alias(c) for c in ("first_seen_ms", "last_seen_ms")],
        *[F.when(slot != 1, F.col(c)).alias(c) for c in ("src_ip", "protocol", "flow_key")],
        F.when(slot != 2, F.col("bytes")).alias("bytes"))
    return flow_defaults(sparse, now_ms=F.lit(1_700_000_000_000)).select(
        "first_packet_id", "first_seen_ms", "last_seen_ms", "src_ip", "protocol", "flow_key", "bytes",
        "duration_ms", "src_country", "label")


@query("risk_labels", sql("risky", "SELECT flow_key, flow_seq, risk_label FROM risky"))
def _(spark, sf):
    return risky_flows(stored_flows(spark, sf)).select(*FLOW_ID, "risk_label")


@query("max_severity", sql("risky", "SELECT flow_key, flow_seq, risk_severity FROM risky"))
def _(spark, sf):
    return risky_flows(stored_flows(spark, sf)).select(*FLOW_ID, "risk_severity")


_RANKS = """ranks(risk_severity, place) AS (VALUES ('Unknown severity', 0), ('Low', 1), ('Medium', 2), ('High', 3),
  ('Severe', 4), ('Critical', 5), ('Emergency', 6))"""


@query("highest_severity", sql("risky", """
SELECT src_ip, coalesce(arg_max(risk_severity, place), 'No risk') AS severity, count(*) AS flows
FROM risky LEFT JOIN ranks USING (risk_severity) GROUP BY src_ip""", _RANKS))
def _(spark, sf):
    return risky_flows(stored_flows(spark, sf)).groupBy("src_ip").agg(
        highest_severity("risk_severity").alias("severity"), F.count(F.lit(1)).alias("flows"))


@query("label_by_ip", sql("labelled", "SELECT flow_key, flow_seq, label, label AS label_by_table FROM labelled"))
def _(spark, sf):
    flows = stored_flows(spark, sf)
    default = F.when(F.col("flow_seq") % 5 == 0, "MALICIOUS").otherwise("BENIGN")
    attackers = flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).where(F.col("ip").isin(ATTACKERS))
    by_table = label_by_ip(flows, attackers, default).select(*FLOW_ID, F.col("label").alias("label_by_table"))
    return label_by_ip(flows, ATTACKERS, default).select(*FLOW_ID, "label").join(by_table, FLOW_ID)


def _signed(name: str, source: str) -> str:
    return f"""{name} AS (SELECT *, concat_ws('_', src_ip, dst_ip, coalesce(src_port, 0)::VARCHAR, coalesce(dst_port, 0)::VARCHAR,
  protocol) AS presence_key, concat_ws('_', src_ip, dst_ip, coalesce(src_port, 0)::VARCHAR, coalesce(dst_port, 0)::VARCHAR,
  protocol, strftime(make_timestamp(first_seen_ms * 1000), '%Y-%m-%d %H:%M:%S.%g')) AS feature_key FROM {source})"""


_SIGNED = _signed("signed", "flows")


def signed(flows):
    ends = {"src_ip": normalize_ip("src_ip"), "dst_ip": normalize_ip("dst_ip")}
    return flows.withColumns({
        "presence_key": flow_signature(**ends),
        "feature_key": flow_signature(**ends, first_seen=format_ts_ms("first_seen_ms"))})


@query("flow_signature", sql("flows", "SELECT flow_key, flow_seq, presence_key, feature_key FROM signed", _SIGNED))
def _(spark, sf):
    return signed(stored_flows(spark, sf)).select(*FLOW_ID, "presence_key", "feature_key")


@query("search_flows", sql("flows", """
SELECT flow_key, flow_seq FROM flows WHERE contains(lower(concat_ws(' ', flow_key, src_ip, dst_ip, protocol, end_reason,
  bytes::VARCHAR)), 'age exceeded') ORDER BY flow_key, flow_seq"""))
def _(spark, sf):
    shown = ["flow_key", "src_ip", "dst_ip", "protocol", "end_reason", "bytes"]
    return stored_flows(spark, sf).where(row_contains(shown, "AGE Exceeded")).select(*FLOW_ID)


@query("benign_only", sql("labelled", "SELECT flow_key, flow_seq, bytes FROM labelled WHERE y = 0"))
def _(spark, sf):
    return labelled_flows(stored_flows(spark, sf)).where("y = 0").select(*FLOW_ID, "bytes")


# ---- rollups

@query("severity_counts", sql("risky", """
SELECT CASE risk_severity WHEN 'No risk' THEN 'NoRisk' ELSE risk_severity END AS severity, count(*) AS flows
FROM risky GROUP BY 1"""))
def _(spark, sf):
    return rollups.severity_counts(risky_flows(stored_flows(spark, sf)))


@query("risk_counts", sql("risky", """
SELECT risk, count(*) AS flows FROM (SELECT unnest(string_split(risk_label, ', ')) AS risk FROM risky) GROUP BY 1"""))
def _(spark, sf):
    return rollups.risk_counts(risky_flows(stored_flows(spark, sf)))


@query("protocol_counts", sql("flows", """
SELECT 'flows' AS what, protocol, count(*) AS n FROM flows GROUP BY ALL
UNION ALL SELECT 'packets', protocol, count(*) FROM packets GROUP BY ALL"""))
def _(spark, sf):
    name = F.coalesce("protocol", F.lit("Unknown"))
    flows = rollups.counted(stored_flows(spark, sf), name, "protocol", "n").withColumn("what", F.lit("flows"))
    return flows.unionByName(rollups.counted(packets(spark, sf), name, "protocol", "n").withColumn(
        "what", F.lit("packets")))


@query("latest_flows_per_severity", sql("risky", """
SELECT risk_severity, last_seen_ms, flow_key, flow_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY risk_severity ORDER BY last_seen_ms DESC, flow_key, flow_seq) AS k FROM risky)
WHERE k <= 1000"""))
def _(spark, sf):
    flows = risky_flows(stored_flows(spark, sf)).select("risk_severity", "last_seen_ms", *FLOW_ID)
    return rollups.latest_per_group(
        flows, "risk_severity", [F.col("last_seen_ms").desc(), F.col("flow_key"), F.col("flow_seq")])


@query("current_flows_by_recency", sql("flows", """
SELECT flow_key, flow_seq, last_seen_ms, count(*) OVER () AS live FROM flows WHERE end_reason = 'PCAP_DONE'
ORDER BY last_seen_ms DESC, flow_key"""))
def _(spark, sf):
    live = stored_flows(spark, sf).where("end_reason = 'PCAP_DONE'")
    total = live.agg(F.count(F.lit(1))).scalar()
    return live.select(*FLOW_ID, "last_seen_ms", total.alias("live")).orderBy(F.col("last_seen_ms").desc(), "flow_key")


@query("dataset_profile", sql("labelled", """
SELECT * FROM (
SELECT 'rows' AS item, '' AS detail, count(*)::DOUBLE AS value FROM d
UNION ALL SELECT 'columns', '', 7.0::DOUBLE
UNION ALL SELECT 'missing_total', '', (count(*) FILTER (src_port IS NULL) + count(*) FILTER (isnan(stddev_packet_length))
  + count(*) FILTER (isnan(inter_arrival_time_stddev)))::DOUBLE FROM d
UNION ALL SELECT 'numeric_columns', '', 5.0::DOUBLE
UNION ALL SELECT 'other_columns', '', 2.0::DOUBLE
UNION ALL SELECT 'duplicate_rows', '', (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)))::DOUBLE FROM d
UNION ALL SELECT 'label_count', label, count(*)::DOUBLE FROM d GROUP BY label
UNION ALL SELECT 'label_percent', label, round(count(*) / (SELECT count(*) FROM d) * 100, 2) FROM d GROUP BY label
UNION ALL SELECT 'missing_by_column', 'src_port', count(*)::DOUBLE FROM d WHERE src_port IS NULL
UNION ALL SELECT 'missing_by_column', 'stddev_packet_length', count(*)::DOUBLE FROM d WHERE isnan(stddev_packet_length)
UNION ALL SELECT 'missing_by_column', 'inter_arrival_time_stddev', count(*)::DOUBLE FROM d
  WHERE isnan(inter_arrival_time_stddev))""",
    """d AS (SELECT protocol, src_port, packet_count, bytes, stddev_packet_length, inter_arrival_time_stddev, label
  FROM labelled)"""))
def _(spark, sf):
    rows = labelled_flows(stored_flows(spark, sf)).select(
        "protocol", "src_port", "packet_count", "bytes", "stddev_packet_length", "inter_arrival_time_stddev", "label")
    return rollups.dataset_profile(rows, "label")


_STAT_COLUMNS = ["bytes", "packet_count", "mean_packet_length", "duration_ms", "ack_count", "syn_rate"]


@query("feature_describe", sql("flows", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM flows" for c in _STAT_COLUMNS)))
def _(spark, sf):
    out = rollups.feature_describe(stored_flows(spark, sf), _STAT_COLUMNS)
    return out.withColumns({"mean": r6("mean"), "std": r6("std")})


@query("feature_drift", sql("flows", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(a, 6) AS train_mean, round(b, 6) AS test_mean, "
    f"round(CASE WHEN a = 0 THEN 0 ELSE abs((b - a) / a) * 100 END, 6) AS diff_percent FROM (SELECT "
    f"avg({c}) FILTER (flow_seq % 2 = 0) AS a, avg({c}) FILTER (flow_seq % 2 = 1) AS b FROM flows)"
    for c in _STAT_COLUMNS) + ") ORDER BY diff_percent DESC, feature LIMIT 10"))
def _(spark, sf):
    flows = stored_flows(spark, sf)
    out = rollups.feature_drift(flows.where("flow_seq % 2 = 0"), flows.where("flow_seq % 2 = 1"), _STAT_COLUMNS)
    return out.withColumns({c: r6(c) for c in ("train_mean", "test_mean", "diff_percent")})


@query("class_feature_means", sql("labelled", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(a, 6) AS normal_mean, round(b, 6) AS anomaly_mean, round(abs(b - a), 6) AS diff "
    f"FROM (SELECT avg({c}) FILTER (score >= 0.05) AS a, avg({c}) FILTER (score < 0.05) AS b FROM labelled)"
    for c in _STAT_COLUMNS)))
def _(spark, sf):
    rows = _verdicts(spark, sf)
    out = rollups.class_feature_means(rows, "verdict", _STAT_COLUMNS)
    return out.withColumns({c: r6(c) for c in ("normal_mean", "anomaly_mean", "diff")})


def _verdicts(spark, sf):
    return labelled_flows(stored_flows(spark, sf)).withColumn(
        "verdict", F.when(F.col("score") < 0.05, "ANOMALY").otherwise("NORMAL"))


@query("attack_type_summary", sql("labelled", """
SELECT protocol || '/' || end_reason AS attack_type, count(*) FILTER (score < 0.05) AS detections,
  round(avg(score), 6) AS score_mean, min(score) AS score_min, max(score) AS score_max, count(*) AS total,
  round(count(*) FILTER (score < 0.05) / count(*) * 100, 2) AS detection_percent FROM labelled GROUP BY 1"""))
def _(spark, sf):
    rows = _verdicts(spark, sf).select(
        F.concat_ws("/", "protocol", "end_reason").alias("attack_type"), F.col("verdict").alias("label"), "score")
    return rollups.attack_type_summary(rows).withColumn("score_mean", r6("score_mean"))


@query("score_percentiles", sql("labelled", " UNION ALL ".join(
    [f"SELECT 'p{p}' AS name, round(quantile_cont(score, {p / 100}), 6) AS value FROM labelled"
     for p in rollups.SCORE_PERCENTILES]
    + ["SELECT 'median', round(quantile_cont(score, 0.5), 6) FROM labelled",
       "SELECT 'min', min(score) FROM labelled", "SELECT 'max', max(score) FROM labelled",
       "SELECT 'mean', round(avg(score), 6) FROM labelled", "SELECT 'std', round(stddev_pop(score), 6) FROM labelled"])))
def _(spark, sf):
    out = rollups.score_percentiles(labelled_flows(stored_flows(spark, sf)), "score")
    return out.withColumn("value", r6("value"))


@query("top_anomalies", sql("labelled", """
SELECT flow_key, flow_seq, protocol, duration_ms, round(bytes_per_second, 6) AS bytes_per_second, syn_count, fin_count, score
FROM labelled WHERE score < 0.05 ORDER BY score, flow_key, flow_seq LIMIT 20"""))
def _(spark, sf):
    return (
        _verdicts(spark, sf).where("verdict = 'ANOMALY'").orderBy("score", *FLOW_ID).limit(20)
        .select(*FLOW_ID, "protocol", "duration_ms", r6("bytes_per_second").alias("bytes_per_second"),
                "syn_count", "fin_count", "score")
    )


# ---- enrichment

def _ips(spark, sf):
    return packets(spark, sf).select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()


@query("enrich_country", sql("facts", "SELECT ip, country FROM facts"))
def _(spark, sf):
    return enrich.enrich_country(_ips(spark, sf), reference_tables(spark)["geo"])


@query("enrich_org", sql("facts", "SELECT ip, asn_org FROM facts"))
def _(spark, sf):
    return enrich.enrich_org(_ips(spark, sf), reference_tables(spark)["asn"])


# Fixed values of the fixture: multipliers that spread keys over 32 bits.
SPREAD = (2654435761, 2246822519, 3266489917, 668265263)


def _spread_sql(key: str) -> str:
    return ", ".join(f"({key} * {m}) % 4294967296 AS p{i}" for i, m in enumerate(SPREAD))


def _spelled_sql(v6: str, parts: list[str]) -> str:
    hexed = ", ".join(f"printf('%x', ({p}) >> 16), printf('%x', ({p}) & 65535)" for p in parts)
    return (f"CASE WHEN {v6} THEN concat_ws(':', {hexed}) ELSE concat_ws('.', ({parts[0]}) >> 24, (({parts[0]}) >> 16) & 255, "
            f"(({parts[0]}) >> 8) & 255, ({parts[0]}) & 255) END")


# Ranges of /4 to /32 (IPv4) and /3 to /128 (IPv6) from the customers, addresses from those who caused events.
_PREFIXED = (
    f"""ranged AS (SELECT k, v6, bits, {', '.join(f'p{i} >> (32 - m{i}) << (32 - m{i}) AS s{i}' for i in range(4))},
  {', '.join(f'(p{i} >> (32 - m{i}) << (32 - m{i})) + (1::BIGINT << (32 - m{i})) - 1 AS e{i}' for i in range(4))}
FROM (SELECT *, {', '.join(f'least(greatest(bits - {32 * i}, 0), 32) AS m{i}' for i in range(4))}
  FROM (SELECT c_custkey AS k, c_custkey % 2 = 0 AS v6, CASE WHEN c_custkey % 2 = 0 THEN 3 + (c_custkey // 2) % 126
    ELSE 4 + c_custkey % 29 END AS bits, {_spread_sql('c_custkey')} FROM customer)))""",
    f"""asked AS (SELECT DISTINCT user_id % 2 = 0 AS v6, p0, p1, p2, p3 FROM (SELECT user_id, p0, p1, p2,
  CASE WHEN event_id % 3 = 0 THEN p3 ELSE (p3 + event_id) % 4294967296 END AS p3
  FROM (SELECT user_id, event_id, {_spread_sql('user_id')} FROM events)))""")


@query("range_prefixes", sql("packets", f"""
SELECT {_spelled_sql('a.v6', ['p0', 'p1', 'p2', 'p3'])} AS ip,
  coalesce(arg_max('net' || k, (bits, 'net' || k)), 'none') AS net
FROM (SELECT DISTINCT v6, p0, CASE WHEN v6 THEN p1 END AS p1, CASE WHEN v6 THEN p2 END AS p2, CASE WHEN v6 THEN p3 END AS p3
  FROM asked) a
LEFT JOIN ranged r ON a.v6 = r.v6 AND p0 BETWEEN s0 AND e0 AND (NOT a.v6 OR (p1 BETWEEN s1 AND e1 AND p2 BETWEEN s2 AND e2
  AND p3 BETWEEN s3 AND e3)) GROUP BY ALL""", *_PREFIXED))
def _(spark, sf):
    def spread(key, i):
        return (F.col(key) * F.lit(SPREAD[i])) % F.lit(1 << 32)

    def spelled(v6, parts):
        groups = [F.lower(F.hex(g)) for p in parts for g in (F.shiftright(p, 16), p.bitwiseAND(0xFFFF))]
        octets = [F.shiftright(parts[0], n).bitwiseAND(255).cast("string") for n in (24, 16, 8, 0)]
        return F.when(v6, F.concat_ws(":", *groups)).otherwise(F.concat_ws(".", *octets))

    k = F.col("c_custkey").cast("long")
    v6 = k % 2 == 0
    bits = F.when(v6, 3 + F.floor(k / 2) % 126).otherwise(4 + k % 29).cast("int")
    masks = [F.least(F.greatest(bits - 32 * i, F.lit(0)), F.lit(32)) for i in range(4)]
    rows = table(spark, sf, "customer").select("c_custkey", v6.alias("v6"), *[
        F.pow(F.lit(2.0), 32 - m).cast("long").alias(f"w{i}") for i, m in enumerate(masks)], *[
        spread("c_custkey", i).alias(f"p{i}") for i in range(4)])
    starts = [F.col(f"p{i}") - F.col(f"p{i}") % F.col(f"w{i}") for i in range(4)]
    ranges = rows.select(spelled(F.col("v6"), starts).alias("start_ip"),
                         spelled(F.col("v6"), [s + F.col(f"w{i}") - 1 for i, s in enumerate(starts)]).alias("end_ip"),
                         F.concat(F.lit("net"), F.col("c_custkey")).alias("net"))
    parts = [spread("user_id", i).alias(f"p{i}") for i in range(3)]
    last = spread("user_id", 3)
    last = F.when(F.col("event_id") % 3 == 0, last).otherwise((last + F.col("event_id")) % F.lit(1 << 32))
    asked = table(spark, sf, "events").select((F.col("user_id") % 2 == 0).alias("v6"), *parts, last.alias("p3"))
    ips = asked.select(spelled(F.col("v6"), [F.col(f"p{i}") for i in range(4)]).alias("ip")).distinct()
    return enrich.range_lookup(ips, ranges, "net").select("ip", F.coalesce("net", F.lit("none")).alias("net"))


@query("enrich_domain", sql("facts", "SELECT ip, domain FROM facts"))
def _(spark, sf):
    return enrich.enrich_domain(_ips(spark, sf), reference_tables(spark)["rdns"])


@query("enrich_whois_org", sql("facts", "SELECT ip, org FROM facts"))
def _(spark, sf):
    t = reference_tables(spark)
    return enrich.enrich_whois_org(enrich.enrich_org(_ips(spark, sf), t["asn"]), t["whois"]).select("ip", "org")


def enriched(spark, sf):
    t = reference_tables(spark)
    return enrich.enrich_flows(stored_flows(spark, sf), t["geo"], t["asn"], t["rdns"], t["whois"])


_ENRICHED = """enriched AS (SELECT flows.*, s.country AS src_country, d.country AS dst_country, s.domain AS src_domain,
  d.domain AS dst_domain, s.org AS src_org, d.org AS dst_org
FROM flows JOIN facts s ON s.ip = src_ip JOIN facts d ON d.ip = dst_ip)"""
_LINKS = """links AS (SELECT src_country AS src, dst_country AS dst, count(*) AS flows FROM enriched GROUP BY ALL)"""
_SHAPES = """shapes AS (SELECT src, dst, flows, a.lat AS src_lat, a.lon AS src_lon, b.lat AS dst_lat, b.lon AS dst_lon,
  CASE WHEN a.lat IS NOT NULL AND b.lat IS NOT NULL THEN 'line' ELSE 'point' END AS shape
FROM links LEFT JOIN coords a ON a.country = src LEFT JOIN coords b ON b.country = dst
WHERE a.lat IS NOT NULL OR b.lat IS NOT NULL)"""


@query("enrich_flows", sql("enriched", """
SELECT flow_key, flow_seq, src_country, dst_country, src_domain, dst_domain, src_org, dst_org FROM enriched""", _ENRICHED))
def _(spark, sf):
    return enriched(spark, sf).select(
        *FLOW_ID, "src_country", "dst_country", "src_domain", "dst_domain", "src_org", "dst_org")


@query("country_links", sql("enriched", "SELECT * FROM links", _ENRICHED, _LINKS))
def _(spark, sf):
    return enrich.country_links(enriched(spark, sf))


@query("country_coordinates", sql("enriched", """
SELECT src, dst, flows, coalesce(src_lat, 0) AS src_lat, coalesce(dst_lat, 0) AS dst_lat, shape FROM shapes""",
    _ENRICHED, _LINKS, _SHAPES))
def _(spark, sf):
    shapes = enrich.country_coordinates(enrich.country_links(enriched(spark, sf)), reference_tables(spark)["coords"])
    return shapes.select("src", "dst", "flows", F.coalesce("src_lat", F.lit(0.0)).alias("src_lat"),
                         F.coalesce("dst_lat", F.lit(0.0)).alias("dst_lat"), "shape")


@query("unknown_endpoint_points", sql("enriched", """
SELECT coalesce(src_lat, dst_lat) AS lat, coalesce(src_lon, dst_lon) AS lon, sum(flows)::BIGINT AS flows
FROM shapes WHERE shape = 'point' GROUP BY 1, 2""", _ENRICHED, _LINKS, _SHAPES))
def _(spark, sf):
    shapes = enrich.country_coordinates(enrich.country_links(enriched(spark, sf)), reference_tables(spark)["coords"])
    return enrich.unknown_endpoint_points(shapes)


# ---- comparison and set operations

_RESPELLED = """SELECT * REPLACE (CASE src_ip WHEN '203.0.113.9' THEN '2001:db8::9' ELSE src_ip END AS src_ip,
  CASE dst_ip WHEN '203.0.113.9' THEN '2001:db8::9' ELSE dst_ip END AS dst_ip) FROM"""
_TOOLS = (f"""one AS ({_RESPELLED} (SELECT * FROM flows UNION ALL
  SELECT * REPLACE (bytes + 7 AS bytes, first_packet_id + 1000000000000 AS first_packet_id) FROM flows
  WHERE first_packet_id % 29 = 0))""", f"""two AS ({_RESPELLED} (
  SELECT * REPLACE (bytes + CASE WHEN first_packet_id % 11 = 0 THEN 1 ELSE 0 END AS bytes,
    CASE WHEN first_packet_id % 13 = 0 THEN mean_packet_length * (1 + 1e-9::DOUBLE) ELSE mean_packet_length END
      AS mean_packet_length)
  FROM flows WHERE first_packet_id % 17 <> 0 AND (coalesce(src_port, 0) + coalesce(dst_port, 0)) % 11 <> 3 UNION ALL
  SELECT * REPLACE (bytes + 5 AS bytes, first_packet_id + 1000000000000 AS first_packet_id) FROM flows
  WHERE first_packet_id % 19 = 0 UNION ALL
  SELECT * REPLACE ('198.51.100.1' AS dst_ip) FROM flows WHERE first_packet_id % 23 = 0))""",
    _signed("first", "one"), _signed("second", "two"))
_LAST = tuple(f"""{name}_last AS (SELECT * FROM {name} QUALIFY row_number() OVER (
  PARTITION BY feature_key ORDER BY first_packet_id DESC) = 1)""" for name in ("first", "second"))
COMPARED = ["bytes", "packet_count", "duration_ms", "total_bytes_upstream", "total_bytes_downstream",
            "total_packets_upstream", "total_packets_downstream", "min_packet_length", "max_packet_length",
            "mean_packet_length", "stddev_packet_length", "bytes_per_second", "packets_per_second",
            "inter_arrival_time_min", "inter_arrival_time_max", "inter_arrival_time_mean",
            "inter_arrival_time_stddev", "syn_count", "ack_count", "psh_count", "rst_count", "fin_count"]


def _two_tools(spark, sf):
    flows = stored_flows(spark, sf)
    return signed(first_tool(flows)), signed(second_tool(flows))


@query("flow_presence_diff", sql("flows", """
SELECT total_a, total_b, missing_in_b, missing_in_a, round(missing_in_b / total_a * 100, 2) AS missing_in_b_percent,
  100 - round(missing_in_b / total_a * 100, 2) AS success_a_percent,
  round(missing_in_a / total_b * 100, 2) AS missing_in_a_percent,
  100 - round(missing_in_a / total_b * 100, 2) AS success_b_percent
FROM (SELECT (SELECT count(DISTINCT presence_key) FROM first) AS total_a,
  (SELECT count(DISTINCT presence_key) FROM second) AS total_b,
  (SELECT count(*) FROM (SELECT presence_key FROM first EXCEPT SELECT presence_key FROM second)) AS missing_in_b,
  (SELECT count(*) FROM (SELECT presence_key FROM second EXCEPT SELECT presence_key FROM first)) AS missing_in_a)""",
    *_TOOLS))
def _(spark, sf):
    a, b = _two_tools(spark, sf)
    return compare.flow_presence_diff(a, b, "presence_key")


@query("key_except", sql("flows", """
SELECT presence_key, 'only_a' AS side FROM (SELECT presence_key FROM first EXCEPT SELECT presence_key FROM second)
UNION ALL
SELECT presence_key, 'only_b' FROM (SELECT presence_key FROM second EXCEPT SELECT presence_key FROM first)""", *_TOOLS))
def _(spark, sf):
    a, b = _two_tools(spark, sf)
    return compare.key_except(a, b, "presence_key")


@query("diff_samples", sql("flows", """
(SELECT presence_key, 'only_a' AS side FROM (SELECT presence_key FROM first EXCEPT SELECT presence_key FROM second)
  ORDER BY presence_key LIMIT 20)
UNION ALL
(SELECT presence_key, 'only_b' FROM (SELECT presence_key FROM second EXCEPT SELECT presence_key FROM first)
  ORDER BY presence_key LIMIT 20)""", *_TOOLS))
def _(spark, sf):
    a, b = _two_tools(spark, sf)
    return compare.diff_samples(compare.key_except(a, b, "presence_key"), "presence_key")


def _clean(side: str, m: str) -> str:
    return f"CASE WHEN {side}.{m} IS NULL OR isnan({side}.{m}::DOUBLE) THEN 0 ELSE {side}.{m} END::DOUBLE"


_CELLS = "cells AS (" + " UNION ALL ".join(
    f"SELECT feature_key, '{m}' AS metric, {_clean('a', m)} AS a, {_clean('b', m)} AS b "
    f"FROM first_last a JOIN second_last b USING (feature_key)" for m in COMPARED) + ")"
_DIFFERS = ("a <> b AND (a = 0 OR b = 0 OR abs(a - b) / greatest(abs(a), abs(b)) * 100 > 0.0001)")


@query("feature_diff", sql("flows", f"""
SELECT feature_key, metric, a, b, round(a - b, 4) AS difference FROM cells WHERE {_DIFFERS}""", *_TOOLS, *_LAST, _CELLS))
def _(spark, sf):
    a, b = _two_tools(spark, sf)
    return compare.feature_diff(a, b, "feature_key", COMPARED, "first_packet_id")


@query("feature_diff_summary", sql("flows", f"""
SELECT metric, count(*) AS compared, count(*) FILTER ({_DIFFERS}) AS differences,
  round(count(*) FILTER ({_DIFFERS}) / count(*) * 100, 2) AS percent FROM cells GROUP BY metric""",
    *_TOOLS, *_LAST, _CELLS))
def _(spark, sf):
    a, b = _two_tools(spark, sf)
    return compare.feature_diff_summary(a, b, "feature_key", COMPARED, "first_packet_id")


@query("packet_positional_diff", sql("packets", """
SELECT count(*) AS rows_a, count(*) AS rows_b, true AS comparable,
  count(*) FILTER (frame_no % 101 = 0) AS different_rows, count(*) FILTER (frame_no % 101 = 0) AS different_cells,
  round((count(*) - count(*) FILTER (frame_no % 101 = 0)) / count(*) * 100, 4) AS accuracy
FROM (SELECT row_number() OVER (ORDER BY ts_ms, packet_id) AS frame_no FROM packets)"""))
def _(spark, sf):
    from tidewire.sources.sinks import numbered_packets
    a = numbered_packets(packets(spark, sf), slice_ms=86_400_000)
    b = a.withColumn("length", F.col("length") + F.when(F.col("frame_no") % 101 == 0, 1).otherwise(0))
    return compare.packet_positional_diff(a, b, "frame_no", ["src_ip", "dst_ip", "src_port", "dst_port", "length"])


@query("dedupe_by_key", sql("flows", """
SELECT presence_key, first_packet_id, bytes FROM (SELECT *, row_number() OVER (PARTITION BY presence_key
  ORDER BY first_packet_id DESC) AS k FROM signed) WHERE k = 1""", _SIGNED))
def _(spark, sf):
    rows = signed(stored_flows(spark, sf)).select("presence_key", "first_packet_id", "bytes")
    return compare.dedupe_by_key(rows, "presence_key", "first_packet_id")


@query("count_duplicates", sql("packets", """
SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT src_ip, dst_ip, length FROM packets))) AS duplicate_rows
FROM packets"""))
def _(spark, sf):
    return compare.count_duplicates(packets(spark, sf).select("src_ip", "dst_ip", "length"))


@query("union_labelled", sql("labelled", """
SELECT flow_key, flow_seq, label, CASE WHEN label = 'MALICIOUS' THEN score ELSE -1 END AS score FROM labelled"""))
def _(spark, sf):
    rows = labelled_flows(stored_flows(spark, sf))
    attack = rows.where("label = 'MALICIOUS'").select(*FLOW_ID, "label", "score")
    benign = rows.where("label = 'BENIGN'").select(*FLOW_ID, "label")
    return attack.unionByName(benign, allowMissingColumns=True).withColumn("score", F.coalesce("score", F.lit(-1.0)))


@query("merge_sorted_flows", sql("labelled", """
SELECT first_seen_ms, flow_key, flow_seq, label FROM labelled ORDER BY first_seen_ms, flow_key"""))
def _(spark, sf):
    rows = labelled_flows(stored_flows(spark, sf)).select("first_seen_ms", *FLOW_ID, "label")
    parts = [rows.where(F.col("label") == x) for x in ("MALICIOUS", "BENIGN")]
    return rollups.merge_sorted(parts, ["first_seen_ms", "flow_key"])
