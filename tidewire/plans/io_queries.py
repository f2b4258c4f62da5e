"""Queries that write derived data to the shared folder and read it back through a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions.decode import decode_frames
from tidewire.plans.checks import sql
from tidewire.plans.inputs import (
    EVENT_RULES, frames, labelled_flows, metric_samples, mixed_kind, packets, raw_frames, stored_flows, table)
from tidewire.plans.flow_queries import FLOW_ID
from tidewire.plans.packet_queries import v6_sql
from tidewire.plans.registry import query, r6, text
from tidewire.operators import metrics
from tidewire.session import shared_folder
from tidewire.sources import captures, readers, sinks

PER_FILE = 2_500


def capture_folder(spark, sf) -> str:
    path = shared_folder(spark, "captures")
    rows = raw_frames(spark, sf, mixed=False).withColumn(
        "file", F.concat(F.lit("part-"), F.floor(F.col("packet_id") / PER_FILE).cast("string")))
    captures.write_capture_files(rows, path)
    return path


@query("scan_pcap", sql("packets", f"""
SELECT 'part-' || (packet_id // {PER_FILE})::VARCHAR || '.pcap' AS file, packet_id % {PER_FILE} AS idx, ts_ms, 1 AS link_type,
  length, src_ip, dst_ip, protocol FROM packets"""))
def _(spark, sf):
    # Small splits, so that files are read in several ranges.
    rows = captures.read_captures(spark, capture_folder(spark, sf), split_bytes=64_000)
    return decode_frames(rows).select(
        F.regexp_extract("file", "([^/]+)$", 1).alias("file"), "idx", "ts_ms", "link_type", "length", "src_ip",
        "dst_ip", "protocol")


@query("merge_captures", sql("packets", """
SELECT ts_ms, packet_id % 2500 AS idx, length FROM packets ORDER BY ts_ms, packet_id"""))
def _(spark, sf):
    path = shared_folder(spark, "merged")
    captures.merge_captures(spark, capture_folder(spark, sf)).write.parquet(path)
    return spark.read.parquet(path).select("ts_ms", "idx", F.octet_length("frame").alias("length"))


def envelopes(spark, sf, mixed=False):
    rows = frames(packets(spark, sf), mixed_kind() if mixed else None).withColumn(
        "ingested_at_ms", F.col("ts_ms") + F.col("packet_id") % 50)
    return readers.to_envelopes(rows, F.col("flow_key"))


def record_folder(spark, sf, mixed=False) -> str:
    """Envelope records with control records and empty lines among them, as text files."""
    control = table(spark, sf, "events").where("event_id % 100 < 3").select(
        F.when(F.col("event_id") % 100 == 0, readers.RESET).when(F.col("event_id") % 100 == 1, '{"status":"PCAP_DONE"}')
        .otherwise("").alias("value"))
    path = shared_folder(spark, "envelopes")
    envelopes(spark, sf, mixed).unionByName(control).write.text(path)
    return path


@query("scan_envelopes", sql("packets", """
SELECT packet_id, ts_ms, ts_ms + packet_id % 50 AS ingested_at_ms, length, src_ip, dst_ip, protocol, rst FROM packets"""))
def _(spark, sf):
    from tidewire.streaming import jobs
    out, cp = shared_folder(spark, "packets"), shared_folder(spark, "cp")
    records = readers.text_stream(spark, record_folder(spark, sf), files_per_trigger=4)
    jobs.run_available(jobs.stream_packets(records).drop("frame"), out, cp)
    return jobs.read_batches(spark, out).select(
        "packet_id", "ts_ms", "ingested_at_ms", "length", "src_ip", "dst_ip", "protocol", "rst")


@query("drop_control_records", """
SELECT 'data' AS kind, count(*) AS records FROM events
UNION ALL SELECT CASE event_id % 100 WHEN 0 THEN 'reset' WHEN 1 THEN 'done' ELSE 'empty' END, count(*) FROM events
WHERE event_id % 100 < 3 GROUP BY 1""")
def _(spark, sf):
    parsed = readers.parse_envelopes(spark.read.text(record_folder(spark, sf)))
    kept = readers.drop_control_records(parsed)
    dropped = parsed.where("kind <> 'data'")
    return kept.unionByName(dropped).groupBy("kind").agg(F.count(F.lit(1)).alias("records"))


_FLOW_JSON_SQL = """
SELECT flow_key, flow_seq, first_seen_ms, src_ip, coalesce(dst_port::VARCHAR, 'none') AS dst_port, bytes, end_reason,
  round(mean_packet_length, 6) AS mean_packet_length, round(stddev_packet_length, 6) AS stddev_packet_length FROM flows
ORDER BY flow_key, flow_seq"""


def _shown(flows):
    return flows.select(
        *FLOW_ID, "first_seen_ms", "src_ip", text("dst_port"), "bytes", "end_reason",
        r6("mean_packet_length").alias("mean_packet_length"), r6("stddev_packet_length").alias("stddev_packet_length"))


def flow_record_folder(spark, sf) -> str:
    path = shared_folder(spark, "flow-records")
    sinks.publish_flows(stored_flows(spark, sf)).select("value").write.text(path)
    return path


@query("publish_flows", sql("flows", _FLOW_JSON_SQL))
def _(spark, sf):
    return _shown(readers.parse_flow_records(spark.read.text(flow_record_folder(spark, sf))))


@query("scan_flows_stream", sql("flows", _FLOW_JSON_SQL))
def _(spark, sf):
    from tidewire.streaming import jobs
    out, cp = shared_folder(spark, "flows-read"), shared_folder(spark, "cp")
    records = readers.text_stream(spark, flow_record_folder(spark, sf))
    jobs.run_available(readers.parse_flow_records(records), out, cp)
    return _shown(jobs.read_batches(spark, out))


_CSV_SQL = """
SELECT strftime(make_timestamp(first_seen_ms * 1000), '%Y-%m-%d %H:%M:%S.%g') || '000000' AS "firstSeen", src_ip AS "srcIp",
  coalesce(src_port::VARCHAR, 'none') AS "srcPort", protocol, bytes::DOUBLE AS bytes, packet_count::DOUBLE AS packets,
  duration_ms::DOUBLE AS "durationMs", round(stddev_packet_length, 6) AS "stddevPacketLength",
  ack_count::DOUBLE AS "ackCount" FROM flows"""


def _csv(spark, sf):
    path = shared_folder(spark, "flow-csv")
    sinks.export_flow_csv(stored_flows(spark, sf), path)
    return readers.read_flow_csv(spark, path).select(
        "firstSeen", "srcIp", text("srcPort"), "protocol", "bytes", "packets", "durationMs",
        r6("stddevPacketLength").alias("stddevPacketLength"), "ackCount")


query("export_flow_csv", sql("flows", _CSV_SQL))(_csv)
query("scan_csv_flows", sql("flows", _CSV_SQL))(_csv)


@query("scan_packet_json", sql("packets", """
SELECT src_ip AS "srcIp", dst_ip AS "dstIp", protocol, length::BIGINT AS bytes FROM packets"""))
def _(spark, sf):
    path = shared_folder(spark, "packet-json")
    one = F.struct(F.col("src_ip").alias("srcIp"), F.col("dst_ip").alias("dstIp"), "protocol",
                   F.col("length").cast("long").alias("bytes"))
    # One array of up to 500 packets per line.
    (packets(spark, sf).groupBy(F.floor(F.col("packet_id") / 500)).agg(F.to_json(F.collect_list(one)).alias("value"))
     .select("value").write.text(path))
    return readers.read_packet_json(spark, path, multi_line=False)


@query("write_packets", sql("kinds", """
SELECT concat_ws('_', 'P', CASE WHEN ip THEN src ELSE '' END, CASE WHEN ip THEN dst ELSE '' END,
    CASE WHEN ip THEN protocol ELSE 'UNKNOWN' END,
    CASE WHEN NOT ip THEN '' WHEN rst THEN 'RST' WHEN fin THEN 'FIN' WHEN syn THEN 'SYN' WHEN ack THEN 'ACK' ELSE '' END,
    ts_ms::VARCHAR) AS id,
  ts_ms AS timestamp_ms, CASE WHEN ip THEN src ELSE '' END AS "srcIp", CASE WHEN ip THEN protocol ELSE 'UNKNOWN' END AS protocol,
  CASE kind WHEN 'short' THEN 10 WHEN 'VLAN' THEN length + 4 WHEN 'IPv6' THEN length + 20 ELSE length END::BIGINT AS bytes
FROM (SELECT * REPLACE (CASE WHEN kind = 'IPv6' AND protocol = 'ICMPv4' THEN 'ICMPv6' ELSE protocol END AS protocol),
  kind IN ('IPv4', 'VLAN', 'IPv6') AS ip,
  CASE WHEN kind = 'IPv6' THEN """ + v6_sql("src_ip") + """ ELSE src_ip END AS src,
  CASE WHEN kind = 'IPv6' THEN """ + v6_sql("dst_ip") + """ ELSE dst_ip END AS dst FROM kinds)"""))
def _(spark, sf):
    path = shared_folder(spark, "network-data")
    sinks.write_packets(decode_frames(raw_frames(spark, sf)), path)
    return spark.read.parquet(path).select("id", F.unix_millis("timestamp").alias("timestamp_ms"), "srcIp", "protocol", "bytes")


@query("write_flows", sql("flows", """
SELECT sha256(concat_ws('|', flow_key, first_seen_ms::VARCHAR, flow_seq::VARCHAR)) AS id, flow_key AS "flowKey",
  first_seen_ms, coalesce(src_port::VARCHAR, 'none') AS "srcPort", bytes, packet_count AS packets,
  duration_ms AS "durationMs", end_reason AS "reasonOfFlowEnd", 'N/A' AS "srcCountry", 'N/A' AS label FROM flows ORDER BY id"""))
def _(spark, sf):
    path = shared_folder(spark, "network-flows")
    sinks.write_flows(stored_flows(spark, sf), path)
    return spark.read.parquet(path).select(
        "id", "flowKey", F.unix_millis("firstSeen").alias("first_seen_ms"), text("srcPort"), "bytes", "packets",
        "durationMs", "reasonOfFlowEnd", "srcCountry", "label")


_METRICS_SQL = """
WITH samples AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'FLOW_AGGREGATION_RATE'
  WHEN event_type = 'error' THEN 'SYSTEM_CPU' WHEN event_type = 'signup' THEN 'SYSTEM_RAM' ELSE 'OTHER' END AS type,
  value, epoch_us(ts) // 3600000000 * 3600000 AS timestamp FROM events)
SELECT type, round(CASE WHEN type LIKE 'SYSTEM%' THEN avg(value) ELSE sum(value) END, 6) AS rate,
  CASE WHEN type = 'OTHER' THEN '' WHEN type LIKE 'SYSTEM%' THEN '%' ELSE 'packets/s' END AS unit, timestamp
FROM samples GROUP BY type, timestamp"""


@query("write_metrics", _METRICS_SQL)
def _(spark, sf):
    path = shared_folder(spark, "metrics")
    sinks.write_metrics(metrics.metric_rows(metric_samples(table(spark, sf, "events")), "1 hour"), path)
    return spark.read.parquet(path).withColumn("rate", r6("rate"))


@query("write_scored_flows", sql("labelled", """
SELECT flow_key, flow_seq::VARCHAR AS flow_seq, bytes::VARCHAR AS bytes, score, CASE WHEN score < 0.05 THEN '-1' ELSE '1' END
  AS prediction, CASE WHEN score < 0.05 THEN 'ANOMALY' ELSE 'NORMAL' END AS verdict FROM labelled"""))
def _(spark, sf):
    path = shared_folder(spark, "scored")
    low = F.col("score") < 0.05
    rows = labelled_flows(stored_flows(spark, sf)).select(
        *FLOW_ID, "bytes", "score", F.when(low, -1).otherwise(1).alias("prediction"),
        F.when(low, "ANOMALY").otherwise("NORMAL").alias("verdict"))
    sinks.write_scored_flows(rows, path)
    return spark.read.option("header", True).csv(path).withColumn("score", F.col("score").cast("double"))
