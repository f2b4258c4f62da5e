"""Queries over packets: projections, filters, order and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions.addresses import is_private_ip, is_valid_ip, normalize_ip
from tidewire.functions.decode import (
    decode_frames, ethertype_class, packet_class, quarantine_malformed)
from tidewire.functions.keys import (
    flow_key_bilateral, flow_key_directed, packet_label, protocol_alias)
from tidewire.functions.protocols import protocol_name, protocol_table
from tidewire.functions.text import (
    anomaly_sign, display_protocol, format_ts_ms, normalize_label, parse_whois_org, safe_double, split_summaries,
    without_arp)
from tidewire.operators import metrics, rollups
from tidewire.operators.features import arp_flows
from tidewire.plans.checks import sql
from tidewire.plans.inputs import (
    DST_MAC, SRC_MAC, frames, metric_samples, mixed_kind, packets, raw_frames, table)
from tidewire.plans.registry import query, r6, text
from tidewire.session import shared_folder
from tidewire.sources.readers import read_packet_csv
from tidewire.sources.sinks import export_packet_csv


@query("flow_key_directed", sql("keyed", "SELECT packet_id, directed FROM keyed"))
def _(spark, sf):
    return packets(spark, sf).select("packet_id", flow_key_directed().alias("directed"))


@query("flow_key_bilateral", sql("keyed", "SELECT packet_id, flow_key FROM keyed"))
def _(spark, sf):
    return packets(spark, sf).select("packet_id", flow_key_bilateral().alias("flow_key"))


@query("packet_id", sql("packets", """
SELECT packet_id, concat_ws('_', 'P', src_ip, dst_ip, protocol,
  CASE WHEN rst THEN 'RST' WHEN fin THEN 'FIN' WHEN syn THEN 'SYN' WHEN ack THEN 'ACK' ELSE '' END,
  ts_ms::VARCHAR) AS label FROM packets"""))
def _(spark, sf):
    return packets(spark, sf).select("packet_id", packet_label().alias("label"))


@query("packet_length_default", sql("packets", """
SELECT packet_id, CASE WHEN packet_id % 7 = 0 THEN length + 1 ELSE length END AS bytes FROM packets"""))
def _(spark, sf):
    # Some envelopes name a length; the others fall back to the size of the frame.
    rows = frames(packets(spark, sf)).withColumn(
        "named", F.when(F.col("packet_id") % 7 == 0, F.col("length") + 1))
    return rows.select("packet_id", F.coalesce("named", F.octet_length("frame")).alias("bytes"))


@query("treatment_delay", sql("packets", """
SELECT packet_id, CASE WHEN packet_id % 10 = 9 THEN ts_ms + 60 ELSE 60 - packet_id % 50 END AS delay FROM packets"""))
def _(spark, sf):
    ingested = F.when(F.col("packet_id") % 10 != 9, F.col("ts_ms") + F.col("packet_id") % 50)
    return packets(spark, sf).select(
        "packet_id", (F.col("ts_ms") + 60 - F.coalesce(ingested, F.lit(0))).alias("delay"))


@query("is_private_ip", sql("packets", """
SELECT src_ip, (src_ip LIKE '10.%' OR src_ip LIKE '192.168.%'
  OR (src_ip LIKE '172.%' AND split_part(src_ip, '.', 2)::INT BETWEEN 16 AND 31)) AS private, count(*) AS packets
FROM packets GROUP BY ALL"""))
def _(spark, sf):
    return packets(spark, sf).groupBy("src_ip").agg(F.count(F.lit(1)).alias("packets")).select(
        "src_ip", is_private_ip("src_ip").alias("private"), "packets")


@query("is_valid_ip", sql("packets", """
SELECT packet_id, CASE packet_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false
  ELSE true END AS valid FROM packets"""))
def _(spark, sf):
    slot = F.col("packet_id") % 5
    shown = (
        F.when(slot == 0, F.col("src_ip")).when(slot == 1, F.concat("src_ip", F.lit(".1")))
        .when(slot == 2, F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.col("packet_id") % 65536))))
        .when(slot == 3, F.concat(F.lit("host-"), F.col("packet_id").cast("string"))).otherwise(F.col("dst_ip")))
    return packets(spark, sf).select("packet_id", is_valid_ip(shown).alias("valid"))


@query("normalize_ip", sql("packets", """
SELECT packet_id,
  CASE packet_id % 3 WHEN 0 THEN src_ip WHEN 1 THEN '2001:db8::' || printf('%x', packet_id % 65535 + 1) ELSE 'x' || src_ip END
    AS compressed,
  CASE packet_id % 3 WHEN 0 THEN src_ip
    WHEN 1 THEN '2001:0db8:0000:0000:0000:0000:0000:' || printf('%04x', packet_id % 65535 + 1) ELSE 'x' || src_ip END AS exploded
FROM packets"""))
def _(spark, sf):
    slot = F.col("packet_id") % 3
    raw = (F.when(slot == 0, F.col("src_ip"))
           .when(slot == 1, F.concat(F.lit("2001:0DB8:0:0:0:0:0:"), F.hex(F.col("packet_id") % 65535 + 1)))
           .otherwise(F.concat(F.lit("x"), "src_ip")))
    return packets(spark, sf).withColumn("raw", raw).select(
        "packet_id", normalize_ip("raw").alias("compressed"), normalize_ip("raw", "exploded").alias("exploded"))


@query("format_ts_ms", sql("packets", """
SELECT packet_id, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S.%g') AS shown,
       strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S.%g') || '000000' AS padded FROM packets"""))
def _(spark, sf):
    return packets(spark, sf).select(
        "packet_id", format_ts_ms("ts_ms").alias("shown"), format_ts_ms("ts_ms", "000000").alias("padded"))


@query("safe_double", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 7.5::DOUBLE WHEN 1 THEN value WHEN 2 THEN 'NaN'::DOUBLE
  WHEN 3 THEN '-Infinity'::DOUBLE WHEN 4 THEN 7.5::DOUBLE ELSE 'Infinity'::DOUBLE END AS number FROM events""")
def _(spark, sf):
    slot = F.col("event_id") % 6
    raw = (F.when(slot == 0, None)
           .when(slot == 1, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
           .when(slot == 2, "NaN").when(slot == 3, "-infinity")
           .when(slot == 4, F.concat(F.lit("type "), "event_type")).otherwise("INFINITY"))
    # Where there is no value there is no text to read; ids below 0 and rows without one are of the last kind.
    number = F.when((slot == 1) & F.col("value").isNull(), None).otherwise(safe_double(raw, 7.5))
    return table(spark, sf, "events").select("event_id", number.alias("number"))


@query("split_summaries", sql("packets", """
SELECT packet_id, CASE WHEN packet_id % 4 = 0 THEN 0 ELSE 3 END AS items,
  CASE WHEN packet_id % 4 = 0 THEN '' ELSE src_ip || '|' || dst_ip || '|' || protocol END AS joined FROM packets"""))
def _(spark, sf):
    raw = F.when(F.col("packet_id") % 4 == 0, "").otherwise(
        F.concat("src_ip", F.lit(", "), "dst_ip", F.lit(","), "protocol"))
    return packets(spark, sf).withColumn("l", split_summaries(raw)).select(
        "packet_id", F.size("l").alias("items"), F.array_join("l", "|").alias("joined"))


@query("parse_whois_org", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN 'Unknown' ELSE c_name END AS org FROM customer""")
def _(spark, sf):
    slot = F.col("c_custkey") % 4
    raw = (F.when(slot == 1, F.concat(F.lit("% no entry for "), "c_name"))
           .when(slot == 2, F.concat(F.lit("NetRange: x\nOrgName: "), "c_name", F.lit("\nOrganization: later\n")))
           .when(slot == 3, F.concat(F.lit("  Organization:   "), "c_name")))
    return table(spark, sf, "customer").select("c_custkey", parse_whois_org(raw).alias("org"))


@query("base64_codec", sql("packets", """
SELECT packet_id, to_base64(encode(src_ip || '>' || dst_ip)) AS encoded, src_ip || '>' || dst_ip AS decoded FROM packets"""))
def _(spark, sf):
    rows = packets(spark, sf).select(
        "packet_id", F.base64(F.encode(F.concat("src_ip", F.lit(">"), "dst_ip"), "UTF-8")).alias("encoded"))
    return rows.select("packet_id", "encoded", F.decode(F.unbase64("encoded"), "UTF-8").alias("decoded"))


_DECODED = """
SELECT packet_id, length, src_ip, dst_ip, coalesce(src_port::VARCHAR, 'none') AS src_port,
  coalesce(dst_port::VARCHAR, 'none') AS dst_port, protocol, syn, fin, rst, ack, psh FROM packets"""


@query("decode_frames", sql("packets", _DECODED))
def _(spark, sf):
    return decode_frames(raw_frames(spark, sf, mixed=False)).select(
        "packet_id", "length", "src_ip", "dst_ip", text("src_port"), text("dst_port"), "protocol",
        "syn", "fin", "rst", "ack", "psh")


def v6_sql(ip: str) -> str:
    return (f"'2001:db8:0:0:0:0:' || printf('%x', split_part({ip}, '.', 1)::INT * 256 + split_part({ip}, '.', 2)::INT)"
            f" || ':' || printf('%x', split_part({ip}, '.', 3)::INT * 256 + split_part({ip}, '.', 4)::INT)")


@query("decode_frames_ipv6", sql("packets", f"""
SELECT packet_id, length + 20 AS length, {v6_sql('src_ip')} AS src_ip, {v6_sql('dst_ip')} AS dst_ip,
  coalesce(src_port::VARCHAR, 'none') AS src_port, coalesce(dst_port::VARCHAR, 'none') AS dst_port,
  CASE protocol WHEN 'ICMPv4' THEN 'ICMPv6' ELSE protocol END AS protocol, syn, fin, rst, ack, psh FROM packets"""))
def _(spark, sf):
    rows = frames(packets(spark, sf), F.lit("IPv6")).select("packet_id", "ts_ms", "frame")
    return decode_frames(rows).select(
        "packet_id", "length", "src_ip", "dst_ip", text("src_port"), text("dst_port"), "protocol",
        "syn", "fin", "rst", "ack", "psh")


@query("vlan_unwrap", sql("packets", """
SELECT packet_id, true AS vlan_tagged, src_ip, dst_ip, protocol, syn, rst,
  'VLAN packet does not contain an inner Ethernet frame' AS dropped FROM packets"""))
def _(spark, sf):
    rows = frames(packets(spark, sf), F.lit("VLAN")).select("packet_id", "ts_ms", "frame")
    dropped = decode_frames(rows, vlan="drop").select("packet_id", F.col("decode_error").alias("dropped"))
    return decode_frames(rows).join(dropped, "packet_id").select(
        "packet_id", "vlan_tagged", "src_ip", "dst_ip", "protocol", "syn", "rst", "dropped")


@query("ethertype_dispatch", sql("kinds", """
SELECT kind AS class, count(*) AS frames FROM (SELECT CASE kind WHEN 'odd' THEN 'unsupported' WHEN 'short' THEN 'unsupported'
  ELSE kind END AS kind FROM kinds) GROUP BY ALL"""))
def _(spark, sf):
    code = F.conv(F.hex(F.substr("frame", F.lit(13), F.lit(2))), 16, 10).cast("int")
    return raw_frames(spark, sf).groupBy(ethertype_class(code).alias("class")).agg(F.count(F.lit(1)).alias("frames"))


_NAMES = ", ".join(f"({n}, '{name}')" for n, name in protocol_table().items())
_CAPTURE = ", ".join(f"({n}, '{name}')" for n, name in protocol_table("capture").items())


@query("protocol_name", f"""
WITH iana(n, name) AS (VALUES {_NAMES}), capture(n, name) AS (VALUES {_CAPTURE})
SELECT p_partkey, coalesce(iana.name, 'Unknown') AS iana, CASE WHEN p_partkey % 300 >= 256 THEN 'unknown'
  ELSE coalesce(capture.name, 'proto:' || (p_partkey % 300)::VARCHAR) END AS capture
FROM part LEFT JOIN iana ON iana.n = p_partkey % 300 LEFT JOIN capture ON capture.n = p_partkey % 300""")
def _(spark, sf):
    number = F.when(F.col("p_partkey") % 300 < 256, F.col("p_partkey") % 300)
    return table(spark, sf, "part").select(
        "p_partkey", protocol_name(number).alias("iana"), protocol_name(number, "capture").alias("capture"))


@query("protocol_alias", sql("packets", """
SELECT packet_id,
  CASE packet_id % 5 WHEN 0 THEN 'ICMPv4' WHEN 1 THEN 'IPv6-ICMP' WHEN 2 THEN 'IPv6-ICMP' WHEN 3 THEN 'unknown'
    ELSE protocol END AS presence,
  CASE packet_id % 5 WHEN 0 THEN 'ICMPv4' WHEN 1 THEN 'IPv6 Hop-by-Hop Option' WHEN 2 THEN 'ICMPv6'
    WHEN 3 THEN 'any local network' ELSE protocol END AS features FROM packets"""))
def _(spark, sf):
    slot = F.col("packet_id") % 5
    name = (F.when(slot == 0, "ICMP").when(slot == 1, "IPv6 Hop-by-Hop Option").when(slot == 2, "ICMPv6")
            .when(slot == 3, "any local network").otherwise(F.col("protocol")))
    return packets(spark, sf).select(
        "packet_id", protocol_alias(name).alias("presence"), protocol_alias(name, "features").alias("features"))


@query("normalize_label", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS y,
  CASE WHEN event_id % 5 IN (1, 4) THEN -1 ELSE 1 END AS sign FROM events""")
def _(spark, sf):
    slot = F.col("event_id") % 5
    label = (F.when(slot == 0, " benign ").when(slot == 1, "malicious").when(slot == 2, "3")
             .when(slot == 3, F.col("event_type")).otherwise("Attack"))
    return table(spark, sf, "events").select(
        "event_id", normalize_label(label).cast("int").alias("y"), anomaly_sign(label).alias("sign"))


@query("display_protocol", sql("packets", """
SELECT packet_id, CASE WHEN packet_id % 4 = 0 THEN 'HTTP' WHEN packet_id % 4 = 3 THEN 'Unknown' ELSE protocol END AS shown
FROM packets"""))
def _(spark, sf):
    app = F.when(F.col("packet_id") % 4 == 0, "HTTP").when(F.col("packet_id") % 4 == 1, "")
    protocol = F.when(F.col("packet_id") % 4 != 3, F.col("protocol"))
    return packets(spark, sf).select("packet_id", display_protocol(app, protocol).alias("shown"))


@query("drop_arp", sql("packets", "SELECT packet_id, protocol FROM packets WHERE packet_id % 6 NOT IN (0, 1, 2)"))
def _(spark, sf):
    slot = F.col("packet_id") % 6
    listed = (F.when(slot == 0, "ARP").when(slot == 1, F.concat("protocol", F.lit(", arp")))
              .when(slot == 2, F.concat(F.lit("arp/"), "protocol"))
              .when(slot == 3, F.concat("protocol", F.lit(",sharp"))).otherwise(F.col("protocol")))
    return packets(spark, sf).withColumn("listed", listed).where(without_arp("listed")).select(
        "packet_id", "protocol")


@query("quarantine_malformed", sql("kinds", """
SELECT packet_id, CASE kind WHEN 'odd' THEN 'Unsupported EtherType: 0x88cc'
  WHEN 'short' THEN 'Frame too short for an Ethernet header' ELSE 'good' END AS error FROM kinds"""))
def _(spark, sf):
    good, bad = quarantine_malformed(decode_frames(raw_frames(spark, sf)))
    return good.select("packet_id", F.lit("good").alias("error")).unionByName(bad.select("packet_id", "error"))


@query("packet_class_counts", sql("kinds", """
SELECT CASE kind WHEN 'odd' THEN 'unknown' WHEN 'short' THEN 'non-Ethernet' ELSE kind END AS class,
  count(*) AS packets, count(*) FILTER (kind IN ('odd', 'short')) AS malformed FROM kinds GROUP BY 1"""))
def _(spark, sf):
    decoded = decode_frames(raw_frames(spark, sf))
    return decoded.groupBy(packet_class(decoded).alias("class")).agg(
        F.count(F.lit(1)).alias("packets"), F.count_if(F.col("decode_error").isNotNull()).alias("malformed"))


def _mac(digits: str) -> str:
    return ":".join(digits[i:i + 2] for i in range(0, 12, 2))


@query("arp_flows", sql("kinds", f"""
SELECT packet_id, '{_mac(SRC_MAC)}' AS src_ip, '{_mac(DST_MAC)}' AS dst_ip, ts_ms AS first_seen_ms, 'ARP' AS end_reason,
  'ARP' AS label, length::BIGINT AS bytes, 1::BIGINT AS packet_count, 0::BIGINT AS total_bytes_upstream,
  1.0::DOUBLE AS ratio_bytes_up_down, 1.0::DOUBLE AS flow_symmetry, 1.0::DOUBLE AS other_fraction
FROM kinds WHERE kind = 'ARP'"""))
def _(spark, sf):
    return arp_flows(decode_frames(raw_frames(spark, sf))).select(
        "packet_id", "src_ip", "dst_ip", "first_seen_ms", "end_reason", "label", "bytes", "packet_count",
        "total_bytes_upstream", "ratio_bytes_up_down", "flow_symmetry", "other_fraction")


@query("packet_delta", """
SELECT idx, coalesce(ts_ms - lag(ts_ms) OVER (ORDER BY idx), 0) AS delta_ms,
  greatest(coalesce(ts_ms - lag(ts_ms) OVER (ORDER BY idx), 0), 1) AS replay_ms
FROM (SELECT event_id * 7 AS idx, epoch_us(ts) // 1000 AS ts_ms FROM events)""")
def _(spark, sf):
    # Numbers with gaps, so that no slice ends with its last possible number.
    rows = packets(spark, sf).select(F.lit("capture").alias("file"), (F.col("packet_id") * 7).alias("idx"), "ts_ms")
    return rollups.packet_delta(rows, "file", "idx", slice_rows=5_000).select("idx", "delta_ms", "replay_ms")


@query("order_packets", sql("packets", "SELECT ts_ms, packet_id, length FROM packets ORDER BY ts_ms, packet_id"))
def _(spark, sf):
    return packets(spark, sf).select("ts_ms", "packet_id", "length").orderBy("ts_ms", "packet_id")


@query("offset_regression", """
SELECT * FROM (SELECT event_id AS arrival, event_id % 8 AS part,
  CASE WHEN event_id % 97 = 0 THEN event_id - 20 ELSE event_id END AS offset_no,
  lag(CASE WHEN event_id % 97 = 0 THEN event_id - 20 ELSE event_id END)
    OVER (PARTITION BY event_id % 8 ORDER BY event_id) AS previous FROM events) WHERE offset_no <= previous""")
def _(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(
        e.alias("arrival"), (e % 8).alias("part"), F.when(e % 97 == 0, e - 20).otherwise(e).alias("offset_no"))
    return rollups.regressions(rows, ["part"], "arrival", "offset_no", strict=True, slice_rows=5_000)


@query("timestamp_regression", sql("keyed", """
SELECT * FROM (SELECT packet_id, flow_key, packet_id % 4 AS part, ts_ms,
  lag(ts_ms) OVER (PARTITION BY packet_id % 4, flow_key ORDER BY packet_id) AS previous
  FROM (SELECT * REPLACE (ts_ms - CASE WHEN packet_id % 13 = 0 THEN 864000000 ELSE 0 END AS ts_ms) FROM keyed))
WHERE ts_ms < previous"""))
def _(spark, sf):
    # Every thirteenth packet carries a time ten days too early.
    shown = F.col("ts_ms") - F.when(F.col("packet_id") % 13 == 0, 864_000_000).otherwise(0)
    rows = packets(spark, sf).select(
        "packet_id", "flow_key", (F.col("packet_id") % 4).alias("part"), shown.alias("ts_ms"))
    return rollups.regressions(rows, ["part", "flow_key"], "packet_id", "ts_ms", strict=False, slice_rows=5_000)


@query("stored_packet_volume", sql("packets", """
SELECT ts_ms // 21600000 * 21600000 AS bucket_ms, protocol, count(*) AS packets, sum(length)::BIGINT AS bytes
FROM packets GROUP BY ALL"""))
def _(spark, sf):
    return rollups.packet_volume(packets(spark, sf), "6 hours")


@query("ingest_counters", sql("packets", """
SELECT bucket_ms, received, queue, (sum(received) OVER (ORDER BY bucket_ms))::BIGINT AS received_total
FROM (SELECT ts_ms // 3600000 * 3600000 AS bucket_ms, count(*) AS received, max(packet_id % 50) AS queue
      FROM packets GROUP BY 1)"""))
def _(spark, sf):
    return rollups.ingest_counters(packets(spark, sf), 3_600_000, F.col("packet_id") % 50)


_SAMPLES = """samples AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'FLOW_AGGREGATION_RATE'
  WHEN event_type = 'error' THEN 'SYSTEM_CPU' WHEN event_type = 'signup' THEN 'SYSTEM_RAM' ELSE 'OTHER' END AS type,
  value, epoch_us(ts) // 3600000000 * 3600000 AS timestamp FROM events)"""


@query("rate_per_second", f"""WITH {_SAMPLES}
SELECT type, round(sum(value), 6) AS rate, 'packets/s' AS unit, timestamp FROM samples
WHERE type = 'FLOW_AGGREGATION_RATE' GROUP BY type, timestamp""")
def _(spark, sf):
    out = metrics.rate_per_second(metric_samples(table(spark, sf, "events")), "1 hour")
    return out.withColumn("rate", r6("rate"))


@query("gauge_avg_per_second", f"""WITH {_SAMPLES}
SELECT type, round(CASE WHEN type = 'OTHER' THEN sum(value) ELSE avg(value) END, 6) AS rate,
  CASE WHEN type = 'OTHER' THEN '' ELSE '%' END AS unit, timestamp FROM samples
WHERE type <> 'FLOW_AGGREGATION_RATE' GROUP BY type, timestamp""")
def _(spark, sf):
    out = metrics.gauge_avg_per_second(metric_samples(table(spark, sf, "events")), "1 hour")
    return out.withColumn("rate", r6("rate"))


@query("stage_duration", """
SELECT o_orderpriority AS stage, (epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 1000 AS duration_ms
FROM orders GROUP BY 1""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("stage"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("ns"))
    return metrics.stage_duration(rows, "stage", F.col("ns"), F.col("ns")).select("stage", "duration_ms")


@query("export_packet_csv", sql("packets", """
SELECT row_number() OVER (ORDER BY ts_ms, packet_id) AS frame_no, src_ip, dst_ip, coalesce(src_port, 0)::VARCHAR AS src_port,
  coalesce(dst_port, 0)::VARCHAR AS dst_port, length FROM packets"""))
def _(spark, sf):
    path = shared_folder(spark, "packet-csv")
    export_packet_csv(packets(spark, sf), path, slice_ms=86_400_000)
    return read_packet_csv(spark, path)
