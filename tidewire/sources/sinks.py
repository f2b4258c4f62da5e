"""Stored packets, flows, metrics and CSV exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewire import schemas
from tidewire.functions.keys import packet_label
from tidewire.functions.text import format_ts_ms
from tidewire.operators.features import flow_lists
from tidewire.operators.ordered import time_rank
from tidewire.operators.sessionize import FlowRules

NUMBERS = [c for c, n in schemas.PUBLISHED.items() if schemas.flow_json_type(n) != "string"
           and c not in ("first_seen_ms", "last_seen_ms", "duration_ms")]
NAMES = ["src_country", "dst_country", "src_domain", "dst_domain", "src_org", "dst_org", "label"]


def flow_defaults(flows: DataFrame, now_ms: Column) -> DataFrame:
    """Defaults for missing fields. A missing column counts as a missing field; ports stay null."""
    def field(c: str) -> Column:
        return F.col(c) if c in flows.columns else F.lit(None)

    first = F.coalesce(field("first_seen_ms").cast("long"), now_ms)
    last = F.coalesce(field("last_seen_ms").cast("long"), first)
    filled = {
        "first_seen_ms": first, "last_seen_ms": last,
        "src_ip": F.coalesce(field("src_ip").cast("string"), F.lit("0.0.0.0")),
        "dst_ip": F.coalesce(field("dst_ip").cast("string"), F.lit("0.0.0.0")),
        "protocol": F.coalesce(field("protocol").cast("string"), F.lit("UNKNOWN")),
        "flow_key": F.coalesce(field("flow_key").cast("string"), F.lit("N/A")),
        "end_reason": F.coalesce(field("end_reason").cast("string"), F.lit("N/A")),
        "duration_ms": F.coalesce(field("duration_ms").cast("long"), last - first),
        "src_port": field("src_port").cast("int"), "dst_port": field("dst_port").cast("int"),
        **{c: F.coalesce(field(c).cast("string"), F.lit("N/A")) for c in NAMES},
        **{c: F.coalesce(field(c).cast("string").try_cast("double"), F.lit(0.0)).cast(
            "long" if schemas.flow_json_type(schemas.PUBLISHED[c]) == "long" else "double")
           for c in NUMBERS if c not in ("src_port", "dst_port")},
    }
    return flows.withColumns(filled)


def stored_packet_rows(decoded: DataFrame) -> DataFrame:
    """The seven stored columns; frames without IP have empty addresses and protocol UNKNOWN."""
    return decoded.select(
        packet_label(F.coalesce("src_ip", F.lit("")), F.coalesce("dst_ip", F.lit("")),
                     F.coalesce("protocol", F.lit("UNKNOWN"))).alias("id"),
        F.timestamp_millis("ts_ms").alias("timestamp"),
        F.coalesce("src_ip", F.lit("")).alias("srcIp"), F.coalesce("dst_ip", F.lit("")).alias("dstIp"),
        F.coalesce("protocol", F.lit("UNKNOWN")).alias("protocol"), F.col("length").cast("long").alias("bytes"),
        F.base64("frame").alias("rawPacket"))


def write_by_date(rows: DataFrame, path: str, ts: Column, order: list[str], mode: str = "append") -> None:
    """Parquet in date folders, sorted inside each file so that scans skip by min and max.

    Rows go to the date folder from the task they are in: a busy day is not gathered in one task."""
    dated = rows.withColumn("date", F.to_date(ts)).sortWithinPartitions("date", *order)
    dated.write.mode(mode).partitionBy("date").parquet(path)


def write_packets(decoded: DataFrame, path: str, mode: str = "append") -> None:
    write_by_date(stored_packet_rows(decoded), path, F.col("timestamp"), ["timestamp"], mode)


def stored_flow_rows(flows: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """Stored flow columns by their published names; ``id`` is the same on a replay.

    A flow is known by its number in its key, or where a stream does not know that by its first packet."""
    now_ms = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    filled = flow_defaults(flows, now_ms)
    number = F.col("flow_seq").cast("string")
    if "first_packet_id" in flows.columns:
        number = F.coalesce(number, F.concat(F.lit("p"), F.col("first_packet_id").cast("string")))
    identity = F.sha2(F.concat_ws("|", "flow_key", F.col("first_seen_ms").cast("string"), number), 256)
    return filled.select(
        identity.alias("id"),
        *[F.timestamp_millis(c).alias(n) if c in ("first_seen_ms", "last_seen_ms")
          else F.col(c).cast("string").alias(n) if c in ("src_port", "dst_port")
          else F.col(c).alias("packets" if n == "packetCount" else n) for c, n in schemas.PUBLISHED.items()],
        F.col("duration_ms").alias("durationMs"))


def stored_flow_lists(packets: DataFrame, rules: FlowRules, processed_at_ms: Column) -> DataFrame:
    """Packet ids and delays of each flow in arrival order: ``flow_key, flow_seq, part, packetSummaries,
    treatmentDelay``. They are stored beside the flows, in parts, because a flood's list has no bound."""
    delay = processed_at_ms - (F.coalesce("ingested_at_ms", F.lit(0)) if "ingested_at_ms" in packets.columns else F.lit(0))
    both = flow_lists(packets, rules, F.struct(packet_label().alias("id"), delay.cast("long").alias("delay")), "item")
    return both.select("flow_key", "flow_seq", "part", F.col("item.id").alias("packetSummaries"),
                       F.col("item.delay").alias("treatmentDelay"))


def write_flows(flows: DataFrame, path: str, mode: str = "append", now_ms: Column | None = None) -> None:
    write_by_date(stored_flow_rows(flows, now_ms), path, F.col("firstSeen"), ["firstSeen", "flowKey"], mode)


def write_metrics(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.select(*schemas.METRICS).write.mode(mode).parquet(path)


def publish_flows(flows: DataFrame) -> DataFrame:
    """``key, value`` records for a topic or a file: the flow as JSON, NaN as the text "NaN"."""
    named = [F.col(c).alias(n) for c, n in schemas.PUBLISHED.items() if c in flows.columns]
    return flows.select(F.col("flow_key").alias("key"),
                        F.to_json(F.struct(*named, F.col("flow_seq").alias("flowSeq"))).alias("value"))


def numbered_packets(packets: DataFrame, slice_ms: int = 60_000) -> DataFrame:
    """Packets with ``frame_no`` 1, 2, ... in the order (time, id), without one global window."""
    ranked = time_rank(packets, [], "ts_ms", "packet_id", slice_ms, "frame_no")
    return ranked.withColumn("frame_no", F.col("frame_no") + 1)


def export_packet_csv(packets: DataFrame, path: str, limit: int | None = None, slice_ms: int = 60_000) -> None:
    """``frame_no, srcIp, dstIp, sport, dport, length`` in arrival order, without a header.

    ``limit`` stops after so many frames, as the export it stands for does."""
    rows = numbered_packets(packets, slice_ms).select(
        "frame_no", "src_ip", "dst_ip", "src_port", "dst_port", "length")
    if limit is not None:
        rows = rows.where(F.col("frame_no") <= limit)
    rows.orderBy("frame_no").write.csv(path)


def flow_csv_rows(flows: DataFrame) -> DataFrame:
    """The 29 columns of the feature CSV."""
    def cell(name: str, c: str) -> Column:
        if name in ("firstSeen", "lastSeen"):
            return format_ts_ms(c, "000000").alias(name)
        if name in FLOAT_COLUMNS:
            return F.col(c).cast("double").alias(name)
        return F.col(c).alias(name)

    return flows.select(*[cell(n, c) for n, c in schemas.FLOW_CSV.items()])


FLOAT_COLUMNS = [n for n in schemas.FLOW_CSV if n not in schemas.FLOW_CSV_TEXT + schemas.FLOW_CSV_COUNTS]


def export_flow_csv(flows: DataFrame, path: str) -> None:
    """Feature CSV with a header, sorted by first packet time (range partitioned)."""
    flow_csv_rows(flows).orderBy("firstSeen").write.option("header", True).csv(path)


def write_scored_flows(scored: DataFrame, path: str) -> None:
    """Input rows with score, prediction and label columns as CSV."""
    scored.write.option("header", True).csv(path)
