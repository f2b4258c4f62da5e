"""Packet envelopes, flow records, CSV and JSON inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewire import schemas
from tidewire.functions.text import safe_double

RESET, DONE = "reset", "PCAP_DONE"


def text_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Records ``value`` from text files as they appear; the rate limit is files per trigger."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, offsets_per_trigger: int | None = None) -> DataFrame:
    """Records ``value`` from a topic; needs the Kafka connector on the class path."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic).option("startingOffsets", "earliest"))
    if offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", offsets_per_trigger)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def record_kind(value: Column, status: Column) -> Column:
    """empty, reset, done or data."""
    return (
        F.when(value.isNull() | (F.trim(value) == ""), "empty").when(F.trim(value) == RESET, "reset")
        .when((status == DONE) | (F.trim(value) == DONE), "done").otherwise("data")
    )


def parse_envelopes(records: DataFrame) -> DataFrame:
    """Records with their ``kind`` and the envelope fields."""
    parsed = records.withColumn("e", F.from_json("value", schemas.ENVELOPE))
    return parsed.select("value", record_kind(F.col("value"), F.col("e.status")).alias("kind"), "e.*")


def drop_control_records(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("kind") == "data")


def envelope_packets(records: DataFrame) -> DataFrame:
    """Envelopes to ``packet_id, ts_ms, ingested_at_ms, named_length, frame``.

    Without a packet number in the envelope, the id is a hash of time and bytes: stable on a replay."""
    rows = drop_control_records(parse_envelopes(records)).where(F.col("rawPacket").isNotNull())
    hashed = F.xxhash64("timestamp", "ingestedAt", "rawPacket").bitwiseAND((1 << 61) - 1)
    return rows.select(
        F.coalesce("packet_id", hashed).alias("packet_id"), F.col("timestamp").alias("ts_ms"),
        F.col("ingestedAt").alias("ingested_at_ms"), F.col("length").alias("named_length"),
        F.try_to_binary("rawPacket", F.lit("base64")).alias("frame"))


def to_envelopes(frames: DataFrame, flow_id: Column | None = None) -> DataFrame:
    """Envelope JSON text of frames."""
    return frames.select(F.to_json(F.struct(
        F.col("ts_ms").alias("timestamp"), F.col("ingested_at_ms").alias("ingestedAt"),
        F.lit(0).alias("delay"), F.base64("frame").alias("rawPacket"),
        (F.lit(None).cast("string") if flow_id is None else flow_id).alias("flow_id"), "packet_id")).alias("value"))


def parse_flow_records(records: DataFrame) -> DataFrame:
    """Flow JSON to typed columns. Numbers may be text such as "NaN"; control records are left out."""
    parsed = records.withColumn("f", F.from_json("value", schemas.FLOW_JSON))
    data = parsed.where((record_kind(F.col("value"), F.lit(None).cast("string")) == "data")
                        & F.col("f.flowKey").isNotNull())

    def field(column: str, name: str) -> Column:
        kind = schemas.flow_json_type(name)
        raw = F.col(f"f.{name}")
        if kind == "string":
            return raw.alias(column)
        if name in ("srcPort", "dstPort"):
            return raw.try_cast("int").alias(column)
        return safe_double(raw).cast(kind).alias(column)

    return data.select(*[field(c, n) for c, n in schemas.PUBLISHED.items()],
                       F.col("f.flowSeq").try_cast("long").alias("flow_seq"))


def read_packet_csv(spark: SparkSession, path: str) -> DataFrame:
    """Packet CSV without a header; empty cells read "0"."""
    rows = spark.read.schema(schemas.PACKET_CSV).csv(path)
    return rows.fillna("0", ["src_ip", "dst_ip", "src_port", "dst_port"])


def read_flow_csv(spark: SparkSession, path: str) -> DataFrame:
    """Feature CSV with a header. Cells are read as text and cast, bad numbers become null."""
    rows = spark.read.option("header", True).schema(
        ", ".join(f"{n} string" for n in schemas.FLOW_CSV)).csv(path)
    return rows.select(*[F.col(n) if n in schemas.FLOW_CSV_TEXT else F.col(n).try_cast("double").alias(n)
                         for n in schemas.FLOW_CSV])


def read_packet_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON arrays of packets: one array per file, or per line with ``multi_line=False`` (splittable)."""
    return spark.read.schema(schemas.PACKET_JSON).option("multiLine", multi_line).json(path)
