"""Schemas and published names."""

from __future__ import annotations

from pyspark.sql import types as T

ENVELOPE = T.StructType([
    T.StructField("timestamp", T.LongType()), T.StructField("ingestedAt", T.LongType()),
    T.StructField("delay", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("rawPacket", T.StringType()), T.StructField("flow_id", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("packet_id", T.LongType()),
])

PACKET_JSON = "srcIp string, dstIp string, protocol string, bytes long"
PACKET_CSV = "frame_no long, src_ip string, dst_ip string, src_port string, dst_port string, length int"
STORED_PACKETS = ["id", "timestamp", "srcIp", "dstIp", "protocol", "bytes", "rawPacket"]
METRICS = ["type", "rate", "unit", "timestamp"]

# Feature columns here and their published names.
PUBLISHED = {
    "flow_key": "flowKey", "first_seen_ms": "firstSeen", "last_seen_ms": "lastSeen", "src_ip": "srcIp",
    "dst_ip": "dstIp", "src_port": "srcPort", "dst_port": "dstPort", "protocol": "protocol", "bytes": "bytes",
    "packet_count": "packetCount", "end_reason": "reasonOfFlowEnd", "min_packet_length": "minPacketLength",
    "max_packet_length": "maxPacketLength", "mean_packet_length": "meanPacketLength",
    "stddev_packet_length": "stddevPacketLength", "bytes_per_second": "bytesPerSecond",
    "packets_per_second": "packetsPerSecond", "total_bytes_upstream": "totalBytesUpstream",
    "total_bytes_downstream": "totalBytesDownstream", "total_packets_upstream": "totalPacketsUpstream",
    "total_packets_downstream": "totalPacketsDownstream", "ratio_bytes_up_down": "ratioBytesUpDown",
    "ratio_packets_up_down": "ratioPacketsUpDown", "duration_ms": "flowDurationMs",
    "inter_arrival_time_mean": "interArrivalTimeMean", "inter_arrival_time_stddev": "interArrivalTimeStdDev",
    "inter_arrival_time_min": "interArrivalTimeMin", "inter_arrival_time_max": "interArrivalTimeMax",
    "flow_symmetry": "flowSymmetry", "syn_rate": "synRate", "fin_rate": "finRate", "rst_rate": "rstRate",
    "ack_rate": "ackRate", "psh_rate": "pshRate", "syn_count": "synCount", "fin_count": "finCount",
    "rst_count": "rstCount", "ack_count": "ackCount", "psh_count": "pshCount", "tcp_fraction": "tcpFraction",
    "udp_fraction": "udpFraction", "other_fraction": "otherFraction", "src_country": "srcCountry",
    "dst_country": "dstCountry", "src_domain": "srcDomain", "dst_domain": "dstDomain", "src_org": "srcOrg",
    "dst_org": "dstOrg", "label": "label",
}
_TEXT = {"flowKey", "srcIp", "dstIp", "protocol", "reasonOfFlowEnd", "srcCountry", "dstCountry", "srcDomain",
         "dstDomain", "srcOrg", "dstOrg", "label"}
_LONG = {"firstSeen", "lastSeen", "bytes", "packetCount", "synCount", "finCount", "rstCount", "ackCount", "pshCount"}

# Numbers are read as text first: they may arrive as "NaN" or "Infinity".
FLOW_JSON = T.StructType(
    [T.StructField(n, T.StringType()) for n in PUBLISHED.values()] + [T.StructField("flowSeq", T.StringType())])


def flow_json_type(name: str) -> str:
    return "string" if name in _TEXT else "long" if name in _LONG else "double"


# The columns of the feature CSV, in order, and where they come from.
FLOW_CSV = {
    "firstSeen": "first_seen_ms", "lastSeen": "last_seen_ms", "srcIp": "src_ip", "dstIp": "dst_ip",
    "srcPort": "src_port", "dstPort": "dst_port", "protocol": "protocol", "bytes": "bytes",
    "packets": "packet_count", "durationMs": "duration_ms", "totalBytesUpstream": "total_bytes_upstream",
    "totalBytesDownstream": "total_bytes_downstream", "totalPacketsUpstream": "total_packets_upstream",
    "totalPacketsDownstream": "total_packets_downstream", "minPacketLength": "min_packet_length",
    "maxPacketLength": "max_packet_length", "meanPacketLength": "mean_packet_length",
    "stddevPacketLength": "stddev_packet_length", "bytesPerSecond": "bytes_per_second",
    "packetsPerSecond": "packets_per_second", "interArrivalTimeMin": "inter_arrival_time_min",
    "interArrivalTimeMax": "inter_arrival_time_max", "interArrivalTimeMean": "inter_arrival_time_mean",
    "interArrivalTimeStdDev": "inter_arrival_time_stddev", "synCount": "syn_count", "ackCount": "ack_count",
    "pshCount": "psh_count", "rstCount": "rst_count", "finCount": "fin_count",
}
FLOW_CSV_TEXT = ["firstSeen", "lastSeen", "srcIp", "dstIp", "srcPort", "dstPort", "protocol"]
FLOW_CSV_COUNTS = ["synCount", "ackCount", "pshCount", "rstCount", "finCount"]
