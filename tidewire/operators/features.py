"""Flow features, ARP flows and ordered packet lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewire.operators.ordered import time_rank
from tidewire.operators.sessionize import FlowRules, assign_packets, sessionize_flows
from tidewire.session import materialize

NAN = float("nan")

# The numeric features by their published names.
FEATURES = [
    "bytes", "packet_count", "duration_ms", "min_packet_length", "max_packet_length", "mean_packet_length",
    "stddev_packet_length", "bytes_per_second", "packets_per_second", "total_bytes_upstream",
    "total_bytes_downstream", "total_packets_upstream", "total_packets_downstream", "ratio_bytes_up_down",
    "ratio_packets_up_down", "flow_symmetry", "inter_arrival_time_min", "inter_arrival_time_max",
    "inter_arrival_time_mean", "inter_arrival_time_stddev", "syn_count", "fin_count", "rst_count", "ack_count",
    "psh_count", "tcp_fraction", "udp_fraction", "other_fraction", "syn_rate", "fin_rate", "rst_rate",
    "ack_rate", "psh_rate",
]


def _sample_stddev(n: Column, total: Column, squares: Column) -> Column:
    return F.sqrt(F.greatest(squares - total.cast("double") * total / n, F.lit(0.0)) / (n - 1))


def flow_features(flows: DataFrame) -> DataFrame:
    """All published features, from the additive sums of ``sessionize_flows``."""
    n, size = F.col("n"), F.col("bytes")
    span = F.col("last_seen_ms") - F.col("first_seen_ms")
    one_host = F.col("src_ip") == F.col("dst_ip")
    up_n = F.when(one_host, n).when(F.col("first_fwd"), F.col("fwd_n")).otherwise(n - F.col("fwd_n"))
    up_b = F.when(one_host, size).when(F.col("first_fwd"), F.col("fwd_bytes")).otherwise(size - F.col("fwd_bytes"))
    prepared = flows.withColumns({"up_n": up_n, "up_b": up_b}).withColumns(
        {"down_n": n - F.col("up_n"), "down_b": size - F.col("up_b"), "span": span})
    up_n, up_b, down_n, down_b, span = (F.col(c) for c in ("up_n", "up_b", "down_n", "down_b", "span"))
    gaps = n - 1

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(1.0)

    def rate(flag: str, without_tcp: float) -> Column:
        return F.when(F.col("tcp_n") > 0, F.col(flag) / F.col("tcp_n")).otherwise(without_tcp)

    return prepared.select(
        "flow_key", "flow_seq", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
        "first_seen_ms", "last_seen_ms", "end_reason", "first_packet_id",
        n.alias("packet_count"),
        "bytes",
        span.alias("duration_ms"),
        F.col("min_len").alias("min_packet_length"),
        F.col("max_len").alias("max_packet_length"),
        (size / n).alias("mean_packet_length"),
        F.when(n == 1, NAN).otherwise(_sample_stddev(n, size, F.col("sumsq"))).alias("stddev_packet_length"),
        F.when(span == 0, 0.0).otherwise(size * 1000 / span).alias("bytes_per_second"),
        F.when(span == 0, 0.0).otherwise(n * 1000 / span).alias("packets_per_second"),
        up_b.alias("total_bytes_upstream"),
        down_b.alias("total_bytes_downstream"),
        up_n.alias("total_packets_upstream"),
        down_n.alias("total_packets_downstream"),
        ratio(up_b, down_b).alias("ratio_bytes_up_down"),
        ratio(up_n, down_n).alias("ratio_packets_up_down"),
        F.when(size > 0, F.least(up_b, down_b) / F.greatest(up_b, down_b)).otherwise(1.0).alias("flow_symmetry"),
        F.when(n == 1, 0).when(F.col("many"), 0).otherwise(F.col("gap_min")).cast("long")
        .alias("inter_arrival_time_min"),
        F.coalesce("gap_max", F.lit(0)).cast("long").alias("inter_arrival_time_max"),
        F.when(n == 1, 0.0).otherwise(span / gaps).alias("inter_arrival_time_mean"),
        F.when(n == 1, 0.0).when(n == 2, NAN)
        .otherwise(_sample_stddev(gaps, span, F.coalesce("gap_sumsq", F.lit(0.0))))
        .alias("inter_arrival_time_stddev"),
        *[F.col(f).alias(f"{f}_count") for f in ("syn", "fin", "rst", "ack", "psh")],
        (F.col("tcp_n") / n).alias("tcp_fraction"),
        (F.col("udp_n") / n).alias("udp_fraction"),
        ((n - F.col("tcp_n") - F.col("udp_n")) / n).alias("other_fraction"),
        *[rate(f, 0.0).alias(f"{f}_rate") for f in ("syn", "fin", "rst", "ack")],
        rate("psh", -1.0).alias("psh_rate"),
    )


def flows_with_features(packets: DataFrame, rules: FlowRules | None = None) -> DataFrame:
    return flow_features(sessionize_flows(packets, rules))


def arp_flows(decoded: DataFrame) -> DataFrame:
    """Every ARP frame is its own flow: MAC endpoints, one key for both directions, ports 0, reason and label ARP."""
    ends = [F.concat_ws("_", a, b, F.lit("0_0_ARP")) for a, b in (("src_mac", "dst_mac"), ("dst_mac", "src_mac"))]
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    length = F.col("length").cast("long")
    return decoded.where(F.col("frame_class") == "ARP").select(
        F.least(*ends).alias("flow_key"),
        F.col("packet_id"),
        F.col("src_mac").alias("src_ip"), F.col("dst_mac").alias("dst_ip"),
        F.lit(0).alias("src_port"), F.lit(0).alias("dst_port"), F.lit("ARP").alias("protocol"),
        F.col("ts_ms").alias("first_seen_ms"), F.col("ts_ms").alias("last_seen_ms"),
        F.lit("ARP").alias("end_reason"), F.lit("ARP").alias("label"),
        F.lit(1).cast("long").alias("packet_count"), length.alias("bytes"), zero.alias("duration_ms"),
        length.alias("min_packet_length"), length.alias("max_packet_length"),
        length.cast("double").alias("mean_packet_length"), F.lit(NAN).alias("stddev_packet_length"),
        zero.alias("total_bytes_upstream"), zero.alias("total_bytes_downstream"),
        zero.alias("total_packets_upstream"), zero.alias("total_packets_downstream"),
        F.lit(1.0).alias("ratio_bytes_up_down"), F.lit(1.0).alias("ratio_packets_up_down"),
        F.lit(1.0).alias("flow_symmetry"), none.alias("inter_arrival_time_mean"),
        none.alias("tcp_fraction"), none.alias("udp_fraction"), F.lit(1.0).alias("other_fraction"),
    )


def flow_lists(packets: DataFrame, rules: FlowRules | None, value: Column, out: str,
               part_size: int = 10_000) -> DataFrame:
    """Values of the packets of each flow in arrival order: rows ``flow_key, flow_seq, part, out``.

    A list longer than ``part_size`` goes on in the next part, so no list is cut and none grows
    without bound. Packets are numbered only in flows that need more than one part."""
    rules = rules or FlowRules()
    names = ["flow_key", "flow_seq"]
    flows = materialize(sessionize_flows(packets, rules).select(
        *names, "first_seen_ms", "last_seen_ms", "first_packet_id", "n"), "flow-starts")
    placed = assign_packets(packets, flows, rules).where("flow_key is not null and flow_seq is not null")
    items = placed.select(*names, "ts_ms", "packet_id", value.alias(out))
    long = flows.where(F.col("n") > part_size).select(*names)
    some_long = not long.isEmpty()
    if some_long:
        items = materialize(items, "flow-items")

    def lists(rows: DataFrame, part: Column, *order: str) -> DataFrame:
        return (
            rows.groupBy(*names, part.cast("long").alias("part"))
            .agg(F.sort_array(F.collect_list(F.struct(*order, out))).alias("l"))
            .select(*names, "part", F.col(f"l.{out}").alias(out))
        )

    whole = lists(items.join(long, names, "left_anti") if some_long else items, F.lit(0), "ts_ms", "packet_id")
    if not some_long:
        return whole
    ranked = time_rank(items.join(long, names, "left_semi"), names, "ts_ms", "packet_id", rules.slice_ms, "pos")
    return whole.unionByName(lists(ranked, F.floor(F.col("pos") / part_size), "pos"))
