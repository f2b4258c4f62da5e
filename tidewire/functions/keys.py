"""Flow keys, packet ids and cross-tool signatures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def flow_key_directed(src_ip="src_ip", dst_ip="dst_ip", src_port="src_port", dst_port="dst_port",
                      protocol="protocol") -> Column:
    """``src_dst_sport_dport_proto``; a missing port reads "null", a missing protocol "UNKNOWN"."""
    return F.concat_ws(
        "_",
        F.coalesce(_c(src_ip), F.lit("null")),
        F.coalesce(_c(dst_ip), F.lit("null")),
        F.coalesce(_c(src_port).cast("string"), F.lit("null")),
        F.coalesce(_c(dst_port).cast("string"), F.lit("null")),
        F.coalesce(_c(protocol), F.lit("UNKNOWN")),
    )


def flow_key_bilateral(src_ip="src_ip", dst_ip="dst_ip", src_port="src_port", dst_port="dst_port",
                       protocol="protocol") -> Column:
    """The smaller of both directed keys, so that both directions share one key."""
    return F.least(
        flow_key_directed(src_ip, dst_ip, src_port, dst_port, protocol),
        flow_key_directed(dst_ip, src_ip, dst_port, src_port, protocol),
    )


def packet_flag(rst="rst", fin="fin", syn="syn", ack="ack") -> Column:
    """First of RST, FIN, SYN, ACK that is set, else the empty text."""
    return (
        F.when(_c(rst), "RST").when(_c(fin), "FIN").when(_c(syn), "SYN").when(_c(ack), "ACK").otherwise("")
    )


def packet_label(src_ip="src_ip", dst_ip="dst_ip", protocol="protocol", ts_ms="ts_ms") -> Column:
    """Readable packet id ``P_src_dst_proto_flag_ts``."""
    return F.concat_ws("_", F.lit("P"), _c(src_ip), _c(dst_ip), _c(protocol), packet_flag(),
                       _c(ts_ms).cast("string"))


# Names that differ between tools, for the presence and the feature comparison.
PRESENCE_ALIASES = {
    "ICMP": "ICMPv4",
    "IPv6 Hop-by-Hop Option": "IPv6-ICMP",
    "ICMPv6": "IPv6-ICMP",
    "any local network": "unknown",
}
FEATURE_ALIASES = {
    "IPv6-ICMP": "IPv6 Hop-by-Hop Option",
    "ICMP": "ICMPv4",
}


def protocol_alias(protocol: Column | str, mode: str = "presence") -> Column:
    """One spelling per protocol for cross-tool comparison (``presence`` or ``features``)."""
    protocol = _c(protocol)
    out = None
    for name, alias in {"presence": PRESENCE_ALIASES, "features": FEATURE_ALIASES}[mode].items():
        out = F.when(protocol == name, alias) if out is None else out.when(protocol == name, alias)
    return out.otherwise(protocol)


def flow_signature(src_ip="src_ip", dst_ip="dst_ip", src_port="src_port", dst_port="dst_port",
                   protocol="protocol", first_seen: Column | str | None = None) -> Column:
    """Text key for matching flows of two tools; with ``first_seen`` it is the feature variant.

    Addresses are expected in normal form (``normalize_ip``)."""
    def port(p):
        return F.coalesce(F.nullif(_c(p).cast("string"), F.lit("")), F.lit("0"))

    mode = "presence" if first_seen is None else "features"
    parts = [_c(src_ip), _c(dst_ip), port(src_port), port(dst_port), protocol_alias(protocol, mode)]
    if first_seen is not None:
        parts.append(_c(first_seen).cast("string"))
    return F.concat_ws("_", *parts)
