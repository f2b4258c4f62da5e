"""Ethernet, IP and TCP/UDP header fields of frames, read from the bytes of a whole Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidewire.functions.keys import flow_key_bilateral
from tidewire.functions.protocols import protocol_name

# EtherTypes by class.
ETHER_CLASSES = {0x0800: "IPv4", 0x86DD: "IPv6", 0x0806: "ARP", 0x8100: "VLAN"}
# IPv6 extension headers that name a next header (hop-by-hop, routing, fragment, options).
HOP, ROUTING, FRAGMENT, OPTIONS = 0, 43, 44, 60
NO_NEXT = 59
TCP, UDP = 6, 17
#: The longest headers of an untagged IPv4 frame: Ethernet, IPv4 with all options, TCP. All fields lie in them.
IPV4_HEADERS = 14 + 60 + 20

FIELDS = {"ether_type": "int", "vlan_tagged": "boolean", "is4": "boolean", "is6": "boolean", "ip_proto": "int",
          "dst_mac": "string", "src_mac": "string", "src_ip": "string", "dst_ip": "string", "l4": "int",
          "src_port": "int", "dst_port": "int", "flags": "int", "seq": "bigint", "ack_no": "bigint"}
ARROW_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def header_fields(vlan: str):
    """The Arrow function behind ``decode_frames``: frame heads and frame lengths to ``FIELDS``."""
    inner_tags = vlan == "decode"
    spelled = {}  # filled once per worker

    def fields(heads: pa.Array, lengths: pa.Array) -> pa.Array:
        n = len(heads)
        if not spelled:
            spelled.update(decimal=pa.array([str(i) for i in range(256)]), octet=pa.array([f"{i:02x}" for i in range(256)]),
                           group=pa.array([f"{i:x}" for i in range(65536)]))
        heads = heads.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(heads.buffers()[1], np.int64, n + 1, heads.offset * 8)
        stored = heads.buffers()[2]
        data = np.frombuffer(stored, np.uint8) if stored is not None and stored.size else np.zeros(1, np.uint8)
        begin, size = offsets[:-1], np.diff(offsets)
        length = lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

        def read(at, width: int, rows=slice(None)):
            """Number of ``width`` bytes at byte ``at`` of each row, and whether the head reaches that far."""
            there = at + width <= size[rows]
            first = np.where(there, begin[rows] + at, 0)
            value = np.zeros(len(first), np.int64)
            for i in range(width):
                value = (value << 8) | data[np.minimum(first + i, len(data) - 1)]
            return np.where(there, value, 0), there

        outer, has_type = read(0 * begin + 12, 2)
        tagged = has_type & (outer == 0x8100)
        ether, l3 = outer, 0 * begin + 14
        if inner_tags:
            inner, has_inner = read(0 * begin + 16, 2)
            ether, l3 = np.where(tagged, inner, outer), np.where(tagged, 18, 14)
            has_type = np.where(tagged, has_inner, has_type)
        first_byte, _ = read(l3, 1)
        options_end = (first_byte & 15) * 4
        total, has_total = read(l3 + 2, 2)
        is4 = (has_type & (ether == 0x0800) & (first_byte >> 4 == 4) & (options_end >= 20)
               & (length >= l3 + options_end) & has_total & (total >= options_end))
        is6 = has_type & (ether == 0x86DD) & (first_byte >> 4 == 6) & (length >= l3 + 40)
        is_ip = is4 | is6
        proto = np.where(is_ip, read(np.where(is4, l3 + 9, l3 + 6), 1)[0], -1)
        l4_at = np.where(is4, l3 + options_end, l3 + 40)
        in_parts = is4 & (read(l3 + 6, 2)[0] & 0x3FFF != 0)

        # Extension headers: each round moves every frame still inside them by at least eight bytes.
        kind, at = proto.copy(), l4_at.copy()
        rows = np.flatnonzero(is6 & np.isin(kind, (HOP, ROUTING, FRAGMENT, OPTIONS)))
        while len(rows):
            place, plain = at[rows], np.isin(kind[rows], (HOP, ROUTING, OPTIONS))
            part, has_part = read(place + 2, 2, rows)
            # A fragment header of a whole packet is passed; parts of packets end the walk.
            moves = plain | (has_part & (part & 0xFFF9 == 0))
            following, has_following = read(place, 1, rows)
            more, _ = read(place + 1, 1, rows)
            kind[rows] = np.where(moves, np.where(has_following, following, NO_NEXT), kind[rows])
            at[rows] = np.where(moves, place + np.where(plain, (more + 1) * 8, 8), place)
            rows = rows[moves & np.isin(kind[rows], (HOP, ROUTING, FRAGMENT, OPTIONS))]

        tcp = ~in_parts & (kind == TCP) & (length >= at + 20)
        udp = ~in_parts & (kind == UDP) & (length >= at + 8)
        direct = (tcp | udp) & np.isin(proto, (TCP, UDP))
        ethernet = length >= 14

        def texts(form: str, at, width: int, parts: int, sign: str, known) -> pa.Array:
            """``parts`` numbers of ``width`` bytes from byte ``at`` on, spelled as ``form``; null where not known."""
            rows = np.flatnonzero(known)
            if not len(rows):
                return pa.nulls(n, pa.string())
            first = (at + 0 * begin)[rows]
            pieces = [spelled[form].take(pa.array(read(first + i * width, width, rows)[0])) for i in range(parts)]
            joined = pc.binary_join_element_wise(*pieces, sign)
            places = np.cumsum(known) - 1
            return joined.take(pa.array(places, mask=~known))

        def addresses(at4: int, at6: int) -> pa.Array:
            return pc.coalesce(texts("decimal", l3 + at4, 1, 4, ".", is4), texts("group", l3 + at6, 2, 8, ":", is6))

        columns = {
            "ether_type": (ether, has_type), "vlan_tagged": (tagged, None), "is4": (is4, None), "is6": (is6, None),
            "ip_proto": (proto, is_ip),
            "dst_mac": (texts("octet", 0, 1, 6, ":", ethernet), None),
            "src_mac": (texts("octet", 6, 1, 6, ":", ethernet), None),
            "src_ip": (addresses(12, 8), None), "dst_ip": (addresses(16, 24), None),
            "l4": (np.where(tcp, TCP, np.where(udp, UDP, 0)), None),
            "src_port": (read(l4_at, 2)[0], direct), "dst_port": (read(l4_at + 2, 2)[0], direct),
            "flags": (read(at + 13, 1)[0], tcp), "seq": (read(at + 4, 4)[0], tcp), "ack_no": (read(at + 8, 4)[0], tcp),
        }
        return pa.StructArray.from_arrays(
            [values if isinstance(values, pa.Array)
             else pa.array(values, ARROW_TYPES[FIELDS[name]], mask=None if known is None else ~known, safe=False)
             for name, (values, known) in columns.items()], names=list(columns))

    # Not to be copied into every filter and column that reads it.
    return F.arrow_udf(fields, ", ".join(f"{c} {t}" for c, t in FIELDS.items())).asNondeterministic()


def ethertype_class(ether_type: Column | str) -> Column:
    """IPv4, IPv6, ARP, VLAN or "unsupported"."""
    ether_type = F.col(ether_type) if isinstance(ether_type, str) else ether_type
    out = None
    for value, name in ETHER_CLASSES.items():
        out = F.when(ether_type == value, name) if out is None else out.when(ether_type == value, name)
    return out.otherwise("unsupported")


def decode_frames(df: DataFrame, vlan: str = "decode") -> DataFrame:
    """Add the header fields of ``frame``.

    Ports are read only where TCP or UDP is the direct payload of the outermost IP header; flags and
    ``l4_kind`` also behind IPv6 extension headers, however many. ``vlan='drop'`` leaves VLAN frames undecoded.
    ``decode_error`` names what keeps a frame from being used."""
    if vlan not in ("decode", "drop"):
        raise ValueError("vlan is 'decode' or 'drop'")
    # Only IPv6 and tagged frames may have headers beyond those of IPv4.
    long_headers = F.hex(F.substring("frame", 13, 2)).isin("86DD", "8100")
    head = F.when(long_headers, F.col("frame")).otherwise(F.substring("frame", 1, IPV4_HEADERS))
    step = df.withColumn("length", F.octet_length("frame").cast("int"))
    step = step.withColumn("__f", header_fields(vlan)(head, F.col("length")))
    f = {name: F.col(f"__f.{name}") for name in FIELDS}
    is4, is6 = f["is4"], f["is6"]
    frame_class = ethertype_class(f["ether_type"])

    def flag(bit: int) -> Column:
        return F.coalesce(f["flags"].bitwiseAND(bit) != 0, F.lit(False))

    return step.withColumns({
        "vlan_tagged": f["vlan_tagged"], "ether_type": f["ether_type"], "frame_class": frame_class,
        "ip_proto": f["ip_proto"],
        "dst_mac": f["dst_mac"], "src_mac": f["src_mac"], "src_ip": f["src_ip"], "dst_ip": f["dst_ip"],
        "protocol": F.when(is4 | is6, protocol_name(f["ip_proto"], "decoder")),
        "src_port": f["src_port"], "dst_port": f["dst_port"],
        "l4_kind": F.when(f["l4"] == TCP, "TCP").when(f["l4"] == UDP, "UDP").otherwise("OTHER"),
        "seq": f["seq"], "ack_no": f["ack_no"],
        "fin": flag(0x01), "syn": flag(0x02), "rst": flag(0x04), "psh": flag(0x08), "ack": flag(0x10),
        "decode_error": (
            F.when(F.col("length") < 14, "Frame too short for an Ethernet header")
            .when(frame_class == "unsupported",
                  F.concat(F.lit("Unsupported EtherType: 0x"), F.lower(F.hex(f["ether_type"]))))
            .when(frame_class == "VLAN", "VLAN packet does not contain an inner Ethernet frame")
            .when(frame_class.isin("IPv4", "IPv6") & ~is4 & ~is6, "Not an IP packet")),
    }).drop("__f")


def ip_packets(decoded: DataFrame) -> DataFrame:
    """Decoded IP packets, with their flow key, as ``sessionize_flows`` reads them."""
    return decoded.where(F.col("decode_error").isNull() & F.col("frame_class").isin("IPv4", "IPv6")).withColumn(
        "flow_key", flow_key_bilateral())


def quarantine_malformed(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to go on with, and rows for the side output with their error text."""
    good = decoded.where(F.col("decode_error").isNull())
    bad = decoded.where(F.col("decode_error").isNotNull())
    return good, bad.select("packet_id", "ts_ms", F.col("decode_error").alias("error"),
                            F.base64("frame").alias("raw_data"))


def packet_class(decoded: DataFrame) -> Column:
    """Class of a decoded frame for counting."""
    return (
        F.when(F.col("length") < 14, "non-Ethernet")
        .when(F.col("frame_class") == "unsupported", "unknown")
        .when(F.col("decode_error").isNotNull(), "not IP")
        .when(F.col("vlan_tagged"), "VLAN")
        .otherwise(F.col("frame_class"))
    )
