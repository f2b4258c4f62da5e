"""Country, organisation and host names for flow endpoints.

Addresses are looked up once each: the distinct addresses of all flows meet the
reference table, and the answers join back."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewire.functions.addresses import ip_sort_key, is_private_ip, is_valid_ip
from tidewire.functions.text import parse_whois_org
from tidewire.session import materialize

INVALID, PRIVATE, MISSING = "Invalid IP", "Private IP", "N/A"

V4_PREFIX = "0" * 20 + "ffff"
#: Prefixes of at most so many bits of their family are few by their number alone: fewer than 2 ** (SHORT_BITS + 1).
SHORT_BITS = 16
#: Longer prefixes than this are asked for only by addresses that share their first so many bits with one.
HEAD_BITS = 28


def _cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Splits each range into the fewest blocks that are prefixes, and those into whole hex digits: ``v4, digits, prefix,
    bits, value``. A block of ``bits`` bits becomes at most eight prefixes of the next whole number of digits."""
    for pdf in batches:
        out = []
        for start, end, value in zip(pdf["start"], pdf["end"], pdf["value"]):
            v4 = start.startswith(V4_PREFIX) and end.startswith(V4_PREFIX)
            low, high = int(start, 16), int(end, 16)
            while low <= high:
                size = low & -low or 1 << 128
                while low + size - 1 > high:
                    size >>= 1
                bits = 129 - size.bit_length()
                digits = -(-bits // 4)
                first = low >> (128 - 4 * digits)
                out += [(v4, digits, f"{first + i:0{digits}x}" if digits else "", bits, value)
                        for i in range(1 << (4 * digits - bits))]
                low += size
        yield pd.DataFrame(out, columns=["v4", "digits", "prefix", "bits", "value"])


@dataclass(frozen=True)
class Prefixes:
    """Ranges as the prefixes that cover them, written once, and the numbers of digits that occur."""

    blocks: DataFrame
    lengths: list[tuple[bool, int]]  # at most 33 for each family


def prefixes(ranges: DataFrame, value: str) -> Prefixes:
    """``start_ip, end_ip, value`` made ready for any number of lookups."""
    bounds = ranges.select(ip_sort_key("start_ip").alias("start"), ip_sort_key("end_ip").alias("end"),
                           F.col(value).cast("string").alias("value")).where("start is not null and end is not null")
    blocks = bounds.mapInPandas(_cover, "v4 boolean, digits int, prefix string, bits int, value string")
    blocks = materialize(blocks.groupBy("v4", "digits", "prefix").agg(F.max(F.struct("bits", "value")).alias("b")).select(
        "v4", "digits", "prefix", "b.*"), "prefixes")
    return Prefixes(blocks, [(r.v4, r.digits) for r in blocks.select("v4", "digits").distinct().collect()])


def range_lookup(ips: DataFrame, ranges: DataFrame | Prefixes, value: str, ip: str = "ip") -> DataFrame:
    """Distinct addresses ``ip`` with the ``value`` of the range that holds them (null: none).

    ``ranges`` has ``start_ip, end_ip, value``, or is what ``prefixes`` made of such a table. Each range becomes the few prefixes that cover it, at most 254 of any
    length from 0 to 128 bits, each spelled in whole hex digits. An address is looked up once per number of digits that
    occurs, by equality; the longest match wins, of equal ones the greatest value. Short prefixes, which very many
    addresses share, are few by their number of bits and broadcast; the others meet by hash. Long ones are asked for only
    by addresses whose first ``HEAD_BITS`` bits are those of a long one."""
    key = F.col("at")
    keyed = ips.select(F.col(ip).alias("ip"), ip_sort_key(ip).alias("at")).where(key.isNotNull()).select(
        "ip", "at", key.startswith(V4_PREFIX).alias("v4"))
    known = ranges if isinstance(ranges, Prefixes) else prefixes(ranges, value)
    blocks, lengths = known.blocks, known.lengths

    def own_bits(v4: bool, digits: int) -> int:
        return 4 * digits - 96 * v4

    def hits(rows: DataFrame, wanted: list, short: bool) -> DataFrame:
        probes = F.array(*[F.struct(F.lit(v4).alias("v4"), F.lit(digits).alias("digits"), F.left(key, F.lit(digits)).alias("prefix"))
                           for v4, digits in sorted(wanted)])
        probed = rows.select("ip", "v4", F.explode(F.filter(probes, lambda p: p["v4"] == F.col("v4"))).alias("p")).select(
            "ip", "p.*")
        own = 4 * F.col("digits") - F.when(F.col("v4"), 96).otherwise(0)
        side = blocks.where((own <= SHORT_BITS) == short)
        return probed.join(F.broadcast(side) if short else side, ["v4", "digits", "prefix"]).select("ip", "bits", "value")

    found = keyed.select("ip", F.lit(-1).alias("bits"), F.lit(None).cast("string").alias("value"))
    for low, high in ((-1000, SHORT_BITS), (SHORT_BITS, HEAD_BITS), (HEAD_BITS, 128)):
        wanted = [at for at in lengths if low < own_bits(*at) <= high]
        if not wanted:
            continue
        rows = keyed
        if low == HEAD_BITS:
            def head(c: str) -> Column:
                return F.left(F.col(c), F.when(F.col("v4"), 24 + HEAD_BITS // 4).otherwise(HEAD_BITS // 4))

            own = 4 * F.col("digits") - F.when(F.col("v4"), 96).otherwise(0)
            heads = blocks.where(own > HEAD_BITS).select("v4", head("prefix").alias("head")).distinct()
            rows = keyed.withColumn("head", head("at")).join(heads, ["v4", "head"], "left_semi")
        found = found.unionByName(hits(rows, wanted, high == SHORT_BITS))
    best = found.groupBy("ip").agg(F.max(F.struct("bits", "value"))["value"].alias("v"))
    return best.select("ip", F.col("v").alias(value))


def _geo_answer(ip: Column, found: Column) -> Column:
    return (
        F.when(~is_valid_ip(ip), INVALID).when(is_private_ip(ip), PRIVATE)
        .otherwise(F.coalesce(found, F.lit(PRIVATE)))
    )


def enrich_ranges(ips: DataFrame, ranges: DataFrame | Prefixes, value: str, out: str) -> DataFrame:
    """Country or organisation per distinct address, with the rules for invalid, private and unknown ones."""
    public = ips.where(is_valid_ip("ip") & ~is_private_ip("ip"))
    found = range_lookup(public, ranges, value)
    return ips.join(found, "ip", "left").select("ip", _geo_answer(F.col("ip"), F.col(value)).alias(out))


def enrich_country(ips: DataFrame, geo: DataFrame) -> DataFrame:
    return enrich_ranges(ips, geo, "country", "country")


def enrich_org(ips: DataFrame, asn: DataFrame) -> DataFrame:
    return enrich_ranges(ips, asn, "org", "asn_org")


def enrich_domain(ips: DataFrame, rdns: DataFrame) -> DataFrame:
    """Host name per address; the address itself when it has no name, N/A when it is no address."""
    return ips.join(rdns.select("ip", "host"), "ip", "left").select(
        "ip", F.when(~is_valid_ip("ip"), MISSING).otherwise(F.coalesce("host", "ip")).alias("domain"))


def enrich_whois_org(ips_with_asn: DataFrame, whois: DataFrame, double_parse: bool = False) -> DataFrame:
    """WHOIS organisation per address, else the one of the address range.

    ``double_parse`` parses the parsed text again, which finds nothing: the range's one always wins
    unless there is no WHOIS answer."""
    joined = ips_with_asn.join(whois.select("ip", "raw"), "ip", "left")
    parsed = parse_whois_org("raw", "No match")
    if double_parse:
        parsed = F.when(F.col("raw").isNull(), MISSING).otherwise("No match")
    return joined.withColumn("w", parsed).select(
        "ip", "asn_org",
        F.when(F.col("w") == "", MISSING).when(F.col("w").contains("No match"), F.col("asn_org"))
        .when(F.col("raw").isNull(), F.col("asn_org")).otherwise(F.col("w")).alias("org"))


def endpoint_facts(flows: DataFrame, geo: DataFrame, asn: DataFrame, rdns: DataFrame,
                   whois: DataFrame) -> DataFrame:
    """One row per distinct endpoint address: ``ip, country, domain, org``."""
    ips = materialize(
        flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).where("ip is not null").distinct(), "addresses")
    org = enrich_whois_org(enrich_org(ips, asn), whois)
    return (
        enrich_country(ips, geo)
        .join(enrich_domain(ips, rdns), "ip").join(org.select("ip", "org"), "ip")
    )


def join_endpoints(flows: DataFrame, facts: DataFrame) -> DataFrame:
    """Both ends of each flow with their facts. A flow without facts stays, with N/A."""
    out = flows
    for side in ("src", "dst"):
        named = facts.select(F.col("ip").alias(f"{side}_ip"), F.col("country").alias(f"{side}_country"),
                             F.col("domain").alias(f"{side}_domain"), F.col("org").alias(f"{side}_org"))
        out = out.join(named, f"{side}_ip", "left")
    return out.fillna(MISSING, [f"{s}_{c}" for s in ("src", "dst") for c in ("country", "domain", "org")])


def enrich_flows(flows: DataFrame, geo: DataFrame, asn: DataFrame, rdns: DataFrame, whois: DataFrame) -> DataFrame:
    return join_endpoints(flows, endpoint_facts(flows, geo, asn, rdns, whois))


def country_links(flows: DataFrame) -> DataFrame:
    """Flows per ordered pair of countries; a missing one reads Unknown."""
    def name(c):
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown"))

    return flows.groupBy(name("src_country").alias("src"), name("dst_country").alias("dst")).agg(
        F.count(F.lit(1)).alias("flows"))


def country_coordinates(links: DataFrame, coords: DataFrame) -> DataFrame:
    """Links with both places known are lines, with one known points, with none nothing."""
    def place(side):
        return coords.select(F.col("country").alias(side), F.col("lat").alias(f"{side}_lat"),
                             F.col("lon").alias(f"{side}_lon"))

    joined = links.join(place("src"), "src", "left").join(place("dst"), "dst", "left")
    both = F.col("src_lat").isNotNull() & F.col("dst_lat").isNotNull()
    one = F.col("src_lat").isNotNull() | F.col("dst_lat").isNotNull()
    return joined.withColumn("shape", F.when(both, "line").when(one, "point")).where(F.col("shape").isNotNull())


def unknown_endpoint_points(shapes: DataFrame) -> DataFrame:
    """Counts of point links summed on the one place known."""
    return (
        shapes.where("shape = 'point'")
        .groupBy(F.coalesce("src_lat", "dst_lat").alias("lat"), F.coalesce("src_lon", "dst_lon").alias("lon"))
        .agg(F.sum("flows").alias("flows"))
    )
