"""Packets and the other inputs, derived by Spark from the given tables.

Every event is one packet and every user one client that talks to one server;
the same rules in SQL are in ``checks.PACKETS``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewire.functions.keys import flow_key_bilateral
from tidewire.functions.risk import max_severity, risk_labels
from tidewire.operators.features import flows_with_features
from tidewire.operators.ml_prep import label_by_ip
from tidewire.operators.sessionize import FlowRules
from tidewire.session import materialize, shared_folder

HOUR_MS = 3_600_000

# The mean gap per user is about eleven hours, hence limits in hours.
EVENT_RULES = FlowRules(
    idle_ms={"TCP": 12 * HOUR_MS, "UDP": 9 * HOUR_MS, "OTHER": 6 * HOUR_MS},
    max_age_ms={"TCP": 48 * HOUR_MS, "UDP": 36 * HOUR_MS, "OTHER": 24 * HOUR_MS},
    slice_ms=24 * HOUR_MS,
)

# Fixed values of the fixture: server address and port by ``user_id % 8``.
SERVERS = ["8.8.8.8", "1.1.1.1", "192.168.1.8", "172.16.0.5", "172.40.0.5", "93.184.216.34",
           "192.168.1.1", "203.0.113.9"]
SERVER_PORTS = [443, 53, 22, 80, 443, 8080, 502, 123]
ATTACKERS = ["172.16.0.5", "203.0.113.9", "198.51.100.77"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets_from_events(events: DataFrame) -> DataFrame:
    spark_conf = events.sparkSession.conf
    if spark_conf.get("spark.sql.session.timeZone") != "UTC":
        spark_conf.set("spark.sql.session.timeZone", "UTC")
    user = F.col("user_id")
    base = events.select(
        F.col("event_id").alias("packet_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        "event_type",
        "value",
        (F.col("event_id") % 3 == 0).alias("reply"),
        F.concat(F.lit("10."), (F.floor(user / 256) % 256).cast("string"), F.lit("."),
                 (user % 256).cast("string"), F.lit(".10")).alias("cli"),
        F.array(*[F.lit(s) for s in SERVERS])[(user % 8).cast("int")].alias("srv"),
        F.array(*[F.lit(p) for p in SERVER_PORTS])[(user % 8).cast("int")].alias("sport"),
        (F.lit(1024) + (user * 7) % 60000).cast("int").alias("cport"),
        F.array(F.lit("TCP"), F.lit("TCP"), F.lit("UDP"), F.lit("ICMPv4"))[(user % 4).cast("int")].alias("proto"),
    )
    tcp = F.col("proto") == "TCP"
    icmp = F.col("proto") == "ICMPv4"

    def flag(*types: str) -> Column:
        return tcp & F.col("event_type").isin(*types)

    out = base.select(
        "packet_id",
        "ts_ms",
        F.when(F.col("reply"), F.col("srv")).otherwise(F.col("cli")).alias("src_ip"),
        F.when(F.col("reply"), F.col("cli")).otherwise(F.col("srv")).alias("dst_ip"),
        F.when(~icmp, F.when(F.col("reply"), F.col("sport")).otherwise(F.col("cport"))).alias("src_port"),
        F.when(~icmp, F.when(F.col("reply"), F.col("cport")).otherwise(F.col("sport"))).alias("dst_port"),
        F.col("proto").alias("protocol"),
        (54 + F.floor("value").cast("int")).alias("length"),
        flag("signup").alias("syn"),
        flag("purchase").alias("fin"),
        flag("error").alias("rst"),
        flag("click", "view", "purchase").alias("ack"),
        flag("view").alias("psh"),
        F.when(tcp, "TCP").when(F.col("proto") == "UDP", "UDP").otherwise("OTHER").alias("l4_kind"),
    )
    return out.withColumn("flow_key", flow_key_bilateral())


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(table(spark, sf_dir, "events"))


_STORED: dict[tuple, DataFrame] = {}


def stored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of closed flows with their features, written once per session and input.

    Rollups, comparisons and models read stored flows; they do not rebuild them."""
    # The list of files alone; no row is read.
    files = spark.read.format("binaryFile").load(f"{sf_dir}/events.parquet").select("path", "length", "modificationTime")
    # One row in all, however many files there are.
    stamp = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("*"))).first()
    key = (spark.sparkContext.applicationId, sf_dir, *stamp)
    if key not in _STORED:
        _STORED[key] = materialize(flows_with_features(packets(spark, sf_dir), EVENT_RULES), "flows")
    return _STORED[key]


_FITTED: dict[tuple, str] = {}


def fitted(spark: SparkSession, sf_dir: str, name: str, fit) -> str:
    """Folder of a stored model, fitted once per session and input."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _FITTED:
        path = shared_folder(spark, "model")
        fit().save(spark, path)
        _FITTED[key] = path
    return _FITTED[key]


# Fixed values of the fixture: small reference tables.
RISKS = {
    0: ("Known proto on non-std port", "Medium"), 1: ("TLS suspicious", "High"), 3: ("Malformed packet", "Low"),
    4: ("Clear-text credentials", "High"), 5: ("Unlisted", "Unknown severity"),
}
GEO = [("8.8.8.0", "8.8.8.255", "United States"), ("1.1.1.0", "1.1.1.255", "Australia"),
       ("93.184.216.0", "93.184.216.255", "United States"), ("172.40.0.0", "172.40.255.255", "Canada")]
ASN = [("8.8.8.0", "8.8.8.255", "ORG-A"), ("1.1.1.0", "1.1.1.255", "ORG-B"),
       ("93.184.216.0", "93.184.216.255", "ORG-C"), ("172.40.0.0", "172.40.255.255", "ORG-D")]
RDNS = [("8.8.8.8", "dns.a.example"), ("1.1.1.1", "one.b.example")]
WHOIS = [("8.8.8.8", "NetRange: x\nOrgName: Org A Inc\n"), ("1.1.1.1", "% nothing"),
         ("93.184.216.34", "  Organization: Org C: Labs")]
COORDS = [("United States", 38.0, -97.0), ("Australia", -27.0, 133.0), ("Canada", 60.0, -95.0)]


def reference_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "geo": spark.createDataFrame(GEO, "start_ip string, end_ip string, country string"),
        "asn": spark.createDataFrame(ASN, "start_ip string, end_ip string, org string"),
        "rdns": spark.createDataFrame(RDNS, "ip string, host string"),
        "whois": spark.createDataFrame(WHOIS, "ip string, raw string"),
        "coords": spark.createDataFrame(COORDS, "country string, lat double, lon double"),
    }


def risky_flows(flows: DataFrame) -> DataFrame:
    mask = (F.col("packet_count") % 4).bitwiseOR(F.shiftleft(F.col("bytes") % 8, 3))
    out = flows.withColumn("risk_mask", mask)
    return out.withColumns({"risk_label": risk_labels("risk_mask", RISKS),
                            "risk_severity": max_severity("risk_mask", RISKS)})


def labelled_flows(flows: DataFrame) -> DataFrame:
    """Flows with a text ``label``, the number ``y`` and a ``score`` in [0, 1)."""
    default = F.when(F.col("flow_seq") % 5 == 0, "MALICIOUS").otherwise("BENIGN")
    return label_by_ip(flows, ATTACKERS, default).withColumns({
        "y": F.when(F.col("label") == "MALICIOUS", 1).otherwise(0),
        "score": ((F.col("bytes") * 31 + F.col("packet_count") * 17) % 1000) / 1000.0,
    })


def ruled_flows(flows: DataFrame) -> DataFrame:
    """Flows labelled by two of their counts: either three packets or a SYN, not both."""
    odd = (F.col("packet_count") >= 3) != (F.col("syn_count") >= 1)
    return flows.withColumns({"label": F.when(odd, "MALICIOUS").otherwise("BENIGN"), "y": odd.cast("int")})


# Fixed values of the fixture: the address the second tool alone sees, and one server as each tool spells it.
ONLY_B, SPELLED, SPELLED_A, SPELLED_B = "198.51.100.1", "203.0.113.9", "2001:db8::9", "2001:0DB8:0:0:0:0:0:9"


def _respelled(flows: DataFrame, spelling: str) -> DataFrame:
    return flows.withColumns({c: F.when(F.col(c) == SPELLED, spelling).otherwise(F.col(c)) for c in ("src_ip", "dst_ip")})


def first_tool(flows: DataFrame) -> DataFrame:
    """One tool's flows: some are written twice, the later row with more bytes."""
    again = flows.where("first_packet_id % 29 = 0").withColumns({
        "bytes": F.col("bytes") + 7, "first_packet_id": F.col("first_packet_id") + 10 ** 12})
    return _respelled(flows.unionByName(again), SPELLED_A)


def second_tool(flows: DataFrame) -> DataFrame:
    """Another tool's flows: some missing, some ports missing altogether, some flows of its own, some written twice, some with one byte more, some equal
    within tolerance; one server is spelled another way."""
    pid = F.col("first_packet_id")
    mean = F.col("mean_packet_length")
    ports = F.coalesce("src_port", F.lit(0)) + F.coalesce("dst_port", F.lit(0))
    kept = flows.where((pid % 17 != 0) & (ports % 11 != 3)).withColumns({
        "bytes": F.col("bytes") + F.when(pid % 11 == 0, 1).otherwise(0),
        "mean_packet_length": F.when(pid % 13 == 0, mean * (1 + 1e-9)).otherwise(mean),
    })
    again = flows.where(pid % 19 == 0).withColumns({"bytes": F.col("bytes") + 5, "first_packet_id": pid + 10 ** 12})
    own = flows.where(pid % 23 == 0).withColumn("dst_ip", F.lit(ONLY_B))
    return _respelled(kept.unionByName(again).unionByName(own), SPELLED_B)


def metric_samples(events: DataFrame) -> DataFrame:
    kind = (F.when(F.col("event_type").isin("click", "view"), "FLOW_AGGREGATION_RATE")
            .when(F.col("event_type") == "error", "SYSTEM_CPU").when(F.col("event_type") == "signup", "SYSTEM_RAM")
            .otherwise("OTHER"))
    return events.select(kind.alias("type"), "value", F.col("ts").cast("timestamp").alias("ts"))


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value.cast("long")), digits, "0")


def _ip_hex(ip: str) -> Column:
    parts = F.split(F.col(ip), r"\.")
    return F.concat(*[_hex(parts[i], 2) for i in range(4)])


# Fixed values of the fixture: MAC addresses of all built frames.
DST_MAC, SRC_MAC = "020000000001", "020000000002"


def frames(rows: DataFrame, kind: Column | None = None) -> DataFrame:
    """Packets with the Ethernet ``frame`` they stand for.

    ``kind`` is IPv4 (default), IPv6, VLAN, ARP, odd (EtherType 88CC) or short (10 bytes). IPv6
    addresses carry the IPv4 ones in their last four bytes."""
    kind = F.lit("IPv4") if kind is None else kind
    ihl = F.col("length")
    tcp, udp = F.col("protocol") == "TCP", F.col("protocol") == "UDP"
    ports = F.concat(_hex(F.coalesce("src_port", F.lit(0)), 4), _hex(F.coalesce("dst_port", F.lit(0)), 4))
    bits = sum((F.col(f).cast("int") * b for f, b in
                (("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16))), F.lit(0))
    zero32 = F.lit("00000000")
    l4 = (F.when(tcp, F.concat(ports, zero32, zero32, F.lit("50"), _hex(bits, 2), zero32, F.lit("0000")))
          .when(udp, F.concat(ports, zero32)).otherwise(F.concat(F.lit("0800"), F.lit("000000000000"))))
    number4 = F.when(tcp, "06").when(udp, "11").otherwise("01")
    number6 = F.when(tcp, "06").when(udp, "11").otherwise("3A")
    macs = F.lit(DST_MAC + SRC_MAC)
    ipv4 = F.concat(F.lit("4500"), _hex(ihl - 14, 4), F.lit("00000000"), F.lit("40"), number4, F.lit("0000"),
                    _ip_hex("src_ip"), _ip_hex("dst_ip"), l4)
    prefix = F.lit("20010DB8" + "0" * 16)
    ipv6 = F.concat(F.lit("60000000"), _hex(ihl, 4), number6, F.lit("40"),
                    prefix, _ip_hex("src_ip"), prefix, _ip_hex("dst_ip"), l4)
    whole = (
        F.when(kind == "IPv6", F.concat(macs, F.lit("86DD"), ipv6))
        .when(kind == "VLAN", F.concat(macs, F.lit("810000640800"), ipv4))
        .when(kind == "ARP", F.concat(macs, F.lit("0806"), F.lit("0001080006040001")))
        .when(kind == "odd", F.concat(macs, F.lit("88CC")))
        .when(kind == "short", F.lit("02000000000102000000"))
        .otherwise(F.concat(macs, F.lit("0800"), ipv4)))
    # Zero bytes up to the packet length, never below what the headers need.
    size = F.when(kind == "short", 10).when(kind == "IPv6", F.col("length") + 20).when(
        kind == "VLAN", F.col("length") + 4).otherwise(F.col("length"))
    return rows.withColumn("frame", F.unhex(F.rpad(whole, (size * 2).cast("int"), F.lit("0"))))


def mixed_kind() -> Column:
    slot = F.col("packet_id") % 16
    return (F.when(slot == 0, "ARP").when(slot == 1, "IPv6").when(slot == 2, "VLAN").when(slot == 3, "odd")
            .when(slot == 4, "short").otherwise("IPv4"))


def raw_frames(spark: SparkSession, sf_dir: str, mixed: bool = True) -> DataFrame:
    """What a capture holds: ``packet_id, ts_ms, frame``."""
    rows = packets(spark, sf_dir)
    return frames(rows, mixed_kind() if mixed else None).select("packet_id", "ts_ms", "frame")
