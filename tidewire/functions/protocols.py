"""IP protocol numbers and their names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# IANA names of the protocol numbers 0 to 148, in order.
IANA_NAMES = [
    "HOPOPT", "ICMP", "IGMP", "GGP", "IPv4", "ST", "TCP", "CBT", "EGP", "IGP",
    "BBN-RCC-MON", "NVP-II", "PUP", "ARGUS", "EMCON", "XNET", "CHAOS", "UDP", "MUX", "DCN-MEAS",
    "HMP", "PRM", "XNS-IDP", "TRUNK-1", "TRUNK-2", "LEAF-1", "LEAF-2", "RDP", "IRTP", "ISO-TP4",
    "NETBLT", "MFE-NSP", "MERIT-INP", "DCCP", "3PC", "IDPR", "XTP", "DDP", "IDPR-CMTP", "TP++",
    "IL", "IPv6", "SDRP", "IPv6-Route", "IPv6-Frag", "IDRP", "RSVP", "GRE", "DSR", "BNA",
    "ESP", "AH", "I-NLSP", "SWIPE", "NARP", "Min-IPv4", "TLSP", "SKIP", "IPv6-ICMP", "IPv6-NoNxt",
    "IPv6-Opts", "any host internal protocol", "CFTP", "any local network", "SAT-EXPAK", "KRYPTOLAN", "RVD",
    "IPPC", "any distributed file system", "SAT-MON",
    "VISA", "IPCV", "CPNX", "CPHB", "WSN", "PVP", "BR-SAT-MON", "SUN-ND", "WB-MON", "WB-EXPAK",
    "ISO-IP", "VMTP", "SECURE-VMTP", "VINES", "IPTM", "NSFNET-IGP", "DGP", "TCF", "EIGRP", "OSPFIGP",
    "Sprite-RPC", "LARP", "MTP", "AX.25", "IPIP", "MICP", "SCC-SP", "ETHERIP", "ENCAP",
    "any private encryption scheme",
    "GMTP", "IFMP", "PNNI", "PIM", "ARIS", "SCPS", "QNX", "A/N", "IPComp", "SNP",
    "Compaq-Peer", "IPX-in-IP", "VRRP", "PGM", "any 0-hop protocol", "L2TP", "DDX", "IATP", "STP", "SRP",
    "UTI", "SMP", "SM", "PTP", "ISIS over IPv4", "FIRE", "CRTP", "CRUDP", "SSCOPMCE", "IPLT",
    "SPS", "PIPE", "SCTP", "FC", "RSVP-E2E-IGNORE", "Mobility Header", "UDPLite", "MPLS-in-IP", "manet", "HIP",
    "Shim6", "WESP", "ROHC", "Ethernet", "AGGFRAG", "NSH", "Homa", "BIT-EMU", "Unassigned",
]
IANA_HIGH = {253: "Use for experimentation", 254: "Use for experimentation", 255: "Reserved"}

# Where the capture summary names a number in another way than the list above.
CAPTURE_NAMES = {
    34: "TPC", 48: "IGP-PVT", 49: "SPI-NET", 52: "NARP", 54: "SWIPE", 55: "NARP-Alt", 58: "ICMPv6",
    61: "Any-Host-Internal", 63: "Any-Local-Network", 73: "RUDP", 74: "IRTP-Alt", 75: "ISO-IP", 76: "VMTP",
    78: "TP+", 79: "HMP-Alt", 80: "MTP", 81: "SECURE-VMTP", 82: "VINES", 83: "TTP/IPTM", 84: "NSFNET-IGP",
    85: "MHRP", 86: "TLSP", 87: "EIGRP-Old", 89: "OSPF", 90: "MPLS-in-IP", 91: "OSPF-Any", 92: "MTP-Alt",
    94: "IPIP-Encap", 95: "SATNET-MON", 96: "IP-MicroMobility", 99: "GMTP", 100: "IFMP", 101: "PNNI",
    102: "PIM-Alt", 114: "0-HOP", 124: "IS-IS over IPv4", 137: "MPLS-in-UDP", 138: "MANET",
}
# Numbers the capture summary has no name for.
CAPTURE_UNNAMED = [53, 56, 68, 143, 144, 145, 146, 147, 148, 253, 254]

# Names the decoder stores, where they are not the IANA ones.
DECODER_NAMES = {0: "IPv6 Hop-by-Hop Option", 1: "ICMPv4", 58: "ICMPv6"}


def protocol_table(variant: str = "iana") -> dict[int, str]:
    table = {**dict(enumerate(IANA_NAMES)), **IANA_HIGH}
    if variant == "capture":
        table.update(CAPTURE_NAMES)
        for number in CAPTURE_UNNAMED:
            table.pop(number)
    elif variant == "decoder":
        table.update(DECODER_NAMES)
    return table


def protocol_name(number: Column | str, variant: str = "iana") -> Column:
    """Name of a protocol number.

    Unknown numbers read "Unknown" (``iana``, ``decoder``) or "proto:<n>", and "unknown" when there
    is no number at all (``capture``)."""
    number = F.col(number) if isinstance(number, str) else number
    table = F.create_map(*[F.lit(x) for pair in protocol_table(variant).items() for x in pair])
    name = table[number.cast("int")]
    if variant == "capture":
        return F.coalesce(name, F.concat(F.lit("proto:"), number.cast("string")), F.lit("unknown"))
    return F.coalesce(name, F.lit("Unknown"))
