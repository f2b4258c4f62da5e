"""Address tests, normal forms and sort keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

V4 = r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
GROUPS = "[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*"
# Eight groups, or fewer with one gap.
V6 = (r"^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}"
      rf"|(?!:*(?:[0-9A-Fa-f]+:+){{7}}[0-9A-Fa-f])(?:{GROUPS})?::(?:{GROUPS})?)$")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_ipv4(ip: Column | str) -> Column:
    return _c(ip).rlike(V4)


def is_valid_ip(ip: Column | str) -> Column:
    """The text is an IPv4 or IPv6 address. Host names are not looked up."""
    return F.coalesce(_c(ip).rlike(V4) | _c(ip).rlike(V6), F.lit(False))


def is_private_ip(ip: Column | str) -> Column:
    """10/8, 192.168/16 and 172.16/12 by text; other private ranges are not told apart."""
    ip = _c(ip)
    second = F.get(F.split(ip, r"\."), F.lit(1)).try_cast("int")
    return (
        ip.startswith("10.") | ip.startswith("192.168.")
        | (ip.startswith("172.") & F.coalesce(second.between(16, 31), F.lit(False)))
    )


def ipv4_number(ip: Column | str) -> Column:
    """The address as a number; null if it is no IPv4 address."""
    parts = F.split(_c(ip), r"\.")
    number = None
    for i in range(4):
        part = F.get(parts, F.lit(i)).try_cast("long") * (256 ** (3 - i))
        number = part if number is None else number + part
    return F.when(is_ipv4(ip), number)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def _groups_v6(ip: Column) -> Column:
    """The eight groups of an IPv6 address, four hex digits each; null if the text is none.

    A dotted tail stands for the last two groups."""
    def hex_tail(number: Column) -> Column:
        return F.concat(F.regexp_replace(ip, "[^:]*$", ""), F.lower(F.hex(F.shiftright(number, 16))), F.lit(":"),
                        F.lower(F.hex(number.bitwiseAND(0xFFFF))))

    def filled(left: Column, right: Column) -> Column:
        gap = F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))
        return F.concat(left, F.array_repeat(F.lit("0"), gap), right)

    def groups(plain: Column) -> Column:
        sides = F.transform(F.split(plain, "::"), lambda side: F.filter(F.split(side, ":"), lambda g: g != ""))
        whole = _once(sides, lambda s: F.when(F.size(s) == 2, filled(F.get(s, F.lit(0)), F.get(s, F.lit(1)))).otherwise(s[0]))
        return F.when(plain.rlike(V6), F.transform(whole, lambda g: F.lpad(g, 4, "0")))

    tail = F.substring_index(ip, ":", -1)
    plain = F.when(tail.contains("."), _once(ipv4_number(tail), hex_tail)).otherwise(F.lower(ip))
    return F.when(ip.contains(":"), _once(plain, groups))


def _short_v6(groups: Column) -> Column:
    """No leading zeros; the first of the longest runs of two or more zero groups is left out."""
    def short(text: Column) -> Column:
        out = None
        for run in range(8, 1, -1):
            zeros = "(?:^|:)0" + "(?::0){%d}(?::|$)" % (run - 1)
            cut = F.regexp_replace(text, "^(.*?)" + zeros + "(.*)$", "$1::$2")
            out = F.when(text.rlike(zeros), cut) if out is None else out.when(text.rlike(zeros), cut)
        return out.otherwise(text)

    return _once(F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0{1,3}", "")), ":"), short)


def normalize_ip(ip: Column | str, mode: str = "compressed") -> Column:
    """IPv4 as it is, IPv6 in one spelling (``compressed`` or ``exploded``), other text unchanged."""
    ip = _c(ip)
    spelled = _short_v6(_groups_v6(ip)) if mode == "compressed" else F.array_join(_groups_v6(ip), ":")
    return F.when(ip.contains(":"), F.coalesce(spelled, ip)).otherwise(ip)


def ip_sort_key(ip: Column | str) -> Column:
    """32 hex digits that sort like the address, IPv4 mapped into IPv6; null if not an address."""
    v4 = F.concat(F.lit("0" * 20 + "ffff"), F.lpad(F.lower(F.hex(ipv4_number(ip))), 8, "0"))
    return F.when(is_ipv4(ip), v4).otherwise(F.array_join(_groups_v6(_c(ip)), ""))
