"""Text and number rules of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def safe_double(value: Column | str, default: float = 0.0) -> Column:
    """Number from text; "NaN" and the infinities in any case; the default for anything else."""
    text = F.trim(_c(value).cast("string"))
    return F.coalesce(text.try_cast("double"), F.lit(float(default)))


def split_summaries(value: Column | str) -> Column:
    """Comma list to array without leading blanks; the empty text is the empty array."""
    value = _c(value)
    return F.when(value == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(value, ","), lambda e: F.regexp_replace(e, "^ ", "")))


def parse_whois_org(raw: Column | str, none: str = "Unknown") -> Column:
    """Organisation from a WHOIS answer: the first ``OrgName:`` or ``Organization:`` line."""
    raw = _c(raw)
    lines = F.filter(
        F.transform(F.split(raw, "\n"), lambda line: F.trim(line)),
        lambda line: line.startswith("OrgName:") | line.startswith("Organization:"))
    return (
        F.when(raw.isNull(), "N/A")
        .when(F.size(lines) == 0, none)
        .otherwise(F.trim(F.regexp_extract(F.element_at(lines, 1), "^[^:]*:(.*)$", 1)))
    )


def format_ts_ms(ms: Column | str, suffix: str = "") -> Column:
    """``YYYY-MM-DD HH:MM:SS.mmm`` in UTC (session zone)."""
    text = F.date_format(F.timestamp_millis(_c(ms)), "yyyy-MM-dd HH:mm:ss.SSS")
    return F.concat(text, F.lit(suffix)) if suffix else text


def normalize_label(label: Column | str) -> Column:
    """BENIGN 0, MALICIOUS 1, else the number in the text, else 0."""
    text = F.upper(F.trim(_c(label).cast("string")))
    return (
        F.when(text == "BENIGN", 0).when(text == "MALICIOUS", 1)
        .otherwise(F.coalesce(text.try_cast("double").cast("int"), F.lit(0)))
    )


def anomaly_sign(label: Column | str) -> Column:
    """-1 for "anomaly", "malicious" or "attack" in any case, else 1."""
    return F.when(F.lower(_c(label).cast("string")).isin("anomaly", "malicious", "attack"), -1).otherwise(1)


def display_protocol(app: Column | str, protocol: Column | str) -> Column:
    return F.coalesce(F.nullif(_c(app), F.lit("")), F.nullif(_c(protocol), F.lit("")), F.lit("Unknown"))


def without_arp(protocol: Column | str) -> Column:
    """True unless the protocol list holds the token ``arp`` in any case."""
    tokens = F.split(F.translate(F.lower(F.coalesce(_c(protocol), F.lit(""))), ";/|\t\n\x0b\x0c\r ", "," * 9), ",")
    return ~F.array_contains(tokens, "arp")


def row_contains(columns: list[str], term: str) -> Column:
    """The lowered row text holds the lowered term."""
    return F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])).contains(term.lower())
