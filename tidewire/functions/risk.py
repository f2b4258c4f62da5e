"""Risk masks: labels and the highest severity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Severities from low to high.
SEVERITIES = ["Low", "Medium", "High", "Severe", "Critical", "Emergency"]
UNKNOWN_SEVERITY = "Unknown severity"
NO_RISK = "No risk"

RiskTable = dict[int, tuple[str, str]]


def risk_labels(mask: Column | str, risks: RiskTable) -> Column:
    """Labels of the set bits in bit order, joined by ", "; "No risk" when there is none."""
    mask = F.col(mask) if isinstance(mask, str) else mask
    mask = mask.cast("long")
    labels = [F.when(F.shiftright(mask, bit).bitwiseAND(F.lit(1).cast("long")) == 1, label)
              for bit, (label, _) in sorted(risks.items()) if label]
    joined = F.concat_ws(", ", *labels)
    return F.when(joined == "", NO_RISK).otherwise(joined)


def severity_rank(severity: Column | str) -> Column:
    """1 to 6 for known severities, 0 for the unknown one, null for anything else."""
    severity = F.col(severity) if isinstance(severity, str) else severity
    ranks = {UNKNOWN_SEVERITY: 0, **{s: i + 1 for i, s in enumerate(SEVERITIES)}}
    return F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])[severity]


def max_severity(mask: Column | str, risks: RiskTable) -> Column:
    """Highest severity of the set bits; an unknown one yields to any known; "No risk" when none is set."""
    mask = F.col(mask) if isinstance(mask, str) else mask
    mask = mask.cast("long")
    ranks = {UNKNOWN_SEVERITY: 0, **{s: i + 1 for i, s in enumerate(SEVERITIES)}}
    top = F.greatest(
        F.lit(-1), F.lit(-1),
        *[F.when(F.shiftright(mask, bit).bitwiseAND(F.lit(1).cast("long")) == 1, ranks[severity])
          for bit, (_, severity) in sorted(risks.items())])
    names = F.array(F.lit(NO_RISK), F.lit(UNKNOWN_SEVERITY), *[F.lit(s) for s in SEVERITIES])
    return F.get(names, top + 1)


def highest_severity(severity: Column | str) -> Column:
    """Aggregate: the highest severity of a group's rows; "No risk" when none has a known name."""
    name = F.col(severity) if isinstance(severity, str) else severity
    return F.coalesce(F.max_by(name, severity_rank(name)), F.lit(NO_RISK))
