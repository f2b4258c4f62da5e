"""Quality rules with risk-controlled thresholds (operator 6).

Each rule rejects documents whose measure lies above a cutoff. A cutoff is chosen per stratum from a grid that is
fixed in advance, by the labelled good documents of that stratum: from the mildest cutoff on, one after another
is tested by the exact binomial tail, that is whether so few rejected good documents would be seen if the rule
rejected more than its share of the allowed risk; the first that fails ends the walk (a fixed order
of tests needs no correction of its own). The level of each walk is the error level divided by the number
of walks, strata times rules (Bonferroni). The allowed risk is divided among the rules, so with
probability 1 - ``error`` no stratum loses more than ``risk`` of its good documents to all rules together. A
stratum with too few labels to prove that keeps everything.

Every document and every label is counted. Features are computed once per document from the whole text; only
counts per stratum, rule and grid step meet in the tests.

Defined results: a null text has no words; a null stratum is a stratum of its own; labels of null count as
none, repeated labels of an id count once as the lower one; repeated documents are rows of their own; an
empty table gives an empty result; without labels only the base rules decide; extra columns are carried along."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidewire.llm.common import words_of
from tidewire.session import materialize

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_bytes")
RISK, ERROR, STEPS = 0.02, 0.05, 48
#: Measure of each rule and the lowest and highest cutoff of its grid (geometric).
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", 0.02, 0.5),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 0.05, 1.0),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 0.05, 1.0),
    "long_words": ("word_chars / greatest(n_words, 1)", 6.0, 60.0),
    "capitals": ("n_capitals / greatest(n_bytes, 1)", 0.05, 1.0),
}


def text_features(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = words_of(text)
    word_chars = len(text) - sum(map(text.count, SPACES))
    lines = text.split("\n")
    dup_lines = 0
    if len(set(lines)) < len(lines):
        # Equal lines beyond the first, of those that have a word.
        dup_lines = sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.strip(SPACES))
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    capitals = int(np.count_nonzero((data >= 65) & (data <= 90)))
    return (len(words), word_chars, sum(map(text.count, SYMBOLS)), dup_lines, repeated_words(words), len(lines),
            capitals, data.size)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which the text has twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    often = np.fromiter((count[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:shift + len(windows)] |= often
    return int(covered.sum())


@F.pandas_udf(T.StructType([T.StructField(f, T.LongType()) for f in FEATURES]))
def features(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_features(t) for t in texts], columns=list(FEATURES))


def base_failed(q: str = "") -> Column:
    return (F.col(f"{q}n_words") < 50) | (100 * F.col(f"{q}n_repeat_words") > 50 * F.col(f"{q}n_words"))


def grid(rule: str, steps: int = STEPS) -> list[float]:
    _, low, high = RULES[rule]
    return [round(float(x), 6) for x in np.geomspace(low, high, steps)]


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n) for chance p each."""
    if k >= n:
        return 1.0
    term = n * math.log1p(-p)
    ratio = math.log(p) - math.log1p(-p)
    terms = []
    for i in range(k + 1):
        terms.append(term)
        term += math.log((n - i) / (i + 1)) + ratio
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def walk(counts: list[int], cutoffs: list[float], n: int, risk: float, level: float) -> float | None:
    """The lowest cutoff proven. ``counts[i]``: good documents above cutoff i and not above the next."""
    lost, best = 0, None
    for cutoff, more in zip(reversed(cutoffs), reversed(counts)):
        lost += more
        if lost > n * risk or binomial_tail(lost, n, risk) > level:
            break
        best = cutoff
    return best


def choose_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", row_id: str = "doc_id",
                   label: str = "quality", risk: float = RISK, error: float = ERROR, steps: int = STEPS) -> DataFrame:
    """``stratum, rule, cutoff`` for every rule that is proven. ``measured`` has ``FEATURES``, the stratum and ids."""
    good = labels.groupBy(F.col(row_id).alias("__id")).agg(F.min(label).alias("__label")).where("__label = 1")
    seen = measured.where(~base_failed()).select(
        F.col(row_id).alias("__id"), F.col(stratum).alias("stratum"),
        F.array(*[F.expr(measure).cast("double") for measure, _, _ in RULES.values()]).alias("m"))
    seen = seen.join(good, "__id").select("stratum", F.posexplode("m").alias("rule", "value"))
    # The step of a value: how many cutoffs lie below it.
    grids = F.array(*[F.array(*map(F.lit, grid(rule, steps))) for rule in RULES])
    step = F.size(F.filter(F.element_at(grids, F.col("rule") + 1), lambda c: c < F.col("value")))
    counts = seen.groupBy("stratum", "rule", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    walks = counts.groupBy("stratum", "rule").agg(
        F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("step", "n"))).alias("by_step"))
    walks = walks.withColumn("walks", F.count(F.lit(1)).over(Window.partitionBy()))  # strata times rules
    names, cutoffs = list(RULES), [grid(rule, steps) for rule in RULES]

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for stratum_, rule, n, by_step, m in frame.itertuples(index=False):
                found = walk([by_step.get(i + 1, 0) for i in range(steps)], cutoffs[rule], n, risk / len(names), error / m)
                if found is not None:
                    rows.append((stratum_, names[rule], found))
            yield pd.DataFrame(rows, columns=["stratum", "rule", "cutoff"])

    kind = measured.schema[stratum].dataType.simpleString()
    return walks.select("stratum", "rule", "n", "by_step", "walks").mapInPandas(
        test, f"stratum {kind}, rule string, cutoff double")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``."""
    limits = cutoffs.groupBy(F.col("stratum").alias("__stratum")).pivot("rule", list(RULES)).agg(F.first("cutoff"))
    limits = limits.select("__stratum", *[F.col(rule).alias(f"__{rule}") for rule in RULES])
    rejected = F.lit(False)
    for rule, (measure, _, _) in RULES.items():
        rejected = rejected | F.coalesce(F.expr(measure) > F.col(f"__{rule}"), F.lit(False))
    joined = measured.join(limits, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    return joined.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & ~rejected).drop("__stratum", *[f"__{rule}" for rule in RULES])


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("__f", features(F.col(text))).select(*[f"`{c}`" for c in docs.columns], "__f.*")


def quality_verdicts(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang",
                     row_id: str = "doc_id", **how) -> DataFrame:
    """One row per document: id, stratum, the features, ``base_failed`` and ``kept``."""
    rows = docs.select(F.col(row_id).alias("doc_id"), F.col(stratum).alias("lang"), F.col(text).alias("text"))
    measured = materialize(measure(rows).drop("text"), "quality")
    return judge(measured, choose_cutoffs(measured, labels, **how))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", row_id: str = "doc_id",
              **how) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, unchanged."""
    key = docs.withColumn("__key", F.xxhash64(row_id, stratum, text))
    rows = key.select("__key", F.col(row_id).alias("doc_id"), F.col(stratum).alias("lang"), F.col(text).alias("text"))
    measured = materialize(measure(rows).drop("text"), "quality")
    verdicts = judge(measured, choose_cutoffs(measured, labels, **how))
    passed = verdicts.where("kept").select("__key").distinct()
    return key.join(passed, "__key", "left_semi").drop("__key")
