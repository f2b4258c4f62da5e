"""Personal data: fixed patterns, and a semi-Markov conditional random field on top (operator 8).

The patterns give the base spans. The field looks at islands, runs of words that hold a digit or an at sign;
elsewhere nothing can be found. Its states are segments: one word outside any entity, or one to SPAN_WORDS words
that form an email, ip, card or phone. A segment is scored by features of the whole span (its shape, number of
digits, check digit, parts), so boundaries and types are chosen together, by dynamic programming over segments of
bounded length. It finds what the patterns lose, such as two card numbers side by side, which one match of the
pattern swallows. Its spans are added where no base span lies.

It is trained by gradient steps on the exact likelihood of a bounded sample of islands (TRAIN_ISLANDS rows with the
smallest hashes) that the base patterns label, each also in spoilt forms (a digit changed, a part out of range, the
domain cut) that are labelled as nothing. Islands whose label is in doubt, as a match was dropped there, are left out.

Defined results: a null text is empty; null and repeated ids are rows of their own; an empty table gives an empty
result; extra columns are not carried."""

from __future__ import annotations

import hashlib
import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewire.operators.ml_prep import bounded_sample
from tidewire.session import materialize

KINDS = ("email", "ip", "card", "phone")
SPAN_WORDS = 6
TRAIN_ISLANDS = 4000
EPOCHS = 60
MARGIN = 2.0

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does, as each part takes whole runs.
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGNAL = re.compile(r"[0-9@]+")
NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]*")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def passes(kind: str, s: str) -> bool:
    """Whether a match of the kind's pattern counts."""
    if kind == "ip":
        return all(map(_small, s.split(".")))
    if kind == "card":
        d = only_digits(s)
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(only_digits(s)) <= 15
    return True


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from the at signs outward."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        elif at + 1 > done:
            done = max(done, at + 1)  # no local part reaches over an at sign
        at = text.find("@", max(done, at + 1))


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """All matches of the four patterns, also those that do not pass."""
    for begin, end in emails(text):
        yield "email", begin, end
    for kind, pattern in (("ip", ADDRESS), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return ordered([m for m in matches(text) if passes(m[0], text[m[1]:m[2]])])


def islands(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring words with a digit or an at sign, as (start, end) of each word."""
    run: list[tuple[int, int]] = []
    for hit in SIGNAL.finditer(text):
        if run and hit.start() < run[-1][1]:
            continue
        begin = hit.start()
        while begin and text[begin - 1] not in SPACES:
            begin -= 1
        if run and SPACE.fullmatch(text, run[-1][1], begin) is None:
            yield run
            run = []
        run.append((begin, NOT_SPACE.match(text, hit.end()).end()))
    if run:
        yield run


def trimmed(text: str, begin: int, end: int) -> tuple[int, int]:
    """The span without the marks around it."""
    while begin < end and not (text[begin].isalnum() or text[begin] in "+(" and end - begin > 1):
        begin += 1
    while end > begin and not text[end - 1].isalnum():
        end -= 1
    return begin, end


def shape(s: str) -> str:
    """Digits as runs with their length, letters as one sign, other marks as they are."""
    out: list[str] = []
    i = 0
    while i < len(s) and len(out) < 40:
        j = i
        if "0" <= s[i] <= "9":
            while j < len(s) and "0" <= s[j] <= "9":
                j += 1
            out.append(f"d{min(j - i, 20)}")
        elif s[i].isalpha():
            while j < len(s) and s[j].isalpha():
                j += 1
            out.append("a")
        else:
            j = i + 1
            out.append(" " if s[i] in SPACES else s[i])
        i = j
    return "".join(out)


def span_features(s: str, words: int) -> list[str]:
    form, digits = shape(s), only_digits(s)
    parts = s.split(".")
    quad = len(parts) == 4 and all(p and set(p) <= set("0123456789") for p in parts)
    coarse = re.sub(r"d[0-9]+", "d", form)
    marks = "".join(sorted({c for c in s if not c.isalnum() and c not in SPACES}))
    bare = "digits" if not set(coarse) - set("d -") else "mixed"
    good = bare == "digits" and 14 <= len(digits) <= 19 and luhn(digits)
    domain = DOMAIN.search(s)
    mail = bool(domain) and domain.end() == len(s) and s.count("@") == 1 and domain.start() > 0
    return ["bias", f"words={words}", f"form={coarse}", f"digits={min(len(digits), 24)}|{bare}", f"card={good}",
            f"quad={quad and all(map(_small, parts))}", f"mail={mail}", f"plus={s[:1] == '+'}|{10 <= len(digits) <= 15}",
            f"marks={marks[:8]}", f"letters={any(c.isalpha() for c in s)}"]


class Field:
    """Weights of features per kind. A word outside has score 0, so a segment's score says how much likelier it is
    than its words being nothing."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        self.weights = weights or {}

    def score(self, feats: list[str]) -> np.ndarray:
        out = np.zeros(len(KINDS))
        for f in feats:
            w = self.weights.get(f)
            out += w if w is not None else (-4.0 if f.startswith("form=") else 0.0)  # a shape never seen speaks against
        return out

    def segments(self, text: str, words: list[tuple[int, int]]):
        """(first word, last word + 1, start, end, features) of each candidate."""
        for i in range(len(words)):
            for j in range(i + 1, min(i + SPAN_WORDS, len(words)) + 1):
                begin, end = trimmed(text, words[i][0], words[j - 1][1])
                if begin < words[i][1] and end > words[j - 1][0] and end - begin <= 320:
                    yield i, j, begin, end, span_features(text[begin:end], j - i)

    def decode(self, text: str, words: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """The likeliest spans of an island; each beats its words being nothing by MARGIN at least."""
        best, back = [0.0] + [-math.inf] * len(words), [None] * (len(words) + 1)
        starting: dict[int, list] = {}
        for i, j, begin, end, feats in self.segments(text, words):
            scores = self.score(feats)
            k = int(scores.argmax())
            if scores[k] >= MARGIN:
                starting.setdefault(i, []).append((j, float(scores[k]), (KINDS[k], begin, end)))
        for i in range(len(words)):
            for j, gain, span in [(i + 1, 0.0, None), *starting.get(i, [])]:
                if best[i] + gain > best[j]:
                    best[j], back[j] = best[i] + gain, (i, span)
        spans, j = [], len(words)
        while j:
            j, span = back[j]
            if span:
                spans.append(span)
        return spans[::-1]

    def train(self, examples: list[tuple[str, list[tuple[str, int, int]], float]], epochs: int = EPOCHS,
              rate: float = 0.3, decay: float = 1e-4) -> Field:
        """Examples are (text of an island, its spans, weight). Exact gradients by the forward and backward sums over
        segmentations, adaptive steps."""
        prepared = []
        for text, spans, weight in examples:
            words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
            found = list(self.segments(text, words))
            gold = {(begin, end): KINDS.index(kind) for kind, begin, end in spans}
            hit = [gold.get((begin, end), -1) for _, _, begin, end, _ in found]
            if sum(h >= 0 for h in hit) == len(gold):  # each span is one of the candidates
                prepared.append((len(words), found, hit, weight))
        squares: dict[str, np.ndarray] = {}
        for _ in range(epochs):
            for n, found, hit, weight in prepared:
                scores = [self.score(f) for *_, f in found]
                forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
                forward[0] = backward[n] = 0.0
                total = [float(np.logaddexp.reduce(s)) for s in scores]
                by_start: dict[int, list[int]] = {}
                for x, (i, *_rest) in enumerate(found):
                    by_start.setdefault(i, []).append(x)
                for i in range(n):
                    forward[i + 1] = np.logaddexp(forward[i + 1], forward[i])
                    for x in by_start.get(i, ()):
                        j = found[x][1]
                        forward[j] = np.logaddexp(forward[j], forward[i] + total[x])
                for i in range(n - 1, -1, -1):
                    backward[i] = backward[i + 1]
                    for x in by_start.get(i, ()):
                        backward[i] = np.logaddexp(backward[i], total[x] + backward[found[x][1]])
                for x, (i, j, _b, _e, feats) in enumerate(found):
                    slope = -np.exp(forward[i] + scores[x] + backward[j] - forward[n])
                    if hit[x] >= 0:
                        slope[hit[x]] += 1.0
                    slope *= weight
                    if np.abs(slope).max() < 1e-4:
                        continue
                    for f in feats:
                        w = self.weights.setdefault(f, np.zeros(len(KINDS)))
                        s = squares.setdefault(f, np.full(len(KINDS), 1e-2))
                        g = slope - decay * w
                        s += g * g
                        w += rate * g / np.sqrt(s)
        return self


def spoilt(text: str, spans: list[tuple[str, int, int]]) -> Iterator[str]:
    """Forms of an island with one entity that are none."""
    if len(spans) != 1:
        return
    kind, begin, end = spans[0]
    s = text[begin:end]
    if kind == "card":
        for at in (len(s) - 1, len(s) // 2):
            if s[at].isdigit():
                yield text[:begin] + s[:at] + str((int(s[at]) + 3) % 10) + s[at + 1:] + text[end:]
        yield text[:begin] + s[:6] + text[end:]
    elif kind == "ip":
        yield text[:begin] + "7" + s.split(".")[0].rjust(3, "4") + s[s.index("."):] + text[end:]
        yield text[:begin] + s[:s.rindex(".")] + text[end:]
    elif kind == "email":
        yield text[:begin] + s[:s.rindex(".") if s.rindex(".") > s.index("@") else len(s)].replace(".", "") + text[end:]
        yield text[:begin] + s[s.index("@"):] + text[end:]
    else:
        yield text[:begin] + s[:max(3, len(s) // 2)] + text[end:]
        yield text[:begin] + s[1:4] + text[end:]


def sample_hash(island: str) -> str:
    """The order in which ``bounded_sample`` takes islands."""
    return hashlib.md5(f"{island}|42".encode("utf-8", "surrogatepass")).hexdigest()


def labelled_islands(docs: DataFrame, text: str = "text", limit: int = TRAIN_ISLANDS) -> DataFrame:
    """A bounded sample of distinct islands (``island`` of at most 400 characters, ``spans`` as start, end and kind).

    Half of the ``limit`` goes to islands without a span, an eighth to each kind, by the kind of the first span. A task keeps
    the first of its own islands of each sort; copies count once, and the driver sees no more than the sample."""
    quota = {"": limit // 2, **{kind: limit // 8 for kind in KINDS}}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, dict[str, tuple]] = {sort: {} for sort in quota}
        bound = dict.fromkeys(quota, "g")
        for frame in frames:
            for value in frame["text"]:
                if not value:
                    continue
                found = list(matches(value)) if SIGNAL.search(value) else []
                for words in islands(value):
                    begin, end = words[0][0], words[-1][1]
                    if end - begin > 400:
                        continue
                    own = [(k, b, e) for k, b, e in found if b < end and e > begin]
                    good = [m for m in own if passes(m[0], value[m[1]:m[2]])]
                    doubt = any(m not in good and (m[0] == "phone" or len(only_digits(value[m[1]:m[2]])) >= 14) for m in own)
                    inside = all(b >= begin and e <= end for _, b, e in good)
                    apart = all(a[2] <= b[1] for a, b in zip(ordered(good), ordered(good)[1:]))
                    if not (inside and apart and not doubt):
                        continue
                    island, sort = value[begin:end], good[0][0] if good else ""
                    place = sample_hash(island)
                    if place >= bound[sort]:
                        continue
                    here = kept[sort]
                    here[place] = island, [f"{b - begin}:{e - begin}:{k}" for k, b, e in good]
                    if len(here) >= 2 * quota[sort] + 100:
                        kept[sort] = {p: here[p] for p in sorted(here)[:quota[sort]]}
                        bound[sort] = max(kept[sort], default="")
        rows = [(sort, *here[p]) for sort, here in kept.items() for p in sorted(here)[:quota[sort]]]
        yield pd.DataFrame(rows, columns=["sort", "island", "spans"])

    rows = docs.select(F.col(text).alias("text")).mapInPandas(run, "sort string, island string, spans array<string>")
    rows = materialize(rows, "islands")
    # The same island in other surroundings can have other spans: the first of them counts.
    rows = materialize(rows.groupBy("sort", "island").agg(F.min("spans").alias("spans")), "islands")
    parts = [bounded_sample(rows.where(F.col("sort") == sort).select("island", "spans"), ["island"], k)
             for sort, k in quota.items()]
    return reduce(DataFrame.unionByName, parts)


def fit(docs: DataFrame, text: str = "text", limit: int = TRAIN_ISLANDS) -> Field:
    """Trains on the bounded sample; islands of one shape and label count as one with a weight."""
    alike: dict[tuple, list] = {}
    for row in labelled_islands(docs, text, limit).collect():
        spans = [(k, int(b), int(e)) for b, e, k in (s.split(":") for s in row["spans"])]
        key = (shape(row["island"]), tuple(k for k, *_ in spans))
        alike.setdefault(key, [row["island"], spans, 0])[2] += 1
    examples = []
    for island, spans, n in alike.values():
        weight = 1.0 + math.log(n)
        examples.append((island, spans, weight))
        examples += [(bad, [], weight) for bad in spoilt(island, spans)]
    return Field().train(examples)


def find(field: Field, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans."""
    if SIGNAL.search(text) is None:
        return [], []
    base = base_spans(text)
    taken = sorted((b, e) for _, b, e in base)
    starts = [b for b, _ in taken]
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else []
    added = []
    for words in islands(text):
        for span in field.decode(text, words):
            before = int(np.searchsorted(starts, span[2], "left"))  # base spans that begin before its end
            if not (before and reach[before - 1] > span[1]):
                added.append(span)
    return base, ordered(base + added)


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


def find_spans(docs: DataFrame, field: Field, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per document: id, number of base spans of each kind, ``base_spans`` and ``spans`` (kind:start:end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base_lists, lists = [[] for _ in KINDS], [], []
            for value in batch.column(1):
                base, spans = find(field, value.as_py() or "")
                kinds = [k for k, *_ in base]
                for column, k in zip(counts, KINDS):
                    column.append(kinds.count(k))
                base_lists.append(listed(base))
                lists.append(listed(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(base_lists, pa.string()),
                 pa.array(lists, pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_spans", "spans"])

    kind = docs.schema[row_id].dataType.simpleString()
    return docs.select(F.col(row_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string")


def masked(text: str, spans: str) -> str:
    """``text`` with each span replaced by its kind in brackets; of spans that overlap the first counts."""
    out, at = [], 0
    for item in filter(None, (spans or "").split(",")):
        kind, begin, end = item.split(":")
        if int(begin) >= at:
            out += [text[at:int(begin)], f"[{kind}]"]
            at = int(end)
    return "".join([*out, text[at:]])


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
