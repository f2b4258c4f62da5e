"""Periodic runs of words, found on a grammar of the text (operator 11).

A run is a stretch of consecutive words with smallest period q (words q apart are the same), at least
``max(MIN_WORDS, MIN_TURNS * q)`` long, that no neighbouring word extends.

Words become ids. Re-Pair replaces the most frequent pair of neighbours by a new symbol until no pair occurs twice;
what is left at the top is halved again and again, so that every symbol but a word has two children. A run that
spans more than one word crosses the boundary between the children of exactly one lowest symbol. Crossing runs are
computed once per symbol, from equal groups of four words next to the boundary and the common stretch on both sides,
then carried to all places where the symbol is derived. What is a part of a longer run of the same period falls away
when the intervals are merged.

Each four words inside a run occur in it again, one period before or after. So only stretches of words whose groups of
four all occur twice in the document are given a grammar; no run reaches beyond such a stretch.

Documents are independent: no shuffle, one document at a time in a task, n log n in its words.

Defined results: a null or empty text has no words, no runs and an empty collapsed text; a null id is carried as it is;
rows that repeat an id are rows of their own; ties need no rule, as the set of runs is unique; an empty table gives an
empty result; extra columns are not carried, whatever their names."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewire.llm.common import WORD, mix

MIN_WORDS, MIN_TURNS = 24, 3
GROUP = 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"

Run = tuple[int, int, int]


def re_pair(ids: list[int], first: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Rules (symbol ``first + i`` stands for ``rules[i]``) and the symbols that are left."""
    n = len(ids)
    symbol, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, pair in enumerate(zip(ids, ids[1:])):
        places[pair].append(i)
    count = {pair: len(at) for pair, at in places.items() if len(at) > 1}
    queue = [(-c, pair) for pair, c in count.items()]
    heapq.heapify(queue)
    rules: list[tuple[int, int]] = []
    while queue:
        seen, pair = heapq.heappop(queue)
        now = count[pair]
        if now < 2:
            continue
        if now < -seen:  # neighbours were replaced since: back to its place in the queue
            heapq.heappush(queue, (-now, pair))
            continue
        x, y = pair
        new, made = first + len(rules), []
        for i in places.pop(pair):
            j = after[i]
            if symbol[i] != x or j >= n or symbol[j] != y:
                continue
            left, right = before[i], after[j]
            if left >= 0 and (p := (symbol[left], x)) in count:
                count[p] -= 1
            if right < n:
                if (p := (y, symbol[right])) in count:
                    count[p] -= 1
                before[right] = i
            symbol[i], symbol[j], after[i] = new, -1, right
            made.append(i)
        count[pair] = 0
        if not made:
            continue
        rules.append(pair)
        fresh = set()
        for i in made:
            left, right = before[i], after[i]
            if left >= 0:
                places[p := (symbol[left], new)].append(left)
                fresh.add(p)
            if right < n and symbol[right] != new:
                places[p := (new, symbol[right])].append(i)
                fresh.add(p)
        for p in fresh:
            if (c := len(places[p])) > 1:
                count[p] = c
                heapq.heappush(queue, (-c, p))
            else:
                del places[p]
    rest, i = [], 0
    while i < n:
        rest.append(symbol[i])
        i = after[i]
    return rules, rest


def _same(w: np.ndarray, i: int, j: int, most: int, step: int) -> int:
    """Number of equal neighbours from ``i`` and ``j`` on, at most ``most``, in the direction of ``step``."""
    done, size = 0, 32
    while done < most:
        m = min(size, most - done)
        if step > 0:
            differs = w[i + done:i + done + m] != w[j + done:j + done + m]
        else:
            differs = w[i - done - m + 1:i - done + 1][::-1] != w[j - done - m + 1:j - done + 1][::-1]
        at = int(differs.argmax())
        if differs[at]:
            return done + at
        done, size = done + m, size * 4
    return most


class _Text:
    """Word ids with the places of equal groups of four words."""

    def __init__(self, w: np.ndarray):
        self.w = w
        m = len(w) - GROUP + 1
        grains = mix(w.astype(np.uint64) + np.uint64(1))
        key = grains[:m].copy()
        for k in range(1, GROUP):
            key = key * np.uint64(0xC2B2AE3D27D4EB4F) + grains[k:k + m]
        self.order = np.argsort(key, kind="stable")
        ordered = key[self.order]
        cut = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [m]))
        self.rank = np.empty(m, np.int64)
        self.rank[self.order] = np.arange(m)
        sizes = ends - starts
        self.begin, self.end = np.empty(m, np.int64), np.empty(m, np.int64)
        self.begin[self.order], self.end[self.order] = np.repeat(starts, sizes), np.repeat(ends, sizes)

    def repeated(self) -> np.ndarray:
        return self.end - self.begin > 1

    def crossing(self, low: int, at: int, high: int) -> list[Run]:
        """Runs (start, end, period) inside [low, high) that cross the boundary before word ``at``."""
        found: dict[Run, None] = {}
        # At least half of a run lies on one side; there the four words at the boundary come again a period further.
        if at + GROUP <= high and self.end[at] - self.begin[at] > 1:
            near = self.order[self.rank[at] + 1:self.end[at]]
            self._grow(near[:np.searchsorted(near, high - GROUP, "right")] - at, low, at, high, found)
        back = at - GROUP
        if back >= low and self.end[back] - self.begin[back] > 1:
            near = self.order[self.begin[back]:self.rank[back]]
            self._grow(back - near[np.searchsorted(near, low):][::-1], low, at, high, found, left=True)
        return list(found)

    def _grow(self, periods: np.ndarray, low: int, at: int, high: int, found: dict[Run, None], left: bool = False) -> None:
        i = 0
        while i < len(periods):
            q = int(periods[i])
            here = at - q if left else at
            if here < low or here + q >= high:
                break
            back = _same(self.w, here - 1, here + q - 1, here - low, -1)
            on = _same(self.w, here, here + q, high - here - q, 1)
            start, end = here - back, here + q + on
            if start < at < end and end - start >= max(MIN_WORDS, MIN_TURNS * q):
                if not any(q % p == 0 and a <= start and end <= b for a, b, p in found):  # the smallest period counts
                    found[start, end, q] = None
            # Two periods share no stretch as long as their sum: longer periods inside this stretch are multiples.
            reach = at - start if left else end - at
            i = max(i + 1, int(np.searchsorted(periods, reach - q, "right"))) if end - start >= 2 * q else i + 1


def _runs_of_stretch(text: _Text, low: int, high: int) -> Iterator[Run]:
    ids = text.w[low:high].tolist()
    first = max(ids) + 1
    rules, rest = re_pair(ids, first)
    length: list[int] = []
    for x, y in rules:
        length.append((length[x - first] if x >= first else 1) + (length[y - first] if y >= first else 1))

    derived: dict[int, list[int]] = defaultdict(list)
    edges, at = [], low
    for s in rest:
        edges.append(at)
        if s >= first:
            derived[s - first].append(at)
        at += length[s - first] if s >= first else 1
    edges.append(at)
    halves = [(0, len(rest))]
    while halves:
        a, b = halves.pop()
        if b - a > 1 and edges[b] - edges[a] >= MIN_WORDS:
            c = (a + b) // 2
            yield from text.crossing(edges[a], edges[c], edges[b])
            halves += [(a, c), (c, b)]
    for r in range(len(rules) - 1, -1, -1):
        if length[r] < MIN_WORDS or r not in derived:
            continue
        places, (x, y) = derived.pop(r), rules[r]
        left = length[x - first] if x >= first else 1
        if x >= first:
            derived[x - first].extend(places)
        if y >= first:
            derived[y - first].extend(p + left for p in places)
        here = places[0]
        for start, end, q in text.crossing(here, here + left, here + length[r]):
            for p in places:
                yield start - here + p, end - here + p, q


def find_runs(w: np.ndarray) -> list[Run]:
    """Runs (start, length, period) of an array of word ids, by start, then period."""
    if len(w) < MIN_WORDS:
        return []
    text = _Text(w)
    marks = np.concatenate(([0], text.repeated().view(np.int8), [0]))
    steps = np.flatnonzero(np.diff(marks))
    by_period: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for a, b in zip(steps[::2].tolist(), steps[1::2].tolist()):
        if b - a > MIN_WORDS - GROUP:
            for start, end, q in _runs_of_stretch(text, a, b + GROUP - 1):
                by_period[q].add((start, -end))
    runs = []
    for q, intervals in by_period.items():
        reached = -1
        for start, minus_end in sorted(intervals):  # a part of a longer one ends no later than it
            if -minus_end > reached:
                reached = -minus_end
                runs.append((start, reached - start, q))
    return sorted((s, n, q) for s, n, q in runs)


def _collapse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_runs, texts = [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            words = text.split() if text else []
            names: dict[bytes, int] = {}
            ids = np.fromiter([names.setdefault(w, len(names)) for w in words], np.int64, len(words))
            runs = find_runs(ids) if len(names) + GROUP <= len(words) else []
            if runs:
                steps = np.zeros(len(words) + 1, np.int64)
                for start, n, q in runs:
                    steps[start + q] += 1
                    steps[start + n] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
            all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            texts.append(b" ".join(words))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(all_runs, kind), pa.array(texts, pa.binary()).cast(pa.string())],
            ["doc_id", "runs", "collapsed"])


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, its ``runs`` (start, length, period; by start, then period) and the ``collapsed`` text.

    The collapsed text lacks every word that any run holds after its first period; words are joined by one space."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_collapse_batches, f"doc_id long, runs {RUNS}, collapsed string")


def plant_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where one document in ten goes on with one stretch of its words, over and over.

    With h = crc32 of the decimal id and g = floor(h / 10): if h % 10 = 0 and there are n > 0 words, the words from
    a = g % n on repeat the p = 1 + floor((n - a) / (3 + g % 8)) words that stand there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    picked = docs.select("doc_id", "text", h.alias("h")).select(
        "doc_id", "text", F.floor(F.col("h") / 10).alias("g"), (F.col("h") % 10 == 0).alias("picked"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    # Only the picked rows are cut into words; the sizes build on each other, so each is a step of its own.
    cut = picked.select("doc_id", "text", "g", F.when(F.col("picked"), words).alias("w"))
    sized = cut.select("*", F.size("w").alias("n")).select(
        "*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int").alias("a"))
    sized = sized.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    turn = F.slice("w", F.col("a") + 1, F.col("p"))
    turns = F.flatten(F.array_repeat(turn, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    new = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(turns, F.lit(1), F.col("n") - F.col("a"))), " ")
    return sized.select("doc_id", F.when(F.col("n") > 0, new).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period."""
    def better(a: Column, b: Column) -> Column:
        mine, other = b["length"] * a["period"], a["length"] * b["period"]
        return mine > other

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | better(best, r), r).otherwise(best))
