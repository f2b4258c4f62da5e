"""Best-fit packing of token sequences (operator 2).

Documents become token ids and a closing id 0; longer ones than the capacity are cut. Pieces are packed
by length alone, and there are no more lengths than the capacity, so the plan is made from a histogram: pieces
above a third of the capacity are matched greedily, the longest with the longest that still fits (no
bin holds three of them); smaller ones, longest first, go where the least gap remains. Bins of one kind
are handled as one entry with a count, so the plan is small whatever the number of pieces. A piece
finds its bin by its rank among the pieces of its length.

Defined results: a null text is empty and gives the closing id alone; null and repeated ids are rows of
their own; an empty table gives an empty result; extra columns are not carried."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.tokens import encoder
from tidewire.operators.ordered import sliced_rank
from tidewire.session import materialize

CAPACITY = 2048
SLICE_ROWS = 4000
ROWS_OUT = 4096


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids: full ones, but for the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(at, capacity) for at in range(first, n, capacity)]]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", row_id: str = "doc_id",
                 with_ids: bool = False) -> DataFrame:
    """Pieces ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (little-endian 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []

            def flush() -> pa.RecordBatch:
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()),
                           pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                for column in (at, piece, start, length, crc, ids):
                    column.clear()
                return pa.RecordBatch.from_arrays(columns, names)

            for i, value in enumerate(batch.column(1)):
                all_ids = np.array(encode(value.as_py() or "") + [0], "<u4")
                for k, (s, n) in enumerate(cut(len(all_ids), capacity)):
                    data = all_ids[s:s + n].tobytes()
                    at.append(i), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(data))
                    if with_ids:
                        ids.append(data)
                if len(at) >= ROWS_OUT:
                    yield flush()
            yield flush()

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kind = docs.schema[row_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(row_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


class _Gaps:
    """Open bins by gap: runs of bins (first, count) of one gap, and the gaps in order."""

    def __init__(self):
        self.bins: dict[int, list[tuple[int, int]]] = {}
        self.order: list[int] = []

    def put(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.bins:
                self.bins[gap] = []
                insort(self.order, gap)
            self.bins[gap].append((first, count))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """The smallest gap that holds ``least``, with one run of its bins."""
        at = bisect_left(self.order, least)
        if at == len(self.order):
            return None
        gap = self.order[at]
        first, count = self.bins[gap].pop()
        if not self.bins[gap]:
            del self.bins[gap], self.order[at]
        return gap, first, count


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Entries (length, first rank, last rank + 1, pieces per bin, first bin, offset in the bin)."""
    left = {n: c for n, c in histogram.items() if c > 0}
    entries, used, gaps, bins = [], dict.fromkeys(left, 0), _Gaps(), 0

    def give(length: int, per_bin: int, first: int, count: int, gap: int) -> None:
        pieces = per_bin * count
        entries.append((length, used[length], used[length] + pieces, per_bin, first, capacity - gap))
        used[length] += pieces
        left[length] -= pieces

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect_right(large, capacity - a) - 1
        if at >= 0 and large[at] == a and left[a] < 2:
            at -= 1
        b = large[at] if at >= 0 else 0
        count = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
        give(a, 1, bins, count, capacity)
        if b:
            give(b, 1, bins, count, capacity - a)
        gaps.put(capacity - a - b, bins, count)
        bins += count
        large = [n for n in large if left[n]] if not (left[a] and (not b or left[b])) else large
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            found = gaps.take(s)
            if found is None:  # new bins
                gap, first, count = capacity, bins, -(-left[s] // (capacity // s))
                bins += count
            else:
                gap, first, count = found
            per_bin = gap // s
            full = min(count, left[s] // per_bin)
            if full:
                give(s, per_bin, first, full, gap)
                gaps.put(gap - per_bin * s, first, full)
            elif left[s]:
                rest = left[s]
                give(s, rest, first, 1, gap)
                gaps.put(gap - rest * s, first, 1)
                full = 1
            gaps.put(gap, first + full, count - full) if gap < capacity or count > full else None
    return entries


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``doc_id, piece, length``) with ``sequence_id`` and ``offset``; the table is read twice."""
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in counts}
    by_length: dict[int, list[tuple]] = {}
    for length, *rest in plan_bins(histogram, capacity):
        by_length.setdefault(length, []).append(tuple(rest))
    kind = "__length long, runs array<struct<lo:long,hi:long,per_bin:long,bin:long,offset:long>>"
    table = F.broadcast(pieces.sparkSession.createDataFrame(list(by_length.items()), kind))  # a row per length
    slices = max(1, sum(histogram.values()) // SLICE_ROWS)
    salted = pieces.withColumn("__slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    ranked = sliced_rank(salted, ["length"], "__slice", ["doc_id", "piece"], "__rank").drop("__slice")
    run = F.element_at(F.filter("runs", lambda r: (r["lo"] <= F.col("__rank")) & (F.col("__rank") < r["hi"])), 1)
    found = ranked.join(table, F.col("length") == F.col("__length")).withColumn("__run", run)
    place = F.col("__rank") - F.col("__run.lo")
    return found.select(
        *pieces.columns, (F.col("__run.bin") + F.floor(place / F.col("__run.per_bin"))).cast("long").alias("sequence_id"),
        (F.col("__run.offset") + F.pmod(place, F.col("__run.per_bin")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack_pieces(materialize(token_pieces(docs, capacity, text, row_id), "pieces"), capacity)


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences from packed pieces with ``ids``: ``sequence_id``, ``n_tokens`` and ``ids``.

    A sequence holds at most the capacity, so its list is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"),
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
