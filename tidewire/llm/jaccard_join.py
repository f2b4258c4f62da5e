"""Near duplicates by n-gram Jaccard similarity with signature trees (operator 9).

Documents are sets of distinct 5-word shingles (64-bit hashes); equal sets are one class. Two sets are linked when
100 * intersection >= 80 * union.

Linked sets share one of the first |A| - ceil(0.8 |A|) + 1 shingles of each in any common order, so classes
that share such a shingle form a block, and blocks of equal members count once. The order is that of the hashes, with
shingles that many documents have at the end (a hint that only saves work).

Inside a block a signature tree stands over the classes: a leaf holds some classes of like size, each with a bitmap of its
shingles; a node holds the OR and the AND of the bitmaps below and the range of sizes. Two trees are walked at
once, and a pair of nodes is left as soon as their sizes or the largest possible overlap rule a link out. Pairs
of classes that stay are compared exactly, on whole texts.

Only the classes connected by links are asked for, so the walk comes twice. The first keeps a spanning forest
of each block's candidates, the closest pairs first; their links give components.
The second gives all candidates whose classes lie in different components; groups of many copies are one
component by then, and their pairs are never listed. A block of very many classes is dealt out as pairs of its parts.

Defined results: a null or empty text has no shingle and is linked with nothing; null ids come last; rows that repeat an id
are rows of their own; an empty table gives an empty result; extra columns are not carried."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewire.llm.common import Hasher, mix, signed, whole_groups
from tidewire.llm.components import components
from tidewire.session import materialize

SHINGLE = 5
SHARE = 80  # per cent
BITS = 8  # per shingle of a set, rounded up to a power of two
LEAF, FAN_OUT = 16, 8
PART = 1024  # classes of a block in one part
COMMON = 1 << 17  # shingles put at the end of the order
TOKENS_AT_ONCE = 2_000_000
TIERS = (0.3, 0.6, 0.8, 1.0)
PAIRS_AT_ONCE = 5000
FORESTS = 1  # walks that keep a spanning forest, before the one that lists what is left


def lowered(text: str | None) -> list[bytes]:
    return [w for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]


def shingle_set(hasher: Hasher, text: str | None) -> np.ndarray:
    return hasher.shingles(lowered(text), SHINGLE)


def prefix(n: int, share: int = SHARE) -> int:
    return n - -(-share * n // 100) + 1 if n else 0


def least_overlap(sizes: np.ndarray | int, share: int = SHARE):
    """Smallest intersection that links two sets whose sizes sum up to this."""
    return -(-share * sizes // (100 + share))


def linked(a: np.ndarray, b: np.ndarray, share: int = SHARE) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= share * (len(a) + len(b) - common)


def class_key(shingles: np.ndarray) -> tuple[int, int]:
    both = (np.add.reduce(mix(shingles)), np.bitwise_xor.reduce(mix(shingles ^ np.uint64(0x51ED270B4F6A0B3D))))
    return tuple(int(np.array(x, np.uint64).view(np.int64)) for x in both)


def width(sizes: np.ndarray | int) -> np.ndarray:
    """64-bit words of the bitmap of a set of this size: linked sets have equal widths or neighbouring ones."""
    return 2 ** np.ceil(np.log2(np.maximum(np.asarray(sizes) * BITS / 64, 8))).astype(np.int64)


def bitmap(shingles: np.ndarray) -> bytes:
    bits = np.zeros(64 * int(width(len(shingles))), bool)
    bits[(shingles % np.uint64(len(bits))).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of 64-bit words at half its width if it is wider than ``words``."""
    return bits if len(bits) == words else bits[:words] | bits[words:]


def _describe(docs: DataFrame) -> DataFrame:
    """Rows of two kinds from one pass: documents (``row_key, doc_id, n, k1, k2, bits``), and shingles that several
    documents of a batch have (``k1`` the shingle, ``n`` the documents; ``row_key`` null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        names = ["row_key", "doc_id", "n", "k1", "k2", "bits"]

        def often(sets: dict[tuple[int, int], np.ndarray], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            if len(sets) < 2:
                return
            values, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            many = counts > 1
            n = int(many.sum())
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, pa.int64()), pa.nulls(n, kind), pa.array(counts[many].astype(np.int64)),
                     pa.array(signed(values[many])), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names)

        for batch in batches:
            n, k1, k2, bits, sets, held = [], [], [], [], {}, 0
            kind = batch.column(1).type
            for value in batch.column(2):
                own = shingle_set(hasher, value.as_py())
                key = class_key(own) if len(own) else (0, 0)
                n.append(len(own)), k1.append(key[0]), k2.append(key[1]), bits.append(bitmap(own))
                if len(own) and key not in sets:
                    sets[key] = own
                    held += len(own)
                    if held > TOKENS_AT_ONCE:
                        yield from often(sets, kind)
                        sets, held = {}, 0
            yield from often(sets, kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()),
                 pa.array(k2, pa.int64()), pa.array(bits, pa.binary())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"row_key long, doc_id {kind}, n long, k1 long, k2 long, bits binary")


def _postings(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """``token, class, n`` of the first shingles of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            tokens, classes, sizes, held, seen = [], [], [], 0, set()

            def flush() -> pa.RecordBatch:
                counts = [len(t) for t in tokens]
                out = pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(tokens))), pa.array(np.repeat(classes, counts)),
                     pa.array(np.repeat(sizes, counts))], ["token", "class", "n"])
                tokens.clear(), classes.clear(), sizes.clear()
                return out

            for value in batch.column(0):
                own = shingle_set(hasher, value.as_py())
                if not len(own) or (key := class_key(own)) in seen:
                    continue
                seen.add(key)
                size, take = len(own), prefix(len(own))
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    late = common[at] == own
                    own = np.concatenate([own[~late], own[late]])
                tokens.append(own[:take]), classes.append(key[0]), sizes.append(size)
                held += take
                if held > 200_000:
                    yield flush()
                    held = 0
            if tokens:
                yield flush()

    return docs.select("text").mapInArrow(run, "token long, class long, n long")


class Tree:
    """A signature tree over the classes of a block, in the order of their sizes."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        """``sizes`` ascending; ``bits`` one row of 64-bit words per class."""
        self.sizes, self.bits = sizes, bits
        first = list(range(0, len(sizes), LEAF))
        self.levels = [[(i, min(i + LEAF, len(sizes))) for i in first]]
        ors = [np.array([np.bitwise_or.reduce(bits[i:j]) for i, j in self.levels[0]])]
        ands = [np.array([np.bitwise_and.reduce(bits[i:j]) for i, j in self.levels[0]])]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            groups = [(k, min(k + FAN_OUT, len(below))) for k in range(0, len(below), FAN_OUT)]
            self.levels.append([(below[k][0], below[m - 1][1]) for k, m in groups])
            ors.append(np.array([np.bitwise_or.reduce(ors[-1][k:m]) for k, m in groups]))
            ands.append(np.array([np.bitwise_and.reduce(ands[-1][k:m]) for k, m in groups]))
        self.ors, self.ands = ors, ands

    def may_link(self, level: int, p: int, q: int) -> bool:
        """Whether sizes and the largest possible overlap of nodes p <= q of a level allow a link."""
        (a, b), (c, d) = self.levels[level][p], self.levels[level][q]
        lo_p, hi_p, lo_q, hi_q = (int(self.sizes[x]) for x in (a, b - 1, c, d - 1))
        if 100 * hi_p < SHARE * lo_q:  # sizes ascend: p's are the smaller
            return False
        if p == q:
            return True
        apart_p = int(np.bitwise_count(self.ands[level][p] & ~self.ors[level][q]).sum())
        apart_q = int(np.bitwise_count(self.ands[level][q] & ~self.ors[level][p]).sum())
        return min(hi_p - apart_p, hi_q - apart_q) >= least_overlap(lo_p + lo_q)

    def leaf_pairs(self, groups: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs of leaves that may hold a link between different ``groups`` of classes."""
        low = [np.array([groups[i:j].min() for i, j in level]) for level in self.levels]
        high = [np.array([groups[i:j].max() for i, j in level]) for level in self.levels]
        top = len(self.levels) - 1
        stack = [(top, 0, 0)]
        while stack:
            level, p, q = stack.pop()
            if min(low[level][p], low[level][q]) == max(high[level][p], high[level][q]):
                continue  # all of one group
            if not self.may_link(level, p, q):
                continue
            if level == 0:
                yield p, q
                continue
            below = len(self.levels[level - 1])
            for i in range(p * FAN_OUT, min((p + 1) * FAN_OUT, below)):
                for j in range(max(i, q * FAN_OUT), min((q + 1) * FAN_OUT, below)):
                    stack.append((level - 1, i, j))

    def candidates(self, groups: np.ndarray, tier: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Index pairs of classes of different groups that can be linked, with the share of bits in which they differ:
        the bits are at most ``tier`` times the shingles in which linked sets may differ."""
        for p, q in self.leaf_pairs(groups):
            (a, b), (c, d) = self.levels[0][p], self.levels[0][q]
            sums = self.sizes[a:b, None] + self.sizes[None, c:d]
            apart = np.bitwise_count(self.bits[a:b, None, :] ^ self.bits[None, c:d, :]).sum(2, dtype=np.int64)
            near = (apart <= tier * (sums - 2 * least_overlap(sums))) & (groups[a:b, None] != groups[None, c:d])
            near &= 100 * self.sizes[a:b, None] >= SHARE * self.sizes[None, c:d]
            if p == q:
                near &= np.triu(np.ones(near.shape, bool), 1)
            i, j = np.nonzero(near)
            if len(i):
                yield i + a, j + c, apart[i, j] / np.maximum(sums[i, j], 1)


def block_pairs(ids: np.ndarray, sizes: np.ndarray, maps: list[np.ndarray], groups: np.ndarray,
                turn: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of a block (indices): all, or with a ``turn`` a spanning forest with the closest first.

    Among equally close ones the forest takes the pairs of the classes that come first by a hash of the turn, so
    that different blocks of the same classes choose the same pairs. Each class of a candidate is in the forest.

    There is a tree for each width of bitmaps, over the classes of that width and, folded, those of the next."""
    groups = np.unique(groups, return_inverse=True)[1]
    widths = width(sizes)
    trees = []
    for words in np.unique(widths).tolist():
        rows = np.flatnonzero((widths == words) | (widths == 2 * words))
        if len(rows) > 1 and (own := widths[rows] == words).any():
            rows = rows[np.argsort(sizes[rows], kind="stable")]
            own = widths[rows] == words
            trees.append((Tree(sizes[rows], np.stack([folded(maps[r], words) for r in rows])), rows, own))
    left, right = [], []
    all_pairs = turn is None
    first = ids if all_pairs else mix(ids.view(np.uint64) + np.uint64(turn))
    root = list(range(int(groups.max()) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for tier in (1.0,) if all_pairs else TIERS:
        found_i, found_j, found_apart = [], [], []
        now = np.array([find(g) for g in range(len(root))])[groups]
        for tree, rows, own in trees:
            for i, j, apart in tree.candidates(now[rows], tier):
                here = own[i] | own[j]  # two of the next width meet in its tree
                found_i.append(rows[i[here]]), found_j.append(rows[j[here]]), found_apart.append(apart[here])
        if not found_i:
            continue
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        if all_pairs:
            left.append(i), right.append(j)
            continue
        order = np.lexsort((np.maximum(first[i], first[j]), np.minimum(first[i], first[j]), np.concatenate(found_apart)))
        for part in range(0, len(order), PAIRS_AT_ONCE):
            at = order[part:part + PAIRS_AT_ONCE]
            now = np.array([find(g) for g in range(len(root))])[groups]
            at = at[now[i[at]] != now[j[at]]]
            for x, y in zip(i[at].tolist(), j[at].tolist()):
                a, b = find(int(groups[x])), find(int(groups[y]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    left.append([x]), right.append([y])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _candidates(blocks: DataFrame, bits: DataFrame, groups: DataFrame | None, turn: int | None) -> DataFrame:
    """Pairs ``a, b`` of classes from blocks (``token, class, n``) whose members are not all of one group."""
    rows = blocks if groups is None else blocks.join(groups, "class", "left")
    rows = rows.withColumn("group", F.col("class") if groups is None else F.coalesce("root", "class"))
    counted = rows.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.min("group").alias("g0"),
                                        F.max("group").alias("g1")).where("g0 < g1")
    rows = rows.join(counted.select("token", "members"), "token")
    parts = F.when(F.col("members") <= 2 * PART, 1).otherwise(F.ceil(F.col("members") / PART)).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(F.xxhash64("token", F.least("part", "other"), F.greatest("part", "other")).alias("block"),
                       "class", "n", "group").join(bits, "class")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, "block"):
            ids = frame["class"].to_numpy()
            sizes, own = frame["n"].to_numpy(np.int64), frame["group"].to_numpy()
            maps = [np.frombuffer(b, np.uint64) for b in frame["bits"]]
            edges = np.flatnonzero(np.diff(frame["block"].to_numpy())) + 1
            out_a, out_b = [], []
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(frame)]):
                x, y = block_pairs(ids[i:j], sizes[i:j], maps[i:j], own[i:j], turn)
                out_a.append(ids[i:j][x]), out_b.append(ids[i:j][y])
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    dealt = rows.repartition("block").sortWithinPartitions("block")
    return dealt.mapInPandas(run, "a long, b long").where("a <> b").distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, linked``: exact comparison of the texts of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, last, own = Hasher(), None, None
        for batch in batches:
            verdicts = []
            for a, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, own = a, shingle_set(hasher, text_a.as_py())
                verdicts.append(linked(own, shingle_set(hasher, text_b.as_py())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(verdicts, pa.bool_())],
                                             ["a", "b", "linked"])

    both = pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean")


def common_shingles(described: DataFrame, most: int = COMMON) -> np.ndarray:
    """Nearly the ``most`` most frequent of the shingles seen often in a batch, sorted: at most one megabyte.

    Levels of like counts are counted first (some hundreds of rows); the lowest level that still has room gives
    a part of its shingles, by their hash. So the driver sees only the shingles it keeps."""
    counts = materialize(described.where("row_key IS NULL").groupBy("k1").agg(F.sum("n").alias("n")).select(
        "k1", F.floor(F.log2("n") * 8).cast("int").alias("level")), "often")
    room, floor, share = most, 1 << 30, 0.0
    for row in counts.groupBy("level").count().orderBy(F.desc("level")).collect():
        floor = row["level"]
        if row["count"] > room:
            share = max(0.0, room - 4 * room ** 0.5) / row["count"]  # drawn by chance: four deviations below the room
            break
        room, share = room - row["count"], 1.0
    drawn = F.pmod(F.xxhash64("k1"), F.lit(1 << 20)) < int(share * (1 << 20))
    rows = counts.where((F.col("level") > floor) | ((F.col("level") == floor) & drawn)).select("k1").toPandas()
    return np.sort(rows["k1"].to_numpy(np.int64).view(np.uint64))


def similar_documents(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``row_key``, id, ``n_shingles``, ``component_id`` (smallest id reachable by links) and
    ``root``, the key of the component: ids can be null or repeated, roots tell components apart (null: no shingle)."""
    rows = docs.select(F.xxhash64(row_id, text).alias("row_key"), F.col(row_id).alias("doc_id"), F.col(text).alias("text"))
    described = materialize(_describe(rows), "shingles")
    common = common_shingles(described)
    members = described.where("row_key IS NOT NULL")
    # Blocks: classes that share a shingle of their prefixes.
    dealt = _postings(rows, common).repartition("token")
    # The largest size is asked for so that both uses need the same columns and share one shuffle.
    several = dealt.groupBy("token").agg(F.min("class").alias("c0"), F.max("class").alias("c1"),
                                         F.max("n").alias("most")).where("c0 < c1 AND most > 0")
    blocks = dealt.join(several.select("token"), "token").distinct()
    # A member without another of like size cannot be linked here.
    by_size = Window.partitionBy("token").orderBy("n")
    below, above = F.lag("n").over(by_size), F.lead("n").over(by_size)
    near = F.coalesce(100 * below >= SHARE * F.col("n"), F.lit(False)) | F.coalesce(
        100 * F.col("n") >= SHARE * above, F.lit(False))
    blocks = materialize(blocks.withColumn("near", near).where("near").drop("near"), "blocks")
    kinds = blocks.groupBy("token").agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("class")).alias("x"),
        F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y"))
    once = kinds.groupBy("m", "x", "y").agg(F.min("token").alias("token")).select("token")
    blocks = materialize(blocks.join(once, "token", "left_semi"), "blocks")
    classes = members.where("n > 0").withColumnRenamed("k1", "class")
    bits = materialize(classes.select("class", "bits").join(blocks.select("class").distinct(), "class", "left_semi")
                       .groupBy("class").agg(F.first("bits").alias("bits")), "bitmaps")
    groups = tested = texts = None
    for turn in [*range(FORESTS), None]:
        pairs = _candidates(blocks, bits, groups, turn)
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "candidates")
        if texts is None:  # later candidates have no other classes
            wanted = classes.groupBy("class").agg(F.min("row_key").alias("row_key")).join(
                pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "class", "left_semi")
            texts = materialize(rows.select("row_key", "text").join(wanted, "row_key").dropDuplicates(["row_key"]).select(
                "class", "text"), "texts")
        checked = materialize(_verified(pairs, texts), "pairs")
        tested = checked if tested is None else tested.unionByName(checked)
        groups = components(tested.where("linked")).select(F.col("node").alias("class"), "root")
    groups = groups.withColumnRenamed("class", "k1")
    classes = members.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
    classes = classes.join(groups, "k1", "left").withColumn("root", F.coalesce("root", "k1"))
    least = classes.groupBy("root").agg(F.min("least").alias("component"))
    classes = classes.join(least, "root").select("k1", "k2", "component", "root")
    return members.join(classes, ["k1", "k2"], "left").select(
        "row_key", F.col("doc_id").alias(row_id), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("root")).alias("root"))


def keep_one_of_each(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component (null last), one of each; rows without words all stay."""
    found = similar_documents(docs, text, row_id)
    lone = found.where("n_shingles = 0").select("row_key", F.lit(1).alias("copies")).distinct()
    # Rows that repeat the smallest id: the least key stays.
    rows = found.where("n_shingles > 0").groupBy("root", "row_key").agg(
        F.min(row_id).alias("id"), F.count(F.lit(1)).alias("copies"))
    head = F.min(F.struct(F.isnull("id").alias("no_id"), "id", "row_key", "copies")).alias("head")
    heads = rows.groupBy("root").agg(head).select("head.row_key", "head.copies")
    keys = materialize(lone.unionByName(heads), "heads").withColumnRenamed("row_key", "__key")
    keyed = docs.withColumn("__key", F.xxhash64(row_id, text))
    kept = keyed.join(keys.where("copies = 1"), "__key", "left_semi")
    several = keys.where("copies > 1")
    if several.limit(1).count():  # rows of equal id and text: any of them
        kept = kept.unionByName(keyed.join(several, "__key", "left_semi").dropDuplicates(["__key"]))
    return kept.drop("__key")
