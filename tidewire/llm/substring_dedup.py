"""Long repeats across documents by recompression (operator 10).

Each word is a symbol. A round names runs of one symbol and then pairs of neighbours, a left one followed by a right
one, where a hash of the symbol says which side it is on. A name is a hash of what it stands for, so all tasks give
equal runs and pairs equal names without exchanging a dictionary. What becomes of a symbol depends on its
neighbours alone; equal passages therefore get equal symbols but near their ends. A round joins nothing longer than
its limit, so the ends that may differ are bounded: 2 * limit - 1 words a side and round. ROUNDS = (2, 4) leaves 30 of 50
words that are cut alike, into symbols of at most 4 words.

The beginnings of symbols are the anchors; an anchor is named by the 8 words that follow. Of each 7 anchors in a row the
one with the least name is kept: the 31 places whose cut is the same hold 7 anchors at least (the words of a name need no
equal cut), so every repeated window of 50 words has a kept anchor in common with its first occurrence. One shuffle of kept names finds the
shared ones; only windows whose inner anchors are all shared are named and compared over all documents (96 bits).

Copies of a whole text are settled by the hash of the text and take no part in the rest but for the first.

Defined results: a null text has no words; a null id is neither earlier nor later than another; rows that repeat an id
do not count as earlier than each other; an empty table gives an empty result; extra columns are not carried."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.common import Hasher, mix, signed, words_of
from tidewire.session import materialize

WINDOW = 50
ROUNDS = (2, 4)
ANCHOR = 8
CHUNK_WORDS = 400_000


def border(rounds: tuple[int, ...] = ROUNDS) -> int:
    """Words at each end of a repeat that may be cut differently."""
    return sum(2 * limit - 1 for limit in rounds)


def anchors_in_a_row(window: int = WINDOW, anchor: int = ANCHOR, rounds: tuple[int, ...] = ROUNDS) -> int:
    """Anchors that every window has where the cut is the same, with their words inside: of so many places in a row
    one in ``max(rounds)`` at least is the beginning of a symbol."""
    return (window - border(rounds) - max(border(rounds), anchor) + 1) // max(rounds)


def recompress(names: np.ndarray, doc: np.ndarray, rounds: tuple[int, ...] = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Symbols over ``names`` of words; nothing is joined over a change of ``doc``. Returns first words and names."""
    at = np.arange(len(names))
    length = np.ones(len(names), np.int64)
    for turn, limit in enumerate(rounds):
        # Runs.
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(names)))
        joined = (count > 1) & (count * length[begin] <= limit)
        keep = np.repeat(~joined, count)
        keep[begin] = True
        names, length = names.copy(), length.copy()
        run = begin[joined]
        names[run] = mix(names[run] * np.uint64(0xD1342543DE82EF95) + count[joined].astype(np.uint64) + np.uint64(turn + 1))
        length[run] *= count[joined]
        names, length, at, doc = names[keep], length[keep], at[keep], doc[keep]
        # Pairs.
        right = (mix(names + np.uint64(0x632BE59BD9B4E019 + turn)) & np.uint64(1)).astype(bool)
        pair = np.flatnonzero(~right[:-1] & right[1:] & (doc[1:] == doc[:-1]) & (length[:-1] + length[1:] <= limit))
        names, length = names.copy(), length.copy()
        names[pair] = mix(names[pair] * np.uint64(0xAF251AF3B0F025B5) + names[pair + 1] + np.uint64(turn + 11))
        length[pair] += length[pair + 1]
        keep = np.ones(len(names), bool)
        keep[pair + 1] = False
        names, length, at, doc = names[keep], length[keep], at[keep], doc[keep]
    return at, names


def anchor_rows(names: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk of documents: first words and names of the anchors, and for each row of anchors that begins at one and
    lies in one document the index of its least anchor (elsewhere -1)."""
    at, _ = recompress(names, doc)
    row = anchors_in_a_row(window)
    whole = at + ANCHOR <= len(names)
    whole[whole] = doc[at[whole]] == doc[at[whole] + ANCHOR - 1]
    at = at[whole]
    name = Hasher.runs(names, ANCHOR)[at]
    n = max(0, len(at) - row + 1)
    least = np.arange(n)
    for j in range(1, row):
        other = np.arange(n) + j
        least = np.where(name[other] < name[least], other, least)
    least[doc[at[:n]] != doc[at[row - 1:][:n]]] = -1
    return at, name, least


def candidate_windows(names: np.ndarray, shared: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """First words of the windows of one document that can be repeats: every row of anchors inside, as far in as the
    cut is the same in all documents, has a shared least anchor."""
    at, name, least = anchor_rows(names, np.zeros(len(names), np.int8), window)
    row, edge = anchors_in_a_row(window), border()
    strange = np.concatenate([[0], np.cumsum(~np.isin(name, shared)[least])])
    begin = np.arange(len(names) - window + 1)
    first = np.searchsorted(at, begin + edge)
    end = np.searchsorted(at[row - 1:], begin + window - max(edge, ANCHOR), "right")
    end = np.minimum(end, len(least))
    fits = end > first
    first, end = np.where(fits, first, 0), np.where(fits, end, 0)
    return begin[fits & (strange[end] == strange[first])]


def _chunks(batch: pa.RecordBatch, text: int, window: int) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Documents of at least a window, gathered until they have CHUNK_WORDS words."""
    rows, texts, n = [], [], 0
    for i, value in enumerate(batch.column(text)):
        words = words_of(value.as_py())
        if len(words) < window:
            continue
        rows.append(i)
        texts.append(words)
        n += len(words)
        if n >= CHUNK_WORDS:
            yield rows, texts
            rows, texts, n = [], [], 0
    if rows:
        yield rows, texts


def _flat(hasher: Hasher, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    names = np.concatenate([hasher.words(words) for words in texts])
    return names, np.repeat(np.arange(len(texts)), [len(words) for words in texts])


def _whole_texts(docs: DataFrame) -> DataFrame:
    """One row per document with its number of words, the hash of all kept and two hashes of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for value in batch.column(2):
                words = words_of(value.as_py())
                sha = hashlib.sha256(b" ".join(words)).hexdigest()
                for column, x in zip(out, (len(words), sha, int(sha[:15], 16), int(sha[15:30], 16))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()),
                 pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())],
                ["doc_id", "key", "n_words", "sha", "w1", "w2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, key long, n_words long, sha string, w1 long, w2 long")


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for rows, texts in _chunks(batch, 2, window):
                names, doc = _flat(hasher, texts)
                at, name, least = anchor_rows(names, doc, window)
                least = np.unique(least[least >= 0])
                pairs = np.unique(np.rec.fromarrays([doc[at[least]], name[least]]))  # a name once per document
                of = pa.array(np.array(rows)[pairs.f0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(pairs.f1.copy())), batch.column(0).take(of), batch.column(1).take(of)],
                    ["name", "doc_id", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("doc_id IS NOT NULL").mapInArrow(run, f"name long, doc_id {kind}, key long")


def _shared(names: pa.Scalar) -> np.ndarray:
    return names.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _with_candidates(joined: DataFrame, window: int) -> DataFrame:
    """The rows of ``doc_id, key, text, names`` (shared anchors) that have a window which can be a repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            keep = [len(candidate_windows(hasher.words(words_of(value.as_py())), _shared(names), window)) > 0
                    for value, names in zip(batch.column(2), batch.column(3))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = joined.select("doc_id", "key", "text", "names")
    return rows.mapInArrow(run, rows.schema)


def _window_rows(suspects: DataFrame, window: int) -> DataFrame:
    """Windows that can be repeats: ``w1, w2`` (name), ``doc_id, key`` and ``at``, all their places there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, second = Hasher(), Hasher(1)
        for batch in batches:
            for i, (value, shared) in enumerate(zip(batch.column(2), batch.column(3))):
                words = words_of(value.as_py())
                names = hasher.words(words)
                begin = candidate_windows(names, _shared(shared), window)
                if not len(begin):
                    continue
                w1 = signed(Hasher.runs(names, window)[begin])
                w2 = signed(Hasher.runs(second.words(words), window)[begin]).astype(np.int32)
                order = np.lexsort((begin, w2, w1))
                w1, w2, begin = w1[order], w2[order], begin[order]
                first = np.flatnonzero(np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(begin)).astype(np.int32)),
                                                  pa.array(begin.astype(np.int32)))
                own = pa.array(np.full(len(first), i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w1[first]), pa.array(w2[first]), batch.column(0).take(own), batch.column(1).take(own), places],
                    ["w1", "w2", "doc_id", "key", "at"])

    kind = suspects.schema["doc_id"].dataType.simpleString()
    return suspects.select("doc_id", "key", "text", "names").mapInArrow(
        run, f"w1 long, w2 int, doc_id {kind}, key long, at array<int>")


def covered(n: int, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of n words lie in a window that begins at one of ``starts``."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + window, n), -1)
    return np.cumsum(marks[:n]) > 0


def _without(suspects: DataFrame, window: int) -> DataFrame:
    """Texts with ``starts`` of repeated windows: what is left of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha, kept = [], [], []
            for value, starts in zip(batch.column(2), batch.column(3)):
                words = words_of(value.as_py())
                gone = covered(len(words), starts.values.to_numpy(zero_copy_only=False).astype(np.int64), window)
                rest = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(kept, pa.string())], ["doc_id", "key", "n_removed", "kept_sha256", "kept_text"])

    kind = suspects.schema["doc_id"].dataType.simpleString()
    return suspects.select("doc_id", "key", "text", "starts").mapInArrow(
        run, f"doc_id {kind}, key long, n_removed long, kept_sha256 string, kept_text string")


def _in_two(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (no nulls) whose ``name`` occurs in two documents.

    Both uses of the dealt rows ask for all columns and no nulls, so they share one shuffle."""
    dealt = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in rows.columns)).repartition(name)
    rest = F.max(F.hash(*[c for c in rows.columns if c != name])).alias("__rest")
    several = dealt.groupBy(name).agg(F.min("doc_id").alias("__first"), F.max("doc_id").alias("__last"), rest).where(
        "__first < __last AND __rest IS NOT NULL").select(name)
    return dealt.join(several, name)


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text`` (null: nothing removed)."""
    rows = docs.select(F.col(row_id).alias("doc_id"), F.xxhash64(row_id, text).alias("key"), F.col(text).alias("text"))
    whole = materialize(_whole_texts(rows), "whole-texts")
    classes = whole.where("doc_id IS NOT NULL").groupBy("w1", "w2").agg(F.min("doc_id").alias("first"))
    whole = materialize(whole.join(classes, ["w1", "w2"], "left").select(
        "doc_id", "key", "n_words", "sha", (F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
                                            & (F.col("n_words") >= window)).alias("copy")), "whole-texts")
    shared = _in_two(_anchor_rows(rows, window), "name")
    # A list holds anchors of one document.
    shared = shared.groupBy("doc_id", "key").agg(F.collect_set("name").alias("names"))
    firsts = whole.where(~F.col("copy") & (F.col("n_words") >= window)).select("doc_id", "key").distinct()
    suspects = materialize(_with_candidates(rows.join(shared.join(firsts, ["doc_id", "key"]), ["doc_id", "key"]), window),
                           "suspects")
    named = materialize(_window_rows(suspects, window), "windows")
    earliest = named.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    repeated = named.join(earliest, ["w1", "w2"]).where("first < doc_id")
    # A list holds places of one document.
    starts = repeated.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("at")).alias("starts"))
    cut = _without(suspects.select("doc_id", "key", "text").join(starts, ["doc_id", "key"]), window)
    cut = cut.groupBy("doc_id", "key").agg(*[F.first(c).alias(c) for c in ("n_removed", "kept_sha256", "kept_text")])
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.join(cut, ["doc_id", "key"], "left").select(
        F.col("doc_id").alias(row_id), "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), "").otherwise(F.col("kept_text")).alias("kept_text"))
