"""Masked pseudo-likelihood of documents (operator 5).

A small network, trained in numpy inside tasks, predicts every word of a text from the two words on either side:
each place of the window has its own embedding table, their sum goes through tanh, and a softmax in two steps
(one of 64 groups, then one of the 64 members of the group) gives the word's class. The VOCABULARY most frequent
words are classes of their own, dealt out over the groups so that these have like shares of the text; each other word
belongs to one of BUCKETS classes by its crc32, and a third step gives the word itself: its share in the counts of its
class. So every word has a probability of its own, and what surrounds a rare word counts for and against it. The score
of a document is the sum of the conditional log-probabilities of its words.

Counts are taken from all words of all documents and stay a table, joined to the words outside the vocabulary;
a word that the counts lack counts as one seen once. Texts are then read once more and written as class ids of two bytes;
training and scoring read only these. Training passes over all documents once: they are divided into ROUNDS by hash; in a
round every task takes gradient steps on its share from the common parameters, and the parameters of the tasks are
averaged, weighted by their words. Scoring reads all again. What meets on the driver is one set of parameters
(fixed size); counts and what the tasks send grow with the corpus. Which documents share a task follows from the files of
the input, so scores of another split of the same rows differ a little.

Defined results: a null or empty text has score 0 and no words; a word alone is predicted from the edge of the text; null
and repeated ids are rows of their own; an empty table gives an empty result; extra columns are not carried."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewire.session import materialize

GROUPS = MEMBERS = 64
CLASSES = GROUPS * MEMBERS
BUCKETS = 1024  # classes of words outside the vocabulary
VOCABULARY = CLASSES - BUCKETS - 1
EDGE = CLASSES - 1
REACH = 2  # words on either side
WIDTH = 16
ROUNDS = 2
BATCH = 8192
RATE = 0.5
BYTES_AT_ONCE = 24_000_000
PARAMETERS = 8192  # of a block
FEW = 1024  # a batch divided by this: rows of a word in it that count as one


def _class_at(slot):
    """Class of a slot: neighbours in the order of frequency stand in different groups."""
    return slot % GROUPS * MEMBERS + slot // GROUPS


def _pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a batch of about ``BYTES_AT_ONCE``, with their first row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // BYTES_AT_ONCE
    cuts = np.concatenate(([0], np.flatnonzero(ends[1:] != ends[:-1]) + 1, [len(texts)])).tolist()
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield a, texts.slice(a, b - a)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after the other (dictionary-encoded), and the number of words of each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)  # at the six characters that are no word, as words_of
    words = lists.flatten().cast(pa.large_binary())
    real = pc.greater(pc.binary_length(words), 0)  # white space at the ends gives empty words
    if pc.all(real).as_py() is False:
        counts = np.bincount(pc.list_parent_indices(lists).filter(real).to_numpy(), minlength=len(texts))
        return words.filter(real).dictionary_encode(), counts
    return words.dictionary_encode(), pc.list_value_length(lists).to_numpy().astype(np.int64)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` of all words of all documents, written once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _pieces(batch.column(0)):
                words, _ = _split(texts)
                if len(words):
                    n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                    yield pa.RecordBatch.from_arrays([words.dictionary.cast(pa.binary()), pa.array(n)], ["word", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word binary, n long")
    return materialize(rows.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def vocabulary(counts: DataFrame, size: int = VOCABULARY) -> dict[bytes, int]:
    """The most frequent words with their classes; frequent ones are spread over the groups."""
    top = counts.orderBy(F.desc("n"), "word").limit(size).collect()
    return {bytes(row["word"]): _class_at(i) for i, row in enumerate(top)}


def bucket_totals(counts: DataFrame, known: dict[bytes, int]) -> np.ndarray:
    """Counts of all words outside the vocabulary, by bucket."""
    known_words = counts.sparkSession.createDataFrame([(bytearray(w),) for w in known], "word binary")  # of fixed size
    rows = counts.join(known_words, "word", "left_anti").groupBy(
        (F.crc32("word") % BUCKETS).alias("bucket")).agg(F.sum("n").alias("n")).collect()  # BUCKETS rows
    totals = np.zeros(BUCKETS, np.int64)
    for row in rows:
        totals[row["bucket"]] = row["n"]
    return totals


def classes_of(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    get = known.get
    return np.array([c if (c := get(w)) is not None else _class_at(VOCABULARY + zlib.crc32(w) % BUCKETS) for w in words],
                    np.int64)


def encode(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """Rows of two kinds from one pass over ``doc_id, text``, written once: documents with their classes (``word`` null),
    and words outside the vocabulary with the documents that hold them and how often.

    ``row`` numbers the documents; the numbers hold once they are written."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # of fixed size
    names = ["row", "doc_id", "n_words", "classes", "word", "rows", "times"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            kind = batch.column(1).type
            for begin, texts in _pieces(batch.column(2)):
                words, counts = _split(texts)
                own = words.dictionary.to_pylist()
                table = classes_of(own, known)
                codes = words.indices.to_numpy()
                blob = table.astype(np.uint16)[codes].tobytes()
                edges = np.concatenate(([0], np.cumsum(2 * counts)))
                n = len(texts)
                blobs = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(blob)])
                rows = batch.column(0).slice(begin, n)
                yield pa.RecordBatch.from_arrays(
                    [rows, batch.column(1).slice(begin, n), pa.array(counts.astype(np.int64)), blobs.cast(pa.binary()),
                     pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))], names)
                rare = np.array([w not in known for w in own], bool)
                at = np.flatnonzero(rare[codes]) if len(codes) else np.empty(0, np.int64)
                if not len(at):
                    continue
                pairs = codes[at].astype(np.int64) * n + np.repeat(np.arange(n), counts)[at]
                pairs, times = np.unique(pairs, return_counts=True)
                ends = np.concatenate(([0], np.cumsum(np.bincount(pairs // n, minlength=len(own))[rare]))).astype(np.int32)
                m = len(ends) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(m, pa.int64()), pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()),
                     words.dictionary.filter(pa.array(rare)).cast(pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends), rows.take(pa.array(pairs % n))),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32)))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    return materialize(numbered.mapInArrow(
        code, f"row long, doc_id {kind}, n_words long, classes binary, word binary, rows array<long>, times array<int>"), "classes")


class Network:
    """Parameters as one flat array, and views on it."""

    SHAPES = {"places": (2 * REACH, CLASSES, WIDTH), "bias": (WIDTH,), "group": (WIDTH, GROUPS), "group_bias": (GROUPS,),
              "member": (GROUPS, WIDTH, MEMBERS), "member_bias": (GROUPS, MEMBERS)}
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at:at + n].reshape(shape))
            at += n

    @classmethod
    def fresh(cls, seed: int = 1) -> Network:
        net = cls(np.zeros(cls.SIZE, np.float32))
        rng = np.random.default_rng(seed)
        for part in (net.places, net.group, net.member):
            part[...] = rng.normal(0, 0.1, part.shape)
        return net

    def hidden(self, window: np.ndarray) -> np.ndarray:
        """``window``: classes of the words around, one row per place."""
        total = self.places[0].take(window[0], axis=0)
        for k in range(1, 2 * REACH):
            total += self.places[k].take(window[k], axis=0)
        total += self.bias
        return np.tanh(total, out=total)

    def log_probability(self, window: np.ndarray, word: np.ndarray) -> np.ndarray:
        order, ends = _by_group(word // MEMBERS)  # words of a group side by side
        h, out = self.hidden(window)[order], np.empty(len(word), np.float32)
        group, member = word[order] // MEMBERS, word[order] % MEMBERS
        found = _log_share(self.group.T @ h.T + self.group_bias[:, None], group)
        for g, (a, b) in enumerate(zip(ends, ends[1:])):
            if b > a:
                found[a:b] += _log_share(self.member[g].T @ h[a:b].T + self.member_bias[g][:, None], member[a:b])
        out[order] = found
        return out

    def step(self, window: np.ndarray, word: np.ndarray, rate: float) -> None:
        """One gradient step on the mean log-probability of a batch; rows that occur often in it share their step."""
        order, ends = _by_group(word // MEMBERS)
        window, word, n = window[:, order], word[order], len(word)
        h, member = self.hidden(window), word % MEMBERS
        slope = _slope(self.group.T @ h.T + self.group_bias[:, None], word // MEMBERS)
        back = self.group @ slope
        self.group += np.float32(rate / n) * (slope @ h).T
        self.group_bias += np.float32(rate) * slope.mean(1)
        for g, (a, b) in enumerate(zip(ends, ends[1:])):
            if b > a:
                own = _slope(self.member[g].T @ h[a:b].T + self.member_bias[g][:, None], member[a:b])
                back[:, a:b] += self.member[g] @ own
                self.member[g] += np.float32(rate / (b - a)) * (own @ h[a:b]).T
                self.member_bias[g] += np.float32(rate) * own.mean(1)
        back = back.T * (1 - h * h)
        self.bias += np.float32(rate) * back.mean(0)
        for k in range(2 * REACH):
            order = np.argsort(window[k].astype(np.uint16), kind="stable")
            sorted_classes = window[k][order]
            first = np.flatnonzero(np.concatenate(([True], sorted_classes[1:] != sorted_classes[:-1])))
            count = np.diff(np.append(first, n))[:, None]
            # The square root stands between the mean over the batch and the mean over the word's own rows.
            share = (rate / np.sqrt(count * (n / FEW) + 1)).astype(np.float32)
            self.places[k][sorted_classes[first]] += share * np.add.reduceat(back.take(order, axis=0), first, axis=0)


def _log_share(x: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax over the rows of ``x``, of the picked row in each column."""
    top = x.max(0)
    out = x[picked, np.arange(x.shape[1])] - top
    x -= top
    return out - np.log(np.exp(x, out=x).sum(0))


def _slope(x: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """Slope of ``_log_share`` by ``x``."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= -x.sum(0)
    x[picked, np.arange(x.shape[1])] += 1
    return x


def _by_group(group: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Order that puts rows of a group side by side, and where the groups begin."""
    order = np.argsort(group.astype(np.uint8), kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(group, minlength=GROUPS)))).tolist()


def windows(classes: np.ndarray, begins: np.ndarray | None = None) -> np.ndarray:
    """Classes of the words around each word, one row per place; beyond the text stands EDGE.

    ``classes`` may hold several texts one after the other; ``begins`` tells where each begins."""
    n = len(classes)
    begins = np.zeros(min(n, 1), np.int64) if begins is None else begins
    ends = np.append(begins[1:], n)
    out = np.full((2 * REACH, n), EDGE, np.int64)
    for k, far in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        if far < 0:
            out[k, -far:] = classes[:far]
        else:
            out[k, :-far] = classes[far:]
        for j in range(abs(far)):  # words at the edge of their text look beyond it
            at = begins + j if far < 0 else ends - 1 - j
            out[k, at[(at >= begins) & (at < ends)]] = EDGE
    return out


def _texts(batches: Iterator[pa.RecordBatch], at: int, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes of whole texts, about ``words`` at a time, and where each text begins; texts without a word are left out."""
    for batch in batches:
        blobs = batch.column(at).cast(pa.large_binary())
        sizes = pc.binary_length(blobs).to_numpy() // 2
        base = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset] if len(blobs) else 0
        data = np.frombuffer(blobs.buffers()[2] or b"", np.uint8)[base:base + 2 * int(sizes.sum())].view(np.uint16)
        begins = np.cumsum(sizes) - sizes
        begins = begins[sizes > 0]
        turn = begins // words
        cuts = np.concatenate(([0], np.flatnonzero(turn[1:] != turn[:-1]) + 1, [len(begins)])).tolist()
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                low, high = int(begins[a]), int(begins[b]) if b < len(begins) else len(data)
                yield data[low:high].astype(np.int64), begins[a:b] - low


def _train_round(coded: DataFrame, flat: np.ndarray, turn: int) -> np.ndarray:
    """Parameters after one round: the mean over the tasks, weighted by words."""
    shared = coded.sparkSession.sparkContext.broadcast(flat)  # of fixed size

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen = Network(shared.value.copy()), 0
        for classes, begins in _texts(batches, 0, 32 * BATCH):
            window = windows(classes, begins)
            order = np.random.default_rng(len(classes)).permutation(len(classes))
            for i in range(0, len(order), BATCH):
                rows = order[i:i + BATCH]
                net.step(window[:, rows], classes[rows], RATE / (1 + turn))
            seen += len(classes)
        if seen:  # in blocks, so that the blocks of all tasks are added up side by side
            total = net.flat.astype(np.float64) * seen
            for k in range(0, Network.SIZE, PARAMETERS):
                yield pa.RecordBatch.from_pydict({"block": [k], "total": [total[k:k + PARAMETERS].tobytes()], "words": [seen]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        words: dict[int, int] = {}
        for batch in batches:
            for k, total, n in zip(*(batch.column(c).to_pylist() for c in ("block", "total", "words"))):
                totals[k] = totals.get(k, 0) + np.frombuffer(total, np.float64)
                words[k] = words.get(k, 0) + n
        for k, total in totals.items():
            yield pa.RecordBatch.from_pydict({"block": [k], "mean": [(total / words[k]).astype(np.float32).tobytes()]})

    rows = coded.where(F.col("word").isNull() & (F.pmod(F.xxhash64("row", F.lit(17)), F.lit(ROUNDS)) == turn)).select(
        "classes").mapInArrow(train, "block long, total binary, words long")
    blocks = rows.repartition("block").mapInArrow(add, "block long, mean binary").collect()  # SIZE parameters
    shared.unpersist()
    out = flat.copy()
    for row in blocks:
        mean = np.frombuffer(row["mean"], np.float32)
        out[row["block"]:row["block"] + len(mean)] = mean
    return out


def train(coded: DataFrame) -> np.ndarray:
    """Parameters from all documents of ``encode``."""
    flat = Network.fresh().flat
    for turn in range(ROUNDS):
        flat = _train_round(coded, flat, turn)
    return flat


def fit(docs: DataFrame, text: str = "text", counts: DataFrame | None = None) -> tuple[dict[bytes, int], np.ndarray]:
    """Vocabulary and parameters from all of ``docs``; ``counts``: their ``word_counts``, if at hand."""
    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = vocabulary(word_counts(rows) if counts is None else counts)
    return known, train(encode(rows, known))


def score_words(classes: np.ndarray, net: Network, begins: np.ndarray | None = None) -> np.ndarray:
    window = windows(classes, begins)
    return np.concatenate([net.log_probability(window[:, i:i + 4 * BATCH], classes[i:i + 4 * BATCH])
                           for i in range(0, len(classes), 4 * BATCH)]) if len(classes) else np.empty(0, np.float32)


def score_classes(coded: DataFrame, flat: np.ndarray) -> DataFrame:
    """``row, doc_id, n_words, log_likelihood``: the log-probability of the classes of each document of ``encode``."""
    shared = coded.sparkSession.sparkContext.broadcast(flat)  # of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shared.value)
        for batch in batches:
            parts = [np.add.reduceat(score_words(classes, net, begins).astype(np.float64), begins)
                     for classes, begins in _texts(iter([batch]), 3, 32 * BATCH)]
            sums = np.zeros(batch.num_rows)
            sums[batch.column(2).to_numpy() > 0] = np.concatenate(parts) if parts else 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums)], ["row", "doc_id", "n_words", "log_likelihood"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.where("word IS NULL").select("row", "doc_id", "n_words", "classes").mapInArrow(
        score, f"row long, doc_id {kind}, n_words long, log_likelihood double")


def score_coded(coded: DataFrame, known: dict[bytes, int], flat: np.ndarray, counts: DataFrame) -> DataFrame:
    """One row per document of ``encode``: id, ``n_words``, ``log_likelihood`` (sum over its words) and ``per_word``."""
    totals = bucket_totals(counts, known)
    total = F.element_at(F.array(*[F.lit(float(max(n, 1))) for n in totals.tolist()]), (F.crc32("word") % BUCKETS + 1).cast("int"))
    share = F.log(F.coalesce(F.col("n"), F.lit(1)) / total).alias("share")
    rare = coded.where("word IS NOT NULL").select("word", "rows", "times").join(counts, "word", "left").select(
        share, F.explode(F.arrays_zip("rows", "times")).alias("at"))
    rare = rare.groupBy(F.col("at.rows").alias("row")).agg(F.sum(F.col("share") * F.col("at.times")).alias("shares"))
    whole = F.col("log_likelihood") + F.coalesce("shares", F.lit(0.0))
    return score_classes(coded, flat).join(rare, "row", "left").select(
        "doc_id", "n_words", F.round(whole, 3).alias("log_likelihood"),
        F.round(whole / F.greatest("n_words", F.lit(1)), 6).alias("per_word"))


def score_documents(docs: DataFrame, known: dict[bytes, int], flat: np.ndarray, text: str = "text",
                    row_id: str = "doc_id", counts: DataFrame | None = None) -> DataFrame:
    """``score_coded`` of ``docs``, which need not be those that were fitted.

    ``counts``: the ``word_counts`` that give words outside the vocabulary their shares; by default those of ``docs``."""
    rows = docs.select(F.col(row_id).alias("doc_id"), F.col(text).alias("text"))
    return score_coded(encode(rows, known), known, flat, word_counts(rows) if counts is None else counts)


def score_corpus(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Counts, network and scores of one table: texts are split twice, classes read once for training, once for scores."""
    rows = docs.select(F.col(row_id).alias("doc_id"), F.col(text).alias("text"))
    counts = word_counts(rows)
    known = vocabulary(counts)
    coded = encode(rows, known)
    return score_coded(coded, known, train(coded), counts)
