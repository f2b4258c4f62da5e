"""Token ids in training order, as binary shards of fixed stride (operator 3).

The ids of the documents of a block (one input split), each closed by an end mark, are cut into sequences of
SEQUENCE ids; the last of a block is filled up with end marks. All sequences are numbered through, and a keyed
Feistel permutation maps the number of a sequence to its slot in the training order: rounds swap two halves of the
number's bits and add a keyed hash, and a result beyond the last slot is sent through again (cycle-walking), so slots
are a permutation of 0 .. N - 1 that needs no table and no sort.

Slots are cut into shards of equal numbers of sequences, and tasks into ranges of shards. A task sorts its sequences and
writes each shard as one file of 16-bit ids: sequence s stands at byte (s mod per_shard) * SEQUENCE * 2 of
file s div per_shard, so a reader starts at any slot and reads on. A file appears under its name only when it is
whole; a task that runs again writes the same bytes. Until then sequences travel compressed.

Defined results: a null or empty text is an end mark alone; null and repeated ids are documents of their own; an empty
table gives no file and an empty result; extra columns are not carried."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidewire.llm.common import mix
from tidewire.llm.tokens import END_OF_TEXT, encoder
from tidewire.session import materialize, shared_folder

SEQUENCE = 2048
PER_SHARD = 4096
FEISTEL_ROUNDS = 6
KEY = 20_240_229
BUNDLE = 128  # sequences that are compressed together before they part
LEVEL = 6
BROADCAST_BLOCKS = 1_000_000


def feistel(numbers: np.ndarray, n: int, key: int = KEY, rounds: int = FEISTEL_ROUNDS, back: bool = False) -> np.ndarray:
    """The slots of ``numbers`` (0 .. n - 1), or with ``back`` the numbers of slots."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, width = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9) % 2**64) for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> width, x & mask
        for k in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & mask)
        return (left << width) | right

    out = once(np.asarray(numbers).astype(np.uint64))
    while len(beyond := np.flatnonzero(out >= np.uint64(n))):
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def token_bundles(docs: DataFrame, length: int = SEQUENCE, text: str = "text") -> DataFrame:
    """``block, number, n, filled, frame``: ``n`` full sequences of 16-bit ids from ``number`` on, compressed; the last one ends
    with ``filled`` marks that stand for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode, pack = encoder(), zstandard.ZstdCompressor(level=LEVEL)
        block, number = TaskContext.get().partitionId(), 0

        def bundles(ids: np.ndarray, filled: int) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for i in range(0, len(ids), BUNDLE * length):
                part = ids[i:i + BUNDLE * length]
                n = len(part) // length
                last = filled if i + len(part) == len(ids) else 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([number], pa.int64()), pa.array([n], pa.int32()),
                     pa.array([last], pa.int32()), pa.array([pack.compress(part.tobytes())], pa.binary())],
                    ["block", "number", "n", "filled", "frame"])
                number += n

        held, n_held = [], 0
        for batch in batches:
            for value in batch.column(0):
                ids = encode(value.as_py() or "")
                ids.append(END_OF_TEXT)
                held.append(np.array(ids, "<u2"))
                n_held += len(ids)
                if n_held >= BUNDLE * length:
                    waiting = np.concatenate(held)
                    whole = n_held // (BUNDLE * length) * BUNDLE * length
                    yield from bundles(waiting[:whole], 0)
                    held, n_held = [waiting[whole:]], n_held - whole
        if n_held:
            filled = -n_held % length
            yield from bundles(np.concatenate([*held, np.full(filled, END_OF_TEXT, "<u2")]), filled)

    return docs.select(F.col(text).alias("text")).mapInArrow(
        run, "block int, number long, n int, filled int, frame binary")


def shard_file(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_in_order(numbered: DataFrame, n: int, folder: str, length: int = SEQUENCE, per_shard: int = PER_SHARD,
                   key: int = KEY) -> DataFrame:
    """Writes bundles (``ordinal`` of the first sequence, ``n, filled, frame``) and returns a row per sequence: ``slot,
    shard, position, ordinal, n_tokens, ids_crc32``. The shards are written while that table is computed."""
    shards = -(-n // per_shard)
    tasks = max(1, min(shards, int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for first, count, filled, frame in zip(*[column.to_pylist() for column in batch.columns]):
                data = unpack.decompress(frame, max_output_size=2 * length * count)
                parts = [data[i:i + 2 * length] for i in range(0, len(data), 2 * length)]
                ordinal, tokens = np.arange(first, first + count), np.full(count, length)
                tokens[-1] -= filled
                yield pa.RecordBatch.from_arrays(
                    [pa.array(feistel(ordinal, n, key)), pa.array(ordinal), pa.array(tokens),
                     pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array([pack.compress(p) for p in parts])],
                    ["slot", "ordinal", "n_tokens", "ids_crc32", "frame"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, (files, root) = zstandard.ZstdDecompressor(), _file_system(folder)
        files.create_dir(root, recursive=True)
        open_shard, stream, draft = None, None, ""

        def close() -> None:
            if stream is not None:
                stream.close()
                files.move(draft, f"{root}/{shard_file(open_shard)}")

        for batch in batches:
            shard = batch.column(0).to_numpy() // per_shard
            for i, frame in enumerate(batch.column(4)):
                if shard[i] != open_shard:
                    close()
                    open_shard = int(shard[i])
                    draft = f"{root}/.{shard_file(open_shard)}.{uuid.uuid4().hex}"
                    stream = files.open_output_stream(draft)
                stream.write(unpack.decompress(frame.as_py(), max_output_size=2 * length))
            slot = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shard.astype(np.int32)), pa.array(slot % per_shard), *batch.columns[1:4]],
                ["slot", "shard", "position", "ordinal", "n_tokens", "ids_crc32"])
        close()

    placed = numbered.select("ordinal", "n", "filled", "frame").mapInArrow(
        slots, "slot long, ordinal long, n_tokens long, ids_crc32 long, frame binary")
    # Slots are uniform, so ranges of shards need no sampling.
    task = F.floor(F.floor(F.col("slot") / per_shard) * tasks / max(1, shards)).cast("int")
    dealt = placed.repartitionById(tasks, task).sortWithinPartitions("slot")
    return dealt.mapInArrow(write, "slot long, shard int, position long, ordinal long, n_tokens long, ids_crc32 long")


def materialise_order(docs: DataFrame, folder: str | None = None, length: int = SEQUENCE, per_shard: int = PER_SHARD,
                      key: int = KEY, text: str = "text") -> tuple[DataFrame, str]:
    """Tokenises, numbers, permutes and writes; returns the table of sequences and the folder of the shards."""
    folder = folder or shared_folder(docs.sparkSession, "shards")
    cut = materialize(token_bundles(docs, length, text), "bundles")
    blocks = cut.groupBy("block").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("block", F.coalesce(before, F.lit(0)).alias("before"))  # a row per input split
    total, n_blocks = blocks.agg(F.sum("n"), F.count(F.lit(1))).first()
    if n_blocks <= BROADCAST_BLOCKS:
        offsets = F.broadcast(offsets)  # 12 bytes each
    numbered = cut.join(offsets, "block").withColumn("ordinal", F.col("before") + F.col("number"))
    return materialize(write_in_order(numbered, total or 0, folder, length, per_shard, key), "training-order"), folder


def read_sequences(folder: str, start: int, count: int, n: int, length: int = SEQUENCE,
                   per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """The ids of up to ``count`` sequences from slot ``start`` on; one seek per shard."""
    files, root = _file_system(folder)
    slot, end = start, min(start + count, n)
    while slot < end:
        here = min(end, (slot // per_shard + 1) * per_shard)
        with files.open_input_file(f"{root}/{shard_file(slot // per_shard)}") as file:
            file.seek(slot % per_shard * length * 2)
            for _ in range(here - slot):
                yield np.frombuffer(file.read(length * 2), "<u2")
        slot = here
