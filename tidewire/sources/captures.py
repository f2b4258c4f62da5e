"""Capture files as DataFrames.

A capture has no marks to split at, so a first pass walks the record headers of each
file and cuts it into byte ranges at record starts; a second pass reads the ranges,
spread over the cluster. Files are opened by the tasks; the driver lists none."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

# Magic numbers by byte order, with the units of a second in the fraction field.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1_000), b"\xa1\xb2\xc3\xd4": (">", 1_000),
          b"\x4d\x3c\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000)}
FILE_HEADER, RECORD_HEADER = 24, 16
ROWS_PER_BATCH = 5_000

SPLITS = "path string, start long, stop long, first long, endian string, per_ms long, link int"
FRAMES = "file string, idx long, ts_ms long, link_type int, frame binary"


def _open(path: str):
    if path.startswith("file:"):
        path = path[5:]
        path = "/" + path.lstrip("/")
        return fs.LocalFileSystem().open_input_file(path)
    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return fs.LocalFileSystem().open_input_file(path)


def _cut(split_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows = []
                with _open(path) as f:
                    size = f.size()
                    head = f.read(FILE_HEADER)
                    if len(head) < FILE_HEADER or head[:4] not in MAGICS:
                        raise ValueError(f"not a capture file: {path}")
                    endian, per_ms = MAGICS[head[:4]]
                    link = struct.unpack(endian + "I", head[20:24])[0]
                    at = start = FILE_HEADER
                    count = first = 0
                    window, window_at = b"", 0
                    while at + RECORD_HEADER <= size:
                        # Headers are taken from a read-ahead window; long payloads are skipped.
                        if not (window_at <= at and at + RECORD_HEADER <= window_at + len(window)):
                            f.seek(at)
                            window, window_at = f.read(1 << 20), at
                        kept = struct.unpack_from(endian + "I", window, at - window_at + 8)[0]
                        if at + RECORD_HEADER + kept > size:
                            break  # the capture was cut while it was written
                        at += RECORD_HEADER + kept
                        count += 1
                        if at - start >= split_bytes:
                            rows.append((path, start, at, first, endian, per_ms, link))
                            start, first = at, count
                    if at > start:
                        rows.append((path, start, at, first, endian, per_ms, link))
                yield pd.DataFrame(rows, columns=["path", "start", "stop", "first", "endian", "per_ms", "link"])
    return run


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for s in batch.itertuples(index=False):
            rows = []
            with _open(s.path) as f:
                f.seek(s.start)
                left, idx = s.stop - s.start, s.first
                while left > 0:
                    sec, frac, kept, _ = struct.unpack(s.endian + "IIII", f.read(RECORD_HEADER))
                    rows.append((s.path, idx, sec * 1000 + frac // s.per_ms, s.link, f.read(kept)))
                    left -= RECORD_HEADER + kept
                    idx += 1
                    if len(rows) >= ROWS_PER_BATCH:
                        yield pd.DataFrame(rows, columns=["file", "idx", "ts_ms", "link_type", "frame"])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["file", "idx", "ts_ms", "link_type", "frame"])


def read_captures(spark: SparkSession, path: str, split_bytes: int = 64 << 20, tasks: int | None = None) -> DataFrame:
    """Frames of one capture, a folder or a glob: ``file, idx, ts_ms, link_type, frame``."""
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap").load(path)
             .select("path").repartition(tasks))
    splits = files.mapInPandas(_cut(split_bytes), SPLITS).repartition(tasks)
    return splits.mapInPandas(_read, FRAMES)


def merge_captures(spark: SparkSession, path: str, **options) -> DataFrame:
    """All captures of a folder in one order of time, file and index."""
    return read_captures(spark, path, **options).orderBy("ts_ms", "file", "idx")


def write_capture_files(frames: DataFrame, path: str, file: str = "file") -> None:
    """Write frames as capture files ``<path>/<file>.pcap``, one per value of ``file``: makes test input.

    Runs in the tasks; ``path`` is a folder all executors see."""
    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        name = str(pdf[file].iloc[0])
        target = f"{path}/{name}.pcap"
        system, inner = (fs.FileSystem.from_uri(target) if "://" in target
                         else (fs.LocalFileSystem(), target.removeprefix("file:")))
        system.create_dir(inner.rsplit("/", 1)[0])
        with system.open_output_stream(inner) as f:
            f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
            for row in pdf.sort_values("packet_id").itertuples(index=False):
                sec, ms = divmod(int(row.ts_ms), 1000)
                f.write(struct.pack("<IIII", sec, ms * 1000, len(row.frame), len(row.frame)) + row.frame)
        return pd.DataFrame({"file": [name], "n": [len(pdf)]})

    written = frames.select(file, "packet_id", "ts_ms", "frame").groupBy(file).applyInPandas(
        write, "file string, n long")
    written.agg(F.sum("n")).first()
