"""Words, hashes and small helpers shared by the corpus operators.

A word is ``[^\\x20\\x09-\\x0D]+``. ``bytes.split()`` cuts at exactly these six characters, so every operator
that runs in Python splits the UTF-8 bytes of a text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
WORDS_AT_ONCE = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, so that others can have any name."""
    return docs.select(*columns)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values: equal in, equal out, on every machine."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(28)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Hasher:
    """64-bit hashes of words and of runs of words, a whole array at a time."""

    def __init__(self, seed: int = 0):
        grain = np.arange(256 + (1 << 16), dtype=np.uint64) + np.uint64(seed * 1_000_003 + 1)
        grain = mix(grain * np.uint64(0x9E3779B97F4A7C15))
        self.letter, self.place = grain[:256], grain[256:] | np.uint64(1)
        self.last = np.uint64(self.place.size - 1)

    def words(self, words: list[bytes]) -> np.ndarray:
        parts = [self._words(words[i:i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)

    def _words(self, words: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        at = (np.arange(letters.size, dtype=np.int64) - np.repeat(starts, lengths)).astype(np.uint64)
        grains = self.letter[letters] * self.place[at & self.last]
        if lengths.max(initial=0) > self.last:  # beyond the table the turn of the table counts too
            grains *= mix((at >> np.uint64(16)) + np.uint64(7)) | np.uint64(1)
        return mix(np.add.reduceat(grains, starts) + lengths.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    @staticmethod
    def runs(h: np.ndarray, k: int) -> np.ndarray:
        """Hash of each k consecutive ones of ``h``."""
        n = len(h) - k + 1
        if n < 1:
            return np.empty(0, np.uint64)
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[j:j + n]
            out ^= out >> np.uint64(29)
        return mix(out)

    def shingles(self, words: list[bytes], k: int) -> np.ndarray:
        """Distinct k-word shingles, sorted; fewer words count as one shingle, no word as none."""
        h = self.words(words)
        return np.unique(self.runs(h, k if len(h) >= k else max(1, len(h))))


def whole_groups(frames: Iterable[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Regroups sorted frames so that no group of ``key`` is cut; holds one frame and one group."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        at = frame[key].to_numpy()
        cut = int(np.searchsorted(at != at[-1], False)) if at[0] == at[-1] else int(np.flatnonzero(at != at[-1])[-1]) + 1
        if held and (cut or held[-1][key].iloc[-1] != at[-1]):
            whole = pd.concat([*held, frame.iloc[:cut]], ignore_index=True)
            held = []
            yield whole
        elif cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        held.append(frame.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
