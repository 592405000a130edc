"""Pieces that the training-data operators share: words, hashes, and tables written in the shared folder."""

from __future__ import annotations

import ctypes

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..sinks.tables import discard, release, written  # noqa: F401

#: The white space that separates words, as code points and as a regular expression class.
WHITE = " \t\n\x0b\x0c\r"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table. One that is read in fewer partitions than half the cores is a small one, and is dealt to all of them."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() < cores else rows


def trimmed() -> None:
    """Give freed memory back to the system where its allocator can: a worker serves many tasks, and what one needed the next may not."""
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def low_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at WHITE: bytes.lower() and bytes.split() touch ASCII only."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if text else []


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit mixer over uint64 arrays."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Codes(dict):
    """word -> its number, given at first sight; `new` lists words that await what belongs to them."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most, self.new = most, []

    def __missing__(self, word):
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def full(self) -> bool:
        """Whether it holds so many words that it starts anew; then so must what belongs to them."""
        if len(self) <= self.most:
            return False
        self.clear()
        self.new = []
        return True

    def take(self) -> list:
        new, self.new = self.new, []
        return new


def byte_symbols() -> dict[str, int]:
    """The printable symbol that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def word_hashes(new: list[bytes]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(w) for w in new]


def shingles(word_hash: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the width-word windows; fewer words make one window of all of them."""
    n = len(word_hash)
    if not n:
        return word_hash
    take = min(n, width)
    out = np.full(n - take + 1, take, dtype=np.uint64)
    for k in range(take):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + word_hash[k : n - take + 1 + k], 0x5851F42D4C957F2D)
    return np.unique(out)
