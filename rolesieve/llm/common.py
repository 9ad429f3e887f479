"""What the corpus operators share: tables, written intermediates, Arrow text slices, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

#: Bytes of text a task works on at a time; a longer text is worked on alone.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


class Texts:
    """UTF-8 bytes of some texts, one after the other, without copying; a null text is empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        self.valid = np.asarray(column.is_valid())
        self.offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2]
        first, last = int(self.offsets[0]), int(self.offsets[-1])
        self.data = np.frombuffer(data, np.uint8, last - first, first) if data is not None and last > first else np.empty(0, np.uint8)
        self.offsets = self.offsets - first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, lower: bool = False) -> "Words":
        return Words(self, lower)


class Words:
    """Maximal runs of bytes other than space and \\x09-\\x0D: where they are and a hash of each."""

    def __init__(self, texts: Texts, lower: bool = False):
        data, n = texts.data, len(texts.data)
        space = _SPACE[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[texts.offsets] = True
        word = ~space
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = True, space[:-1]
            after[-1], after[:-1] = True, space[1:]
        self.start = np.flatnonzero(word & (before | cut[:-1]))
        self.end = np.flatnonzero(word & (after | cut[1:])) + 1
        #: words of text i: first[i] to first[i + 1]
        self.first = np.searchsorted(self.start, texts.offsets)
        self._data = _LOWER[data] if lower else data

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64 bits per word."""
        n = len(self._data)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self._data] * up[:n], out=sums[1:])
        return mixed((sums[self.end] - sums[self.start]) * down[self.start])


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and the last run of each text before which they lie.

    Returns (hash of the run that starts at word i, for all i, and the number of runs of each text).
    A run that would leave its text is present in the array but never counted.
    """
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        weight = np.uint64((0xD1B54A32D192ED03 * (2 * k + 3)) % (1 << 64))
        out[: n - k] += mixed(hashes[k:] + np.uint64(k + 1)) * weight
    return mixed(out), np.maximum(np.diff(first) - size + 1, 0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut Arrow batches into slices of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(Texts(batch.column(column)).offsets)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            part = batch.slice(at, to - at)
            yield part, Texts(part.column(column))
            at = to


def record_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
