"""Vectorised text primitives shared by the operators: words, word hashes and n-gram hashes of Arrow batches.

A *slice* is a run of whole documents of about ``SLICE_BYTES`` bytes, so the working set of a task does not
depend on how many rows Spark puts in an Arrow batch.  One document longer than that is a slice of its own, whose
working set grows with it (about 60 bytes a byte of text).

Hashes of words and of runs of words are chained through a non-linear mixer in two lanes of 64 bits, so no family of
texts collides by algebra; a word is taken in whole, and a run of k words is made of its halves.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import MapType

from tessera.cluster import checkpointed, shared_dir  # noqa: F401  the operators take them from here

SLICE_BYTES, SLICE_DOCS = 1 << 20, 20_000
U = np.uint64
# Odd multipliers and starting states of the hashes; words of more bytes than this are digested one by one.
_LEFT, _LEFT2, _START, _START2, _LONG_WORD = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), 64
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The columns ``names[new] = old`` alone, found by exact name, so that clashing extra columns do no harm."""
    have, flat = df.columns, df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[flat[f"_{have.index(old)}"].alias(new) for new, old in names.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Gives freed memory of a worker back at the end of a task, where the C library can; workers outlive their tasks."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def row_key(doc_id: Column, text: Column) -> Column:
    """Identifies a row for joins back to its text: equal rows may share it, different texts of one id do not."""
    return F.xxhash64(doc_id, F.lit(1), text)


def row_keys(df: DataFrame) -> tuple[Column, Column]:
    """128 bits of hash over all columns of a row, by position and with nulls told apart; equal rows share them."""
    columns = [F.to_json(c) if isinstance(f.dataType, MapType) else c for f, c in ((f, F.col(f"`{f.name}`")) for f in df.schema)]
    every = [x for c in columns for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(1), *every), F.xxhash64(F.lit(2), *every)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_slices(column: pa.Array | pa.ChunkedArray, size: int | None = None):
    """(first row, last row + 1, bytes, offsets) of each slice, of ``size`` bytes if given; null texts are empty."""
    size = size or SLICE_BYTES
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = min(n, i + SLICE_DOCS, max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the documents of a slice.

    starts, ends: byte bounds of each word; first: of each document, its first word (one more entry than documents).
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.data, self.offs, self.n_docs = _LOWER[data] if lower else data, offs, len(offs) - 1
        space = np.ones(len(data) + 2, bool)
        space[1:-1] = _SPACE[data]
        word = ~space[1:-1]
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True  # a document ends where the next begins
        self.starts = np.flatnonzero(word & (space[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(word & (space[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)
        self._runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _lanes_of_words(self) -> tuple[np.ndarray, np.ndarray]:
        size = self.ends - self.starts
        padded = np.concatenate([self.data, np.zeros(16, np.uint8)])
        eight = np.ndarray(len(self.data) + 8, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        x, y = _START + size.astype(U), _START2 ^ size.astype(U)
        live = np.flatnonzero(size <= _LONG_WORD)
        for at in range(0, _LONG_WORD, 8):
            live = live[size[live] > at] if at else live
            if not len(live):
                break
            v = eight[self.starts[live] + at] & _MASK[np.minimum(size[live] - at, 8)]
            x[live] = mix(x[live] ^ v)
            y[live] = mix(y[live] * _LEFT + (v ^ x[live]))
        for i in np.flatnonzero(size > _LONG_WORD):
            x[i], y[i] = np.frombuffer(hashlib.blake2b(self.data[self.starts[i] : self.ends[i]].tobytes(), digest_size=16).digest(), "<u8")
        return x, y

    def lanes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the run of k words from each word on; runs that leave a document mean nothing."""
        if k not in self._runs:
            if k == 1:
                self._runs[k] = self._lanes_of_words()
            else:
                half = 1 << (k - 1).bit_length() - 1
                (a, a2), (b, b2) = self.lanes(half), self.lanes(k - half)
                n = max(0, len(self.starts) - k + 1)
                x = mix(a[:n] * _LEFT + b[half : half + n])
                self._runs[k] = x, mix((a2[:n] ^ x) * _LEFT2 + b2[half : half + n])
        return self._runs[k]

    def runs(self, k: int) -> np.ndarray:
        """One 64-bit hash of the run of k words from each word on."""
        x, y = self.lanes(k)
        return x ^ y

    @property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return self.runs(1)

    def inside(self, k: int) -> np.ndarray:
        """The first words of the runs of k words inside one document."""
        n = len(self.starts)
        return np.flatnonzero(np.arange(k, n + k) <= self.first[1:][self.doc]) if n else np.zeros(0, np.int64)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of k words inside one document."""
        at = self.inside(k)
        return at, self.runs(k)[at]

    def shingles(self, k: int) -> list[np.ndarray]:
        """Of each document, the sorted hashes of its distinct k-word shingles; a shorter one is a single shingle."""
        at, h = self.grams(k)
        cut = np.searchsorted(at, self.first)
        whole = {}
        for size in range(1, k):
            short = np.flatnonzero(self.counts == size)
            if len(short):
                whole |= zip(short.tolist(), self.runs(size)[self.first[short]])
        return [np.array([whole[d]], U) if d in whole else np.unique(h[cut[d] : cut[d + 1]]) for d in range(self.n_docs)]
