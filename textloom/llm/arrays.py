"""Texts as flat NumPy arrays: words, their hashes, shingles, one block of texts at a time.

Spark splits the rows over tasks; a task sees Arrow batches, cuts them into blocks of
a megabyte of text, and works on each block as one byte array, so that no Python
code runs for each word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BLOCK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
GIVE_BACK_BYTES = 16 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
SEGMENT = 1 << 18

# ASCII white space of the contracts, and lower case for A-Z only.
SPACES = bytes([9, 10, 11, 12, 13, 32])
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def byte_mask(values: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(values)] = True
    return mask


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def small_batches(spark: SparkSession) -> None:
    """From now on texts go to Python in Arrow batches of some BATCH_BYTES, unless the session has a limit of its own.

    Spark's default of 64 MB is held several times in a task, by the JVM as buffers that double, and by Python.
    """
    if BATCH_LIMIT not in spark.conf.getAll:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)


def give_back() -> None:
    """Returns memory that is free to the system: workers outlive their tasks, and the next step needs it elsewhere."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def text_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``size`` bytes of text (one row at least), null texts as empty.

    What batches leave free goes back to the system.
    """
    passed = 0
    for batch in batches:
        column = batch.column(batch.schema.names.index(text))
        ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        start, before = 0, 0
        while start < len(column):
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            part = batch.slice(start, stop - start)
            yield part, [t or b"" for t in column.slice(start, stop - start).to_pylist()]
            start, before = stop, int(ends[stop - 1])
        passed += before
        batch = column = part = None
        if passed >= GIVE_BACK_BYTES:
            give_back()
            passed = 0
    give_back()


class Words:
    """The words of a block of texts.

    ``data``: all bytes, a separator after each text; ``starts``, ``ends``: of the words;
    ``first``: of each text its first word, with the number of words at the end.
    """

    def __init__(self, texts: list[bytes], fold: bytes | None = LOWER, separators: np.ndarray | None = None):
        separators = byte_mask(SPACES) if separators is None else separators
        raw = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(raw.translate(fold) if fold else raw, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_ends = np.cumsum(lengths)
        gap = separators[self.data]
        edges = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.concatenate(([0], np.searchsorted(self.starts, self.text_ends)))

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.text_ends)), self.counts)


class Hasher:
    """64-bit hashes of substrings of a block, by prefix sums of a polynomial in an odd base."""

    def __init__(self):
        base = np.full(SEGMENT, BASE, np.uint64)
        base[0] = 1
        self.powers = np.multiply.accumulate(base)
        back = np.full(SEGMENT, pow(BASE, -1, 1 << 64), np.uint64)
        back[0] = 1
        self.inverse = np.multiply.accumulate(back)

    def hash(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of data[starts:ends]; starts and ends both ascend."""
        low, high = self._sums(data, starts), self._sums(data, ends)
        segments, shift = int(len(data) // SEGMENT) + 1, pow(BASE, -SEGMENT, 1 << 64)
        steps = [1]
        for _ in range(segments):
            steps.append(steps[-1] * shift & MASK)
        scale = self.inverse[starts % SEGMENT] * np.array(steps, np.uint64)[starts // SEGMENT]
        return mix((high - low) * scale + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def _sums(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sum of all terms before each place."""
        out = np.empty(len(at), np.uint64)
        before, scale = 0, 1
        for low in range(0, len(data) + 1, SEGMENT):
            part = data[low : low + SEGMENT].astype(np.uint64)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * self.powers[: len(part)])))
            a, b = np.searchsorted(at, (low, low + SEGMENT))
            out[a:b] = np.uint64(before) + np.uint64(scale) * sums[at[a:b] - low]
            before = (before + scale * int(sums[-1])) & MASK
            scale = scale * pow(BASE, SEGMENT, 1 << 64) & MASK
        return out

    def words(self, words: Words) -> np.ndarray:
        return self.hash(words.data, words.starts, words.ends)


def chains(hashes: np.ndarray, width: int, gap: int = 1) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words (``gap``: take each gap-th word)."""
    n = len(hashes) - (width - 1) * gap
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(n, np.uint64(width * 31 + gap), np.uint64)
    for j in range(width):
        acc = (acc ^ hashes[j * gap : j * gap + n]) * np.uint64(BASE)
        acc ^= acc >> np.uint64(29)
    return mix(acc)


def shingle_sets(words: Words, hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text its distinct shingles, ascending; a text of fewer words is one shingle, no words none."""
    runs = chains(hashes, width)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= width:
            s = np.sort(runs[a : b - width + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(chains(hashes[a:b], int(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
