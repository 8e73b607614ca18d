"""Ragged rows of a block of texts as NumPy arrays: pieces of the bytes, told apart without a hash of our own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def coded_pieces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of the pieces data[starts[i]:starts[i + 1]] (the last one ends with the data), and each distinct piece once."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def distinct_pieces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    codes, pieces = coded_pieces(data, starts)
    return codes, pieces.to_pylist()


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, ... of all runs in a row."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each i; runs may be empty."""
    before = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return before[first[1:]] - before[first[:-1]]


class Tally:
    """Keys with counts; sorted parts are merged as they come, so the memory follows the distinct keys."""

    def __init__(self, merge_at: int = 1 << 18, kind: type = np.int64):
        self.kind, self.keys, self.counts = kind, np.empty(0, kind), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.merge_at = 0, merge_at

    def add(self, keys: np.ndarray) -> None:
        part = np.unique(keys, return_counts=True)
        self.waiting.append(part)
        self.size += len(part[0])
        if self.size > self.merge_at + len(self.keys):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(n for _, n in self.waiting)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        self.keys, self.counts = keys[at], np.add.reduceat(counts, at) if len(at) else counts
        self.waiting, self.size = [], 0

    def rows(self, name: str) -> pa.RecordBatch:
        """All keys and counts so far; the tally starts anew."""
        self.merge()
        out = pa.RecordBatch.from_arrays([pa.array(self.keys.view(np.int64)), pa.array(self.counts)], [name, "n"])
        self.__init__(self.merge_at, self.kind)
        return out
