"""Words of Arrow text batches, by numpy over the texts' UTF-8 bytes.

Small helper for the operators that run inside Arrow batches: no string object is made
for a word. A word's hash is 64 bits of the sum of its bytes' random values times
powers of an odd number, modulo 2^64, mixed with its length.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts worked on together; a longer text is worked on alone
_ODD = 0x9E3779B97F4A7C15
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_VALUES = mix64((np.arange(1, 257, dtype=np.uint64) * _U(_ODD)))


def _byte_set(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: A-Z to a-z; other bytes as they are.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
NOT_SPACE = ~_byte_set(b" \t\n\x0b\x0c\r")
#: ASCII letters, and all bytes of characters beyond ASCII.
LETTER = _byte_set(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES)
        inverse = pow(_ODD, -1, 1 << 64)
        for name, base in (("up", _ODD), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"]


@dataclass
class Texts:
    """Consecutive texts of a batch. offsets: of each text in data, and the end."""
    data: np.ndarray
    offsets: np.ndarray
    first: int  # the first text's row in the batch

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends in data of the runs of member bytes, and each one's text."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, none
        inside = members[self.data]
        edges = np.zeros(len(self.data), bool)
        edges[self.offsets[:-1][self.offsets[:-1] < len(self.data)]] = True
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        starts = np.flatnonzero(inside & (~before | edges))
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        next_edge = np.zeros(len(self.data), bool)
        next_edge[:-1] = edges[1:]
        ends = np.flatnonzero(inside & (~after | next_edge)) + 1
        text = np.searchsorted(self.offsets, starts, side="right") - 1
        return starts, ends, text

    def hasher(self, fold: np.ndarray = ASCII_LOWER):
        """A function from starts and ends to 64-bit hashes of data[start:end] after fold."""
        up, down = _powers(max(1, len(self.data)))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[fold[self.data]] * up[:len(self.data)], out=sums[1:])

        def of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
            if not len(starts):
                return np.zeros(0, np.uint64)
            return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        return of

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = ASCII_LOWER) -> np.ndarray:
        return self.hasher(fold)(starts, ends)


def chunks(column: pa.Array) -> Iterator[Texts]:
    """The texts of a batch in pieces of about CHUNK_BYTES. Null counts as empty."""
    column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield Texts(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], at)
        at = to


def code_points(data: np.ndarray) -> np.ndarray:
    """Characters before each byte, and in all: the place of a byte offset in code points."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from the values of all rows and the number of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
