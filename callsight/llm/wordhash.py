"""Words of many texts at once: their places in one byte buffer and 64-bit hashes, in numpy.

A word is a run of bytes other than the six ASCII white-space ones (0x20 and 0x09 to 0x0D). The hash of a word is a
polynomial over its bytes modulo 2**64, read off the prefix sums of the whole buffer and then mixed; grams are polynomials
over the words' hashes, mixed again.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Texts are taken together up to so many bytes; a longer text is taken alone.
BLOCK = 1 << 20

_RADIX = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the radix and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_RADIX, pow(_RADIX, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    out = _powers[0][:n], _powers[1][:n]
    if n > 2 * BLOCK:  # of one very long text: not kept
        _powers[:] = [p[: 1 << 16].copy() for p in _powers]
    return out


class Words:
    """Places and hashes of the words of ``texts`` (UTF-8 bytes); ``space`` says of each byte whether it parts words, as a line feed must."""

    def __init__(self, texts: list[bytes], space: np.ndarray = SPACE):
        self.raw = b"\n".join(texts)
        self.bytes = np.frombuffer(self.raw, dtype=np.uint8)
        inside = np.zeros(len(self.bytes) + 2, dtype=np.int8)
        inside[1:-1] = ~space[self.bytes]
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.text_at = np.concatenate([[0], np.cumsum(lengths + 1)])  # where each text begins
        self.first = np.searchsorted(self.starts, self.text_at)  # each text's first word, and the number of words at last
        self.counts = np.diff(self.first)

    def texts_of(self) -> np.ndarray:
        """Per word, the number of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        n = len(self.bytes)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.bytes] * up[:n], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def per_text(self, of_words: np.ndarray) -> np.ndarray:
        """Sums over each text's words."""
        sums = np.concatenate([[0], np.cumsum(of_words)])
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def windows(self, n: int) -> np.ndarray:
        """Per word, whether n words of its text start there."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))
        return left >= n


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places have none."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, dtype=np.uint64)
    for i in range(n):
        out *= np.uint64(_RADIX)
        out += words[i : i + count]
    return mix(out)


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie within n of one of the different ``starts``."""
    step = np.zeros(size + n + 1, dtype=np.int32)
    step[starts] += 1
    step[starts + n] -= 1
    return np.cumsum(step[:size]) > 0


@cache
def returned_arrays() -> None:
    """Has the C library give freed arrays back to the system at once: a Python worker lives through many tasks, and would keep the
    largest task's memory. Where there is no such setting, nothing is set."""
    try:
        ctypes.CDLL(None).mallopt(-3, 256 << 10)  # M_MMAP_THRESHOLD of glibc; set, it no longer grows
    except (OSError, AttributeError):
        pass


def column_blocks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first row, texts as UTF-8) of at most BLOCK bytes, or of one text; null is an empty text. Only one block is unpacked at a time."""
    returned_arrays()
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    first, done = 0, 0
    while first < len(ends):
        stop = max(first + 1, int(np.searchsorted(ends, done + BLOCK, side="right")))
        yield first, [t or b"" for t in column.slice(first, stop - first).cast(pa.binary()).to_pylist()]
        first, done = stop, int(ends[stop - 1])


def blocks(texts: list[bytes], most: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts) of at most so many bytes, or of one text."""
    returned_arrays()
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]
