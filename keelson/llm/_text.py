"""Whole texts as arrays of bytes: words, lines and their hashes for many documents at once.

Texts come as Arrow arrays and are worked on as UTF-8. White space and A-Z are ASCII, so bytes give the same words as
characters. Work goes in blocks of about `BLOCK` bytes (a longer text is a block of its own), which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
U64 = np.uint64
#: Odd multipliers of 64 bits.
BASE, MIX_1, MIX_2, GOLD = U64(0x9E6C63D0876A9A47), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SPACE = byte_set(b" \t\n\x0b\x0c\r")
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    x = (x ^ (x >> U64(30))) * MIX_1
    x = (x ^ (x >> U64(27))) * MIX_2
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U64(pow(int(BASE), -1, 1 << 64))
    out = []
    for b in (BASE, inverse):
        p = np.full(n, b, U64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse, modulo 2**64."""
    return _powers_to(max(BLOCK + (BLOCK >> 2), 1 << max(0, int(n - 1).bit_length()) if n > BLOCK + (BLOCK >> 2) else 0))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Entry i: the polynomial hash of the first i bytes."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from starts to ends: equal for equal content, wherever it stands."""
    if not len(starts):
        return np.zeros(0, U64)
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts] + (ends - starts).astype(U64) * GOLD)


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and the offsets of each; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Block:
    """Some documents: first index, their bytes, and the offset of each (one more than documents)."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets, self.n = first, data, offsets, len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and the index of the first word of each document (one more than documents)."""
        inside = ~SPACE[self.data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        first = np.zeros(len(inside) + 1, bool)
        first[self.offsets] = True  # a word ends with its document
        starts = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the lines that are not empty; a line ends at a line feed."""
        if not len(self.data):
            return (np.zeros(0, np.int64),) * 3
        feeds = np.flatnonzero(self.data == 10)
        starts = np.unique(np.concatenate([self.offsets[:-1], feeds + 1]))
        starts = starts[starts < len(self.data)]
        ends = np.minimum(np.append(starts[1:], len(self.data)), len(self.data))
        ends = ends - ((ends > starts) & (self.data[np.maximum(ends - 1, 0)] == 10))
        full = ends > starts
        starts, ends = starts[full], ends[full]
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """For each document, how many of its bytes are flagged."""
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[self.offsets])


def blocks(texts: pa.Array, fold: bool = False, size: int | None = None) -> Iterator[Block]:
    """Blocks of whole documents of about `size` bytes, in order. fold: lower-case A-Z."""
    size = size or BLOCK
    data, offsets = as_bytes(texts)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        part = data[offsets[i] : offsets[j]]
        yield Block(i, FOLD[part] if fold else part, offsets[i : j + 1] - offsets[i])
        i = j


def shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on, as far as there are k."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i in range(k):
        out = mix(out * GOLD + word_hashes[i : i + n])
    return out
