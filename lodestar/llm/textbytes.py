"""Vectorised word splitting and hashing over the UTF-8 bytes of Arrow strings.

Word patterns here are byte classes: every byte of a non-ASCII character is 0x80
or above, so a class that holds all non-ASCII characters can be tested byte by
byte.  All functions work on chunks of bounded size, so that memory depends on
the chunk (or the longest single text), never on the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20


def _byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: digits, a-z and everything that is not ASCII (texts are lower-cased first)
LOWER_WORD = _byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: everything but space and the controls 0x09-0x0D
NON_SPACE = ~_byte_class((0x20, 0x20), (0x09, 0x0D))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n; kept for texts of a chunk's usual size."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        filled = 1
        while filled < size:
            step = np.uint64(pow(base, filled, 1 << 64))
            upto = min(2 * filled, size)
            have[filled:upto] = have[: upto - filled] * step
            filled = upto
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    """Some texts: their bytes, and where each begins (one offset more than texts)."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> Texts:
        return Texts(_LOWER[self.data], self.offsets)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts_of(column: pa.Array) -> Texts:
    """The texts of an Arrow string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
        column = pc.fill_null(column, b"") if column.null_count else column
    else:
        column = column.cast(pa.large_string())
        column = pc.fill_null(column, "") if column.null_count else column
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return Texts(raw[ends[0] : ends[-1]], ends - ends[0])


def chunks(texts: Texts, limit: int = CHUNK_BYTES, most: int = 1 << 20) -> Iterator[tuple[int, Texts]]:
    """(index of the first text, texts) for runs of at most ``most`` texts of about ``limit`` bytes."""
    at = 0
    while at < len(texts):
        base = texts.offsets[at]
        to = max(at + 1, int(np.searchsorted(texts.offsets, base + limit, side="right")) - 1)
        to = min(to, at + most)
        yield at, Texts(texts.data[base : texts.offsets[to]], texts.offsets[at : to + 1] - base)
        at = to


@dataclass
class Words:
    """Words of several texts: byte extents, and where each text's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split(texts: Texts, table: np.ndarray) -> Words:
    n = len(texts.data)
    if not n:
        return Words(np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64))
    inside = table[texts.data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    cuts = texts.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(opens)
    return Words(starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, texts.offsets))


def byte_sums(texts: Texts) -> np.ndarray:
    """Prefix sums from which ``span_hash`` hashes any byte range."""
    sums = np.empty(len(texts.data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_CODES[texts.data] * powers(len(texts.data), _BASE), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes hash alike wherever they stand."""
    inverse = powers(len(sums), _BASE_INV)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def hash_words(texts: Texts, words: Words) -> np.ndarray:
    """The words' hashes; a very long text is gone through in segments, so that no
    array of eight bytes per byte has to be made of it."""
    if len(texts.data) <= 4 * CHUNK_BYTES:
        return span_hash(byte_sums(texts), words.starts, words.ends)
    out = np.empty(len(words.starts), dtype=np.uint64)
    at = 0
    while at < len(out):
        base = words.starts[at]
        to = max(at + 1, int(np.searchsorted(words.ends, base + CHUNK_BYTES, side="right")))
        part = Texts(texts.data[base : words.ends[to - 1]], np.array([0, words.ends[to - 1] - base]))
        out[at:to] = span_hash(byte_sums(part), words.starts[at:to] - base, words.ends[at:to] - base)
        at = to
    return out


def text_hashes(texts: Texts) -> np.ndarray:
    """A hash of each whole text."""
    if len(texts.data) <= 4 * CHUNK_BYTES:
        return span_hash(byte_sums(texts), texts.offsets[:-1], texts.offsets[1:])
    out = np.empty(len(texts), dtype=np.uint64)
    for i, (low, high) in enumerate(zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True)):
        total = 0
        for at in range(low, high, CHUNK_BYTES):
            part = texts.data[at : min(high, at + CHUNK_BYTES)]
            inner = int((_BYTE_CODES[part] * powers(len(part), _BASE)).sum(dtype=np.uint64))
            total = (total + inner * pow(_BASE, at - low, 1 << 64)) & (2**64 - 1)
        out[i] = mix(np.array([(total + high - low) & (2**64 - 1)], dtype=np.uint64))[0]
    return out


def sequence_sums(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums over a sequence of symbol hashes, for ``run_hash``."""
    sums = np.empty(len(hashes) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(hashes * powers(len(hashes), _BASE), out=sums[1:])
    return sums


def run_hash(sums: np.ndarray, starts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """64-bit hashes of runs of symbols, from ``starts`` on."""
    inverse = powers(len(sums), _BASE_INV)
    return mix((sums[starts + length] - sums[starts]) * inverse[starts])


def shingle_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and owners of the ``width``-word shingles of each text.

    A text of fewer words (but at least one) has one shingle of all of them.
    """
    counts = np.diff(first)
    per = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    owner = np.repeat(np.arange(len(counts)), per)
    begins = np.concatenate([[0], np.cumsum(per)])
    starts = np.arange(begins[-1]) - np.repeat(begins[:-1], per) + np.repeat(first[:-1], per)
    return starts, np.minimum(counts, width)[owner], owner
