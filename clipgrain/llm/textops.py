"""Vectorised byte, word and shingle kernels shared by the text operators.

Everything here works on one Arrow batch (or a slice of one) at a time, so the
memory that a task needs is bounded by ``CHUNK_BYTES`` plus its longest text.
Hashes are 64-bit and depend only on content and on the fixed seeds below, so
that every task and every retry gives the same values.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U64 = np.uint64

#: The six bytes that separate words: space and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_seed = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _seed.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RATIO = 0x9E3779B97F4A7C15
_RATIO_INV = pow(_RATIO, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: What modules keep for the life of a worker, by key.
KEPT: list[dict] = []


def let_go() -> None:
    """Give back what an operator of an earlier step keeps in this worker, which Spark uses again: a tokenizer and its words take 100 MB."""
    if any(KEPT):
        for kept in KEPT:
            kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not every C library has it
            trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (the splitmix64 one) over unsigned 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table is kept for the worker's life."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, U64(base & (2**64 - 1)))
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and each text's offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("" if pa.types.is_large_string(column.type) else b"", column.type))
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """(first, past) row ranges that hold at most ``limit`` bytes each, or one longer text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray, parting: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a slice, and the first word of each text (one more at the end); ``parting``: which bytes are no part of words."""
    word = ~parting[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner[1:] - 1] = word[inner[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Words up to this many bytes are hashed eight bytes at a time, longer ones by BLAKE2.
LANE_WORD = 64
_LANE_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as integers."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


def block_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: eight bytes at a time, with a non-linear step after each."""
    sizes, lanes = ends - starts, _lanes(data)
    h = mix64(sizes.astype(np.uint64) * U64(_RATIO))
    live, at = np.arange(len(starts)), 0
    while len(live):
        rest = sizes[live] - at
        h[live] = mix64((h[live] ^ (lanes[starts[live] + at] & _LANE_MASK[np.minimum(rest, 8)])) * U64(0xD6E8FEB86659FD93) + U64(at + 1))
        at += 8
        live = live[rest > 8]
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, of any length."""
    h = block_hashes(data, starts, np.minimum(ends, starts + LANE_WORD))
    for i in np.flatnonzero(ends - starts > LANE_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z lower-cased."""
    return span_hashes(_LOWER[data], starts, ends)


def equal_spans(one: np.ndarray, starts: np.ndarray, ends: np.ndarray, two: np.ndarray, starts_two: np.ndarray, ends_two: np.ndarray) -> np.ndarray:
    """Whether the spans of one array are byte for byte those of another."""
    sizes = ends - starts
    same, a, b = sizes == ends_two - starts_two, _lanes(one), _lanes(two)
    live, at = np.flatnonzero(same & (sizes <= LANE_WORD)), 0
    while len(live):
        rest = sizes[live] - at
        same[live] &= ((a[starts[live] + at] ^ b[starts_two[live] + at]) & _LANE_MASK[np.clip(rest, 0, 8)]) == 0
        at += 8
        live = live[rest > 8]
    for i in np.flatnonzero(same & (sizes > LANE_WORD)).tolist():
        same[i] = np.array_equal(one[starts[i] : ends[i]], two[starts_two[i] : ends_two[i]])
    return same


_STEP = (U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3), U64(0x589965CC75374CC3))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of n-word shingles.

    A text of fewer words gives its whole word sequence as one shingle; without words, none.
    """
    starts, ends, first = word_bounds(data, offsets)
    h = word_hashes(data, starts, ends)
    m = len(h) - n + 1
    if m > 0:
        runs = h[:m] * _STEP[0]
        for j in range(1, n):
            runs += mix64(h[j : m + j] + U64(j)) * _STEP[j % 5]
        runs = mix64(runs)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(runs[a : b - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for word in h[a:b]:
                short = mix64(short * _STEP[0] + word)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
