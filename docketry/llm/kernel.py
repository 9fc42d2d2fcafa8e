"""Vectorised hashing of words and shingles over Arrow string buffers.

Everything works on the UTF-8 bytes of a block of texts at once. A word's hash is a polynomial over a random byte table
(modulo 2**64, by prefix sums), then mixed; hashes of distinct words collide with a chance near 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_OTHER = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_MULT = _RNG.integers(1, 2**62, 64, dtype=np.int64).astype(U) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS = [np.ones(1, U), np.ones(1, U)]
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
BLOCK = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser; the input is overwritten."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(max(n, BLOCK), base, U)
            row[0] = 1
            _POWERS[k] = np.multiply.accumulate(row)
    return _POWERS[0], _POWERS[1]


def blocks(column, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive runs of whole texts, about ``size`` bytes each; nulls are empty texts."""
    text = pc.fill_null(pc.cast(column, pa.large_string()), "")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    n = len(text)
    if not n:
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def prefix(data: np.ndarray, other: bool = False) -> np.ndarray:
    """Sums s with (s[b]-s[a]) * inverse_power[a] the polynomial hash of bytes a..b; ``other``: over a second byte table."""
    power, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((_OTHER if other else _BYTE)[data] * power[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inverse = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


def word_spans(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray = _SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, or of runs of other ``solid`` bytes, and each text's first word (one more than texts)."""
    solid = solid[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge], after[edge - 1] = False, False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a block, and each text's first word."""
    starts, ends, first = word_spans(data, offsets)
    return span_hash(prefix(LOWERED[data]), starts, ends), first


def combine(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k consecutive hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out += hashes[j : j + n] * _MULT[j]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text, end to end, and their bounds.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    hashes, first = word_hashes(data, offsets)
    runs, parts, sizes = combine(hashes, k), [], []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            part = runs[a : b - k + 1].copy()
            part.sort()
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        elif b > a:
            part = mix(np.array([(hashes[a:b] * _MULT[8 : 8 + b - a]).sum(dtype=U)], U))
        else:
            part = runs[:0]
        parts.append(part)
        sizes.append(len(part))
    return np.concatenate(parts) if parts else runs[:0], np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))
