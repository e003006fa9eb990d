"""Vectorised word and shingle hashing over the bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240531))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words without visible structure."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hash() gives the polynomial hash of any span of data."""
    up, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    big = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if big.null_count:
        big = big.fill_null(b"")
    if not len(big):
        return
    _, offs, data = big.buffers()
    offsets = np.frombuffer(offs, np.int64)[big.offset : big.offset + len(big) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < len(big):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        j = min(j, len(big))
        yield i, flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_hashes(flat: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of every text, and how many words each text has."""
    n = len(flat)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    word = ~_SPACE[flat]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = word[heads]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = word[tails]
    ends = np.flatnonzero(last) + 1
    hashes = span_hash(prefix_sums(LOWER[flat] if lower else flat), starts, ends)
    bounds = np.searchsorted(starts, offsets)
    return hashes, np.diff(bounds)


_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For every text the sorted distinct hashes of its runs of `width` lower-cased words; the whole sequence as one if it has fewer."""
    words, counts = word_hashes(flat, offsets)
    at = np.concatenate([[0], np.cumsum(counts)])
    if len(words) >= width:
        grams = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            grams = grams * _STEP + words[k : len(words) - width + 1 + k]
        grams = mix(grams)
    else:
        grams = np.empty(0, np.uint64)
    out = []
    for k, n in enumerate(counts):
        a = at[k]
        if n >= width:
            out.append(np.unique(grams[a : a + n - width + 1]))
        elif n:
            h = np.uint64(n)
            for w in words[a : a + n]:
                h = np.uint64((int(h) * int(_STEP) + int(w)) % 2**64)
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
