"""Vectorised helpers on the UTF-8 bytes of whole texts, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WHITE = b" \t\n\r\x0b\x0c"
IS_WHITE = np.zeros(256, bool)
IS_WHITE[list(WHITE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Texts are hashed in blocks of this many bytes, so that long ones need bounded memory.
BLOCK = 1 << 18
#: Words of so many bytes or more are hashed by xxhash, shorter ones all at once.
LONG = 128
_BASE, _MASK = 0x9E3779B97F4A7C55, (1 << 64) - 1
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if len(_tables[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _tables[k] = np.multiply.accumulate(steps)
    return _tables[0], _tables[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that all of their bits depend on all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def blocks(body: bytes) -> Iterator[tuple[bytes, bool]]:
    """Parts that end at white space or the end; True marks a single word that fills a block or more."""
    i, n = 0, len(body)
    while i < n:
        j, long = min(n, i + BLOCK), False
        if j < n:
            k = max(body.rfind(bytes([c]), i, j) for c in WHITE)
            if k >= i:
                j = k + 1
            else:
                long = True
                j = min((x for c in WHITE if (x := body.find(bytes([c]), j)) >= 0), default=n)
        yield body[i:j], long
        i = j


def words(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of every word in order: a 64-bit hash of its bytes, and its last two bytes as one number."""
    hashes, tails = [], []
    for part, long in blocks(body):
        if long:
            hashes.append(np.array([xxhash.xxh64_intdigest(part)], np.uint64))
            tails.append(np.array([part[-2] * 256 + part[-1]], np.uint16))
            continue
        a = np.frombuffer(part, np.uint8)
        edge = np.empty(len(a) + 1, bool)
        white = IS_WHITE[a]
        edge[0], edge[-1] = not white[0], not white[-1]
        np.not_equal(white[1:], white[:-1], out=edge[1:-1])
        at = np.flatnonzero(edge)
        start, end = at[::2], at[1::2]
        power, inverse = _powers(len(a) + 1)
        upto = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a + np.uint64(1)) * power[: len(a)], out=upto[1:])
        own = mix((upto[end] - upto[start]) * inverse[start] + (end - start).astype(np.uint64))
        # sums of powers modulo 2^64 agree for some long words of two letters, so long words are digested one by one
        for i in np.flatnonzero(end - start >= LONG):
            own[i] = xxhash.xxh64_intdigest(part[start[i] : end[i]])
        hashes.append(own)
        first = np.where(end - start > 1, a[np.maximum(end, 2) - 2], 0).astype(np.uint16)
        tails.append(first * np.uint16(256) + a[end - 1])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.uint16)
    return (hashes[0], tails[0]) if len(hashes) == 1 else (np.concatenate(hashes), np.concatenate(tails))


def lower(body: bytes) -> bytes:
    """A-Z in lower case; all other bytes as they are."""
    return body.lower()


def shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of runs of k words; fewer words are one shingle, none give none."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    length = min(k, n)
    h = np.full(n - length + 1, length, np.uint64)
    for i in range(length):
        h = (h ^ word_hashes[i : n - length + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(28)
    return np.unique(mix(h))


def ngram_counts(body: bytes, table: np.ndarray, dim: int, longest: int = 3) -> np.ndarray:
    """Counts of hashed byte n-grams, n from 1 to longest, after mapping bytes by table."""
    counts = np.zeros(dim, np.int64)
    for i in range(0, len(body), BLOCK):
        a = table[np.frombuffer(body, np.uint8)[i : i + BLOCK + longest - 1]].astype(np.uint32)
        h = a * np.uint32(0x9E3779B1)
        for n in range(1, longest + 1):
            if n > 1:
                h = (h[:-1] ^ a[n - 1 :]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
            own = min(len(h), BLOCK)
            counts += np.bincount(((h[:own] * np.uint32(0xC2B2AE35)) >> np.uint32(8)) % np.uint32(dim), minlength=dim)
    return counts


def bodies(column: pa.Array) -> list[bytes | None]:
    """A text column's values as bytes."""
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 2 << 20, most_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batch in parts of so many bytes of text and rows at most (one row at least), so that Python never holds a whole batch."""
    texts = batch.column(column)
    upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most_bytes, side="right"))
        end = min(max(end, at + 1), at + most_rows)
        yield batch.slice(at, end - at)
        at = end
