"""Vectorised word hashing over Arrow text columns.

Words are read eight bytes at a time and mixed under a key, as keyed 64-bit
hashes do, all words of a block at once; words of more than ``LONG`` bytes go
through blake2b.  A second lane under a key of its own makes 128 bits.  One
lane chooses candidates; what is equal is decided by bytes or by both lanes.
Prefix sums of a polynomial modulo 2**64 (``gram_values``) only choose where
strings are anchored: such sums collide on patterns that are easy to build.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_STEP = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_STEP, -1, 2**64)
#: Bytes of text that are hashed at once; a longer document is a block of its own.
BLOCK_BYTES = 500_000
#: Powers that a worker keeps; longer runs compute their own and drop them.
KEPT_POWERS = 2_000_256

_CASED = np.random.default_rng(20240502).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Words of more bytes are hashed one by one.
LONG = 64
_KEYS = np.random.default_rng(20241102).integers(1, 2**63, (2, 4), dtype=np.uint64) * U64(2) + U64(1)
_MASKS = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] = np.arange(97, 123)
_PLACE = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)

#: Bytes that belong to words: all but ASCII white space.
BY_SPACE = np.ones(256, bool)
BY_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes that belong to words: ASCII digits and letters, and all of a non-ASCII character.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[65:91] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True

_powers: dict[str, np.ndarray] = {}


def _series(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the step and of its inverse."""
    if n > KEPT_POWERS:
        return _series(_STEP, n), _series(_INVERSE, n)
    if not _powers or len(_powers["p"]) < n:
        size = min(KEPT_POWERS, max(n, BLOCK_BYTES + 1))
        _powers.update(p=_series(_STEP, size), q=_series(_INVERSE, size))
    return _powers["p"], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche finish: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes, at least one document each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """Words of the documents of a block: spans, hashes and the document of each."""

    __slots__ = ("start", "end", "doc", "hash", "hash2", "first")

    def __init__(self, offsets: np.ndarray, data: np.ndarray, alphabet: np.ndarray, fold: bool = True, lanes: int = 1):
        """offsets: len n+1, from 0; data: the block's bytes.  ``hash2`` is there with two lanes."""
        self.start, self.end = _runs_of(alphabet[data], offsets[1:-1])
        self.first = np.searchsorted(self.start, offsets)  # of each document, and the end
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        got = _word_hashes(_FOLDED[data] if fold else data, self.start, self.end, lanes)
        self.hash, self.hash2 = got[0], got[-1] if lanes > 1 else None


def _runs_of(inside: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of word bytes; ``edge``: inner places where documents end."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = edge[(edge > 0) & (edge < len(inside))]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[edge] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lanes: int) -> list[np.ndarray]:
    """One 64-bit hash a lane of each span: eight bytes a round, each under the key and the length."""
    length = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    keys = _KEYS[:lanes]
    out = [mix(length.astype(np.uint64) * k[0] + k[1]) for k in keys]
    live, done = np.flatnonzero(length <= LONG), 0
    while len(live):
        chunk = eight[start[live] + done] & _MASKS[np.minimum(length[live] - done, 8)]
        for h, k in zip(out, keys, strict=True):
            h[live] = mix((h[live] + k[2]) ^ mix(chunk * k[3] + k[1]))
        done += 8
        live = live[length[live] > done]
    long_ = np.flatnonzero(length > LONG)
    for i, a, b in zip(long_.tolist(), start[long_].tolist(), end[long_].tolist(), strict=True):
        digest = np.frombuffer(hashlib.blake2b(data[a:b], digest_size=16).digest(), "<u8")
        for h, x in zip(out, digest, strict=False):
            h[i] = x
    return out


def gram_values(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit value of the ``width`` bytes from each place; equal strings have equal values, and a few unequal ones as well."""
    n = len(data)
    p, q = _power(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_CASED[data] * p[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * q[: n - width + 1])


def word_blocks(column: pa.Array, alphabet: np.ndarray, fold: bool = True, lanes: int = 1) -> Iterator[tuple[int, int, np.ndarray, Words]]:
    """(first document, last, bytes, words) of each block of a column."""
    offsets, data = text_buffers(column)
    for a, b in blocks(offsets):
        own = data[offsets[a] : offsets[b]]
        yield a, b, own, Words(offsets[a : b + 1] - offsets[a], own, alphabet, fold, lanes)


def shingle_hashes(words: Words, width: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of ``width`` words; shorter texts give their whole sequence once."""
    h, counts = (words.hash2 if lane else words.hash), np.diff(words.first)
    m = len(h) - width + 1
    docs, out = [], []
    if m > 0:
        acc = np.zeros(m, np.uint64)
        for k in range(width):
            acc += mix(h[k : k + m] ^ _PLACE[k]) * _PLACE[width + k]
        whole = words.doc[:m] == words.doc[width - 1 :]
        docs.append(words.doc[:m][whole])
        out.append(mix(acc[whole]))
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        # a sequence of n < width words hashes with n, so it equals no full run
        acc = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            at = words.first[short[has]] + k
            acc[has] += mix(h[at] ^ _PLACE[k]) * _PLACE[width + k]
        docs.append(short)
        out.append(mix(acc ^ _PLACE[63 - counts[short]]))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(out)


def hash_of(text: str, fold: bool = True) -> np.uint64:
    """The hash that ``Words`` gives this word."""
    data = np.frombuffer(text.encode(), np.uint8)
    every = np.ones(256, bool)
    return Words(np.array([0, len(data)]), data, every, fold).hash[0]
