"""Vectorised word kernels over Arrow string buffers (numpy, no per-word Python).

A batch of texts is one byte buffer with offsets.  ASCII white space separates
words, so word bounds come from a byte mask, and a word's 64-bit hash is a
polynomial in an odd base taken as a difference of two prefix sums, finished by
a bijective mixer.  Work is cut into pieces of about ``PIECE`` bytes, so memory
stays bounded for any batch and for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n + 1:
        size = max(n + 1, PIECE * 2)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good avalanche."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    off = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off.astype(np.int64)


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: (first, past, bytes, offsets from 0)."""
    buf, off = strings(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def _spans(data: np.ndarray, starts: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    solid = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[starts] = True
    cut[0] = cut[n] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:n]
    last[:-1] &= ~solid[1:] | cut[1:n]
    st, en = np.flatnonzero(first), np.flatnonzero(last) + 1
    return st, en, hash_spans(fold[data], st, en)


def hash_spans(data: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte span [st, en) of ``data``."""
    up, down = _power(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], out=total[1:])
    h = (total[en] - total[st]) * up[st]
    return mix(h + (en - st).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, off: np.ndarray, fold: np.ndarray = ASCII_LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, word offsets by text) of all words of a piece.

    A text larger than a few pieces is worked through in parts cut at white
    space, so the temporary arrays stay small.
    """
    if len(data) <= 4 * PIECE:
        st, en, h = _spans(data, off[:-1][off[:-1] < len(data)], fold) if len(data) else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    else:
        parts, at = [], 0
        while at < len(data):
            to = min(len(data), at + PIECE)
            if to < len(data):
                gaps = np.flatnonzero(SPACE[data[at:to]])
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
                else:  # one word longer than a piece: up to its end
                    while to < len(data) and not SPACE[data[to]]:
                        to += 1
            inner = off[(off >= at) & (off < to)] - at
            s, e, h = _spans(data[at:to], inner, fold)
            parts.append((s + at, e + at, h))
            at = to
        st, en, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return st, en, h, np.searchsorted(st, off)


def shingles(h: np.ndarray, wo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word windows by text; a shorter text is one window, an empty one none."""
    m = np.diff(wo)
    count = np.where(m >= k, m - k + 1, (m > 0).astype(m.dtype))
    so = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(int(so[-1]), np.uint64)
    if len(h) >= k:
        acc = mix(h[: len(h) - k + 1] + np.uint64(k))
        for j in range(1, k):
            acc = mix(acc * np.uint64(0x2545F4914F6CDD1D) + h[j : len(h) - k + 1 + j])
        doc = np.repeat(np.arange(len(m)), m)[: len(acc)]
        pos = np.arange(len(acc))
        good = pos + k <= wo[1:][doc]
        out[(pos - wo[:-1][doc] + so[:-1][doc])[good]] = acc[good]
    for d in np.flatnonzero((m > 0) & (m < k)):
        acc = np.array([int(m[d])], np.uint64)
        for x in h[wo[d] : wo[d + 1]]:
            acc = mix(acc * np.uint64(0x2545F4914F6CDD1D) + x)
        out[so[d]] = acc[0]
    return out, so


def by_text(so: np.ndarray) -> np.ndarray:
    """The text's index of every element, from offsets by text."""
    return np.repeat(np.arange(len(so) - 1), np.diff(so))


def sums(values: np.ndarray, so: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by text; 0 for an empty text."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[so[1:]] - total[so[:-1]]
