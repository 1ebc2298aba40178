"""Words of UTF-8 texts and their 64-bit hashes, by whole arrays of bytes."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CHUNK = 1 << 20
_tables: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, _CHUNK + 1)
        _tables[:] = [np.cumprod(np.r_[_U(1), np.full(size - 1, _U(base))]) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _tables[0], _tables[1]


def spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of each word: a run of bytes other than 0x20 and 0x09-0x0D within one text."""
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.r_[False, word[:-1]] if len(word) else word
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.r_[word[1:], False] if len(word) else word
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, the same in any process."""
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        powers, inverse = _powers(high - low)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[data[low:high]] * powers[: high - low], out=total[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((total[b] - total[a]) * inverse[a])
        i = j
    return out


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _U(0xD1342543DE82EF95)
        out += words[j : j + n]
    return mix(out)


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` (minimum or maximum) of each ``width`` neighbours, in log2(width) steps."""
    if len(x) < width:
        return x[:0]
    size = 1
    while size * 2 <= width:
        x, size = op(x[:-size], x[size:]), size * 2
    return op(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def pack(x: np.ndarray) -> bytes:
    """Integers of 8 bytes as byte planes, which block compression shortens."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes, kind=np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=_U(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)
