"""Vectorised word and byte helpers used inside Arrow batches.

Everything here works on one Arrow batch at a time (numpy over the batch's
UTF-8 buffer); Spark partitions and shuffles the work.  A word is a run of
bytes outside ``[\\x20\\x09-\\x0D]``.  Hashes are 64-bit polynomial prefix
hashes finished with a splitmix step; they depend on the bytes only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20  # bytes hashed at a time; a longer single word makes its own block


def _byte_codes() -> np.ndarray:
    """One odd 64-bit code per byte value (splitmix64 of the value)."""
    return mix(np.arange(1, 257, dtype=np.uint64)) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_CODES = _byte_codes()
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (the common size is kept)."""
    size = max(_BLOCK, n)
    if size not in _POW:
        out = []
        with np.errstate(over="ignore"):
            for base in (_BASE, _INV):
                a = np.full(size, base, dtype=np.uint64)
                a[0] = 1
                out.append(np.multiply.accumulate(a))
        if size > _BLOCK:
            return out[0], out[1]
        _POW[size] = (out[0], out[1])
    return _POW[size]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first run index of each document; one longer than documents)
    of the maximal runs of marked bytes; runs end with their document."""
    prev = np.zeros(len(inside), bool)
    prev[1:] = inside[:-1]
    inner = off[(off > 0) & (off < len(inside))]
    prev[inner] = False
    starts = np.flatnonzero(inside & ~prev)
    nxt = np.zeros(len(inside), bool)
    nxt[:-1] = inside[1:]
    nxt[inner - 1] = False
    ends = np.flatnonzero(inside & ~nxt) + 1
    return starts, ends, np.searchsorted(starts, off)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes outside [\\x20\\x09-\\x0D]."""
    return runs(~((buf == 32) | ((buf >= 9) & (buf <= 13))), off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            lo = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, lo + _BLOCK, side="right")))
            hi = ends[j - 1]
            pw, inv = powers(hi - lo)
            pre = np.empty(hi - lo + 1, dtype=np.uint64)
            pre[0] = 0
            np.cumsum(_CODES[buf[lo:hi]] * pw[:hi - lo], out=pre[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (pre[e] - pre[s]) * inv[s]
            i = j
    return mix(out ^ (ends - starts).astype(np.uint64))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive entries of h (length len(h) - n + 1)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    with np.errstate(over="ignore"):
        acc = np.zeros(m, dtype=np.uint64)
        for k in range(n):
            acc = acc * _U(_BASE) + h[k:k + m]
    return mix(acc)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Like gram_hashes, by prefix sums: cost does not depend on n."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    with np.errstate(over="ignore"):
        if len(h) <= _BLOCK:
            pw, inv = powers(len(h))
            pre = np.zeros(len(h) + 1, dtype=np.uint64)
            np.cumsum(h * pw[:len(h)], out=pre[1:])
            return mix((pre[n:] - pre[:m]) * inv[:m])
        step = _BLOCK - n
        return np.concatenate([window_hashes(h[i:i + step + n - 1], n) for i in range(0, m, step)])


def covered(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [lo, hi) covered by windows of one width at sorted starts."""
    if len(starts) == 0:
        e = np.zeros(0, np.int64)
        return e, e
    cut = np.flatnonzero(np.diff(starts) > width)
    return starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + width


def chunks(offsets: np.ndarray, limit: int):
    """Row ranges of a batch holding about `limit` bytes each (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j
