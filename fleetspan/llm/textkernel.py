"""Words and shingles of Arrow string batches as 64-bit hashes, in vector form.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, after A-Z are lower-cased. A word's hash is a polynomial in
its bytes (mod 2^64) that is then mixed; a shingle's hash is a weighted sum of its words' hashes, mixed again.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa

P = 0x9E3779B97F4A7C15 | 1
P_INV = pow(P, -1, 1 << 64)
WEIGHTS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)
#: Bytes handled at once; temporaries take some 40 bytes each.
SLICE = 1 << 19


def _kept() -> dict:
    """Tables that a worker keeps between tasks; in a module of their own, as globals of this one travel with each task."""
    return vars(sys.modules.setdefault("_fleetspan_kept", types.ModuleType("_fleetspan_kept")))


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing permutation of SplitMix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    kept, key = _kept(), f"powers{base}"
    have = kept.get(key)
    if have is None or len(have) < n:
        a = np.full(1 << max(16, int(n).bit_length()), base, dtype=np.uint64)
        a[0] = 1
        have = kept[key] = np.cumprod(a, dtype=np.uint64)
    return have[:n]


def _tables():
    kept = _kept()
    if "value" not in kept:
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        space = np.zeros(256, dtype=bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        kept["space"] = space
        kept["value"] = mix(lower.astype(np.uint64) + np.uint64(0x1234567))
    return kept["space"], kept["value"]


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes; null counts as empty."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = col.fill_null("")
    offs = np.frombuffer(col.buffers()[1], dtype=kind, count=len(col) + col.offset + 1)[col.offset :].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return offs, data


def _slices(offs: np.ndarray):
    """Row ranges of SLICE bytes at most, or of one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of b, which holds rows that begin at offs[:-1]."""
    space, _ = _tables()
    n = len(b)
    gap = np.ones(n + 1, dtype=bool)
    gap[:n] = space[b]
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    inside = ~gap[:n]
    before = np.ones(n, dtype=bool)
    before[1:] = gap[: n - 1]
    starts = np.flatnonzero(inside & (before | first[:n]))
    ends = np.flatnonzero(inside & (gap[1:] | first[1:])) + 1
    return starts, ends


def word_hashes(col: pa.Array):
    """Yield (row from, row to, hashes of all words, word offsets by row) for slices of a string array."""
    offs, data = _buffers(col)
    _, value = _tables()
    for i, j in _slices(offs):
        lo = offs[i]
        b, o = data[lo : offs[j]], offs[i : j + 1] - lo
        if not len(b):
            yield i, j, np.zeros(0, np.uint64), np.zeros(j - i + 1, np.int64)
            continue
        s, e = spans(b, o)
        total = value[b]
        total *= _powers(P, len(b))
        np.cumsum(total, out=total)
        before = np.where(s > 0, total[np.maximum(s - 1, 0)], np.uint64(0))
        h = mix((total[e - 1] - before) * _powers(P_INV, len(b))[s] + (e - s).astype(np.uint64) * WEIGHTS[63])
        yield i, j, h, np.searchsorted(s, o)


def word_counts(col: pa.Array) -> np.ndarray:
    """Words of each row."""
    offs, data = _buffers(col)
    out = np.zeros(len(col), dtype=np.int64)
    for i, j in _slices(offs):
        b, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        if len(b):
            s, _ = spans(b, o)
            out[i:j] = np.diff(np.searchsorted(s, o))
    return out


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of size words in h; one for all of h if it has fewer words; none without words."""
    if not len(h):
        return h
    k = min(size, len(h))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k * 0x51ED270B), dtype=np.uint64)
    for t in range(k):
        out += h[t : t + n] * WEIGHTS[t]
    return mix(out)


def shingle_sets(col: pa.Array, size: int):
    """Yield (row, sorted distinct shingle hashes, hashes of the words in order) of each row."""
    for i, j, h, o in word_hashes(col):
        for r in range(i, j):
            w = h[o[r - i] : o[r - i + 1]]
            yield r, np.unique(shingles(w, size)), w


def sequence_hash(w: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the sequence of words."""
    with np.errstate(over="ignore"):
        a = (w * _powers(0xA24BAED4963EE407 | 1, len(w))).sum(dtype=np.uint64)
        b = (w * _powers(0x9FB21C651E98DF25 | 1, len(w))).sum(dtype=np.uint64)
    both = mix(np.array([a, b], dtype=np.uint64) + np.uint64(len(w))).view(np.int64)
    return int(both[0]), int(both[1])
