"""Texts as flat numpy arrays: code points, words, lines and their hashes."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}


def text_blocks(texts: list[str], limit: int = 1_000_000):
    """(start, end) ranges of consecutive texts with at most ``limit`` characters
    together; a longer text is a block of its own."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def code_points(texts: list[str], sep: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one uint32 array, ``sep`` after each, and the start of each
    text plus the total length."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    joined = "".join([t + sep for t in texts])
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    return cp, np.concatenate(([0], np.cumsum(lens)))


def is_space(cp: np.ndarray) -> np.ndarray:
    """Space and U+0009..U+000D."""
    return (cp == 32) | ((cp >= 9) & (cp <= 13))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POW.get("b")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for key, base in (("b", _BASE), ("i", _INV)):
            p = np.full(size, U64(base))
            p[0] = 1
            _POW[key] = np.multiply.accumulate(p)
    return _POW["b"][:n], _POW["i"][:n]


def segment_hash(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every segment's code points, equal for equal segments
    wherever they stand (prefix sums of a polynomial, divided by its offset)."""
    if not len(start):
        return np.empty(0, U64)
    up, down = _powers(len(cp) + 1)
    with np.errstate(over="ignore"):
        s = np.zeros(len(cp) + 1, U64)
        np.cumsum(mix64(cp.astype(U64) + U64(1)) * up[:-1], out=s[1:])
        h = (s[end] - s[start]) * down[start]
        return mix64(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def owner(pos: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the text that each position belongs to."""
    return np.searchsorted(offsets, pos, side="right") - 1


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per text (positions offsets[i]..offsets[i+1])."""
    c = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return c[offsets[1:]] - c[offsets[:-1]]
