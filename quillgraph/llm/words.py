"""Words of many texts as arrays of 64-bit hashes; everything in here is array operations."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over Arrow batches, giving back what the allocators hold on to when a task ends: workers are used again
    for other stages, and what one keeps is missing to the next."""

    def wrapped(batches: Iterator) -> Iterator:
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there with the GNU library
            if trim:
                trim(0)

    return wrapped


_rng = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multipliers of the two polynomial hashes (bytes of a word, words of a window) and their inverses mod 2^64.
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class _Powers:
    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            grow = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)])
            self.up, self.down = grow(np.uint64(self.base)), grow(np.uint64(self.inverse))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_P), _Powers(_Q)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words before each text and in all): words between ASCII white space."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.r_[0, edge]
    start, end = edge[0::2], edge[1::2]
    up, down = _BYTES.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(start, offsets)


def window_sums(h: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``window`` takes the hash of any run of words."""
    up, _ = _WORDS.to(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=sums[1:])
    return sums


def window(sums: np.ndarray, start: np.ndarray, n) -> np.ndarray:
    _, down = _WORDS.to(len(sums))
    return mix((sums[start + n] - sums[start]) * down[start] + np.asarray(n).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours, by doubling."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:]) if len(x) > size else x[:0]
        size *= 2
    rest = w - size
    return x if not rest else np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]


def chunks(values: list, most: int = 1 << 19):
    """Index ranges of about ``most`` bytes of text; one text is never split."""
    lo = held = 0
    for i, v in enumerate(values):
        held += len(v)
        if held >= most:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(values):
        yield lo, len(values)
