"""Word shingles of a text as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, modulo 2**64, for i < n; kept up to a million."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = (np.full(size, b, dtype=np.uint64) for b in (_BASE, inverse))
        up[0] = down[0] = 1
        made = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
        if size > 1 << 20:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles: A-Z lowered, words split at
    ASCII white space. Fewer words make one shingle; none, an empty array.

    The hash is a random-weight polynomial over the bytes, read off prefix sums, so the
    work is linear in the bytes with no Python loop over words.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    up, down = _powers(len(joined))
    sums = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[joined] * up[: len(joined)], out=sums[1:])
    ends = np.flatnonzero(joined == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    a, b = starts[: len(words) - k + 1], ends[k - 1 :]
    return np.unique(mixed((sums[b] - sums[a]) * down[a]))
