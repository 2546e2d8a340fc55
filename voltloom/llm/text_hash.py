"""Hashes of the words of a text, computed over its bytes with numpy."""

from __future__ import annotations

import numpy as np

#: The five ASCII white-space bytes besides the space, as spaces.
TO_SPACE = bytes(0x20 if 9 <= b <= 13 else b for b in range(256))
_STEP = 1 << 20
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _BASE
    return h ^ (h >> np.uint64(32))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", inverse)):
            ones = np.full(size, base, np.uint64)
            ones[0] = 1
            _powers[name] = np.multiply.accumulate(ones)
    return _powers["up"], _powers["down"]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word (run without ASCII white space), in order. Memory is a few times the text."""
    text = text.translate(TO_SPACE)
    codes = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = codes != 32
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[0::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _STEP, "right")))
        size = int(ends[j - 1] - base)
        up, down = _tables(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((codes[base : base + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    h = hashes[:m].copy()
    for k in range(1, n):
        h = h * _BASE + hashes[k : k + m]
    return mix(h)
