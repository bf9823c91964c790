"""Word and shingle hashes of texts, for tasks that work on arrays."""

from __future__ import annotations

import numpy as np
import xxhash

_MOST = 250_000
_P = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hashes of words seen before; emptied when full, so its size has a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MOST:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words, which ASCII white space divides; A-Z as a-z if lower."""
    raw = (text or "").encode()
    words = (raw.lower() if lower else raw).split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order; of the whole if there are fewer, of nothing if there are none."""
    if len(h) == 0:
        return h
    m = max(1, len(h) - n + 1)
    n = min(n, len(h))
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = out * _P + h[k : k + m]
    return mix(out)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of n words."""
    return np.unique(runs(word_hashes(text), n))
