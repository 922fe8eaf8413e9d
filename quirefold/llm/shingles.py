"""Word shingles of whole texts as sets of 64-bit hashes, in numpy."""
from __future__ import annotations

import numpy as np

BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
VALUE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
VALUE[ord("A") : ord("Z") + 1] = VALUE[ord("a") : ord("z") + 1]  # A-Z count as a-z, in words only


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order, by sorting; np.unique alone hashes, which takes many times as long."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base, np.uint64)]))


#: Bytes that are hashed at a time; a longer word is hashed alone.
WINDOW = 1 << 20
_known = {"n": 0, "up": np.zeros(0, np.uint64), "down": np.zeros(0, np.uint64)}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and INVERSE; those for a window are kept."""
    if n > WINDOW + 1:
        return _powers(BASE, n), _powers(INVERSE, n)
    if _known["n"] < n:
        n = min(WINDOW + 1, max(1 << 16, 2 * n))
        _known.update(n=n, up=_powers(BASE, n), down=_powers(INVERSE, n))
    return _known["up"], _known["down"]


def words_at(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^ \\t-\\r]+ of a text's bytes, in order, and where they start; A-Z lower-cased. Equal words
    have equal hashes. A long text is hashed in windows that end between words."""
    data = np.frombuffer(raw, np.uint8)
    gap = SPACE[data]
    hashes, starts, lo = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while lo < len(data):
        hi = min(lo + WINDOW, len(data))
        if hi < len(data) and not gap[hi]:
            step = int(gap[hi:].argmax())
            hi = hi + step if gap[hi + step] else len(data)
        edge = np.diff(gap[lo:hi].astype(np.int8), prepend=1, append=1)
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(start):
            up, down = _tables(hi - lo + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUE[data[lo:hi]] * up[: hi - lo])])
            hashes.append(mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            starts.append(start + lo)
        lo = hi
    return np.concatenate(hashes), np.concatenate(starts)


def word_hashes(raw: bytes) -> np.ndarray:
    return words_at(raw)[0]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of so many words; of the whole sequence if it has fewer; else empty."""
    h = word_hashes((text or "").encode())
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = mix(out * np.uint64(0xA24BAED4963EE407) + h[k : k + n])
    return distinct(out)
