"""Hashed character n-grams of whole texts, in numpy."""
from __future__ import annotations

import numpy as np

MULTIPLIER, MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIXER
    return h ^ (h >> np.uint64(29))


def gram_hashes(text: str, orders: tuple[int, ...]) -> list[np.ndarray]:
    """64-bit hashes of all n-grams of code points, an array for each order (ascending)."""
    points = code_points(text) + np.uint64(1)
    out, h = [], np.zeros(0, np.uint64)
    for n in range(1, max(orders) + 1):
        h = points if n == 1 else h[: max(0, len(points) - n + 1)] * MULTIPLIER + points[n - 1 :]
        if n in orders:
            out.append(mixed(h * MIXER + np.uint64(n)))
    return out
