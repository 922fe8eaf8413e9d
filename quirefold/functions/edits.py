"""Exact edit distances and matching blocks of sequences, a machine word or a big integer of table cells at a time."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

ONE = np.uint64(1)
#: Cells of the symbol table of a block of pairs, pairs of a block.
TABLE, PAIRS = 4_000_000, 2048


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences; a whole column of the table is one big integer (Myers)."""
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, c in enumerate(a):
        places.setdefault(c, []).append(i)
    size, own = (len(a) + 7) // 8, {}
    for c, at in places.items():
        bits = np.zeros(size * 8, np.uint8)
        bits[at] = 1
        own[c] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    last = len(a) - 1
    mask = (1 << len(a)) - 1
    up, down, score = mask, 0, len(a)
    for c in b:
        same = own.get(c, 0)
        x = same | down
        d = (((same & up) + up) ^ up) | same
        plus, minus = (down | ~(d | up)) & mask, up & d
        if plus >> last:
            score += 1
        elif minus >> last:
            score -= 1
        plus = ((plus << 1) | 1) & mask
        up, down = ((minus << 1) | ~(x | plus)) & mask, plus & x
    return score


def _together(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Distances of pairs, the longest b first. Each step takes the next symbol of every b, one machine word of all pairs
    at a time; what the last column of a pair adds up to is its distance."""
    pairs = len(a)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    words = int(la.max() + 63) // 64
    symbols, codes = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    split = la.sum()
    own = np.zeros((words, len(symbols) * pairs), np.uint64)
    pair = np.repeat(np.arange(pairs), la)
    place = np.arange(split) - np.repeat(np.cumsum(la) - la, la)
    np.bitwise_or.at(own, (place // 64, codes[:split] * pairs + pair), ONE << (place % 64).astype(np.uint64))
    other = np.zeros((lb[0], pairs), np.int64)
    pair = np.repeat(np.arange(pairs), lb)
    other[np.arange(len(pair)) - np.repeat(np.cumsum(lb) - lb, lb), pair] = codes[split:] * pairs + pair
    up, down = np.full((words, pairs), ~np.uint64(0)), np.zeros((words, pairs), np.uint64)
    top = np.uint64(63)
    active = np.searchsorted(-lb, -np.arange(lb[0]), side="left")
    for step in range(lb[0]):
        n = active[step]
        at = other[step, :n]
        rise, fall = ONE, np.uint64(0)  # of the row above the word
        for w in range(words):
            same, u, d = own[w].take(at), up[w, :n], down[w, :n]
            x = same | d
            same |= fall
            h = same & u
            h += u
            h ^= u
            h |= same
            minus = u & h
            h |= u
            plus = ~h
            plus |= d
            rises, falls = plus >> top, minus >> top
            plus <<= ONE
            plus |= rise
            minus <<= ONE
            minus |= fall
            np.bitwise_and(plus, x, out=d)
            x |= plus
            np.bitwise_or(minus, ~x, out=u)
            rise, fall = rises, falls
    held = np.clip(la - 64 * np.arange(words)[:, None], 0, 64)
    mask = np.where(held == 64, ~np.uint64(0), (ONE << np.minimum(held, 63).astype(np.uint64)) - ONE)
    return lb + np.bitwise_count(up & mask).sum(0, np.int64) - np.bitwise_count(down & mask).sum(0, np.int64)


def distances(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Levenshtein distances of pairs of arrays of codes: many of about one length together, else each by itself."""
    out = np.zeros(len(a), np.int64)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    none = (la == 0) | (lb == 0)
    out[none] = (la + lb)[none]
    words = (la + 63) // 64
    left = np.lexsort((-lb, -words))
    left = left[~none[left]]
    fit = PAIRS
    while len(left):
        # of about so many words as the first, and symbols that fit a table
        most = int(words[left[0]])
        n = min(PAIRS, 2 * fit, int(np.searchsorted(-words[left], -(most * 3 // 4), side="right")))
        while n > 1 and n * most * len(np.unique(np.concatenate([*(a[i] for i in left[:n]), *(b[i] for i in left[:n])]))) > TABLE:
            n //= 2
        fit = max(n, 16)
        block, left = np.split(left, [n])
        block = block[np.argsort(-lb[block], kind="stable")]
        together = lb[block[0]] * most * (20e-6 + 20e-9 * len(block))
        alone = float((lb[block] * (2e-6 + 50e-9 * words[block])).sum())
        if alone < together:
            out[block] = [distance(a[i].tolist(), b[i].tolist()) for i in block]
        else:
            out[block] = _together([a[i] for i in block], [b[i] for i in block])
    return out


def _each(gt: pd.Series, hyp: pd.Series, codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance and first length of each pair of texts, equal pairs counted once; and which pairs aren't null."""
    known = (gt.notna() & hyp.notna()).to_numpy()
    place: dict = {}
    at = [place.setdefault(pair, len(place)) for pair in zip(gt[known], hyp[known])]
    a, b = [codes(g) for g, _ in place], [codes(h) for _, h in place]
    return distances(a, b)[at], np.array([len(x) for x in a], np.int64)[at], known


@F.pandas_udf(IntegerType())
def edits(gt: pd.Series, hyp: pd.Series) -> pd.Series:
    """Levenshtein distance of two texts' characters, as levenshtein gives it, in a 64th of its steps."""
    out = pd.array([None] * len(gt), "Int32")
    d, _, known = _each(gt, hyp, characters)
    out[known] = d.astype(np.int32)
    return pd.Series(out)


def _run(cells: int, step: int) -> tuple[int, int]:
    """Length of the longest diagonal run of set cells, and the cells in which runs of that length end."""
    ends, length = [cells], 1
    while longer := ends[-1] & (ends[-1] << step * length):
        ends.append(longer)
        length *= 2
    best, size = ends[-1], length
    for k in range(len(ends) - 2, -1, -1):
        part = 1 << k
        if longer := best & (ends[k] << step * size):
            best, size = longer, size + part
    return size, best


def blocks(a: list, b: list, cells: int = 100_000) -> list[tuple[int, int, int]]:
    """(i, j, n) of the matching blocks that difflib.SequenceMatcher(None, a, b, autojunk=False) finds, in order, without the
    empty last one: the longest match, the first in a and then in b on ties, then both sides of it.

    Equal pairs are listed by symbol and cut with the rectangles; a rectangle of few cells becomes one big integer.
    """
    codes: dict = {}
    x, y = (np.array([codes.setdefault(c, len(codes)) for c in s], np.int64) for s in (a, b))
    found: list[tuple[int, int, int]] = []
    todo = [(0, len(x), 0, len(y), None)]
    while todo:
        alo, ahi, blo, bhi, pairs = todo.pop()
        if alo >= ahi or blo >= bhi:
            continue
        if (ahi - alo) * (bhi - blo) <= cells:
            _small(x[alo:ahi].tolist(), y[blo:bhi].tolist(), alo, blo, found)
            continue
        if pairs is None:
            order = np.argsort(y, kind="stable")
            lo, hi = np.searchsorted(y[order], x), np.searchsorted(y[order], x, side="right")
            n = hi - lo
            i = np.repeat(np.arange(len(x)), n)
            j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            order = np.lexsort((i, i - j))  # by diagonal, and so it stays
            pairs = i[order], j[order]
        i, j = pairs
        if not len(i):
            continue
        start = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)]))
        size = np.diff(np.append(start, len(i)))
        top = start[size == size.max()]
        first = top[np.lexsort((j[top], i[top]))[0]]
        fi, fj, k = int(i[first]), int(j[first]), int(size.max())
        found.append((fi, fj, k))
        for box, keep in (((alo, fi, blo, fj), (i < fi) & (j < fj)), ((fi + k, ahi, fj + k, bhi), (i >= fi + k) & (j >= fj + k))):
            todo.append((*box, (i[keep], j[keep])))
    found.sort()
    out: list[tuple[int, int, int]] = []
    for i, j, k in found:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + k)
        else:
            out.append((i, j, k))
    return out


def _small(a: list, b: list, di: int, dj: int, found: list) -> None:
    """Adds the blocks of a rectangle, whose equal cells are the bits of one integer: a row of b for each place of a."""
    places: dict = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << j
    size = len(b) // 8 + 1
    width, none = size * 8, bytes(size)
    rows = {c: bits.to_bytes(size, "little") for c, bits in places.items()}
    whole = int.from_bytes(b"".join([rows.get(c, none) for c in a]), "little")
    ones = int.from_bytes((b"\1" + bytes(size - 1)) * len(a), "little")  # the first cell of each row
    todo = [(0, len(a), 0, len(b), whole)] if whole else []
    while todo:
        alo, ahi, blo, bhi, cells = todo.pop()  # cells from row alo on
        length, ends = _run(cells, width + 1)
        i, j = divmod((ends & -ends).bit_length() - 1, width)
        i, j = i + alo - length + 1, j - length + 1
        found.append((i + di, j + dj, length))
        if i > alo and j > blo:
            n = (i - alo) * width
            left = cells & ((ones & ((1 << n) - 1)) * ((1 << j) - (1 << blo)))
            if left:
                todo.append((alo, i, blo, j, left))
        i, j = i + length, j + length
        if i < ahi and j < bhi:
            right = (cells >> (i - alo) * width) & ((ones & ((1 << (ahi - i) * width) - 1)) * ((1 << bhi) - (1 << j)))
            if right:
                todo.append((i, ahi, j, bhi, right))


def opcodes(a: list, b: list):
    """(kind, i, j, k, n) of the runs a[i:j] and b[k:n], as difflib.SequenceMatcher.get_opcodes gives them."""
    i = j = 0
    for ai, bj, size in [*blocks(a, b), (len(a), len(b), 0)]:
        kind = "replace" if i < ai and j < bj else "delete" if i < ai else "insert" if j < bj else ""
        if kind:
            yield kind, i, ai, j, bj
        i, j = ai + size, bj + size
        if size:
            yield "equal", ai, i, bj, j


def similarity(a: str, b: str) -> float:
    """difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()."""
    n = len(a) + len(b)
    return 2.0 * sum(k for _, _, k in blocks(a, b)) / n if n else 1.0
