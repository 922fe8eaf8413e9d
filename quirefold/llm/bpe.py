"""Byte-level BPE encoding and decoding with padded numpy matrices."""
from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
NONE = np.int32(2**31 - 1)  # the rank of a pair that doesn't merge


class PairTable:
    """Open-addressing hash table from pairs of token ids to the rank of the merged token."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64(2**bits - 1)
        self.keys, self.ranks = np.full(2**bits, -1, np.int64), np.full(2**bits, NONE, np.int32)
        at, todo, self.probes = self._slot(pairs), np.arange(len(pairs)), 1
        while len(todo):
            free = self.keys[at[todo]] == -1
            _, first = np.unique(at[todo][free], return_index=True)
            won = todo[free][first]
            self.keys[at[won]], self.ranks[at[won]] = pairs[won], ranks[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask
            self.probes += bool(len(todo))

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b), NONE where they don't merge; a or b may be -1 (padding)."""
        pairs = (a.astype(np.int64) << 32) | b.astype(np.int64)
        at = self._slot(pairs)
        keys = self.keys[at]
        out = np.where((keys == pairs) & (a >= 0) & (b >= 0), self.ranks[at], NONE)
        open_ = np.flatnonzero((keys != pairs) & (keys != -1) & (a >= 0) & (b >= 0))
        at, want = at[open_], pairs[open_]
        while len(open_):
            at = (at + 1) & self.mask
            keys = self.keys[at]
            hit = keys == want
            out[open_[hit]] = self.ranks[at[hit]]
            go = ~hit & (keys != -1)
            open_, at, want = open_[go], at[go], want[go]
        return out


class Encoder:
    """A vocabulary of ranks. Encodes pieces as repeated merges of the leftmost pair of minimum rank do."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, cache: int = 200_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.pattern, self.known, self.cache = regex.compile(pattern), {}, cache
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs, merged = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    merged.append(rank)
        self.pairs = PairTable(np.array(pairs, np.int64), np.array(merged, np.int32))

    def start(self, pieces: list[bytes]) -> tuple[np.ndarray, ...]:
        """Padded matrices of pieces, a row each: ids, ranks of the pairs that begin there, and places of the tokens after
        and before. The width is a whole number of spans, see leftmost."""
        length = np.array([len(p) for p in pieces])
        span = self.span(int(length.max()))
        width = -(-(int(length.max()) + 1) // span) * span
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width)[None, :] < length[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((len(pieces), width), NONE, np.int32)
        ranks[:, :-1] = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        places = np.arange(width, dtype=np.int32)
        return ids, ranks, np.tile(places + 1, (len(pieces), 1)), np.tile(places - 1, (len(pieces), 1))

    @staticmethod
    def span(width: int) -> int:
        """Columns that share one minimum: all of a short row, about the root of a long one's width."""
        return width + 1 if width < 512 else int(np.sqrt(width)) + 1

    def matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of similar lengths, in one matrix: each round merges the leftmost pair of minimum rank of every row.

        A merged pair leaves a gap, over which the places before and after are linked; gaps are closed (compaction) when
        they may be half of the width, and finished rows go when they are half of all. The minimum of a wide row is
        found by the minima of its spans of columns, which a round renews where it changed them.
        """
        ids, ranks, after, before = self.start(pieces)
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        row, gaps = np.arange(len(pieces)), 0
        while True:
            width = ids.shape[1]
            span = min(width, self.span(width - 1))
            lows = ranks.reshape(len(row), -1, span).min(axis=2) if span < width else None
            while True:
                every = np.arange(len(row))
                if lows is None:
                    at = ranks.argmin(axis=1)
                else:
                    block = lows.argmin(axis=1)
                    at = block * span + ranks.reshape(len(row), -1, span)[every, block].argmin(axis=1)
                least = ranks[every, at]
                live = np.flatnonzero(least != NONE)
                if 2 * len(live) <= len(row) or 2 * gaps >= width:
                    break
                at, least = at[live].astype(np.int32), least[live]
                second = after[live, at]
                third = after[live, second]
                ids[live, at], ids[live, second], ranks[live, second] = least, -1, NONE
                after[live, at] = third
                inside = third < width
                third = np.minimum(third, width - 1)
                before[live[inside], third[inside]] = at[inside]
                ranks[live, at] = self.pairs.find(least, np.where(inside, ids[live, third], -1))
                first = before[live, at]
                left = np.flatnonzero(first >= 0)
                ranks[live[left], first[left]] = self.pairs.find(ids[live[left], first[left]], least[left])
                if lows is not None:
                    spans = ranks.reshape(len(row), -1, span)
                    for place in (at, second, np.maximum(first, 0)):
                        lows[live, place // span] = spans[live, place // span].min(axis=1)
                gaps += 1
            over = np.flatnonzero(least == NONE)
            for k in over:
                out[row[k]] = ids[k][ids[k] >= 0]
            if not len(live):
                return out
            row, ids, ranks = row[live], ids[live], ranks[live]
            closed = np.argsort(ids < 0, axis=1, kind="stable")
            used = int((ids >= 0).sum(axis=1).max()) + 1
            span = self.span(used - 1)
            wide = -(-used // span) * span
            keep = np.pad(closed[:, : min(wide, width)], ((0, 0), (0, max(0, wide - width))), mode="edge")
            ids, ranks = np.take_along_axis(ids, keep, 1), np.take_along_axis(ranks, keep, 1)
            ranks[ids < 0] = NONE
            places = np.arange(wide, dtype=np.int32)
            after, before = np.tile(places + 1, (len(row), 1)), np.tile(places - 1, (len(row), 1))
            gaps = 0

    def learn(self, new: list[str]) -> None:
        """Encodes pieces that aren't known yet, in matrices of similar lengths."""
        if len(self.known) + len(new) > self.cache:
            self.known.clear()
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            raw = piece.encode()
            if raw in self.ranks:
                self.known[piece] = np.uint32(self.ranks[raw]).tobytes()
            else:  # buckets of lengths: by fours, and from 64 on by the leading two bits
                n = len(raw)
                by_width.setdefault(-(-n // 4) if n <= 64 else 16 + 4 * n.bit_length() + (n >> n.bit_length() - 3 & 3), []).append((piece, raw))
        for rows in by_width.values():
            size = max(1, min(4096, 4_000_000 // max(len(raw) for _, raw in rows)))
            for i in range(0, len(rows), size):
                part = rows[i : i + size]
                for (piece, _), ids in zip(part, self.matrix([raw for _, raw in part])):
                    self.known[piece] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        split = [self.pattern.findall(t) for t in texts]
        every = set().union(*split)
        new = every - self.known.keys()
        if new:
            if len(self.known) + len(new) > self.cache:
                new = every
            self.learn(list(new))
        known = self.known
        return [b"".join([known[p] for p in pieces]) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def portions(texts: list[str], chars: int = 1_000_000):
    """Slices of the list with about so many characters, one text at least."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= chars:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes every whole text and decodes the ids: doc_id, n_tokens, ids (little-endian uint32), decoded (bytes).

    A null text counts as empty; an empty text has no tokens. Rows are independent of each other, so nothing is
    shuffled; a task holds about a million characters at a time besides one Arrow batch and a bounded cache of pieces.
    """
    path = path or public_tokenizers.path(TOKENIZER)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in portions(texts):
                ids = enc.encode(texts[part])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[part], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(enc.decode, ids), pa.binary())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, token_ids (array<int>) and whether decoding gave the text's bytes back."""
    path = path or public_tokenizers.path(TOKENIZER)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in portions(texts):
                ids = enc.encode(texts[part])
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                ends = np.cumsum([0] + [len(x) // 4 for x in ids], dtype=np.int32)
                same = [enc.decode(x) == t.encode() for x, t in zip(ids, texts[part])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[part], pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(same)], ["doc_id", "n_tokens", "token_ids", "round_trip"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")
