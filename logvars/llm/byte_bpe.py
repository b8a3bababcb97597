"""Byte-level BPE by a file of ranks: encoding in two tiers, and decoding.

A minimal perfect hash over the vocabulary resolves every pre-token that is a token itself: as many slots
as tokens, one displacement for each bucket of keys, and the bytes in the slot tell a member from a
stranger.  Pre-tokens outside the vocabulary are merged pair by pair, lowest rank first and leftmost of
equal ranks, with a heap of pairs over a linked list of bytes.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import new_column

#: Characters of text (or pre-tokens of one long text) that are encoded at once.
AT_ONCE, LONG = 4_000_000, 500_000
#: Merged pre-tokens in each of the two generations that a worker remembers, and the longest of them.
REMEMBERED, REMEMBERED_LENGTH = 250_000, 64
#: What ids outside the vocabulary and null ids decode to.
UNKNOWN = "�".encode()
_WORD, _STEP, _MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


class PerfectHash:
    """Slots 0 to n - 1 for n distinct byte strings, without gaps or clashes; other strings get any slot.

    Keys fall into n buckets.  Buckets of several keys, large ones first, try displacements until all
    their keys land on free slots; a bucket of one key names its slot itself, as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.seed = len(keys), 0
        while not self._place([self.hash(k) for k in keys]):
            self.seed += 1

    def hash(self, key: bytes) -> int:
        return xxhash.xxh3_64_intdigest(key, self.seed)

    def _landing(self, hashed: int, move: int) -> int:
        x = (hashed + move * _STEP) & _WORD
        x = ((x ^ (x >> 31)) * _MIX) & _WORD
        return (x ^ (x >> 29)) % self.n

    def _place(self, hashes: list[int]) -> bool:
        if len(set(hashes)) < len(hashes):
            return False
        buckets: dict[int, list[int]] = {}
        for h in hashes:
            buckets.setdefault(h % self.n, []).append(h)
        moves, taken = [0] * self.n, bytearray(self.n)
        alone = []
        for bucket, held in sorted(buckets.items(), key=lambda b: -len(b[1])):
            if len(held) == 1:
                alone.append(bucket)
                continue
            for move in range(1, 1 << 20):
                spots = {self._landing(h, move) for h in held}
                if len(spots) == len(held) and not any(map(taken.__getitem__, spots)):
                    break
            else:
                return False
            moves[bucket] = move
            for s in spots:
                taken[s] = 1
        free = (s for s in range(self.n) if not taken[s])
        for bucket, slot in zip(alone, free, strict=True):
            moves[bucket] = ~slot
        self.moves = np.array(moves, dtype=np.int64)
        return True

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """Slots of many keys at once."""
        seed, digest = self.seed, xxhash.xxh3_64_intdigest
        hashed = np.fromiter((digest(k, seed) for k in keys), dtype=np.uint64, count=len(keys))
        moves = self.moves[(hashed % np.uint64(self.n)).astype(np.int64)]
        x = hashed + np.maximum(moves, 0).astype(np.uint64) * np.uint64(_STEP)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(_MIX)
        landed = ((x ^ (x >> np.uint64(29))) % np.uint64(self.n)).astype(np.int64)
        return np.where(moves < 0, ~moves, landed)


class Codec:
    """Ids of texts and texts of ids, by a file with one token (base64) and its rank in each line."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        if lacking := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{path} has no token for the bytes {lacking[:9]}")
        tokens = list(ranks)
        self.longest = max(map(len, tokens))
        self.table = PerfectHash(tokens)
        order = np.argsort(self.table.slots(tokens))
        self.tokens = [tokens[i] for i in order]
        self.ranks = np.array([ranks[t] for t in self.tokens], dtype=np.int32)
        self.rank_of = ranks
        top = max(ranks.values()) + 1
        by_rank = dict(zip(ranks.values(), ranks, strict=True))
        self.by_rank = pa.array([by_rank.get(r, UNKNOWN) for r in range(top)] + [UNKNOWN], pa.binary())
        self.pattern = regex.compile(pattern)
        self.merged: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token outside the vocabulary.

        ``end`` links each part, named by its first byte, to the part after it, ``before`` back.  A heap
        entry (rank, left, middle, right) counts only while both parts still end where they did.
        """
        n, rank_of, longest, pop, push = len(piece), self.rank_of, self.longest, heapq.heappop, heapq.heappush
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [
            (rank, left, left + 1, left + 2) for left in range(n - 1) if (rank := rank_of.get(piece[left : left + 2])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            _, left, middle, right = pop(heap)
            if end[left] != middle or end[middle] != right:
                continue
            end[left], end[middle] = right, -1
            if right < n:
                before[right] = left
                stop = end[right]
                if stop - left <= longest and (rank := rank_of.get(piece[left:stop])) is not None:
                    push(heap, (rank, left, right, stop))
            if left:
                start = before[left]
                if right - start <= longest and (rank := rank_of.get(piece[start:right])) is not None:
                    push(heap, (rank, start, left, right))
        ids, at = [], 0
        while at < n:
            ids.append(rank_of[piece[at : end[at]]])
            at = end[at]
        return ids

    def _miss(self, piece: bytes) -> bytes:
        """Its ids as 32-bit integers."""
        ids = self.merged.get(piece)
        if ids:
            return ids
        if not (ids := self.older.get(piece)):
            merged = self.merge(piece)
            ids = pack("=%di" % len(merged), *merged)
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self.merged) >= REMEMBERED:
                self.older, self.merged = self.merged, {}
            self.merged[piece] = ids
        return ids

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after the other, and how many each has; distinct ones are looked up once."""
        code = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        keys = [p.encode("utf-8", "surrogatepass") for p in code]
        slots = self.table.slots(keys)
        ids = self.ranks[slots]
        sizes = np.ones(len(keys), dtype=np.int64)
        misses = [i for i, (s, k) in enumerate(zip(slots.tolist(), keys, strict=True)) if self.tokens[s] != k]
        found = [self._miss(keys[i]) for i in misses]
        sizes[misses] = [len(f) // 4 for f in found]
        starts = np.cumsum(sizes) - sizes
        held = np.empty(int(sizes.sum()), dtype=np.int32)
        held[starts] = ids
        if misses:
            spots = np.repeat(starts[misses], sizes[misses]) + _within(sizes[misses])
            held[spots] = np.frombuffer(b"".join(found), dtype=np.int32)
        codes = np.fromiter(map(code.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        lengths = sizes[codes]
        return held[np.repeat(starts[codes], lengths) + _within(lengths)], lengths

    def encode(self, texts: Iterable[str | None]) -> pa.Array:
        """A list of ids for each text; null and empty texts have none."""
        flat, counts, pieces, held = [], [], [], []

        def settle() -> None:
            ids, lengths = self._encode(pieces)
            flat.append(ids)
            per_text = np.repeat(np.arange(len(held)), held)
            counts.extend(np.bincount(per_text, weights=lengths, minlength=len(held)).astype(np.int64).tolist())
            pieces.clear()
            held.clear()

        for text in texts:
            if text and len(text) > AT_ONCE:
                settle()
                matches, total = (m.group() for m in self.pattern.finditer(text)), 0
                while part := list(islice(matches, LONG)):
                    flat.append(self._encode(part)[0])
                    total += len(flat[-1])
                counts.append(total)
                continue
            found = self.pattern.findall(text) if text else []
            pieces += found
            held.append(len(found))
            if len(pieces) >= LONG:
                settle()
        settle()
        offsets = np.cumsum([0, *counts])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat), pa.int32()))

    def decode(self, lists: pa.Array) -> pa.Array:
        """The bytes of each list of ids."""
        last = len(self.by_rank) - 1
        ids = lists.flatten().fill_null(last).to_numpy(zero_copy_only=False)
        ids = np.where((ids < 0) | (ids > last), last, ids)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        pieces = pa.ListArray.from_arrays(offsets, self.by_rank.take(pa.array(ids)))
        joined = pc.binary_join(pieces, pa.scalar(b"", pa.binary()))
        return pc.if_else(lists.is_valid(), joined, pa.scalar(None, pa.binary()))


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, … inside each run of the given sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process and file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _slices(parts: Iterator[pa.Array], bytes_at_once: int = AT_ONCE) -> Iterator[pa.Array]:
    """Parts of about as many bytes, so that memory does not follow the rows of a batch."""
    for part in parts:
        rows = max(1, int(len(part) * bytes_at_once / max(part.nbytes, 1)))
        for at in range(0, len(part), rows):
            yield part.slice(at, rows)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``, the ids of the whole text.

    ``path`` names a file of ranks that all workers can read, ``pattern`` the expression whose matches
    are encoded each on its own; special tokens are ordinary text.  Null and empty texts get an empty
    list.  Every row and column stays; a column named ``out`` is refused.
    """

    @arrow_udf("array<int>")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in _slices(parts):
            yield codec(path, pattern).encode(part.to_pylist())

    # What reads the ids twice must not encode twice.
    return docs.withColumn(new_column(docs, out), of.asNondeterministic()(F.col(text_col)))


def decode(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``, the bytes that the ids stand for; they need not be whole characters.

    A null list gives null, an empty one no bytes; ids outside the vocabulary and null ids give U+FFFD.
    Every row and column stays; a column named ``out`` is refused.
    """

    @arrow_udf("binary")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in _slices(parts):
            yield codec(path, pattern).decode(part)

    return docs.withColumn(new_column(docs, out), of.asNondeterministic()(F.col(ids_col)))
