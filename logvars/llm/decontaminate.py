"""Benchmark decontamination by a generalised suffix automaton of the test items.

Words of an item follow the automaton's edges; a document's words are streamed through it, which
gives the longest match that ends at each word.  A match of ``window`` words (or a whole shorter
item) marks all its words.  A pair table tells where a match can lie at all: a match of n words
needs n - 1 successive pairs that occur in items, so only such stretches are streamed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import stage

#: Fixed rule for words: after A-Z become lower case, runs of digits, a-z and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SPOTS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
MATCHES = "n_words long, starts array<int>, ends array<int>, items array<long>"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Automaton:
    """Suffix automaton of many word sequences, with the items that hold each window."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        number = self.vocabulary.setdefault
        coded = [(item, [number(w, len(self.vocabulary)) for w in text]) for item, text in items if text]
        for text in {tuple(c): None for _, c in coded}:
            last = 0
            for word in text:
                last = self._extend(last, word)
        self.windows: dict[int, set[int]] = {}
        self.short: dict[int, dict[int, set[int]]] = {}
        for item, text in coded:
            if len(text) < window:
                state = 0
                for word in text:
                    state = self.next[state][word]
                self.short.setdefault(state, {}).setdefault(len(text), set()).add(item)
            else:
                for state, _, _ in self._stream(text, window):
                    self.windows.setdefault(state, set()).add(item)
        self.has_short = bool(self.short)
        self.least = min([window, *(n for found in self.short.values() for n in found)])
        self.pairs = np.zeros(1 << 20, dtype=bool)
        for _, text in coded:
            ids = np.array(text, dtype=np.int64)
            self.pairs[self._pair(ids)] = True

    def _extend(self, last: int, word: int) -> int:
        """Add one word after state ``last``; the state that holds the longer sequence."""
        there = self.next[last].get(word)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
        state = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            there = self.next[last][word]
            self.link[state] = there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
        return state

    def _split(self, last: int, word: int, there: int) -> int:
        """A state of its own for the shorter sequences of ``there`` that come by ``last``."""
        copy = self._state(self.length[last] + 1, dict(self.next[there]), self.link[there])
        self.link[there] = copy
        while last >= 0 and self.next[last].get(word) == there:
            self.next[last][word] = copy
            last = self.link[last]
        return copy

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _stream(self, text, least: int) -> Iterator[tuple[int, int, int]]:
        """(state of the ``least`` last words, position, longest match) wherever that many words match."""
        state = matched = 0
        edges, link, length = self.next, self.link, self.length
        for at, word in enumerate(text):
            while state and word not in edges[state]:
                state = link[state]
                matched = length[state]
            if word in edges[state]:
                state, matched = edges[state][word], matched + 1
            if matched >= least:
                low = state
                while length[link[low]] >= least:
                    low = link[low]
                yield low, at, matched

    def _pair(self, ids: np.ndarray) -> np.ndarray:
        mixed = (ids[:-1] * np.int64(0x9E3779B1) + ids[1:] * np.int64(0x85EBCA77)).astype(np.uint64)
        return ((mixed ^ (mixed >> np.uint64(17))) & np.uint64((1 << 20) - 1)).astype(np.int64)

    def _stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where successive words form pairs of items, long enough for the shortest match."""
        known = ids >= 0
        if self.least == 1:
            linked = known
            grow = 0
        else:
            linked = known[:-1] & known[1:] & self.pairs[self._pair(ids)]
            grow = 1
        edge = np.flatnonzero(np.diff(np.concatenate([[False], linked, [False]]).astype(np.int8)))
        begins, ends = edge[::2], edge[1::2] + grow
        for i in np.flatnonzero(ends - begins >= self.least):
            yield int(begins[i]), int(ends[i])

    def match(self, text: list[bytes]) -> tuple[list[int], list[int], set[int]]:
        """Starts and ends of matched stretches of words, and the items with matches."""
        starts, ends, items = [], [], set()
        if len(text) < self.least:
            return starts, ends, items
        ids = np.array([self.vocabulary.get(w, -1) for w in text], dtype=np.int64)
        for begin, end in self._stretches(ids):
            part = ids[begin:end].tolist()
            for state, at, matched in self._stream(part, self.window):
                items |= self.windows.get(state, set())
                starts.append(begin + at + 1 - matched)
                ends.append(begin + at + 1)
            if self.has_short:
                self._short_matches(part, begin, starts, ends, items)
        return starts, ends, items

    def _short_matches(self, part: list[int], begin: int, starts: list[int], ends: list[int], items: set[int]) -> None:
        for low, at, matched in self._stream(part, 1):
            state = self._deepest(part, at, matched)
            while state:
                for n, found in self.short.get(state, {}).items():
                    if n <= matched:
                        items |= found
                        starts.append(begin + at + 1 - n)
                        ends.append(begin + at + 1)
                state = self.link[state]

    def _deepest(self, part: list[int], at: int, matched: int) -> int:
        """The state of the last ``min(matched, window)`` words that end at ``at``."""
        state = 0
        for word in part[at + 1 - min(matched, self.window) : at + 1]:
            state = self.next[state][word]
        return state


def _covered(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The union of stretches, in order."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def automata(items: DataFrame, window: int, id_col: str, text_col: str, block_words: int) -> Iterator[Automaton]:
    """Automata over blocks of items of about ``block_words`` words, so each has a bounded size.

    Items without words or id are left out.  The driver holds one block at a time.
    """
    text = F.col(text_col)
    sized = items.where(text.isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), text.alias("text"))
    sized = stage(sized.withColumn("n", F.length("text")), "items")
    total = sized.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // (6 * block_words)))
    for block in range(blocks):
        rows = sized.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).select("item", "text").collect()
        found = [(r["item"], words(r["text"])) for r in rows]
        if any(w for _, w in found):
            yield Automaton(found, window)


def _matcher(automaton: Automaton | None):
    @arrow_udf(MATCHES)
    def match(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            columns = ([], [], [], [])
            for text in part.to_pylist():
                found = words(text)
                starts, ends, items = automaton.match(found) if automaton else ([], [], set())
                spans = _covered(starts, ends)
                for column, value in zip(columns, (len(found), [a for a, _ in spans], [b for _, b in spans], sorted(items)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.StructArray.from_arrays(arrays, names=["n_words", "starts", "ends", "items"])

    # A filter on the hits would otherwise be pushed below them and match once more.
    return match.asNondeterministic()


def _united(starts: pa.Array, ends: pa.Array) -> pa.Array:
    spans = [_covered(a, b) for a, b in zip(starts.to_pylist(), ends.to_pylist(), strict=True)]
    lists = pa.list_(pa.int32())
    columns = [
        pa.array([[a for a, _ in s] for s in spans], lists),
        pa.array([[b for _, b in s] for s in spans], lists),
        pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
    ]
    return pa.StructArray.from_arrays(columns, names=["starts", "ends", "n_hit"])


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = 1_000_000,
    out: str = "contamination",
) -> DataFrame:
    """``docs`` with the struct ``out``: n_words, n_hit, items (ascending ids), starts and ends of hit stretches of words.

    Null and empty texts have no words; repeated rows each get their result; no items or no rows give
    no hits.  Every other column stays.
    """
    raw = f"_{out}"
    while any(c.startswith(raw) for c in docs.columns):
        raw = f"_{raw}"
    found, columns = docs, []
    for i, automaton in enumerate(automata(items, window, item_id_col, item_text_col, block_words)):
        columns.append(f"{raw}_{i}")
        found = found.withColumn(columns[-1], _matcher(automaton)(F.col(text_col)))
    if not columns:
        columns = [f"{raw}_0"]
        found = found.withColumn(columns[0], _matcher(None)(F.col(text_col)))
    if len(columns) == 1:  # one automaton: its stretches are united already
        found = found.withColumn(raw, F.col(columns[0]))
        lengths = F.zip_with(F.col(f"{raw}.ends"), F.col(f"{raw}.starts"), lambda b, a: (b - a).cast("long"))
        n_hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda n, x: n + x)
    else:
        joined = {k: F.concat(*[F.col(f"{c}.{k}") for c in columns]) for k in ("starts", "ends")}
        united = arrow_udf(_united, "starts array<int>, ends array<int>, n_hit long")(joined["starts"], joined["ends"])
        found = found.withColumn(raw, united)
        n_hit = F.col(f"{raw}.n_hit")
    result = F.struct(
        F.col(f"{columns[0]}.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.array_sort(F.array_distinct(F.concat(*[F.col(f"{c}.items") for c in columns]))).alias("items"),
        F.col(f"{raw}.starts").alias("starts"),
        F.col(f"{raw}.ends").alias("ends"),
    )
    return found.withColumn(out, result).drop(*columns, raw)


def _without(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    out = []
    for text, a, b in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
        if text and a:
            spots = [m.span() for m in _SPOTS.finditer(text)]
            kept, at = [], 0
            for first, last in zip(a, b, strict=True):
                kept.append(text[at : spots[first][0]])
                at = spots[last - 1][1]
            text = "".join([*kept, text[at:]])
        out.append(text)
    return pa.array(out, pa.string())


def decontaminate(docs: DataFrame, items: DataFrame, max_coverage: float = 0.5, text_col: str = "text", **how) -> DataFrame:
    """Documents without the stretches of words that benchmark items share with them.

    A document of which more than ``max_coverage`` of the words is hit goes as a whole; in others
    the hit stretches are cut out.  Documents without hits stay as they are, null texts too.
    """
    out = "_contamination"
    while out in docs.columns:
        out = f"_{out}"
    found = find_contamination(docs, items, text_col=text_col, out=out, **how)
    hit = F.col(f"{out}.n_hit")
    kept = found.where(hit <= F.lit(max_coverage) * F.col(f"{out}.n_words"))
    cut = arrow_udf(_without, "string")(F.col(text_col), F.col(f"{out}.starts"), F.col(f"{out}.ends"))
    return kept.withColumn(text_col, cut).select(*[F.col(f"`{c}`") for c in docs.columns])
