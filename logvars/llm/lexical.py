"""Ranked lexical search turned round: the queries are indexed, the documents are streamed past them.

The items' terms form an inverted index that each worker holds.  A document's term counts are looked up in
it, which gives its scores for all items at once; every task keeps a bounded heap for each item, and the
heaps are merged.  Items come in blocks of bounded size, so the index is bounded however many items there are.

Scores are integers: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a document's part in it
(10^9 tf) div (1000 tf + 12 m) with m = 100 - 25 + (25 n N) div L, for N documents with terms and L terms in
all, n terms in the document, tf of them this one, and df documents that hold it.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .decontaminate import words

_SEPARATOR = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Characters of a text whose terms are held at once, cells of the score table, and postings added at once.
PIECE, CELLS, ADDED = 4_000_000, 2_000_000, 2_000_000
COUNTED = "doc_id long, n long, terms array<int>, counts array<int>"
BEST = "item int, doc_id long, score long"
_LAST = np.iinfo(np.int64).max


def term_lists(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in order, in lists of bounded size; terms are cut at ASCII other than letters and digits."""
    text = text or ""
    at = 0
    while at < len(text):
        stop = at + PIECE
        if stop < len(text):
            cut = _SEPARATOR.search(text, stop)
            stop = cut.start() if cut else len(text)
        yield words(text[at:stop])
        at = stop


class ItemIndex:
    """Inverted index of one block of items: for each term the items that hold it, and how often."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        counts: dict[int, Counter] = {}
        for item, terms in items:
            counts.setdefault(item, Counter()).update(terms)
        self.items = sorted(counts)
        postings: dict[bytes, list[tuple[int, int]]] = {}
        for at, item in enumerate(self.items):
            for term, n in counts[item].items():
                postings.setdefault(term, []).append((at, n))
        self.numbers = {term: i for i, term in enumerate(postings)}
        sizes = np.array([len(p) for p in postings.values()], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        held = np.array([x for p in postings.values() for x in p], dtype=np.int64).reshape(-1, 2)
        self.holders, self.times = held[:, 0].copy(), held[:, 1].copy()

    def count(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
        """All terms of a text, and those of the index with their counts."""
        total, known, counts = 0, np.empty(0, np.int64), np.empty(0, np.int64)
        number = self.numbers.get
        for part in term_lists(text):
            total += len(part)
            found = np.array([i for i in map(number, part) if i is not None], dtype=np.int64)
            terms, n = np.unique(found, return_counts=True)
            if len(known):
                terms, n = np.concatenate([known, terms]), np.concatenate([counts, n])
                terms, back = np.unique(terms, return_inverse=True)
                n = np.bincount(back, weights=n).astype(np.int64)
            known, counts = terms, n
        return total, known, counts


def _count_batches(index):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, int(whole.num_rows * PIECE / max(whole.nbytes, 1)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                found = [index.value.count(t) for t in batch.column(1).to_pylist()]
                offsets = pa.array(np.cumsum([0, *(len(terms) for _, terms, _ in found)]), pa.int32())
                lists = [
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[i] for f in found]), pa.int32())) for i in (1, 2)
                ]
                made = pa.record_batch([batch.column(0), pa.array([n for n, _, _ in found], pa.int64()), *lists], names=_names(COUNTED))
                yield made.filter(pa.array([n > 0 for n, _, _ in found]))

    return count


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of the documents of one task."""
    seen = np.zeros(0, dtype=np.int64)
    for batch in batches:
        here = np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False))
        if len(here) > len(seen):
            seen, here = here, seen
        seen[: len(here)] += here
    terms = np.flatnonzero(seen)
    yield pa.record_batch([pa.array(terms, pa.int32()), pa.array(seen[terms], pa.int64())], names=["term", "df"])


class Heaps:
    """The ``k`` best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        # What a document must pass: a score above ``least``, or that score and an id below ``last``.
        self.least = np.zeros(items, dtype=np.int64)
        self.last = np.full(items, np.iinfo(np.int64).min)

    def update(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Offer documents to all items; ``scores`` has a row for each document."""
        passing = (scores > self.least) | ((scores == self.least) & (ids[:, None] < self.last))
        rows, items = np.nonzero(passing)
        for doc, item, score in zip(ids[rows].tolist(), items.tolist(), scores[rows, items].tolist(), strict=True):
            heap, entry = self.heaps[item], (score, -doc)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        for item in np.unique(items).tolist():
            heap = self.heaps[item]
            if len(heap) == self.k:
                self.least[item], self.last[item] = heap[0][0], -heap[0][1]


def _expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, … of each run."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _rank_batches(index, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Documents to (item, doc_id, score): the best of each item among the rows of one task."""

    def scores_of(n: np.ndarray, owners: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        found = index.value
        m = 100 - 25 + (25 * n * n_docs) // n_terms
        parts = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 12 * m[owners]))
        begins, sizes = found.starts[terms], found.starts[terms + 1] - found.starts[terms]
        places = _expanded(begins, sizes)
        cells = np.repeat(owners * len(found.items), sizes) + found.holders[places]
        table = np.zeros(len(n) * len(found.items), dtype=np.int64)
        np.add.at(table, cells, np.repeat(parts, sizes) * found.times[places])
        return table.reshape(len(n), -1)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        heaps = Heaps(len(found.items), k)
        for batch in batches:
            # A null id counts as the greatest.
            ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
            n = batch.column(1).to_numpy(zero_copy_only=False)
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            terms = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            work = np.concatenate([[0], np.cumsum(found.starts[terms + 1] - found.starts[terms])])[ends]
            at = 0
            while at < len(ids):
                done = work[at - 1] if at else 0
                stop = max(at + 1, min(at + max(1, CELLS // len(found.items)), int(np.searchsorted(work, done + ADDED, side="right"))))
                part = slice(ends[at] - sizes[at], ends[stop - 1])
                owners = np.repeat(np.arange(stop - at), sizes[at:stop])
                heaps.update(ids[at:stop], scores_of(n[at:stop], owners, terms[part], counts[part]))
                at = stop
        rows = [(item, -key, score) for item, heap in enumerate(heaps.heaps) for score, key in heap]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        docs = pa.array([None if d == _LAST else d for d in columns[1]], pa.int64())
        yield pa.record_batch([pa.array(columns[0], pa.int32()), docs, pa.array(columns[2], pa.int64())], names=_names(BEST))

    return rank


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _merged(best: DataFrame, k: int) -> DataFrame:
    """The best of each item over all tasks: first within bundles of tasks, so that no item's rows meet at once."""
    bundles = int(best.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    bundled = best.withColumn("_bundle", F.pmod(F.spark_partition_id(), F.lit(bundles)))
    within = Window.partitionBy("item", "_bundle").orderBy(*order)
    short = bundled.withColumn("_r", F.row_number().over(within)).where(F.col("_r") <= k).drop("_r", "_bundle")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return short.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def indexes(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[ItemIndex]:
    """Indexes of blocks of items, of about ``block_words`` words at most or of a single longer item."""
    text = F.col(text_col)
    rows = items.where(text.isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("item"), text.alias("text")).distinct()
    sized = stage(rows.withColumn("n", F.length("text")), "search-items")
    total = sized.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // (6 * block_words)))
    for block in range(blocks):
        held = sized.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "text").collect()
        found = [(r["item"], [t for part in term_lists(r["text"]) for t in part]) for r in held]
        if any(terms for _, terms in found):
            yield ItemIndex([(item, terms) for item, terms in found if terms])


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = 500_000,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 for each item.

    Equal scores are ranked by ascending id, null ids last.  Repeated document rows are ranked each.
    Items without id or terms find nothing; rows of items with the same id and different texts are one
    item.  Null and empty texts have no terms and count for nothing.  No documents or items give no rows.
    Terms are counted once for each block of items and written; the driver holds one block's index and
    the frequencies of its terms.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = []
    for index in indexes(items, item_id_col, item_text_col, block_words):
        held = spark.sparkContext.broadcast(index)
        counted = stage(texts.mapInArrow(_count_batches(held), COUNTED), "search-terms")
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        seen = counted.select("terms").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
        weights = np.zeros(len(index.numbers), dtype=np.int64)
        for r in seen.collect():
            weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
        best = _merged(counted.mapInArrow(_rank_batches(held, weights, n_docs, n_terms, k), BEST), k)
        names = spark.createDataFrame(list(enumerate(index.items)), "item int, item_id long")
        found.append(stage(best.join(names, "item").select("item_id", "rank", "doc_id", "score"), "search-block"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole
