"""Document fingerprints by winnowing.

Every run of ``k`` code points has a rolling hash; of ``window`` successive hashes the smallest is kept,
the rightmost of equal ones, with its position.  So any text of ``window + k - 1`` code points that two
documents share leaves at least one common hash in both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import id_ranges, range_count

_BASE, _MIX = 0x100000001B3, np.uint64(0x9E3779B97F4A7C15)
#: Grams handled at once; positions within such a stretch take 20 bits of a key, hashes 44.
_STRETCH = 1 << 19
_POSITION = np.uint64((1 << 20) - 1)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of each run of ``k`` codes, built by joining runs of doubling length."""
    joined, length, power = None, 0, codes.astype(np.uint64) + np.uint64(1)
    size = 1
    while True:
        if k & size:
            if joined is None:
                joined, length = power, size
            else:
                n = min(len(joined), len(power) - length)
                joined = joined[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + power[length : length + n]
                length += size
        if size * 2 > k:
            break
        power = power[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + power[size:]
        size *= 2
    mixed = joined * _MIX
    return (mixed ^ (mixed >> np.uint64(29))) * _MIX


def _window_minima(keys: np.ndarray, window: int) -> np.ndarray:
    """Smallest of each ``window`` successive keys."""
    size = 1
    while size * 2 <= window:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    rest = window - size
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def winnow(text: str | None, k: int = 16, window: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes (44 bits) and their positions, in order of position.

    A text shorter than ``k`` is one gram, fewer grams than ``window`` are one window; null and empty
    texts keep nothing.
    """
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    k = min(k, len(codes))
    window = min(window, len(codes) - k + 1)
    hashes, positions = [], []
    total = len(codes) - k + 1
    for at in range(0, total - window + 1, _STRETCH):
        part = codes[at : at + _STRETCH + window - 1 + k - 1]
        h = gram_hashes(part, k)
        # Ties go to the smaller key, which is the position further right.
        keys = (h & ~_POSITION) | (_POSITION - np.arange(len(h), dtype=np.uint64))
        least = _window_minima(keys, window)
        least = least[np.concatenate([[True], least[1:] != least[:-1]])]
        hashes.append(least >> np.uint64(20))
        positions.append((_POSITION - (least & _POSITION)).astype(np.int64) + at)
    h, p = np.concatenate(hashes), np.concatenate(positions)
    if len(hashes) > 1:
        p, first = np.unique(p, return_index=True)
        h = h[first]
    return h, p


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared distinct hashes over all distinct hashes; two texts without any are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def as_text(hashes: np.ndarray) -> str:
    """Eight hexadecimal digits for each kept hash, in order of position."""
    return (hashes >> np.uint64(12)).astype(">u4").tobytes().hex()


def fingerprint(k: int = 16, window: int = 32):
    """A column function: text to (hashes, positions)."""

    def of(texts: pa.Array) -> pa.Array:
        found = [winnow(t, k, window) for t in texts.to_pylist()]
        columns = [pa.array([f[i].astype(np.int64) for f in found], pa.list_(pa.int64())) for i in (0, 1)]
        return pa.StructArray.from_arrays(columns, names=["hashes", "positions"])

    return arrow_udf(of, "hashes array<long>, positions array<long>")


def fingerprints(docs: DataFrame, k: int = 16, window: int = 32, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the struct ``out`` (hashes, positions); every row and column stays."""
    return docs.withColumn(out, fingerprint(k, window)(F.col(text_col)))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, text, range, last) whose next document is the next row of the same range.

    Ranges of ids are put in order in parallel.  The first row of each range is also sent to the
    range before it, and the first of all to the last one, marked ``last``.  Null ids come first,
    rows with the same id are ordered by text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = range_count(spark)
    edges = np.asarray(id_ranges(rows, "doc_id", parts), dtype=np.int64)
    first = rows.agg(F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    low = None if first["nulls"] else first["low"]

    def places(ids: pa.Array) -> pa.Array:
        out = []
        for i in ids.to_pylist():
            at = 0 if i is None else int(np.searchsorted(edges, i, side="right"))
            mine = [2 * at]
            if at and i == edges[at - 1]:
                mine.append(2 * (at - 1) + 1)
            if i == low:
                mine.append(2 * len(edges) + 1)
            out.append(mine)
        return pa.array(out, pa.list_(pa.int32()))

    placed = rows.withColumn("place", F.explode(arrow_udf(places, "array<int>")(F.col("doc_id"))))
    placed = placed.select("doc_id", "text", F.expr("place div 2").cast("int").alias("range"), (F.col("place") % 2 == 1).alias("last"))
    return placed.repartition(parts // 4, "range").sortWithinPartitions("range", "last", "doc_id", "text")


EDITED = (
    "doc_id long, n_chars long, edited string, fingerprint string, hashes array<long>, positions array<long>, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def edited_likeness(docs: DataFrame, k: int = 16, window: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of the next document and of a text edited with it.

    The edit replaces the last half (rounded down) by the first as many code points of the next
    document in ascending id order, or all of them; after the last comes the first.  Null texts count as empty.  A
    single document is its own next one; no rows give none; other columns are left out.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch, out = whole.slice(at, 512), []
                for doc, text, place, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if place != current:
                        held, current = None, place
                    if last and held is None:
                        continue
                    hashes, positions = winnow(text, k, window)
                    if held is not None:
                        out.append(_edited(held, text, hashes, k, window))
                    held = None if last else (doc, text, hashes, positions)
                names = [c.split()[0] for c in EDITED.split(", ")]
                lists = pa.list_(pa.int64())
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), lists, lists, pa.string(), pa.float64(), pa.float64())
                yield pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)

    return with_next(docs, id_col, text_col).mapInArrow(compare, EDITED)


def _edited(held: tuple, other: str, other_hashes: np.ndarray, k: int, window: int) -> tuple:
    doc, text, hashes, positions = held
    half = len(text) // 2
    edited = text[: len(text) - half] + other[:half]
    edited_hashes, _ = winnow(edited, k, window)
    return (
        doc, len(text), edited, as_text(hashes), hashes.astype(np.int64), positions, as_text(edited_hashes),
        likeness(hashes, edited_hashes), likeness(hashes, other_hashes),
    )

