"""Packing documents into sequences of equal length by cutting-stock column generation.

Every document is encoded; stretches of a full sequence's length stand alone, and what remains is
an item.  The histogram of item lengths (in steps of ``quantum`` ids, so its size is bounded) is a
cutting-stock problem: a linear program over patterns of lengths, whose columns come from a
knapsack by dynamic programming.  Whole multiples of good patterns are handed to the items by
their rank within their length; what rounding leaves is laid end to end and cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .tokens import encoder

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, task int, size int, nth long"
PLACED = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, slot int"


def price(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the best worth of sizes 1..len(values) within ``capacity``, and how often each."""
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        sizes = min(room, len(values))
        worth = values[:sizes] + best[room - 1 :: -1][:sizes]
        k = int(np.argmax(worth))
        if worth[k] > best[room - 1] + 1e-12:
            best[room], last[room] = worth[k], k + 1
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(values), dtype=np.int64), capacity
    while room > 0:
        if last[room]:
            counts[last[room] - 1] += 1
            room -= last[room]
        else:
            room -= 1
    return float(best[capacity]), counts


def patterns(demand: np.ndarray, rounds: int = 20_000) -> list[tuple[np.ndarray, float]]:
    """Optimal fractional use of patterns for ``demand[i]`` items of size i + 1 and sequences of size len(demand).

    Primal simplex with generated columns; the basis has one row for each size in demand.
    """
    capacity = len(demand)
    sizes = np.flatnonzero(demand)
    if not len(sizes):
        return []
    columns = np.zeros((capacity, len(sizes)))
    columns[sizes, np.arange(len(sizes))] = capacity // (sizes + 1)
    basis = columns[sizes]
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ demand[sizes].astype(float)
    for _ in range(rounds):
        duals = np.zeros(capacity)
        duals[sizes] = inverse.sum(axis=0)
        worth, counts = price(np.maximum(duals, 0), capacity)
        counts[demand == 0] = 0
        if worth <= 1 + 1e-9:
            break
        change = inverse @ counts[sizes]
        up = change > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, change, 1), np.inf)
        out = int(np.argmin(ratio))
        x -= ratio[out] * change
        x[out] = ratio[out]
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
        columns[:, out] = counts
    return [(columns[:, j].astype(np.int64), float(max(x[j], 0))) for j in range(len(sizes))]


@dataclass
class Plan:
    """Where the r-th item of a size goes: patterns first, then the stretch laid end to end."""

    capacity: int
    quantum: int
    # by size: first rank, sequences before the pattern, items per sequence, first slot
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    in_patterns: dict[int, int]
    # by size: where its left-over items begin in the stretch, in ids rounded up to the quantum
    left_at: dict[int, int]
    pattern_sequences: int
    left_sequences: int


def plan(counts: dict[int, int], capacity: int, quantum: int, slack: int = 1) -> Plan:
    """Round the fractional solution down; patterns that leave over ``slack`` steps empty aren't used."""
    steps = capacity // quantum
    demand = np.zeros(steps, dtype=np.int64)
    for size, n in counts.items():
        demand[size - 1] = n
    unit = np.arange(1, steps + 1)
    used, sequences = np.zeros(steps, dtype=np.int64), 0
    by_size: dict[int, list] = {}
    for pattern, x in patterns(demand):
        n = int(x + 1e-7) if int(pattern @ unit) >= steps - slack else 0
        n = min([n, *((demand - used)[pattern > 0] // pattern[pattern > 0])])
        if n <= 0:
            continue
        slot = 0
        for i in np.flatnonzero(pattern):
            by_size.setdefault(int(i) + 1, []).append((int(used[i]), sequences, int(pattern[i]), slot))
            slot += int(pattern[i])
        used += pattern * int(n)
        sequences += int(n)
    left, left_at = 0, {}
    for i in np.flatnonzero(demand - used):
        left_at[int(i) + 1] = left
        left += int(demand[i] - used[i]) * (int(i) + 1) * quantum
    tables = {s: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for s, rows in by_size.items()}
    return Plan(capacity, quantum, tables, {int(i) + 1: int(used[i]) for i in np.flatnonzero(demand)}, left_at, sequences, -(-left // capacity))


def encode_pieces(
    docs: DataFrame, tokenizer: str, chunks: str | None, end_id: int, capacity: int, quantum: int, id_col: str, text_col: str
) -> DataFrame:
    """Full stretches (size 0) and one item per document, numbered within task and size."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer, chunks).encode, TaskContext.get().partitionId()
        end, seen = np.array([end_id], dtype="<u4").tobytes(), np.zeros(capacity // quantum + 1, dtype=np.int64)
        narrow = encoder(tokenizer, chunks).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                found = list(encode(batch.column("text").to_pylist()))
                total = np.array([len(f) // 4 + 1 for f in found], dtype=np.int64)
                ids = np.frombuffer(b"".join([x for f in found for x in (f, end)]), dtype="<u4")
                parts = -(-total // capacity)
                doc = np.repeat(np.arange(len(total)), parts)
                first = within(parts) * capacity
                length = np.minimum(capacity, total[doc] - first)
                size = np.where(length == capacity, 0, -(-length // quantum))
                # Numbers within each size go on from batch to batch.
                order = np.argsort(size, kind="stable")
                counts = np.bincount(size, minlength=len(seen))
                nth = np.empty(len(size), dtype=np.int64)
                nth[order] = within(counts) + np.repeat(seen, counts)
                seen += counts
                columns = [
                    batch.column("doc_id").take(pa.array(doc)), pa.array(first), pa.array(length), pa.array(total[doc]),
                    binaries(ids.astype("<u2") if narrow else ids, length), pa.array(np.full(len(doc), task, dtype=np.int32)),
                    pa.array(size.astype(np.int32)), pa.array(nth),
                ]
                yield pa.record_batch(columns, names=[c.split()[0] for c in PIECES.split(", ")])

    return rows.mapInArrow(cut, PIECES)


def within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, … inside each run of the given sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def binaries(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Successive runs of ``ids`` as binary values, without a copy of each."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]) * ids.itemsize
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)]
    return pa.Array.from_buffers(pa.binary(), len(lengths), buffers)


def place(pieces: DataFrame, made: Plan) -> DataFrame:
    """Sequence and slot of every piece; items that cross the end of a left-over sequence are cut there."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                start, length, total, size, rank = (
                    batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "length", "doc_tokens", "size", "rank")
                )
                sequence = made.pattern_sequences + made.left_sequences + rank
                slot, room = np.zeros(len(size), dtype=np.int64), length.copy()
                for s in np.unique(size[size > 0]).tolist():
                    fits = (size == s) & (rank < made.in_patterns[s])
                    if fits.any():
                        first, before, per, slots = made.by_size[s]
                        k = np.searchsorted(first, rank[fits], side="right") - 1
                        nth = rank[fits] - first[k]
                        sequence[fits], slot[fits] = before[k] + nth // per[k], slots[k] + nth % per[k]
                    left = (size == s) & ~fits
                    begin = made.left_at.get(s, 0) + (rank[left] - made.in_patterns[s]) * s * made.quantum
                    sequence[left], slot[left] = made.pattern_sequences + begin // made.capacity, begin % made.capacity
                    room[left] = np.minimum(length[left], made.capacity - begin % made.capacity)
                # Two parts of each piece, the second mostly empty; then the empty ones go.
                parts = np.stack([room, length - room], axis=1).ravel()
                kept = parts > 0
                row = np.repeat(np.arange(len(size)), 2)[kept]
                second = np.tile([0, 1], len(size))[kept]
                ids = batch.column("ids")
                data = b"".join(ids.to_pylist())
                flat = np.frombuffer(data, dtype=f"<u{len(data) // max(int(length.sum()), 1)}").astype("<u4")
                columns = [
                    batch.column("doc_id").take(pa.array(row)), pa.array(start[row] + second * room[row]), pa.array(parts[kept]),
                    pa.array(total[row]), binaries(flat, parts[kept]), pa.array(sequence[row] + second),
                    pa.array(np.where(second, 0, slot[row]).astype(np.int32)),
                ]
                yield pa.record_batch(columns, names=[c.split()[0] for c in PLACED.split(", ")])

    return pieces.mapInArrow(put, PLACED)


def pack(
    docs: DataFrame,
    tokenizer: str,
    chunks: str | None,
    end_id: int = 0,
    capacity: int = 1024,
    quantum: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    Every id of every row, and the end id after each, lies in one piece; ``ids`` are little-endian
    unsigned 32-bit numbers.  Null and empty texts hold the end id only.  Repeated rows are packed
    once each, null ids stay null, other columns are left out whatever their names, no rows give none.
    The driver sees the length histogram only (``capacity / quantum`` counts).
    """
    if capacity % quantum:
        raise ValueError("capacity must be a multiple of quantum")
    pieces = stage(encode_pieces(docs, tokenizer, chunks, end_id, capacity, quantum, id_col, text_col), "pieces")
    counts = stage(pieces.groupBy("size", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["size"]: r["n"] for r in counts.where("size > 0").groupBy("size").agg(F.sum("n").alias("n")).collect()}
    made = plan(histogram, capacity, quantum)
    before = F.sum("n").over(Window.partitionBy("size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stage(counts.select("size", "task", F.coalesce(before, F.lit(0)).alias("_before")), "piece-offsets")
    ranked = pieces.join(offsets, ["size", "task"]).select(
        "doc_id", "start", "length", "doc_tokens", "ids", "size", (F.col("_before") + F.col("nth")).alias("rank")
    )
    full = place(ranked.where("size = 0"), made).withColumn("offset", F.lit(0).cast("long"))
    # A sequence holds at most ``capacity`` pieces, so this window is bounded.
    order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    parts = place(ranked.where("size > 0"), made).withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
    return full.unionByName(parts).drop("slot")
