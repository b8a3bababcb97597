"""K-d tree shards: nodes are cut at distributed weighted medians along their widest dimension.

The points are groups of equal texts, weighed by their bytes, in three metadata dimensions: length,
language, source.  Each dimension orders points by its value and then by the text's hash, so a cut
falls inside a value without parting equal texts.  Only a group that alone weighs more than a set
share of a shard is dealt into slices that a cut may part.  All nodes of a level are cut together: a
histogram of weights over key ranges, narrowed round the wanted weight until it is fine enough.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

_VALUE_BITS, _HASH_BITS, _SLICE_BITS = 20, 31, 12
_BINS = 1024
DIMENSIONS = ("k_length", "k_lang", "k_source")


@dataclass
class Node:
    """A part of the tree: so many leaves from shard ``first`` on."""

    first: int
    leaves: int
    dimension: str | None = None
    cut: int = 0
    left: Node | None = None
    right: Node | None = None
    # While it is being cut: where the cut may lie, what weighs less, and the weight wanted below the cut.
    low: int = 0
    high: int = 0
    below: int = 0
    wanted: float = 0

    def leaf_of(self, keys: dict[str, np.ndarray]) -> np.ndarray:
        """The first shard of the leaf or open node that each row falls into."""
        if self.left is None or self.right is None:
            return np.full(len(keys[DIMENSIONS[0]]), self.first, dtype=np.int32)
        out = np.empty(len(keys[DIMENSIONS[0]]), dtype=np.int32)
        left = keys[self.dimension] < self.cut
        for side, child in ((left, self.left), (~left, self.right)):
            out[side] = child.leaf_of({d: k[side] for d, k in keys.items()})
        return out


def _units(rows: DataFrame, target: float, part: float) -> tuple[DataFrame, DataFrame]:
    """(rows with their slice, units): a unit is a group of equal texts, or a slice of a heavy group."""
    key = ["h", "crc", "size"]
    groups = rows.groupBy(*key).agg(F.sum("size").alias("w"), F.min("lang").alias("g_lang"), F.min("source").alias("g_source"))
    heavy = stage(groups.where(F.col("w") > part * target), "heavy-groups")
    # No more than (shards / part) groups can be so heavy, so this side's size is bounded.
    slices = F.least(F.ceil(F.col("w") / (part * target)), F.lit(1 << _SLICE_BITS)).cast("long")
    marked = rows.join(F.broadcast(heavy.withColumn("slices", slices).drop("w")), key, "left")
    slice_of = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("slices")), F.lit(0))
    marked = marked.select("doc_id", *key, "lang", "source", "g_lang", "g_source", slice_of.alias("slice"))
    units = marked.groupBy(*key, "slice").agg(
        F.sum("size").alias("w"),
        F.coalesce(F.first("g_lang"), F.min("lang"), F.lit("")).alias("lang"),
        F.coalesce(F.first("g_source"), F.min("source"), F.lit("")).alias("source"),
    )
    return marked, units


def _key(value: Column) -> Column:
    tie = F.shiftleft(F.col("h").bitwiseAND(F.lit((1 << _HASH_BITS) - 1)), _SLICE_BITS).bitwiseOR(F.col("slice"))
    return F.shiftleft(value.cast("long"), _HASH_BITS + _SLICE_BITS).bitwiseOR(tie)


def _keyed(units: DataFrame) -> DataFrame:
    top = (1 << _VALUE_BITS) - 1
    length = F.least(F.floor(F.log2(F.col("size") + 1) * (1 << (_VALUE_BITS - 6))), F.lit(top))
    scattered = {c: F.shiftrightunsigned(F.xxhash64(c), 64 - _VALUE_BITS) for c in ("lang", "source")}
    return units.select(
        "h", "crc", "size", "slice", "w",
        _key(length).alias("k_length"), _key(scattered["lang"]).alias("k_lang"), _key(scattered["source"]).alias("k_source"),
    )


def _summed(units: DataFrame, of: Callable, schema: str) -> DataFrame:
    """``of`` (keys by dimension, weights) for every batch; its rows are summed up by the caller's aggregate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = of({d: batch.column(d).to_numpy() for d in DIMENSIONS}, batch.column("w").to_numpy())
            yield pa.record_batch([pa.array(c) for c in found.values()], names=list(found))

    return units.select(*DIMENSIONS, "w").mapInArrow(run, schema)


def _extents(units: DataFrame, tree: Node) -> dict[int, dict]:
    """Weight and the lowest and highest key of each dimension, by node."""

    def extents(keys: dict[str, np.ndarray], w: np.ndarray) -> dict[str, np.ndarray]:
        leaf = tree.leaf_of(keys)
        nodes, at = np.unique(leaf, return_inverse=True)
        out = {"node": nodes, "w": np.zeros(len(nodes), np.int64)}
        np.add.at(out["w"], at, w)
        for d in DIMENSIONS:
            out[f"low_{d}"] = np.full(len(nodes), np.iinfo(np.int64).max)
            out[f"high_{d}"] = np.full(len(nodes), np.iinfo(np.int64).min)
            np.minimum.at(out[f"low_{d}"], at, keys[d])
            np.maximum.at(out[f"high_{d}"], at, keys[d])
        return out

    names = [f"{side}_{d}" for d in DIMENSIONS for side in ("low", "high")]
    found = _summed(units, extents, "node int, w long, " + ", ".join(f"{n} long" for n in names))
    merged = found.groupBy("node").agg(F.sum("w").alias("w"), *[(F.min if n.startswith("low") else F.max)(n).alias(n) for n in names])
    return {r["node"]: r.asDict() for r in merged.collect()}


def _open(units: DataFrame, nodes: list[Node], tree: Node, spans: dict[str, int]) -> None:
    """Choose each node's widest dimension and the range of keys in which its cut lies."""
    found, shift = _extents(units, tree), _HASH_BITS + _SLICE_BITS
    if not spans:
        spans |= {d: max([1, *((r[f"high_{d}"] >> shift) - (r[f"low_{d}"] >> shift) for r in found.values())]) for d in DIMENSIONS}
    for node in nodes:
        r = found.get(node.first)
        if r is None:  # more leaves than points: everything there is lies on the left
            node.dimension, node.low, node.high, node.wanted = DIMENSIONS[0], 0, 1, 0
            continue
        width = {d: ((r[f"high_{d}"] >> shift) - (r[f"low_{d}"] >> shift)) / spans[d] for d in DIMENSIONS}
        node.dimension = max(DIMENSIONS, key=lambda d: width[d])
        node.low, node.high = r[f"low_{node.dimension}"], r[f"high_{node.dimension}"] + 1
        node.wanted, node.below = r["w"] * (node.leaves // 2) / node.leaves, 0


def _narrow(units: DataFrame, nodes: list[Node], tree: Node, fine: float) -> list[Node]:
    """One histogram over the open ranges; the nodes whose cut is not yet found to within ``fine``."""

    def histogram(keys: dict[str, np.ndarray], w: np.ndarray) -> dict[str, np.ndarray]:
        leaf, rows = tree.leaf_of(keys), []
        for n in nodes:
            key = keys[n.dimension]
            inside = (leaf == n.first) & (key >= n.low) & (key < n.high)
            bins, at = np.unique((key[inside] - n.low) // -(-(n.high - n.low) // _BINS), return_inverse=True)
            weights = np.zeros(len(bins), np.int64)
            np.add.at(weights, at, w[inside])
            rows.append((np.full(len(bins), n.first, np.int32), bins.astype(np.int64), weights))
        return {c: np.concatenate([r[i] for r in rows]) for i, c in enumerate(("node", "bin", "w"))}

    found = _summed(units, histogram, "node int, bin long, w long").groupBy("node", "bin").agg(F.sum("w").alias("w"))
    by_node: dict[int, list] = {}
    for r in sorted(found.collect(), key=lambda r: r["bin"]):
        by_node.setdefault(r["node"], []).append((r["bin"], r["w"]))
    still = []
    for n in nodes:
        width = -(-(n.high - n.low) // _BINS)
        n.cut = n.high
        for number, weight in by_node.get(n.first, []):
            if n.below + weight < n.wanted:
                n.below += weight
                continue
            low, high = n.low + number * width, min(n.high, n.low + (number + 1) * width)
            if width > 1 and weight > fine:
                n.low, n.high = low, high
                still.append(n)
            else:  # the nearer edge
                n.cut = high if n.below + weight - n.wanted < n.wanted - n.below else low
            break
    return still


def _tree(units: DataFrame, shards: int, fine: float) -> Node:
    tree, spans = Node(0, shards), {}
    level = [tree] if shards > 1 else []
    while level:
        _open(units, level, tree, spans)
        waiting = level
        while waiting:
            waiting = _narrow(units, waiting, tree, fine)
        for n in level:
            half = n.leaves // 2
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.leaves - half)
        level = [c for n in level for c in (n.left, n.right) if c.leaves > 1]
    return tree


def _leaves(units: DataFrame, tree: Node) -> DataFrame:
    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = tree.leaf_of({d: batch.column(d).to_numpy() for d in DIMENSIONS})
            yield pa.record_batch([*(batch.column(c) for c in ("h", "crc", "size", "slice")), pa.array(shard)], names=["h", "crc", "size", "slice", "shard"])

    return units.mapInArrow(leaves, "h long, crc long, size long, slice long, shard int")


def _with_slots(placed: DataFrame, rows: int) -> DataFrame:
    """Gapless numbers within each shard: by bucket in parallel, plus the rows of the buckets before."""
    buckets = max(1, math.isqrt(rows // 64))
    dealt = placed.withColumn("bucket", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(buckets)))
    counts = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stage(counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before")), "slots")
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "h")) - 1
    return dealt.withColumn("within", within).join(offsets, ["shard", "bucket"]).withColumn("slot", F.col("before") + F.col("within"))


def shard(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    overhead: int = 16,
    part: float = 0.002,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row; shards of nearly equal bytes.

    Give the number of shards, or the bytes that a shard should hold.  A row's size is its text's UTF-8
    bytes plus ``overhead``; a null text counts as empty.  Equal texts share a shard unless together they
    exceed ``part`` of a shard and a cut meets them.  Null languages and sources count as ''; null ids and
    repeated rows are placed like others; no rows give none.  ``slot`` is gapless from 0 in each shard.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.length(text) + overhead).cast("long").alias("size"),
            F.crc32(text).alias("crc"),
            F.xxhash64(text).alias("h"),
            F.col(lang_col).cast("string").alias("lang"),
            F.col(source_col).cast("string").alias("source"),
        ),
        "sizes",
    )
    whole = rows.agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).first()
    total = whole["w"] or 0
    if shards is None:
        if not target_bytes:
            raise ValueError("give shards or target_bytes")
        shards = max(1, math.ceil(total / target_bytes))
    target = max(1.0, total / shards)
    marked, units = _units(rows, target, part)
    units = stage(_keyed(units), "units")
    tree = _tree(units, shards, fine=part * target / 4)
    placed = marked.join(_leaves(units, tree), ["h", "crc", "size", "slice"])
    placed = stage(placed.select("doc_id", "size", "crc", "h", "shard"), "shards")
    return _with_slots(placed, whole["n"]).select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot"))
