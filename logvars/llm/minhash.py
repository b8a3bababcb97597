"""Near duplicates: many universal hash minima, bands, signature and full-set verification, star components.

Equal shingle sets are one class from the start.  Classes that meet in a band are compared with a hub of
the band, which links most of a group of near copies without comparing all its pairs.  Classes joined
by bands are a cluster; where one still holds several components, the pairs across them that share a
band are compared in blocks of bounded size, and only what joins components leaves a block.  Every
link is confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import stage as write_stage
from .hmm import shuffles_end

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Minima kept for the signature, 16 bits each.
KEPT = 256
#: Orders by which bands choose their hub.
HUBS = 2
#: Members of a cluster in a block, and shingles in a block, about.
BLOCK, BLOCK_SHINGLES = 256, 1_000_000
#: Bits of the filter that keeps most texts that aren't wanted out of a shuffle; a fixed size.
FILTER_BITS = 1 << 25


def stage(df: DataFrame, name: str) -> DataFrame:
    """A written table, whose shuffle files go as soon as it is written."""
    with shuffles_end(df.sparkSession):
        return write_stage(df, name)


class _WordHashes(dict):
    """64-bit hashes of words; emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: dict, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``size`` words; fewer words are one run, none give none.

    Words are runs of other characters than ASCII white space, after A-Z become lower case.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.array([hashes[x] for x in words], dtype=np.uint64)
    n = max(1, len(w) - size + 1)
    total = np.full(n, min(size, len(w)), dtype=np.uint64)
    for i in range(min(size, len(w))):
        total = total * _MIX[0] + w[i : i + n]
    return np.unique(_mixed(total))


class Hashing:
    """``bands`` x ``rows`` minima of a*x + b over 64 bits, from a fixed seed."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20_240_501)
        n = max(bands * rows, KEPT)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        self.salt = np.arange(1, bands + 1, dtype=np.uint64) * _MIX[0]

    def minima(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        step, wide = 64, 512
        for at in range(0, len(x), wide):
            part = x[None, at : at + wide]
            for k in range(0, len(self.a), step):
                h = self.a[k : k + step, None] * part
                h += self.b[k : k + step, None]
                np.minimum(out[k : k + step], h.min(axis=1), out=out[k : k + step])
        return out >> np.uint64(32)

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band, different between bands."""
        rows = minima[: self.bands * self.rows].reshape(self.bands, self.rows)
        key = self.salt.copy()
        for r in range(self.rows):
            key = _mixed(key * _MIX[0] + rows[:, r])
        return key.view(np.int64)


def bands_for(threshold: float, rows: int, missed: float = 1e-6) -> int:
    """Bands so that a pair at the threshold meets in none with a chance of ``missed``."""
    return math.ceil(math.log(missed) / math.log(1 - threshold**rows))


def _prints(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, hashing = _WordHashes(), Hashing(bands, rows)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                counts, sums, mixes, keys, kept = [], [], [], [], []
                for text in batch.column("text").to_pylist():
                    x = shingles(text, hashes, size)
                    counts.append(len(x))
                    sums.append(int(x.sum().view(np.int64)) if len(x) else 0)
                    mixes.append(int(np.bitwise_xor.reduce(_mixed(x + _MIX[0])).view(np.int64)) if len(x) else 0)
                    minima = hashing.minima(x) if len(x) else None
                    keys.append(hashing.keys(minima) if len(x) else None)
                    kept.append(minima[:KEPT].astype("<u2").tobytes() if len(x) else None)
                longs = pa.int64()
                yield pa.record_batch(
                    [batch.column("doc_id"), pa.array(counts, longs), pa.array(sums, longs), pa.array(mixes, longs), pa.array(keys, pa.list_(longs)), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_shingles", "k1", "k2", "bands", "signature"],
                )

    schema = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, signature binary"
    return docs.mapInArrow(prints, schema)


def _filter_places(ids: np.ndarray) -> np.ndarray:
    """Three places of each id among the filter's bits."""
    x = ids.astype(np.int64).view(np.uint64)
    return np.stack([_mixed(x + _MIX[0] * np.uint64(i)) & np.uint64(FILTER_BITS - 1) for i in (1, 2, 3)])


def _wanted_filter(wanted: DataFrame) -> np.ndarray:
    """Bits set by the ids of ``wanted(id)``; the driver gets no more than the filter's size."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for batch in batches:
            for places in _filter_places(batch.column("id").to_numpy()):
                np.bitwise_or.at(bits, (places >> np.uint64(3)).astype(np.int64), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))
        words = bits.view(np.int64)
        used = np.flatnonzero(words)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(words[used])], names=["place", "bits"])

    words = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    found = wanted.select("id").mapInArrow(mark, "place int, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    words[found.column("place").to_numpy()] = found.column("bits").to_numpy()
    return words.view(np.uint8)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, set) of the documents whose ids are wanted.

    A fixed-size filter of the ids drops most other texts before the join, which decides.
    """
    bits = _wanted_filter(wanted)

    @arrow_udf("boolean")
    def may_be_wanted(ids: pa.Array) -> pa.Array:
        places = _filter_places(ids.fill_null(0).to_numpy(zero_copy_only=False))
        return pa.array((bits[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8) & 1).all(axis=0))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [np.sort(shingles(t, hashes, size).view(np.int64)) for t in batch.column("text").to_pylist()]
                yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], names=["id", "set"])

    chosen = docs.where(may_be_wanted("doc_id")).join(wanted.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return chosen.mapInArrow(build, "id long, set array<long>")


def _estimated(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Share of equal minima."""
    sides = [np.frombuffer(b"".join(s.to_pylist()), dtype="<u2").reshape(-1, KEPT) for s in (left, right)]
    return (sides[0] == sides[1]).mean(axis=1)


def _verified_by_signature(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                close = pa.array(_estimated(batch.column("sa"), batch.column("sb")) >= least)
                yield pa.record_batch([batch.column(c).filter(close) for c in ("a", "b")], names=["a", "b"])

    a = reps.select(F.col("cid").alias("a"), F.col("signature").alias("sa"))
    b = reps.select(F.col("cid").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long").distinct()


def _links(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that the signatures and then the full sets confirm."""
    close = stage(_verified_by_signature(pairs, reps, _least_estimate(percent)), "near-pairs")
    ids = close.select(F.col("a").alias("id")).union(close.select(F.col("b").alias("id"))).distinct()
    sets = stage(_sets(docs, ids, size), "near-sets")
    a = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    b = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    common = F.size(F.array_intersect("x", "y")).cast("long")
    counted = close.join(a, "a").join(b, "b").select("a", "b", (F.size("x") + F.size("y")).alias("both"), common.alias("common"))
    return stage(counted.where(100 * F.col("common") >= percent * (F.col("both") - F.col("common"))).select("a", "b").distinct(), "near-links")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def star_components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ids in ``edges(a, b)``; component is the smallest id reachable.

    Alternates large-star (larger neighbours go to the smallest one) and small-star (smaller
    neighbours and the node itself go to the smallest one) until nothing changes.  Each round is
    written.  Minima are aggregated before the shuffle, so a hub's neighbours are never one group.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stage(edges.where("a <> b").select(*_ordered(F.col("a"), F.col("b"))).distinct(), "stars")
    known = state(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large.where("u <> v"), "large-star")  # v < u in every row
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.m").alias("a"), F.col("e.v").alias("b")).where("a <> b").distinct()
        now = stage(small, "stars")
        before, known = known, state(now)
        if known == before:
            break
    found = now.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return found.union(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def _across(pairs: DataFrame, docs: DataFrame, reps: DataFrame, components: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components of one cluster, by comparing the members that share a band across components."""
    clusters = star_components(pairs).withColumnsRenamed({"id": "cid", "component": "cluster"})
    placed = clusters.join(components.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    placed = stage(placed, "cluster-members")
    lows = placed.groupBy("cluster").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m"))
    chosen = stage(placed.join(lows.where("low <> high and m > 2").select("cluster"), "cluster"), "open-members")
    sets = stage(_sets(docs, chosen.select(F.col("cid").alias("id")), size), "open-sets").withColumnRenamed("id", "cid")
    held = chosen.join(sets, "cid").groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum(F.size("set").cast("long")).alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("long")
    full = chosen.join(sets, "cid").join(reps, "cid").join(stage(held.select("cluster", blocks.alias("blocks")), "cluster-sizes"), "cluster")
    dealt = full.withColumn("block", F.pmod(F.xxhash64("cid"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "cid", "component", "signature", "bands", "set")
    least = _least_estimate(percent)

    def compare(table: pa.Table) -> pa.Table:
        a, b = _joining(table.combine_chunks(), percent, least)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("cluster", "b1", "b2").applyInArrow(compare, "a long, b long")


def _least_estimate(percent: int) -> float:
    """Five standard deviations of the estimate below the threshold."""
    t = percent / 100
    return t - 5 * math.sqrt(t * (1 - t) / KEPT)


def _joining(table: pa.Table, percent: int, least: float) -> tuple[list[int], list[int]]:
    """Links that join components, among the members of two blocks (or within one)."""
    column = {c: table.column(c).combine_chunks() for c in ("block", "b1", "b2", "cid", "component", "signature", "bands", "set")}
    block, ids = column["block"].to_numpy(), column["cid"].to_numpy()
    within = column["b1"][0] == column["b2"][0]
    signatures = np.frombuffer(b"".join(column["signature"].to_pylist()), dtype="<u2").reshape(-1, KEPT)
    bands = column["bands"].values.to_numpy().reshape(len(ids), -1)
    shingle, ends = column["set"].values.to_numpy(), column["set"].offsets.to_numpy()
    parent = {int(c): int(c) for c in column["component"].to_numpy()}
    component = column["component"].to_numpy()

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out_a, out_b = [], []
    for i in range(len(ids)):
        mine = shingle[ends[i] : ends[i + 1]]
        sizes = ends[i + 1 :] - ends[i:-1]
        top = sizes[0]
        later = np.arange(i + 1, len(ids))
        n = sizes[1:]
        near = (component[later] != component[i]) & (100 * np.minimum(n, top) >= percent * np.maximum(n, top))
        near &= True if within else block[later] != block[i]
        later = later[near]
        later = later[(bands[later] == bands[i]).any(axis=1)]
        later = later[(signatures[later] == signatures[i]).mean(axis=1) >= least]
        for j in later.tolist():
            ra, rb = root(int(component[i])), root(int(component[j]))
            if ra == rb:
                continue
            other = shingle[ends[j] : ends[j + 1]]
            at = np.searchsorted(mine, other)
            common = int((mine[np.minimum(at, len(mine) - 1)] == other).sum())
            if 100 * common >= percent * (len(mine) + len(other) - common):
                parent[max(ra, rb)] = min(ra, rb)
                out_a.append(min(int(ids[i]), int(ids[j])))
                out_b.append(max(int(ids[i]), int(ids[j])))
    return out_a, out_b


def near_duplicates(
    docs: DataFrame,
    percent: int = 80,
    size: int = 5,
    rows: int = 8,
    bands: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Two documents are linked if their sets of ``size``-word shingles share ``percent`` per cent of their
    union or more; a component's id is its smallest doc_id, and that document is kept.  Texts without
    words (null too) have no shingles and link with nothing.  Rows with one id count as one document,
    with the links of all its texts, and every such row gets a result.  Null ids: such a row joins
    documents with its very set only; among null ids alone, component_id is null and the row is kept.
    No rows give none; other columns are left out, whatever their names.
    """
    bands = bands or bands_for(percent / 100, rows)
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = stage(_prints(table, size, bands, rows), "prints")
    same_set = ["n_shingles", "k1", "k2"]
    classes = stage(prints.where("n_shingles > 0").groupBy(*same_set).agg(F.min("doc_id").alias("cid")), "set-classes")
    # Rows of a class other than its first document's: copies, mostly few beside the table.
    whole = prints.where("n_shingles > 0").select("doc_id", *same_set).join(classes, same_set)
    copies = stage(whole.where("not doc_id <=> cid").select("doc_id", *same_set), "copies")
    firsts = prints.where("n_shingles > 0 and doc_id is not null").join(copies, ["doc_id", *same_set], "left_anti")
    reps = stage(firsts.select(F.col("doc_id").alias("cid"), "bands", "signature"), "class-prints")
    keyed = reps.select("cid", F.explode("bands").alias("key"))
    seed = F.pmod(F.col("key"), F.lit(HUBS))
    first = F.min(F.struct(F.xxhash64("cid", seed).alias("h"), F.col("cid").alias("hub"))).alias("first")
    hubs = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1").select("key", F.col("first.hub").alias("hub"))
    met = keyed.join(stage(hubs, "band-hubs"), "key").where("cid <> hub")
    pairs = stage(met.select(*_ordered(F.col("cid"), F.col("hub"))).distinct(), "hub-pairs")
    links = _links(pairs, table, reps, size, percent)
    components = stage(star_components(links), "components")
    more = stage(_across(pairs, table, reps, components, size, percent), "across-links")
    if not more.isEmpty():
        stars = components.select(F.col("component").alias("a"), F.col("id").alias("b"))
        components = stage(star_components(stars.union(more)), "components")
    labelled = classes.join(components.withColumnRenamed("id", "cid"), "cid", "left").select(*same_set, F.coalesce("component", "cid").alias("component"))
    found = prints.select("doc_id", *same_set).join(stage(labelled, "class-components"), same_set, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull(), F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each group of near duplicates, with all its columns.

    The document with the smallest id stays.  Of rows with one id, one stays (that whose text hashes
    lowest); rows without an id stay.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **how)
    found = stage(found.select("doc_id", "kept"), "kept")
    drop = found.where("not kept and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    repeated = stage(found.where("doc_id is not null").groupBy(F.col("doc_id").alias(id_col)).count().where("count > 1").select(id_col), "repeated-ids")
    left = docs.join(drop, id_col, "left_anti").select(*docs.columns)
    once = left.join(repeated, id_col, "left_anti").select(*docs.columns)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = left.join(repeated, id_col, "left_semi").groupBy(id_col).agg(F.min_by(whole, F.xxhash64(text_col)).alias("_row"))
    return once.unionByName(again.select("_row.*"))
