"""A hidden Markov language model, trained by Baum-Welch over all partitions.

Latent states emit words.  Workers hold the emissions of the ``head`` most frequent ones; those of all
other words seen often enough (the middle) are a distributed table of expected counts, summed by the
executors in each round, whose rows reach the documents by a join.  Only rare and unknown words share
symbols by their last bytes, each with the part that its corpus count has in its symbol.  A text's
probability is the exact forward recursion over all of its words.
"""

from __future__ import annotations

import contextlib
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logvars.operators.staging import run_folder

from .common import shared_dir, stage

TAILS = 1024
#: Symbols in a stretch of a training text; stretches of all texts cover every symbol.
STRETCH = 512
#: Texts and symbols of a block, about; a longer text is a block of its own.
BLOCK_TEXTS, BLOCK_SYMBOLS = 128, 1 << 16
#: Symbols worked on at once, about.
AT_ONCE = 1 << 18
#: Expected counts of the middle's words are summed in whole numbers of so many parts, mostly zeros, which compress well.
UNITS = 1 << 16
#: Shares by state of the middle's words travel as numbers of so many bits, three in a long.
BITS = 21
#: Frequent symbols whose shares part the texts for the first counts.
SHOWN = 128
BLOCKS = "block long, doc_id array<long>, held_out boolean, lengths array<int>, symbols binary, tails binary, words array<string>"


def words(text: str | None) -> list[bytes]:
    """Runs of other bytes than ASCII white space, after A-Z become lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def tail_symbol(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAILS


def word_counts(docs: DataFrame, text_col: str = "text", waiting: int = 400_000) -> DataFrame:
    """(word, tail, n) over all texts: counted within tasks, then summed by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def batch() -> pa.RecordBatch:
            found = list(counts)
            columns = [pa.array([w.decode("utf-8", "replace") for w in found], pa.string()), pa.array([tail_symbol(w) for w in found], pa.int32()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.record_batch(columns, names=["word", "tail", "n"])

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                for text in whole.column("text").slice(at, 256).to_pylist():
                    counts.update(words(text))
                if len(counts) > waiting:
                    yield batch()
        yield batch()

    partial = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, tail int, n long")
    return partial.groupBy("word", "tail").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """The frequent words (symbol 0 is the end of a text) and what the others weigh.

    Weights are counts + 0.5; the middle are the words that are seen ``least`` times but are not in the head.
    """

    words: list[str]
    counts: np.ndarray  # of the end and the frequent words
    tokens: int  # N
    distinct: int  # V
    tail_total: np.ndarray  # by tail symbol, of words seen less than ``least`` times: tokens + (words + 1) / 2
    least: int
    lowest: int | None  # level of the last of the head
    middle: int  # words
    middle_total: float

    @property
    def symbols(self) -> int:
        return len(self.counts) + TAILS

    def numbers(self) -> dict[bytes, int]:
        return {w.encode(): i + 1 for i, w in enumerate(self.words)}

    def base_total(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    def weight(self) -> float:
        return float((self.counts + 0.5).sum() + self.tail_total.sum() + self.middle_total)

    def common(self) -> np.ndarray:
        """Share of each symbol; what is missing to 1 is the share of the middle."""
        return np.concatenate([self.counts + 0.5, self.tail_total]) / self.weight()

    def in_middle(self) -> Column:
        seen = F.col("n") >= self.least
        return seen if self.lowest is None else seen & (_level() < self.lowest)


def _level() -> Column:
    return F.floor(F.log2("n") * 256).cast("int")


def lexicon(counts: DataFrame, texts: int, head: int, least: int = 4) -> Lexicon:
    """At most ``head`` words, the most frequent; the driver gets these, ``TAILS`` sums and a histogram of bounded size.

    Words with nearly equal counts go to the head or the middle together.  Words seen less than ``least``
    times are the tail, whose symbols so learn what new words are like.
    """
    if head + 1 + TAILS > 1 << 16:
        raise ValueError("symbols must fit in 16 bits")
    frequent = counts.where(F.col("n") >= least).withColumn("level", _level())
    room, lowest = head, None
    for r in sorted(frequent.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        room -= r["count"]
        if room < 0:
            break
        lowest = r["level"]
    chosen = frequent.where(F.col("level") >= lowest).select("word", "n").collect() if lowest is not None else []
    top = sorted(((r["word"], r["n"]) for r in chosen), key=lambda x: (-x[1], x[0]))
    rare = F.col("n") < least
    sums = counts.groupBy("tail").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("v"),
        F.coalesce(F.sum(F.when(rare, F.col("n"))), F.lit(0)).alias("rare_n"),
        F.count(F.when(rare, 1)).alias("rare_v"),
    )
    sums = {r["tail"]: r for r in sums.collect()}
    tokens = texts + sum(r["n"] for r in sums.values())
    distinct = sum(r["v"] for r in sums.values()) + (texts > 0)
    total = np.array([sums[t]["rare_n"] + 0.5 * (sums[t]["rare_v"] + 1) if t in sums else 0.5 for t in range(TAILS)])
    middle = sum(r["v"] - r["rare_v"] for r in sums.values()) - len(top)
    middle_total = sum(r["n"] - r["rare_n"] for r in sums.values()) - sum(n for _, n in top) + 0.5 * middle
    return Lexicon(
        [w for w, _ in top], np.array([texts, *(n for _, n in top)], dtype=np.int64), tokens, distinct, total, least, lowest, middle, middle_total
    )


def sequences(docs: DataFrame, held_out: Column, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of texts: the symbols of all (32 bits each, every text's end last), and the different words outside the head.

    From ``lex.symbols`` on, symbols number these words; ``tails`` are their tail symbols.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    symbols = lex.symbols

    class Block:
        def __init__(self):
            self.ids, self.codes, self.lengths, self.own, self.n = [], [], [], {}, 0

        def add(self, doc_id: int | None, text: str | None, numbers: dict) -> None:
            own = self.own
            codes = [numbers[w] if w in numbers else symbols + own.setdefault(w, len(own)) for w in words(text)]
            codes.append(0)
            self.ids.append(doc_id)
            self.codes.append(np.array(codes, dtype="<i4"))
            self.lengths.append(len(codes))
            self.n += len(codes)

        def row(self, number: int, held: bool) -> pa.RecordBatch:
            tails = np.array([tail_symbol(w) for w in self.own], dtype="<u2").tobytes()
            found = [w.decode("utf-8", "replace") for w in self.own]
            columns = [
                pa.array([number], pa.int64()),
                pa.array([self.ids], pa.list_(pa.int64())),
                pa.array([held]),
                pa.array([self.lengths], pa.list_(pa.int32())),
                pa.array([np.concatenate(self.codes).tobytes()], pa.binary()),
                pa.array([tails], pa.binary()),
                pa.array([found], pa.list_(pa.string())),
            ]
            return pa.record_batch(columns, names=[c.split()[0] for c in BLOCKS.split(", ")])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, number = lex.numbers(), TaskContext.get().partitionId() << 33
        waiting = {True: Block(), False: Block()}
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                for doc_id, held, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
                    block = waiting[held]
                    block.add(doc_id, text, numbers)
                    if len(block.ids) >= BLOCK_TEXTS or block.n >= BLOCK_SYMBOLS:
                        yield block.row(number, held)
                        number, waiting[held] = number + 1, Block()
        for held, block in waiting.items():
            if block.ids:
                yield block.row(number, held)
                number += 1

    return rows.mapInArrow(encode, BLOCKS)


def in_buckets(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Written once, in buckets by ``key``, so that a join by it moves only its other side."""
    spark = rows.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.repartition(parts, key).write.format("parquet").bucketBy(parts, key)
    with shuffles_end(spark):
        writer.option("path", f"{shared_dir(spark).rstrip('/')}/logvars-{name}").saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"drop table {name}")  # from the catalog; the files stay like those of other stages
    return written


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written in here go when it is written, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


PACKED = "block long, held_out boolean, middle binary, rare binary"
#: A word of the middle and a rarer one in their binary columns.
MIDDLE, RARE = np.dtype([("place", "<i4"), ("n", "<i8"), ("number", "<i8")]), np.dtype([("place", "<i4"), ("n", "<i4")])


def _known_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PACKED.split(", ")]
    for batch in batches:
        columns = {"middle": [], "rare": []}
        for i in range(batch.num_rows):
            known = _rows_of(batch.column("known"), i)
            place, n, number = (_field(known, c) for c in ("place", "n", "number"))
            order = np.argsort(place)
            for name, kind, at in (("middle", MIDDLE, order[number[order] >= 0]), ("rare", RARE, order[number[order] < 0])):
                rows = np.empty(len(at), dtype=kind)
                rows["place"], rows["n"] = place[at], n[at]
                if name == "middle":
                    rows["number"] = number[at]
                columns[name].append(rows.tobytes())
        yield pa.record_batch([pa.array(columns[c], pa.binary()) if c in columns else batch.column(c) for c in names], names=names)


def _middle_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.frombuffer(m, dtype=MIDDLE) for m in batch.column("middle").to_pylist()]
        sizes = [len(f) for f in found]
        every = np.concatenate(found) if found else np.empty(0, dtype=MIDDLE)
        columns = [every["number"], np.repeat(batch.column("block").to_numpy(), sizes), np.repeat(batch.column("held_out").to_numpy(zero_copy_only=False), sizes), every["place"]]
        yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], names=["number", "block", "held_out", "place"])


def with_counts(blocks: DataFrame, counts: DataFrame, lex: Lexicon) -> tuple[DataFrame, DataFrame]:
    """``blocks`` (in buckets) with the counts of their words that training texts hold, and the places of the middle's words.

    Words meet their counts once, here; from then on a word of the middle is a number.  No word outside
    the head is more frequent than the last of the head, so no key of the joins is hot.
    """
    places = blocks.select("block", F.posexplode("words").alias("place", "word"))
    number = F.when(lex.in_middle(), F.col("number")).otherwise(F.lit(-1).cast("long")).alias("number")
    found = places.join(counts.select("word", "n", number), "word")
    known = found.groupBy("block").agg(F.collect_list(F.struct("place", "n", "number")).alias("known"))
    packed = blocks.select("block", "held_out").join(known, "block", "left").mapInArrow(_known_packed, PACKED)
    packed = in_buckets(packed, "block", "known_words")
    coded = blocks.drop("words").join(packed.drop("held_out"), "block")
    middle = packed.select("block", "held_out", "middle").mapInArrow(_middle_places, "number long, block long, held_out boolean, place int")
    return coded, in_buckets(middle, "number", "middle_places") if lex.middle else middle


def with_own(coded: DataFrame, places: DataFrame, table: DataFrame, lex: Lexicon) -> DataFrame:
    """``coded`` and, as ``own``, the packed shares of ``table`` for the middle's words in each block."""
    packed = [c for c in table.columns if c.startswith("q")]
    if not lex.middle:
        return coded.withColumn("own", F.lit(None).cast("array<struct<place: int, " + ", ".join(f"{c}: bigint" for c in packed) + ">>"))
    found = places.join(table, "number").groupBy("block").agg(F.collect_list(F.struct("place", *packed)).alias("own"))
    return coded.join(found, "block", "left")


def _parts(states: int) -> int:
    return -(-states // 3)


def _packed(names: list[str]) -> list[Column]:
    """Columns of counts by state as shares of their sum, three of BITS bits in a long."""
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    units = [F.coalesce(F.round(F.col(c) / total * ((1 << BITS) - 1)).cast("long"), F.lit(0).cast("long")) for c in names]
    out = []
    for k in range(_parts(len(names))):
        three = units[3 * k : 3 * k + 3]
        column = three[0]
        for i, u in enumerate(three[1:], 1):
            column = column.bitwiseOR(F.shiftleft(u, BITS * i))
        out.append(column.alias(f"q{k}"))
    return out


@dataclass
class Texts:
    """Some blocks' texts end to end; the middle's words are numbered from ``symbols`` on."""

    doc_ids: list
    lengths: np.ndarray
    steps: np.ndarray  # symbols of all texts
    outside: np.ndarray  # places in ``steps`` of words outside the head
    n: np.ndarray  # counts of these
    number: np.ndarray  # of the words with emissions of their own
    own_n: np.ndarray
    own: np.ndarray  # their counts by state


def _rows_of(column: pa.Array, i: int) -> pa.StructArray:
    start, end = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
    return column.values.slice(start, end - start)


def _field(rows: pa.StructArray, name: str) -> np.ndarray:
    return rows.field(name).to_numpy(zero_copy_only=False)


def read_blocks(batches: Iterator[pa.RecordBatch], symbols: int, states: int) -> Iterator[Texts]:
    """Blocks put together until they have about AT_ONCE symbols; counts of rare words are 0 where ``rare`` is left out."""

    def united(parts: list[Texts]) -> Texts:
        steps, outside, own, at = [], [], 0, 0
        for p in parts:
            steps.append(np.where(p.steps >= symbols, p.steps + own, p.steps))
            outside.append(p.outside + at)
            own, at = own + len(p.number), at + len(p.steps)
        joined = {c: np.concatenate([getattr(p, c) for p in parts]) for c in ("lengths", "n", "number", "own_n", "own")}
        return Texts([i for p in parts for i in p.doc_ids], steps=np.concatenate(steps), outside=np.concatenate(outside), **joined)

    waiting, size = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            steps = np.frombuffer(batch.column("symbols")[i].as_py(), dtype="<i4").astype(np.int64)
            mapped = symbols - TAILS + np.frombuffer(batch.column("tails")[i].as_py(), dtype="<u2").astype(np.int64)
            n, number = np.zeros(len(mapped), dtype=np.int64), np.full(len(mapped), -1, dtype=np.int64)
            middle = np.frombuffer(batch.column("middle")[i].as_py(), dtype=MIDDLE)
            n[middle["place"]], number[middle["place"]] = middle["n"], middle["number"]
            if "rare" in batch.schema.names:
                rare = np.frombuffer(batch.column("rare")[i].as_py(), dtype=RARE)
                n[rare["place"]] = rare["n"]
            found = _rows_of(batch.column("own"), i) if "own" in batch.schema.names else None
            if found is not None:
                at = _field(found, "place").astype(np.int64)
                words = np.stack([_field(found, f"q{k}") for k in range(_parts(states))], axis=1)
                units = np.stack([(words[:, s // 3] >> (BITS * (s % 3))) & ((1 << BITS) - 1) for s in range(states)], axis=1)
            else:
                at, units = np.flatnonzero(number >= 0), np.zeros(((number >= 0).sum(), states))
            mapped[at] = symbols + np.arange(len(at))
            outside = np.flatnonzero(steps >= symbols)
            local = steps[outside] - symbols
            steps[outside] = mapped[local]
            own = units * (n[at, None] / ((1 << BITS) - 1))
            waiting.append(Texts(batch.column("doc_id")[i].as_py(), np.array(batch.column("lengths")[i].as_py(), dtype=np.int64), steps, outside, n[local], number[at], n[at], own))
            size += len(steps)
            if size >= AT_ONCE:
                yield united(waiting)
                waiting, size = [], 0
    if waiting:
        yield united(waiting)


def time_major(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of all symbols of texts laid end to end: the first of each text, the second of each, and so on.

    Gives the order, where each time begins in it, and the order of the texts: longest first, so that
    the texts alive at a time are the first ones.
    """
    texts = np.argsort(-lengths, kind="stable")
    rank = np.empty_like(texts)
    rank[texts] = np.arange(len(texts))
    begin = np.cumsum(lengths) - lengths
    alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max()), side="right")
    times = np.concatenate([[0], np.cumsum(alive)])
    time = np.arange(lengths.sum()) - np.repeat(begin, lengths)
    order = np.empty(len(time), dtype=np.int64)
    order[times[time] + np.repeat(rank, lengths)] = np.arange(len(time))
    return order, times, texts


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states
    #: For words of the middle: what their shares of the corpus count for, and the total of counts, by state.
    mix: np.ndarray | None = None
    total: np.ndarray | None = None

    def own(self, counts: np.ndarray, share: np.ndarray) -> np.ndarray:
        return (counts + self.mix * share[:, None]) / self.total

    def extended(self, rows: np.ndarray) -> Model:
        return Model(self.start, self.move, np.concatenate([self.emit, rows])) if len(rows) else self

    def log10_probability(self, texts: list[np.ndarray], width: int = 512) -> np.ndarray:
        """Exact scaled forward recursion, at once over ``width`` texts of like length, or fewer long ones."""
        out = np.zeros(len(texts))
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        while order:
            chosen, size = [], 0
            while len(chosen) < min(width, len(order)) and (not chosen or size + len(texts[order[len(chosen)]]) <= AT_ONCE):
                size += len(texts[order[len(chosen)]])
                chosen.append(order[len(chosen)])
            order = order[len(chosen) :]
            places, times, _ = time_major(np.array([len(texts[i]) for i in chosen]))
            steps = np.concatenate([texts[i] for i in chosen])[places]
            total, now = np.zeros(len(chosen)), None
            for t in range(len(times) - 1):
                k = times[t + 1] - times[t]
                now = (self.start if t == 0 else now[:k] @ self.move) * self.emit[steps[times[t] : times[t + 1]]]
                scale = now.sum(axis=1)
                now /= scale[:, None]
                total[:k] += np.log10(scale)
            out[chosen] = total
        return out


class Expected:
    """Baum-Welch counts of many stretches."""

    def __init__(self, model: Model):
        self.model = model
        self.start, self.move, self.emit = np.zeros_like(model.start), np.zeros_like(model.move), np.zeros_like(model.emit)

    def add(self, texts: list[np.ndarray], own: np.ndarray | None = None) -> np.ndarray:
        """``texts`` of at most STRETCH symbols each; forward and backward over all of them at once.

        Gives the emission counts of the further symbols, whose emissions are ``own``.
        """
        if not texts:
            return np.zeros((0 if own is None else len(own), len(self.model.start)))
        return self.add_steps(np.concatenate(texts), np.array([len(t) for t in texts]), own)

    def add_steps(self, flat: np.ndarray, lengths: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        model = self.model
        emit = model.emit if own is None else np.concatenate([model.emit, own])
        places, times, _ = time_major(lengths)
        steps, last = flat[places], len(times) - 2
        seen = emit[steps]
        alpha, scales, beta = np.empty_like(seen), np.empty(len(steps)), np.ones_like(seen)
        for t in range(last + 1):
            here = slice(times[t], times[t + 1])
            now = (model.start if t == 0 else alpha[times[t - 1] : times[t - 1] + here.stop - here.start] @ model.move) * seen[here]
            scales[here] = scale = now.sum(axis=1)
            np.divide(now, scale[:, None], out=alpha[here])
        later = seen
        later /= scales[:, None]
        back = np.ascontiguousarray(model.move.T)
        for t in range(last, 0, -1):
            here = slice(times[t], times[t + 1])
            later[here] *= beta[here]
            beta[times[t - 1] : times[t - 1] + here.stop - here.start] = later[here] @ back
        if last > 0:
            alive = np.diff(times)
            before = np.arange(times[1], len(steps)) - np.repeat(alive[:-1], alive[1:])  # the same texts a time earlier
            self.move += model.move * (alpha[before].T @ later[times[1] :])
        alpha *= beta  # the states' probabilities
        self.start += alpha[: times[1]].sum(axis=0)
        counts = np.stack([np.bincount(steps, weights=alpha[:, s], minlength=len(emit)) for s in range(alpha.shape[1])], axis=1)
        self.emit += counts[: len(self.emit)]
        return counts[len(self.emit) :]


def stretch_lengths(lengths: np.ndarray) -> np.ndarray:
    """Lengths of the stretches of texts laid end to end."""
    parts = -(-lengths // STRETCH)
    out = np.full(parts.sum(), STRETCH, dtype=np.int64)
    out[np.cumsum(parts) - 1] = lengths - (parts - 1) * STRETCH
    return out


def _maximised(start: np.ndarray, move: np.ndarray, emit: np.ndarray, common: np.ndarray, own_seen: np.ndarray, own_total: np.ndarray) -> Model:
    """Shares of the counts, mixed with the corpus's symbol shares: the more, the more symbols of a state are new ones.

    ``own_seen`` and ``own_total`` are the numbers and the counts of the middle's words by state.
    """
    mix = 1 + (emit > 0.5).sum(axis=0) + own_seen
    total = emit.sum(axis=0) + own_total + mix
    move = move + 1e-2
    start = (start + 1e-2) / (start + 1e-2).sum()
    return Model(start, move / move.sum(axis=1, keepdims=True), (emit + mix * common[:, None]) / total, mix, total)


@dataclass
class Sides:
    """Texts by the side of the mean on which they lie along the main directions of their frequent symbols' shares."""

    shown: np.ndarray  # by symbol: its column or -1
    mean: np.ndarray
    directions: np.ndarray

    @staticmethod
    def shares(steps: np.ndarray, lengths: np.ndarray, shown: np.ndarray) -> np.ndarray:
        d = int(shown.max()) + 1
        text = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.flatnonzero(steps < len(shown))
        column = shown[steps[inside]]
        key = text[inside[column >= 0]] * d + column[column >= 0]
        return np.sqrt(np.bincount(key, minlength=len(lengths) * d).reshape(-1, d) / lengths[:, None])

    def groups(self, steps: np.ndarray, lengths: np.ndarray, states: int) -> np.ndarray:
        above = (self.shares(steps, lengths, self.shown) - self.mean) @ self.directions > 1e-9
        return above @ (1 << np.arange(above.shape[1])) % states


def _sides(trained: DataFrame, lex: Lexicon, states: int) -> Sides:
    """Main directions from the second moments of all training texts, summed on the executors; the driver gets these sums."""
    top = np.argsort(-lex.counts, kind="stable")[:SHOWN]
    shown = np.full(len(lex.counts), -1, dtype=np.int64)
    shown[top] = np.arange(len(top))
    d, symbols = len(top) + 1, lex.symbols

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for t in read_blocks(batches, symbols, states):
            x = Sides.shares(t.steps, t.lengths, shown)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            total += x.T @ x
        yield pa.record_batch([pa.array(np.arange(d * d, dtype=np.int32)), pa.array(total.ravel())], names=["place", "v"])

    found = trained.select("doc_id", "lengths", "symbols", "tails", "middle").mapInArrow(moments, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(d * d)
    total[found.column("place").to_numpy()] = found.column("v").to_numpy()
    total = total.reshape(d, d) / max(1.0, total[0])
    mean = total[0, 1:]
    _, vectors = np.linalg.eigh(total[1:, 1:] - np.outer(mean, mean))
    chosen = vectors[:, ::-1][:, : max(1, (states - 1).bit_length())]
    chosen = chosen * np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(chosen.shape[1])])
    return Sides(shown, mean, chosen)


def _one_round(texts: DataFrame, now: Model | Sides, lex: Lexicon, states: int) -> tuple[Model, DataFrame]:
    """Counts of all training texts, summed by symbol or word on the executors.

    From a model these are Baum-Welch's expected counts; from ``Sides`` each text is of one state.
    The driver gets one row per symbol; those of the middle stay a table of packed shares.
    """
    common, weight, symbols = lex.common(), lex.weight(), lex.symbols
    names = [f"s{i}" for i in range(states)]
    # Keys: symbols, and the middle's words after them; below zero the start counts (-1) and the moves from state i (-2 - i).
    schema = "key long, " + ", ".join(f"{c} double" for c in names)

    def rows(keys: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(keys.astype(np.int64)), *(pa.array(np.ascontiguousarray(table[:, i])) for i in range(states))], names=["key", *names])

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = isinstance(now, Sides)
        found = Expected(Model(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))) if first else now)
        for t in read_blocks(batches, symbols, states):
            if first:
                key = t.steps * states + np.repeat(now.groups(t.steps, t.lengths, states), t.lengths)
                counts = np.bincount(key, minlength=(symbols + len(t.number)) * states).reshape(-1, states).astype(float)
                found.emit += counts[:symbols]
                counts = counts[symbols:]
            else:
                counts = found.add_steps(t.steps, stretch_lengths(t.lengths), now.own(t.own, (t.own_n + 0.5) / weight))
            if len(t.number):
                words, at = np.unique(t.number, return_inverse=True)
                summed = np.stack([np.bincount(at, weights=counts[:, s], minlength=len(words)) for s in range(states)], axis=1)
                yield rows(symbols + words, np.round(summed * UNITS) / UNITS)
        used = np.flatnonzero(found.emit.any(axis=1))
        yield rows(np.concatenate([[-1], -2 - np.arange(states), used]), np.concatenate([found.start[None], found.move, found.emit[used]]))

    columns = [c for c in ("doc_id", "lengths", "symbols", "tails", "middle", "own") if c in texts.columns]
    summed = texts.select(*columns).mapInArrow(expect, schema).groupBy("key").agg(*[F.sum(c).alias(c) for c in names])
    with shuffles_end(texts.sparkSession):
        counts = stage(summed, "expected")
    few = counts.where(F.col("key") < symbols).toArrow()
    keys, values = few.column("key").to_numpy(), np.stack([few.column(c).to_numpy() for c in names], axis=1).reshape(-1, states)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))
    emit[keys[keys >= 0]] = values[keys >= 0]
    start += values[keys == -1].sum(axis=0)
    move[-2 - keys[keys < -1]] = values[keys < -1]
    if isinstance(now, Sides):  # states stay, mostly
        start, move = np.ones(states), np.full((states, states), 0.1) + 9 * np.eye(states)
    own = counts.where(F.col("key") >= symbols)
    seen, total = np.zeros(states), np.zeros(states)
    if lex.middle:
        r = own.agg(*[F.count(F.when(F.col(c) > 0.5, 1)) for c in names], *[F.coalesce(F.sum(c), F.lit(0.0)) for c in names]).first()
        seen, total = np.array(r[:states]), np.array(r[states:])
    return _maximised(start, move, emit, common, seen, total), own.select((F.col("key") - symbols).alias("number"), *_packed(names))


def train(coded: DataFrame, places: DataFrame, lex: Lexicon, states: int, rounds: int) -> tuple[Model, DataFrame]:
    """``rounds`` of Baum-Welch over all training texts, from counts that give each text to one state.

    Gives the model and the middle's table (number, packed shares by state).
    """
    trained, held = coded.where("not held_out"), places.where("not held_out")
    model, table = _one_round(trained, _sides(trained, lex, states), lex, states)
    for _ in range(rounds):
        model, table = _one_round(with_own(trained, held, table, lex), model, lex, states)
    return model, table


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _score_sequences(texts: DataFrame, model: Model, lex: Lexicon) -> DataFrame:
    base, tails, weight = np.log10(lex.counts + 0.5), np.log10(lex.tail_total), lex.weight()
    seen, first_tail, states = lex.counts > 0, len(lex.counts), len(model.start)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            held_out = whole.column("held_out")
            for held in (False, True):
                for t in read_blocks([whole.filter(pyarrow.compute.equal(held_out, held))], len(model.emit), states):
                    begin = np.cumsum(t.lengths) - t.lengths
                    head = np.where(t.steps < first_tail, t.steps, 0)
                    bases, known, shares = base[head], seen[head].astype(np.int64), np.zeros(len(t.steps))
                    weights, symbol = np.log10(t.n + 0.5), t.steps[t.outside]
                    bases[t.outside], known[t.outside] = weights, t.n > 0
                    rare = symbol < len(model.emit)
                    shares[t.outside[rare]] = weights[rare] - tails[symbol[rare] - first_tail]
                    sums = [np.add.reduceat(x, begin) for x in (known, bases, shares)]
                    parts = np.split(t.steps, begin[1:])
                    found = model.extended(model.own(t.own, (t.own_n + 0.5) / weight)).log10_probability(parts)
                    columns = [pa.array(t.doc_ids, pa.int64()), pa.array([held] * len(parts)), pa.array(t.lengths), pa.array(sums[0]), pa.array(sums[1]), pa.array(found + sums[2])]
                    yield pa.record_batch(columns, names=[c.split()[0] for c in SCORED.split(", ")])

    return texts.select("doc_id", "held_out", "lengths", "symbols", "tails", "middle", "rare", "own").mapInArrow(score, SCORED)


def language_model_scores(
    docs: DataFrame, held_out: Column, states: int = 8, rounds: int = 3, head: int = 49_152, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Learns from rows where ``held_out`` is not true.  Tokens are the words and one end; ``base_score``
    is the smoothed unigram log10 probability, ``score`` the model's.  Null and empty texts are one end;
    repeated rows count and get a result each, null ids too; without training rows all words are
    unknown and both scores are finite; no rows give none; other columns are left out.
    """
    held_out = F.coalesce(held_out, F.lit(False))
    train_docs = docs.where(~held_out)
    with run_folder(docs.sparkSession):  # these tables go when all that is read later is written
        with shuffles_end(docs.sparkSession):
            # Numbers of words are fixed by what is written.
            counts = stage(word_counts(train_docs, text_col).withColumn("number", F.monotonically_increasing_id()), "word-counts")
            lex = lexicon(counts, train_docs.count(), head)
            blocks = in_buckets(sequences(docs, held_out, lex, id_col, text_col), "block", "blocks")
        coded, places = with_counts(blocks, counts, lex)
    model, table = train(coded, places, lex, states, rounds)
    scored = _score_sequences(with_own(coded, places, table, lex), model, lex)
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * float(np.log10(lex.base_total()))).alias("base_score"),
        "score",
    )
