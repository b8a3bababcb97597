"""Language identification by compression with one raw-content dictionary for each language.

A text belongs to the language whose dictionary makes it smallest.  Texts are compressed in blocks,
so that a long text cannot serve as its own dictionary; all blocks count.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import lowest_hashes

UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Languages:
    """One dictionary for each language, in order of the names."""

    names: list[str]
    dictionaries: list[bytes]
    block: int = 2048
    level: int = 6
    #: Share by which the runner-up must be larger for a text of ``judged`` bytes or more to be accepted;
    #: on shorter texts a whole byte more or less says nothing, and they are accepted.
    margin: float = 0.01
    judged: int = 200


def letters_only(text: str) -> str:
    """Lower case, with one space for every run of other characters."""
    return _OTHER.sub(" ", text.lower()).strip()


def lesson(text: str, part: int) -> bytes:
    """At most ``part`` bytes of letters from a place that the text's checksum chooses among all."""
    raw = letters_only(text).encode()
    if len(raw) <= part:
        return raw
    at = zlib.crc32(raw) % (len(raw) - part + 1)
    return raw[at : at + part].decode("utf-8", "ignore").encode()


def _lessons():
    """A column function: text and number of bytes to lesson."""

    @arrow_udf("binary")
    def lessons(texts: pa.Array, parts: pa.Array) -> pa.Array:
        return pa.array([lesson(t, p) for t, p in zip(texts.to_pylist(), parts.to_pylist(), strict=True)], pa.binary())

    return lessons


def learn(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = 300, size: int = 200_000
) -> Languages:
    """Dictionaries from at most ``sample`` different texts of each language, at most ``size`` bytes each.

    The texts are those whose hash is lowest, whatever the partitions and ids.  Each gives an equal part at
    most, from a place of the whole text that its content chooses.  Rows without a language or a letter
    teach nothing; no rows give no languages.
    """
    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where("lang is not null").where(F.col("text").rlike(r"\p{L}"))
    totals = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"))
    totals = {r["lang"]: r["n"] for r in totals.collect()}
    names = sorted(totals)
    dictionaries = []
    for name in names:
        chosen = lowest_hashes(known.where(F.col("lang") == name).select("text").distinct(), totals[name], sample, "text")
        # One byte less, as parts are joined by one.
        part = F.floor(F.lit(size) / F.count(F.lit(1)).over(Window.partitionBy())).cast("int") - 1
        parts = chosen.select("text", part.alias("part")).select(_lessons()("text", "part").alias("lesson"))
        dictionaries.append(b"\n".join(dict.fromkeys(bytes(r["lesson"]) for r in parts.collect() if r["lesson"])))
    kept = [(n, d) for n, d in zip(names, dictionaries, strict=True) if len(d) >= 8]
    return Languages([n for n, _ in kept], [d for _, d in kept])


class _Model:
    def __init__(self, languages: Languages):
        self.names, self.margin = languages.names, languages.margin
        self.block, self.judged = languages.block, languages.judged
        self.compress = []
        for raw in languages.dictionaries:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=languages.level)
            frame = zstandard.ZstdCompressor(
                dict_data=d, level=languages.level, write_checksum=False, write_content_size=False, write_dict_id=False
            )
            self.compress.append(frame.compress)

    def sizes(self, raw: bytes) -> np.ndarray:
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        return np.array([sum([len(c(b)) for b in blocks]) for c in self.compress], dtype=float)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        raw = letters_only(text).encode()
        sizes = self.sizes(raw)
        order = np.argsort(sizes, kind="stable")
        best = sizes[order[0]]
        score = 1 / float(np.exp(-100 * (sizes / best - 1)).sum())
        sure = len(order) == 1 or len(raw) < self.judged or sizes[order[1]] - best >= self.margin * best
        return self.names[order[0]], score, bool(sure)


def predictor(languages: Languages):
    """A column function: text to (lang, score, accepted).

    ``lang`` is the language of the smallest result (ties: the first name), ``und`` for null, empty
    or letterless texts and where nothing was learned; ``score`` is 0 to 1; ``accepted`` is false for
    ``und`` and where the runner-up is larger by less than the margin (long enough texts only).
    """

    @arrow_udf("lang string, score double, accepted boolean")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _Model(languages)
        for part in parts:
            found = [model.predict(t) for t in part.to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.StructArray.from_arrays(columns, names=["lang", "score", "accepted"])

    # A filter on the result would otherwise be pushed below it and predict once more.
    return predict.asNondeterministic()


def identify(docs: DataFrame, languages: Languages, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with the struct column ``out``; every row and column stays, repeated rows alike."""
    text: Column = F.col(text_col)
    return docs.withColumn(out, predictor(languages)(text))
