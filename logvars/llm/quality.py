"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are runs of three character classes, hashed words, and repetitions; their weighted
frequencies are projected on the leading singular vectors of a bounded labelled sample.  Every document
is compared with every labelled vector in blocks of exact cosine products; the nearest ones vote for
their label, weighted by similarity.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import lowest_hashes

_CLASSES = 16
_SHAPES = _CLASSES**3
_WORDS = 512
_HABITS = 8
TERMS = _SHAPES + _WORDS + _HABITS
#: How much hashed words and repetitions count beside the shapes.
_WORD_SHARE, _HABIT_SHARE = 0.3, 1.0


def _class_of(byte: int) -> int:
    """Space, line end, upper case, lower case (with all beyond ASCII), digit, then punctuation by kind."""
    c = chr(byte)
    if byte >= 128 or c.islower():
        return 3
    for number, members in enumerate((" \t", "\n\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "", "0123456789", ".", ",;:", "!?", "|", "*#", "%&", "$@", "'\"", "-_", "()[]{}<>")):
        if c in members and members:
            return number
    return 15


_TABLE = bytes(_class_of(b) for b in range(256))


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        n = self[word] = zlib.crc32(word) % _WORDS
        return n


def term_weights(text: str | None, buckets: dict) -> np.ndarray:
    """Square roots of relative frequencies of all terms of the whole text, or zeros for null and empty texts."""
    out = np.zeros(TERMS, dtype=np.float32)
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    if not raw:
        return out
    classes = np.frombuffer((b" " + raw + b" ").translate(_TABLE), dtype=np.uint8).astype(np.uint16)
    shapes = np.bincount(classes[:-2] * _CLASSES * _CLASSES + classes[1:-1] * _CLASSES + classes[2:], minlength=_SHAPES)
    out[:_SHAPES] = np.sqrt(shapes / len(raw))
    words = raw.lower().split()
    if words:
        n = len(words)
        seen = np.bincount(np.fromiter(map(buckets.__getitem__, words), np.int64, n), minlength=_WORDS)
        out[_SHAPES : _SHAPES + _WORDS] = _WORD_SHARE * np.sqrt(seen / n)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        habits = [
            sum(map(operator.eq, words, words[1:])) / n,
            sum(map(operator.eq, words, words[2:])) / n,
            sum(map(operator.eq, words, words[3:])) / n,
            1 - len(set(words)) / n,
            1 - len(set(lines)) / max(1, len(lines)),
            min(1.0, np.log2(n + 1) / 16),
            min(1.0, sum(map(len, words)) / n / 16),
            1.0 if n < 4 else 0.0,
        ]
        out[_SHAPES + _WORDS :] = _HABIT_SHARE * np.sqrt(habits)
    return out


@dataclass(frozen=True)
class Neighbours:
    """Term weights, projection and the labelled vectors (unit length); bounded by the sample."""

    scale: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    nearest: int
    sharpness: float

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def latent(self, weights: np.ndarray) -> np.ndarray:
        found = (weights * self.scale) @ self.projection
        length = np.linalg.norm(found, axis=1, keepdims=True)
        return found / np.where(length > 0, length, 1)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled vectors; the share of label 1 where nothing is similar."""
        if not len(self.labels):
            return np.full(len(weights), self.prior)
        cosines = self.latent(weights) @ self.vectors.T
        k = min(self.nearest, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(cosines, near, axis=1), 0) ** self.sharpness
        total = votes.sum(axis=1)
        score = (votes * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, score, self.prior), 0, 1)


def _singular(x: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors by a randomised range finder."""
    rng = np.random.default_rng(7)
    rank = min(rank, *x.shape)
    q = x.T @ rng.standard_normal((x.shape[0], min(rank + 10, x.shape[0]))).astype(x.dtype)
    for _ in range(4):
        q, _ = np.linalg.qr(q)
        q = x.T @ (x @ q)
    q, _ = np.linalg.qr(q)
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return q @ v[:rank].T


def fit(weights: np.ndarray, labels: np.ndarray, rank: int = 64, nearest: int = 15, sharpness: float = 8.0) -> Neighbours:
    if not len(labels):
        none = np.zeros((0, 1), np.float32)
        return Neighbours(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), none, np.zeros(0), nearest, sharpness)
    seen = (weights > 0).sum(axis=0)
    scale = (np.log((1 + len(labels)) / (1 + seen)) + 0.1).astype(np.float32)
    scale[_SHAPES + _WORDS :] = 1
    projection = _singular(weights * scale, rank).astype(np.float32)
    model = Neighbours(scale, projection, np.zeros((0, projection.shape[1]), np.float32), labels.astype(float), nearest, sharpness)
    return Neighbours(scale, projection, model.latent(weights).astype(np.float32), model.labels, nearest, sharpness)


def _packed(weights: np.ndarray) -> bytes:
    at = np.flatnonzero(weights)
    return at.astype("<u2").tobytes() + weights[at].astype("<f4").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    out = np.zeros(TERMS, dtype=np.float32)
    out[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
    return out


def _term_column(texts: pa.Array) -> pa.Array:
    buckets = _Buckets()
    return pa.array([_packed(term_weights(t, buckets)) for t in texts.to_pylist()], pa.binary())


def learn(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 2048,
    rank: int = 32,
    nearest: int = 9,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Neighbours:
    """Fit on at most ``sample`` labelled rows, those whose id hashes lowest, whatever the partitions.

    Rows without id or label, and labelled ids without a document, teach nothing.  Terms are counted by
    the executors; the driver gets a bounded number of sparse vectors of bounded length.
    """
    named = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label"))
    named = named.where("id is not null and label is not null")
    chosen = lowest_hashes(named, named.count(), sample, "id", "label")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").select("id", "label", arrow_udf(_term_column, "binary")("text").alias("terms"))
    rows = found.orderBy(F.xxhash64("id"), "id", "label", "terms").limit(sample).collect()
    weights = np.array([_unpacked(r["terms"]) for r in rows], dtype=np.float32).reshape(len(rows), TERMS)
    return fit(weights, np.array([r["label"] for r in rows]), rank, nearest)


def scorer(model: Neighbours, block: int = 256):
    """A column function: text to score.  Null and empty texts have the share of label 1 in the sample."""

    @arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets = _Buckets()
        for part in parts:
            out = []
            for at in range(0, len(part), block):
                texts = part.slice(at, block).to_pylist()
                out.append(model.scores(np.array([term_weights(t, buckets) for t in texts])))
            yield pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    # A filter on the score would otherwise be pushed below it and score once more.
    return score.asNondeterministic()


def rate(docs: DataFrame, model: Neighbours, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with the column ``out`` (0 to 1, higher: label 1 likelier); every row and column stays."""
    return docs.withColumn(out, scorer(model)(F.col(text_col)))
