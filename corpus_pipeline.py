"""A text pipeline from raw documents to packed sequences, as stages over the operators in logvars.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvars.llm import decontaminate, langid, quality
from logvars.llm.common import shared_dir
from logvars.llm.minhash import deduplicate
from logvars.llm.packing import pack
from logvars.llm.queries import table, tokenizer_path


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts travel to Python in Arrow batches, so the session's limit of rows for a batch is lowered to ``rows``.

    With 10,000 rows, buffers on both sides grow with the partition and stay in the executor from stage to stage.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or between two languages by a hair, go."""
    small_batches(spark)
    languages = langid.learn(docs)
    found = langid.identify(docs, languages, out="_language")
    return found.where("_language.accepted").select(*docs.columns)


def rate_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their labelled neighbours vote down go."""
    small_batches(spark)
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.rate(docs, model, out="_quality").where("_quality >= 0.3").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree by 80 per cent or more stays."""
    small_batches(spark)
    return deduplicate(docs, percent=80, size=5, rows=8)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten or more words from benchmark items are cut out; documents that are mostly such passages go."""
    small_batches(spark)
    clean = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5)
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids."""
    small_batches(spark)
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), "byte_level", end_id=0, capacity=1024)


STAGES = [
    ("language", identify_language),
    ("quality", rate_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("packing", pack_sequences),
]
#: Compression, neighbours, minima and the linear program are not SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, function in STAGES:
        function(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
