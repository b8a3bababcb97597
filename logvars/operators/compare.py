"""Results of other parsers: adapters and cluster comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import text_similarity
from ..functions.templates import count_holes, from_regex_template
from .numbering import number_by_file_order
from .staging import stage


#: Lines of one log that a task compares at once.
PART_LINES = 200_000


def adapt_regex_templates(rows: DataFrame, number_lines: bool = False) -> DataFrame:
    """Regex-template results in the common form; lines of a file scan can be numbered from 1."""
    named = rows.withColumn("EventTemplate", from_regex_template(F.col("RegexTemplate"))).drop("RegexTemplate")
    return number_by_file_order(named) if number_lines else named


def adapt_positional(rows: DataFrame) -> DataFrame:
    """Results whose four columns are known by position and counted from 0."""
    named = rows.toDF("LineId", "EventId", "Content", "EventTemplate")
    return named.withColumn("LineId", F.col("LineId").cast("long") + 1)


def exact_clusters(base: DataFrame, other: DataFrame) -> DataFrame:
    """(BaseTemplate, EventTemplate, n_lines): clusters of both parsers with the same lines.

    Each side is shuffled once, by line, into parts of bounded size; equal clusters are those whose overlap is as
    large as both of them, so no line sets are collected.
    """
    spark = base.sparkSession
    # Templates compress to nearly nothing on their way, so parts are counted in lines, not in bytes.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-max(base.count(), other.count()) // PART_LINES))
    a = base.select("LineId", F.col("EventTemplate").alias("BaseTemplate")).repartition(parts, "LineId").distinct()
    b = other.select("LineId", "EventTemplate").repartition(parts, "LineId").distinct()
    overlap = a.join(b, "LineId").groupBy("BaseTemplate", "EventTemplate").agg(F.count(F.lit(1)).alias("n_lines"))
    n_a = a.groupBy("BaseTemplate").agg(F.count(F.lit(1)).alias("n_a"))
    n_b = b.groupBy("EventTemplate").agg(F.count(F.lit(1)).alias("n_b"))
    sized = overlap.join(n_a, "BaseTemplate").join(n_b, "EventTemplate")
    return sized.where("n_lines = n_a and n_lines = n_b").drop("n_a", "n_b")


def compare_templates(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("Similarity", text_similarity(F.col("BaseTemplate"), F.col("EventTemplate")))


def parser_difference_sheet(base: DataFrame, other: DataFrame) -> DataFrame:
    """One row per hole of the templates that cover the same lines in other words.

    (Template, Content, ParameterIndex, similarity), least similar first.
    """
    # Texts are alike in full exactly where they are equal.
    differing = stage(compare_templates(exact_clusters(base, other).where("BaseTemplate <> EventTemplate")), "pairs")
    chosen = differing.groupBy("EventTemplate").agg(F.min("Similarity").alias("similarity"))
    hits = other.join(chosen, "EventTemplate")
    first = stage(hits.groupBy("EventTemplate").agg(F.min("LineId").alias("LineId")), "firsts")
    lines = other.select("EventTemplate", "LineId", "Content").join(first, ["EventTemplate", "LineId"]).join(chosen, "EventTemplate")
    holes = count_holes(F.col("EventTemplate"))
    rows = lines.where(holes > 0).select(
        F.col("EventTemplate").alias("Template"), "Content",
        F.explode(F.sequence(F.lit(0), holes - 1)).alias("ParameterIndex"), "similarity",
    )
    return rows.orderBy("similarity", "Template", "ParameterIndex")
