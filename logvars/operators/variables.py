"""The variable table in long form: one row per template, hole and distinct value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import templates as tpl
from .extract import explode_parameters
from .ranking import hash_key, hash_numbers, prefix_rows
from .staging import stage

VARIABLE = ["NewTemplate", "pos"]


def variable_values(extracted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, NewTemplate, pos, value, first_line).

    ``by`` adds leading keys, such as the log set, to run many sets in one job.

    Reducing lines to distinct values here is the only full shuffle; repeated values
    collapse in the map-side aggregate, so constant or hot values stay cheap.
    """
    return (
        explode_parameters(extracted, "LineId", *by)
        .groupBy(*by, *VARIABLE, "value")
        .agg(F.min("LineId").alias("first_line"))
    )


def distinct_contents(extracted: DataFrame) -> DataFrame:
    """First line of every distinct content of a template."""
    return extracted.groupBy("NewTemplate", "Content").agg(F.min("LineId").alias("first_line"))


def first_lines(extracted: DataFrame, columns: Sequence[str] = ("EventTemplate", "Content")) -> DataFrame:
    """First line of each template with its original template and content, or the ``columns`` named.

    Two narrow passes (a minimum per template, then a join on it) instead of sorting
    all lines for an ordered aggregate.
    """
    firsts = stage(extracted.groupBy("NewTemplate").agg(F.min("LineId").alias("LineId")), "firsts")
    return extracted.select("NewTemplate", "LineId", *columns).join(
        firsts, ["NewTemplate", "LineId"]
    )


def representative_lines(extracted: DataFrame, n: int, seed: str) -> DataFrame:
    """At most ``n`` distinct contents of each template in a reproducible random order."""
    rows = stage(distinct_contents(extracted).withColumn("_h", hash_key(seed, "first_line")), "contents")
    return prefix_rows(rows, ["NewTemplate"], hash_numbers(F.col("_h")), ["_h", "first_line"], F.lit(n)).drop("_h")


def representative_values(extracted: DataFrame, n: int, seed: str) -> DataFrame:
    """Variable table built from a sample of ``n`` contents per template."""
    chosen = representative_lines(extracted, n, seed)
    holes = tpl.tokens_at_holes(tpl.tokens(F.col("Content")), tpl.tokens(F.col("NewTemplate")))
    params = chosen.select("NewTemplate", "first_line", F.posexplode(holes).alias("pos", "value"))
    return params.groupBy(*VARIABLE, "value").agg(F.min("first_line").alias("first_line"))
