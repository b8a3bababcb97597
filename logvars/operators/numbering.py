"""Dense numbers over a whole table without passing it through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def number_by_order(df: DataFrame, order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """Add ``name`` = rank of the row in ``order`` (a unique key), counted from ``start``.

    Range partitions are sorted in parallel; only one count per partition is
    accumulated afterwards.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stage(ranged.withColumn("_mid", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_mid", _ROW_BITS)
    return _add_offsets(numbered.withColumn("_part", part), ["_part"], name, start)


def number_by_file_order(df: DataFrame, name: str = "LineId", start: int = 1) -> DataFrame:
    """Number rows of a file scan in file order, one count per file block, no shuffle of rows.

    The located rows are written once, so that counts and rows come from the same blocks.
    """
    located = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    return _add_offsets(stage(located, "located"), ["_file", "_block"], name, start)


def _add_offsets(rows: DataFrame, keys: Sequence[str], name: str, start: int) -> DataFrame:
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition or file block, never one per line; written, so its size is known to the join.
    offsets = stage(
        counts.select(*keys, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "offsets"
    )
    index = (F.col("_mid") - F.col("_first") + F.col("_before") + F.lit(start)).cast("long")
    return rows.join(offsets, list(keys)).withColumn(name, index).drop(*keys, "_mid", "_first", "_before")
