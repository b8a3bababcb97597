"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from logvars.operators.staging import shared_dir, stage

__all__ = ["filesystem", "fold", "id_ranges", "lowest_hashes", "new_column", "range_count", "range_of", "shared_dir", "stage"]


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def lowest_hashes(rows: DataFrame, total: int, limit: int, *columns: str) -> DataFrame:
    """The ``limit`` rows whose hash of ``columns`` is lowest, whatever the partitions.

    ``total`` is the number of rows.  Rows far above the cut are dropped first, so that all tasks
    together hand on about twice ``limit`` rows, and not ``limit`` each.
    """
    here = F.xxhash64(*columns)
    share = 2 * limit / max(1, total)
    if share < 0.5:
        rows = rows.where(here < F.lit(int(-(1 << 63) + share * (1 << 64))))
    return rows.orderBy(here, *columns).limit(limit)


def filesystem(path: str):
    """(file system, path in it) of a folder that Spark names, by URI or plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def id_ranges(docs: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` increasing values of ``column`` that cut its rows into like counts.

    One narrow scan; the driver holds one number for each range.
    """
    if parts <= 1:
        return []
    quantiles = [i / parts for i in range(1, parts)]
    found = docs.select(F.percentile_approx(column, quantiles, max(1000, 20 * parts)).alias("q")).first()["q"]
    return sorted(set(found or []))


def range_of(column: Column, bounds: Sequence[int]) -> Column:
    """Number of the range that ``column`` falls into; a bound opens its range. Nulls: range 0."""
    edges = np.asarray(list(bounds), dtype=np.int64)

    @arrow_udf("int")
    def find(values: pa.Array) -> pa.Array:
        known = values.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(edges, known, side="right").astype(np.int32))

    return find(column)


def range_count(spark: SparkSession) -> int:
    """Ranges to cut a table into: a few for each shuffle partition, so that their sizes even out."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_column(rows: DataFrame, name: str) -> str:
    """``name``, if no column of ``rows`` has it; names differ in more than case."""
    if name.lower() in {c.lower() for c in rows.columns}:
        raise ValueError(f"the table has a column {name} already; choose another name for the result")
    return name
