"""Tables written between stages, in the folder all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_run_folder: ContextVar[str | None] = ContextVar("run_folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="logvars-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Bytes of a row group of staged tables.  One file can be read by as many tasks as it has row groups.
ROW_GROUP = 8 << 20


def stage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Cuts lineage, survives lost executors, is read column by column, and gives the
    optimizer the sizes of its files, so that it broadcasts only tables known to be small.  ``codec`` is
    that of the session unless given.
    """
    spark = df.sparkSession
    folder = _run_folder.get() or shared_dir(spark).rstrip("/")
    path = f"{folder}/logvars-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("parquet.block.size", ROW_GROUP)
    (writer.option("compression", codec) if codec else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_narrow(df: DataFrame, name: str, usual: dict[str, Column]) -> DataFrame:
    """:func:`stage`, with the columns of ``usual`` written only where they are not what other columns tell.

    ``usual`` has an expression of other columns for each; one may use those that come before it in ``usual``.
    """
    told = {c: F.coalesce(F.col(c) == expected, F.lit(False)) for c, expected in usual.items()}
    columns = [F.when(~told[c], F.col(c)).alias(c) if c in told else F.col(c) for c in df.columns]
    found = stage(df.select(*columns, *[mark.alias(f"_told_{c}") for c, mark in told.items()]), name, "zstd")
    for c, expected in usual.items():
        found = found.withColumn(c, F.when(F.col(f"_told_{c}"), expected).otherwise(F.col(c)))
    return found.select(*df.columns)


@contextlib.contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Tables staged in here lie in one folder, which is removed at the end if all went well.

    Nothing that is read later may depend on them: write results elsewhere first.  After a failure the
    folder stays, so that the tables can be looked at.
    """
    path = f"{shared_dir(spark).rstrip('/')}/logvars-run-{uuid.uuid4().hex}"
    token = _run_folder.set(path)
    try:
        yield path
    finally:
        _run_folder.reset(token)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
