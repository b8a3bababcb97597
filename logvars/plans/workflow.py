"""The whole job: from parsed lines to formats and analysis-ready records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.analysis import analysis_ready, apply_formats, template_rules
from ..operators.classify import classify
from ..operators.drift import extract_with_drift
from ..operators.extract import extract_parameters
from ..operators.groups import attach_groups, same_value_groups
from ..operators.induce import format_rows, group_formats, group_rules, proposed_formats
from ..operators.staging import run_folder, stage
from ..operators.variables import variable_values
from ..sources.logs import write_table

# Fixed settings of the known log sets.
SPLIT_PREFIXES = {
    "Hadoop": ["attempt_", "task_"],
    "Spark": ["rdd_", "broadcast_", "mesos-slave-", "mesos-master-"],
    "BGL": [],
}
SPECIAL_MARKERS = {
    "BGL": ["X-", "X+", "Y-", "Y+", "Z-", "Z+", "x+", "x-", "y+", "y-", "z+", "z-"],
}
LOG_SETS = [
    "Apache", "BGL", "Hadoop", "HDFS", "HealthApp", "HPC", "Linux", "Mac", "OpenSSH", "OpenStack",
    "Proxifier", "Spark", "Thunderbird", "Zookeeper",
]


def set_words(words: dict[str, Sequence[str]], by: str) -> Column:
    """Array column: the words of a row's log set, empty for sets that have none."""
    kind = "array<string>"
    entries = [x for name, held in words.items() for x in (F.lit(name), F.array(*map(F.lit, held)).cast(kind))]
    none = F.array().cast(kind)
    return F.coalesce(F.element_at(F.create_map(*entries), F.col(by)), none) if entries else none


def run(
    lines: DataFrame,
    dataset: str = "",
    out: str | None = None,
    until: str = "formats",
    prefixes: Sequence[str] | Column | None = None,
    markers: Sequence[str] | Column | None = None,
    drift: bool = False,
    proposer=None,
    keep_equals: bool = False,
    proposal: dict | None = None,
    by: str | None = None,
) -> dict[str, DataFrame]:
    """All stages as DataFrames; with ``out`` each is written there once and read on from there.

    ``until``: "grouped" stops before formats, "formats" (default), "analysis" adds the
    records per line.  ``keep_equals`` keeps the ``=`` of values cut as ``=digits``.  With a ``proposer``
    (see ``proposed_formats``, which gets the options ``proposal``) there is also "rejected": its answers and
    formats that were not used.

    Tables between the stages lie in the shared folder; with ``out`` they are removed when all is written.

    ``by`` names a column of log sets: all sets run in one job, each with its own templates, settings, groups and
    numbers, as if it had run alone.  Lines of no set (null) are the set "".
    """
    if until not in ("grouped", "formats", "analysis"):
        raise ValueError(f"unknown stage: {until}")
    how = (lines, dataset, out, until, prefixes, markers, drift, proposer, keep_equals, proposal, by)
    if not out:
        return _run(*how)
    with run_folder(lines.sparkSession):
        return _run(*how)


def _run(lines, dataset, out, until, prefixes, markers, drift, proposer, keep_equals, proposal, by) -> dict[str, DataFrame]:
    sets = [by] if by else []
    if by:
        lines = lines.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("")))
        prefixes = set_words(SPLIT_PREFIXES, by) if prefixes is None else prefixes
        markers = set_words(SPECIAL_MARKERS, by) if markers is None else markers
    prefixes = SPLIT_PREFIXES.get(dataset, []) if prefixes is None else prefixes
    markers = SPECIAL_MARKERS.get(dataset, []) if markers is None else markers

    def keep(table: DataFrame, name: str) -> DataFrame:
        if not out:
            return stage(table, name)
        write_table(table, f"{out}/{name}")
        return table.sparkSession.read.schema(table.schema).parquet(f"{out}/{name}")

    extracted = extract_with_drift(lines, by=sets) if drift else extract_parameters(lines)
    if drift or out or until == "analysis":
        extracted = keep(extracted, "structured")
    values = stage(variable_values(extracted, sets), "distinct-values")
    variables, rows, facts = classify(values, markers, keep_equals, sets)
    rows = stage(rows, "values")
    grouped = stage(attach_groups(variables, same_value_groups(variables, rows, sets)), "variables")
    own = own_numbers(grouped, sets)
    result = {"structured": extracted}
    result["variables"] = keep(own(grouped), "variables") if out or by else grouped
    result["values"] = keep(own(rows), "values") if out or by else rows
    if until != "grouped":
        members = rows.join(grouped.select("DynamicID", "GroupID"), "DynamicID")
        if proposer is None:
            rules = group_rules(members, prefixes, sets)
            formats = group_formats(members, prefixes, by=sets, rules=rules)
        else:
            formats, rejected = proposed_formats(members, proposer, prefixes, by=sets, **(proposal or {}))
            result["rejected"] = keep(own(rejected, grouped), "rejected")
        result["formats"] = keep(own(format_rows(grouped, rows, formats, sets)), "formats")
    if until == "analysis":
        if proposer is None:
            templates = template_rules(facts, grouped, rules, sets)
            records = apply_formats(extracted, templates, rules.shapes, prefixes, keep_equals, by=sets)
        else:
            records = analysis_ready(extracted, result["formats"], sets)
        result["analysis"] = keep(records, "analysis") if out else records
    return result


def own_numbers(grouped: DataFrame, by: Sequence[str]) -> Callable[..., DataFrame]:
    """A function that turns numbers running through all sets into those of each set alone.

    DynamicIDs follow the sets' order, and so do groups, which are numbered by their first members; so the numbers
    of a set are dense and only begin late.
    """
    if not by:
        return lambda table, owners=None: table
    firsts = grouped.groupBy(*by).agg(F.min("DynamicID").alias("_d"), (F.min("GroupID") - 1).alias("_g"))
    firsts = stage(firsts, "set-numbers")

    def own(table: DataFrame, owners: DataFrame | None = None) -> DataFrame:
        if owners is not None:  # rows that name their set by a group only
            table = table.join(owners.select(*by, "GroupID").distinct(), "GroupID")
        found = table.join(firsts, list(by))
        for number, before in (("DynamicID", "_d"), ("GroupID", "_g")):
            if number in table.columns:
                found = found.withColumn(number, F.col(number) - F.col(before))
        return found.drop("_d", "_g")

    return own


def run_log_sets(lines: DataFrame, out: str, names: Sequence[str] = LOG_SETS, **options) -> None:
    """Run the log sets of a table with the column ``dataset`` in one job, each with its own settings.

    Only the finished tables are written set by set, each set to a folder of its own.
    """
    result = run(lines.where(F.col("dataset").isin(*names)), by="dataset", **options)
    for table, rows in result.items():
        rows = stage(rows, table) if table == "analysis" else rows
        for name in names:
            write_table(rows.where(F.col("dataset") == name).drop("dataset"), f"{out}/dataset={name}/{table}")
