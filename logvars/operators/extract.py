"""Parameters of log lines: template re-cut, extraction, realignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import templates as tpl


def recut_templates(templates: DataFrame) -> DataFrame:
    """(…, NewTemplate) for the templates that hold at least one hole."""
    return templates.where(tpl.is_dynamic(F.col("EventTemplate"))).withColumn(
        "NewTemplate", tpl.recut(F.col("EventTemplate"))
    )


def hole_positions(recut: DataFrame) -> DataFrame:
    return recut.select(
        "NewTemplate", F.posexplode(tpl.hole_positions(tpl.tokens(F.col("NewTemplate")))).alias("Hole", "TokenIndex")
    )


def extract_parameters(lines: DataFrame, realign: bool = True) -> DataFrame:
    """Add NewTemplate and ParameterList (array) to every line of a dynamic template.

    Lines whose token count differs from their template are aligned to it one by one,
    independent of line order.  With ``realign=False`` such lines are left out (see
    :func:`unaligned_lines`).  A null text, as an empty line of a CSV file gives, is one
    empty token.  A projection only: no join, no shuffle.
    """
    dynamic = lines.drop("ParameterList").where(tpl.is_dynamic(F.col("EventTemplate"))).fillna("", ["Content"])
    if not realign:
        dynamic = dynamic.where(n_tokens("Content") == n_tokens("EventTemplate"))
    # Token lists are columns: they are made once per line, and no expression around them is copied for each use.
    base = dynamic.withColumn("_base", tpl.recut(F.col("EventTemplate"))).withColumn("_have", tpl.tokens(F.col("Content")))
    cut = base.withColumn("_want", tpl.tokens(F.col("_base")))
    fitted = cut.withColumn("_odd", tpl.fit_odd_line(F.col("_have"), F.col("_want")))
    # Never null here; saying so spares joins on it a null test that would extract twice.
    new_template = F.coalesce("_odd.NewTemplate", "_base", F.lit(""))
    params = F.when(tpl.same_length(F.col("_have"), F.col("_want")), tpl.tokens_at_holes(F.col("_have"), F.col("_want")))
    return fitted.select(*dynamic.columns, new_template.alias("NewTemplate"), params.otherwise(F.col("_odd.ParameterList")).alias("ParameterList"))


def unaligned_lines(lines: DataFrame) -> DataFrame:
    """Lines whose token count differs from their re-cut template."""
    differs = F.coalesce(n_tokens("Content"), F.lit(1)) != n_tokens("EventTemplate")
    return lines.where(tpl.is_dynamic(F.col("EventTemplate")) & differs)


def n_tokens(column: str) -> Column:
    """Token count without making the tokens; re-cutting a template does not change it."""
    return F.length(column) - F.length(F.replace(F.col(column), F.lit(" "), F.lit(""))) + 1


def lines_without_template(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """Lines whose template is missing from the template table."""
    return lines.join(templates.select("EventTemplate").distinct(), "EventTemplate", "left_anti")


def explode_parameters(extracted: DataFrame, *keep: str) -> DataFrame:
    """One row per line and hole: (keep…, NewTemplate, pos, value)."""
    # The outer form keeps the optimizer from testing the list for emptiness below the
    # extraction, which would run the extraction twice.
    rows = extracted.select(*keep, "NewTemplate", F.posexplode_outer("ParameterList").alias("pos", "value"))
    return rows.where("pos is not null")
