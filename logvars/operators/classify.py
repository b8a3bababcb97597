"""Types of variables: strip shared marks and affixes, then test all values.

Every decision about a variable is a conjunction over its values, so one hash
aggregate with boolean buffers over the distinct values settles all of them.  Only the
small per-variable table is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions.formats import COMPONENT, SLOT, fill
from .numbering import number_by_order
from .staging import stage
from .variables import VARIABLE


class Classified(NamedTuple):
    variables: DataFrame  # one row per DynamicID
    values: DataFrame  # DynamicID, token, value, first_line
    facts: DataFrame  # one row per template and hole: how to cut and type its tokens


TESTS = ["dot", "number", "unit", "host", "path", "macro"]


def first_values(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First value of each variable.

    All holes of a template start at the template's first line, so a minimum per
    template finds them; no ordered aggregate over strings is needed.
    """
    starts = stage(values.groupBy(*by, "NewTemplate").agg(F.min("first_line").alias("first_line")), "starts")
    found = values.join(starts, [*by, "NewTemplate", "first_line"])
    # Where lines share the first number, a hole has several values there: the smallest one counts.
    return found.groupBy(*by, *VARIABLE, "first_line").agg(F.min("value").alias("value"))


def punctuation(firsts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, NewTemplate, pos, template_line, begin, end, marks, first_bare) from each first value."""
    value = F.col("value")
    begin, end = p.leading_marks(value), p.trailing_marks(value)
    return firsts.select(
        *by,
        *VARIABLE,
        F.col("first_line").alias("template_line"),
        begin.alias("begin"),
        end.alias("end"),
        F.concat(
            F.substring(value, F.lit(1), begin), F.lit(COMPONENT), F.substring(value, F.length(value) - end + 1, end)
        ).alias("marks"),
        value.alias("first"),
        p.cut(value, begin, end).alias("first_bare"),
    )


def first_outcomes(marks: DataFrame, markers: Sequence[str] | Column, keep_equals: bool) -> DataFrame:
    """Add what holds for each first value.

    All values of a variable can only pass a test that the first one passes, so the other
    values need just the few tests that are left.
    """
    bare = F.col("first_bare")
    outcomes = [p.is_number(F.col("first"), markers).alias("ok_raw")]
    for kind, cut in affixes(bare, keep_equals).items():
        if kind != "none":
            outcomes.append(affix_prefix(bare, kind).alias(f"prefix_{kind}"))
        outcomes += [test.alias(f"ok_{kind}_{name}") for name, test in _tests(cut, markers).items()]
    return marks.select("*", *outcomes)


def strip_marks(values: DataFrame, marks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the stripped value ``bare`` (and what strip would cut by mistake: ``lossy``)."""
    value, begin, end = F.col("value"), F.col("begin"), F.col("end")
    head = F.substring_index("marks", COMPONENT, 1)
    tail = F.substring_index("marks", COMPONENT, -1)
    lossy = ~(value.startswith(head) & value.endswith(tail)) | (F.length(value) < begin + end)
    return values.join(marks, [*by, *VARIABLE]).withColumn("bare", p.cut(value, begin, end)).withColumn("lossy", lossy)


def _tails(bare: Column) -> dict[str, Column]:
    return {
        "ip": F.regexp_extract(bare, p.TAIL_IP, 0),
        "hex": F.regexp_extract(bare, p.TAIL_HEX, 0),
        "eq": F.regexp_extract(bare, p.TAIL_EQ_DIGITS, 1),
    }


def affixes(bare: Column, keep_equals: bool = False) -> dict[str, Column]:
    """Value that remains under each way of cutting an affix; null where it does not apply."""
    tails = _tails(bare)
    eq = F.concat(F.lit("="), tails["eq"]) if keep_equals else tails["eq"]
    return {
        "none": bare,
        "url": F.when(bare.startswith("url="), F.substring(bare, 5, 2**31 - 1)),
        "ip": F.when(tails["ip"] != "", tails["ip"]),
        "hex": F.when(tails["hex"] != "", tails["hex"]),
        "eq": F.when(tails["eq"] != "", eq),
    }


def affix_prefix(bare: Column, kind: str) -> Column:
    """Text in front of the cut value; null where the affix does not apply."""
    if kind == "url":
        return F.when(bare.startswith("url="), F.lit("url="))
    tail = _tails(bare)[kind]
    return F.when(tail != "", p.without_tail(bare, tail))


def _tests(value: Column, markers: Sequence[str] | Column) -> dict[str, Column]:
    return {
        "dot": p.is_dot_suffix(value),
        "number": p.is_number(value, markers),
        "unit": p.is_unit(value),
        "host": p.is_host_port(value),
        "path": p.is_path(value),
        "macro": p.is_macro(value),
    }


def variable_facts(
    values: DataFrame,
    marks: DataFrame,
    markers: Sequence[str] | Column = (),
    keep_equals: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per variable: chosen affix, token format and value type (dot suffixes still whole)."""
    bare = F.col("bare")
    cuts = affixes(bare, keep_equals)
    known = stage(first_outcomes(marks, markers, keep_equals), "outcomes")
    # Cut values become columns, so that no test repeats the cutting.
    columns = [
        (cut if kind == "none" else F.when(F.col(f"prefix_{kind}").isNotNull(), cut)).alias(f"_{kind}")
        for kind, cut in cuts.items()
    ]
    stripped = strip_marks(values, known, by).select("*", *columns)

    def every(test: Column, allowed: str) -> Column:
        return F.every(F.when(F.col(allowed), test).otherwise(F.lit(False)))

    aggs = [every(p.is_number(F.col("value"), markers), "ok_raw").alias("raw_number"), F.some("lossy").alias("strip_lossy")]
    for kind in cuts:
        cut = F.col(f"_{kind}")
        if kind != "none":
            tail = F.length(cut) - (1 if kind == "eq" and keep_equals else 0)
            prefix = F.substring(bare, F.lit(1), F.length(bare) - tail)
            aggs.append(F.every(F.coalesce(prefix == F.col(f"prefix_{kind}"), F.lit(False))).alias(f"all_{kind}"))
        # Nulls are left out of the conjunction; it is read only where the affix fits all values.
        aggs += [every(test, f"ok_{kind}_{name}").alias(f"{kind}_{name}") for name, test in _tests(cut, markers).items()]
    keys = [*by, *VARIABLE, "template_line", "begin", "end", "marks", *[f"prefix_{kind}" for kind in cuts if kind != "none"]]
    aggs += [F.count(F.lit(1)).alias("n_values"), F.min("first_line").alias("format_line")]
    flags = stripped.groupBy(*keys).agg(*aggs)
    affix = F.lit("none")
    for kind in ["eq", "hex", "ip", "url"]:
        affix = F.when(F.col(f"all_{kind}"), F.lit(kind)).otherwise(affix)
    chosen = flags.withColumn("affix", F.when(F.col("raw_number"), F.lit("raw")).otherwise(affix))

    def holds(test: str) -> Column:
        out = F.lit(False)
        for kind in ["none", "url", "ip", "hex", "eq"]:
            out = F.when(F.col("affix") == kind, F.col(f"{kind}_{test}")).otherwise(out)
        return out

    component = F.lit(COMPONENT)
    for kind in ["url", "ip", "hex", "eq"]:
        component = F.when(
            F.col("affix") == kind, F.concat(F.col(f"prefix_{kind}"), F.lit(COMPONENT))
        ).otherwise(component)
    token_format = F.when(F.col("affix") == "raw", F.lit(COMPONENT)).otherwise(fill(F.col("marks"), component))
    typed = chosen.withColumn("TokenFormat", token_format).withColumn(
        "ValueType",
        F.when((F.col("affix") == "raw") | holds("dot") | holds("number"), F.lit("Value"))
        .when(holds("unit"), F.lit("Unit"))
        .when(holds("host"), F.lit("Identifier"))
        .when(holds("path"), F.lit("Path"))
        .when(holds("macro"), F.lit("Macro"))
        .when(F.col("TokenFormat").contains("url="), F.lit("Path"))
        .otherwise(F.lit("Undecided")),
    )
    return typed.select(
        *by, *VARIABLE, "template_line", "begin", "end", "affix", "TokenFormat", "ValueType",
        (holds("dot") & (F.col("affix") != "raw")).alias("is_dot"),
        (F.col("strip_lossy") & (F.col("affix") != "raw")).alias("strip_lossy"),
        F.when(F.col("ValueType") == "Identifier", F.lit("<D>:<D>")).otherwise(F.lit(SLOT)).alias("component"),
        "n_values", "format_line",
    )


def tail_of(bare: Column, affix: Column) -> Column:
    """The tail that the affix of a variable keeps of a token without marks; empty where it has none."""
    tails = _tails(bare)
    return F.when(affix == "ip", tails["ip"]).when(affix == "hex", tails["hex"]).when(affix == "eq", tails["eq"])


def cut_token(token: Column, bare: Column, tail: Column, affix: Column, keep_equals: bool = False) -> Column:
    """Value of a token after cutting the marks and the affix of its variable.

    ``bare`` is the token without marks and ``tail`` its :func:`tail_of`; as columns of their own they are made once.
    """
    eq = F.concat(F.lit("="), tail) if keep_equals else tail
    return (
        F.when(affix.isin("ip", "hex"), F.when(tail != "", tail))
        .when(affix == "eq", F.when(tail != "", eq))
        .when(affix == "url", F.when(bare.startswith("url="), F.substring(bare, 5, 2**31 - 1)))
        .when(affix == "none", bare)
        .otherwise(token)
    )


def component_and_value(cut: Column, is_dot: Column, component: Column) -> tuple[Column, Column]:
    return (
        F.when(is_dot, p.dot_suffix_format(cut)).otherwise(component),
        F.when(is_dot, F.regexp_extract(cut, p.DOT_SUFFIX, 3)).otherwise(cut),
    )


def normalised_values(values: DataFrame, facts: DataFrame, keep_equals: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Long rows (…facts, token, value, ComponentFormat, first_line) with affixes and marks cut off."""
    joined = values.withColumnRenamed("value", "token").join(facts, [*by, *VARIABLE])
    bare = p.cut(F.col("token"), F.col("begin"), F.col("end"))
    cut = cut_token(F.col("token"), F.col("_bare"), F.col("_tail"), F.col("affix"), keep_equals)
    component, value = component_and_value(F.col("_v"), F.col("is_dot"), F.col("component"))
    # Each step is a column, so that none is repeated in the next: code too long for the JVM's compiler runs many times slower.
    steps = joined.withColumn("_bare", bare).withColumn("_tail", tail_of(F.col("_bare"), F.col("affix"))).withColumn("_v", cut)
    return steps.select(
        *by, *VARIABLE, "template_line", "TokenFormat", "ValueType", "strip_lossy", "token", "first_line",
        # Never null, as all values of a variable with dot suffixes have one; saying so spares the join on it a null test that would cut again.
        F.coalesce(component, F.lit("")).alias("ComponentFormat"), value.alias("value"),
    )


def classify(
    values: DataFrame, markers: Sequence[str] | Column = (), keep_equals: bool = False, by: Sequence[str] = ()
) -> Classified:
    """Variables with their types and DynamicIDs, and their normalised values.

    ``values`` should be a written table (see ``stage``): it is read three times.
    A variable of dotted suffixes gives one DynamicID per format.  With ``by`` the values of many
    log sets are typed in one job; ``markers`` may then be an array column that depends on the set.
    DynamicIDs are numbered through all sets, in their order.
    """
    marks = stage(punctuation(first_values(values, by), by), "marks")
    facts = stage(variable_facts(values, marks, markers, keep_equals, by), "facts")
    keys = [*by, *VARIABLE, "template_line", "TokenFormat", "ComponentFormat", "ValueType", "strip_lossy"]
    plain = facts.where("not is_dot").select(
        *[F.col("component").alias(k) if k == "ComponentFormat" else k for k in keys], "format_line", "n_values"
    )
    dotted = normalised_values(values, facts.where("is_dot"), keep_equals, by).groupBy(*keys)
    dotted = dotted.agg(F.min("first_line").alias("format_line"), F.count(F.lit(1)).alias("n_values"))
    formats = plain.unionByName(dotted)
    variables = stage(
        number_by_order(formats, [*by, "template_line", "pos", "format_line", "ComponentFormat"], "DynamicID"), "variables"
    )
    rows = normalised_values(values, facts, keep_equals, by)
    ids = variables.select("DynamicID", *by, *VARIABLE, "ComponentFormat")
    numbered = rows.join(ids, [*by, *VARIABLE, "ComponentFormat"]).select(*by, "DynamicID", "ValueType", "token", "value", "first_line")
    return Classified(variables, numbered, facts)
