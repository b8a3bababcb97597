"""Formats of values, found by rule from the values themselves.

A value's format depends on the value and on what is common to the values of its group
that have the same delimiters.  Both are settled by hash aggregates, so each value gets
its format by one equality join on a small table instead of trying patterns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats as fm
from ..functions import predicates as p
from .match import collapse_entities, cover_all, match_formats, unmatched_values, used_formats
from .match import rejected_formats as match_rejected
from .sampling import MAX_TOKENS, MIN_VALUES, token_budget_sample
from .staging import stage, stage_narrow

# Fixed patterns of values that stand for one undivided thing.
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://"
DOTTED = r"^[A-Za-z0-9_$-]+(?:\.[A-Za-z0-9_$-]+)+$"
MAC = r"^[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5,}$"
SLOT_LIKE = ["<D", "D>"]
JOINED = r"[@:=$#]"
ENTITY = r"[^@:=$#]+"
DELIMITERS = r"[^_-]+"
DIGITS = r"\d+"

OTHER_BUCKET = "(other)"
WHOLE_GROUP = "(all)"


def open_groups(values: DataFrame) -> DataFrame:
    """Groups that still have an undecided member."""
    return (
        values.groupBy("GroupID").agg(F.some(F.col("ValueType") == "Undecided").alias("open")).where("open").select("GroupID")
    )


def merged_values(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values over all members of each group; a group belongs to one log set."""
    return values.groupBy(*by, "GroupID", "value").agg(F.min("first_line").alias("first_line"))


Prefixes = Sequence[str] | Column


def is_given(prefixes: Prefixes) -> bool:
    return isinstance(prefixes, Column) or bool(prefixes)


def bucket_of(value: Column, prefixes: Prefixes) -> Column:
    """The first prefix that the value starts with; ``prefixes`` may be an array column where they differ by row."""
    if isinstance(prefixes, Column):
        found = F.get(F.filter(prefixes, lambda p: value.startswith(p)), F.lit(0))
        return F.when(F.size(prefixes) == 0, F.lit(WHOLE_GROUP)).otherwise(F.coalesce(found, F.lit(OTHER_BUCKET)))
    bucket = F.lit(OTHER_BUCKET)
    for prefix in reversed(list(prefixes)):
        bucket = F.when(value.startswith(prefix), F.lit(prefix)).otherwise(bucket)
    return bucket


def bucket_sizes(merged: DataFrame, prefixes: Prefixes) -> DataFrame:
    """(GroupID, bucket, used, split): buckets of a single value are not used, and a group
    without any usable bucket is not split."""
    placed = merged.select("GroupID", bucket_of(F.col("value"), prefixes).alias("bucket"))
    sizes = placed.groupBy("GroupID", "bucket").agg((F.count(F.lit(1)) >= 2).alias("used"))
    split = sizes.groupBy("GroupID").agg(F.some("used").alias("split"))
    return stage(sizes.join(split, "GroupID"), "buckets")


def prefix_buckets(merged: DataFrame, prefixes: Prefixes, sizes: DataFrame | None = None) -> DataFrame:
    """Add bucket and used: the first prefix a value starts with."""
    if not is_given(prefixes):
        return merged.withColumn("bucket", F.lit(WHOLE_GROUP)).withColumn("used", F.lit(True))
    sizes = bucket_sizes(merged, prefixes) if sizes is None else sizes
    placed = merged.withColumn("bucket", bucket_of(F.col("value"), prefixes))
    return placed.join(sizes, ["GroupID", "bucket"]).select(
        *merged.columns,
        F.when(F.col("split"), F.col("bucket")).otherwise(F.lit(WHOLE_GROUP)).alias("bucket"),
        (F.col("used") | ~F.col("split")).alias("used"),
    )


def _whole(value: Column) -> Column:
    return (
        reduce(Column.__or__, [value.contains(part) for part in SLOT_LIKE])
        | (value.contains("://") & value.rlike(URL))
        | (value.contains(".") & value.rlike(DOTTED))
        | value.rlike(MAC)
        | p.is_path(value)
        | (value == "")
    )


def with_shape(values: DataFrame) -> DataFrame:
    """Add _kind and, for values cut at ``_`` and ``-``, _shape (their delimiters)."""
    value = F.col("value")
    return values.withColumn("_kind", kind_of(value)).withColumn("_shape", shape_of(value))


def kind_of(value: Column) -> Column:
    return (
        F.when(p.is_host_port(value), "joined")
        .when(_whole(value), "whole")
        .when(value.rlike(JOINED), "joined")
        .otherwise("parts")
    )


def shape_of(value: Column) -> Column:
    return F.regexp_replace(value, DELIMITERS, "")


def segments(text: Column) -> Column:
    # A single character is split at without a pattern.
    return F.split(F.translate(text, "-", "_"), "_", -1)


def segment_parts(value: Column, same: Column) -> Column:
    """Parts of a value cut at its delimiters.

    All letters and delimiters of a value are literals of its format, unless its segment is
    one whole slot; so a format has just one match, and the parts can be cut out directly.
    """
    inner = F.zip_with(
        segments(value),
        same,
        lambda text, agreed: F.when(agreed, F.regexp_extract_all(text, F.lit(DIGITS), F.lit(0))).otherwise(F.array(text)),
    )
    return F.flatten(inner)


def direct_format(value: Column, whole: Column) -> tuple[Column, Column]:
    """Format and parts of a value that needs no comparison with others."""
    return (
        F.when(whole, F.lit(fm.SLOT)).otherwise(F.regexp_replace(value, ENTITY, fm.SLOT)),
        F.when(whole, F.array(value)).otherwise(F.regexp_extract_all(value, F.lit(ENTITY), F.lit(0))),
    )


def shape_formats(shaped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, _shape, _same, Format) from the written output of :func:`with_shape`.

    ``_same`` tells for each segment whether all values agree on it up to digits.
    """
    value = F.col("value")
    parts = shaped.where("_kind = 'parts'")
    group = [*keys, "_shape"]
    # Any member may serve as the model the others are compared with; the smallest hash
    # picks one without sorting strings.
    picked = stage(parts.groupBy(*group).agg(F.min(F.xxhash64("value")).alias("_x")), "picked")
    models = parts.withColumn("_x", F.xxhash64("value")).join(picked, [*group, "_x"])
    models = stage(models.groupBy(*group).agg(F.min("value").alias("_model")), "models")

    def pattern(text: Column) -> Column:
        return F.regexp_replace(text, DIGITS, fm.SLOT)

    zipped = F.arrays_zip(segments(pattern(value)).alias("s"), segments(pattern(F.col("_model"))).alias("m"))
    pairs = parts.join(models, group).select(*group, F.posexplode_outer(zipped).alias("_i", "_z"))
    agreed = pairs.groupBy(*group, "_i").agg(F.every(F.col("_z.s") == F.col("_z.m")).alias("_same"))
    flags = agreed.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_i", "_same"))).alias("_flags"))
    pieces = F.zip_with(
        segments(pattern(F.col("_model"))), "_same", lambda text, same: F.when(same, text).otherwise(fm.SLOT)
    )
    marks = F.filter(F.split("_shape", ""), lambda mark: mark != "")
    text = F.array_join(
        F.zip_with(pieces, marks, lambda piece, mark: F.concat(piece, F.coalesce(mark, F.lit("")))), ""
    )
    joined = flags.withColumn("_same", F.col("_flags._same")).join(models, group)
    return stage(joined.select(*group, "_same", text.alias("Format")), "formats")


def propose_formats(shaped: DataFrame, keys: Sequence[str], built: DataFrame | None = None) -> DataFrame:
    """(keys…, value, Format, Parts); ``built`` are the :func:`shape_formats` of ``shaped`` if they are known.

    Addresses, paths and package names are one slot; texts joined by ``@ : = $ #`` one
    slot per part; the rest is cut at ``_`` and ``-``, where a segment keeps the letters
    all values agree on and digits become slots.
    """
    columns = [c for c in shaped.columns if not c.startswith("_")]
    built = shape_formats(shaped, keys) if built is None else built
    by_shape = shaped.where("_kind = 'parts'").join(built, [*keys, "_shape"])
    by_shape = by_shape.select(*columns, "Format", segment_parts(F.col("value"), F.col("_same")).alias("Parts"))
    fmt, parts = direct_format(F.col("value"), F.col("_kind") == "whole")
    direct = shaped.where("_kind <> 'parts'").select(*columns, fmt.alias("Format"), parts.alias("Parts"))
    return direct.unionByName(by_shape)


class GroupRules(NamedTuple):
    """What must be known of each group to format its values: small tables, and ``placed``, its distinct values with their buckets."""

    prefixes: Prefixes
    sizes: DataFrame | None
    shapes: DataFrame
    placed: DataFrame


def group_rules(values: DataFrame, prefixes: Prefixes = (), by: Sequence[str] = ()) -> GroupRules:
    """Rules of the open groups of (GroupID, ValueType, value, first_line)."""
    merged = merged_values(values.join(stage(open_groups(values), "open"), "GroupID"), by).drop("first_line")
    shaped = stage(with_shape(merged), "shaped")
    sizes = bucket_sizes(shaped, prefixes) if is_given(prefixes) else None
    placed = prefix_buckets(shaped, prefixes, sizes)
    return GroupRules(prefixes, sizes, shape_formats(placed.where("used"), ["GroupID", "bucket"]), placed)


def group_formats(
    values: DataFrame,
    prefixes: Prefixes = (),
    proposer: Callable[[DataFrame], DataFrame] | None = None,
    by: Sequence[str] = (),
    rules: GroupRules | None = None,
) -> DataFrame:
    """(GroupID, value, Format, Parts) for every value of every open group.

    ``rules`` are the :func:`group_rules` of the same values if they are known.  ``proposer`` may replace the rules: it gets all (GroupID, value) and returns (GroupID, Format), which are
    tried in order, specific ones first.  See :func:`proposed_formats` for one that sees samples and answers in text.
    """
    if proposer is not None:
        merged = merged_values(values.join(stage(open_groups(values), "open"), "GroupID"), by).drop("first_line")
        return collapse_entities(cover_all(match_formats(merged.drop(*by), proposer(merged), "GroupID"))).drop("matched")
    rules = group_rules(values, prefixes, by) if rules is None else rules
    placed = rules.placed
    proposed = propose_formats(placed.where("used"), ["GroupID", "bucket"], rules.shapes)
    alone = placed.where("not used").withColumn("Format", F.lit(fm.SLOT)).withColumn("Parts", F.array("value"))
    found = proposed.unionByName(alone.select(*proposed.columns))
    return collapse_entities(found).drop("bucket", "used", *by)


class Proposed(NamedTuple):
    """``formats``: (GroupID, value, Format, Parts); ``rejected``: (GroupID, bucket, attempt, text, reason)."""

    formats: DataFrame
    rejected: DataFrame


NOT_A_LIST, UNUSED = "not a list", "fits no value"


def proposed_formats(
    values: DataFrame,
    proposer: Callable[[DataFrame, int], DataFrame],
    prefixes: Prefixes = (),
    rounds: int = 5,
    max_tokens: int = MAX_TOKENS,
    at_least: int = MIN_VALUES,
    by: Sequence[str] = (),
) -> Proposed:
    """Formats that a proposer suggests, checked against all values of the open groups.

    In each round every bucket that still has values without a format is sampled to its budget;
    ``proposer`` gets (GroupID, bucket, samples), the shortest values first, with the number of the round, and
    answers with (GroupID, bucket, answer), each answer a JSON list of formats.  Answers that are no such list
    are rejected, broken slots are mended, and values that a format fits leave the rest.  A bucket may get
    several answers, or none.  At most ``rounds`` rounds; values left over keep their whole text as one slot.

    In the end each value takes the first format of its group that fits, over all buckets and rounds.  Formats that
    fit no value of their bucket when they are proposed are rejected, like answers that are no list.
    """
    merged = merged_values(values.join(stage(open_groups(values), "open"), "GroupID"), by)
    merged = stage(merged, "merged")
    placed = prefix_buckets(merged, prefixes).where("used").select("GroupID", "bucket", "value", "first_line")
    left, keys = stage(placed, "left"), ["GroupID", "bucket"]
    verified, rejected = [], []
    for attempt in range(1, rounds + 1):
        if left.isEmpty():
            break
        sample = token_budget_sample(left, keys, max_tokens, at_least)
        in_order = F.array_sort(F.collect_list(F.struct(F.length("value").alias("n"), "first_line", "value")))
        samples = sample.groupBy(*keys).agg(in_order["value"].alias("samples"))  # no longer than the budget
        answers = proposer(stage(samples, "samples"), attempt).select(*keys, "answer", fm.json_list(F.col("answer")).alias("_list"))
        answers = stage(answers, "answers")
        fmt = F.explode(F.filter("_list", lambda f: f.isNotNull()))
        formats = answers.select(*keys, fmt.alias("Format")).select(*keys, fm.merge_slots(fm.repair(F.col("Format"))).alias("Format"))
        formats = stage(formats.distinct(), "proposed")
        matched = stage(match_formats(left, formats, keys), "matched")
        verified.append(used_formats(matched, keys).select("GroupID", "Format"))
        broken = answers.where("_list is null").select(*keys, F.col("answer").alias("text"), F.lit(NOT_A_LIST).alias("reason"))
        unused = match_rejected(matched, formats, keys).select(*keys, F.col("Format").alias("text"), F.lit(UNUSED).alias("reason"))
        rejected.append(broken.unionByName(unused).withColumn("attempt", F.lit(attempt)))
        left = stage(unmatched_values(matched), "left")
    none = merged.where("false")
    formats = reduce(DataFrame.union, verified, none.select("GroupID", F.col("value").alias("Format"))).distinct()
    texts = none.select("GroupID", F.lit("").alias("bucket"), F.lit(0).alias("attempt"), F.col("value").alias("text"), F.lit("").alias("reason"))
    found = match_formats(merged.drop("first_line", *by), stage(formats, "verified"), "GroupID")
    found = collapse_entities(cover_all(found)).drop("matched")
    return Proposed(found, reduce(DataFrame.unionByName, rejected, texts))


def format_rows(variables: DataFrame, values: DataFrame, formats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The format table in long form (schema FORMAT_ROWS): decided and filled rows.

    ``variables`` has GroupID; ``values`` has DynamicID, token, value, first_line.
    """
    facts = variables.select(
        *by, "DynamicID", F.col("NewTemplate").alias("Template"), F.col("pos").cast("int").alias("ParameterIndex"),
        "TokenFormat", "ComponentFormat", "ValueType", F.col("GroupID").cast("long").alias("GroupID"),
    )
    rows = values.select("DynamicID", "token", "value", "first_line").join(facts, "DynamicID")
    decided = rows.where("ValueType <> 'Undecided'").withColumn("Parts", F.array("value"))
    filled = (
        rows.where("ValueType = 'Undecided'")
        .drop("ComponentFormat")
        .join(formats, ["GroupID", "value"])
        .withColumnRenamed("Format", "ComponentFormat")
    )
    columns = [
        *by, "DynamicID", "Template", "ParameterIndex", "TokenFormat", F.col("token").alias("Token"), "ComponentFormat",
        F.col("value").alias("Value"), "Parts", "ValueType", "GroupID", F.col("first_line").alias("FirstLine"),
    ]
    return decided.select(*columns).unionByName(filled.select(*columns))


def stage_format_rows(rows: DataFrame) -> DataFrame:
    """The written table of :func:`format_rows`: most values are their tokens, and most have themselves for their only part."""
    return stage_narrow(rows, "formats", {"Value": F.col("Token"), "Parts": F.array("Value")})


def variable_formats(variables: DataFrame, values: DataFrame) -> DataFrame:
    """Long format table with formats found for each variable on its own."""
    alone = variables.drop("GroupID").withColumn("GroupID", F.col("DynamicID"))
    own = values.withColumn("GroupID", F.col("DynamicID")).where("ValueType = 'Undecided'")
    return format_rows(alone, values, group_formats(own))


def nested_formats(rows: DataFrame, chunk_rows: int = 10_000) -> DataFrame:
    """Format table with list columns, one row per variable, format and chunk of values.

    Lists are cut into chunks of about ``chunk_rows`` values, so that no task builds an
    unbounded list; a small variable has a single chunk 0.
    """
    keys, facts = ["DynamicID", "ComponentFormat"], ["Template", "ParameterIndex", "TokenFormat", "ValueType", "GroupID"]
    chunks = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("long").alias("_chunks"))
    owners = rows.select(*keys, *facts).distinct().join(stage(chunks, "chunks"), keys)
    owners = stage(owners.withColumn("_owner", F.monotonically_increasing_id()), "owners")
    # Values are dealt by number and chunk before they are listed: gathering lists first would sort and spill all rows with their
    # facts.  Parts travel only where they differ from the token.
    renamed = owners.select("_owner", "_chunks", *[F.col(c).alias(f"_f{i}") for i, c in enumerate([*keys, *facts])])
    same_owner = [F.col(c).eqNullSafe(F.col(f"_f{i}")) for i, c in enumerate([*keys, *facts])]
    whole = F.coalesce(F.col("Parts") == F.array("Token"), F.lit(False))
    item = F.struct("FirstLine", "Token", F.when(~whole, F.col("Parts")).alias("Parts"), whole.alias("whole"))
    chunk = F.pmod(F.xxhash64("Token", "Value"), F.col("_chunks")).alias("Chunk")
    dealt = rows.join(renamed, same_owner).select("_owner", chunk, item.alias("_row")).repartition("_owner", "Chunk")
    full = F.struct("_row.FirstLine", "_row.Token", F.when(F.col("_row.whole"), F.array("_row.Token")).otherwise(F.col("_row.Parts")).alias("Parts"))
    lists = dealt.groupBy("_owner", "Chunk").agg(F.array_sort(F.collect_list(full)).alias("_rows"))
    return lists.join(owners, "_owner").select(
        "DynamicID", "Template", "ParameterIndex", "TokenFormat", "ComponentFormat", "ValueType", "GroupID", "Chunk",
        F.col("_rows.Token").alias("Tokens"), F.col("_rows.Parts").alias("ValueList"),
    )
