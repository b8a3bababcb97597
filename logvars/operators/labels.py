"""Label sheets for annotators and the agreement of two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.templates import is_dynamic, replace_nth_hole
from .extract import extract_parameters
from .ranking import before_edge, edge_rows, hash_key, hash_numbers, prefix_edges, prefix_rows, with_keys
from .staging import stage
from .variables import first_lines

SEED = "line-sample"


def sample_lines(lines: DataFrame, n: int, seed: str = SEED) -> DataFrame:
    """``n`` lines of each template in a reproducible random order (all, if it has fewer).

    Lines are chosen by template and number alone, before anything else about them is computed.
    """
    keys = ["EventTemplate", "LineId"]
    hashed = stage(lines.select(*keys).withColumn("_h", hash_key(seed, "LineId")), "line-hashes")
    chosen = prefix_rows(hashed, ["EventTemplate"], hash_numbers(F.col("_h")), ["_h", "LineId"], F.lit(n))
    chosen = stage(chosen.select(*keys).distinct(), "chosen-lines")
    on = [lines[k].eqNullSafe(chosen[k]) for k in keys]
    return lines.join(chosen, on, "left_semi")


def parameter_label_sheet(lines: DataFrame, templates: DataFrame, n: int, seed: str = SEED) -> DataFrame:
    """(Template, LineId, Log, Index, Value): every parameter of the sampled lines.

    ``lines`` has ParameterList as an array, or is not extracted yet: then only the sampled lines are.
    """
    wanted = templates.where(is_dynamic(F.col("EventTemplate"))).select("EventTemplate").distinct()
    sampled = sample_lines(lines.join(wanted, "EventTemplate", "left_semi"), n, seed)
    if "NewTemplate" not in lines.columns:
        sampled = extract_parameters(sampled)
    return sampled.select(
        F.col("EventTemplate").alias("Template"), "LineId", F.col("Content").alias("Log"),
        F.posexplode("ParameterList").alias("Index", "Value"),
    )


def mark_share(rows: DataFrame, key: str, ratio: float = 0.2, seed: str = SEED) -> DataFrame:
    """Add ``selected``: exactly ``int(n * ratio)`` rows, chosen by hash.

    Only the stretch of hashes in which the share ends is ranked; the rest is decided by its hashes alone.
    """
    here = hash_key(seed, key)
    keyed = stage(with_keys(rows.select(key).withColumn("_h", here), hash_numbers(F.col("_h"))), "share-hashes")
    budget = F.floor(F.col("_total") * F.lit(float(ratio)))
    edges = prefix_edges(keyed, [], budget)
    edge = edges.first()
    if edge is None:
        return rows.withColumn("selected", F.lit(False))
    # The last chosen row of that stretch is the cut; one row comes back.
    order = F.struct("_h", key)
    last = edge_rows(keyed, edges, [], ["_h", key], budget, 0).agg(F.max(order).alias("cut")).first()["cut"]
    bound = {c: F.lit(edge[c]).cast("long") for c in ("_low",)} | {"_at": F.lit(edge["_at"]).cast("array<bigint>")}
    marked = with_keys(rows.withColumn("_h", here), hash_numbers(F.col("_h"))).withColumns(bound)
    selected = before_edge()
    if last is not None:
        selected |= (F.col("_h") < last["_h"]) | ((F.col("_h") == last["_h"]) & (F.col(key) <= F.lit(last[key])))
    return marked.withColumn("selected", selected).select(*rows.columns, "selected")


def format_label_sheet(extracted: DataFrame, formats: DataFrame) -> DataFrame:
    """One row per variable and format with its first value put into the template.

    ``extracted`` is read twice, so it should be a written table (see ``stage``).
    """
    keys = ["DynamicID", "ComponentFormat"]
    first = stage(formats.groupBy(*keys).agg(F.min("FirstLine").alias("FirstLine")), "firsts")
    example = formats.join(first, [*keys, "FirstLine"])
    original = first_lines(extracted, ["EventTemplate"]).select(F.col("NewTemplate").alias("Template"), F.col("EventTemplate").alias("OldTemplate"))
    content = replace_nth_hole(F.col("Template"), F.col("Token"), F.col("ParameterIndex") + 1)
    return example.join(original, "Template").select(
        "OldTemplate", F.col("Template").alias("NewTemplate"), content.alias("Content"), "ParameterIndex",
        "TokenFormat", "Token", "ComponentFormat", F.col("Parts").alias("ValueList"),
    ).orderBy("NewTemplate", "ParameterIndex", "ComponentFormat")


def disagreements(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two aligned sheets (row_id, Type) that carry different types; null is a type."""
    pairs = _pairs(a, b)
    return pairs.where(~F.col("type_a").eqNullSafe(F.col("type_b")))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Percent of equal types among the rows that at least one annotator typed."""
    pairs = _pairs(a, b)
    typed = F.col("type_a").isNotNull() | F.col("type_b").isNotNull()
    differ = ~F.col("type_a").eqNullSafe(F.col("type_b"))
    counts = pairs.agg(F.count_if(typed).alias("n_total"), F.count_if(differ).alias("n_inconsistent"))
    share = F.try_divide((F.col("n_total") - F.col("n_inconsistent")).cast("double"), F.col("n_total").cast("double"))
    return counts.withColumn("percent", share * 100)


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both sheets by number; what only one sheet has stays, untyped by the other."""
    left = a.select(F.col("row_id").alias("id_a"), F.col("Type").alias("type_a"))
    right = b.select(F.col("row_id").alias("id_b"), F.col("Type").alias("type_b"))
    both = left.join(right, F.col("id_a").eqNullSafe(F.col("id_b")), "full_outer")
    return both.select(F.coalesce("id_a", "id_b").alias("row_id"), "type_a", "type_b")
