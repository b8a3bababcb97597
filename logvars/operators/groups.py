"""Groups of variables that share values or contain each other's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .numbering import number_by_order
from .staging import stage

# Fixed set of characters that may border a contained value.
BOUNDARY = "._:-/\\,;|[](){}<>@#=+?"


def shared_value_edges(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(src, dst) from the smallest DynamicID of a value to every other one that has it.

    A star per value (of one log set, with ``by``) instead of all pairs.
    """
    linkable = values.where(~F.col("ValueType").isin("Value", "Unit")).select(*by, "value", "DynamicID")
    ends = linkable.groupBy(*by, "value").agg(F.min("DynamicID").alias("src"), F.max("DynamicID").alias("last"))
    # Few values are shared: only those are joined back.
    shared = stage(ends.where("src <> last").select(*by, "value", "src"), "shared-values")
    return linkable.join(shared, [*by, "value"]).select("src", F.col("DynamicID").alias("dst")).where("src <> dst").distinct()


def number_groups(components: DataFrame) -> DataFrame:
    """(DynamicID, GroupID): groups counted from 1 in order of their first member."""
    roots = number_by_order(components.select("component").distinct(), ["component"], "GroupID", start=1)
    return components.join(roots, "component").select(F.col("id").alias("DynamicID"), "GroupID")


def same_value_groups(variables: DataFrame, values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    nodes = variables.select(F.col("DynamicID").alias("id"))
    return number_groups(stage(connected_components(nodes, shared_value_edges(values, by)), "components"))


def attach_groups(table: DataFrame, groups: DataFrame) -> DataFrame:
    """Add GroupID by DynamicID; 0 where there is none."""
    return table.join(groups, "DynamicID", "left").fillna(0, ["GroupID"])


#: Modulus and base of the hashes of stretches; products of two residues fit a long.
_PRIME, _BASE = (1 << 31) - 1, 1_103_515_245
_START = "\x01"


def _power(exponent: Column) -> Column:
    """Base to the power of a number below 2^31, modulo the prime, by its bits."""
    found = F.lit(1).cast("long")
    for bit in range(31):
        factor = F.when(exponent.bitwiseAND(1 << bit) != 0, pow(_BASE, 1 << bit, _PRIME)).otherwise(1)
        found = found * factor % _PRIME
    return found


def _cut_texts(texts: DataFrame) -> DataFrame:
    """(id, k, j, begin, size, head, term): a narrow row for each piece between boundary characters.

    ``head`` is the hash of the piece, ``term`` its part in the hash of a stretch: the hash of the piece with the
    boundary before it, times the base to the power of its place.  Each text is read once, and cut at its boundaries.
    """
    boundary = "[" + "".join("\\" + c for c in BOUNDARY) + "]"
    # With a character in front, every piece has one before it.
    pieces = F.split(F.concat(F.lit(_START), F.col("text")), f"(?={boundary})", -1)
    rows = texts.select("id", pieces.alias("_p")).select("id", F.size("_p").alias("k"), F.posexplode("_p").alias("j", "e"))
    term = F.pmod(F.xxhash64("e"), F.lit(_PRIME)) * _power(F.col("j")) % _PRIME
    return rows.select("id", "k", "j", F.length("e").alias("size"), F.xxhash64(F.substring("e", 2, 2**31 - 1)).alias("head"), term.alias("term"))


def contained_pairs(values: DataFrame) -> DataFrame:
    """Distinct (short, long): ``short`` lies in ``long`` between boundary characters.

    The pair test becomes equality joins of hashes.  Each piece of a long value may open a stretch of as many pieces
    as some short value that begins with that piece; the hash of such a stretch is the difference of two prefix
    hashes.  Only what meets the hash of a short value fetches its texts, which decide.  Only the first occurrence
    counts, all-digit and empty values are never the short side.
    """
    texts = values.select(F.col("value").alias("text")).distinct().withColumn("id", F.monotonically_increasing_id())
    texts = stage(texts, "texts")  # written, so that ids stay
    pieces = stage(_cut_texts(texts), "pieces")
    shorts = texts.where(~F.col("text").rlike(r"^\d*$")).select("id")
    whole = pieces.join(shorts, "id").groupBy("id", "k").agg(
        F.min(F.when(F.col("j") == 0, F.col("head"))).alias("head"),
        # The first piece stands for itself, whatever is before it; it has the power 0.
        (F.sum(F.when(F.col("j") > 0, F.col("term")).otherwise(0)) % _PRIME).alias("rest"),
    )
    whole = stage(whole.select(F.col("id").alias("short_id"), F.col("k").alias("n"), "head", "rest"), "short-hashes")
    widths = stage(whole.select("head", "n").distinct(), "widths")
    along = Window.partitionBy("id").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = pieces.where("k > 1").select(
        "id", "k", "j", "head", (F.sum("term").over(along) % _PRIME).alias("upto"),
        (F.sum("size").over(along) - F.col("size")).cast("int").alias("begin"),
    )
    summed = stage(summed, "prefix-hashes")
    # A proper stretch has fewer pieces than its value.
    opened = summed.join(widths, "head").where("j + n <= k and n < k").select(
        "id", "head", "n", "j", "begin", (F.col("j") + F.col("n") - 1).alias("last"), F.col("upto").alias("before")
    )
    ends = summed.select("id", F.col("j").alias("last"), "upto")
    stretch = opened.join(ends, ["id", "last"]).withColumn("stretch", F.pmod(F.col("upto") - F.col("before"), F.lit(_PRIME)))
    # Shifted back to the place of the short value's own pieces by the inverse of the power.
    inverse = _power((F.lit(_PRIME - 1) - F.col("j").cast("long") % (_PRIME - 1)) % (_PRIME - 1))
    keyed = stretch.select("id", "head", "n", "begin", (F.col("stretch") * inverse % _PRIME).alias("rest"))
    hits = keyed.join(whole, ["head", "n", "rest"]).select("id", "short_id", "begin")
    found = hits.join(texts.select("id", F.col("text").alias("long")), "id")
    found = found.join(texts.select(F.col("id").alias("short_id"), F.col("text").alias("short")), "short_id")
    return found.where("instr(long, short) = begin + 1").select("short", "long").distinct()


def contained_values(values: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(DynamicID, long, short, sub): values of a variable with the contained part marked; ``pairs`` as in :func:`containment_groups`."""
    pairs = contained_pairs(values) if pairs is None else pairs
    owners = values.select("DynamicID", F.col("value").alias("long")).distinct()
    marked = pairs.withColumn("sub", F.replace(F.col("long"), F.col("short"), F.lit("<sub>")))
    return owners.join(marked, "long").select("DynamicID", "long", "short", "sub")


def group_texts(groups: DataFrame, contained: DataFrame, chunk_rows: int = 1000) -> DataFrame:
    """(GroupID, DynamicID, Chunk, subs): the texts with ``<sub>`` of each variable of a containment group.

    ``contained`` are the :func:`contained_values`.  Distinct texts in order, in chunks of about ``chunk_rows``, so that
    no list grows with a variable.
    """
    texts = contained.select("DynamicID", "sub").distinct().join(groups, "DynamicID")
    texts = stage(texts.select("GroupID", "DynamicID", "sub"), "group-texts")
    keys = ["GroupID", "DynamicID"]
    sizes = texts.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("long").alias("_chunks"))
    cut = texts.join(stage(sizes, "group-chunks"), keys).withColumn("Chunk", F.pmod(F.xxhash64("sub"), F.col("_chunks")))
    return cut.groupBy(*keys, "Chunk").agg(F.array_sort(F.collect_list("sub")).alias("subs"))


def containment_groups(variables: DataFrame, values: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(DynamicID, GroupID) of variables linked by contained values (Undecided ones only).

    ``pairs`` is the written table of their :func:`contained_pairs` if it is known.

    Each matched value is represented by its smallest variable, so edges grow with the
    matches, not with products of variables.
    """
    undecided = values.where(F.col("ValueType") == "Undecided") if "ValueType" in values.columns else values
    owners = undecided.select("DynamicID", "value").distinct()
    pairs = stage(contained_pairs(undecided), "pairs") if pairs is None else pairs
    matched = pairs.select(F.col("short").alias("value")).union(pairs.select("long")).distinct()
    held = stage(
        owners.join(matched, "value").withColumn("rep", F.min("DynamicID").over(Window.partitionBy("value"))), "held"
    )
    reps = held.groupBy("value").agg(F.min("DynamicID").alias("rep"))
    across = (
        pairs.join(reps.select(F.col("value").alias("short"), F.col("rep").alias("src")), "short")
        .join(reps.select(F.col("value").alias("long"), F.col("rep").alias("dst")), "long")
        .select("src", "dst")
    )
    edges = across.union(held.select(F.col("rep").alias("src"), F.col("DynamicID").alias("dst"))).distinct()
    nodes = variables.select(F.col("DynamicID").alias("id"))
    return number_groups(stage(connected_components(nodes, edges), "components"))
