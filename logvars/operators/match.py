"""Given formats against values: order, first match, cover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats as fm
from ..functions.formats import SLOT
from .staging import stage


#: Characters of a format's literal text by which it is looked up.
STRETCH = 12
#: Formats of a group with the same stretch that are few, whatever its kind.
FEW = 64
RUN, MARK = "[A-Za-z0-9]+", "[^A-Za-z0-9]"
_PROBE = "struct<kind:string,text:string>"


def _keys(group: str | Sequence[str]) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def _probe(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text")).cast(_PROBE)


def format_index(formats: DataFrame, group: str | Sequence[str]) -> DataFrame:
    """``formats`` (group, Format, …) with ``kind`` and ``text``: one literal stretch that every fitting value has.

    ``whole``: a format without slots; ``head``, ``tail``: how values begin or end; ``word``: a run of letters
    and digits that they contain between other characters; ``mark``: one such other character; ``middle``:
    letters and digits that they contain anywhere; ``any``: a format without text of its own.  Of several
    stretches that with the fewest formats of the group is taken, then the longest, but ``middle`` last of those with few.
    """
    keys = _keys(group)
    pieces = F.split("Format", SLOT, -1)
    last = F.size(pieces) - 1

    def stretch(piece: Column, i: Column) -> Column:
        return (
            F.when((last == 0), _probe("whole", piece))
            .when(piece == "", F.lit(None).cast(_PROBE))
            .when(i == 0, _probe("head", F.left(piece, F.lit(STRETCH))))
            .when(i == last, _probe("tail", F.right(piece, F.lit(STRETCH))))
            .when(word(piece) != "", _probe("word", word(piece)))
            .when(mark(piece) != "", _probe("mark", mark(piece)))
            .otherwise(_probe("middle", F.left(piece, F.lit(STRETCH))))
        )

    def word(piece: Column) -> Column:
        return F.regexp_extract(piece, f"{MARK}({RUN}){MARK}", 1)

    def mark(piece: Column) -> Column:
        return F.regexp_extract(piece, MARK, 0)

    found = F.filter(F.transform(pieces, stretch), lambda x: x.isNotNull())
    listed = F.when(F.size(found) > 0, F.array_distinct(found)).otherwise(F.array(_probe("any", F.lit(""))))
    stretches = formats.select(*keys, "Format", F.explode(listed).alias("_at")).distinct()
    shared = stretches.groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("_n"))
    rated = _join(stretches, shared, [*keys, "_at"])
    few = F.greatest("_n", F.lit(FEW)).alias("few")
    rating = F.struct(few, (F.col("_at.kind") == "middle").alias("late"), "_n", (-F.length("_at.text")).alias("l"), "_at")
    chosen = rated.groupBy(*keys, "Format").agg(F.min(rating).alias("_c"))
    return _join(formats, chosen.select(*keys, "Format", "_c._at.kind", "_c._at.text"), [*keys, "Format"])


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", also: Sequence[Column] = ()) -> DataFrame:
    """Join on keys that may be null, and on the conditions ``also``."""
    renamed = right.select(*[F.col(k).alias(f"_k{i}") if k in keys else k for i, k in enumerate(right.columns)])
    names = {k: f"_k{i}" for i, k in enumerate(right.columns) if k in keys}
    return left.join(renamed, [F.col(k).eqNullSafe(F.col(names[k])) for k in keys] + list(also), how).drop(*names.values())


def _bit(text: Column) -> Column:
    """One of 64 bits, by the text's hash."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(text), F.lit(64)).cast("int"))


def _probes(value: Column, wanted: Column) -> Column:
    """The stretches of a value that formats of its group are looked up by; ``wanted``: their kinds, sizes and bits."""
    # An anchored pattern also fits in front of a closing line feed.
    none = F.array().cast("array<string>")
    ends = F.when(value.endswith("\n"), F.array(value, F.left(value, F.length(value) - 1))).otherwise(F.array(value))

    def texts(want: Column) -> Column:
        kind, size = want["kind"], want["size"]
        last = F.length(value) - size + 1
        grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(value, i, size))
        return (
            F.when(kind == "any", F.array(F.lit("")))
            .when(kind == "whole", ends)
            .when(kind == "head", F.when(last > 0, F.array(F.left(value, size))).otherwise(none))
            .when(kind == "tail", F.array_distinct(F.transform(F.filter(ends, lambda x: F.length(x) >= size), lambda x: F.right(x, size))))
            .when(kind == "word", F.array_distinct(F.regexp_extract_all(value, F.lit(RUN), F.lit(0))))
            .when(kind == "mark", F.array_distinct(F.regexp_extract_all(value, F.lit(MARK), F.lit(0))))
            .otherwise(F.when(last > 0, F.array_distinct(grams)).otherwise(none))
        )

    def listed(want: Column) -> Column:
        held = F.filter(texts(want), lambda text: _bit(text).bitwiseAND(want["bits"]) != 0)
        return F.transform(held, lambda text: F.struct(want["kind"].alias("kind"), text.alias("text")).cast(_PROBE))

    # Texts are made distinct for each kind and size: lists of structs would be compared pair by pair.
    # Most of them are no format's; the bits of the formats' texts tell that of nearly all where formats are few.
    return F.flatten(F.transform(wanted, listed))


def candidate_formats(values: DataFrame, formats: DataFrame, group: str | Sequence[str], possible: Column | None = None) -> DataFrame:
    """Rows of ``values`` (group, value, …) with ``_fit``, a struct of the columns of each format that may fit, and its ``_pieces``.

    Candidates come from an equality join on literal stretches (see :func:`format_index`).  Every row stays at least
    once.  ``possible`` is a cheap condition that every fitting pair meets, on columns of ``values`` and of ``_fit``.
    """
    keys = _keys(group)
    index = stage(format_index(formats, group), "format-index")
    size = F.when(F.col("kind").isin("head", "tail", "middle"), F.length("text")).otherwise(F.lit(0))
    # At most one entry for each kind and size up to STRETCH.
    sizes = index.groupBy(*keys, "kind", size.alias("size")).agg(F.bit_or(_bit(F.col("text"))).alias("bits"))
    wanted = sizes.groupBy(*keys).agg(F.collect_list(F.struct("kind", "size", "bits")).alias("_wanted"))
    # Texts that fill a small file only may have many candidates: a fixed number of partitions deals them out.
    dealt = values.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "value")
    probed = _join(dealt, wanted, keys, "left")
    probed = probed.select(*values.columns, F.explode_outer(_probes(F.col("value"), F.col("_wanted"))).alias("_at"))
    fields = [c for c in formats.columns if c not in keys]
    pieces = F.split("Format", SLOT, -1).alias("_pieces")
    entries = index.select(*keys, F.struct("kind", "text").cast(_PROBE).alias("_at"), F.struct(*fields).alias("_fit"), pieces)
    return _join(probed, entries, [*keys, "_at"], "left", () if possible is None else (possible,)).drop("_at")


def _fits() -> Column:
    return fm.fits(F.col("value"), F.col("_fit.regex"), F.col("_pieces"))


def fitting_formats(values: DataFrame, formats: DataFrame, group: str | Sequence[str]) -> DataFrame:
    """Rows of ``values`` (group, value, …) with ``_fit``, a struct of the columns of each format that fits, or null.

    ``formats`` has Format, regex and more.  The literal texts of candidates only confirm them.  Every row stays at
    least once.
    """
    met = candidate_formats(values, formats, group)
    return met.withColumn("_fit", F.when(F.col("_fit").isNotNull() & _fits(), F.col("_fit"))).drop("_pieces")


def order_formats(formats: DataFrame, group: str | Sequence[str] = "GroupKey") -> DataFrame:
    """(group, Format, regex, slots, n_more_general, format_rank), specific formats first.

    A format is more general than another if its pattern matches the other's text but
    not the other way round; both ends are anchored.
    """
    keys = _keys(group)
    clean = formats.select(*keys, fm.merge_slots(F.col("Format")).alias("Format")).distinct()
    clean = clean.withColumn("regex", fm.to_regex(F.col("Format"))).withColumn("slots", fm.count_slots(F.col("Format")))
    # Thousands of formats may share their rarest stretch: most of them have characters that the text has not.
    masks = [fm.character_mask(F.replace(F.col("Format"), F.lit(SLOT), F.lit(""))).alias("mask"), fm.character_mask(F.col("Format")).alias("_mask")]
    clean = stage(clean.select("*", *masks), "clean-formats")
    texts = clean.select(
        *keys, F.col("Format").alias("value"), F.col("regex").alias("_own"), F.split("Format", SLOT, -1).alias("_own_pieces"), "_mask"
    )
    clean = clean.drop("_mask")
    possible = F.col("_fit.mask").bitwiseAND(F.col("_mask")) == F.col("_fit.mask")
    pairs = candidate_formats(texts, clean, group, possible).where(F.col("_fit").isNotNull() & _fits())
    wider = pairs.where(~fm.fits(F.col("_fit.Format"), F.col("_own"), F.col("_own_pieces")))
    counted = wider.groupBy(*keys, F.col("value").alias("Format")).agg(F.count_distinct("_fit.Format").cast("int").alias("n_more_general"))
    rated = _join(clean.drop("mask"), counted, [*keys, "Format"], "left").withColumn("n_more_general", F.coalesce("n_more_general", F.lit(0)))
    order = Window.partitionBy(*keys).orderBy(F.desc("n_more_general"), F.desc(F.length("Format")), "Format")
    return rated.withColumn("format_rank", F.row_number().over(order))


def match_formats(values: DataFrame, formats: DataFrame, group: str | Sequence[str] = "GroupKey") -> DataFrame:
    """Add Format, Parts and matched to each value: the first format of its group that fits.

    Equal rows are matched once.  No list of formats travels with a value: see :func:`fitting_formats`.
    """
    keys = _keys(group)
    ordered = stage(order_formats(formats, group).select(*keys, "format_rank", "Format", "regex"), "formats")
    columns = [F.col(f"`{c}`") for c in values.columns]
    once = values.groupBy(*columns).agg(F.count(F.lit(1)).alias("_times"))
    # The least rank fits a buffer of fixed width; its format follows by number.
    fits = fitting_formats(once, ordered, group).groupBy(*columns, "_times").agg(F.min("_fit.format_rank").alias("_rank"))
    named = ordered.select(*keys, F.col("format_rank").alias("_rank"), F.col("Format").alias("_format"), "regex", F.split("Format", SLOT, -1).alias("_pieces"))
    fits = _join(fits, named, [*keys, "_rank"], "left")
    parts = F.when(F.col("_rank").isNotNull(), fm.parts(F.col("value"), F.col("regex"), F.col("_pieces")))
    found = fits.select(*columns, "_times", F.col("_format").alias("Format"), parts.alias("Parts"), F.col("_rank").isNotNull().alias("matched"))
    again = found.withColumn("_times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return again.drop("_times")


def unmatched_values(matched: DataFrame) -> DataFrame:
    return matched.where(~F.col("matched")).drop("Format", "Parts", "matched")


def used_formats(matched: DataFrame, group: str | Sequence[str] = "GroupKey") -> DataFrame:
    return matched.where("matched").groupBy(*_keys(group), "Format").agg(F.count(F.lit(1)).alias("n_values"))


def rejected_formats(matched: DataFrame, formats: DataFrame, group: str | Sequence[str] = "GroupKey") -> DataFrame:
    """Formats of a group that no value needs."""
    keys = _keys(group)
    candidates = formats.select(*keys, fm.merge_slots(F.col("Format")).alias("Format")).distinct()
    return candidates.join(used_formats(matched, group), [*keys, "Format"], "left_anti")


def collapse_entities(matched: DataFrame) -> DataFrame:
    """Formats of whole addresses or paths become one slot that holds the value."""
    whole = fm.is_single_entity(F.col("Format"))
    return matched.withColumn("Parts", F.when(whole, F.array("value")).otherwise(F.col("Parts"))).withColumn(
        "Format", F.when(whole, F.lit(fm.SLOT)).otherwise(F.col("Format"))
    )


def cover_all(matched: DataFrame) -> DataFrame:
    """Values that no format fits keep their whole text as one slot."""
    return matched.withColumn("Parts", F.coalesce("Parts", F.array("value"))).withColumn(
        "Format", F.coalesce("Format", F.lit(fm.SLOT))
    )
