"""The small format language: literal text with ``<D>`` data slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT = "<D>"
COMPONENT = "<C>"

# Formats of one undivided thing, and the run of slots that counts as one.
IP_FORMAT = r"^(?:<D>\.){3}<D>$"
PATH_FORMAT = r"(?s)^[A-Za-z]:[\\/]|/.*/|\\\\.*\\\\"
RUN_OF_SLOTS = r"(?:<D>\s*){2,}"


def to_regex(fmt: Column) -> Column:
    """Anchored pattern: literals escaped, each slot a greedy group."""
    pieces = F.split(fmt, SLOT, -1)
    quoted = F.transform(pieces, lambda p: F.regexp_replace(p, r"([^A-Za-z0-9_ ])", r"\\$1"))
    return F.concat(F.lit("(?d)^"), F.array_join(quoted, "(.*)"), F.lit("$"))


def fits(value: Column, regex: Column, pieces: Column) -> Column:
    """Whether the pattern of a format, whose literal texts are ``pieces``, matches a value.

    Slots take any text without a line feed, so for a value without one the texts need only be found in order, each at
    its first place after the one before; no pattern is compiled for a pair.
    """
    last = F.size(pieces) - 1
    head, tail = F.get(pieces, F.lit(0)), F.get(pieces, last)

    def after(at: Column, piece: Column) -> Column:
        found = F.call_function("locate", piece, value, at)
        return F.when((at == 0) | (found == 0), 0).otherwise(found + F.length(piece))

    def in_order() -> Column:
        inner = F.slice(pieces, F.lit(2), last - 1)
        ending = F.length(value) - F.length(tail) + 1
        return F.aggregate(inner, F.length(head) + 1, after, lambda at: (at > 0) & (at <= ending))

    enclosed = value.startswith(head) & value.endswith(tail) & (F.length(head) + F.length(tail) <= F.length(value))
    found = F.when(last == 0, value == head).when(~enclosed, F.lit(False)).when(last == 1, F.lit(True)).otherwise(in_order())
    return F.when(value.contains("\n"), F.regexp_like(value, regex)).otherwise(found)


def character_mask(text: Column) -> Column:
    """64 bits of a text's characters with their numbers; those of a text whose characters another one has are a part of its.

    The first to fourth occurrence of a character have a bit each.
    """

    def add(mask: Column, char: Column) -> Column:
        times = F.length(text) - F.length(F.replace(text, char, F.lit("")))
        for n in range(1, 5):
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(char, F.lit(n)), F.lit(64)).cast("int"))
            mask = mask.bitwiseOR(F.when(times >= n, bit).otherwise(0))
        return mask

    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0).cast("long"), add)


def count_slots(fmt: Column) -> Column:
    return F.size(F.split(fmt, SLOT, -1)) - 1


def captures(value: Column, regex: Column, slots: Column) -> Column:
    """Text in each slot; empty array for a format without slots."""
    found = F.transform(F.sequence(F.lit(1), slots), lambda i: F.call_function("regexp_extract", value, regex, i))
    return F.when(slots > 0, found).otherwise(F.array().cast("array<string>"))


def parts(value: Column, regex: Column, pieces: Column) -> Column:
    """:func:`captures` of a value that the format with the literal texts ``pieces`` fits.

    Greedy slots end at the last places of the texts after them, so for a value without a line feed they are cut from
    the right; no pattern is compiled for a row.
    """
    last = F.size(pieces) - 1
    head, tail = F.get(pieces, F.lit(0)), F.get(pieces, last)
    inside = F.substring(value, F.length(head) + 1, F.length(value) - F.length(head) - F.length(tail))

    def before(state: Column, piece: Column) -> Column:
        slot = F.call_function("substring_index", state["left"], piece, F.lit(-1))
        left = F.left(state["left"], F.length(state["left"]) - F.length(slot) - F.length(piece))
        return F.struct(left.alias("left"), F.array_append(state["slots"], slot).alias("slots"))

    def cut() -> Column:
        start = F.struct(inside.alias("left"), F.array().cast("array<string>").alias("slots"))
        inner = F.reverse(F.slice(pieces, F.lit(2), last - 1))
        return F.aggregate(inner, start, before, lambda state: F.reverse(F.array_append(state["slots"], state["left"])))

    found = F.when(last == 0, F.array().cast("array<string>")).when(last == 1, F.array(inside)).otherwise(cut())
    return F.when(value.contains("\n"), captures(value, regex, last)).otherwise(found)


# A slot that is whole, or has lost its closing or its opening bracket; or any other character.
_SLOT_PIECES = r"(?s)<D>?|D>|."


def repair(fmt: Column) -> Column:
    """Complete slots that lost a bracket: one pass over the pieces of a format."""
    pieces = F.regexp_extract_all(fmt, F.lit(_SLOT_PIECES), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.isin("<D", "D>"), SLOT).otherwise(p)), "")


def merge_slots(fmt: Column) -> Column:
    """Slots with nothing but white space between them are one."""
    return F.regexp_replace(fmt, RUN_OF_SLOTS, SLOT)


def is_single_entity(fmt: Column) -> Column:
    """Formats of addresses and paths, which stand for one undivided value."""
    return fmt.rlike(IP_FORMAT) | fmt.rlike(PATH_FORMAT)


def fill(token_format: Column, component: Column) -> Column:
    return F.replace(token_format, F.lit(COMPONENT), component)


def json_list(text: Column) -> Column:
    """Strings of a JSON list; null for anything that is not one."""
    return F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>"))
