"""Value tests and cuts as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit words, marks that are stripped, and the patterns DOT_SUFFIX, MACRO and TAIL_* below.
UNIT_WORDS = ["kb", "mb", "gb", "ms"]
PUNCTUATION = [",", ".", ":", ";", ")", "(", "[", "]", "{", "}", "'", "/", '"', "<", ">"]
PUNCTUATION_CLASS = "[" + "".join("\\" + c if c in "[]" else c for c in PUNCTUATION) + "]"

# A number as people write it in logs: digit groups may hold single underscores.
# (A cast to double would take `1d` or `0x1p3` and refuse `1_000`.)
NUMBER = (
    r"^\s*[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)"
    r"(?:[eE][+-]?\d+(?:_\d+)*)?|(?i:nan|inf|infinity))\s*$"
)
HEX_NUMBER = r"^[+-]?0[xX][0-9a-fA-F]+$"
HOST_PORT = r"^[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:\d+$"
PATH = r"(?s)^[A-Za-z]:[\\/]|/.*/|\\\\.*\\\\"
MACRO = r"^[A-Z]+(?:_[A-Z]+)*$"
DOT_SUFFIX = r"^(\(?[A-Za-z]+\)?)(\.{3,})(\d+)$"
TAIL_IP = r"\b(?:\d{1,3}\.){3}\d{1,3}$"
TAIL_HEX = r"(?:0x[0-9a-fA-F]+|[0-9a-fA-F]{8,})$"
TAIL_EQ_DIGITS = r"=(\d+)$"


def is_number(value: Column, markers: Sequence[str] | Column = ()) -> Column:
    """A number, or one of ``markers``: words, or an array column of words where they differ by row."""
    found = value.rlike(NUMBER) | value.rlike(HEX_NUMBER)
    if isinstance(markers, Column):
        return found | F.array_contains(markers, value)
    return found | value.isin(*markers) if markers else found


# A test for a character that a pattern needs costs a scan of bytes; it comes before the patterns that few values fit.


def is_unit(value: Column) -> Column:
    return (F.length(value) == 2) & F.lower(value).isin(*UNIT_WORDS)


def is_host_port(value: Column) -> Column:
    return value.contains(":") & value.rlike(HOST_PORT)


def is_path(value: Column) -> Column:
    return (value.contains("/") | value.contains("\\")) & value.rlike(PATH)


def is_macro(value: Column) -> Column:
    return value.rlike(MACRO)


def is_dot_suffix(value: Column) -> Column:
    return value.contains("...") & value.rlike(DOT_SUFFIX)


def dot_suffix_format(value: Column) -> Column:
    return F.concat(F.regexp_extract(value, DOT_SUFFIX, 1), F.regexp_extract(value, DOT_SUFFIX, 2), F.lit("<D>"))


def unit_of(token: Column) -> Column:
    """Unit word left after trimming the token's own punctuation, else null."""
    bare = F.regexp_replace(token, rf"^{PUNCTUATION_CLASS}+|{PUNCTUATION_CLASS}+$", "")
    return F.when(is_unit(bare), F.lower(bare))


def leading_marks(value: Column) -> Column:
    """Number of punctuation marks cut from the front of a first value."""
    run = F.length(F.regexp_extract(value, rf"^{PUNCTUATION_CLASS}*", 0))
    whole = F.length(value)
    return F.when(run == whole, F.floor(whole / 2).cast("int")).otherwise(run)


def trailing_marks(value: Column) -> Column:
    """Number of punctuation marks cut from the end; marks only: the larger half."""
    run = F.length(F.regexp_extract(value, rf"{PUNCTUATION_CLASS}*$", 0))
    whole = F.length(value)
    return F.when(run == whole, F.ceil(whole / 2).cast("int")).otherwise(run)


def cut(value: Column, begin: Column, end: Column) -> Column:
    return F.substring(value, begin + 1, F.greatest(F.length(value) - begin - end, F.lit(0)))


def without_tail(value: Column, tail: Column) -> Column:
    return F.substring(value, F.lit(1), F.length(value) - F.length(tail))
