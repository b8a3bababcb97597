"""List columns stored as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_list(text: Column) -> Column:
    """Strings of a list literal with single- or double-quoted items."""
    # JSON has no two-digit escapes; an escaped backslash before the x stays as it is.
    unicode_escapes = F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    return F.from_json(
        unicode_escapes,
        "array<string>",
        {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"},
    )
