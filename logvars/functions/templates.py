"""Column expressions on templates and tokens (no joins, no shuffles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOLE = "<*>"


def tokens(text: Column) -> Column:
    """Tokens between single spaces; empty tokens are kept."""
    return F.split(text, " ", -1)


def is_dynamic(template: Column) -> Column:
    return template.contains(HOLE)


def recut(template: Column) -> Column:
    """Widen every hole to the whole space-separated token around it."""
    # Looked for from the first character of a token only, not from each.
    return F.regexp_replace(template, r"(?<![^ ])[^ ]*<\*>[^ ]*", HOLE)


def hole_positions(template_tokens: Column) -> Column:
    marked = F.transform(template_tokens, lambda tok, i: F.when(tok == HOLE, i))
    return F.filter(marked, lambda i: i.isNotNull())


def count_holes(template: Column) -> Column:
    return F.size(F.split(template, r"<\*>", -1)) - 1


def anchors(template_tokens: Column) -> Column:
    return F.filter(template_tokens, lambda tok: tok != HOLE)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also when used inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Items of a list whose expressions are written out by :func:`each`.
UNROLLED = 8


def each(values: Column, body) -> Column:
    """``F.transform(values, body)``, compiled for lists of at most ``UNROLLED`` items.

    Lambdas are interpreted item by item, which costs several times what compiled expressions do; only longer lists
    take them.  ``body`` gets an item and its index; what it uses more than once should be a column.
    """
    n = F.size(values)
    items = [F.when(n > i, body(F.get(values, F.lit(i)), F.lit(i))) for i in range(UNROLLED)]
    short = F.slice(F.array(*items), F.lit(1), n)
    return F.when(n.between(0, UNROLLED), short).otherwise(F.transform(values, body))


def align(content_tokens: Column, anchor_tokens: Column) -> Column:
    """Template tokens for a line whose token count differs from its template.

    Anchors are looked for greedily from left to right.  The fold carries only the
    positions where an anchor was met, so its state stays as small as the template
    and a line of n tokens costs n steps.
    """
    start = F.struct(
        F.lit(0).alias("k"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("hits")
    )

    def rebuild(met: Column) -> Column:
        return F.transform(
            content_tokens,
            lambda tok, i: F.when(F.array_contains(met, i) | (tok == ""), tok).otherwise(F.lit(HOLE)),
        )

    def fold(anchor: Column) -> Column:
        def step(state: Column, tok: Column) -> Column:
            met = tok.eqNullSafe(F.get(anchor, state["k"]))
            return F.struct(
                F.when(met, state["k"] + 1).otherwise(state["k"]).alias("k"),
                (state["i"] + 1).alias("i"),
                F.when(met, F.array_append(state["hits"], state["i"])).otherwise(state["hits"]).alias("hits"),
            )

        return F.aggregate(content_tokens, start, step, lambda state: state["hits"])

    return bind(bind(anchor_tokens, fold), rebuild)


def tokens_at_holes(content_tokens: Column, template_tokens: Column) -> Column:
    return F.filter(content_tokens, lambda tok, i: F.get(template_tokens, i) == HOLE)


def same_length(content_tokens: Column, template_tokens: Column) -> Column:
    return F.size(content_tokens) == F.size(template_tokens)


def fit_odd_line(content_tokens: Column, template_tokens: Column) -> Column:
    """struct(NewTemplate, ParameterList) of a line that is aligned to its template; null if it has as many tokens."""
    fitted = bind(
        align(content_tokens, anchors(template_tokens)),
        lambda used: F.struct(
            F.array_join(used, " ").alias("NewTemplate"), tokens_at_holes(content_tokens, used).alias("ParameterList")
        ),
    )
    return F.when(~same_length(content_tokens, template_tokens), fitted)


def replace_nth_hole(template: Column, token: Column, n: Column) -> Column:
    """Put ``token`` into the n-th hole (1-based); other holes stay."""
    pieces = F.split(template, r"<\*>", -1)
    head = F.array_join(F.slice(pieces, F.lit(1), n), HOLE)
    tail = F.array_join(F.slice(pieces, n + 1, F.greatest(F.size(pieces) - n, F.lit(0))), HOLE)
    fits = (n >= 1) & (n < F.size(pieces))
    return F.when(fits, F.concat(head, token, tail)).otherwise(template)


# The capture group of such templates, and the characters they escape.
GROUP = "(.*?)"
ESCAPED = "\\()[]{}.+*?|^$:/-"
_REGEX_PIECE = r"(?s)\(\.\*\?\)|\\[" + "".join("\\" + c for c in ESCAPED) + "]|."


_UNESCAPE = r"\\?\$\z|\\([" + "".join("\\" + c for c in ESCAPED) + "])"


def from_regex_template(text: Column) -> Column:
    """Event template of a regex template: capture groups become holes."""
    # Where no group follows a backslash all groups are holes, and what is left is escapes and a closing anchor.
    plain = F.regexp_replace(F.replace(text, F.lit(GROUP), F.lit(HOLE)), _UNESCAPE, "$1")
    return F.when(text.contains("\\" + GROUP), _by_pieces(text)).otherwise(plain)


def _by_pieces(text: Column) -> Column:
    """The template of a text whose backslashes must be counted to tell groups from escaped ones."""

    # One pass: a group becomes a hole, an escaped character itself, a closing anchor (escaped or not) nothing.
    def joined(pieces: Column) -> Column:
        return F.array_join(bind(F.size(pieces) - 1, lambda last: F.transform(pieces, lambda p, i: plain(p, i, last))), "")

    def plain(piece: Column, i: Column, last: Column) -> Column:
        return (
            F.when(piece == GROUP, F.lit(HOLE))
            .when((i == last) & piece.isin("$", "\\$"), F.lit(""))
            .when((F.length(piece) == 2) & piece.startswith("\\"), F.substring(piece, 2, 1))
            .otherwise(piece)
        )

    return bind(F.regexp_extract_all(text, F.lit(_REGEX_PIECE), F.lit(0)), joined)
