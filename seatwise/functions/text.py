"""String and number columns: trimming, parsing, splitting, display formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seatwise.dims import values as V

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_PROGRAM = V.PROGRAM_PATTERN


def trimmed(c: Column) -> Column:
    """Strip all Unicode white space; Spark's own ``trim`` strips the space character only."""
    return F.btrim(c, F.lit(V.WHITESPACE))


def numeric(c: Column) -> Column:
    """Double value of a number text, null for anything else.

    The pattern keeps out what the cast alone would accept, such as a ``d`` suffix or ``inf``.
    """
    text = trimmed(c.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def whole_rank(c: Column) -> Column:
    """A double rank as bigint, truncated; null when it has no finite bigint value."""
    return c.try_cast("bigint")


def normalised_gender(c: Column) -> Column:
    low = F.lower(trimmed(c))
    return F.when(low.contains("female") | (low == "f"), "female").otherwise("neutral")


def program_branch(program: Column) -> Column:
    """The name in front of the first parenthesis."""
    name = trimmed(program)
    return F.when(
        name.rlike(_PROGRAM), trimmed(F.regexp_extract(name, _PROGRAM, 1))
    ).otherwise(name)


def program_degree(program: Column) -> Column:
    """The last comma part inside the parentheses; empty when there are none."""
    inside = F.regexp_extract(trimmed(program), _PROGRAM, 2)
    return trimmed(F.element_at(F.split(inside, ","), -1))


def parsed_rank(c: Column) -> Column:
    """The digits of a typed rank as a positive bigint, else null."""
    value = F.regexp_replace(c, "[^0-9]", "").try_cast("bigint")
    return F.when(value > 0, value)


def indian_grouping(c: Column) -> Column:
    """12,34,567"""
    return F.regexp_replace(c.cast("string"), r"(?<=\d)(?=(\d\d)+\d$)", ",")


def western_grouping(c: Column) -> Column:
    """1,234,567"""
    return F.format_number(c, 0)


def filled(template: Column, **slots: Column) -> Column:
    """Put values into ``{name}`` slots; a slot whose value is null stays as it is.

    The template is cut at its slots and joined once, so a value that looks like a slot is not
    filled again.
    """
    # a cut in front of each opening and behind each closing brace
    parts = F.split(template, r"(?=\{)|(?<=\})")

    def shown(part: Column) -> Column:
        values = None
        for name, value in slots.items():
            mark = F.lit("{" + name + "}")
            found = F.coalesce(value.cast("string"), mark)
            values = F.when(part == mark, found) if values is None else values.when(part == mark, found)
        return part if values is None else values.otherwise(part)

    return F.array_join(F.transform(parts, shown), "")


def half_up(c: Column) -> Column:
    """Nearest whole number with halves going up, also below zero."""
    return F.floor(c + F.lit(0.5)).cast("bigint")
