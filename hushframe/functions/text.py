"""Text helpers with the stripping and capping rules every transform shares."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe import rules


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once per row and use it many times in ``body``.

    Plain columns are copied into a filter that is pushed below the projection
    which defines them; a bound variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(values: Sequence[str]) -> Column:
    """Array literal of words that hold no ``|``, folded by the optimizer."""
    return F.split(F.lit("|".join(values)), r"\|")


def strip(value: Column) -> Column:
    """Remove leading and trailing white space of any Unicode kind."""
    return F.btrim(value, F.lit(rules.WHITESPACE))


def is_blank(value: Column) -> Column:
    return F.coalesce(F.length(strip(value)) == 0, F.lit(True))


def capped(value: Column, limit: int) -> Column:
    """Cut at ``limit`` characters and mark the cut with ``...``."""
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit("..."))).otherwise(value)


def schema_text(value: Column) -> Column:
    """Labels, formulas and help texts without markup, on one line, capped."""
    plain = F.translate(F.coalesce(value, F.lit("")), "<>", "")
    one_line = strip(F.regexp_replace(plain, r"(?U)[\s\x1c-\x1f]+", " "))
    return capped(one_line, rules.SCHEMA_TEXT_MAX)


def skip_detail(value: Column) -> Column:
    return capped(F.coalesce(value, F.lit("")), rules.SKIP_DETAIL_MAX)


def as_text(value: Column, data_type: str = "string") -> Column:
    """Cell text: NULL becomes empty, booleans read ``True`` / ``False``."""
    text = value.cast("string")
    if data_type == "boolean":
        text = F.initcap(text)
    return F.coalesce(text, F.lit(""))
