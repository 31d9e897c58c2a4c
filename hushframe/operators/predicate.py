"""Checks on a row predicate before it narrows an extract, scopes, caps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe import rules
from hushframe.functions.text import strip

_WORDS = r"\b(" + "|".join(rules.FORBIDDEN_PREDICATE_WORDS) + r")\b"


def predicate_problem(text: Column) -> Column:
    """Why a predicate is refused, NULL when it is fine."""
    clean = strip(F.coalesce(text, F.lit("")))
    word = F.regexp_extract(F.lower(clean), _WORDS, 1)
    return (
        F.when(clean == "", "empty")
        .when(F.contains(clean, F.lit(";")), "statement separator")
        .when(clean.rlike(r"--|/\*|\*/"), "comment marker")
        .when(word != "", "forbidden word")
    )


def checked_predicate(text: str | None) -> str:
    """The stripped predicate; ValueError says why it is refused."""
    clean = (text or "").strip()
    if not clean:
        raise ValueError("predicate is empty")
    if ";" in clean:
        raise ValueError("predicate has a statement separator")
    if any(mark in clean for mark in ("--", "/*", "*/")):
        raise ValueError("predicate has a comment marker")
    hit = re.search(_WORDS, clean.lower())
    if hit:
        raise ValueError(f"predicate has the forbidden word {hit.group(1)!r}")
    return clean


def narrowed(frame: DataFrame, predicate: str | None) -> DataFrame:
    """Apply a checked predicate to RAW values, before any masking."""
    return frame if predicate is None else frame.where(F.expr(checked_predicate(predicate)))


def record_scope(only: list[str] | None, planned: list[str] | None) -> list[str]:
    """Explicit list, else the plan's; without repeats, in order."""
    names = list(only or planned or [])
    if not names:
        raise ValueError("no objects in scope")
    return list(dict.fromkeys(names))


def ordered_distinct(names: DataFrame, name: str, position: str) -> DataFrame:
    """:func:`record_scope`'s de-duplication for a table of requests."""
    return names.groupBy(name).agg(F.min(position).alias(position))


def catalogue_scope(requested: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known entries with transport, unknown names) of requested objects."""
    small = F.broadcast(catalogue)  # 40 fixed rows
    return requested.join(small, "object"), requested.join(small, "object", "left_anti")
