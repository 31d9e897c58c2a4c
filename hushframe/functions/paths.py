"""Path rewriting for component files: legal characters, bounded length, no escape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe import rules


def legal_component(name: Column) -> Column:
    """Illegal characters become ``_``; trailing dots and blanks go; never empty."""
    mapped = F.translate(name, rules.ILLEGAL_PATH_CHARS, "_" * len(rules.ILLEGAL_PATH_CHARS))
    trimmed = F.regexp_replace(mapped, r"[ .]+$", "")
    return F.when(trimmed == "", "_").otherwise(trimmed)


def short_component(name: Column, limit: int = rules.PATH_COMPONENT_MAX) -> Column:
    """Names over ``limit`` keep a stem, eight digits of SHA-1 and the extension.

    The extension starts at the first dot.  One too long to fit is cut, so the
    result never passes the limit.
    """
    dot = F.instr(name, ".")
    stem = F.substring_index(name, ".", 1)
    extension = F.when(dot > 0, F.substr(name, dot + F.lit(1))).otherwise("")
    extension = F.substring(extension, 1, limit - 20)
    tail = F.concat(
        F.lit("_"),
        F.substring(F.sha1(name), 1, 8),
        F.when(F.length(extension) > 0, F.concat(F.lit("."), extension)).otherwise(""),
    )
    keep = F.greatest(F.lit(10), F.lit(limit) - F.length(tail))
    return F.when(F.length(name) > limit, F.concat(F.substr(stem, F.lit(1), keep), tail)).otherwise(name)


def _components(path: Column) -> Column:
    relative = F.regexp_replace(path, r"^/+", "")
    return F.filter(F.split(relative, "/"), lambda part: (part != "") & (part != "."))


def escapes_root(path: Column) -> Column:
    """True when some prefix of the path climbs above the folder it starts in."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest"))

    def step(state: Column, part: Column) -> Column:
        depth = state["depth"] + F.when(part == "..", -1).otherwise(1)
        return F.struct(depth.alias("depth"), F.least(state["lowest"], depth).alias("lowest"))

    return F.aggregate(_components(path), start, step, lambda state: state["lowest"] < 0)


def safe_path(path: Column) -> Column:
    """Relative path with each component made legal and short."""
    return F.array_join(
        F.transform(_components(path), lambda part: short_component(legal_component(part))), "/"
    )
