"""Importing this module registers every query."""

from workload import (  # noqa: F401
    checks,
    classification,
    correlation,
    landing,
    narrowing,
    outputs,
    runs,
    summaries,
    values,
)
