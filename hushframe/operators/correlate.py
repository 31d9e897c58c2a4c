"""Joins on the keys that masked event logs and objects share.

Key columns can be hot: one user, session or job may own a third of all rows.
Sides that only contribute a measure are therefore aggregated (map side first)
before they are joined, and row-level joins to a unique side are left to
adaptive skew splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_key(rows: DataFrame, *keys: str, **measures: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])


def fan_out(events: DataFrame, request: str, event_type: str) -> DataFrame:
    """Per request: rows, distinct event types and their sorted list.

    Counts per (request, type) come first, so a hot request is spread over its
    types and the list never holds more than the event-type vocabulary.
    """
    pairs = events.groupBy(request, event_type).agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy(request).agg(
        F.sum("_n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_types"),
        F.concat_ws(",", F.array_sort(F.collect_list(event_type))).alias("types"),
    )


def sessions(logins: DataFrame, activity: DataFrame, key: str, value: str) -> DataFrame:
    """Logins joined to what happened under their key, both sides reduced first."""
    started = per_key(logins, key, n_logins=F.count(F.lit(1)), first_login=F.min("ts"))
    done = per_key(
        activity,
        key,
        n_actions=F.count(F.lit(1)),
        total=F.sum(F.col(value).cast("decimal(18,2)")),
        last_action=F.max("ts"),
    )
    return started.join(done, key, "left")


def search_clicks(searches: DataFrame, clicks: DataFrame, key: str) -> DataFrame:
    """Every search with its clicks; searches without a click stay.

    Split into an inner join, which adaptive execution can skew-split on both
    sides, and an anti join against the distinct clicked keys.
    """
    hit = searches.join(clicks, key)
    extra = [c for c in clicks.columns if c != key]
    kinds = dict(clicks.dtypes)
    missed = searches.join(clicks.select(key).distinct(), key, "left_anti")
    return hit.unionByName(
        missed.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in extra])
    )


def job_runs(events: DataFrame, jobs: DataFrame, job: str) -> DataFrame:
    """Queued jobs with what their events add up to."""
    work = per_key(events, job, n_events=F.count(F.lit(1)), n_rows=F.sum("rows"))
    return jobs.join(work, job, "left")


def privilege_paths(assignments: DataFrame, permission_sets: DataFrame, users: DataFrame) -> DataFrame:
    """Assignment -> permission set -> user; both lookups are unique keys."""
    return assignments.join(permission_sets, "PermissionSetId").join(users, "AssigneeId")


def login_places(logins: DataFrame, geo: DataFrame, checks: DataFrame) -> DataFrame:
    """Verifications with the login they belong to and where it came from."""
    return checks.join(logins, "LoginHistoryId", "left").join(geo, "LoginGeoId", "left")


# ---------------------------------------------------------------- small column rules
def client_address(forwarded: Column, client: Column) -> Column:
    """The forwarded address when there is one, else the client's."""
    return F.coalesce(F.nullif(forwarded, F.lit("")), client)


def prefer_derived(derived: Column, raw: Column) -> Column:
    return F.coalesce(F.nullif(derived, F.lit("")), raw)


def scaled_rows(rows: Column, factor: Column) -> Column:
    """True rows behind sampled ones."""
    return F.sum(rows * factor)


def page_times(usage: DataFrame, *keys: str) -> DataFrame:
    """Mean page time per key: summed time over summed page views."""
    sums = usage.groupBy(*keys).agg(
        F.sum("SumEPT").alias("sum_ept"), F.sum("RecordCountEPT").alias("views")
    )
    return sums.withColumn("mean_ept", F.round(F.col("sum_ept") / F.nullif(F.col("views"), F.lit(0)), 4))


def page_time_bins(usage: DataFrame, key: str, bins: list[str]) -> DataFrame:
    """Histogram bins as rows, summed per key."""
    sums = usage.groupBy(key).agg(*[F.sum(b).alias(b) for b in bins])
    return sums.unpivot([key], bins, "bin", "n")


def content_matrix(classified: DataFrame, *keys: str) -> DataFrame:
    """What kinds of content an object holds, from its field actions."""
    name = F.lower("name")
    return classified.groupBy(*keys).agg(
        F.bool_or(name.rlike("user|owner|assignee|identity")).alias("identifies_users"),
        F.bool_or((F.col("recipe") == "ip_prefix") | (F.col("rule") == "C3.7")).alias("has_network_or_place"),
        F.bool_or(F.col("rule").isin("C3.8") | ((F.col("rule") == "C3.1") & (F.col("action") == "DROP"))).alias(
            "has_free_text"
        ),
    )
