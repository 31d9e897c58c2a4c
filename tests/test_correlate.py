"""Joins with one key that holds a third of the rows, against plain Python."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hushframe.operators import correlate, reports

N = 3_000


@pytest.fixture(scope="module")
def clicks(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("q"), (F.col("id") % 50).cast("string")))
    return spark.range(N).select(key.alias("QUERY_ID"), F.col("id").alias("record"))


def test_search_clicks_keep_everything(spark, clicks):
    searches = spark.createDataFrame([(k, i) for i, k in enumerate(["hot", "q1", "q2", "none", "nothing"])], "QUERY_ID string, user int")
    got = correlate.search_clicks(searches, clicks, "QUERY_ID")
    want = searches.join(clicks, "QUERY_ID", "left")
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count() > N / 3
    assert got.where("record IS NULL").count() == 2


def test_fan_out(spark):
    rows = [("hot" if i % 3 == 0 else f"r{i % 40}", f"T{i % 7}") for i in range(N)]
    got = {r["r"]: (r["n_rows"], r["n_types"], r["types"]) for r in correlate.fan_out(
        spark.createDataFrame(rows, "r string, t string"), "r", "t").collect()}
    counts, types = Counter(r for r, _ in rows), defaultdict(set)
    for r, t in rows:
        types[r].add(t)
    assert got == {r: (counts[r], len(types[r]), ",".join(sorted(types[r]))) for r in counts}


def test_sessions_and_jobs(spark):
    logins = spark.createDataFrame([("s1", 1), ("s1", 2), ("s2", 3)], "k string, ts int")
    activity = spark.createDataFrame([("s1", 5, 1.5), ("s1", 6, 2.0), ("s3", 1, 9.0)], "k string, ts int, v double")
    got = {r["k"]: (r["n_logins"], r["n_actions"], r["total"]) for r in correlate.sessions(logins, activity, "k", "v").collect()}
    assert got["s1"][:2] == (2, 2) and float(got["s1"][2]) == 3.5 and got["s2"] == (1, None, None) and len(got) == 2
    jobs = spark.createDataFrame([("j1",), ("j2",)], "JOB_ID string")
    events = spark.createDataFrame([("j1", 4), ("j1", 6), ("j9", 1)], "JOB_ID string, rows int")
    assert sorted(tuple(r) for r in correlate.job_runs(events, jobs, "JOB_ID").collect()) == [("j1", 2, 10), ("j2", None, None)]


def test_column_rules(spark):
    frame = spark.createDataFrame([("", "c", 2, 10), ("f", "c", 3, 1), (None, "c", 1, 1)], "f string, c string, n int, s int")
    assert [r[0] for r in frame.select(correlate.client_address(F.col("f"), F.col("c"))).collect()] == ["c", "f", "c"]
    assert frame.agg(correlate.scaled_rows(F.col("n"), F.col("s"))).first()[0] == 24


def test_reports(spark):
    rows = [("pmd", 1 + i % 5, f"f{i % 2}") for i in range(10)]
    frame = spark.createDataFrame(rows, "engine string, severity int, file string")
    assert tuple(reports.severity_counts(frame, "engine").first()) == ("pmd", 10, 2, 2, 2, 2, 2)
    assert {(r["dimension"], r["value"]): r["n"] for r in reports.by_dimension(frame, "engine", "file").collect()} == {
        ("engine", "pmd"): 10, ("file", "f0"): 5, ("file", "f1"): 5}
