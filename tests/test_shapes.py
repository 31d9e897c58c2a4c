"""Plans: what reaches the scan, and what must never appear."""

import datetime as dt
import re

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL


def plan_of(frame, mode="formatted"):
    return frame.sparkSession._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), mode)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, SMALL), "simple")
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert node not in plan, node


def test_window_is_pushed_to_the_scan(spark):
    plan = plan_of(entry.queries()["f11_time_window"](spark, SMALL))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts.*LessThan\(ts", plan)
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>", plan)


def test_finished_days_are_pushed_to_the_scan(spark):
    plan = plan_of(entry.queries()["f14_unfinished_files"](spark, SMALL))
    assert re.search(r"PushedFilters: \[.*LessThan\(ts.*GreaterThanOrEqual\(ts", plan)


def test_dropped_columns_are_not_read(spark):
    plan = plan_of(entry.queries()["f1_record_projection"](spark, SMALL))
    assert re.search(r"ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_acctbal:double,c_mktsegment:string>", plan)


def test_masking_needs_no_shuffle_and_is_compiled(spark):
    plan = plan_of(entry.queries()["k2_masked_event_log"](spark, SMALL), "simple")
    assert "Exchange" not in plan and "*(1) Project" in plan


def test_event_run_masks_in_methods_that_the_jvm_compiles(spark, tmp_path, monkeypatch):
    from hushframe.plans import eventlogs
    from workload.runs import _logins_by_day

    written, write = [], eventlogs.write_dated_csv
    monkeypatch.setattr(eventlogs, "write_dated_csv", lambda table, path: (written.append(table.frame), write(table, path)))
    _logins_by_day(spark, SMALL).write.parquet(str(tmp_path / "rows"))
    for name, rows in (("made", _logins_by_day(spark, SMALL)), ("read", spark.read.parquet(str(tmp_path / "rows")))):
        eventlogs.run(spark, str(tmp_path / name), {"Login": rows}, dt.date(2024, 1, 18))
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan_of(written[-1], "codegen"))]
        assert 0 < max(sizes) < 8000
    inside = rows.where("log_date BETWEEN '2023-12-20' AND '2024-01-17'").count()
    assert [e["rows"] for name in ("made", "read") for e in eventlogs.finished_runs(spark, str(tmp_path / name))] == [inside, inside]
    assert "QUERY" not in re.search(r"ReadSchema: .*", plan_of(written[-1]))[0]


def test_small_caps_are_applied_before_the_shuffle(spark):
    plan = plan_of(entry.queries()["f13_row_cap"](spark, SMALL), "simple")
    assert plan.index("WindowGroupLimit") < plan.index("Exchange")


def test_fan_out_aggregates_before_each_shuffle(spark):
    plan = plan_of(entry.queries()["j7_request_fan_out"](spark, SMALL), "simple")
    assert plan.count("partial_count") >= 2


def test_deny_list_reaches_a_file_scan(spark, tmp_path):
    from hushframe.operators import inventory

    spark.createDataFrame([("Role", "a"), ("Flow", "b")], "type string, member string").write.parquet(str(tmp_path / "c"))
    plan = plan_of(inventory.allowed(spark.read.parquet(str(tmp_path / "c"))))
    assert re.search(r"PushedFilters: \[.*Not\(In\(type|PushedFilters: \[.*not", plan, re.I)


def test_json_is_parsed_once(spark):
    for name in ("s1_describe_scan", "s3_record_scan", "s12_violations", "a16_violation_tags"):
        assert plan_of(entry.queries()[name](spark, SMALL), "simple").count("from_json(") <= 2, name


def test_report_bodies_are_made_outside_the_parser(spark):
    from hushframe.sources import payloads

    plan = plan_of(entry.queries()["k12_analysis_documents"](spark, SMALL), "simple")
    (parse,) = [line for line in plan.splitlines() if "from_json" in line]
    assert "StructsToJsonEvaluator" not in parse and plan.count("from_json") == 1
    bodies = [(1, '{"runDir": "/r", "violationCounts": {"total": 2}, "versions": {"pmd": "7"}}'), (2, "{broken"), (3, None), (4, "{}")]
    found = payloads.read_reports(spark.createDataFrame(bodies, "k int, body string")).orderBy("k").collect()
    assert [(r["k"], r["runDir"], r["violationCounts"] and r["violationCounts"]["total"], r["versions"]) for r in found] == [
        (1, "/r", 2, {"pmd": "7"}), (2, None, None, None), (3, None, None, None), (4, None, None, None),
    ]


def test_small_side_is_counted_before_broadcast(spark):
    from hushframe.session import broadcast_if_small

    small, large = spark.range(10), spark.range(100)
    assert "ResolvedHint" in str(broadcast_if_small(small, 50)._jdf.queryExecution().analyzed())
    assert "ResolvedHint" not in str(broadcast_if_small(large, 50)._jdf.queryExecution().analyzed())
