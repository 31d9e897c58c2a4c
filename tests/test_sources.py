"""Payload and event-log readers."""

import csv
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hushframe.operators.incremental import (
    completed, finished_days, finished_ranges, open_window, split_bad, unfinished, window_plan,
)
from hushframe.plans import eventlogs
from hushframe.sources import eventlog, payloads
from hushframe.sources.eventlog import columns_by_type, read_bodies


def bodies(spark, *documents, **keys):
    rows = [(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "n int, body string")


def test_describe(spark):
    doc = {"fields": [{"name": "A__c", "label": "<i>x</i>", "type": "STRING", "length": 5, "custom": True}, {"label": "nameless"},
                      {"name": "B", "calculated": True, "calculatedFormula": "a\n+ b", "inlineHelpText": None}]}
    rows = payloads.read_describe(bodies(spark, doc, {"result": doc}, "broken {", None)).orderBy("n", "position").collect()
    assert [(r["n"], r["name"]) for r in rows] == [(0, "A__c"), (0, "B"), (1, "A__c"), (1, "B")]
    assert (rows[0]["label"], rows[0]["type"], rows[0]["custom"], rows[1]["formula"], rows[1]["length"]) == ("ix/i", "string", True, "a + b", 0)


def test_technical_describe(spark):
    frame = spark.createDataFrame(
        [("ApexClass", json.dumps({"fields": [{"name": "Body", "type": "textarea"}, {"name": "Name", "type": "string"}]})),
         ("Blob", json.dumps({"fields": [{"name": "Content", "type": "string"}]}))], "object string, body string")
    assert [(r["object"], r["name"]) for r in payloads.read_technical_describe(frame).collect()] == [("ApexClass", "Name")]
    assert [r["object"] for r in payloads.objects_without_fields(frame).collect()] == ["Blob"]


def test_pages(spark):
    page = lambda ids, **more: json.dumps({"records": [{"attributes": {"type": "T"}, "Id": i} for i in ids], **more})
    frame = spark.createDataFrame(
        [("a", 0, page("12", done=False, nextRecordsUrl="/n")), ("a", 1, page("3", done=True)), ("a", 2, page("9", done=True)),
         ("b", 0, page("4", done=False)), ("b", 1, page("5", done=True))], "chain string, page int, body string")
    rows = payloads.read_paged(frame, "Id:string", "chain", "page").collect()
    assert sorted((r["chain"], r["Id"]) for r in rows) == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "4")]
    assert "attributes" not in payloads.read_records(frame, "Id:string").columns


def test_limits_and_counts(spark):
    limits = {"DailyApiRequests": {"Max": 15000, "Remaining": 14800}, "DataStorageMB": {"Max": 5, "Remaining": 4}, "note": "x", "n": 3}
    got = {(r["LimitName"], r["Max"], r["Remaining"]) for r in payloads.read_limits(bodies(spark, limits)).collect()}
    assert got == {("DailyApiRequests", 15000, 14800), ("DataStorageMB", 5, 4)}
    counts = {"sObjects": [{"name": "Account", "count": 5000}, {"name": "Contact", "count": 3000}]}
    got = {(r["ObjectName"], r["RecordCount"]) for r in payloads.read_record_counts(bodies(spark, counts, {})).collect()}
    assert got == {("Account", 5000), ("Contact", 3000)}


def test_health_scores(spark):
    scores = payloads.read_health_scores(bodies(spark, {"records": [{"attributes": {}, "Id": "x", "Score": "87"}]}, {"records": []}))
    assert sorted((r["n"], r["Score"]) for r in scores.collect()) == [(0, 87), (1, None)]
    payloads.require_score(scores.where("Score IS NOT NULL"))
    for none in (scores, scores.limit(0)):
        with pytest.raises(RuntimeError):
            payloads.require_score(none)


def test_reports(spark):
    doc = {"violationCounts": {"total": 42, "sev2": 10}, "versions": {"pmd": "7"}, "violations": [
        {"rule": "R", "engine": "cpd", "severity": 3, "tags": ["a"], "primaryLocationIndex": 1,
         "locations": [{"file": "x"}, {"file": "y", "startLine": 4}], "message": "m"},
        {"rule": "S", "engine": "pmd", "severity": 1, "tags": [], "primaryLocationIndex": 9, "locations": [{"file": "z"}]}]}
    report = payloads.read_reports(bodies(spark, doc, "nonsense")).orderBy("n").collect()
    assert report[0]["violationCounts"]["total"] == 42 and report[1]["violationCounts"] is None
    rows = payloads.read_violations(bodies(spark, doc, "nonsense")).orderBy("rule").collect()
    assert [(r["rule"], r["file"], r["line"]) for r in rows] == [("R", "y", 4), ("S", None, None)]


def test_event_bodies(spark, tmp_path):
    (tmp_path / "a.csv").write_text('A,B,C\n"1","say ""hi"", you","x\ny"\n2\n3,b,c,extra\n')
    (tmp_path / "b.csv").write_text("A,B,C\n4,,z\n")
    rows = read_bodies(spark, str(tmp_path), ["A", "B", "C"]).orderBy("A").collect()
    assert [tuple(r) for r in rows] == [("1", 'say "hi", you', "x\ny"), ("2", "", ""), ("3", "b", "c"), ("4", "", "z")]


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    folder = tmp_path / "logs of a day"
    folder.mkdir()
    (folder / "a.csv").write_text("USER_NAME,COUNTRY_CODE\na@x.com,US\n")
    (folder / "b.csv").write_text('"COUNTRY_CODE", USER_NAME ,EXTRA\nDE,b@x.com,1\n')
    (folder / "c.csv").write_text("COUNTRY_CODE\nFR\n")
    (folder / "d.csv").write_text("COUNTRY_CODE,USER_NAME,COUNTRY_CODE\nXX,d@x.com,NL\n")
    (folder / "empty.csv").write_text("")
    rows = read_bodies(spark, str(folder)).orderBy("COUNTRY_CODE")
    assert rows.columns == ["USER_NAME", "COUNTRY_CODE", "EXTRA"]
    assert [tuple(r) for r in rows.collect()] == [
        ("b@x.com", "DE", "1"), ("", "FR", ""), ("d@x.com", "NL", ""), ("a@x.com", "US", "")]
    shown = eventlogs.anonymise("Login", read_bodies(spark, str(folder), ["USER_NAME", "COUNTRY_CODE"])).frame
    assert not [v for r in shown.collect() for v in r if "@" in v]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("")
    assert read_bodies(spark, str(tmp_path / "none"), ["A"]).collect() == []


def test_first_header_of_a_type_wins(spark):
    rows = [("2", "Login", "A,B"), ("1", "Login", " C ,,D"), ("3", None, "E")]
    found = columns_by_type(spark.createDataFrame(rows, "Id string, EventType string, LogFileFieldNames string"))
    assert sorted(tuple(r) for r in found.collect()) == [("Login", 0, "C"), ("Login", 1, "D"), ("Unknown", 0, "E")]


def test_windows(spark):
    def ledger(*names):
        return spark.createDataFrame([(n, s) for n, s in names], "name string, sentinel boolean")

    today = dt.date(2026, 6, 10)
    none = ledger(("scratch", True), ("2026-06-01_to_2026-06-09", False))
    assert completed(none).count() == 0
    assert open_window(none, today) == (dt.date(2026, 5, 12), dt.date(2026, 6, 9))
    some = ledger(("2026-05-01_to_2026-06-05", True), ("2026-04-01_to_2026-05-01", True))
    assert open_window(some, today) == (dt.date(2026, 6, 6), dt.date(2026, 6, 9))
    assert open_window(ledger(("a_to_2026-06-09", True)), today) is None
    assert window_plan(some, today).first()["start"] == dt.date(2026, 6, 6)


def test_finished_days_leave_the_scan_and_nothing_else_does(spark):
    first = dt.date(2026, 1, 1)
    day = lambda i: first + dt.timedelta(days=i)
    names = [(f"{day(2 * i)}_to_{day(2 * i)}", True) for i in range(20)]  # more runs than are pushed
    names += [("2026-03-01_to_2026-03-09", True), ("2026-03-10_to_2026-03-12", True), ("2026-04-01_to_2026-04-09", False),
              ("2026-05-09_to_2026-05-01", True), ("odd", True)]
    ledger = spark.createDataFrame(names, "name string, sentinel boolean")
    days = finished_days(ledger)
    assert days.count() == 32
    assert finished_ranges(days, most=2) == [(first, first), (dt.date(2026, 3, 1), dt.date(2026, 3, 12))]
    times = [None, *[dt.datetime(2026, 1, 1, 23, 59, 59) + dt.timedelta(days=i) for i in range(150)]]
    files = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz").withColumn("log_date", F.to_date("ts"))
    done = {r["day"] for r in days.collect()}
    for time in ("ts", None):
        got = {r["ts"] for r in unfinished(files, ledger, time=time).collect()}
        assert got == {t for t in times if t is None or t.date() not in done}
    assert unfinished(files, ledger.limit(0)).count() == len(times)


def test_bad_files_are_set_aside(spark):
    rows = [(1, "A, B", '"A","B"\n1,2'), (2, "A,B", None), (3, "A,B", "<html>"), (4, "A,B", "A,B")]
    good, bad = split_bad(spark.createDataFrame(rows, "id int, names string, body string"))
    assert sorted(r["id"] for r in good.collect()) == [1, 4]
    assert {r["id"]: r["reason"] for r in bad.collect()} == {2: "fetch failed", 3: "parse failed"}
    assert "body" not in bad.columns


def test_landed_files(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"sObjects":\n[{"name":"A","count":1}]}')
    landed = payloads.landed(spark, str(tmp_path))
    assert payloads.read_record_counts(landed).select("ObjectName", "RecordCount").collect()[0] == ("A", 1)
    assert landed.select(F.col("path").endswith("x.json")).first()[0]


def test_one_quoted_file_is_read_by_several_tasks(spark, tmp_path):
    path = tmp_path / "large.csv"
    cells = ["plain", 'with "quotes"', "two\nlines", "a,b", "", "\r\nreturns\r\n", "long " * 400 + "\n" + "x" * 3000]
    expected = []
    with path.open("w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator="\r\n")
        writer.writerow(["A", "B", "A", " C "])
        for k in range(400):
            row = [str(k), cells[k % len(cells)], f"last {k}", cells[(k // 7) % len(cells)]]
            expected.append(tuple(row[1:]))
            writer.writerow(row[:3] if k % 50 == 49 else [*row, "beyond"] if k % 50 == 48 else row)
    expected = [(b, a, "" if k % 50 == 49 else c) for k, (b, a, c) in enumerate(expected)]
    (tmp_path / "small.csv").write_text("C,D\n1,2\n\n3\n")
    (tmp_path / "empty.csv").write_text("")
    expected += [("", "", "1"), ("", "", "3")]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    limit = eventlog.BLOCK_LIST_BYTES
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for size in ("700b", "20000b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            if size != "128m":
                assert eventlog.file_blocks(eventlog.file_lines(spark, str(path))).count() > 3
            for eventlog.BLOCK_LIST_BYTES in (limit, 0):
                found = read_bodies(spark, str(tmp_path), ["B", "A", "C"])
                assert sorted(map(tuple, found.collect())) == sorted(expected)
        assert read_bodies(spark, str(tmp_path)).columns == ["A", "B", "C", "D"]
    finally:
        eventlog.BLOCK_LIST_BYTES = limit
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_small_files_beside_a_large_one_do_not_move_its_blocks(spark, tmp_path):
    """A scan without the small files cuts the large one elsewhere than a scan with them."""
    want = [(str(k), "two\nlines, " * (k % 5)) for k in range(1200)]
    with (tmp_path / "large.csv").open("w", newline="") as out:
        csv.writer(out, lineterminator="\n").writerows([("A", "B"), *want])
    for k in range(10):
        (tmp_path / f"small{k}.csv").write_text("B,A\n" + "".join(f"b,{k}.{n}\n" for n in range(200)))
        want += [(f"{k}.{n}", "b") for n in range(200)]
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "2000b")
        for columns in (["A", "B"], None):
            assert sorted(map(tuple, read_bodies(spark, str(tmp_path), columns).select("A", "B").collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)


def test_badly_formed_rows_stay_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'A,B\nx"y,"z\n1,2\n5" pipe,3" pipe\nc\rd,e\n')
    rows = sorted(map(tuple, read_bodies(spark, str(tmp_path)).collect()))
    assert rows == [("1", "2"), ('5" pipe', '3" pipe'), ("c d", "e"), ('x"y', "z")]


def test_one_report_is_split_over_several_tasks(spark, tmp_path):
    import json
    import random

    from hushframe.sources import reports

    chance = random.Random(7)
    bits = ["}", "{", "]", "[", '"', "\\", "violations", '"violations": [{', "é", "\n", "x" * 300, ","]

    def finding(n):
        text = "".join(chance.choice(bits) for _ in range(chance.randrange(9)))
        return {
            "rule": f"r{n}", "tags": [text, "}"], "severity": n % 5, "message": text, "primaryLocationIndex": n % 2,
            "locations": [{"file": text, "startLine": n}, {"file": "b", "startLine": -n}],
            "resources": [{"violations": [{"rule": "inner"}]}] if n % 3 == 0 else [],
        }

    many = [finding(n) for n in range(700)]
    (tmp_path / "many.json").write_text(
        json.dumps({"runDir": '"violations": [{', "violations": many, "after": [{"rule": "no"}], "deep": {"violations": [{"rule": "no"}]}}, ensure_ascii=False)
    )
    (tmp_path / "long.json").write_text(json.dumps({"violations": [{"rule": "long", "message": "}{" * 9000}], "tools": [[1], {}]}, indent=1))
    (tmp_path / "none.json").write_text('{"violations": [], "x": [{"rule": "no"}]}')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "list.json").write_text('[{"rule": "no"}]')
    (tmp_path / "cut.json").write_text('{"violations": [{"rule": "whole"}, {"rule": "par')
    want = sorted(
        [(f["rule"], f["message"], f["locations"][f["primaryLocationIndex"]]["startLine"]) for f in many]
        + [("long", "}{" * 9000, None), ("whole", None, None)],
        key=str,
    )
    old = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "5000b", "300b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "4m" if size == "128m" else "0b")
            if size != "128m":
                assert reports.file_states(reports._pieces(spark, str(tmp_path / "many.json"))).count() > 20
            got = [(r["rule"], r["message"], r["line"]) for r in reports.read_report_files(spark, str(tmp_path)).collect()]
            assert sorted(got, key=str) == want
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def test_small_reports_beside_a_large_one_do_not_move_its_blocks(spark, tmp_path):
    import json

    from hushframe.sources import reports

    def report(name, n):
        (tmp_path / name).write_text(json.dumps({"violations": [{"rule": f"{name}{k}", "message": '}"{[' * (k % 7)} for k in range(n)]}))
        return [f"{name}{k}" for k in range(n)]

    want = report("large", 900) + [rule for k in range(10) for rule in report(f"small{k}", 30)]
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "2000b")
        assert sorted(r["rule"] for r in reports.read_report_files(spark, str(tmp_path)).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)


def test_short_reports_are_cut_into_fewer_rows(spark, tmp_path, monkeypatch):
    from hushframe.sources import reports

    found = [{"rule": f"r{n}", "locations": [{"file": "}, {", "startLine": n}, {"file": "b"}], "message": '},"' * (n % 4)} for n in range(400)]
    (tmp_path / "dense.json").write_text(json.dumps({"violations": found}, separators=(",", ":")))
    (tmp_path / "apart.json").write_text(json.dumps({"violations": found}, indent=2).replace("},\n", "}\n,"))
    (tmp_path / "cut.json").write_text('{"violations": [{"rule": "whole"},{"rule": "value", "x": {"y": 1}},{"rule": "par')
    want = sorted([f["rule"] for f in found] * 2 + ["whole", "value"])
    cut, rows = reports.in_tasks, []
    monkeypatch.setattr(reports, "in_tasks", lambda lines: rows.append(lines.count()) or cut(lines))
    old = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "4m" if size == "128m" else "0b")
            read = {}
            for short in (32 << 20, 0):
                monkeypatch.setattr(reports, "SHORT", short, raising=False)
                rows.clear()
                assert sorted(r["rule"] for r in reports.read_report_files(spark, str(tmp_path)).collect()) == want
                read[short] = sum(rows)
            assert 3 * read[32 << 20] < 2 * read[0]
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def test_one_batch_of_reports_lies_on_disk_at_a_time(spark, tmp_path, monkeypatch):
    from pathlib import Path

    import duckdb

    import __spark_entry__ as entry
    from hushframe.session import shared_dir
    from workload import landing

    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn("l_orderkey", F.col("l_orderkey") * 100)
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    texts = lambda: {p: p.stat().st_size for p in Path(shared_dir(spark)).rglob("*.txt")}
    before, written, most, read = texts(), {}, [], landing.read_report_files

    def watched(*given):
        now = {p: size for p, size in texts().items() if p not in before}
        written.update(now)
        most.append(sum(now.values()))
        return read(*given)

    monkeypatch.setattr(landing, "read_report_files", watched)
    monkeypatch.setattr(landing, "REPORT_ROWS", 1700, raising=False)
    monkeypatch.setattr(landing, "CORE_ROWS", 1, raising=False)
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "20000b")  # the reports are read in several blocks
        found = entry.queries()["s12_report_files"](spark, str(tmp_path))
        got = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["s12_report_files"])
    assert found.columns == [d[0] for d in want.description]
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str) and len(got) > 6000
    assert len({r[0] for r in got}) > 5 and 2 * max(most) < sum(written.values())
