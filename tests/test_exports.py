"""Whole runs: extract, publish, append, stream."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hushframe.functions import sqlnames
from hushframe.operators.gates import GateError, detector_stage
from hushframe.operators.mask import ClassifiedFrame, ColumnAction
from hushframe.plans import eventlogs, inventory, records, technical
from hushframe.sinks import publish as publishing
from hushframe.sinks import text as sinks
from hushframe.sources.planfile import Plan
from hushframe.streaming import eventlog_stream
from workload.landing import account_fields

FIELDS = ["Id", "OwnerId", "Name", "Industry", "AnnualRevenue", "Website_ID__c", "Contact_Email__c", "Phone", "Ethnicity__c",
          "MailingPostalCode", "Birthdate", "IsActive"]
ROW = ("001x", "005x", "Acme", "Tech\tnology", "1000", "WID123", "Foo@Bar.com", "555-secret", "X", "SW1A 1AA", "1990-05-01", True)


@pytest.fixture(scope="module")
def account(spark):
    return spark.createDataFrame([ROW], ", ".join(f"{n} {'boolean' if n == 'IsActive' else 'string'}" for n in FIELDS))


def test_record_export(spark, tmp_path, account):
    target = str(tmp_path / "out")
    with pytest.raises(publishing.PublishError):
        publishing.read_published(spark, target, "Account")
    records.export(spark, target, {"Account": account}, account_fields(spark), None, "Industry LIKE 'Tech%'")
    rows = publishing.read_published(spark, target, "Account")
    assert rows.columns == ["Id", "OwnerId", "Industry", "AnnualRevenue", "Website_ID__c", "Contact_Email__c", "IsActive"]
    shown = " ".join(str(v) for v in rows.first())
    assert "Acme" not in shown and "Foo" not in shown and "WID123" not in shown and "secret" not in shown
    audit = publishing.read_published(spark, target, records.SENTINEL).collect()
    assert len(audit) == len(FIELDS) + 1 and [r["reason"] for r in audit if r["field"] == "__where__"] == ["Industry LIKE 'Tech%'"]
    plan = Plan(overrides={("Account", "Ethnicity__c"): "KEEP"}, known_fields={("Account", "Id")})
    records.export(spark, target, {"Account": account}, account_fields(spark), plan)
    flags = publishing.read_published(spark, target, "flagged_fields").collect()
    assert ("Account", "downgraded", "Ethnicity__c") in [tuple(r) for r in flags] and len(flags) == len(FIELDS)
    assert publishing.purge_superseded(spark, target) == 1


def test_refused_publication_keeps_the_old_snapshot(spark, tmp_path):
    target = str(tmp_path / "out")
    rows, audit = spark.range(3), spark.range(1)
    publishing.publish(spark, target, {"rows": rows, "audit": audit}, "audit")
    with pytest.raises(publishing.PublishError):
        publishing.publish(spark, target, {"rows": rows}, "audit")

    def refuse(written):
        assert written["rows"].count() == 5
        raise GateError("no")

    with pytest.raises(GateError):
        publishing.publish(spark, target, {"rows": spark.range(5), "audit": audit}, "audit", gates=(refuse,))
    assert publishing.read_published(spark, target, "rows").count() == 3


def test_tsv(spark, tmp_path):
    frame = spark.createDataFrame([("1", 'a\tb "c"', True, None), ("2", " pad ", False, "")], "Id string, T string, B boolean, N string")
    table = ClassifiedFrame("X", frame.coalesce(1), tuple(ColumnAction(c, "PASS") for c in frame.columns))
    sinks.write_tsv(table, str(tmp_path / "x"))
    (part,) = (tmp_path / "x").glob("part-*")
    assert part.read_text() == 'Id\tT\tB\tN\n1\t"a\tb ""c"""\tTrue\t\n2\t pad \tFalse\t\n'
    empty = ClassifiedFrame("X", frame.where("Id = '9'"), table.actions)
    sinks.write_csv(empty, str(tmp_path / "empty"))
    assert "".join(p.read_text() for p in (tmp_path / "empty").glob("part-*")) == "Id,T,B,N\n"
    with pytest.raises(GateError):
        sinks.write_csv(ClassifiedFrame("X", frame, (ColumnAction("Id", "RAW"),)), str(tmp_path / "no"))


def login_rows(spark, *days):
    rows = [("Login", "005xx", "jane@example.com", "203.0.113.55", "/home?ret=%2Fsetup", "ABC123", "US", "SELECT x", d) for d in days]
    names = ["EVENT_TYPE", "USER_ID", "USER_NAME", "CLIENT_IP", "URI", "SESSION_KEY", "COUNTRY_CODE", "QUERY"]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", log_date date")


def test_event_export(spark, tmp_path):
    target = str(tmp_path / "logs")
    run = dt.date(2026, 6, 10)
    days = [dt.date(2026, 6, d) for d in (4, 7, 8, 9, 10)]
    ledger = spark.createDataFrame([("2026-06-01_to_2026-06-06", True)], "name string, sentinel boolean")
    window = eventlogs.export(spark, target, {"Login": login_rows(spark, *days), "API": login_rows(spark, *days)}, ledger, run, Plan(scope=["Login"]))
    assert window == (dt.date(2026, 6, 7), dt.date(2026, 6, 9))
    for _ in range(2):  # a repeated run changes nothing
        rows = spark.read.parquet(target)
        assert rows.count() == 3 and "QUERY" not in rows.columns
        row = rows.first()
        assert (row["USER_ID"], row["SESSION_KEY"], row["CLIENT_IP"], row["URI"], row["COUNTRY_CODE"]) == ("005xx", "ABC123", "203.0.113.0", "/home", "US")
        assert len(row["USER_NAME"]) == 64
        eventlogs.export(spark, target, {"Login": login_rows(spark, *days)}, ledger, run)
    done = spark.createDataFrame([("2026-06-01_to_2026-06-09", True)], "name string, sentinel boolean")
    assert eventlogs.export(spark, target, {}, done, run) is None


def test_event_run(spark, tmp_path):
    target = str(tmp_path / "run")
    days = [dt.date(2026, 6, d) for d in (4, 7, 8, 9)]
    torn = tmp_path / "torn.parquet"
    torn.write_bytes(b"PAR1 torn")
    bodies = {
        "Login": login_rows(spark, *days),
        "Hidden": login_rows(spark, *days).select("QUERY", "log_date"),
        "Torn": spark.read.schema("USER_ID string, log_date date").parquet(str(torn)),
    }
    skips = spark.createDataFrame([("API", "fetch failed")], "event_type string, reason string")
    plan = Plan(scope=["Login", "Hidden", "Torn"])
    assert eventlogs.run(spark, target, bodies, dt.date(2026, 6, 9), plan, skips) == (dt.date(2026, 5, 11), dt.date(2026, 6, 8))
    assert eventlogs.run(spark, target, bodies, dt.date(2026, 6, 9), plan, skips) is None
    assert eventlogs.read_rows(spark, target, "Login").count() == 3
    assert eventlogs.run(spark, target, bodies, dt.date(2026, 6, 10), plan) == (dt.date(2026, 6, 9), dt.date(2026, 6, 9))
    rows = eventlogs.read_rows(spark, target, "Login")
    assert rows.count() == 4 and "QUERY" not in rows.columns and eventlogs.read_rows(spark, target, "Hidden") is None
    row = rows.first()
    assert (row["CLIENT_IP"], row["URI"]) == ("203.0.113.0", "/home") and len(row["USER_NAME"]) == 64
    lost = sorted((r["window"], r["event_type"]) for r in eventlogs.read_part(spark, target, eventlogs.SKIPPED).collect())
    assert lost == [("2026-05-11_to_2026-06-08", "API"), ("2026-05-11_to_2026-06-08", "Torn"), ("2026-06-09_to_2026-06-09", "Torn")]
    audit = {(r["window"], r["column"]): (r["action"], r["event_types"]) for r in eventlogs.read_part(spark, target, eventlogs.SENTINEL).collect()}
    assert audit["2026-06-09_to_2026-06-09", "QUERY"] == ("DROP", "Hidden,Login")
    summary = {r["window"]: json.loads(r["summary"]) for r in eventlogs.read_part(spark, target, eventlogs.SUMMARY).collect()}
    assert summary["2026-05-11_to_2026-06-08"]["records_by_type"] == {"Login": 3} and summary["2026-05-11_to_2026-06-08"]["skipped"] == 2
    assert [e["rows"] for e in eventlogs.finished_runs(spark, target)] == [3, 1]


def test_event_run_of_two_at_once_and_refused(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "run")
    bodies = {"Login": login_rows(spark, dt.date(2026, 6, 8))}
    first, inner = eventlogs.run_summary, []

    def other_run_first(*args):
        if not inner:
            inner.append(True)
            eventlogs.run(spark, target, bodies, dt.date(2026, 6, 9))
        return first(*args)

    monkeypatch.setattr(eventlogs, "run_summary", other_run_first)
    eventlogs.run(spark, target, bodies, dt.date(2026, 6, 9))
    assert eventlogs.read_rows(spark, target, "Login").count() == 1
    assert len(list((tmp_path / "run" / "runs").iterdir())) == 1
    leak = {"Login": login_rows(spark, dt.date(2026, 6, 9)).withColumn("COUNTRY_CODE", F.lit("jane@example.com"))}
    with pytest.raises(GateError, match="COUNTRY_CODE: clear e-mail"):
        eventlogs.run(spark, target, leak, dt.date(2026, 6, 10))
    with pytest.raises(RuntimeError):
        eventlogs.run(spark, target, {"X": spark.range(1).select(F.raise_error(F.lit("no")).cast("string").alias("USER_ID"), F.lit(dt.date(2026, 6, 9)).alias("log_date"))}, dt.date(2026, 6, 10))
    assert len(eventlogs.finished_runs(spark, target)) == 1 and len(list((tmp_path / "run" / "runs").iterdir())) == 1


def test_two_publications_at_once(spark, tmp_path):
    target = str(tmp_path / "out")
    with publishing.Publication(spark, target, "audit") as slow:
        slow.write("rows", spark.range(3))
        publishing.publish(spark, target, {"rows": spark.range(7), "audit": spark.range(1)}, "audit")
        assert publishing.purge_superseded(spark, target) == 0  # the slow run is leased
        slow.write("audit", spark.range(1))
        number = slow.commit()
    assert number == 2 and slow.rows == {"rows": 3, "audit": 1}
    with publishing.held_snapshot(spark, target) as held:
        publishing.publish(spark, target, {"rows": spark.range(9), "audit": spark.range(1)}, "audit")
        assert publishing.purge_superseded(spark, target) == 1  # the first; the held one stays
        assert held("rows").count() == 3
    assert publishing.purge_superseded(spark, target) == 1
    assert publishing.read_published(spark, target, "rows").count() == 9


def test_a_marker_number_is_taken_once(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "out")
    publishing.publish(spark, target, {"audit": spark.range(1)}, "audit")
    with publishing.Publication(spark, target, "audit") as run:
        run.write("audit", spark.range(2))
        seen = publishing._numbers
        monkeypatch.setattr(publishing, "_numbers", lambda *a: [n for n in seen(*a) if n > 1])  # as listed before the first
        assert run.commit() == 2
    monkeypatch.undo()
    assert publishing.read_published(spark, target, "audit").count() == 2


def test_leases_run_out(spark, tmp_path):
    target = str(tmp_path / "out")
    publishing.publish(spark, target, {"audit": spark.range(1)}, "audit")
    run = publishing.Publication(spark, target, "audit", lease=-1)
    run.write("audit", spark.range(5))
    assert publishing.purge_superseded(spark, target) == 1
    assert list((tmp_path / "out" / "leases").glob("*.json")) == []


def test_technical_quarantine(spark, tmp_path):
    fields = spark.createDataFrame(
        [("LoginHistory", 0, "Id", "id", True), ("LoginHistory", 1, "SourceIp", "string", True),
         ("SetupAuditTrail", 0, "Display", "string", True), ("ApexClass", 0, "Name", "string", True)],
        "object string, position int, name string, type string, queryable boolean")
    torn = tmp_path / "torn.parquet"
    torn.write_bytes(b"PAR1 torn")
    tables = {"LoginHistory": spark.createDataFrame([("1", "10.0.1.42")], "id string, sourceip string"),
              "SetupAuditTrail": spark.createDataFrame([("text",)], "Display string"),
              "ApexClass": spark.read.schema("Name string").parquet(str(torn))}
    done, skipped = technical.extract(spark, tables.__getitem__, fields, list(tables))
    target = str(tmp_path / "tech")
    technical.export(spark, target, done, skipped, limit=5)
    assert [tuple(r) for r in publishing.read_published(spark, target, "LoginHistory").collect()] == [("1", "10.0.1.0")]
    assert publishing.read_published(spark, target, "SetupAuditTrail").columns == []
    assert [r["object"] for r in publishing.read_published(spark, target, "skipped").collect()] == ["ApexClass"]
    summary = json.loads(publishing.read_published(spark, target, technical.SUMMARY).first()["summary"])
    assert [(o["object"], o["rows"], o["columns"]) for o in summary["objects"]] == [("LoginHistory", 1, 2), ("SetupAuditTrail", 0, 0)]
    assert summary["limit"] == 5 and [s["object"] for s in summary["skipped"]] == ["ApexClass"]
    with pytest.raises(RuntimeError):
        technical.export(spark, target, done[2:], skipped)
    leak = ClassifiedFrame("LoginHistory", tables["LoginHistory"].toDF("Id", "SourceIp"), done[0].actions)
    with pytest.raises(GateError, match="raw address"):
        technical.export(spark, target, [leak], skipped)
    assert publishing.read_published(spark, target, "LoginHistory").count() == 1


def test_event_plan_text(spark):
    headers = spark.createDataFrame([("1", "Login", "CLIENT_IP,QUERY"), ("2", "API", "CLIENT_IP,URI")], "Id string, EventType string, LogFileFieldNames string")
    text = eventlogs.plan_text(headers)
    assert 'event_types = ["API", "Login"]' in text and "CLIENT_IP: DERIVE/ip_prefix" in text and "QUERY: DROP" in text


def test_technical_export(spark, tmp_path):
    fields = spark.createDataFrame(
        [("LoginHistory", 0, "Id", "id", True), ("LoginHistory", 1, "SourceIp", "string", True), ("LoginHistory", 2, "Body", "string", True),
         ("SetupAuditTrail", 0, "Display", "string", True), ("ApexClass", 0, "Name", "string", True)],
        "object string, position int, name string, type string, queryable boolean")
    tables = {"LoginHistory": spark.createDataFrame([("2", "10.0.1.42", "x"), ("1", "10.0.1.43", "x")], "Id string, SourceIp string, Body string"),
              "SetupAuditTrail": spark.createDataFrame([("a", "free text")], "Id string, Display string")}

    def open_table(name):
        return tables[name] if name in tables else spark.read.parquet(str(tmp_path / "missing"))

    done, skipped = technical.extract(spark, open_table, fields, ["LoginHistory", "SetupAuditTrail", "ApexClass"], limit=1)
    assert [tuple(r) for r in done[0].frame.collect()] == [("1", "10.0.1.0")]
    assert done[1].frame.columns == [] and done[1].frame.count() == 0
    assert [r["object"] for r in skipped.collect()] == ["ApexClass"]
    target = str(tmp_path / "tech")
    technical.export(spark, target, done, skipped)
    audit = publishing.read_published(spark, target, technical.SENTINEL)
    assert {(r["object"], r["field"]): r["action"] for r in audit.collect()} == {
        ("LoginHistory", "Id"): "RAW", ("LoginHistory", "SourceIp"): "DERIVE", ("SetupAuditTrail", "Display"): "DROP"}
    with pytest.raises(RuntimeError):
        technical.extract(spark, open_table, fields, ["ApexClass"])


def test_inventory_export(spark, tmp_path):
    target = str(tmp_path / "inv")
    got = spark.createDataFrame([("Flow", "A"), ("Flow", "B"), ("Profile", "P")], "type string, member string")
    skips = spark.createDataFrame([("Report", "unknown", "secret detail", None, None)],
                                  "type string, bucket string, detail string, requested bigint, retrieved bigint")
    contents = spark.createDataFrame([("Flow/A", "contact me@home.org")], "path string, text string")
    with pytest.raises(GateError):
        inventory.export(spark, target, got, skips, contents, [detector_stage("path", "text")])
    inventory.export(spark, target, got, skips)
    (block,) = publishing.read_published(spark, target, inventory.SENTINEL).collect()
    assert "<members>A</members>" in block["block"] and "Profile" not in block["block"]
    assert "detail" not in publishing.read_published(spark, target, inventory.SKIPS).columns


def test_stream_equals_batch_and_repeats_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    days = [dt.date(2026, 6, d) for d in (7, 8)]
    login_rows(spark, *days).write.parquet(source)
    rows = eventlog_stream.file_stream(spark, source, login_rows(spark, *days).schema)
    table = eventlogs.anonymise("Login", rows, keep=("log_date",))
    for expected in (2, 2, 3):
        eventlog_stream.drain(table, str(tmp_path / "out"), str(tmp_path / "ck"), ("log_date",))
        got = spark.read.parquet(str(tmp_path / "out"))
        assert got.count() == expected
        if expected == 2:
            batch = eventlogs.anonymise("Login", spark.read.parquet(source), keep=("log_date",)).frame
            assert got.select(*batch.columns).exceptAll(batch).count() == 0 or expected == 3
        if got.count() == 2 and not (tmp_path / "added").exists():
            (tmp_path / "added").touch()
        elif got.count() == 2:
            login_rows(spark, dt.date(2026, 6, 9)).write.mode("append").parquet(source)


def test_sql_names(spark):
    assert len(sqlnames.register(spark)) == 7
    row = spark.sql("SELECT hf_ip_prefix(' 1.2.3.4:5 ') a, hf_ip_prefix('fe80::1') b, hf_clean_url('/x/1.2.3.4?y') c, "
                    "hf_outcode(' sw1 2a') d, hf_birth_year('1990-1') e, hf_hash_id('  ') f, hf_mask_quads('at 1.2.3.44.') g").first()
    assert tuple(row) == ("1.2.3.0", "fe80::", "/x/1.2.3.0", "SW1", "1990", "", "at 1.2.3.0.")
    assert spark.range(1).select(F.expr("hf_hash_email(' A@b.c ') = sha2('a@b.c', 256)")).first()[0]
