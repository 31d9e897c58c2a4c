"""Plans: overrides, reasons, drift, files."""

import pytest
from pyspark.sql import functions as F

from hushframe import rules
from hushframe.operators import audit, resolve
from hushframe.operators.classify import classify_records
from hushframe.plans import eventlogs, records, technical
from hushframe.sources import planfile
from hushframe.sources.planfile import Plan, PlanError

FIELDS = [
    ("Account", 0, "Id", "id"), ("Account", 1, "Phone", "phone"), ("Account", 2, "Industry", "picklist"),
    ("Account", 3, "Ethnicity__c", "picklist"), ("Account", 4, "Gender__c", "picklist"), ("Account", 5, "Zip__c", "string"),
    ("Account", 6, "Birthdate", "date"), ("Account", 7, "Nick__c", "string"),
]


@pytest.fixture(scope="module")
def fields(spark):
    frame = spark.createDataFrame(FIELDS, "object string, position int, name string, type string")
    blank = F.lit("")
    return frame.select("*", F.lit(0).alias("length"), blank.alias("label"), blank.alias("help_text"),
                        blank.alias("formula"), F.lit(False).alias("calculated"))


def by_field(frame):
    return {r["field"]: r for r in frame.collect()}


def test_record_plan(fields):
    plan = Plan(
        overrides={("Account", "Phone"): "KEEP", ("Account", "Ethnicity__c"): "KEEP", ("Account", "Gender__c"): "HASH_ID",
                   ("Account", "Zip__c"): "DERIVE", ("Account", "Nick__c"): "DERIVE", ("Other", "Industry"): "DROP"},
        reasons={("Account", "Gender__c"): "equality report"},
    )
    got = by_field(records.resolve_fields(fields, plan))
    assert (got["Id"]["action"], got["Id"]["source"]) == ("RAW", "default")
    assert (got["Phone"]["action"], got["Phone"]["source"], got["Phone"]["downgraded"]) == ("PASS", "override", False)
    assert (got["Ethnicity__c"]["action"], got["Ethnicity__c"]["downgraded"]) == ("DROP", True)
    assert (got["Gender__c"]["action"], got["Gender__c"]["downgraded"]) == ("HASH_ID", False)
    assert (got["Zip__c"]["action"], got["Zip__c"]["recipe"]) == ("DERIVE", "uk_postcode_outcode")
    assert (got["Nick__c"]["action"], got["Nick__c"]["recipe"]) == ("DROP", "")
    assert (got["Industry"]["action"], got["Industry"]["source"]) == ("PASS", "default")
    counts = {r["action"]: r["fields"] for r in audit.action_counts(records.resolve_fields(fields, plan), "object").collect()}
    assert sum(counts.values()) == len(FIELDS)


def test_no_plan_means_defaults(fields):
    got = by_field(records.resolve_fields(fields, None))
    assert {r["source"] for r in got.values()} == {"default"} and not any(r["downgraded"] for r in got.values())
    assert got["Birthdate"]["action"] == "DROP"


def test_repeated_plan_rows_do_not_multiply_fields(spark, fields):
    rows = spark.createDataFrame([("Account", "Phone", "PASS")] * 3, "object string, field string, action string")
    none = spark.createDataFrame([], "object string, field string, text string")
    base = classify_records(fields).withColumnRenamed("name", "field")
    assert resolve.resolve_records(base, rows, none).count() == len(FIELDS)


def test_drift(spark, fields):
    known = Plan(known_fields={("Account", "Id"), ("Account", "Phone")}).known_table(spark)
    seen = fields.withColumnRenamed("name", "field")
    assert {r["field"] for r in resolve.drift(seen, known).collect()} == {f[2] for f in FIELDS} - {"Id", "Phone"}


def test_event_plan(spark):
    plan = Plan(
        overrides={("", "QUERY"): "KEEP", ("", "CLIENT_IP"): "PASS", ("", "URI"): "DROP", ("", "USER_ID"): "HASH", ("", "MESSAGE"): "HASH"},
        reasons={("", "CLIENT_IP"): "fraud team"},
    )
    names = ["query", " Client_IP ", "URI", "USER_ID", "MESSAGE", "RUN_TIME"]
    got = {a.name: a for a in eventlogs.actions_for(spark, names, plan)}
    assert (got["query"].action, got["query"].downgraded) == ("DROP", True)
    assert (got[" Client_IP "].action, got[" Client_IP "].source) == ("PASS", "override")
    assert got["URI"].action == "DROP" and not got["URI"].downgraded
    assert (got["USER_ID"].action, got["USER_ID"].recipe) == ("HASH", "id")
    assert (got["MESSAGE"].action, got["MESSAGE"].downgraded) == ("DROP", True)
    assert [a.name for a in eventlogs.actions_for(spark, names)] == names


def test_technical_plan_keeps_the_email_recipe(spark):
    rows = [("Group", "Email", "email", True), ("LoginHistory", "SourceIp", "string", True), ("ApexLog", "Status", "string", True),
            ("ApexClass", "Name", "string", True)]
    frame = spark.createDataFrame(rows, "object string, name string, type string, queryable boolean")
    plan = Plan(overrides={("Group", "Email"): "HASH", ("LoginHistory", "SourceIp"): "HASH", ("ApexLog", "Status"): "PASS",
                           ("ApexClass", "Name"): "DERIVE"}, reasons={("LoginHistory", "SourceIp"): "join"})
    got = by_field(technical.resolve_fields(frame, plan))
    assert (got["Email"]["action"], got["Email"]["recipe"]) == ("HASH", "email")
    assert (got["SourceIp"]["action"], got["SourceIp"]["recipe"]) == ("HASH", "id")
    assert (got["Status"]["action"], got["Status"]["downgraded"]) == ("DROP", True)
    assert (got["Name"]["action"], got["Name"]["recipe"]) == ("DERIVE", "")


def test_plan_files(tmp_path):
    path = tmp_path / "plan.toml"
    path.write_text('[scope]\nobjects = ["A"]\n[overrides.A]\nX = "KEEP"\n[reasons.A]\nX = "why"\n[known_fields]\nA = ["X", "Y"]\n')
    plan = planfile.load_records_plan(path)
    assert plan.scope == ["A"] and plan.overrides == {("A", "X"): "KEEP"} and plan.known_fields == {("A", "X"), ("A", "Y")}
    path.write_text('[overrides.A]\nX = "keep"\n')
    with pytest.raises(PlanError):
        planfile.load_records_plan(path)
    path.write_text('[scope]\nevent_types = ["Login"]\n[overrides]\nquery = "keep"\n[reasons]\nQuery = "ok"\n')
    plan = planfile.load_event_plan(path)
    assert plan.overrides == {("", "QUERY"): "KEEP"} and plan.reasons == {("", "QUERY"): "ok"} and plan.scope == ["Login"]
    path.write_text('[overrides]\nquery = "DERIVE"\n')
    with pytest.raises(PlanError):
        planfile.load_event_plan(path)
    path.write_text('[overrides]\n"A.X" = "derive"\n')
    assert planfile.load_technical_plan(path).overrides == {("A", "X"): "DERIVE"}
    path.write_text("not toml [")
    with pytest.raises(PlanError):
        planfile.load_technical_plan(path)


def test_plan_text_round_trip(tmp_path, spark, fields):
    text = records.plan_text(fields, ["Account"])
    path = tmp_path / "plan.toml"
    path.write_text(text)
    plan = planfile.load_records_plan(path)
    assert plan.scope == ["Account"] and plan.known_fields == {("Account", f[2]) for f in FIELDS} and not plan.overrides
    assert "[SPECIAL]" in text and "Phone: DROP" in text


def test_invalid_actions(spark):
    rows = spark.createDataFrame([("A", "x", "KEEP"), ("A", "y", "NOPE")], "object string, field string, action string")
    assert [r["field"] for r in resolve.invalid_actions(rows, rules.RECORD_ACTIONS).collect()] == ["y"]
