"""Classifier rows and the order of the rules."""

import pytest
from pyspark.sql import functions as F

from hushframe import rules
from hushframe.operators import classify

_SCHEMA = "name string, type string, length int, label string, calculated boolean, formula string, help_text string"


def recommend(spark, name, type="string", length=0, label="", calculated=False, formula="", help_text=""):
    frame = spark.createDataFrame([(name, type, length, label, calculated, formula, help_text)], _SCHEMA)
    return classify.classify_records(frame).first()


RECORDS = [
    ("Id", "id", "RAW"), ("AccountId", "reference", "RAW"), ("OwnerId", "reference", "RAW"), ("Jigsaw", "string", "RAW"),
    ("FirstName", "string", "DROP"), ("LastName", "string", "DROP"), ("Name", "string", "DROP"),
    ("MailingStreet", "string", "DROP"), ("Home_Phone__c", "phone", "DROP"), ("Birthdate", "date", "DROP"),
    ("PhotoUrl", "url", "DROP"), ("LinkedIn_Profile__c", "string", "DROP"), ("Email", "email", "HASH_EMAIL"),
    ("Personal_Email__c", "string", "HASH_EMAIL"), ("Membership_Number__c", "string", "HASH_ID"),
    ("Website_ID__c", "string", "HASH_ID"), ("Passport_Number__c", "string", "HASH_ID"), ("Industry", "picklist", "PASS"),
    ("AnnualRevenue", "currency", "PASS"), ("IsActive", "boolean", "PASS"), ("CreatedDate", "datetime", "PASS"),
    ("HasOptedOutOfEmail", "boolean", "PASS"), ("EmailBouncedDate", "datetime", "PASS"),
    ("Secondary_Email__c", "string", "HASH_EMAIL"), ("Primary_Address_Lookup__c", "reference", "RAW"),
    ("Delivery_Address_Ref__c", "string", "DROP"), ("Trace_Flag__c", "boolean", "DROP"),
]


def test_record_rows(spark):
    frame = spark.createDataFrame([(n, t, 0, "", False, "", "") for n, t, _ in RECORDS], _SCHEMA)
    got = {r["name"]: r["action"] for r in classify.classify_records(frame).collect()}
    assert got == {n: a for n, _, a in RECORDS}


@pytest.mark.parametrize("name", ["Ethnicity__c", "Gender__c", "Disability__c", "Nationality__c", "Religion__c", "Ethnic_Group__c"])
def test_special_category(spark, name):
    row = recommend(spark, name, "picklist")
    assert (row["action"], row["special_category"]) == ("DROP", True)


def test_first_pattern_in_list_order_is_reported(spark):
    assert recommend(spark, "Ethnicity__c")["reason"].endswith(": ethnic")
    assert recommend(spark, "Zip_Phone_City__c")["reason"].endswith(": city")
    assert recommend(spark, "X", help_text="swift iban", label="tax_id")["reason"].endswith(": iban")


def test_text_lengths(spark):
    assert recommend(spark, "Blurb__c", "textarea", 40_000)["action"] == "DROP"
    assert recommend(spark, "Blurb__c", "textarea", 29_999)["action"] == "PASS"
    assert recommend(spark, "Member_Notes__c", "textarea", 2_000)["action"] == "DROP"
    assert recommend(spark, "Quick_Note__c", "string", 80)["action"] == "PASS"


def test_formula_sources(spark):
    row = recommend(spark, "Who__c", calculated=True, formula="contact.FIRSTNAME & x")
    assert row["action"] == "DROP" and "formula" in row["reason"]
    assert recommend(spark, "Total__c", "currency", calculated=True, formula="Amount__c * 2")["action"] == "PASS"
    assert recommend(spark, "Who__c", calculated=False, formula="FirstName")["action"] == "PASS"


def test_email_type_without_the_word(spark):
    row = recommend(spark, "Contact_Point__c", "email")
    assert row["action"] == "HASH_EMAIL" and "name lacks" in row["reason"]


def test_label_and_help_are_searched(spark):
    assert recommend(spark, "X1__c", label="Mobile Phone")["action"] == "DROP"
    assert recommend(spark, "X2__c", help_text="the member's email for login")["action"] == "HASH_EMAIL"


EVENTS = {
    "DERIVE": "CLIENT_IP SOURCE_IP FORWARDED_FOR_IP REMOTE_ADDRESS IP_ADDRESS URI PAGE_URL REFERRER_URI LOGIN_URL API_RESOURCE MALFORMED_URL",
    "HASH": "USER_NAME DELEGATED_USER_NAME DEVICE_ID",
    "DROP": "QUERY SEARCH_QUERY HTTP_HEADERS STACK_TRACE EXCEPTION_MESSAGE DESCRIPTION FILTER SELECT CONTEXT_MAP ACTION_MESSAGE X_TOKEN_Y",
    "RAW": "USER_ID USER_ID_DERIVED REPORT_ID SESSION_KEY LOGIN_KEY DEVICE_SESSION_ID URI_ID_DERIVED DATASET_IDS REQUEST_ID",
    "PASS": "COUNTRY_CODE CLIENT_GEO QUERY_TYPE KEY_PREFIX RUN_TIME EVENT_TYPE TIMESTAMP_DERIVED REPORT_DESCRIPTION ENTITY_NAME",
}


def test_event_columns(spark):
    rows = [(name,) for names in EVENTS.values() for name in names.split()]
    found = classify.classify_event_columns(spark.createDataFrame(rows, "column string"))
    got = {r["column"]: r["action"] for r in found.collect()}
    assert got == {name: action for action, names in EVENTS.items() for name in names.split()}
    spelled = classify.classify_event_columns(spark.createDataFrame([(" client_ip ",), ("uri",), (None,)], "column string"))
    assert [r["recipe"] for r in spelled.collect()] == ["ip_prefix", "url_sanitise", ""]


TECHNICAL = [
    ("LoginHistory", "Id", "id", "RAW", ""), ("LoginHistory", "UserId", "reference", "RAW", ""),
    ("AuthSession", "UsersId", "string", "RAW", ""), ("Group", "Email", "email", "HASH", "email"),
    ("SomeObject", "NotificationEmail", "string", "HASH", "email"), ("Contact", "HasOptedOutOfEmail", "boolean", "PASS", ""),
    ("LoginHistory", "SourceIp", "string", "DERIVE", "ip_prefix"), ("AuthSession", "ClientIp", "string", "DERIVE", "ip_prefix"),
    ("Organization", "Phone", "phone", "DROP", ""), ("SomeObj", "MobilePhone", "string", "DROP", ""),
    ("AuthSession", "LoginUrl", "url", "DERIVE", "url_sanitise"), ("AuthSession", "LogoutUrl", "string", "DERIVE", "url_sanitise"),
    ("LoginGeo", "Latitude", "string", "DROP", ""), ("LoginGeo", "City", "string", "DROP", ""),
    ("LoginGeo", "PostalCode", "string", "DROP", ""), ("LoginGeo", "CountryIso", "string", "PASS", ""),
    ("LoginGeo", "Subdivision", "string", "PASS", ""), ("PermissionSet", "Description", "string", "DROP", ""),
    ("SomeObj", "SomeError", "string", "DROP", ""), ("PermissionSet", "PermissionsModifyAllData", "boolean", "PASS", ""),
    ("ApexClass", "ApiVersion", "double", "PASS", ""), ("ApexClass", "Status", "picklist", "PASS", ""),
]


def test_technical_fields(spark):
    rows = [(o, n, t) for o, n, t, _, _ in TECHNICAL] + [(o, f, "string") for o, f, _, _ in rules.CURATED]
    found = classify.classify_technical(spark.createDataFrame(rows, "object string, name string, type string"))
    got = {(r["object"], r["name"]): (r["action"], r["recipe"]) for r in found.collect()}
    for o, n, _, a, r in TECHNICAL:
        assert got[(o, n)] == (a, r), (o, n)
    for o, f, a, r in rules.CURATED:
        assert got[(o, f)] == (a, r), (o, f)


def test_structural_skip(spark):
    rows = [("A", "Body", "string", True), ("A", "body", "string", True), ("A", "X", "BASE64", True), ("A", "Y", "anyType", True),
            ("A", "Z", "string", False), ("A", "W", "string", None)]
    frame = spark.createDataFrame(rows, "object string, name string, type string, queryable boolean")
    assert [r["name"] for r in classify.selectable(frame).collect()] == ["body", "W"]


def test_skip_buckets(spark):
    rows = [("500 Fault: INSUFFICIENT_ACCESS: x",), ("INVALID_TYPE: y",), ("Cannot use: ApexClass",), ("other",), (None,)]
    frame = spark.createDataFrame(rows, "m string")
    got = [r["b"] for r in frame.select(classify.skip_bucket(F.col("m")).alias("b")).collect()]
    assert got == ["insufficient_access", "invalid_type", "invalid_type", "unknown", "unknown"]


def test_weights(spark):
    frame = spark.createDataFrame([("ExperienceBundle",), ("Flow",), ("CustomObject",)], "t string")
    assert [r["w"] for r in frame.select(classify.type_weight(F.col("t")).alias("w")).collect()] == [500, 3, 1]


def test_fixed_tables():
    assert len(rules.CATALOGUE) == 40 and len(set(rules.CATALOGUE)) == 40
    assert len(rules.DENIED) == 25 and len(rules.SPECIAL_CATEGORY) == 17 and len(rules.DIRECT_PII) == 39
    assert len(rules.IDENTIFIERS) == 26 and len(rules.ESSAY_NAMES) == 12 and len(rules.FORMULA_SOURCES) == 12
    assert len(rules.EVENT_CONTENT) == 21 and len(rules.EVENT_KEYS) == 18 and len(rules.CURATED) == 16
