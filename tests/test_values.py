"""Value transforms against known inputs and outputs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from hushframe.functions import dates, masking, paths, text
from hushframe.operators.mask import ColumnAction, mask, record_action


def column(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in frame.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def sha(value):
    return hashlib.sha256(value.encode()).hexdigest()


def test_hash_email(spark):
    got = column(spark, ["  Foo@Bar.COM ", "foo@bar.com", "", "   ", None, " x@y.z　"], masking.hash_email)
    assert got == [sha("foo@bar.com"), sha("foo@bar.com"), "", "", "", sha("x@y.z")]


def test_hash_id_keeps_case(spark):
    assert column(spark, ["  WID-123 ", "wid-123", "\t", None], masking.hash_id) == [sha("WID-123"), sha("wid-123"), "", ""]


@pytest.mark.parametrize(
    "value, expected",
    [
        ("203.0.113.55", "203.0.113.0"),
        ("10.0.0.1", "10.0.0.0"),
        ("2001:db8:85a3:8d3:1319:8a2e:370:7348", "2001:db8:85a3::"),
        ("", ""),
        ("not-an-ip", ""),
        (None, ""),
        (" 1.2.3.4 ", "1.2.3.0"),
        ("1.2.3.4:443", "1.2.3.0"),
        ("fe80::1:2", "fe80::"),
        ("::1", ""),
        ("a.b.c.d", ""),
        ("1.2.3", ""),
        ("host:443", ""),
    ],
)
def test_ip_prefix(spark, value, expected):
    assert column(spark, [value], masking.ip_prefix) == [expected]


@pytest.mark.parametrize(
    "value, expected",
    [
        ("/home?ret=%2Fsetup", "/home"),
        ("/p;jsessionid=ABC", "/p"),
        ("https://h.my.example.com/x/y?a=1&b=2", "https://h.my.example.com/x/y"),
        ("/x#frag", "/x"),
        ("", ""),
        (None, ""),
        ("https://util.example.com/ipinfo/93.159.47.56", "https://util.example.com/ipinfo/93.159.47.0"),
        ("http://10.0.0.1/api/v1?token=abc", "http://10.0.0.0/api/v1"),
        ("https://example.com/path/192.168.1.42/info", "https://example.com/path/192.168.1.0/info"),
        (" /a\n?b\nc ", "/a\n"),
    ],
)
def test_clean_url(spark, value, expected):
    assert column(spark, [value], masking.clean_url) == [expected]


def test_clean_url_can_drop_userinfo(spark):
    got = column(spark, ["https://u:p@h.example.com/x@y", "/x@y"], lambda c: masking.clean_url(c, drop_userinfo=True))
    assert got == ["https://h.example.com/x@y", "/x@y"]


def test_derivations(spark):
    assert column(spark, ["SW1A 1AA", " ec1v9hq ", "", None], masking.outcode) == ["SW1A", "EC1V9HQ", "", ""]
    assert column(spark, ["1990-05-01", "  1985", "May 1990", None], masking.birth_year) == ["1990", "1985", "", ""]
    assert column(spark, ["MailingPostalCode", "Zip__c", "DOB__c", "Birthdate", "Name"], masking.derive_recipe) == [
        "uk_postcode_outcode", "uk_postcode_outcode", "year_of_birth", "year_of_birth", None,
    ]
    for name in ("MailingPostalCode", "DOB__c", "Name"):
        assert column(spark, [name], masking.derive_recipe) == [masking.derive_recipe_of(name)]


def test_cell_text(spark):
    frame = spark.createDataFrame([(True, 1000, 12.5, None)], "b boolean, i int, d double, s string")
    row = frame.select(*[text.as_text(F.col(n), t).alias(n) for n, t in frame.dtypes]).first()
    assert tuple(row) == ("True", "1000", "12.5", "")


def test_schema_text(spark):
    got = column(spark, ["<b>A\n\t label</b> ", None, "x" * 600, "a 　b"], text.schema_text)
    assert got == ["bA label/b", "", "x" * 500 + "...", "a b"]


def test_skip_detail(spark):
    assert column(spark, ["z" * 5000, "short", None], text.skip_detail) == ["z" * 400 + "...", "short", ""]


def test_actions_by_name(spark):
    frame = spark.createDataFrame(
        [("001", "A@b.c", "W1", "ab1 2cd", "Tech", True)],
        "Id string, Email string, Key string, Zip string, Industry string, Flag boolean",
    )
    actions = [
        record_action("Id", "RAW"), record_action("Email", "HASH_EMAIL"), record_action("Key", "HASH_ID"),
        record_action("Zip", "DERIVE"), record_action("Industry", "DERIVE"), record_action("Flag", "HASH_ID"),
    ]
    out = mask(frame, actions)
    assert out.columns == ["Id", "Email", "Key", "Zip", "Flag"]  # DERIVE without a recipe is dropped
    assert tuple(out.first()) == ("001", sha("a@b.c"), sha("W1"), "AB1", sha("True"))
    assert mask(frame, [ColumnAction(c, "DROP") for c in frame.columns]).columns == ["Id"]


def test_long_dispatch_agrees_with_wide(spark):
    rows = [
        ("HASH_EMAIL", "", " A@B.c "), ("HASH", "email", "A@B.c"), ("HASH", "id", "A@B.c"), ("HASH_ID", "", None),
        ("DERIVE", "ip_prefix", "1.2.3.4"), ("DERIVE", "url_sanitise", "/a?b"), ("DERIVE", "", "x"), ("DROP", "", "x"),
        ("RAW", "", "x"), ("PASS", "", None),
    ]
    frame = spark.createDataFrame(rows, "action string, recipe string, value string")
    got = [r["o"] for r in frame.select(
        masking.apply_action_column(F.col("value"), F.col("action"), F.col("recipe")).alias("o")).collect()]
    assert got == [sha("a@b.c"), sha("a@b.c"), sha("A@B.c"), "", "1.2.3.0", "/a", "", "", "x", ""]


def test_paths(spark):
    assert column(spark, ["objects/Acc<ount>.field"], paths.safe_path) == ["objects/Acc_ount_.field"]
    (short,) = column(spark, ["classes/" + "A" * 200 + ".cls"], paths.safe_path)
    name = short.split("/")[-1]
    assert len(name) <= 120 and name.endswith(".cls")
    assert name == "A" * 107 + "_" + hashlib.sha1(("A" * 200 + ".cls").encode()).hexdigest()[:8] + ".cls"
    assert column(spark, ["x. .", "...", "a|b", "ok"], paths.legal_component) == ["x", "_", "a_b", "ok"]
    assert column(spark, ["../evil", "a/../../evil", "a/../b", "ok.txt", "/x/y"], paths.escapes_root) == [
        True, True, False, False, False,
    ]
    (long_extension,) = column(spark, ["a." + "e" * 300], paths.short_component)
    assert len(long_extension) <= 120


def test_dates(spark):
    assert column(
        spark, ["2026-06-09T00:00:00.000+0000", "2026-06-09", "junk-textT1", "2024-13-45T00:00:00", "", None], dates.log_day
    ) == ["2026-06-09", "2026-06-09", "junk-text", "2024-13-45", "", ""]
    ends = column(
        spark,
        ["2026-01-01_to_2026-01-09", "x_to_2026-1-9", "a_to_b_to_2026-01-09", "scratch", "a_to_2026-02-30"],
        lambda c: dates.window_end(c).cast("string"),
    )
    assert ends == ["2026-01-09", "2026-01-09", None, None, None]
