"""Listings, deny list, batches, reconciliation, manifests."""

import random

import pytest
from pyspark.sql import functions as F

from hushframe import rules
from hushframe.operators import batching, inventory, ranking
from hushframe.plans import inventory as inventory_plan
from hushframe.sources.manifest import parse_manifests, read_manifests

DESCRIBED = [("CustomObject", False), ("Flow", False), ("DecisionTable", False), ("ConnectedApp", False), ("Report", True)]
LISTING = [
    ("CustomObject", None, "Account__c", None), ("CustomObject", None, "Foo__c", None), ("CustomObject", None, "Foo__c", None),
    ("Flow", None, "F1", None), ("ApexTrigger", None, "T1", None), ("ReportFolder", None, "FolderA", None),
    ("Report", "FolderA", "FolderA/R1", None), ("Report", "unfiled$public", "unfiled$public/R2", None),
    ("Report", "Elsewhere", "Elsewhere/R3", None), ("ConnectedApp", None, "Secret", None), ("Layout", None, "L1", None),
    ("DecisionTable", None, None, "500 Fault: INSUFFICIENT_ACCESS: no access"),
    ("ApexClass", None, None, "INVALID_TYPE: Cannot use: ApexClass"), ("StandardValueSet", None, None, "something " + "x" * 500),
    ("Dashboard", "D1", None, "INSUFFICIENT_ACCESS"), ("EmailFolder", None, None, "broken"),
]


@pytest.fixture(scope="module")
def described(spark):
    return spark.createDataFrame(DESCRIBED, "type string, in_folder boolean")


@pytest.fixture(scope="module")
def listing(spark):
    return spark.createDataFrame(LISTING, "type string, folder string, member string, error string")


def pairs(frame):
    return sorted((r["type"], r["member"]) for r in frame.collect())


def test_enumeration(described, listing):
    assert pairs(inventory.enumerate_components(described, listing)) == [
        ("ApexTrigger", "T1"), ("CustomObject", "Account__c"), ("CustomObject", "Foo__c"), ("Flow", "F1"),
        ("Report", "FolderA/R1"), ("Report", "unfiled$public/R2"), ("ReportFolder", "FolderA"),
    ]


def test_listing_skips(described, listing):
    skips = inventory.listing_skips(described, listing)
    got = sorted((r["type"], r["bucket"]) for r in skips.collect())
    assert got == [("ApexClass", "invalid_type"), ("Dashboard", "insufficient_access"), ("DecisionTable", "insufficient_access"),
                   ("EmailTemplate", "unknown"), ("StandardValueSet", "unknown")]
    assert all(len(r["detail"]) <= 403 for r in skips.collect())
    assert inventory.skip_report(skips).columns == ["type", "bucket", "requested", "retrieved"]
    assert inventory.bad_buckets(skips).count() == 0


def test_deny_list(spark):
    frame = spark.createDataFrame([("Profile", "a"), ("Profile", "b"), ("Role", "c"), ("Flow", "d")], "type string, member string")
    assert pairs(inventory.allowed(frame)) == [("Flow", "d")]
    assert {r["type"]: r["n"] for r in inventory.excluded_counts(frame).collect()} == {"Profile": 2, "Role": 1, None: 3}


def test_reconciliation(spark):
    asked = spark.createDataFrame([("T", "A"), ("T", "B"), ("T", "C"), ("U", "X"), ("U", "X")], "type string, member string")
    got = spark.createDataFrame([("T", "A"), ("T", "B"), ("U", "X"), ("V", "Z")], "type string, member string")
    (row,) = inventory.partial_retrieves(asked, got).collect()
    assert (row["type"], row["bucket"], row["requested"], row["retrieved"]) == ("T", "partial_retrieve", 3, 2)
    assert pairs(inventory.missing_components(asked, got)) == [("T", "C")]
    (line,) = inventory.skip_lines(inventory.partial_retrieves(asked, got)).collect()
    assert "(requested=3, retrieved=2)" in line["line"]


def sequential(by_type, max_members, max_weight):
    """One member after the other: a full batch is closed before the next member."""
    out, batch, count, load = {}, 1, 0, 0
    for name in sorted(by_type):
        weight = rules.TYPE_WEIGHTS.get(name, rules.DEFAULT_WEIGHT)
        for member in sorted(by_type[name]):
            if count >= max_members or load >= max_weight:
                batch, count, load = batch + 1, 0, 0
            out[(name, member)] = batch
            count, load = count + 1, load + weight
    return out


@pytest.mark.parametrize("seed", range(6))
def test_batches_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    names = rng.sample([*rules.TYPE_WEIGHTS, "CustomObject", "Layout"], 7)
    by_type = {n: {f"m{rng.randrange(10**6):06d}" for _ in range(rng.choice([1, 2, 9, 40, 300]))} for n in names}
    limits = rng.choice([(10, 1500), (7, 120), (100, 5000), (1, 1), (50, 333)])
    rows = [(n, m) for n, ms in by_type.items() for m in ms for _ in range(rng.choice([1, 2]))]
    got = batching.assign_batches(spark.createDataFrame(rows, "type string, member string"), *limits).collect()
    assert {(r["type"], r["member"]): r["batch"] for r in got} == sequential(by_type, *limits)
    assert len(got) == sum(map(len, by_type.values()))


def test_known_batches(spark):
    def sizes(name, n, *limits):
        frame = spark.createDataFrame([(name, f"m{i:03d}") for i in range(n)], "type string, member string")
        rows = batching.assign_batches(frame, *limits).groupBy("batch").count().orderBy("batch").collect()
        return [r["count"] for r in rows]

    assert sizes("CustomObject", 25, 10, 50_000) == [10, 10, 5]
    assert sizes("ExperienceBundle", 8, 8_000, 1_500) == [3, 3, 2]
    assert sizes("ExperienceBundle", 1, 8_000, 100) == [1]
    with pytest.raises(ValueError):
        batching.assign_batches(spark.createDataFrame([("a", "b")], "type string, member string"), 0, 1)


def test_rank_with_a_hot_group(spark):
    rows = spark.range(0, 30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 97)).alias("g"),
        F.format_string("%08d", (F.col("id") * 7919) % 1_000_003).alias("o"),
    )
    got = ranking.ranked(rows, ["g"], ["o"], "p", slices=13)
    from pyspark.sql import Window

    want = rows.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy("o")).cast("long") - 1)
    assert got.select("g", "o", "p").exceptAll(want).count() == 0 and got.count() == 30_000


def test_caps_and_pages(spark):
    rows = spark.range(0, 9_000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("g"), "id")
    for limit in (5, 2_500):
        got = ranking.cap_per_group(rows, ["g"], ["id"], limit).groupBy("g").agg(F.count("*").alias("n"), F.max("id").alias("m"))
        found = {r["g"]: (r["n"], r["m"]) for r in got.collect()}
        hot = [i for i in range(9_000) if i % 3 < 2][:limit]
        cold = [i for i in range(9_000) if i % 3 == 2][:limit]
        assert found == {"hot": (len(hot), hot[-1]), "cold": (len(cold), cold[-1])}
    placed = {r["id"]: r["page"] for r in ranking.pages(rows.select("id"), "id", 2_000).collect()}
    assert placed == {i: i // 2_000 for i in range(9_000)}
    assert [r["id"] for r in ranking.next_page(rows.select("id"), "id", 41, 3).collect()] == [42, 43, 44]


def test_caps_of_uneven_groups(spark):
    rows = spark.range(0, 20_000).select(
        F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 3 == 2, F.concat(F.lit("g"), F.col("id") % 501)).alias("g"),
        F.when(F.col("id") % 1_000 == 2, None).otherwise((F.col("id") * 7919) % 1_000_003).alias("o"),
        "id",
        F.lit(0).alias("rows"),
    ).withColumn("g", F.when(F.col("id") % 50 == 0, None).otherwise(F.col("g")))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("g").orderBy("o", "id"))
    for limit in (1, 7, 1_001, 12_000, 10**9):
        want = rows.withColumn("p", place).where(F.col("p") <= limit).drop("p")
        got = ranking.cap_per_group(rows, ["g"], ["o", "id"], limit)
        assert got.columns == rows.columns
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    none = rows.limit(0)
    assert ranking.cap_per_group(none, ["g"], ["id"], 3).count() == 0 and ranking.pages(none, "id", 3).count() == 0
    same = spark.createDataFrame([(1, "a")] * 500, "k int, v string")
    assert ranking.cap_per_group(same, ["k"], ["v"], 20).count() == 20
    assert {r["p"] for r in ranking.ranked(same, ["k"], ["v"], "p").collect()} == set(range(500))


def test_numbering_runs_no_job_and_sorts_ranges(spark):
    from hushframe.operators.ranking import _in_ranges

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("numbering", "none")
    rows = spark.range(0, 40_000).select(F.lit("hot").alias("g"), F.format_string("%08d", (F.col("id") * 7919) % 1_000_003).alias("o"))
    ranking.ranked(rows, ["g"], ["o"], "p"), ranking.cap_per_group(rows, ["g"], ["o"], 5_000)
    assert not tracker.getJobIdsForGroup("numbering")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    sizes = _in_ranges(rows, ["g", "o"], 16).groupBy(F.col("_range").alias("r")).agg(
        F.count(F.lit(1)).alias("n"), F.min("o").alias("low"), F.max("o").alias("high")
    ).orderBy("r").collect()
    assert len(sizes) >= 10 and max(r["n"] for r in sizes) < 3 * 40_000 / 16
    assert all(a["high"] < b["low"] for a, b in zip(sizes, sizes[1:]))


def test_manifests(spark, tmp_path):
    frame = spark.createDataFrame([("Flow", "B<1>"), ("Flow", "A&"), ("Layout", "L")], "type string, member string")
    blocks = inventory.manifest_blocks(batching.chunks(batching.assign_batches(frame)))
    text = inventory_plan.manifest_of(blocks, 1)
    assert text.startswith("<?xml") and text.index("A&amp;") < text.index("B&lt;1&gt;") and "<version>61.0</version>" in text
    texts = spark.createDataFrame([(text,), ("  ",), (None,)], "body string")
    assert pairs(parse_manifests(texts)) == pairs(frame)
    (tmp_path / "package.xml").write_text(text)
    (tmp_path / "again.xml").write_text(
        "<Package><types><members> L </members><members>M</members><members> </members><name>Layout</name></types>"
        "<types><members>x</members></types></Package>"
    )
    assert pairs(read_manifests(spark, str(tmp_path))) == sorted([*pairs(frame), ("Layout", "M")])


def test_rename_map(spark):
    frame = spark.createDataFrame([("a<b.txt",), ("ok/x.cls",), ("../evil",), ("/lead/ok",)], "path string")
    assert [tuple(r) for r in inventory.rename_map(frame).collect()] == [("a<b.txt", "a_b.txt")]


def test_batches_of_very_many_types(spark):
    """10^5 types, most of one member, two heavy: blocks composed, equal to the sequential rule."""
    limits = (400, 1200)
    by_type = {f"T{i:06d}": {f"m{j:05d}" for j in range(i % 59 if i % 50 == 1 else 1)} for i in range(100_000)}
    by_type = {n: ms for n, ms in by_type.items() if ms}
    by_type["ExperienceBundle"] = {f"m{j:05d}" for j in range(3_000)}
    by_type["T050000x"] = {f"m{j:05d}" for j in range(40_000)}
    sizes = spark.createDataFrame([(n, len(ms)) for n, ms in by_type.items()], "type string, n int")
    frame = sizes.select("type", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.format_string("m%05d", j))).alias("member"))
    got = batching.assign_batches(frame, *limits).toPandas()
    wanted = sequential(by_type, *limits)
    assert dict(zip(zip(got["type"], got["member"]), got["batch"])) == wanted and len(got) == len(wanted)


def test_batches_without_rows_and_without_types(spark):
    schema = "type string, member string"
    assert batching.assign_batches(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(None, "a"), ("T", None), ("T", "a")], schema)
    assert {tuple(r) for r in batching.assign_batches(rows, 1, 1).select("batch", "member").collect()} == {(1, None), (2, "a")}
