"""Operators on small literal tables: nulls, ties and refusals."""

import pytest
from pyspark.sql import functions as F

from purselake.functions import exprs as X
from purselake.operators import aggs, graphs, joins, linking, windows
from purselake.quality import checks
from purselake.sources import lake as io


def one(spark, column, *args, schema="v string"):
    return spark.createDataFrame([args], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("The Boeing Company", "BOEING"),
        ("Company, The (Inc)", ""),
        ("United Defense Systems", "UNITED DEFENSE SYSTEMS"),
        ("Boeing North American, L.L.C.", "BOEING"),
        ("Acme Mission Systems Global Inc.", "ACME"),
        (None, ""),
    ],
)
def test_normalize_name(spark, raw, clean):
    assert one(spark, X.normalize_name(F.col("v")), raw) == clean


@pytest.mark.parametrize("text, usd", [("$1.2 million", 1_200_000), ("a $41,256 M b", 41_256_000_000), ("$5", 5), ("none", None), (None, None)])
def test_parse_money(spark, text, usd):
    assert one(spark, X.parse_money(F.col("v")), text) == usd


@pytest.mark.parametrize("text, found", [("BLI 2025 is", True), ("in 2025", False), ("BLI 2,025", False), ("line item no. 2025.", True), ("PE: 20251", False)])
def test_labelled_code(spark, text, found):
    assert one(spark, X.labelled_code_match(F.col("v"), "2025"), text) is found


def test_pct_change_of_zero_and_null_base(spark):
    df = spark.createDataFrame([(0.0, 1.0), (None, 1.0), (50.0, 75.0)], "a double, b double")
    assert [r["p"] for r in df.select(X.pct_change(F.col("a"), F.col("b")).alias("p")).collect()] == [None, None, 50.0]


def test_row_fact_id_is_null_if_a_part_is(spark):
    assert one(spark, X.row_fact_id(F.lit("a"), F.col("v")), None) is None


def test_null_is_a_key(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, n int")
    b = spark.createDataFrame([(None, 5)], "k string, m int")
    assert [(r.k, r.n, r.m) for r in joins.null_safe(a, b, ["k"]).collect()] == [(None, 1, 5)]


def test_asof_takes_the_latest_not_after(spark):
    a = spark.createDataFrame([("k", 5), ("k", 1), ("z", 9)], "k string, t int")
    b = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b"), ("k", 7, "c")], "k string, u int, v string")
    got = {(r.k, r.t): r.v for r in joins.asof_join(a, b, ["k"], "t", "u").collect()}
    assert got == {("k", 5): "b", ("k", 1): None, ("z", 9): None}


def test_hhi_without_positive_money_is_zero(spark):
    df = spark.createDataFrame([("a", 1, -5.0), ("b", 1, 3.0), ("b", 2, 1.0)], "g string, e int, m double")
    got = {r.g: r.hhi for r in aggs.hhi(df, ["g"], "e", "m").collect()}
    assert got["a"] == 0.0 and got["b"] == pytest.approx(6250.0)


def test_other_row_of_top_n(spark):
    df = spark.createDataFrame([("g", k, v) for k, v in zip("abcd", (4, 3, 2, 1))], "g string, k string, v long")
    got = {r.label: (r.members, r.total, r.listed, r.omitted) for r in aggs.top_n_with_other(df, ["g"], "k", "v", 2, 1).collect()}
    assert got == {"a": (1, 4, "", 0), "b": (1, 3, "", 0), "Other": (2, 3, "c", 1)}


def test_pick_first_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("p", None, "z"), ("p", 1, "b"), ("p", 1, "a")], "p string, n int, v string")
    assert windows.pick_first(df, ["p"], [F.col("n").desc_nulls_last(), F.col("v")]).first().v == "a"


def test_components_and_chains(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 8), (4, 4)], "a long, b long")
    assert {r.node: r.component for r in graphs.components(e, "a", "b").collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 4: 4}
    line = spark.createDataFrame([(i, i + 1) for i in range(1, 20)], "a long, b long")
    ends = {r.start: (r.end, r.steps) for r in graphs.chain_ends(line, "a", "b").collect()}
    assert ends[1] == (20, 19) and ends[19] == (20, 1)


def test_cycles_are_parked_last(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (5, 6), (6, 5)], "a long, b long")
    got = {r.node: (r.depth, r.cyclic) for r in graphs.longest_path_depth(e, "a", "b").collect()}
    assert got == {1: (0, False), 2: (1, False), 3: (2, False), 5: (3, True), 6: (3, True)}


def test_ambiguous_copies_are_refused(spark):
    df = spark.createDataFrame([("k", 1, "2024"), ("k", 2, "2024")], "k string, p int, m string")
    with pytest.raises(ValueError, match="ambiguous"):
        linking.resolve_duplicates(df, ["k"], "p", "m")


def test_retention_guard(spark, tmp_path):
    df = spark.range(10).withColumn("fy", F.lit(2024))
    io.guarded_overwrite(df, f"file://{tmp_path}/t", "fy")
    with pytest.raises(io.RetentionError):
        io.guarded_overwrite(df.limit(3), f"file://{tmp_path}/t", "fy")
    io.guarded_overwrite(df.limit(3), f"file://{tmp_path}/t", "fy", allow=True)
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 3


def test_required_columns_are_named(spark):
    with pytest.raises(ValueError, match="missing columns: x"):
        io.require_columns(spark.range(1), ["id", "x"])


def test_optional_source_is_empty(spark, tmp_path):
    assert io.read_optional(spark, f"{tmp_path}/none", "a int, b string").count() == 0


def test_money_colour_rules(spark):
    df = spark.createDataFrame([(None, ["a"]), (["a"], None), (["b"], ["a"]), (["a", "b"], ["b"]), ([], ["a"])], "x array<string>, y array<string>")
    assert [r.m for r in df.select(linking.accounts_match(F.col("x"), F.col("y")).alias("m")).collect()] == [True, False, False, True, True]


def test_checks_return_violations_only(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    assert [r.k for r in checks.unique(df, ["k"]).collect()] == [1]
    assert checks.not_null(df, "v").count() == 1
    assert checks.complete(df, df.filter("k = 1"), ["k"]).collect()[0].missing_on == "right"


def test_entry_has_a_query_for_every_key():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_client_matches_by_tier(spark):
    names = [
        "The Acme Dynamics, Inc.", "ACME DYNAMICS LAND UNIT", "Jamestown BPU", "BP", "Dynamics of Acme", "Rocket Group", "Rocket Holdings USA", "Old Name LLC", "A.D.", "USA Group", None, "", "Orbit Lab West", "My rocket",
    ]
    clients = spark.createDataFrame([(i, n) for i, n in enumerate([*names, names[0]])], "id int, client string")
    families = spark.createDataFrame([("ACME DYNAMICS",), ("BP",), ("ROCKET",), ("USA GROUP",), ("LAB",), (None,), ("ACME DYNAMICS",)], "family_key string")
    aliases = spark.createDataFrame([("ACME DYNAMICS", "A.D."), ("ROCKET", "acme dynamics"), ("BP", None)], "family_key string, name string")
    members = spark.createDataFrame([("BP", "Old Name Inc"), ("ROCKET", "Old Name Inc"), ("ROCKET", "The Rocket")], "family_key string, name string")
    pairs = linking.client_matches(clients, "client", families, aliases, members)
    got = {(r.client, r.family_key): r.tier for r in pairs.collect()}
    want = {
        (names[0], "ACME DYNAMICS"): "exact_family",
        (names[0], "ROCKET"): "curated_alias",
        (names[1], "ACME DYNAMICS"): "normalized",
        ("BP", "BP"): "exact_family",  # one short word is no part of a longer name
        ("Rocket Group", "ROCKET"): "normalized",
        ("Rocket Holdings USA", "ROCKET"): "normalized",
        ("Old Name LLC", "BP"): "family_raw_name",
        ("Old Name LLC", "ROCKET"): "family_raw_name",
        ("A.D.", "ACME DYNAMICS"): "curated_alias",
        ("USA Group", "USA GROUP"): "exact_family",
        ("My rocket", "ROCKET"): "normalized",
    }
    assert got == want
    best = {(r.id, r.family_key, r.tier) for r in linking.best_client_match(clients, "client", pairs).collect()}
    assert {(0, "ACME DYNAMICS", "exact_family"), (14, "ACME DYNAMICS", "exact_family"), (7, "BP", "family_raw_name"), (10, None, "none"), (12, None, "none")} <= best and len(best) == 15


def test_client_residue_keeps_words_that_tell(spark):
    clients = spark.createDataFrame([("Acme Holdings Land",), ("Zed Group International",), ("Acme Land",)], "client string")
    families = spark.createDataFrame([("ACME LAND GROUP",), ("ZED HOLDINGS",)], "family_key string")
    none = spark.createDataFrame([], "family_key string, name string")
    got = {(r.client, r.family_key, r.tier) for r in linking.client_matches(clients, "client", families, none, none).collect()}
    assert got == {("Acme Holdings Land", "ACME LAND GROUP", "suffix_residue"), ("Acme Land", "ACME LAND GROUP", "suffix_residue")}


def test_match_gate_refuses_stale_and_few_matches(spark):
    families = spark.createDataFrame([("ACME LAND", 9), ("ROCKET", 8), ("BP", 7), ("LAST ONE", 1), ("NO SUM", None)], "family_key string, total int")
    rows = [("Acme Land Unit", "ACME LAND", "normalized"), ("Acme Landing", "ACME LAND", "normalized"), ("Jamestown BP", "BP", "normalized"), ("Jamestown BP", "BP", "normalized"), ("x", "ROCKET", "none"), (None, None, "none")]
    filings = spark.createDataFrame(rows, "client string, family_key string, tier string")
    gate = lambda f, **more: tuple(linking.match_gate(families, "total", f, "client", **more).first())
    assert gate(filings, top=3) == (3, 2, 0.6667, 2, False)  # "Landing" is another word, "BP" too short
    assert gate(filings.limit(1), top=1) == (1, 1, 1.0, 0, True)
    assert gate(filings.limit(1), top=2) == (2, 1, 0.5, 0, False)
    assert tuple(linking.match_gate(families.limit(0), "total", filings, "client").first()) == (0, 0, 0.0, 2, False)


@pytest.mark.parametrize(
    ("rule", "text", "out"),
    [
        (X.is_synthetic_key, "0400D-A-L12", True),
        (X.is_synthetic_key, "0400D-A-L", False),
        (X.is_synthetic_key, "0400D-A-12", False),
        (X.is_synthetic_key, "x 0400D-A-L12", False),
        (X.is_synthetic_key, "0604123F", False),
        (X.is_synthetic_key, None, None),
        (X.normalize_award_number, "W58RGZ-19 - C-0001", "W58RGZ19C0001"),
        (X.normalize_award_number, "", ""),
        (X.normalize_award_number, None, None),
        (X.normalize_service_heading, " *.AIR&nbsp;&#160; FORCE .* ", "AIR FORCE"),
        (X.normalize_service_heading, "*. *", ""),
        (X.normalize_service_heading, "A.I*R", "A.I*R"),
        (X.normalize_service_heading, None, None),
    ],
)
def test_keys_numbers_and_headings(spark, rule, text, out):
    assert one(spark, rule(F.col("v")), text) == out
