"""Indexes, sweeps, row numbers, digests, overlays and bucketed merges on literals."""

import hashlib
import math
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from purselake.operators import aggs, joins, linking, text_index, windows
from purselake.plans import graph_text, registry
from purselake.schedule import jobs as schedule
from purselake.sources import lake
from purselake.streaming.jobs import BucketTable


def test_postings_and_hits(spark):
    docs = spark.createDataFrame([(1, "One two, ONE."), (None, "two"), (2, None), (2, ""), (3, "é two2")], "id long, text string")
    got = sorted(map(tuple, text_index.written_postings(docs, "text", ["id"]).collect()), key=repr)
    assert got == sorted([("one", 1, 1, 2), ("two", 1, 5, 1), ("two", None, 1, 1), ("two2", 3, 3, 1)], key=repr)


def test_mentions_with_many_terms_null_and_repeated_ids(spark):
    texts = [(1, "x alpha beta end"), (1, "alpha only"), (None, "about CODE7 here"), (4, "nick"), (4, "nick"), (5, "reporting alpha: beta, port"), (6, "gamma alpha")]
    docs = spark.createDataFrame([(i, len(t), t) for i, t in texts], "doc_id long, n_chars int, text string")
    rows = [(1, "Alpha Beta beta", "code7", "nick")] + [(i, f"filler{i} other{i}", f"zz{i}", f"yy{i}") for i in range(2, 1002)]
    programs = spark.createDataFrame(rows, "item_id int, title string, code string, alias string")
    index = text_index.written_postings(docs.withColumn("text_key", text_index.text_key(F.col("text"))), "text", ["doc_id", "n_chars", "text_key"])
    got = sorted(map(tuple, graph_text.mentions(docs, index, programs).collect()), key=repr)
    want = [
        (1, 1, "alpha", "title_tokens", "x alpha beta end"), (None, 1, "code7", "code", "about CODE7 here"), (4, 1, "nick", "alias", "nick"), (4, 1, "nick", "alias", "nick"),
        (5, 1, "alpha", "title_tokens", "reporting alpha: beta, port"),
    ]
    assert got == sorted(want, key=repr)
    many = text_index.term_hits(index, programs.select("item_id", F.col("code").alias("term")), limit=10)
    assert [r.item_id for r in many.collect()] == [1]


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), lo, lo + rng.choice([-1, 0, 0, 1, 3, 17, 200])) for i in range(400) for lo in [rng.randrange(-50, 300)]]
    df = spark.createDataFrame([*rows, (900, 1, None, 5), (901, None, 0, 9), (902, None, 0, 9)], "id int, k int, lo int, hi int")
    got = Counter((r.k, r.id_a, r.id_b) for r in joins.overlap_pairs(df, ["k"], "id", "lo", "hi").collect())
    sound = [r for r in rows if r[2] <= r[3]]
    want = Counter((a[1], a[0], b[0]) for a in sound for b in sound if a[1] == b[1] and a[0] < b[0] and a[2] <= b[3] and b[2] <= a[3])
    assert got == want


def test_a_key_of_disjoint_ranges_costs_no_product(spark):
    df = spark.range(100_000).selectExpr("id", "1 AS k", "date_add(DATE '1700-01-01', cast(id AS int) * 2) AS lo", "date_add(DATE '1700-01-01', cast(id AS int) * 2 + 1) AS hi")
    began = time.time()
    assert joins.overlap_pairs(df, ["k"], "id", "lo", "hi").count() == 0
    assert time.time() - began < 60


def test_tolerance_matches_equal_brute_force(spark):
    rng, inf = random.Random(9), float("inf")
    for tol in (1.0, 0.1, 0.3, 25.00001, 2.5):
        near = lambda: rng.choice([0.0, -0.0, tol, -tol, rng.randrange(-30, 30) * tol / 4, rng.randrange(-30, 30) / 10, rng.uniform(-3 * tol, 3 * tol)])  # noqa: E731, B023
        steps = [x for v in (near() for _ in range(60)) for x in (v, v + tol, math.nextafter(v + tol, inf), math.nextafter(v + tol, -inf), math.nextafter(v - tol, inf))]
        huge = [s * 2.0**e * tol + k * 2.0 ** (e - 52) * tol for s in (1, -1) for e in (44, 46, 50, 52, 53, 54, 60) for k in range(-6, 7)]
        odd = [inf, -inf, inf, float("nan"), None, 1e300, -1e300, 1.7e308, -1.7e308, 5e-324, -5e-324, 1e-18]
        rows = [(rng.choice([i, i, i, i - 1, None]), rng.choice(["x", "x", "x", "y", None]), v) for i, v in enumerate(rng.sample(steps, len(steps)) + [*odd, *odd, *huge])]
        df = spark.createDataFrame(rows, "id long, k string, v double")
        found = joins.tolerance_match(df.withColumnRenamed("v", "a"), df.selectExpr("id AS other", "k", "v AS b"), ["k"], "a", "b", tol, "id", "other").collect()
        sound = [r for r in rows if None not in r]
        want = {}
        for i, k, v in sound:
            for j, m, w in sound:
                if k == m and i != j and abs(v - w) < tol:
                    want[i] = min(want.get(i, j), j)
        assert len(found) == len(want) and {r.id: r.other for r in found} == want


def test_a_key_of_near_values_costs_no_product(spark, tmp_path):
    rows = spark.range(100_000).selectExpr("id AS p_partkey", "'b' AS p_brand", "'t' AS p_type", "900 + pmod(id * 7919, 2000) / 100.0D AS p_retailprice")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    began = time.time()
    got = registry.QUERIES["J10_tolerance_match"](spark, str(tmp_path)).groupBy("other").count().collect()
    assert sorted(map(tuple, got)) == [(0, 99_999), (1, 1)]
    assert time.time() - began < 60


def test_row_numbers_over_ranges(spark):
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else "cold", (i * 7919) % 5000) for i in range(5000)]
    df = spark.createDataFrame(rows, "p string, v int").repartition(7)
    got = windows.numbered(df, ["p"], [F.col("v").desc()], "r").collect()
    want = {(p, v): i for q in (None, "hot", "cold") for i, (p, v) in enumerate(sorted((x for x in rows if x[0] == q), key=lambda x: -x[1]), 1)}
    assert {(r.p, r.v): r.r for r in got} == want and len(got) == len(rows)


def test_digests(spark):
    rows = [("a", "2"), ("a", "10"), ("a", None), (None, "x"), ("b", None)] + [("c", str(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v string").repartition(5)
    got = {r.k: r.digest for r in aggs.lines_digest(df, ["k"], F.col("v")).collect()}
    sha = lambda xs: hashlib.sha256("\n".join(sorted(xs)).encode()).hexdigest()
    assert got == {"a": sha(["2", "10"]), None: sha(["x"]), "b": sha([]), "c": sha(map(str, range(3000)))}
    same = df.groupBy("k").agg(aggs.multiset_digest(F.col("v")).alias("d")).collect()
    again = df.orderBy(F.rand(3)).groupBy("k").agg(aggs.multiset_digest(F.col("v")).alias("d")).collect()
    assert {r.k: r.d for r in same} == {r.k: r.d for r in again} and len({r.d for r in same}) == 4
    twice = df.union(df.filter("v = '2'")).groupBy("k").agg(aggs.multiset_digest(F.col("v")).alias("d")).collect()
    assert {r.k: r.d for r in twice}["a"] != {r.k: r.d for r in same}["a"]


def test_top_and_other(spark):
    df = spark.createDataFrame([("g", f"m{i:02}", 100 - i) for i in range(14)] + [("h", "x", None), ("h", "y", 1)], "g string, k string, v int")
    got = {(r.g, r.label): tuple(r)[2:] for r in aggs.top_n_with_other(df, ["g"], "k", "v", 5, 3).collect()}
    assert got["g", "Other"] == (9, sum(100 - i for i in range(5, 14)), "m05,m06,m07", 6, sum(100 - i for i in range(8, 14)))
    assert got["g", "m04"] == (1, 96, "", 0, 0) and ("h", "Other") not in got and got["h", "x"][1] is None


def test_targets_of_all_four_shapes(spark):
    slots = spark.createDataFrame([(1, "s", "l", "2024-01-15", 1, 9), (2, "s", "l", "2024-01-16", 2, 9), (3, "s", "l", "2024-01-15", 1, 7)], "event long, studio string, location string, class_date string, dow int, minutes int")
    targets = spark.createDataFrame([(10, "s", "l", 9, 2, None), (11, "s", "l", None, 2, None), (12, "s", "l", 9, 5, "2024-01-15"), (13, "s", "l", None, 5, "2024-01-15")], "target long, studio string, location string, want_minutes int, want_dow int, want_date string")
    assert sorted((r.target, r.event) for r in schedule.target_slot_match(slots, targets).collect()) == [(10, 2), (11, 2), (12, 1), (13, 1), (13, 3)]


def test_taken_days_go_before_slots_are_met(spark, tmp_path):
    rng = random.Random(6)
    day = lambda: rng.choice(["2024-01-15", "2024-01-16", "2024-01-22", None])
    slots = [(i, rng.choice("st"), "l", day(), rng.choice([1, 2, None]), rng.choice([7, 9, None])) for i in range(80)]
    targets = [(rng.choice([i, i, 5, None]), rng.choice(["s", "t", None]), "l", rng.choice([7, 9, None]), rng.choice([1, 2, None]), day()) for i in range(60)]
    taken = [(rng.choice([rng.randrange(60), 5, None]), day()) for _ in range(60)]
    frames = [spark.createDataFrame(rows, ddl) for rows, ddl in (
        (slots, "event long, studio string, location string, class_date string, dow int, minutes int"),
        (targets, "target long, studio string, location string, want_minutes int, want_dow int, want_date string"),
        (taken, "target long, class_date string"),
    )]
    got = Counter((r.target, r.event) for r in schedule.target_slot_match(*frames).collect())
    gone = {t for t in taken if None not in t}
    want = Counter(
        (t[0], s[0]) for s in slots for t in targets
        if s[1:3] == t[1:3] and (t[3] is None or t[3] == s[5]) and (t[5] == s[3] if t[5] is not None else t[4] is not None and t[4] == s[4]) and (t[0], s[3]) not in gone
    )
    assert got == want and len(want) > 100
    kind = "array('click', 'purchase')[id % 2] AS event_type"
    spark.range(1000).selectExpr("id AS event_id", "id % 7 AS user_id", kind, "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id AS int)) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    plan = registry.QUERIES["B03_suppress_existing_jobs"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    joins_of = [line.split("Join ")[1].split(",")[0].split(" ")[0] for line in plan.splitlines() if "Join " in line]
    assert joins_of[0] == "Inner" and joins_of.count("LeftAnti") == 4  # matches are not joined again


def reviewed(spark, method, confidence, adjudication=None, reviews=(), ruling=None):
    links = spark.createDataFrame([("p", 1, "R-1", 2020, method, confidence)], "pe string, award int, exhibit string, year int, method string, confidence string")
    adj = spark.createDataFrame([("p", 1, *adjudication)] if adjudication else [], "pe string, award int, adjudicated_confidence string, award_verdict string, pair_reason string, basis string, lenses_passed int")
    rev = spark.createDataFrame([("p", 1, "R-1", 2020, *r) for r in reviews], "pe string, award int, exhibit string, year int, record_kind string, reviewer_verdict string, adversarial_verdict string, article_id string, cites_article boolean")
    rul = spark.createDataFrame([("p", 1, ruling), ("p", 1, "hold")] if ruling else [], "pe string, award int, ruling string")
    got = linking.overlay_grades(links, adj, rev, rul, ["pe", "award"], ["exhibit", "year"]).collect()
    assert len(got) == 1
    return got[0].confidence, got[0].demotion_reason


def test_overlay_of_decisions(spark):
    upheld, refuted, wrong = ("pipeline", "link", "upheld", None, None), ("pipeline", "link", "refuted", "7", None), ("pipeline", "wrong", None, "7", True)
    elsewhere, sample = ("pipeline", "link", "refuted", "7", False), ("precision_sample", "weak", None, "7", False)
    two = ("medium", "pinned", "pinned-here", "b", 2)
    assert reviewed(spark, "account", "low", ruling="withdraw") == ("low", None)
    assert reviewed(spark, "account", "high", ruling="withdraw") == ("low", "line_activity_mismatch")
    assert reviewed(spark, "account", "high", ruling="withdraw", reviews=[sample]) == ("low", "precision_sample_refuted")
    assert reviewed(spark, "account", "high", ruling="allow") == ("high", None)
    assert reviewed(spark, "account+subagency", "medium") == ("low", "account_subagency_not_pinned")
    assert reviewed(spark, "account+subagency", "medium", two) == ("medium", None)
    assert reviewed(spark, "account+tokens", "high") == ("medium", "account_tokens_unadjudicated")
    assert reviewed(spark, "account+tokens", "high", ("high", "plausible", "x", "b", 1)) == ("high", None)
    announced = lambda *r: reviewed(spark, "announcement+lexicon", "high", reviews=r)
    assert announced(upheld) == ("high", None)
    assert announced(upheld, elsewhere) == ("high", None)
    assert announced(upheld, refuted) == ("medium", "announcement_review_refuted")
    assert announced(upheld, wrong) == ("medium", "announcement_reviewer_rejected")
    assert announced(upheld, sample) == ("medium", "precision_sample_refuted")
    assert announced(elsewhere) == ("medium", "announcement_review_refuted")
    assert announced(("pipeline", "link", None, None, None)) == ("medium", "announcement_review_incomplete")
    assert announced() == ("medium", "announcement_review_unrecorded")
    assert reviewed(spark, "account", "high", reviews=[sample]) == ("medium", "precision_sample_refuted")
    assert reviewed(spark, "account", "high", two, reviews=[sample]) == ("medium", None)


def test_grading_of_links(spark):
    lines = spark.createDataFrame([("c", "A", "o", 2020, ["jet", "fuel", "cell"]), ("c", "A", "o", 2020, ["pump"])], "code string, account string, organization string, year int, words array<string>")
    tx = [(1, 2020, ["A"], ["jet"], "x", 5), (1, 2020, ["A", "B"], ["pump"], "x", 7), (2, 2020, ["B", "A"], ["jet"], "Air Force East", 1), (3, 2020, ["A"], [], None, 2), (4, 2021, ["A"], ["jet", "pump"], "x", 3), (5, 2020, ["AA"], ["jet", "pump"], "x", 3)]
    t = spark.createDataFrame(tx, "award int, year int, accounts array<string>, words array<string>, sub_agency string, obligation int")
    alias = spark.createDataFrame([("o", "air force")], "organization string, alias string")
    got = {r.award: (r.confidence, r.method, r.overlap, r.matched_obligation) for r in linking.grade_links(lines, t, alias).collect()}
    assert got == {1: ("high", "account+tokens", 2, 5), 2: ("medium", "account+subagency", 1, None), 3: ("low", "account", 0, 2)}


def test_awards_of_a_kind_are_graded_once(spark):
    words = lambda start: f"transform(sequence({start}, {start} + 399), x -> concat('w', x)) AS words"
    lines = spark.range(300).selectExpr("concat('c', id) AS code", "'A' AS account", "'o' AS organization", "2020 AS year", words("399 + id"))
    t = spark.range(8_000).selectExpr("id AS award", "2020 AS year", "array('A') AS accounts", words("1"), "'Air Force East' AS sub_agency", "1 AS obligation")
    alias = spark.createDataFrame([("o", "air force")], "organization string, alias string")
    began = time.time()
    got = linking.grade_links(lines, t, alias).groupBy("confidence", "method", "overlap").agg(F.count(F.lit(1)).alias("n"), F.sum("matched_obligation").alias("m")).collect()
    assert sorted(map(tuple, got)) == [("high", "account+tokens", 2, 8_000, 8_000), ("medium", "account+subagency", 0, 298 * 8_000, 298 * 8_000), ("medium", "account+subagency", 1, 8_000, 8_000)]
    assert time.time() - began < 30


def test_era_classes(spark):
    ddl = "edition int, account string, code string, title string"
    era = spark.createDataFrame(
        [(2020, "a", "A1", "Big Jet (MOD)"), (2020, "a", "A2", "big fast jet"), (2020, "a", "R1", "sea radar"), (2020, "b", "R2", "x"), (2020, "a", "H", "x"), (2020, "a", "CR1", "x"), (2020, "a", "R3", "one"), (2020, "b", "R3", "two"), (2020, "a", "G", "gap jet")], ddl
    )
    modern = spark.createDataFrame([(2024, "a", "A1", "big jet"), (2024, "a", "A2", "big jet"), (2024, "a", "R1", "land radar set"), (2024, "a", "R2", "x"), (2024, "a", "R3", "one"), (2024, "a", "CR1", "x"), (2024, "a", "G", "gap jet two")], ddl)
    amounts = spark.createDataFrame([("a", "A2", 2019, "enacted", 5000), ("a", "A2", 2019, "actuals", 2500), ("a", "A2", 2020, "enacted", 9000), ("a", "G", 2019, "enacted", 5000), ("a", "G", 2019, "actuals", -5000)], "account string, code string, fy int, kind string, amount int")
    got = {(r.account, r.code): r["class"] for r in linking.classify_era_keys(era, modern, amounts, ["CR1"]).collect()}
    assert got == {("a", "A1"): "A1", ("a", "A2"): "A2", ("a", "R1"): "R1", ("b", "R2"): "R2", ("a", "H"): "H", ("a", "CR1"): "CR", ("a", "R3"): "R3", ("b", "R3"): "R2", ("a", "G"): "R1"}


def test_announcement_records(spark):
    html = "<title>Contracts For March 5, 2024</title><p>NAVY</p><p a='b'>Acme <b>Corp.,</b> X, won a $1.5 million contract (N0001924C0001). See $3,000 and contract N00019-19-C-0002</p><pre>N0001924C9999</pre><p>no number $5</p><P>U.S. Army Command.*</P><p>Bolt, $1 $2 $3 $4 $5 to contract mod N00019 24 C 0003, N0001924C0004</p>"
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p>Solo N0001924C0001</p>")], "id int, html string")
    got = [tuple(r)[:-1] for r in sorted(lake.announcement_records(df, "id", "html").collect(), key=lambda r: (r.id, r.pos))]
    assert got == [
        (1, 1, "2024-03-05", "NAVY", "Acme Corp.", "referenced:N0001924C0001,referenced:N0001919C0002", "1500000,3000"),
        (1, 4, "2024-03-05", "U.S. ARMY COMMAND", "Bolt", "referenced:N0001924C0003,award:N0001924C0004", "1,2,3,4"),
        (4, 0, None, None, "Solo N0001924C0001", "award:N0001924C0001", ""),
    ]


def test_bucket_table_rewrites_touched_buckets_only(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    table = BucketTable(spark, folder, ["k"], "n", buckets=8)
    rows = lambda xs: spark.createDataFrame(xs, "k int, n int, v string")
    table.merge(rows([(i, 0, "a") for i in range(100)]), 0)
    files = lambda: {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet") if "data" in str(p)}
    first = files()
    one = [(5, 1, "b"), (5, 0, "old")]
    table.merge(rows(one), 1)
    kept = [f for f in first if f in files() and files()[f] == first[f]]
    assert len(kept) == len(first)  # the batch before can still be replayed from
    held = table.manifest()
    assert sorted(held.values()) == [0] * 7 + [1]
    want = {i: (0, "a") for i in range(100)} | {5: (1, "b")}
    read = lambda: {r.k: (r.n, r.v) for r in table.rows(rows([]).schema).collect()}
    assert read() == want
    table.merge(rows(one), 1)  # a replay
    assert read() == want and table.manifest() == held
    table.merge(rows([(5, 2, "c"), (200, 1, "d")]), 2)
    table.merge(rows([(5, 3, "e")]), 3)
    assert read() == want | {5: (3, "e"), 200: (1, "d")}
    bucket = next(b for b, v in table.manifest().items() if v == 3)
    left = {f.split("/data/")[1].split("/")[0] for f in files() if f"__bucket={bucket}/" in f}
    assert left == {"v2", "v3"} and table.manifests() == [2, 3]
