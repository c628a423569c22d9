"""Rules over narratives on literals."""

import pytest

from purselake.operators import narratives as N

A, B, C = "0601111F", "0602222F", "0603333A"


def stated(spark, *bodies, year=2024, own=A):
    rows = [(i, own, year, b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "id long, own string, year int, body string")
    return sorted((r.from_code, r.to_code, r.relation) for r in N.stated_edges(df, "id", "own", "year", "body").collect())


@pytest.mark.parametrize(
    ("body", "edge"),
    [
        (f"Funds were transferred from PE {B}.", (B, A, "realigned")),
        (f"Work transferred  from program element {B}", (B, A, "realigned")),
        (f"It was REALIGNED from PE {B} in full.", (B, A, "realigned")),
        (f"previously funded in PE {B}", (B, A, "renamed")),
        (f"Previously budgeted under program element {B}", (B, A, "renamed")),
        (f"Formerly PE {B}", (B, A, "renamed")),
        (f"will be transferred to PE {B}", (A, B, "realigned")),
        (f"realigning to program element {B}", (A, B, "realigned")),
    ],
)
def test_each_rule_with_the_own_code(spark, body, edge):
    assert stated(spark, body) == [edge]


@pytest.mark.parametrize(
    ("body", "edges"),
    [
        (f"In PE {B} phase F, efforts were transferred to PE {C}.", [(B, C, "realigned")]),
        (f"Transferred from PE {B} and transferred to PE {C}", [(B, C, "realigned")]),
        (f"Formerly PE {B}, realigned to PE {C}", [(B, C, "realigned")]),
        (f"transferred to PE {B} and transferred to PE {C}", [(A, B, "realigned"), (A, C, "realigned")]),
        (f"Formerly PE {A}, transferred to PE {A}.", []),
        (f"transferred to PE {A}", []),
        (f"moved to PE {B}", []),
        (None, []),
        ("", []),
    ],
)
def test_pairs_that_a_clause_names(spark, body, edges):
    assert stated(spark, body) == edges


def test_a_pair_named_by_two_rules_and_by_two_editions_is_one_edge(spark):
    rows = [(1, A, 2020, f"transferred from PE {B}"), (2, A, 2021, f"formerly PE {B}"), (3, A, 2021, f"realigned from PE {B}"), (4, C, 2022, f"previously funded in PE {B}, it was transferred to PE {A}")]
    df = spark.createDataFrame(rows, "id long, own string, year int, body string")
    got = N.stated_edges(df, "id", "own", "year", "body").collect()
    assert [(r.from_code, r.to_code, r.relation, r.year, r.id) for r in got] == [(B, A, "realigned", 2022, 4)]
    assert stated(spark, f"transferred from PE {B} or formerly PE {B}") == [(B, A, "realigned")]


def test_retractions(spark):
    assert stated(spark, f"Funds were erroneously transferred to PE {B}.") == []
    assert stated(spark, f"Transferred to PE {B}. The move to {B} was rescinded.") == []
    assert stated(spark, f"Transferred to PE {B}. All of {A} will be returned.") == []
    assert stated(spark, f"Transferred to PE {B}. Another award was rescinded.") == [(A, B, "realigned")]
    assert stated(spark, f"Transferred to PE {B}. The $1{B} part was rescinded.") == [(A, B, "realigned")]
    assert stated(spark, f"Transferred to PE {B} for $62.4M in error. Nothing.") == []
    assert stated(spark, f"Transferred to PE {B}. Then. The move to {B} was rescinded.") == [(A, B, "realigned")]


def test_clauses_keep_decimals_and_skip_blanks(spark):
    df = spark.createDataFrame([(1, "Cost $62.4M moved. . :Next: 1.2.3 moved")], "id long, body string")
    got = sorted(N.clause_rows(df, ["id"], "body", "moved").collect(), key=lambda r: r.clause_no)
    assert [(r.clause_no, r.clause, r.before, r.after) for r in got] == [(1, "Cost $62.4M moved", None, "Next"), (3, " 1.2.3 moved", "Next", None)]


def test_clause_candidates(spark):
    rows = [(1, f"One. Work moved to {C} and {A}, {A}. Two"), (2, "It moved, no code."), (3, f"{A} stays."), (1, f"Work moved to {C} and {A}, {A}."), (4, "split 06012345X6")]
    df = spark.createDataFrame(rows, "id long, body string")
    got = N.clause_candidates(df, "id", "body").collect()
    assert [(r.id, r.clause, r.codes) for r in got] == [(1, f"Work moved to {C} and {A}, {A}", f"{A},{C}")]


def found_successors(spark, *bodies):
    old = spark.createDataFrame([("5600D15603", "x"), ("K99999", "y"), ("12345", "x")], "code string, account string")
    new = spark.createDataFrame([("E11111", "x"), ("F22222", "y"), ("F33333", "y"), ("5600G44444", "z")], "code string, account string")
    df = spark.createDataFrame([(i, 2024, b) for i, b in enumerate(bodies)], "id long, year int, body string")
    got = N.successors(old, new, df, "id", "year", "body").collect()
    return sorted((r.code, r.successor_code, r.matched_form, r.id) for r in got)


def test_successors(spark):
    assert found_successors(spark, "5600D15603 continues under F22222") == [("5600D15603", "F22222", "literal", 0)]
    assert found_successors(spark, "Line D15603 is a continuation of G44444") == [("5600D15603", "5600G44444", "short", 0)]
    # the literal form wins wherever it stands
    assert found_successors(spark, "D15603 continues under F22222", "5600D15603 continues under F33333") == [("5600D15603", "F33333", "literal", 1)]
    # several others: those of the own account, if there is one
    assert found_successors(spark, "5600D15603 continues under F22222 and E11111") == [("5600D15603", "E11111", "literal", 0)]
    assert found_successors(spark, "5600D15603 continues under F22222 and F33333") == []
    assert found_successors(spark, "K99999 was previously funded in F22222 and F33333") == []
    assert found_successors(spark, "K99999 beside F22222", "12345 continues under F22222", "K99999 continues under K99999") == []


def candidates(spark, titles, terms):
    t = spark.createDataFrame(titles, "org string, title string")
    a = spark.createDataFrame([(i, *x) for i, x in enumerate(terms)], "id long, org string, common string, full string")
    return sorted((r.id, r.title, r.term, r.rule) for r in N.assessment_candidates(t, a, "org", "title", "id", ["common", "full"]).collect())


def test_terms_in_titles_and_titles_in_terms(spark):
    titles = [("n", "Next Missile Warning Radar"), ("n", "Warning Radar"), ("a", "Missile Warning")]
    assert candidates(spark, titles, [("n", "missile warning", None)]) == [(0, "Next Missile Warning Radar", "missile warning", "A")]
    assert candidates(spark, titles, [("n", "missile radar", "")]) == []
    long = "The Next Missile Warning Radar Block"
    assert candidates(spark, titles, [("n", None, f"{long} (Phase 2)")]) == [(0, "Next Missile Warning Radar", long, "B")]
    assert candidates(spark, titles, [("n", "Warning Radar", "Warning Radar (x)")]) == [(0, t, "Warning Radar", "A") for t in ("Next Missile Warning Radar", "Warning Radar")]
    assert candidates(spark, titles, [("x", "missile warning", ""), ("n", "  ", "...")]) == []


def test_candidates_of_repeated_names_without_broadcasts(spark):
    titles = spark.createDataFrame([("n", "Warning Radar Block"), ("n", "Radar")], "org string, title string")
    a = spark.range(500).selectExpr("id % 400 AS id", "'n' AS org", "'warning radar' AS common", "concat('New Warning Radar Block ', id % 2) AS full")
    got = N.assessment_candidates(titles, a, "org", "title", "id", ["common", "full"])
    want = [(i, "Warning Radar Block", t, r) for i in range(400) for t, r in (("warning radar", "A"), (f"New Warning Radar Block {i % 2}", "B"))]
    assert sorted((r.id, r.title, r.term, r.rule) for r in got.collect()) == sorted(want)
    # Words explode to far more than Spark estimates: at size, a broadcast ends the driver.
    assert "Broadcast" not in got._jdf.queryExecution().toString()


def test_lexicon_candidates(spark):
    body = "é The Joint Strike Program  (JSP2) met DDG 51 and AN/TPY-2."
    rows = [("k", i, t, b) for i, (t, b) in enumerate([("Radar AN/SPY-6", body), ("n/a", body), ("Radar  AN/SPY-6", None), ("radar an/spy-6", ""), ("Plans for F-35", "F-35A")])] + [("A-b-L7", 9, "Radar", body)]
    df = spark.createDataFrame(rows, "key string, id long, title string, body string")
    got = {(r.name, r.source, r.n): (r.id, r.quote) for r in N.lexicon_candidates(df, "key", "id", "title", "body").collect()}
    assert got["Radar AN/SPY-6", "title", 1] == (0, "Radar AN/SPY-6")
    assert {(n, i) for (name, s, n), (i, _) in got.items() if s == "title"} == {(1, 0), (2, 2), (3, 3)}
    assert got["AN/SPY-6", "designator-title", 1][0] == 0
    assert got["The Joint Strike Program (JSP2)", "acronym-def", 1] == (0, body)
    assert got["JSP2", "acronym", 2] == (1, body)
    assert got["DDG 51", "designator-body", 1][1] == body
    assert got["F-35A", "designator-body", 1] == (4, "F-35A")
    assert ("F-35", "designator-title", 1) not in got and {k[2] for k in got} == {1, 2, 3}
