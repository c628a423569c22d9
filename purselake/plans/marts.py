"""Mart jobs M01-M35: each one callable job over the lake's bindings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from purselake.functions import exprs as X
from purselake.operators import aggs, joins, linking, windows
from purselake.plans.bindings import Lake, with_sql
from purselake.plans.registry import query
from purselake.plans.relational import CANDIDATES_SQL, HHI_SQL, RANGE_SQL, candidates, money, range_rules
from purselake.plans.scalars import CLASS_SQL, OFFERS, OFFERS_SQL, competed_class


def n_rows():
    return F.count(F.lit(1))


def tier_rank(c):
    return X.recode(c, {"high": 1, "medium": 2}, 3)


def crosswalk(lake):
    """Recipients with totals, method and confidence."""
    totals = lake.transactions(with_order=False).groupBy("recipient_id").agg(F.sum("obligation").alias("total_obligation"))
    tier = F.when(F.col("balance") >= 5000, "high").when(F.col("balance") >= 0, "medium").otherwise("low")
    return lake.recipients().join(totals, "recipient_id", "left").withColumn("confidence", tier)


XWALK_SQL = """, xk AS (SELECT xw.*, t.total_obligation, CASE WHEN balance >= 5000 THEN 'high' WHEN balance >= 0 THEN 'medium' ELSE 'low' END AS confidence
FROM xw LEFT JOIN (SELECT recipient_id, sum(obligation) AS total_obligation FROM tx GROUP BY 1) t USING (recipient_id))"""


@query("M01_dim_entities", with_sql("tx xw", XWALK_SQL + """, d AS (SELECT family_key, recipient_id, recipient_name, row_number() OVER (PARTITION BY family_key ORDER BY total_obligation DESC NULLS LAST, recipient_name, recipient_id) AS n FROM xk)
SELECT k.family_key, d.recipient_name AS display_name, d.recipient_id AS dominant_id, k.n AS uei_count, CAST(k.t AS DOUBLE) AS total_obligation, CASE k.w WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS worst_confidence
FROM (SELECT family_key, count(*) AS n, sum(total_obligation) AS t, max(CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS w FROM xk GROUP BY 1) k JOIN d ON k.family_key = d.family_key AND d.n = 1"""))
def m01(spark, sf):
    best = F.min(F.struct(F.col("total_obligation").isNull(), -F.col("total_obligation"), "recipient_name", "recipient_id"))
    f = crosswalk(Lake(spark, sf)).groupBy("family_key").agg(best.alias("b"), n_rows().alias("uei_count"), F.sum("total_obligation").alias("t"), F.max(tier_rank(F.col("confidence"))).alias("w"))
    return f.select("family_key", F.col("b.recipient_name").alias("display_name"), F.col("b.recipient_id").alias("dominant_id"), "uei_count", money(F.col("t"), "total_obligation"), X.recode(F.col("w"), {1: "high", 2: "medium"}, "low").alias("worst_confidence"))


@query("M02_dim_geography", with_sql("tx pl", "SELECT pop_state, pop_district, count(*) AS transaction_count, CAST(sum(obligation) AS DOUBLE) AS total_obligation FROM tx JOIN pl USING (customer_id) WHERE pop_state <> '' GROUP BY 1, 2"))
def m02(spark, sf):
    return Lake(spark, sf).located().filter("pop_state <> ''").groupBy("pop_state", "pop_district").agg(n_rows().alias("transaction_count"), money(F.sum("obligation"), "total_obligation"))


@query("M03_dim_lobbyists", """WITH c AS (SELECT c_custkey AS name, o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS pos FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT name, pos, count(*) AS n FROM c GROUP BY 1, 2), b AS (SELECT name, pos, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN pos = '' THEN 1 ELSE 0 END, n DESC, pos) AS r FROM p)
SELECT c.name, b.pos AS covered_position, count(DISTINCT o_orderkey) AS filings_count, bool_or(c.pos <> '') AS revolving_door FROM c JOIN b ON c.name = b.name AND r = 1 GROUP BY 1, 2""")
def m03(spark, sf):
    lake = Lake(spark, sf)
    c = lake.orders.join(lake.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("name"), "o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("pos"))
    p = c.groupBy("name", "pos").agg(F.countDistinct("o_orderkey").alias("n"))
    best = F.min(F.struct(F.when(F.col("pos") == "", 1).otherwise(0), -F.col("n"), "pos")).getField("pos")
    return p.groupBy("name").agg(best.alias("covered_position"), F.sum("n").alias("filings_count"), F.bool_or(F.col("pos") != "").alias("revolving_door"))


@query("M04_dim_pe_titles", with_sql("ln", "SELECT pe_bli, title FROM (SELECT pe_bli, title, row_number() OVER (PARTITION BY pe_bli ORDER BY count(*) DESC, title) AS n FROM ln WHERE edition_year = 2026 AND title IS NOT NULL GROUP BY 1, 2) WHERE n = 1"))
def m04(spark, sf):
    return titles(Lake(spark, sf))


def titles(lake):
    counts = lake.lines().filter("edition_year = 2026 AND title IS NOT NULL").groupBy("pe_bli", "title").count()
    return windows.pick_first(counts, ["pe_bli"], [F.col("count").desc(), F.col("title").asc_nulls_last()]).select("pe_bli", "title")


_PROGRAMS_SQL = """, det AS (SELECT pe_bli, organization, account, title, amount_thousands, bool_and(exhibit <> 'P-1R') AS rec FROM ln WHERE exhibit = 'R-1' GROUP BY 1, 2, 3, 4, 5),
agg AS (SELECT pe_bli, organization, count(DISTINCT title) AS project_count, sum(amount_thousands) AS amount, bool_and(rec) AS fully_reconciled, CASE WHEN count(DISTINCT account) = 1 THEN min(account) END AS account FROM det GROUP BY 1, 2),
col AS (SELECT pe_bli FROM ln GROUP BY 1 HAVING count(DISTINCT account) > 1), syn AS (SELECT DISTINCT ln.pe_bli, ln.organization, ln.account FROM ln JOIN col USING (pe_bli) WHERE exhibit = 'P-1' AND NOT EXISTS (SELECT 1 FROM det d WHERE d.pe_bli = ln.pe_bli AND d.account = ln.account)),
ttl AS (SELECT pe_bli, title FROM (SELECT pe_bli, title, row_number() OVER (PARTITION BY pe_bli ORDER BY count(*) DESC, title) AS n FROM ln WHERE edition_year = 2026 GROUP BY 1, 2) WHERE n = 1),
prog AS (SELECT * FROM agg UNION ALL SELECT pe_bli, organization, 0, 0, TRUE, account FROM syn)"""


@query("M05_dim_programs", with_sql("ln", _PROGRAMS_SQL + " SELECT prog.pe_bli, organization, project_count, CAST(amount AS DOUBLE) AS amount, fully_reconciled, account, ttl.title FROM prog LEFT JOIN ttl USING (pe_bli)"))
def m05(spark, sf):
    return programs(Lake(spark, sf)).withColumn("amount", F.col("amount").cast("double"))


def programs(lake):
    """Program rows: each detail once, then members that only budget lines name."""
    ln = lake.lines()
    det = ln.filter("exhibit = 'R-1'").groupBy("pe_bli", "organization", "account", "title", "amount_thousands").agg(F.bool_and(F.col("exhibit") != "P-1R").alias("rec"))
    a = det.groupBy("pe_bli", "organization").agg(
        F.countDistinct("title").alias("project_count"),
        F.sum("amount_thousands").cast("decimal(38,2)").alias("amount"),
        F.bool_and("rec").alias("fully_reconciled"),
        F.when(F.countDistinct("account") == 1, F.min("account")).alias("account"),
    )
    shared = aggs.collisions(ln, ["pe_bli"], "account").select("pe_bli")
    only = ln.filter("exhibit = 'P-1'").join(shared, "pe_bli", "left_semi").join(det, ["pe_bli", "account"], "left_anti").select("pe_bli", "organization", "account").distinct()
    made = only.select("pe_bli", "organization", F.lit(0).cast("long").alias("project_count"), F.lit(0).cast("decimal(38,2)").alias("amount"), F.lit(True).alias("fully_reconciled"), "account")
    return a.unionByName(made).join(titles(lake), "pe_bli", "left")


@query("M06_dim_recipients", with_sql("tx xw", "SELECT recipient_id, recipient_name, parent_name, CAST(sum(obligation) AS DOUBLE) AS total_obligation, count(*) AS transaction_count, min(fiscal_year) AS first_fiscal_year, max(fiscal_year) AS last_fiscal_year FROM tx JOIN xw USING (recipient_id) GROUP BY 1, 2, 3"))
def m06(spark, sf):
    lake = Lake(spark, sf)
    t = lake.transactions(with_order=False).groupBy("recipient_id").agg(money(F.sum("obligation"), "total_obligation"), n_rows().alias("transaction_count"), F.min("fiscal_year").alias("first_fiscal_year"), F.max("fiscal_year").alias("last_fiscal_year"))
    return t.join(lake.recipients().select("recipient_id", "recipient_name", "parent_name"), "recipient_id")


@query("M07_entity_xwalk", with_sql("tx xw", XWALK_SQL + " SELECT recipient_id, recipient_name, family_key, parent_name, confidence, CAST(total_obligation AS DOUBLE) AS total_obligation FROM xk"))
def m07(spark, sf):
    return crosswalk(Lake(spark, sf)).select("recipient_id", "recipient_name", "family_key", "parent_name", "confidence", money(F.col("total_obligation"), "total_obligation"))


@query("M08_agency_concentration", with_sql("tx xw", ", tf AS (SELECT sub_agency, coalesce(family_key, CAST(recipient_id AS VARCHAR)) AS family, obligation FROM tx LEFT JOIN xw USING (recipient_id)), h AS (" + HHI_SQL.format(g="sub_agency", e="family", a="obligation", t="tf") + ") SELECT *, CASE WHEN floor(hhi + 0.5) > 1800 THEN 'concentrated' WHEN floor(hhi + 0.5) >= 1000 THEN 'moderate' ELSE 'unconcentrated' END AS band FROM h"))
def m08(spark, sf):
    t = Lake(spark, sf).family_transactions().withColumn("family", F.coalesce("family_key", F.col("recipient_id").cast("string")))
    return aggs.hhi(t, ["sub_agency"], "family", "obligation").withColumn("total", F.col("total").cast("double")).withColumn("band", X.hhi_band(F.col("hhi")))


@query("M09_award_transactions", with_sql("tx", "SELECT award_type, transaction_key, part_id, fiscal_year, CAST(obligation AS DOUBLE) AS obligation FROM tx WHERE award_type = 'contract' UNION ALL SELECT award_type, transaction_key, part_id, fiscal_year, CAST(obligation AS DOUBLE) FROM tx WHERE award_type = 'assistance'"))
def m09(spark, sf):
    # Both archives lie in one table here: the union of its two filters is the scan itself.
    return Lake(spark, sf).transactions(with_order=False).filter(F.col("award_type").isin("contract", "assistance")).select("award_type", "transaction_key", "part_id", "fiscal_year", money(F.col("obligation"), "obligation"))


# Editions -------------------------------------------------------------------------

_SERIES_SQL = f""", {CANDIDATES_SQL}, colk AS (SELECT pe_bli, amount_type FROM ln WHERE edition_year >= 2026 AND title IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT account) > 1),
keyed AS (SELECT ln.pe_bli, CASE WHEN colk.pe_bli IS NOT NULL THEN account END AS account, ln.edition_year, ln.amount_type, amount_thousands, line_id FROM ln LEFT JOIN colk ON ln.pe_bli = colk.pe_bli AND ln.amount_type = colk.amount_type WHERE exhibit IN ('R-1', 'P-1')),
sums AS (SELECT k.pe_bli, k.account, k.edition_year, c.scenario, c.priority, c.fy, k.amount_type, sum(amount_thousands) AS amount, count(*) AS n_source_rows, CASE WHEN count(*) = 1 THEN min(line_id) END AS source_id
  FROM keyed k JOIN cand c ON k.edition_year = c.edition_year AND k.amount_type = c.amount_type GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pe_bli, account, edition_year, scenario ORDER BY priority) AS r FROM sums) WHERE r = 1),
alls AS (SELECT pe_bli, edition_year, amount_type, sum(amount_thousands) AS s FROM ln WHERE exhibit <> 'P-1R' GROUP BY 1, 2, 3), series AS (SELECT b.* EXCLUDE (r) FROM best b WHERE b.account IS NOT NULL OR EXISTS
  (SELECT 1 FROM alls a WHERE a.pe_bli = b.pe_bli AND a.edition_year = b.edition_year AND a.amount_type = b.amount_type AND abs(a.s - b.amount) <= 0.5))"""


def decade_series(lake):
    """(code, account, edition, scenario): the best candidate's sum, kept where an
    independent sum agrees."""
    ln = lake.lines()
    shared = aggs.collisions(ln.filter("edition_year >= 2026 AND title IS NOT NULL"), ["pe_bli", "amount_type"], "account").select("pe_bli", "amount_type", F.lit(True).alias("shared"))
    keyed = ln.filter(F.col("exhibit").isin("R-1", "P-1")).join(shared, ["pe_bli", "amount_type"], "left").withColumn("account", F.when(F.col("shared"), F.col("account")))
    sums = keyed.join(F.broadcast(candidates(lake)), ["edition_year", "amount_type"]).groupBy("pe_bli", "account", "edition_year", "scenario", "priority", "fy", "amount_type")
    sums = sums.agg(F.sum("amount_thousands").alias("amount"), n_rows().alias("n_source_rows"), aggs.single_source(F.col("line_id")).alias("source_id"))
    best = windows.pick_first(sums, ["pe_bli", "account", "edition_year", "scenario"], [F.col("priority")])
    check = ln.filter("exhibit <> 'P-1R'").groupBy("pe_bli", "edition_year", "amount_type").agg(F.sum("amount_thousands").alias("s"))
    agrees = best.join(check, ["pe_bli", "edition_year", "amount_type"]).filter(F.col("account").isNotNull() | (F.abs(F.col("s") - F.col("amount")) <= 0.5))
    return agrees.drop("s")


@query("M14_decade_series", with_sql("ln", _SERIES_SQL + " SELECT pe_bli, account, edition_year, scenario, priority, fy, amount_type, CAST(amount AS DOUBLE) AS amount, n_source_rows, source_id FROM series"))
def m14(spark, sf):
    return decade_series(Lake(spark, sf)).withColumn("amount", F.col("amount").cast("double")).withColumn("priority", F.col("priority").cast("int"))


_DIFF_SQL = """ SELECT a.pe_bli, a.account, a.edition_year AS from_edition, b.edition_year AS to_edition, CASE WHEN b.scenario = 'BudgetYearOne' THEN 'request_to_request' ELSE 'request_to_actuals' END AS diff_kind, CAST(a.amount AS DOUBLE) AS from_value, CAST(b.amount AS DOUBLE) AS to_value, CAST(b.amount - a.amount AS DOUBLE) AS delta
FROM series a JOIN series b ON a.pe_bli = b.pe_bli AND a.account IS NOT DISTINCT FROM b.account AND a.scenario = 'BudgetYearOne' AND ((b.scenario = 'BudgetYearOne' AND b.edition_year = a.edition_year + 1) OR (b.scenario = 'PriorYear' AND b.edition_year = a.edition_year + 2 AND a.fy = b.fy))"""


@query("M10_book_diff", with_sql("ln", _SERIES_SQL + _DIFF_SQL))
def m10(spark, sf):
    s = decade_series(Lake(spark, sf))
    asked = s.filter("scenario = 'BudgetYearOne'").select("pe_bli", "account", F.col("edition_year").alias("from_edition"), "fy", F.col("amount").alias("x"))
    to = s.select("pe_bli", "account", F.col("edition_year").alias("to_edition"), "scenario", F.col("fy").alias("to_fy"), F.col("amount").alias("y"))
    steps = to.filter("scenario = 'BudgetYearOne'").withColumn("from_edition", F.col("to_edition") - 1), to.filter("scenario = 'PriorYear'").withColumn("from_edition", F.col("to_edition") - 2)
    a = joins.null_safe(asked, steps[0], ["pe_bli", "account", "from_edition"]).withColumn("diff_kind", F.lit("request_to_request"))
    b = joins.null_safe(asked, steps[1], ["pe_bli", "account", "from_edition"]).filter("fy = to_fy").withColumn("diff_kind", F.lit("request_to_actuals"))
    return a.unionByName(b).select("pe_bli", "account", "from_edition", "to_edition", "diff_kind", money(F.col("x"), "from_value"), money(F.col("y"), "to_value"), money(F.col("y") - F.col("x"), "delta"))


@query("M11_budget_lines", with_sql("ln", "SELECT * REPLACE (CAST(amount_thousands AS DOUBLE) AS amount_thousands) FROM ln"))
def m11(spark, sf):
    return Lake(spark, sf).lines().withColumn("amount_thousands", F.col("amount_thousands").cast("double"))


@query("M12_budget_to_awards", with_sql("lk ln", ", t AS (SELECT pe_bli, title FROM (SELECT pe_bli, title, row_number() OVER (PARTITION BY pe_bli ORDER BY count(*) DESC, title) AS n FROM ln WHERE edition_year = 2026 GROUP BY 1, 2) WHERE n = 1), g AS (SELECT pe_bli, min(title) AS title FROM ln GROUP BY 1) SELECT lk.pe_bli, award_id, confidence, coalesce(t.title, g.title) AS program_title FROM lk LEFT JOIN t ON lk.pe_bli = t.pe_bli LEFT JOIN g ON lk.pe_bli = g.pe_bli WHERE confidence IN ('high', 'medium')"))
def m12(spark, sf):
    lake = Lake(spark, sf)
    named = joins.fallback_join(published(lake), titles(lake), lake.lines().groupBy("pe_bli").agg(F.min("title").alias("title")), ["pe_bli"], ["pe_bli"], "title")
    return named.withColumnRenamed("title", "program_title")


def published(lake):
    return lake.links().filter(F.col("confidence").isin("high", "medium"))


_TRAJ_SQL = """, pick AS (SELECT pe_bli, organization, account FROM (SELECT pe_bli, organization, account, row_number() OVER (PARTITION BY pe_bli, organization ORDER BY (max(edition_year) = 2026) DESC, sum(amount_thousands) DESC, account) AS n FROM ln WHERE title IS NOT NULL GROUP BY 1, 2, 3) WHERE n = 1),
colt AS (SELECT pe_bli FROM ln WHERE amount_type = 'fy_2025_request' GROUP BY 1 HAVING count(DISTINCT account) > 1),
src AS (SELECT ln.pe_bli, ln.organization, CASE WHEN colt.pe_bli IS NOT NULL THEN ln.account ELSE pick.account END AS account, amount_type, amount_thousands FROM ln LEFT JOIN colt ON ln.pe_bli = colt.pe_bli JOIN pick ON ln.pe_bli = pick.pe_bli AND ln.organization = pick.organization),
traj AS (SELECT pe_bli, organization, account, sum(amount_thousands) FILTER (WHERE amount_type = 'fy_2023_actuals') AS actuals, sum(amount_thousands) FILTER (WHERE amount_type = 'fy_2024_total') AS total, sum(amount_thousands) FILTER (WHERE amount_type = 'fy_2025_request') AS request FROM src GROUP BY 1, 2, 3)"""


def trajectory(lake):
    """(code, org, account): three years side by side, colliding accounts kept apart."""
    ln = lake.lines().filter("title IS NOT NULL")
    by = ln.groupBy("pe_bli", "organization", "account").agg((F.max("edition_year") == 2026).alias("current"), F.sum("amount_thousands").alias("s"))
    pick = windows.pick_first(by, ["pe_bli", "organization"], [F.col("current").desc(), F.col("s").desc_nulls_last(), F.col("account").asc_nulls_last()]).select("pe_bli", "organization", F.col("account").alias("stable"))
    shared = aggs.collisions(ln.filter("amount_type = 'fy_2025_request'"), ["pe_bli"], "account").select("pe_bli", F.lit(True).alias("shared"))
    src = ln.join(shared, "pe_bli", "left").join(pick, ["pe_bli", "organization"]).withColumn("account", F.when(F.col("shared"), F.col("account")).otherwise(F.col("stable")))
    wide = src.groupBy("pe_bli", "organization", "account").pivot("amount_type", ["fy_2023_actuals", "fy_2024_total", "fy_2025_request"]).agg(F.sum("amount_thousands"))
    return wide.toDF("pe_bli", "organization", "account", "actuals", "total", "request")


_TRAJ_OUT = "CAST(actuals AS DOUBLE) AS actuals, CAST(total AS DOUBLE) AS total, CAST(request AS DOUBLE) AS request, CAST(request - total AS DOUBLE) AS change, CASE WHEN total <> 0 THEN round(CAST((request - total) * 100 AS DOUBLE) / CAST(total AS DOUBLE), 2) END AS pct_change"


def with_change(df):
    pct = X.pct_change(F.col("total").cast("double"), F.col("request").cast("double"))
    return df.withColumn("change", (F.col("request") - F.col("total")).cast("double")).withColumn("pct_change", pct).withColumns({c: F.col(c).cast("double") for c in ("actuals", "total", "request")})


@query("M13_budget_trajectory", with_sql("ln", _TRAJ_SQL + f" SELECT pe_bli, organization, account, {_TRAJ_OUT} FROM traj"))
def m13(spark, sf):
    return with_change(trajectory(Lake(spark, sf)))


@query("M25_program_trajectory", with_sql("ln", _TRAJ_SQL + f", p AS (SELECT pe_bli, account, count(*) AS n_org_components, sum(actuals) AS actuals, sum(total) AS total, sum(request) AS request FROM traj GROUP BY 1, 2) SELECT pe_bli, account, n_org_components, {_TRAJ_OUT} FROM p"))
def m25(spark, sf):
    p = trajectory(Lake(spark, sf)).groupBy("pe_bli", "account").agg(n_rows().alias("n_org_components"), *[F.sum(c).alias(c) for c in ("actuals", "total", "request")])
    return with_change(p)


_ERA_SQL = f""", {RANGE_SQL}, era AS (SELECT ln.edition_year, ln.account, ln.organization, concat(ln.account, '-', ln.organization, '-L', ln.line_id) AS era_key, ln.line_id, ln.pe_bli, min(rule_id) AS decision_id FROM ln LEFT JOIN rules r ON ln.account = r.account AND ln.edition_year BETWEEN first_edition AND last_edition AND (r.organization IS NULL OR r.organization = ln.organization) GROUP BY ALL)"""


def era_map(lake):
    """Every line with the first ranged decision that binds it."""
    ln = lake.lines()
    bound = joins.range_join(ln, F.broadcast(range_rules(lake.spark)), ["account"], "edition_year", "first_edition", "last_edition", ["organization"]).groupBy("line_id").agg(F.min("rule_id").alias("decision_id"))
    return ln.join(bound, "line_id", "left").select("edition_year", "account", "organization", X.mint_key(F.col("account"), F.col("organization"), F.col("line_id")).alias("era_key"), "line_id", "pe_bli", "decision_id")


@query("M30_era_line_map", with_sql("ln", _ERA_SQL + ", dg AS (SELECT decision_id, sha256(string_agg(era_key, chr(10) ORDER BY era_key)) AS sha FROM era WHERE decision_id IS NOT NULL GROUP BY 1) SELECT era.*, sha AS keys_sha FROM era LEFT JOIN dg USING (decision_id)"))
def m30(spark, sf):
    m = era_map(Lake(spark, sf))
    digests = aggs.lines_digest(m.filter("decision_id IS NOT NULL"), ["decision_id"], F.col("era_key"), "keys_sha")
    return m.join(F.broadcast(digests), "decision_id", "left")  # one row a rule


@query("M23_program_decade_series", with_sql("ln", _ERA_SQL + """ SELECT coalesce('D' || decision_id, ln.pe_bli) AS program_key, ln.edition_year, ln.amount_type, CASE WHEN decision_id IS NULL THEN 'native' ELSE 'mapped' END AS map_basis, CAST(sum(amount_thousands) AS DOUBLE) AS amount, string_agg(DISTINCT ln.pe_bli, ',' ORDER BY ln.pe_bli) AS source_keys
FROM ln JOIN era USING (line_id) WHERE exhibit <> 'P-1R' GROUP BY 1, 2, 3, 4"""))
def m23(spark, sf):
    lake = Lake(spark, sf)
    m = lake.lines().filter("exhibit <> 'P-1R'").join(era_map(lake).select("line_id", "decision_id"), "line_id")
    key = F.coalesce(F.concat(F.lit("D"), F.col("decision_id").cast("string")), F.col("pe_bli"))
    basis = F.when(F.col("decision_id").isNull(), "native").otherwise("mapped")
    return m.groupBy(key.alias("program_key"), "edition_year", "amount_type", basis.alias("map_basis")).agg(money(F.sum("amount_thousands"), "amount"), aggs.ordered_join(F.col("pe_bli")).alias("source_keys"))


# Places ----------------------------------------------------------------------------

_PLACE_OUT = "count(DISTINCT transaction_key) AS transaction_count, count(DISTINCT award_id) AS award_count, count(DISTINCT recipient_id) AS recipient_count, CAST(sum(obligation) AS DOUBLE) AS total_obligation"
_PUB = ", pub AS (SELECT DISTINCT pe_bli, award_id FROM lk WHERE confidence IN ('high', 'medium'))"


def linked(lake):
    """Located transactions with each published (code, award) pair once."""
    bridge = published(lake).select("pe_bli", "award_id").distinct()
    return lake.located().join(bridge, "award_id")


def _place(df, by, *sums):
    """Counts and sums of places. A transaction belongs to one award, so transactions are
    counted inside awards and awards by their rows; recipients are counted apart. No row is
    expanded, and no task needs a whole place before its rows are added up."""
    inner = df.groupBy(*by, "award_id").agg(F.countDistinct("transaction_key").alias("n"), *sums)
    names = [c for c in inner.columns if c not in (*by, "award_id", "n")]
    awards = inner.groupBy(*by).agg(F.sum("n").alias("transaction_count"), F.count("award_id").alias("award_count"), *[money(F.sum(c), c) for c in names])
    recipients = df.select(*by, "recipient_id").distinct().groupBy(*by).agg(F.count("recipient_id").alias("recipient_count"))
    return joins.null_safe(awards, recipients, by)


@query("M15_district_programs", with_sql("tx pl lk", _PUB + f" SELECT pop_state, pop_district, pe_bli, {_PLACE_OUT} FROM tx JOIN pl USING (customer_id) JOIN pub USING (award_id) GROUP BY 1, 2, 3"))
def m15(spark, sf):
    return _place(linked(Lake(spark, sf)), ["pop_state", "pop_district", "pe_bli"], F.sum("obligation").alias("total_obligation"))


@query("M15_district_programs_by_year", with_sql("tx pl lk", _PUB + f" SELECT pop_state, pop_district, pe_bli, fiscal_year, {_PLACE_OUT}, CAST(sum(greatest(coalesce(obligation, 0), 0)) AS DOUBLE) AS positive_obligation FROM tx JOIN pl USING (customer_id) JOIN pub USING (award_id) GROUP BY 1, 2, 3, 4"))
def m15_year(spark, sf):
    positive = F.sum(X.positive_part(F.col("obligation"))).alias("positive_obligation")
    return _place(linked(Lake(spark, sf)), ["pop_state", "pop_district", "pe_bli", "fiscal_year"], F.sum("obligation").alias("total_obligation"), positive)


@query("M16_district_totals", with_sql("tx pl lk", _PUB + " SELECT pop_state, pop_district, count(DISTINCT award_id) AS award_count, CAST(sum(obligation) AS DOUBLE) AS total_obligation FROM tx JOIN pl USING (customer_id) WHERE award_id IN (SELECT award_id FROM pub) GROUP BY 1, 2"))
def m16(spark, sf):
    lake = Lake(spark, sf)
    return joins.bridge_join(lake.located(), published(lake), ["award_id"]).groupBy("pop_state", "pop_district").agg(F.countDistinct("award_id").alias("award_count"), money(F.sum("obligation"), "total_obligation"))


@query("M16_district_totals_by_year", with_sql("tx pl lk", _PUB + " SELECT pop_state, pop_district, fiscal_year, count(DISTINCT award_id) AS award_count, CAST(sum(obligation) AS DOUBLE) AS total_obligation, CAST(sum(greatest(obligation, 0)) AS DOUBLE) AS positive_obligation FROM tx JOIN pl USING (customer_id) WHERE award_id IN (SELECT award_id FROM pub) GROUP BY 1, 2, 3"))
def m16_year(spark, sf):
    lake = Lake(spark, sf)
    kept = joins.bridge_join(lake.located(), published(lake), ["award_id"])
    return kept.groupBy("pop_state", "pop_district", "fiscal_year").agg(F.countDistinct("award_id").alias("award_count"), money(F.sum("obligation"), "total_obligation"), money(F.sum(X.positive_part(F.col("obligation"))), "positive_obligation"))


@query("M17_flow_edges", with_sql("tx xw pl", f""", f AS (SELECT fiscal_year, pop_state AS state, sub_agency AS agency, family_key AS family, {CLASS_SQL} AS competed_class, {OFFERS_SQL.replace('q AS', 'CAST(quantity AS VARCHAR) AS').replace('try_cast(q ', 'try_cast(CAST(CAST(quantity AS INTEGER) AS VARCHAR) ')} AS offers, obligation FROM tx JOIN pl USING (customer_id) JOIN xw USING (recipient_id))
SELECT fiscal_year, CASE WHEN grouping(family) = 0 THEN 'agency>family' WHEN grouping(competed_class) = 0 THEN 'class>offers' ELSE 'state>agency' END AS level, state, agency, family, competed_class, offers, CAST(sum(obligation) AS DOUBLE) AS amount, count(*) AS line_count
FROM f GROUP BY GROUPING SETS ((fiscal_year, state, agency), (fiscal_year, agency, family), (fiscal_year, competed_class, offers))"""))
def m17(spark, sf):
    lake = Lake(spark, sf)
    f = lake.located().join(lake.recipients(), "recipient_id").select(
        "fiscal_year", F.col("pop_state").alias("state"), F.col("sub_agency").alias("agency"), F.col("family_key").alias("family"),
        competed_class(F.col("sub_agency")).alias("competed_class"), X.bucketize(F.col("quantity").cast("int").cast("string"), OFFERS, "10+").alias("offers"), "obligation",
    )
    sets = [("fiscal_year", "state", "agency"), ("fiscal_year", "agency", "family"), ("fiscal_year", "competed_class", "offers")]
    cols = ["fiscal_year", "state", "agency", "family", "competed_class", "offers"]
    grouped = f.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols])
    level = F.when(F.grouping("family") == 0, "agency>family").when(F.grouping("competed_class") == 0, "class>offers").otherwise("state>agency")
    return grouped.agg(level.alias("level"), money(F.sum("obligation"), "amount"), n_rows().alias("line_count")).select("level", *cols, "amount", "line_count")


@query("M18_family_obligations_by_year", with_sql("tx xw", "SELECT family_key, fiscal_year, CAST(sum(obligation) AS DOUBLE) AS total_obligation, count(*) AS transaction_count, count(DISTINCT recipient_id) AS uei_count FROM tx JOIN xw USING (recipient_id) GROUP BY 1, 2"))
def m18(spark, sf):
    return Lake(spark, sf).family_transactions(with_order=False).filter("family_key IS NOT NULL").groupBy("family_key", "fiscal_year").agg(money(F.sum("obligation"), "total_obligation"), n_rows().alias("transaction_count"), F.countDistinct("recipient_id").alias("uei_count"))


_EVENT_COLS = ["event_type", "key", "headline_value", "comparison_value", "pct_change", "fiscal_year", "units"]


@query("M19_feed_events", with_sql("ln tx xw", _TRAJ_SQL + """, yoy AS (SELECT 'yoy_swing' AS event_type, concat(pe_bli, '|', organization, '|', coalesce(account, '')) AS key, CAST(request AS DOUBLE) AS headline_value, CAST(total AS DOUBLE) AS comparison_value, round(CAST((request - total) * 100 AS DOUBLE) / CAST(nullif(total, 0) AS DOUBLE), 2) AS pct_change, 2025 AS fiscal_year, 'thousands_usd' AS units FROM traj WHERE total >= 1000 AND request IS NOT NULL AND abs((request - total) * 100 / nullif(total, 0)) >= 50),
zero AS (SELECT 'zeroed', concat(pe_bli, '|', organization, '|', coalesce(account, '')), CAST(total AS DOUBLE), 0.0, CAST(NULL AS DOUBLE), 2025, 'thousands_usd' FROM traj WHERE total > 0 AND request = 0),
e AS (SELECT sub_agency, fiscal_year, recipient_id, CAST(sum(greatest(obligation, 0)) AS DOUBLE) AS p FROM tx GROUP BY 1, 2, 3), s AS (SELECT *, 100 * p / sum(p) OVER (PARTITION BY sub_agency, fiscal_year) AS share FROM e WHERE p > 0),
h AS (SELECT sub_agency, fiscal_year, sum(share * share) AS hhi, sum(p) AS dollars FROM s GROUP BY 1, 2 HAVING sum(p) >= 5000), con AS (SELECT 'concentration_shift', b.sub_agency, b.hhi, a.hhi, round((b.hhi - a.hhi) * 100 / a.hhi, 2), b.fiscal_year, 'hhi' FROM h a JOIN h b ON a.sub_agency = b.sub_agency AND b.fiscal_year = a.fiscal_year + 1),
ne AS (SELECT 'new_entrant', family_key, CAST(sum(obligation) AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), min(fiscal_year), 'usd' FROM tx JOIN xw USING (recipient_id) GROUP BY family_key HAVING min(fiscal_year) >= 1995 AND sum(obligation) >= 1000 ORDER BY min(fiscal_year) DESC, sum(obligation) DESC, family_key LIMIT 25)
SELECT * FROM yoy UNION ALL SELECT * FROM zero UNION ALL SELECT * FROM con UNION ALL SELECT * FROM ne"""))
def m19(spark, sf):
    lake = Lake(spark, sf)
    t = trajectory(lake).withColumn("key", F.concat_ws("|", "pe_bli", "organization", F.coalesce("account", F.lit(""))))
    pct = X.pct_change(F.col("total").cast("double"), F.col("request").cast("double"))
    none = F.lit(None).cast("double")

    def event(df, kind, key, head, comp, change, year, units):
        return df.select(F.lit(kind).alias("event_type"), key.alias("key"), head.cast("double").alias("headline_value"), comp.cast("double").alias("comparison_value"), change.alias("pct_change"), year.cast("int").alias("fiscal_year"), F.lit(units).alias("units"))

    swing = t.filter("total >= 1000 AND request IS NOT NULL").filter(F.abs((F.col("request") - F.col("total")) * 100 / F.col("total")) >= 50)
    yoy = event(swing, "yoy_swing", F.col("key"), F.col("request"), F.col("total"), pct, F.lit(2025), "thousands_usd")
    zero = event(t.filter("total > 0 AND request = 0"), "zeroed", F.col("key"), F.col("total"), F.lit(0), none, F.lit(2025), "thousands_usd")
    e = lake.transactions().groupBy("sub_agency", "fiscal_year", "recipient_id").agg(F.sum(X.positive_part(F.col("obligation"))).cast("double").alias("p")).filter("p > 0")
    s = e.withColumn("share", windows.share_of_total("p", ["sub_agency", "fiscal_year"]))
    h = s.groupBy("sub_agency", "fiscal_year").agg(F.sum(F.col("share") * F.col("share")).alias("hhi"), F.sum("p").alias("dollars")).filter("dollars >= 5000").drop("dollars")
    before = h.select("sub_agency", (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col("hhi").alias("was"))
    con = event(h.join(before, ["sub_agency", "fiscal_year"]), "concentration_shift", F.col("sub_agency"), F.col("hhi"), F.col("was"), F.round((F.col("hhi") - F.col("was")) * 100 / F.col("was"), 2), F.col("fiscal_year"), "hhi")
    new = lake.family_transactions(with_order=False).groupBy("family_key").agg(F.min("fiscal_year").alias("y"), F.sum("obligation").alias("s")).filter("y >= 1995 AND s >= 1000 AND family_key IS NOT NULL")
    new = new.orderBy(F.col("y").desc(), F.col("s").desc(), "family_key").limit(25)
    return yoy.unionByName(zero).unionByName(con).unionByName(event(new, "new_entrant", F.col("family_key"), F.col("s"), none, none, F.col("y"), "usd"))


@query("M20_improper_exposure", """WITH p AS (SELECT l_suppkey AS program, l_returnflag AS agency, year(l_shipdate) AS y, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(38,4)) AS improper, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS outlays FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT *, max(y) OVER (PARTITION BY program, agency) AS last FROM p) SELECT agency, count(DISTINCT program) AS program_count, CAST(sum(improper) AS DOUBLE) AS improper_usd, CASE WHEN sum(outlays) <> 0 THEN round(CAST(sum(improper) AS DOUBLE) / CAST(sum(outlays) AS DOUBLE) * 100, 4) END AS weighted_rate_pct, CAST(max(y) AS INTEGER) AS latest_fiscal_year FROM m WHERE y = last GROUP BY 1""")
def m20(spark, sf):
    price, rate = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
    p = Lake(spark, sf).lineitem.groupBy(F.col("l_suppkey").alias("program"), F.col("l_returnflag").alias("agency"), F.year("l_shipdate").alias("y")).agg(F.sum(price * rate).alias("improper"), F.sum(price).alias("outlays"))
    latest = windows.tied_top(p, ["program", "agency"], [F.col("y").desc()])
    w = F.when(F.sum("outlays") != 0, F.round(F.sum("improper").cast("double") / F.sum("outlays").cast("double") * 100, 4))
    return latest.groupBy("agency").agg(F.countDistinct("program").alias("program_count"), money(F.sum("improper"), "improper_usd"), w.alias("weighted_rate_pct"), F.max("y").alias("latest_fiscal_year"))


# Filings ------------------------------------------------------------------------------

_RESOLVED_SQL = """, f AS (SELECT *, filing_type IN ('RR', 'RA') AS is_registration, filing_type = '1A' AS is_amendment, coalesce(try_cast(nullif(trim(income_usd), '') AS DOUBLE), 0) AS reported FROM fl),
q AS (SELECT registrant, filing_year, filing_period, count(*) FILTER (WHERE is_amendment) AS amendments, count(DISTINCT income_usd) FILTER (WHERE is_amendment) AS figures FROM f WHERE NOT is_registration GROUP BY ALL),
r AS (SELECT f.*, coalesce(q.amendments, 0) AS amendments, q.figures, row_number() OVER w AS k, first_value(f.filing_id) OVER w AS first_id FROM f LEFT JOIN q ON NOT f.is_registration AND f.registrant = q.registrant AND f.filing_year = q.filing_year AND f.filing_period = q.filing_period
  WINDOW w AS (PARTITION BY f.registrant, f.filing_year, f.filing_period, f.is_registration ORDER BY f.is_amendment DESC, f.reported, f.filing_id)),
res AS (SELECT *, CASE WHEN is_registration THEN 'registration' WHEN amendments = 0 THEN 'original' WHEN NOT is_amendment THEN 'superseded_by_amendment' WHEN k = 1 THEN 'amendment_counted' ELSE 'amendment_superseded' END AS resolution FROM r)"""


def resolved_filings(lake):
    """Amendment resolution; a quarter's counts ride on the same window's partition."""
    f = lake.filings().withColumns({
        "is_registration": F.col("filing_type").isin("RR", "RA"),
        "is_amendment": F.col("filing_type").rlike("^[1-4][A@]Y?$"),
        "reported": F.coalesce(X.try_double(X.blank_to_null(F.col("income_usd"))), F.lit(0.0)),
    })
    part = ["registrant", "filing_year", "filing_period", "is_registration"]
    figures = f.filter("NOT is_registration").groupBy(*part).agg(F.count_if("is_amendment").alias("amendments"), F.countDistinct(F.when(F.col("is_amendment"), F.col("income_usd"))).alias("figures"))
    w = Window.partitionBy(*part).orderBy(F.col("is_amendment").desc(), "reported", "filing_id")
    r = f.join(figures, part, "left").withColumn("amendments", F.coalesce("amendments", F.lit(0))).withColumn("k", F.row_number().over(w)).withColumn("first_id", F.first("filing_id").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rule = F.when(F.col("is_registration"), "registration").when(F.col("amendments") == 0, "original").when(~F.col("is_amendment"), "superseded_by_amendment").when(F.col("k") == 1, "amendment_counted").otherwise("amendment_superseded")
    return r.withColumn("resolution", rule)


@query("M33_audit_filings", with_sql("fl", _RESOLVED_SQL + " SELECT filing_id, resolution, resolution IN ('registration', 'original', 'amendment_counted') AS counted, CASE WHEN resolution IN ('superseded_by_amendment', 'amendment_superseded') THEN first_id END AS superseded_by, CASE WHEN resolution NOT IN ('registration', 'original') THEN figures = 1 END AS latest_determinable FROM res"))
def m33(spark, sf):
    r = resolved_filings(Lake(spark, sf))
    res = F.col("resolution")
    return r.select("filing_id", "resolution", res.isin("registration", "original", "amendment_counted").alias("counted"), F.when(res.isin("superseded_by_amendment", "amendment_superseded"), F.col("first_id")).alias("superseded_by"), F.when(~res.isin("registration", "original"), F.col("figures") == 1).alias("latest_determinable"))


@query("M21_influence", with_sql("fl tx", _RESOLVED_SQL + """, a AS (SELECT registrant % 100 AS family, filing_year, count(*) AS filings_count, sum(CAST(income_usd AS DECIMAL(20,2))) AS income FROM res WHERE resolution IN ('registration', 'original', 'amendment_counted') GROUP BY 1, 2), o AS (SELECT recipient_id, sum(obligation) AS s FROM tx GROUP BY 1)
SELECT family, filing_year, filings_count, CAST(income AS DOUBLE) AS lobbying_income_usd, CAST(s AS DOUBLE) AS family_obligations_usd FROM a LEFT JOIN o ON a.family = o.recipient_id"""))
def m21(spark, sf):
    lake = Lake(spark, sf)
    counted = resolved_filings(lake).filter(F.col("resolution").isin("registration", "original", "amendment_counted"))
    a = counted.groupBy((F.col("registrant") % 100).alias("family"), "filing_year").agg(n_rows().alias("filings_count"), money(F.sum(F.col("income_usd").try_cast("decimal(20,2)")), "lobbying_income_usd"))
    o = lake.transactions(with_order=False).groupBy(F.col("recipient_id").alias("family")).agg(money(F.sum("obligation"), "family_obligations_usd"))
    return a.join(o, "family", "left")


@query("M22_program_concentration", with_sql("tx xw lk", """, aw AS (SELECT award_id, coalesce(family_key, CAST(recipient_id AS VARCHAR)) AS family, sum(greatest(obligation, 0)) AS p FROM tx LEFT JOIN xw USING (recipient_id) GROUP BY 1, 2),
b AS (SELECT pe_bli, award_id, 'all' AS basis FROM lk WHERE confidence IN ('high', 'medium') UNION ALL SELECT pe_bli, award_id, 'high' FROM lk WHERE confidence = 'high'),
f AS (SELECT pe_bli, basis, family, CAST(sum(p) AS DOUBLE) AS p, count(DISTINCT award_id) AS awards FROM aw JOIN b USING (award_id) GROUP BY 1, 2, 3), n AS (SELECT pe_bli, basis, count(DISTINCT award_id) AS award_count FROM aw JOIN b USING (award_id) GROUP BY 1, 2)
SELECT pe_bli, basis, CASE WHEN sum(p) = 0 THEN 0 ELSE sum(p * p) * 10000 / (sum(p) * sum(p)) END AS hhi, arg_max(family, p) AS top_family, count(*) AS family_count, count(*) FILTER (WHERE p > 0) AS positive_family_count, award_count, sum(p) AS program_dollars FROM f JOIN n USING (pe_bli, basis) GROUP BY pe_bli, basis, award_count HAVING award_count >= 3 AND count(*) FILTER (WHERE p > 0) >= 2 AND sum(p) > 0"""))
def m22(spark, sf):
    lake = Lake(spark, sf)
    t = lake.family_transactions(with_order=False).withColumn("family", F.coalesce("family_key", F.col("recipient_id").cast("string")))
    award = t.groupBy("award_id", "family").agg(F.sum(X.positive_part(F.col("obligation"))).alias("p"))
    # An award of several families counts once, with the first of them.
    counts = F.row_number().over(Window.partitionBy("award_id").orderBy("family")) == 1
    award = award.withColumn("counted", counts.cast("long"))
    basis = F.explode(F.when(F.col("confidence") == "high", F.array(F.lit("all"), F.lit("high"))).otherwise(F.array(F.lit("all")))).alias("basis")
    j = award.join(published(lake).select("pe_bli", "award_id", basis), "award_id")
    f = j.groupBy("pe_bli", "basis", "family").agg(F.sum("p").cast("double").alias("p"), F.sum("counted").alias("counted"))
    g = f.groupBy("pe_bli", "basis").agg(
        (F.sum(F.col("p") * F.col("p")) * 10000 / F.nullif(F.sum("p") * F.sum("p"), F.lit(0.0))).alias("hhi"), F.max_by("family", "p").alias("top_family"),
        n_rows().alias("family_count"), F.count_if(F.col("p") > 0).alias("positive_family_count"), F.sum("p").alias("program_dollars"), F.sum("counted").alias("award_count"),
    )
    return g.filter("award_count >= 3 AND positive_family_count >= 2 AND program_dollars > 0")


@query("M24_program_lobbying", with_sql("fl ln", _RESOLVED_SQL + """, mt AS (SELECT f2.filing_id, concat('Brand#', f2.filing_id % 25) AS pe_bli FROM fl f2 UNION ALL SELECT filing_id, concat('Brand#', registrant % 25) FROM fl), one AS (SELECT DISTINCT filing_id, pe_bli FROM mt),
ti AS (SELECT pe_bli, string_agg(title, ' / ' ORDER BY r) AS program_title FROM (SELECT pe_bli, title, row_number() OVER (PARTITION BY pe_bli ORDER BY min(line_id)) AS r FROM ln GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1)
SELECT res.filing_id, one.pe_bli, program_title, filing_year FROM res JOIN one USING (filing_id) LEFT JOIN ti USING (pe_bli) WHERE resolution IN ('registration', 'original', 'amendment_counted')"""))
def m24(spark, sf):
    lake = Lake(spark, sf)
    f = resolved_filings(lake).filter(F.col("resolution").isin("registration", "original", "amendment_counted"))
    codes = F.array_distinct(F.array(F.concat(F.lit("Brand#"), (F.col("filing_id") % 25).cast("string")), F.concat(F.lit("Brand#"), (F.col("registrant") % 25).cast("string"))))
    mentions = f.select("filing_id", "filing_year", F.explode(codes).alias("pe_bli"))
    firsts = lake.lines().groupBy("pe_bli", "title").agg(F.min("line_id").alias("first"))
    ranked = firsts.withColumn("r", F.row_number().over(Window.partitionBy("pe_bli").orderBy("first"))).filter("r <= 3")
    t = ranked.groupBy("pe_bli").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]), " / ").alias("program_title"))
    return mentions.join(t, "pe_bli", "left").select("filing_id", "pe_bli", "program_title", "filing_year")


# States ---------------------------------------------------------------------------------

_STATE_SQL = """WITH b AS (SELECT n_name AS department, c_mktsegment AS category, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey {r} GROUP BY 1, 2, 3)"""


def checkbook(lake, regions):
    j = lake.orders.join(lake.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(lake.nation.filter(F.col("n_regionkey").isin(*regions))), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("department"), F.col("c_mktsegment").alias("category"), F.year("o_orderdate").alias("fiscal_year")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"))


@query("M26_state_budget", _STATE_SQL.format(r="= 0") + " SELECT department, category, fiscal_year, CAST(amount AS DOUBLE) AS amount_usd, CAST(sum(amount) OVER (PARTITION BY department, fiscal_year) AS DOUBLE) AS department_total FROM b")
def m26(spark, sf):
    w = Window.partitionBy("department", "fiscal_year")
    return checkbook(Lake(spark, sf), [0]).select("department", "category", "fiscal_year", money(F.col("amount"), "amount_usd"), money(F.sum("amount").over(w), "department_total"))


@query("M27_state_spend", _STATE_SQL.format(r="IN (0, 1)") + " SELECT CASE WHEN department IN (SELECT n_name FROM nation WHERE n_regionkey = 0) THEN 'CA' ELSE 'CT' END AS jurisdiction, department, category, fiscal_year, CAST(amount AS DOUBLE) AS amount_usd FROM b")
def m27(spark, sf):
    return state_spend(Lake(spark, sf)).withColumnRenamed("amount", "amount_usd").withColumn("amount_usd", F.col("amount_usd").cast("double"))


def state_spend(lake):
    return checkbook(lake, [0]).withColumn("jurisdiction", F.lit("CA")).unionByName(checkbook(lake, [1]).withColumn("jurisdiction", F.lit("CT")))


@query("M28_state_per_capita", _STATE_SQL.format(r="IN (0, 1)") + """, s AS (SELECT CASE WHEN department IN (SELECT n_name FROM nation WHERE n_regionkey = 0) THEN 'CA' ELSE 'CT' END AS jurisdiction, category, fiscal_year, sum(amount) AS amount FROM b WHERE category <> 'MACHINERY' GROUP BY 1, 2, 3),
p(jurisdiction, py, population) AS (VALUES ('CA', 1994, 1000), ('CA', 1998, 1250), ('CT', 1996, 400)), j AS (SELECT s.*, population, row_number() OVER (PARTITION BY s.jurisdiction, category, fiscal_year ORDER BY py DESC) AS n FROM s JOIN p ON s.jurisdiction = p.jurisdiction AND py <= fiscal_year)
SELECT jurisdiction, category, fiscal_year, CAST(amount AS DOUBLE) / population AS per_capita FROM j WHERE n = 1 QUALIFY count(*) OVER (PARTITION BY category, fiscal_year) = 2""")
def m28(spark, sf):
    s = state_spend(Lake(spark, sf)).filter("category <> 'MACHINERY'").groupBy("jurisdiction", "category", "fiscal_year").agg(F.sum("amount").cast("double").alias("amount"))
    people = spark.createDataFrame([("CA", 1994, 1000), ("CA", 1998, 1250), ("CT", 1996, 400)], "jurisdiction string, py int, population int")
    at = joins.asof_join(s, people, ["jurisdiction"], "fiscal_year", "py").filter("population IS NOT NULL")
    both = Window.partitionBy("category", "fiscal_year")
    return at.withColumn("k", F.count(F.lit(1)).over(both)).filter("k = 2").select("jurisdiction", "category", "fiscal_year", (F.col("amount") / F.col("population")).alias("per_capita"))


# Award keys and audits -----------------------------------------------------------------------


@query("M29_link_award_keys", with_sql("tx lk", """, slots AS (SELECT DISTINCT award_id, recipient_id FROM tx WHERE award_id IN (SELECT award_id FROM lk WHERE confidence IN ('high', 'medium'))), n AS (SELECT award_id, count(*) AS n_awards FROM slots GROUP BY 1)
SELECT award_id, recipient_id, n_awards, n_awards = 1 OR recipient_id = award_id % 100 AS named FROM slots JOIN n USING (award_id)"""))
def m29(spark, sf):
    lake = Lake(spark, sf)
    slots = lake.transactions(with_order=False).join(published(lake), "award_id", "left_semi").select("award_id", "recipient_id").distinct()
    return slots.withColumn("n_awards", F.count(F.lit(1)).over(Window.partitionBy("award_id"))).withColumn("named", (F.col("n_awards") == 1) | (F.col("recipient_id") == F.col("award_id") % 100))


_COPIES_SQL = """, k AS (SELECT award_type, transaction_key, count(*) AS copies, count(DISTINCT fiscal_year) AS fiscal_years, count(action_date) AS dated, count(DISTINCT action_date) AS dates FROM tx GROUP BY 1, 2 HAVING count(*) > 1),
c AS (SELECT tx.award_type, tx.transaction_key, tx.fiscal_year, action_date, part_id, copies, CASE WHEN copies <> 2 THEN 'more than two copies' WHEN fiscal_years <> 2 THEN 'both copies sit in one fiscal year' WHEN dated <> 2 THEN 'a copy has no date' WHEN dates <> 2 THEN 'both copies carry the same date' END AS ambiguity FROM tx JOIN k ON tx.award_type = k.award_type AND tx.transaction_key = k.transaction_key),
cp AS (SELECT *, CASE WHEN ambiguity IS NOT NULL THEN 'ambiguous' WHEN action_date = max(action_date) OVER (PARTITION BY award_type, transaction_key) THEN 'keep' ELSE 'retire' END AS resolution FROM c)"""


def duplicate_copies(lake):
    """One window over each key's rows; two copies differ where their least and greatest do."""
    w = Window.partitionBy("award_type", "transaction_key")
    differ = lambda c: (F.min(c).over(w) != F.max(c).over(w)).cast("int") + 1
    t = lake.transactions(with_order=False).select("award_type", "transaction_key", "fiscal_year", "action_date", "part_id")
    t = t.withColumn("copies", F.count(F.lit(1)).over(w)).withColumn("fiscal_years", differ("fiscal_year")).withColumn("dated", F.count("action_date").over(w))
    c = t.withColumn("dates", differ("action_date")).withColumn("newest", F.max("action_date").over(w)).filter("copies > 1")
    why = F.when(F.col("copies") != 2, "more than two copies").when(F.col("fiscal_years") != 2, "both copies sit in one fiscal year").when(F.col("dated") != 2, "a copy has no date").when(F.col("dates") != 2, "both copies carry the same date")
    return c.withColumn("ambiguity", why).withColumn("resolution", F.when(F.col("ambiguity").isNotNull(), "ambiguous").when(F.col("action_date") == F.col("newest"), "keep").otherwise("retire"))


@query("M31_audit_duplicate_copies", with_sql("tx", _COPIES_SQL + " SELECT award_type, transaction_key, fiscal_year, action_date, part_id, copies, ambiguity, resolution FROM cp"))
def m31(spark, sf):
    return duplicate_copies(Lake(spark, sf)).select("award_type", "transaction_key", "fiscal_year", "action_date", "part_id", "copies", "ambiguity", "resolution")


@query("M32_audit_fy_moves", with_sql("tx", _COPIES_SQL + " SELECT a.award_type, a.transaction_key, a.fiscal_year AS kept_year, b.fiscal_year AS retired_year, a.part_id AS kept_part, b.part_id AS retired_part FROM cp a JOIN cp b ON a.award_type = b.award_type AND a.transaction_key = b.transaction_key AND a.resolution = 'keep' AND b.resolution = 'retire'"))
def m32(spark, sf):
    c = duplicate_copies(Lake(spark, sf))
    kept = c.filter("resolution = 'keep'").select("award_type", "transaction_key", F.col("fiscal_year").alias("kept_year"), F.col("part_id").alias("kept_part"))
    retired = c.filter("resolution = 'retire'").select("award_type", "transaction_key", F.col("fiscal_year").alias("retired_year"), F.col("part_id").alias("retired_part"))
    return kept.join(retired, ["award_type", "transaction_key"])


@query("M34_audit_link_grading", with_sql("al", """, b AS (SELECT *, coalesce(record_kind = 'precision_sample', FALSE) AS sampled, coalesce(reviewer_verdict IN ('weak', 'wrong'), FALSE) AS rejects, coalesce(adversarial_verdict = 'refuted', FALSE) AS refutes, trim(coalesce(article_id, '')) = '' OR coalesce(cites_article, TRUE) AS binds FROM rev),
v AS (SELECT pe_bli, award_id, exhibit, fiscal_year, TRUE AS reviewed, coalesce(bool_or(reviewer_verdict = 'link' AND adversarial_verdict = 'upheld'), FALSE) AS upheld, bool_or(refutes AND binds) AS rf, bool_or(rejects AND binds) AS rj, bool_or(refutes) AS anf, bool_or(rejects) AS anj FROM b WHERE NOT sampled GROUP BY ALL),
s AS (SELECT DISTINCT pe_bli, award_id, TRUE AS sr FROM b WHERE sampled AND (refutes OR rejects)), w AS (SELECT DISTINCT pe_bli, award_id, TRUE AS wd FROM rul WHERE ruling = 'withdraw'),
o AS (SELECT al.*, al.confidence AS crosswalk, coalesce(adjudicated_confidence, al.confidence) AS ov, basis IS NOT NULL AS adj, award_verdict, pair_reason, basis, coalesce(award_verdict = 'pinned' AND pair_reason = 'pinned-here' AND lenses_passed = 2, FALSE) AS two, coalesce(reviewed, FALSE) AS reviewed, coalesce(upheld, FALSE) AS upheld, coalesce(rf, FALSE) AS rf, coalesce(rj, FALSE) AS rj, coalesce(anf, FALSE) AS anf, coalesce(anj, FALSE) AS anj, coalesce(sr, FALSE) AS sr, coalesce(wd, FALSE) AS wd
  FROM al LEFT JOIN adj USING (pe_bli, award_id) LEFT JOIN v USING (pe_bli, award_id, exhibit, fiscal_year) LEFT JOIN s USING (pe_bli, award_id) LEFT JOIN w USING (pe_bli, award_id)),
q AS (SELECT *, CASE WHEN ov NOT IN ('high', 'medium') THEN NULL WHEN wd THEN CASE WHEN sr THEN 'precision_sample_refuted' ELSE 'line_activity_mismatch' END WHEN method = 'account+subagency' AND NOT two THEN 'account_subagency_not_pinned' WHEN NOT adj AND method = 'account+tokens' AND crosswalk = 'high' THEN 'account_tokens_unadjudicated'
  WHEN NOT adj AND method = 'announcement+lexicon' AND ov = 'high' AND NOT (upheld AND NOT rf AND NOT rj AND NOT sr) THEN CASE WHEN rf THEN 'announcement_review_refuted' WHEN rj THEN 'announcement_reviewer_rejected' WHEN upheld THEN 'precision_sample_refuted' WHEN anf THEN 'announcement_review_refuted' WHEN anj THEN 'announcement_reviewer_rejected' WHEN reviewed THEN 'announcement_review_incomplete' ELSE 'announcement_review_unrecorded' END
  WHEN NOT adj AND ov = 'high' AND sr THEN 'precision_sample_refuted' END AS demotion_reason FROM o)
SELECT pe_bli, award_id, exhibit, fiscal_year, organization, recipient_id, method, account, CASE WHEN demotion_reason IS NULL THEN ov WHEN wd OR demotion_reason = 'account_subagency_not_pinned' THEN 'low' ELSE 'medium' END AS confidence, crosswalk AS crosswalk_confidence,
CASE WHEN adj THEN 'adjudicated' ELSE 'mechanical' END AS confidence_source, demotion_reason, award_verdict, pair_reason, basis AS adjudication_basis FROM q"""))
def m34(spark, sf):
    """Adjudications, reviews, sample refutations and rulings laid over the links."""
    lake = Lake(spark, sf)
    return linking.overlay_grades(lake.award_links(), *lake.link_decisions(), ["pe_bli", "award_id"], ["exhibit", "fiscal_year"])


@query("M35_stg_mts_outlays", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS record_date, o_orderpriority AS classification, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS outlay FROM orders GROUP BY 1, 2")
def m35(spark, sf):
    return Lake(spark, sf).orders.groupBy(F.trunc("o_orderdate", "month").alias("record_date"), F.col("o_orderpriority").alias("classification")).agg(money(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), "outlay"))
