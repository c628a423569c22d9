"""Queries J, A, W, O and U: join shapes, aggregations, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from purselake.functions import exprs as X
from purselake.operators import aggs, joins, windows
from purselake.plans.bindings import Lake, with_sql
from purselake.plans.registry import query

D = "double"


def money(c, name):
    return c.cast(D).alias(name)


# Joins -----------------------------------------------------------------------


@query("J01_left_enrichment", with_sql("tx xw", "SELECT family_key, count(*) AS n, CAST(sum(obligation) AS DOUBLE) AS total FROM tx LEFT JOIN xw USING (recipient_id) GROUP BY 1"))
def j01(spark, sf):
    return Lake(spark, sf).family_transactions(with_order=False).groupBy("family_key").agg(F.count(F.lit(1)).alias("n"), money(F.sum("obligation"), "total"))


_NULLABLE = "SELECT p_partkey, p_brand, nullif(p_type, 'PROMO') AS kind FROM part"


@query("J02_null_safe", f"WITH a AS ({_NULLABLE}), b AS (SELECT kind, count(*) AS n FROM ({_NULLABLE}) GROUP BY 1) SELECT p_partkey, a.kind, n FROM a JOIN b ON a.kind IS NOT DISTINCT FROM b.kind")
def j02(spark, sf):
    a = Lake(spark, sf).part.select("p_partkey", F.nullif(F.col("p_type"), F.lit("PROMO")).alias("kind"))
    return joins.null_safe(a, a.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), ["kind"])


@query("J03_semi", with_sql("tx lk", "SELECT transaction_key, part_id FROM tx WHERE award_id IN (SELECT award_id FROM lk WHERE confidence = 'high')"))
def j03(spark, sf):
    lake = Lake(spark, sf)
    return lake.transactions(with_order=False).join(lake.links().filter("confidence = 'high'"), "award_id", "left_semi").select("transaction_key", "part_id")


@query("J04_anti_several", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_returnflag = 'R' AND m.l_orderkey = l.l_orderkey AND m.l_linenumber = l.l_linenumber AND m.l_suppkey = l.l_suppkey)")
def j04(spark, sf):
    li = Lake(spark, sf).lineitem
    retired = li.filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_suppkey")
    return li.join(retired, ["l_orderkey", "l_linenumber", "l_suppkey"], "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("J05_semi_tolerance", """WITH a AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1),
b AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS t FROM orders) SELECT k, CAST(s AS DOUBLE) AS s FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND abs(a.s - b.t) <= 20000)""")
def j05(spark, sf):
    lake = Lake(spark, sf)
    a = lake.lineitem.filter("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("s"))
    b = lake.orders.select(F.col("o_orderkey").alias("k2"), F.col("o_totalprice").cast("decimal(18,2)").alias("t"))
    return a.join(b, (a.k == b.k2) & (F.abs(a.s - b.t) <= 20000), "left_semi").select("k", money(F.col("s"), "s"))


RULES = [("PriorYear", 1, "fy_%d_actuals", 2), ("CurrentYear", 1, "fy_%d_total", 1), ("BudgetYearOne", 1, "fy_%d_total", 0), ("BudgetYearOne", 2, "fy_%d_request", 0)]
RULES_SQL = "(VALUES " + ", ".join(f"('{s}', {p}, '{t}', {o})" for s, p, t, o in RULES) + ") AS r(scenario, priority, template, fy_offset)"
CANDIDATES_SQL = f"cand AS (SELECT edition_year, scenario, priority, replace(template, '%d', CAST(edition_year - fy_offset AS VARCHAR)) AS amount_type, CAST(edition_year - fy_offset AS INTEGER) AS fy FROM (SELECT DISTINCT edition_year FROM ln) CROSS JOIN {RULES_SQL})"


def candidates(lake):
    """Editions times rule patterns: a rule table of a few rows, broadcast."""
    rules = lake.spark.createDataFrame(RULES, "scenario string, priority int, template string, fy_offset int")
    editions = lake.lines().select("edition_year").distinct()
    fy = (F.col("edition_year") - F.col("fy_offset")).cast("int")
    return editions.crossJoin(F.broadcast(rules)).select("edition_year", "scenario", "priority", F.expr("format_string(template, edition_year - fy_offset)").alias("amount_type"), fy.alias("fy"))


@query("J06_cross_rule_table", with_sql("ln", f", {CANDIDATES_SQL} SELECT * FROM cand"))
def j06(spark, sf):
    return candidates(Lake(spark, sf))


@query("J07_offset_self_join", with_sql("ln", """, t AS (SELECT pe_bli, edition_year, sum(amount_thousands) AS v FROM ln GROUP BY 1, 2)
SELECT a.pe_bli, a.edition_year AS from_edition, b.edition_year AS to_edition, CAST(b.v - a.v AS DOUBLE) AS delta FROM t a JOIN t b ON a.pe_bli = b.pe_bli AND b.edition_year = a.edition_year + 1"""))
def j07(spark, sf):
    t = Lake(spark, sf).lines().groupBy("pe_bli", "edition_year").agg(F.sum("amount_thousands").alias("v"))
    nxt = t.select("pe_bli", F.col("edition_year").alias("to_edition"), (F.col("edition_year") - 1).alias("edition_year"), F.col("v").alias("w"))
    return t.join(nxt, ["pe_bli", "edition_year"]).select("pe_bli", F.col("edition_year").alias("from_edition"), "to_edition", money(F.col("w") - F.col("v"), "delta"))


RANGE_RULES = [(1, "ECONOMY", None, 2017, 2020), (2, "ECONOMY", "r", 2021, 2026), (3, "SMALL", None, 2019, 2024), (4, "PROMO", "b", 2017, 2026), (5, "ECONOMY", None, 2020, 2022)]
RANGE_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', {repr(o) if o else 'NULL'}, {lo}, {hi})" for i, a, o, lo, hi in RANGE_RULES) + ") AS t(rule_id, account, organization, first_edition, last_edition))"


def range_rules(spark):
    return spark.createDataFrame(RANGE_RULES, "rule_id int, account string, organization string, first_edition int, last_edition int")


@query("J08_range_optional_key", with_sql("ln", f", {RANGE_SQL} SELECT line_id, rule_id FROM ln JOIN rules r ON ln.account = r.account AND edition_year BETWEEN first_edition AND last_edition AND (r.organization IS NULL OR r.organization = ln.organization)"))
def j08(spark, sf):
    return joins.range_join(Lake(spark, sf).lines(), F.broadcast(range_rules(spark)), ["account"], "edition_year", "first_edition", "last_edition", ["organization"]).select("line_id", "rule_id")


@query("J09_asof", """WITH p AS (SELECT user_id, event_id AS buy_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts AS seen, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT buy_id, click_id FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.seen""")
def j09(spark, sf):
    e = Lake(spark, sf).events
    buys = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy_id"), "ts")
    clicks = e.filter("event_type = 'click'").groupBy("user_id", F.col("ts").alias("seen")).agg(F.max("event_id").alias("click_id"))
    return joins.asof_join(buys, clicks, ["user_id"], "ts", "seen").select("buy_id", "click_id")


@query("J10_tolerance_match", """WITH s AS (SELECT * FROM part) SELECT p_partkey, other FROM (SELECT a.p_partkey, b.p_partkey AS other, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) AS n
FROM s a JOIN s b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) < 25.00001) WHERE n = 1""")
def j10(spark, sf):
    p = Lake(spark, sf).part
    a = p.select("p_partkey", "p_brand", "p_type", F.col("p_retailprice").alias("a"))
    b = p.select(F.col("p_partkey").alias("other"), "p_brand", "p_type", F.col("p_retailprice").alias("b"))
    return joins.tolerance_match(a, b, ["p_brand", "p_type"], "a", "b", 25.00001, "p_partkey", "other")


_LISTS = "SELECT o_orderkey, concat(o_custkey % 50, ';', o_custkey % 37, ';', o_custkey % 29) AS accounts FROM orders"


@query("J11_containment", f"WITH a AS ({_LISTS}), b AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS account FROM supplier) SELECT DISTINCT o_orderkey, account FROM a JOIN b ON list_contains(string_split(accounts, ';'), account)")
def j11(spark, sf):
    lake = Lake(spark, sf)
    lists = lake.orders.select("o_orderkey", *[(F.col("o_custkey") % n).cast("string").alias(f"a{n}") for n in (50, 37, 29)])
    text = lists.select("o_orderkey", F.concat_ws(";", "a50", "a37", "a29").alias("accounts"))
    exploded = text.select("o_orderkey", F.explode(F.array_distinct(F.split("accounts", ";"))).alias("account"))
    return exploded.join(lake.supplier.select(F.col("s_suppkey").cast("string").alias("account")).distinct(), "account").select("o_orderkey", "account")


@query("J12_full_outer_reconcile", """WITH a AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS t FROM lineitem WHERE l_quantity > 45 GROUP BY 1), b AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS t FROM orders WHERE o_orderstatus = 'F')
SELECT coalesce(a.k, b.k) AS k, CAST(a.t AS DOUBLE) AS total_in, CAST(b.t AS DOUBLE) AS total_out FROM a FULL JOIN b ON a.k = b.k WHERE abs(coalesce(a.t, 0) - coalesce(b.t, 0)) > 1000""")
def j12(spark, sf):
    lake = Lake(spark, sf)
    a = lake.lineitem.filter("l_quantity > 45").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"))
    b = lake.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    return joins.conservation(a, b, ["k"], 1000).select("k", money(F.col("total_in"), "total_in"), money(F.col("total_out"), "total_out"))


@query("J13_interval_overlap", """WITH r AS (SELECT o_orderkey AS id, o_custkey AS k, CAST(o_orderdate AS DATE) AS lo, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS hi FROM orders)
SELECT a.k, a.id AS id_a, b.id AS id_b FROM r a JOIN r b ON a.k = b.k AND a.id < b.id AND a.lo <= b.hi AND b.lo <= a.hi""")
def j13(spark, sf):
    o = Lake(spark, sf).orders
    r = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("lo"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 90).cast("int")).alias("hi"))
    return joins.overlap_pairs(r, ["k"], "id", "lo", "hi")


@query("J14_optional_key", with_sql("ln", f", {RANGE_SQL} SELECT line_id, rule_id FROM ln JOIN rules r ON ln.account = r.account AND (r.organization IS NULL OR r.organization = ln.organization)"))
def j14(spark, sf):
    # The OR is split into two branches, so that both are hash joins.
    lines, rules = Lake(spark, sf).lines(), range_rules(spark)
    anyone = lines.join(rules.filter("organization is null").drop("organization"), "account")
    named = lines.join(rules.filter("organization is not null"), ["account", "organization"])
    return anyone.select("line_id", "rule_id").unionByName(named.select("line_id", "rule_id"))


@query("J15_array_overlap", f"WITH a AS ({_LISTS}), b AS (SELECT c_custkey, [CAST(c_custkey % 31 AS VARCHAR), CAST(c_nationkey AS VARCHAR)] AS xs FROM customer) SELECT o.o_orderkey, list_has_any(string_split(accounts, ';'), xs) AS shares FROM a JOIN orders o USING (o_orderkey) JOIN b ON b.c_custkey = o.o_custkey")
def j15(spark, sf):
    lake = Lake(spark, sf)
    o = lake.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.array(*[(F.col("o_custkey") % n).cast("string") for n in (50, 37, 29)]).alias("xs"))
    c = lake.customer.select("c_custkey", F.array((F.col("c_custkey") % 31).cast("string"), F.col("c_nationkey").cast("string")).alias("ys"))
    return o.join(c, "c_custkey").select("o_orderkey", F.arrays_overlap("xs", "ys").alias("shares"))


@query("J16_latest_rows", "SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC) AS r FROM orders) WHERE r = 1")
def j16(spark, sf):
    o = Lake(spark, sf).orders
    latest = o.groupBy("o_custkey").agg(F.max(F.year("o_orderdate")).alias("y"))
    return o.withColumn("y", F.year("o_orderdate")).join(latest, ["o_custkey", "y"], "left_semi").select("o_custkey", "o_orderkey")


@query("J17_distinct_bridge", with_sql("tx lk pl", "SELECT pop_state, count(*) AS n, CAST(sum(obligation) AS DOUBLE) AS total FROM tx JOIN pl USING (customer_id) WHERE award_id IN (SELECT award_id FROM lk WHERE confidence <> 'low') GROUP BY 1"))
def j17(spark, sf):
    lake = Lake(spark, sf)
    kept = joins.bridge_join(lake.located(), lake.links().filter("confidence <> 'low'"), ["award_id"])
    return kept.groupBy("pop_state").agg(F.count(F.lit(1)).alias("n"), money(F.sum("obligation"), "total"))


@query("J18_fallback", with_sql("ln", """, a AS (SELECT pe_bli, account, max(title) AS title FROM ln WHERE organization = 'r' GROUP BY 1, 2), b AS (SELECT pe_bli, min(title) AS title FROM ln GROUP BY 1)
SELECT line_id, coalesce(a.title, b.title) AS title FROM ln LEFT JOIN a ON ln.pe_bli = a.pe_bli AND ln.account = a.account LEFT JOIN b ON ln.pe_bli = b.pe_bli"""))
def j18(spark, sf):
    ln = Lake(spark, sf).lines()
    specific = ln.filter("organization = 'r'").groupBy("pe_bli", "account").agg(F.max("title").alias("title"))
    general = ln.groupBy("pe_bli").agg(F.min("title").alias("title"))
    return joins.fallback_join(ln.drop("title"), specific, general, ["pe_bli", "account"], ["pe_bli"], "title").select("line_id", "title")


@query("J19_existence_counts", """SELECT count(*) AS listed, count(*) FILTER (WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS detailed,
count(*) FILTER (WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) OR o_orderstatus = 'P') AS covered FROM orders""")
def j19(spark, sf):
    lake = Lake(spark, sf)
    seen = lake.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("seen", F.lit(True))
    j = lake.orders.join(seen, "o_orderkey", "left")
    return j.agg(F.count(F.lit(1)).alias("listed"), F.count("seen").alias("detailed"), F.count_if(F.col("seen").isNotNull() | (F.col("o_orderstatus") == "P")).alias("covered"))


# Aggregations ------------------------------------------------------------------


@query("A01_profile_group", with_sql("tx", "SELECT recipient_id, CAST(sum(obligation) AS DOUBLE) AS total, count(*) AS n, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year FROM tx GROUP BY 1"))
def a01(spark, sf):
    return Lake(spark, sf).transactions(with_order=False).groupBy("recipient_id").agg(money(F.sum("obligation"), "total"), F.count(F.lit(1)).alias("n"), F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"))


@query("A02_distinct_counts", with_sql("tx pl", "SELECT pop_state, pop_district, count(DISTINCT transaction_key) AS transactions, count(DISTINCT award_id) AS awards, count(DISTINCT recipient_id) AS recipients FROM tx JOIN pl USING (customer_id) GROUP BY 1, 2"))
def a02(spark, sf):
    return Lake(spark, sf).located().groupBy("pop_state", "pop_district").agg(F.countDistinct("transaction_key").alias("transactions"), F.countDistinct("award_id").alias("awards"), F.countDistinct("recipient_id").alias("recipients"))


@query("A03_filtered_aggregate", with_sql("tx", "SELECT sub_agency, CAST(sum(obligation) FILTER (WHERE award_type = 'contract') AS DOUBLE) AS contracts, count(*) FILTER (WHERE obligation < 0) AS negative, bool_and(quantity > 0) FILTER (WHERE award_type = 'assistance') AS all_positive FROM tx GROUP BY 1"))
def a03(spark, sf):
    t = Lake(spark, sf).transactions()
    return t.groupBy("sub_agency").agg(F.expr("cast(sum(obligation) filter (where award_type = 'contract') as double)").alias("contracts"), F.expr("count(*) filter (where obligation < 0)").alias("negative"), F.expr("bool_and(quantity > 0) filter (where award_type = 'assistance')").alias("all_positive"))


@query("A04_filtered_distinct", with_sql("fl", "SELECT registrant, count(DISTINCT concat(income_usd, '|', filing_type)) FILTER (WHERE filing_type = '1A') AS amended FROM fl GROUP BY 1"))
def a04(spark, sf):
    return Lake(spark, sf).filings().groupBy("registrant").agg(F.expr("count(distinct concat(income_usd, '|', filing_type)) filter (where filing_type = '1A')").alias("amended"))


@query("A05_bool_and_or", "SELECT p_brand, bool_and(p_size > 2) AS all_big, bool_or(p_type = 'PROMO') AS any_promo FROM part GROUP BY 1")
def a05(spark, sf):
    return Lake(spark, sf).part.groupBy("p_brand").agg(F.bool_and(F.col("p_size") > 2).alias("all_big"), F.bool_or(F.col("p_type") == "PROMO").alias("any_promo"))


@query("A06_conditional_pivot", with_sql("ln", "SELECT pe_bli, " + ", ".join(f"CAST(sum(amount_thousands) FILTER (WHERE exhibit = '{e}') AS DOUBLE) AS {c}" for e, c in (("R-1", "r1"), ("P-1", "p1"), ("P-1R", "p1r"))) + " FROM ln GROUP BY 1"))
def a06(spark, sf):
    wide = Lake(spark, sf).lines().groupBy("pe_bli").pivot("exhibit", ["R-1", "P-1", "P-1R"]).agg(F.sum("amount_thousands").cast(D))
    return wide.toDF("pe_bli", "r1", "p1", "p1r")


@query("A07_pivot_by_basis", with_sql("lk", "SELECT pe_bli, count(*) AS n_all, count(*) FILTER (WHERE confidence = 'high') AS n_high, min(award_id) AS first_all, min(award_id) FILTER (WHERE confidence = 'high') AS first_high FROM lk GROUP BY 1"))
def a07(spark, sf):
    k = Lake(spark, sf).links()
    bases = k.select("*", F.explode(F.when(F.col("confidence") == "high", F.array(F.lit("all"), F.lit("high"))).otherwise(F.array(F.lit("all")))).alias("basis"))
    wide = bases.groupBy("pe_bli").pivot("basis", ["all", "high"]).agg(F.count(F.lit(1)).alias("n"), F.min("award_id").alias("first"))
    return wide.select("pe_bli", F.col("all_n").alias("n_all"), F.coalesce("high_n", F.lit(0)).alias("n_high"), F.col("all_first").alias("first_all"), F.col("high_first").alias("first_high"))


HHI_SQL = "SELECT {g}, CASE WHEN sum(p) = 0 THEN 0 ELSE sum(p * p) * 10000 / (sum(p) * sum(p)) END AS hhi, CAST(sum(net) AS DOUBLE) AS total, count(*) AS entities FROM (SELECT {g}, {e}, CAST(sum(greatest({a}, 0)) AS DOUBLE) AS p, sum({a}) AS net FROM {t} GROUP BY ALL) GROUP BY {g}"


@query("A08_hhi", with_sql("tx", HHI_SQL.format(g="sub_agency", e="recipient_id", a="obligation", t="tx")))
def a08(spark, sf):
    return aggs.hhi(Lake(spark, sf).transactions(), ["sub_agency"], "recipient_id", "obligation").withColumn("total", F.col("total").cast(D))


@query("A09_hhi_window", with_sql("tx", """, e AS (SELECT fiscal_year, recipient_id, CAST(sum(greatest(obligation, 0)) AS DOUBLE) AS p FROM tx GROUP BY 1, 2), s AS (SELECT fiscal_year, p, 100 * p / sum(p) OVER (PARTITION BY fiscal_year) AS share FROM e WHERE p > 0)
SELECT fiscal_year, sum(share * share) AS hhi FROM s GROUP BY 1 HAVING sum(p) >= 1000000"""))
def a09(spark, sf):
    e = Lake(spark, sf).transactions(with_order=False).groupBy("fiscal_year", "recipient_id").agg(F.sum(X.positive_part(F.col("obligation"))).cast(D).alias("p")).filter("p > 0")
    s = e.withColumn("share", windows.share_of_total("p", ["fiscal_year"]))
    return s.groupBy("fiscal_year").agg(F.sum(F.col("share") * F.col("share")).alias("hhi"), F.sum("p").alias("p")).filter("p >= 1000000").drop("p")


@query("A10_having_collisions", with_sql("ln", "SELECT pe_bli, amount_type, count(DISTINCT account) AS n_values FROM ln GROUP BY 1, 2 HAVING count(DISTINCT account) > 1"))
def a10(spark, sf):
    return aggs.collisions(Lake(spark, sf).lines(), ["pe_bli", "amount_type"], "account")


@query("A11_all_present", with_sql("tx", "SELECT award_id, count(*) AS n FROM tx GROUP BY 1 HAVING count(DISTINCT award_type) = 2"))
def a11(spark, sf):
    return Lake(spark, sf).transactions(with_order=False).groupBy("award_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("award_type").alias("k")).filter("k = 2").drop("k")


@query("A12_ordered_string_agg", with_sql("ln", "SELECT pe_bli, string_agg(DISTINCT account, ',' ORDER BY account) AS accounts FROM ln GROUP BY 1"))
def a12(spark, sf):
    return Lake(spark, sf).lines().groupBy("pe_bli").agg(aggs.ordered_join(F.col("account")).alias("accounts"))


@query("A13_ordered_list_with_nulls", "SELECT p_brand, array_to_string(list_transform(list(k ORDER BY k NULLS FIRST), lambda x: coalesce(x, '-')), ',') AS kinds FROM (SELECT p_brand, nullif(p_type, 'PROMO') AS k FROM part) GROUP BY 1")
def a13(spark, sf):
    boxed = F.struct(F.nullif(F.col("p_type"), F.lit("PROMO")).alias("k"))
    lists = Lake(spark, sf).part.groupBy("p_brand").agg(F.sort_array(F.collect_list(boxed)).alias("xs"))
    return lists.select("p_brand", F.array_join(F.transform("xs", lambda x: F.coalesce(x["k"], F.lit("-"))), ",").alias("kinds"))


@query("A14_arg_max", "SELECT l_orderkey, arg_max(v, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS v FROM (SELECT *, CASE WHEN l_tax > 0.02 THEN l_partkey END AS v FROM lineitem) WHERE v IS NOT NULL GROUP BY 1")
def a14(spark, sf):
    v = F.when(F.col("l_tax") > 0.02, F.col("l_partkey"))
    return Lake(spark, sf).lineitem.groupBy("l_orderkey").agg(aggs.arg_max(v, F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")).alias("v")).filter("v is not null")


@query("A15_exact_decimal_sum", "SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS VARCHAR) AS exact FROM lineitem GROUP BY 1")
def a15(spark, sf):
    return Lake(spark, sf).lineitem.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).cast("string").alias("exact"))


@query("A16_ranked_category", with_sql("lk", "SELECT award_id, CASE min(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS worst FROM lk GROUP BY 1"))
def a16(spark, sf):
    rank = X.recode(F.col("confidence"), {"high": 3, "medium": 2}, 1)
    return Lake(spark, sf).links().groupBy("award_id").agg(F.min(rank).alias("r")).select("award_id", X.recode(F.col("r"), {3: "high", 2: "medium"}, "low").alias("worst"))


@query("A17_single_source", with_sql("ln", "SELECT pe_bli, account, edition_year, CASE WHEN count(*) = 1 THEN min(line_id) END AS source_id FROM ln GROUP BY 1, 2, 3"))
def a17(spark, sf):
    return Lake(spark, sf).lines().groupBy("pe_bli", "account", "edition_year").agg(aggs.single_source(F.col("line_id")).alias("source_id"))


@query("A18_distinct_tuple_sum", with_sql("ln", "SELECT pe_bli, CAST(sum(a) AS DOUBLE) AS total FROM (SELECT DISTINCT pe_bli, account, title, floor(amount_thousands / 10) AS a FROM ln) GROUP BY 1"))
def a18(spark, sf):
    once = Lake(spark, sf).lines().select("pe_bli", "account", "title", F.floor(F.col("amount_thousands") / 10).alias("a")).distinct()
    return once.groupBy("pe_bli").agg(money(F.sum("a"), "total"))


@query("A19_weighted_rate", "SELECT l_returnflag, CAST(round(CAST(sum(CAST(l_quantity AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / nullif(sum(CAST(l_quantity AS BIGINT)), 0), 4) AS DOUBLE) AS rate FROM lineitem GROUP BY 1")
def a19(spark, sf):
    q = F.col("l_quantity").cast("long")
    rate = F.sum(q * F.round(F.col("l_discount") * 100).cast("long")).cast(D) / F.nullif(F.sum(q), F.lit(0))
    return Lake(spark, sf).lineitem.groupBy("l_returnflag").agg(F.round(rate, 4).alias("rate"))


@query("A20_coverage_test", "SELECT p_brand, count(k) = count(*) AND count(DISTINCT k) = count(*) AS keyed FROM (SELECT p_brand, nullif(p_name, 'red bolt') AS k FROM part) GROUP BY 1")
def a20(spark, sf):
    k = F.nullif(F.col("p_name"), F.lit("red bolt"))
    n = F.count(F.lit(1))
    return Lake(spark, sf).part.groupBy("p_brand").agg(((F.count(k) == n) & (F.countDistinct(k) == n)).alias("keyed"))


@query("A21_group_by_all", with_sql("fl", "SELECT registrant, filing_year, filing_period, count(*) FILTER (WHERE filing_type = '1A') AS amendments FROM fl WHERE filing_type <> 'RR' GROUP BY ALL"))
def a21(spark, sf):
    return Lake(spark, sf).filings().filter("filing_type <> 'RR'").groupBy("registrant", "filing_year", "filing_period").agg(F.count_if(F.col("filing_type") == "1A").alias("amendments"))


@query("A22_success_rate", "SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS booked FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY GROUP BY 1")
def a22(spark, sf):
    recent = Lake(spark, sf).events.filter("ts >= timestamp'2024-01-31' - interval 14 days")
    return recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "purchase").alias("booked"))


@query("A23_parentage", with_sql("tx pl", """, f AS (SELECT pop_district AS dst, sub_agency AS src, sum(obligation) AS v FROM tx JOIN pl USING (customer_id) GROUP BY 1, 2)
SELECT dst, count(*) AS n_sources, arg_max(src, v) AS main_source, CAST(sum(v) AS DOUBLE) AS inflow FROM f GROUP BY 1"""))
def a23(spark, sf):
    edges = Lake(spark, sf).located().select(F.col("sub_agency").alias("src"), F.col("pop_district").alias("dst"), "obligation")
    return aggs.parentage(edges, "src", "dst", "obligation").withColumn("inflow", F.col("inflow").cast(D))


# Windows -------------------------------------------------------------------------


@query("W01_pick_first", with_sql("ln", "SELECT pe_bli, title FROM (SELECT pe_bli, title, row_number() OVER (PARTITION BY pe_bli ORDER BY count(*) DESC, title) AS n FROM ln GROUP BY 1, 2) WHERE n = 1"))
def w01(spark, sf):
    counts = Lake(spark, sf).lines().groupBy("pe_bli", "title").count()
    return windows.pick_first(counts, ["pe_bli"], [F.col("count").desc(), F.col("title").asc_nulls_last()]).select("pe_bli", "title")


@query("W02_tied_top", with_sql("ln", "SELECT pe_bli, max(title) AS title FROM (SELECT pe_bli, title, rank() OVER (PARTITION BY pe_bli ORDER BY edition_year DESC) AS r FROM ln) WHERE r = 1 GROUP BY 1"))
def w02(spark, sf):
    return windows.tied_top(Lake(spark, sf).lines(), ["pe_bli"], [F.col("edition_year").desc()]).groupBy("pe_bli").agg(F.max("title").alias("title"))


@query("W03_candidate_priority", with_sql("ln", f", {CANDIDATES_SQL} SELECT line_id, scenario, priority FROM (SELECT line_id, scenario, priority, rank() OVER (PARTITION BY line_id ORDER BY priority) AS r FROM ln JOIN cand USING (edition_year, amount_type)) WHERE r = 1"))
def w03(spark, sf):
    lake = Lake(spark, sf)
    c = candidates(lake).drop("fy")
    return windows.tied_top(lake.lines().join(F.broadcast(c), ["edition_year", "amount_type"]), ["line_id"], [F.col("priority")]).select("line_id", "scenario", "priority")


@query("W04_first_value", "SELECT DISTINCT o_custkey, first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END, o_orderdate, o_orderkey) AS priority FROM orders")
def w04(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", 1).otherwise(0), "o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return Lake(spark, sf).orders.select("o_custkey", F.first("o_orderpriority").over(w).alias("priority")).distinct()


@query("W05_mark_newest", "SELECT o_orderkey, o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey) AS newest FROM orders")
def w05(spark, sf):
    return Lake(spark, sf).orders.select("o_orderkey", (F.col("o_orderdate") == F.max("o_orderdate").over(Window.partitionBy("o_custkey"))).alias("newest"))


@query("W06_share_of_total", "SELECT l_suppkey, l_returnflag, 100.0 * q / sum(q) OVER (PARTITION BY l_suppkey) AS share FROM (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)")
def w06(spark, sf):
    q = Lake(spark, sf).lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return q.select("l_suppkey", "l_returnflag", windows.share_of_total("q", ["l_suppkey"]).alias("share"))


@query("W07_member_rank", with_sql("ln", "SELECT title, min(r) AS best FROM (SELECT title, row_number() OVER (PARTITION BY account ORDER BY amount_thousands DESC, line_id) AS r FROM ln) GROUP BY 1"))
def w07(spark, sf):
    ln = Lake(spark, sf).lines().select("account", "title", "amount_thousands", "line_id")
    return windows.numbered(ln, ["account"], [F.col("amount_thousands").desc(), F.col("line_id")], "r").groupBy("title").agg(F.min("r").cast("int").alias("best"))


@query("W08_boolean_first", with_sql("ln", "SELECT pe_bli, account FROM (SELECT pe_bli, account, row_number() OVER (PARTITION BY pe_bli ORDER BY (account = 'PROMO') DESC, sum(amount_thousands) DESC, account) AS n FROM ln GROUP BY 1, 2) WHERE n = 1"))
def w08(spark, sf):
    t = Lake(spark, sf).lines().groupBy("pe_bli", "account").agg(F.sum("amount_thousands").alias("s"))
    return windows.pick_first(t, ["pe_bli"], [(F.col("account") == "PROMO").desc(), F.col("s").desc_nulls_last(), F.col("account").asc_nulls_last()]).select("pe_bli", "account")


@query("W09_global_top_k", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def w09(spark, sf):
    return Lake(spark, sf).customer.select("c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(25)


@query("W10_qualify_margin", with_sql("tx", """, s AS (SELECT sub_agency, recipient_id, sum(obligation) AS v FROM tx GROUP BY 1, 2)
SELECT sub_agency, recipient_id, CAST(v AS DOUBLE) AS v, CAST(v - lead(v) OVER (PARTITION BY sub_agency ORDER BY v DESC, recipient_id) AS DOUBLE) AS margin FROM s QUALIFY row_number() OVER (PARTITION BY sub_agency ORDER BY v DESC, recipient_id) = 1"""))
def w10(spark, sf):
    s = Lake(spark, sf).transactions().groupBy("sub_agency", "recipient_id").agg(F.sum("obligation").alias("v"))
    w = Window.partitionBy("sub_agency").orderBy(F.col("v").desc(), "recipient_id")
    first = s.withColumn("n", F.row_number().over(w)).filter("n <= 2")  # each task passes on two rows a group
    margin = F.col("v") - F.lead("v").over(w)
    return first.select("sub_agency", "recipient_id", money(F.col("v"), "v"), money(margin, "margin"), "n").filter("n = 1").drop("n")


@query("W11_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since FROM events")
def w11(spark, sf):
    e = Lake(spark, sf).events.withColumn("mark", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return e.select("event_id", windows.carry_forward("mark", ["user_id"], [F.col("ts"), F.col("event_id")]).alias("since"))


@query("W12_continuity", with_sql("ln", """, t AS (SELECT pe_bli, edition_year, sum(amount_thousands) AS v FROM ln GROUP BY 1, 2)
SELECT a.pe_bli, a.edition_year, (abs(a.v) < 100 AND abs(b.v) < 100) OR (sign(a.v) = sign(b.v) AND abs(a.v) <= 2 * abs(b.v) AND abs(b.v) <= 2 * abs(a.v)) AS continuous FROM t a JOIN t b ON a.pe_bli = b.pe_bli AND b.edition_year = a.edition_year + 1"""))
def w12(spark, sf):
    t = Lake(spark, sf).lines().groupBy("pe_bli", "edition_year").agg(F.sum("amount_thousands").alias("v"))
    w = Window.partitionBy("pe_bli").orderBy("edition_year")
    n = t.select("*", F.lead("v").over(w).alias("b"), F.lead("edition_year").over(w).alias("next")).filter("next = edition_year + 1")
    a, b = F.abs("v"), F.abs("b")
    near = ((a < 100) & (b < 100)) | ((F.signum(F.col("v").cast(D)) == F.signum(F.col("b").cast(D))) & (a <= 2 * b) & (b <= 2 * a))
    return n.select("pe_bli", "edition_year", near.alias("continuous"))


# Sorting, top-k, set operations -------------------------------------------------------


@query("O01_top_n_with_other", with_sql("tx", """, s AS (SELECT sub_agency, CAST(recipient_id AS VARCHAR) AS k, sum(obligation) AS v FROM tx GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY sub_agency ORDER BY v DESC, k) AS r FROM s)
SELECT sub_agency, CASE WHEN r <= 5 THEN k ELSE 'Other' END AS label, count(*) AS members, CAST(sum(v) AS DOUBLE) AS total, coalesce(string_agg(k, ',' ORDER BY r) FILTER (WHERE r > 5 AND r <= 10), '') AS listed,
CAST(greatest(count(*) FILTER (WHERE r > 5) - 5, 0) AS BIGINT) AS omitted, CAST(coalesce(sum(v) FILTER (WHERE r > 10), 0) AS DOUBLE) AS omitted_total FROM r GROUP BY 1, 2"""))
def o01(spark, sf):
    s = Lake(spark, sf).transactions().groupBy("sub_agency", F.col("recipient_id").cast("string").alias("k")).agg(F.sum("obligation").alias("v"))
    out = aggs.top_n_with_other(s, ["sub_agency"], "k", "v", 5)
    return out.withColumn("total", F.col("total").cast(D)).withColumn("omitted_total", F.col("omitted_total").cast(D))


@query("O02_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def o02(spark, sf):
    return windows.pick_first(Lake(spark, sf).orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("O03_page", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def o03(spark, sf):
    o = Lake(spark, sf).orders
    page = o.orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(40).limit(20).select("o_orderkey")
    return page.crossJoin(F.broadcast(o.agg(F.count(F.lit(1)).alias("total"))))


@query("O04_top_families", with_sql("tx xw", "SELECT family_key, CAST(sum(obligation) AS DOUBLE) AS total FROM tx JOIN xw USING (recipient_id) GROUP BY 1 ORDER BY sum(obligation) DESC, 1 LIMIT 10"))
def o04(spark, sf):
    t = Lake(spark, sf).family_transactions(with_order=False).groupBy("family_key").agg(F.sum("obligation").alias("s"))
    return t.orderBy(F.col("s").desc(), "family_key").limit(10).select("family_key", money(F.col("s"), "total"))


@query("U01_union_all", "SELECT 'open' AS side, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT 'final', l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linestatus = 'F'")
def u01(spark, sf):
    li = Lake(spark, sf).lineitem.select("l_linestatus", "l_orderkey", "l_linenumber", "l_partkey")
    a = li.filter("l_linestatus = 'O'").select(F.lit("open").alias("side"), "l_orderkey", "l_linenumber", "l_partkey")
    b = li.filter("l_linestatus = 'F'").select("l_partkey", "l_linenumber", "l_orderkey", F.lit("final").alias("side"))
    return a.unionByName(b)


@query("U02_except_all", "SELECT 'a' AS side, * FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 EXCEPT ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40) UNION ALL SELECT 'b', * FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40 EXCEPT ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45)")
def u02(spark, sf):
    li = Lake(spark, sf).lineitem
    part = lambda n: li.filter(F.col("l_quantity") > n).select("l_orderkey", "l_linenumber")
    a, b = part(10).exceptAll(part(40)), part(40).exceptAll(part(45))
    return a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))


@query("U03_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def u03(spark, sf):
    return Lake(spark, sf).part.select("p_brand", "p_type").distinct()


@query("U04_key_sets", "SELECT 'both' AS side, k FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'idle', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)")
def u04(spark, sf):
    lake = Lake(spark, sf)
    c, o = lake.customer.select(F.col("c_custkey").alias("k")), lake.orders.select(F.col("o_custkey").alias("k"))
    return c.intersect(o).withColumn("side", F.lit("both")).unionByName(c.join(o, "k", "left_anti").distinct().withColumn("side", F.lit("idle")))
