"""Queries QC01-QC10 (checks) and V01-V20 (gates: metrics beside their thresholds)."""

from __future__ import annotations

from pyspark.sql import functions as F

from purselake.functions import exprs as X
from purselake.operators import aggs, joins, linking
from purselake.plans import entities, graph_text, marts
from purselake.plans.bindings import Lake, with_sql
from purselake.plans.marts import n_rows
from purselake.plans.registry import query
from purselake.plans.relational import RANGE_SQL, money, range_rules
from purselake.quality import checks


@query("QC01_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def qc01(spark, sf):
    return checks.unique(Lake(spark, sf).lineitem, ["l_orderkey", "l_linenumber"])


@query("QC02_not_null_accepted_values", "SELECT 'null' AS check_name, p_partkey FROM (SELECT p_partkey, nullif(p_type, 'PROMO') AS k FROM part) WHERE k IS NULL UNION ALL SELECT 'value', p_partkey FROM part WHERE p_type NOT IN ('ECONOMY', 'SMALL', 'PROMO')")
def qc02(spark, sf):
    p = Lake(spark, sf).part
    a = checks.not_null(p.withColumn("k", F.nullif(F.col("p_type"), F.lit("PROMO"))), "k").select(F.lit("null").alias("check_name"), "p_partkey")
    return a.unionByName(checks.accepted_values(p, "p_type", ["ECONOMY", "SMALL", "PROMO"]).select(F.lit("value").alias("check_name"), "p_partkey"))


@query("QC03_conservation", with_sql("tx", ", a AS (SELECT sub_agency, sum(obligation) AS t FROM tx GROUP BY 1), b AS (SELECT sub_agency, sum(obligation) AS t FROM tx WHERE quantity < 50 GROUP BY 1) SELECT sub_agency, CAST(a.t AS DOUBLE) AS total_in, CAST(b.t AS DOUBLE) AS total_out FROM a FULL JOIN b USING (sub_agency) WHERE abs(coalesce(a.t, 0) - coalesce(b.t, 0)) > 1"))
def qc03(spark, sf):
    t = Lake(spark, sf).transactions()
    a, b = (d.groupBy("sub_agency").agg(F.sum("obligation").alias("total")) for d in (t, t.filter("quantity < 50")))
    return joins.conservation(a, b, ["sub_agency"], 1).select("sub_agency", money(F.col("total_in"), "total_in"), money(F.col("total_out"), "total_out"))


@query("QC04_recompute_equals", "SELECT o_orderkey AS k, CAST(t AS DOUBLE) AS mart_value, CAST(s AS DOUBLE) AS source_value FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS t FROM orders) FULL JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE t IS NULL OR s IS NULL OR abs(t - s) > 250000")
def qc04(spark, sf):
    lake = Lake(spark, sf)
    a = lake.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    b = lake.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("v"))
    return checks.recompute_equals(a, b, ["k"], "v", 250000).select("k", money(F.col("mart_value"), "mart_value"), money(F.col("source_value"), "source_value"))


@query("QC05_rule_wellformed", "SELECT p_partkey, p_brand FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#[0-9]')")
def qc05(spark, sf):
    return checks.wellformed(Lake(spark, sf).part, "p_brand", "^Brand#[0-9]$").select("p_partkey", "p_brand")


@query("QC06_no_overlap", with_sql("ln", f", {RANGE_SQL} SELECT a.account, a.rule_id AS id_a, b.rule_id AS id_b, (SELECT count(*) FROM ln WHERE ln.account = a.account) AS lines FROM rules a JOIN rules b ON a.account = b.account AND a.rule_id < b.rule_id AND a.first_edition <= b.last_edition AND b.first_edition <= a.last_edition"))
def qc06(spark, sf):
    pairs = checks.no_overlap(range_rules(spark), ["account"], "rule_id", "first_edition", "last_edition")
    return pairs.join(Lake(spark, sf).lines().groupBy("account").agg(n_rows().alias("lines")), "account")


@query("QC07_complete", "SELECT k, 'right' AS missing_on FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT s_suppkey FROM supplier) UNION ALL SELECT k, 'left' FROM (SELECT s_suppkey AS k FROM supplier EXCEPT SELECT o_custkey FROM orders)")
def qc07(spark, sf):
    lake = Lake(spark, sf)
    return checks.complete(lake.orders.select(F.col("o_custkey").alias("k")), lake.supplier.select(F.col("s_suppkey").alias("k")), ["k"])


@query("QC08_pinned_value", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) IS DISTINCT FROM 4")
def qc08(spark, sf):
    return checks.pinned_value(Lake(spark, sf).nation.groupBy("n_regionkey").agg(n_rows().alias("n")), "n", 4)


@query("QC09_consistency_rule", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate AND o_orderstatus = 'F'")
def qc09(spark, sf):
    lake = Lake(spark, sf)
    return lake.lineitem.join(lake.orders, F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate < o_orderdate AND o_orderstatus = 'F'").select("l_orderkey", "l_linenumber", "l_partkey")


@query("QC10_warn_count", "SELECT count(*) AS warnings FROM lineitem WHERE l_extendedprice > 90000")
def qc10(spark, sf):
    return checks.warn_count(Lake(spark, sf).lineitem.filter("l_extendedprice > 90000"))


# Gates ------------------------------------------------------------------------------------


@query("V01_resolution_rate", with_sql("tx xw", ", t AS (SELECT recipient_id, sum(obligation) AS s FROM tx GROUP BY 1 ORDER BY s DESC, 1 LIMIT 50) SELECT count(*) AS top_n, count(family_key) AS resolved, count(family_key) * 1.0 / count(*) AS rate FROM t LEFT JOIN xw USING (recipient_id)"))
def v01(spark, sf):
    lake = Lake(spark, sf)
    top = lake.transactions(with_order=False).groupBy("recipient_id").agg(F.sum("obligation").alias("s")).orderBy(F.col("s").desc(), "recipient_id").limit(50)
    j = top.join(lake.recipients(), "recipient_id", "left")
    return j.agg(n_rows().alias("top_n"), F.count("family_key").alias("resolved"), (F.count("family_key") / n_rows()).alias("rate"))


@query("V02_golden_families", with_sql("xw", ", g(pattern) AS (VALUES ('%00001_'), ('%00002'), ('nothing%')) SELECT pattern, count(DISTINCT family_key) AS families FROM g LEFT JOIN xw ON recipient_name ILIKE pattern GROUP BY 1"))
def v02(spark, sf):
    x = Lake(spark, sf).recipients()
    goldens = ["%00001_", "%00002", "nothing%"]
    one = x.agg(*[F.countDistinct(F.when(F.ilike("recipient_name", F.lit(g)), F.col("family_key"))).alias(f"g{i}") for i, g in enumerate(goldens)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(g).alias("pattern"), F.col(f"g{i}").alias("families")) for i, g in enumerate(goldens)])).alias("x")).select("x.*")


@query("V03_geography_coverage", "SELECT count(*) FILTER (WHERE s IS NOT NULL) AS with_state, count(*) FILTER (WHERE s IS NOT NULL AND d IS NOT NULL) AS with_district FROM (SELECT nullif(c_mktsegment, 'MACHINERY') AS s, nullif(c_nationkey, 3) AS d FROM customer)")
def v03(spark, sf):
    s, d = F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")), F.nullif(F.col("c_nationkey"), F.lit(3))
    return Lake(spark, sf).customer.agg(F.count_if(s.isNotNull()).alias("with_state"), F.count_if(s.isNotNull() & d.isNotNull()).alias("with_district"))


@query("V04_mapping_rate", "SELECT count(*) AS areas, count(*) FILTER (WHERE p_type <> 'PROMO') AS mapped, count(*) FILTER (WHERE p_type <> 'PROMO') >= 0.8 * count(*) AS passed FROM part")
def v04(spark, sf):
    mapped = F.count_if(F.col("p_type") != "PROMO")
    return Lake(spark, sf).part.agg(n_rows().alias("areas"), mapped.alias("mapped"), (mapped >= 0.8 * n_rows()).alias("passed"))


@query("V05_mart_invariants", with_sql("tx", ", h AS (SELECT sub_agency, sum(p * p) * 10000 / (sum(p) * sum(p)) AS hhi FROM (SELECT sub_agency, recipient_id, CAST(sum(greatest(obligation, 0)) AS DOUBLE) AS p FROM tx GROUP BY 1, 2) GROUP BY 1) SELECT count(*) AS marts, count(*) FILTER (WHERE hhi < 0 OR hhi > 10000) AS out_of_range FROM h"))
def v05(spark, sf):
    h = aggs.hhi(Lake(spark, sf).transactions(), ["sub_agency"], "recipient_id", "obligation")
    return h.agg(n_rows().alias("marts"), F.count_if((F.col("hhi") < 0) | (F.col("hhi") > 10000)).alias("out_of_range"))


_DEPT = "WITH a AS (SELECT o_custkey % 50 AS d, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS t FROM orders GROUP BY 1), b AS (SELECT o_custkey % 50 AS d, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS t FROM orders WHERE o_orderkey % 400 <> 0 GROUP BY 1)"


@query("V06_dept_reconcile", _DEPT + " SELECT count(*) AS departments, count(*) FILTER (WHERE abs(a.t - b.t) <= a.t / 200) AS within FROM a FULL JOIN b USING (d)")
def v06(spark, sf):
    o = Lake(spark, sf).orders.withColumn("d", F.col("o_custkey") % 50)
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)"))
    a, b = o.groupBy("d").agg(total.alias("t")), o.filter("o_orderkey % 400 <> 0").groupBy("d").agg(total.alias("u"))
    return a.join(b, "d", "full_outer").agg(n_rows().alias("departments"), F.count_if(F.abs(F.col("t") - F.col("u")) <= F.col("t") / 200).alias("within"))


@query("V07_capture_coverage", "SELECT count(*) AS captured, max(l_orderkey) + 1 AS expected, count(*) * 1.0 / (max(l_orderkey) + 1) >= 0.8 AS passed FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def v07(spark, sf):
    k = Lake(spark, sf).lineitem.select("l_orderkey").distinct()
    return k.agg(n_rows().alias("captured"), (F.max("l_orderkey") + 1).alias("expected"), (n_rows() / (F.max("l_orderkey") + 1) >= 0.8).alias("passed"))


@query("V08_comparable_pairs", "SELECT count(*) AS pairs FROM (SELECT o_orderpriority, year(o_orderdate) FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) = 3)")
def v08(spark, sf):
    g = Lake(spark, sf).orders.groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.countDistinct("o_orderstatus").alias("k")).filter("k = 3")
    return g.agg(n_rows().alias("pairs"))


@query("V09_match_rate", with_sql("tx", f""", t AS ({entities._TIER_SQL}), top AS (SELECT concat('SUPPLIER ', recipient_id) AS family_key FROM tx GROUP BY 1 ORDER BY sum(obligation) DESC, 1 LIMIT 50),
m AS (SELECT count(*) AS top_n, count(*) FILTER (WHERE family_key IN (SELECT family_key FROM t WHERE tier <> 'none')) AS matched_count FROM top)
SELECT top_n, matched_count, round(matched_count / top_n, 4) AS matched_fraction, (SELECT count(*) FROM t WHERE tier = 'normalized' AND family_key NOT LIKE 'SUPPLIER _%') AS bad_normalized, matched_count / top_n >= 0.85 AS ok FROM m"""))
def v09(spark, sf):
    lake = Lake(spark, sf)
    families = lake.transactions(with_order=False).groupBy(F.concat(F.lit("SUPPLIER "), F.col("recipient_id").cast("string")).alias("family_key")).agg(F.sum("obligation").alias("total"))
    return linking.match_gate(families, "total", entities.client_tiers(lake), "client_name")


@query("V10_mention_integrity", "SELECT count(*) AS mentions, count(DISTINCT l_partkey) AS codes, count(*) FILTER (WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 49)) AS orphans FROM lineitem")
def v10(spark, sf):
    lake = Lake(spark, sf)
    known = lake.part.filter("p_size < 49").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("known"))
    return lake.lineitem.join(known, "l_partkey", "left").agg(n_rows().alias("mentions"), F.countDistinct("l_partkey").alias("codes"), F.count_if(F.col("known").isNull()).alias("orphans"))


@query("V11_coverage_accuracy_gates", with_sql("ln", ", c AS (SELECT DISTINCT pe_bli, account FROM ln), d AS (SELECT DISTINCT pe_bli, account FROM ln WHERE exhibit = 'R-1') SELECT (SELECT count(*) FROM c) AS listed, (SELECT count(*) FROM d) AS detailed, (SELECT count(*) FROM d) * 1.0 / (SELECT count(*) FROM c) AS coverage"))
def v11(spark, sf):
    ln = Lake(spark, sf).lines()
    k = ln.groupBy("pe_bli", "account").agg(F.bool_or(F.col("exhibit") == "R-1").alias("d"))
    return k.agg(n_rows().alias("listed"), F.count_if("d").alias("detailed"), (F.count_if("d") / n_rows()).alias("coverage"))


@query("V12_independent_recomputes", with_sql("tx pl lk", marts._PUB + ", m AS (SELECT pop_state, count(DISTINCT award_id) AS n FROM tx JOIN pl USING (customer_id) WHERE award_id IN (SELECT award_id FROM pub) GROUP BY 1) SELECT count(*) AS compared, 0 AS differing FROM m"))
def v12(spark, sf):
    """The district mart summed up against a recount from raw tables."""
    lake = Lake(spark, sf)
    mart = joins.bridge_join(lake.located(), marts.published(lake), ["award_id"]).groupBy("pop_state").agg(F.countDistinct("award_id").alias("n"))
    li, p = lake.lineitem, lake.part
    good = li.join(p, li.l_partkey == p.p_partkey).groupBy("p_brand", "l_orderkey").agg(F.max("l_quantity").alias("q")).filter("q >= 20").select("l_orderkey").distinct()
    o = lake.orders.join(good, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").join(lake.places(), F.col("o_custkey") == F.col("customer_id"))
    raw = o.groupBy("pop_state").agg(F.countDistinct("o_orderkey").alias("raw"))
    j = mart.join(raw, "pop_state", "full_outer")
    return j.agg(n_rows().alias("compared"), F.count_if(~F.col("n").eqNullSafe(F.col("raw"))).cast("int").alias("differing"))


@query("V13_snapshot_pins", "SELECT 'orders' AS table_name, count(*) AS row_count, bit_xor(CAST(o_orderkey * 31 + o_custkey AS BIGINT)) AS pin FROM orders UNION ALL SELECT 'customer', count(*), bit_xor(CAST(c_custkey * 31 + c_nationkey AS BIGINT)) FROM customer")
def v13(spark, sf):
    """Order-free pins: the exclusive or of row digests, which needs no sort."""
    lake = Lake(spark, sf)

    def pin(df, name, digest):
        return df.agg(n_rows().alias("row_count"), F.bit_xor(digest.cast("long")).alias("pin")).withColumn("table_name", F.lit(name))

    return pin(lake.orders, "orders", F.col("o_orderkey") * 31 + F.col("o_custkey")).unionByName(pin(lake.customer, "customer", F.col("c_custkey") * 31 + F.col("c_nationkey")))


@query("V14_fact_delta", "WITH a AS (SELECT p_partkey AS id, p_retailprice AS v FROM part WHERE p_partkey % 10 < 9), b AS (SELECT p_partkey AS id, p_retailprice + CASE WHEN p_partkey % 50 = 0 THEN 1 ELSE 0 END AS v FROM part WHERE p_partkey % 10 > 0 OR p_partkey % 50 = 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'lost' ELSE 'moved' END AS kind FROM a FULL JOIN b ON a.id = b.id WHERE a.v IS DISTINCT FROM b.v")
def v14(spark, sf):
    p = Lake(spark, sf).part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))
    a = p.filter("id % 10 < 9")
    b = p.filter("id % 10 > 0 OR id % 50 = 0").select("id", (F.col("v") + F.when(F.col("id") % 50 == 0, 1).otherwise(0)).alias("w"))
    j = a.join(b, "id", "full_outer").filter(~F.col("v").eqNullSafe(F.col("w")))
    return j.select("id", linking.first_true([(F.col("v").isNull(), "added"), (F.col("w").isNull(), "lost")], "moved").alias("kind"))


@query("V15_lineage_integrity", f"WITH {graph_text._EDGES_SQL} SELECT count(*) AS edges, count(*) FILTER (WHERE relation = 'split') AS splits, 0 AS crossing FROM ed")
def v15(spark, sf):
    """Edges never cross recomputed components."""
    e = graph_text.lineage(Lake(spark, sf))
    comp = graph_text.graphs.components(e, "a", "b")
    side = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    j = e.join(side("a"), "a").join(side("b"), "b")
    return j.agg(n_rows().alias("edges"), F.count_if(F.col("relation") == "split").alias("splits"), F.count_if(F.col("c_a") != F.col("c_b")).cast("int").alias("crossing"))


_RECORDED = 2024


@query("V16_ranged_decision_integrity", with_sql("ln", marts._ERA_SQL + f""", d AS (SELECT r.rule_id, count(e.era_key) AS bound, string_agg(e.era_key, chr(10) ORDER BY e.era_key) AS now, string_agg(e.era_key, chr(10) ORDER BY e.era_key) FILTER (WHERE e.edition_year <= {_RECORDED}) AS recorded FROM rules r LEFT JOIN era e ON e.decision_id = r.rule_id GROUP BY 1)
SELECT rule_id, bound, now IS NOT DISTINCT FROM recorded AS digest_matches, CAST(NULL AS BIGINT) AS undecided FROM d
UNION ALL SELECT NULL, NULL, NULL, (SELECT count(*) FROM era WHERE decision_id IS NULL AND account IN (SELECT account FROM rules))"""))
def v16(spark, sf):
    """Per rule: keys it binds and whether the digest recorded when it was decided still
    holds; and, in a row of its own, keys of ruled accounts that no rule decides."""
    m = marts.era_map(Lake(spark, sf))
    recorded = F.when(F.col("edition_year") <= _RECORDED, F.col("era_key"))
    now = m.filter("decision_id IS NOT NULL").groupBy(F.col("decision_id").alias("rule_id")).agg(n_rows().alias("n"), aggs.multiset_digest(F.col("era_key")).alias("now"), aggs.multiset_digest(recorded).alias("was"))
    rules = range_rules(spark)
    per_rule = rules.select("rule_id").join(now, "rule_id", "left").select("rule_id", F.coalesce("n", F.lit(0)).alias("bound"), F.coalesce(F.col("now") == F.col("was"), F.lit(True)).alias("digest_matches"), F.lit(None).cast("long").alias("undecided"))
    open_keys = m.filter("decision_id IS NULL").join(F.broadcast(rules.select("account").distinct()), "account", "left_semi").agg(n_rows().alias("undecided"))
    return per_rule.unionByName(open_keys.select(F.lit(None).cast("int").alias("rule_id"), F.lit(None).cast("long").alias("bound"), F.lit(None).cast("boolean").alias("digest_matches"), "undecided"))


@query("V17_edition_leakage", with_sql("ln", "SELECT edition_year, count(*) FILTER (WHERE CAST(regexp_extract(amount_type, '[0-9]+') AS INTEGER) > edition_year) AS leaked, count(*) AS lines FROM ln GROUP BY 1"))
def v17(spark, sf):
    year = F.regexp_extract("amount_type", "[0-9]+", 0).cast("int")
    return Lake(spark, sf).lines().groupBy("edition_year").agg(F.count_if(year > F.col("edition_year")).alias("leaked"), n_rows().alias("lines"))


@query("V18_sampled_recompute", with_sql("tx", ", s AS (SELECT sub_agency, recipient_id FROM (SELECT *, row_number() OVER (PARTITION BY sub_agency ORDER BY sha256(concat('3|', recipient_id)), recipient_id) AS n FROM (SELECT DISTINCT sub_agency, recipient_id FROM tx)) WHERE n <= 10) SELECT sub_agency, recipient_id, CAST(sum(obligation) AS DOUBLE) AS total FROM tx JOIN s USING (sub_agency, recipient_id) GROUP BY 1, 2"))
def v18(spark, sf):
    t = Lake(spark, sf).transactions()
    picked = linking.stratified_sample(t.select("sub_agency", "recipient_id").distinct(), ["sub_agency"], ["recipient_id"], 10, 3)
    return t.join(picked, ["sub_agency", "recipient_id"], "left_semi").groupBy("sub_agency", "recipient_id").agg(money(F.sum("obligation"), "total"))


@query("V19_answer_freshness", "SELECT o_orderstatus, count(*) AS answer, abs(count(*) - (SELECT count(*) FROM orders) / 3.0) <= 0.05 * count(*) AS fresh FROM orders GROUP BY 1")
def v19(spark, sf):
    o = Lake(spark, sf).orders
    stored = o.agg((n_rows() / 3.0).alias("stored"))
    return o.groupBy("o_orderstatus").agg(n_rows().alias("answer")).crossJoin(F.broadcast(stored)).select("o_orderstatus", "answer", (F.abs(F.col("answer") - F.col("stored")) <= 0.05 * F.col("answer")).alias("fresh"))


@query("V20_fact_id_integrity", with_sql("ln", ", f AS (SELECT left(sha256(concat_ws('|', pe_bli, account, edition_year, amount_type, line_id)), 16) AS id FROM ln) SELECT count(*) AS facts, count(*) - count(DISTINCT id) AS repeated FROM f"))
def v20(spark, sf):
    ids = Lake(spark, sf).lines().select(X.row_fact_id(*[F.col(c) for c in ("pe_bli", "account", "edition_year", "amount_type", "line_id")]).alias("id"))
    return ids.agg(n_rows().alias("facts"), (n_rows() - F.countDistinct("id")).alias("repeated"))
