"""Queries E01-E38: entity resolution, linking, review and reconciliation jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from purselake.functions import exprs as X
from purselake.operators import aggs, linking, narratives, windows
from purselake.plans.bindings import Lake, with_sql
from purselake.plans.marts import XWALK_SQL, crosswalk, n_rows
from purselake.plans.registry import query
from purselake.plans.relational import money
from purselake.plans.scalars import TOKENS_SQL

# E01: keys made clean by number of copies, then the newest kept.


@query("E01_resolve_duplicates", "WITH c AS (SELECT o_orderkey AS k, 1 AS part, o_orderdate AS m FROM orders UNION ALL SELECT o_orderkey, 2, o_orderdate + INTERVAL 400 DAY FROM orders WHERE o_orderkey % 10 = 0) SELECT k, arg_max(part, m) AS part, max(m) AS m FROM c GROUP BY 1")
def e01(spark, sf):
    o = Lake(spark, sf).orders.select(F.col("o_orderkey").alias("k"), F.lit(1).alias("part"), F.col("o_orderdate").alias("m"))
    again = o.filter("k % 10 = 0").select("k", F.lit(2).alias("part"), (F.col("m") + F.expr("INTERVAL 400 DAYS")).alias("m"))
    return linking.resolve_duplicates(o.unionByName(again), ["k"], "part", "m")


_PAIR_SQL = """, r AS (SELECT recipient_id, concat('N', part_id % 5) AS name, nullif(customer_id % 4, 0) AS parent_id, CASE customer_id % 4 WHEN 1 THEN 'P1' WHEN 2 THEN 'P2' END AS parent_name, obligation FROM tx),
k AS (SELECT * FROM r WHERE NOT (recipient_id % 9 = 0 AND coalesce(parent_id, -1) = 1)),
p AS (SELECT *, row_number() OVER (PARTITION BY recipient_id ORDER BY s DESC NULLS LAST, n DESC, parent_name NULLS LAST, parent_id NULLS LAST) AS q FROM (SELECT recipient_id, parent_id, parent_name, sum(obligation) AS s, count(*) AS n FROM k GROUP BY 1, 2, 3)),
m AS (SELECT *, row_number() OVER (PARTITION BY recipient_id ORDER BY s DESC NULLS LAST, name NULLS LAST) AS q FROM (SELECT recipient_id, name, sum(obligation) AS s FROM r GROUP BY 1, 2)),
cw AS (SELECT m.recipient_id, m.name, p.parent_id, p.parent_name, coalesce(p.parent_name, CAST(p.parent_id AS VARCHAR), m.name) AS family_key, CASE WHEN p.parent_name IS NOT NULL THEN 'parent_name' WHEN p.parent_id IS NOT NULL THEN 'parent_id' ELSE 'own_name' END AS method FROM m LEFT JOIN p ON m.recipient_id = p.recipient_id AND p.q = 1 WHERE m.q = 1)"""


def built_crosswalk(lake):
    k = F.col("customer_id") % 4
    rows = lake.transactions().select("recipient_id", F.concat(F.lit("N"), (F.col("part_id") % 5).cast("string")).alias("name"), F.nullif(k, F.lit(0)).alias("parent_id"), F.when(k == 1, "P1").when(k == 2, "P2").alias("parent_name"), "obligation")
    excluded = lake.supplier.filter("s_suppkey % 9 = 0").select(F.col("s_suppkey").alias("recipient_id"), F.lit(1).cast("long").alias("parent_id"))
    return linking.entity_crosswalk(rows, "recipient_id", "name", "parent_id", "parent_name", "obligation", excluded)


@query("E02_build_entity_crosswalk", with_sql("tx", _PAIR_SQL + " SELECT * FROM cw"))
def e02(spark, sf):
    return built_crosswalk(Lake(spark, sf))


@query("E03_cross_parent_downgrade", with_sql("tx xw", XWALK_SQL + " SELECT recipient_id, CASE WHEN count(DISTINCT parent_name) OVER (PARTITION BY left(recipient_name, 17)) > 1 AND confidence = 'high' THEN 'medium' ELSE confidence END AS confidence FROM xk"))
def e03(spark, sf):
    x = crosswalk(Lake(spark, sf)).withColumn("stem", F.substring("recipient_name", 1, 17))
    return linking.cross_parent_downgrade(x, "stem", "parent_name", "confidence").select("recipient_id", "confidence")


@query("E04_curated_exclusion", with_sql("tx", ", p AS (SELECT DISTINCT recipient_id, customer_id % 4 AS parent_id FROM tx) SELECT * FROM p WHERE NOT (recipient_id % 9 = 0 AND parent_id = 1)"))
def e04(spark, sf):
    lake = Lake(spark, sf)
    pairs = lake.transactions().select("recipient_id", (F.col("customer_id") % 4).alias("parent_id")).distinct()
    curated = lake.supplier.filter("s_suppkey % 9 = 0").select(F.col("s_suppkey").alias("recipient_id"), F.lit(1).cast("long").alias("parent_id"))
    absent = curated.join(pairs, ["recipient_id", "parent_id"], "left_anti").join(lake.transactions(with_order=False), "recipient_id", "left_semi")
    if absent.count() == curated.count() and not curated.isEmpty():
        raise ValueError("no curated exclusion bites")
    return pairs.join(curated, ["recipient_id", "parent_id"], "left_anti")


@query("E05_label_margin", with_sql("tx xw", """, s AS (SELECT family_key, recipient_name, sum(greatest(obligation, 0)) AS v FROM tx JOIN xw USING (recipient_id) GROUP BY 1, 2), r AS (SELECT *, lead(v) OVER w AS nxt, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY family_key ORDER BY v DESC, recipient_name))
SELECT family_key, recipient_name, CAST((v - coalesce(nxt, 0)) * 100 AS DOUBLE) / CAST(v AS DOUBLE) < 15 AS close FROM r WHERE n = 1 AND v > 0"""))
def e05(spark, sf):
    s = Lake(spark, sf).family_transactions(with_order=False).filter("family_key IS NOT NULL").groupBy("family_key", "recipient_name").agg(F.sum(X.positive_part(F.col("obligation"))).alias("v"))
    w = Window.partitionBy("family_key").orderBy(F.col("v").desc(), "recipient_name")
    r = s.select("*", F.lead("v").over(w).alias("next"), F.row_number().over(w).alias("n")).filter("n = 1 AND v > 0")
    share = ((F.col("v") - F.coalesce("next", F.lit(0))) * 100).cast("double") / F.col("v").cast("double")
    return r.select("family_key", "recipient_name", (share < 15).alias("close"))


# Clients as filers write them: those of a market segment name the supplier of their nation's
# number in the segment's own way, those in debt file under their own name.
_FILED = """CASE WHEN c_acctbal < 0 THEN c_name WHEN c_mktsegment = 'MACHINERY' THEN concat('The Supplier ', n, ', Inc.') WHEN c_mktsegment = 'BUILDING' THEN concat('SUP ', n)
 WHEN c_mktsegment = 'AUTOMOBILE' THEN concat('Friends of Supplier ', n, ' Group') WHEN c_mktsegment = 'FURNITURE' THEN concat('Supplier Holdings ', n, ' International') ELSE concat('Supplier#', lpad(n, 9, '0')) END"""
_NORM = "trim(regexp_replace(regexp_replace(trim(regexp_replace(upper({}), '[^A-Z0-9 ]+', ' ', 'g')), ' +', ' ', 'g'), '^THE | (INC|LLC)$', '', 'g'))"
_CORE = "trim(regexp_replace(regexp_replace({}, '\\b(HOLDINGS?|GROUP|INTERNATIONAL)\\b', ' ', 'g'), ' +', ' ', 'g'))"
_TIER_SQL = f"""WITH c AS (SELECT c_custkey, {_NORM.format('raw')} AS clean FROM (SELECT c_custkey, {_FILED} AS raw FROM (SELECT *, CAST(c_nationkey AS VARCHAR) AS n FROM customer))),
f AS (SELECT {_NORM.format('s_name')} AS raw, concat('SUPPLIER ', s_suppkey) AS family_key, concat('SUP ', s_suppkey) AS alias FROM supplier),
p AS (SELECT c_custkey, family_key, CASE WHEN clean = family_key THEN 1 WHEN clean = alias THEN 2 WHEN contains(concat(' ', clean, ' '), concat(' ', family_key, ' ')) THEN 3 WHEN clean = f.raw THEN 4 WHEN {_CORE.format('clean')} = family_key THEN 5 END AS r FROM c, f),
b AS (SELECT c_custkey, min(r) AS r, arg_min(family_key, (r, family_key)) AS family_key FROM p WHERE r IS NOT NULL GROUP BY 1)
SELECT c_custkey, b.family_key, CASE r WHEN 1 THEN 'exact_family' WHEN 2 THEN 'curated_alias' WHEN 3 THEN 'normalized' WHEN 4 THEN 'family_raw_name' WHEN 5 THEN 'suffix_residue' ELSE 'none' END AS tier FROM c LEFT JOIN b USING (c_custkey)"""


def client_tiers(lake):
    """Name as filed, family and tier of each client."""
    filed = lake.customer.withColumn("n", F.col("c_nationkey").cast("string")).select("c_custkey", F.expr(_FILED).alias("client_name"))
    number = F.col("s_suppkey").cast("string")
    f = lake.supplier.select(F.concat(F.lit("SUPPLIER "), number).alias("family_key"), F.concat(F.lit("SUP "), number).alias("alias"), "s_name")
    pairs = linking.client_matches(filed, "client_name", f, f.withColumnRenamed("alias", "name"), f.withColumnRenamed("s_name", "name"))
    return linking.best_client_match(filed, "client_name", pairs).select("c_custkey", "client_name", "family_key", "tier")


@query("E06_client_match_tier", _TIER_SQL)
def e06(spark, sf):
    return client_tiers(Lake(spark, sf)).drop("client_name")


# A filing keeps the tier of its day: those of before 1995 were matched by key and alias only.
_STORED = "CASE WHEN year(o_orderdate) >= 1995 OR tier IN ('exact_family', 'curated_alias') THEN tier ELSE 'none' END"


@query("E07_restamp_matches", f"WITH t AS ({_TIER_SQL}) SELECT o_orderkey, tier AS new_tier, {_STORED} IS DISTINCT FROM tier AS changed FROM orders JOIN t ON o_custkey = c_custkey")
def e07(spark, sf):
    lake = Lake(spark, sf)
    j = lake.orders.join(client_tiers(lake), F.col("o_custkey") == F.col("c_custkey"))
    return j.select("o_orderkey", F.col("tier").alias("new_tier"), (~F.expr(_STORED).eqNullSafe(F.col("tier"))).alias("changed"))


#: Names by which sub-agencies go, for each organization.
ALIASES = [("c", "urgent"), ("s", "high"), ("l", "low"), ("l", "not spec"), ("b", "medium")]
_ALIAS_SQL = "al AS (SELECT * FROM (VALUES " + ", ".join(f"('{o}', '{a}')" for o, a in ALIASES) + ") AS t(organization, alias))"
_TX_ACCOUNTS = "CASE WHEN l_tax >= 0.06 AND p_type <> 'PROMO' THEN array(p_type, 'PROMO') ELSE array(p_type) END"


@query("E08_grade_links", f"""WITH {_ALIAS_SQL}, tr AS (SELECT l_orderkey AS award, CAST(year(l_shipdate) AS INTEGER) AS year, {_TX_ACCOUNTS.replace('array(p_type', '[p_type').replace("'PROMO') ELSE", "'PROMO'] ELSE").replace('[p_type) END', '[p_type] END')} AS accounts, {TOKENS_SQL.format("concat(p_name, ' ', p_type)")} AS words, o_orderpriority AS sub_agency, CAST(l_extendedprice AS DECIMAL(18,2)) AS obligation
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 30),
aw AS (SELECT award, account, year, list_distinct(flatten(list(words))) AS aws, list(DISTINCT lower(sub_agency)) AS ag, CAST(sum(obligation) FILTER (WHERE len(accounts) = 1) AS DOUBLE) AS matched_obligation FROM (SELECT *, unnest(accounts) AS account FROM tr) GROUP BY 1, 2, 3),
li AS (SELECT p_brand AS code, p_type AS account, left(p_name, 1) AS organization, CAST(p_size % 10 + 2017 AS INTEGER) - 22 AS year, list_distinct(flatten(list({TOKENS_SQL.format("concat(p_name, ' ', p_type)")}))) AS lw FROM part WHERE (p_partkey // 3) % 3 = 0 GROUP BY 1, 2, 3, 4),
j AS (SELECT *, len(list_intersect(aws, lw)) AS overlap, EXISTS (SELECT 1 FROM al WHERE al.organization = li.organization AND list_has_any([contains(s, al.alias) FOR s IN ag], [TRUE])) AS under FROM aw JOIN li USING (account, year))
SELECT code, account, organization, year, award, CASE WHEN overlap >= 2 THEN 'high' WHEN under THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN overlap >= 2 THEN 'account+tokens' WHEN under THEN 'account+subagency' ELSE 'account' END AS method, CAST(overlap AS INTEGER) AS overlap, matched_obligation FROM j""")
def e08(spark, sf):
    lake = Lake(spark, sf)
    words = X.tokens(F.concat("p_name", F.lit(" "), "p_type"))
    p = lake.part.select("p_partkey", "p_type", words.alias("words"))
    # Orders come last: rows then lie by award, as their groups do.
    li = lake.lineitem.filter("l_quantity > 30").join(p, F.col("l_partkey") == F.col("p_partkey")).join(lake.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    tx = li.select(F.col("l_orderkey").alias("award"), F.year("l_shipdate").alias("year"), F.expr(_TX_ACCOUNTS).alias("accounts"), "words", F.col("o_orderpriority").alias("sub_agency"), F.col("l_extendedprice").cast("decimal(18,2)").alias("obligation"))
    ln = lake.part.filter("floor(p_partkey / 3) % 3 = 0").select(F.col("p_brand").alias("code"), F.col("p_type").alias("account"), F.substring("p_name", 1, 1).alias("organization"), (F.col("p_size") % 10 + 1995).cast("int").alias("year"), words.alias("words"))
    graded = linking.grade_links(ln, tx, spark.createDataFrame(ALIASES, "organization string, alias string"))
    return graded.withColumn("matched_obligation", F.col("matched_obligation").cast("double"))


@query("E09_plan_links", with_sql("ln tx", ", a AS (SELECT fiscal_year, award_type, count(DISTINCT award_id) AS awards FROM tx GROUP BY 1, 2), l AS (SELECT edition_year - 20 AS fiscal_year, count(*) AS lines FROM ln GROUP BY 1) SELECT fiscal_year, award_type, lines, awards, lines * awards AS pairs, lines * awards <= 500000 AS allowed FROM l JOIN a USING (fiscal_year)"))
def e09(spark, sf):
    """Pairs are projected from counts; none is built."""
    lake = Lake(spark, sf)
    a = lake.transactions(with_order=False).groupBy("fiscal_year", "award_type").agg(F.countDistinct("award_id").alias("awards"))
    n = lake.lines().groupBy((F.col("edition_year") - 20).alias("fiscal_year")).agg(n_rows().alias("lines"))
    return n.join(a, "fiscal_year").withColumn("pairs", F.col("lines") * F.col("awards")).withColumn("allowed", F.col("pairs") <= 500_000)


@query("E10_ambiguous_identities", with_sql("ln", "SELECT pe_bli, edition_year FROM ln GROUP BY 1, 2 HAVING count(DISTINCT (organization, account)) > 1"))
def e10(spark, sf):
    return Lake(spark, sf).lines().groupBy("pe_bli", "edition_year").agg(F.countDistinct("organization", "account").alias("n")).filter("n > 1").drop("n")


@query("E11_canonical_line", with_sql("ln", "SELECT pe_bli, account, title FROM (SELECT *, row_number() OVER (PARTITION BY pe_bli, account ORDER BY edition_year DESC, line_id) AS n FROM ln) WHERE n = 1"))
def e11(spark, sf):
    return windows.pick_first(Lake(spark, sf).lines(), ["pe_bli", "account"], [F.col("edition_year").desc(), F.col("line_id")]).select("pe_bli", "account", "title")


@query("E12_scoped_tokens", with_sql("ln", f", w AS (SELECT DISTINCT pe_bli, organization, edition_year, unnest({TOKENS_SQL.format('title')}) AS t FROM ln) SELECT pe_bli, organization, edition_year, string_agg(t, ' ' ORDER BY t) AS words FROM w GROUP BY 1, 2, 3"))
def e12(spark, sf):
    w = Lake(spark, sf).lines().select("pe_bli", "organization", "edition_year", F.explode(X.tokens(F.col("title"))).alias("t"))
    return w.groupBy("pe_bli", "organization", "edition_year").agg(aggs.ordered_join(F.col("t"), " ").alias("words"))


@query("E13_pick_recipient", with_sql("tx", ", s AS (SELECT award_id, recipient_id, sum(obligation) AS v FROM tx GROUP BY 1, 2) SELECT award_id, recipient_id FROM (SELECT *, row_number() OVER (PARTITION BY award_id ORDER BY v DESC, recipient_id) AS n FROM s) WHERE n = 1"))
def e13(spark, sf):
    s = Lake(spark, sf).transactions(with_order=False).groupBy("award_id", "recipient_id").agg(F.sum("obligation").alias("v"))
    return windows.pick_first(s, ["award_id"], [F.col("v").desc(), F.col("recipient_id")]).select("award_id", "recipient_id")


@query("E14_derive_program_links", with_sql("ln", """, c AS (SELECT DISTINCT l_orderkey AS award_id, p_brand AS pe_bli, p_type AS award_account FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT DISTINCT award_id, c.pe_bli, ln.organization FROM c JOIN ln ON c.pe_bli = ln.pe_bli AND c.award_account = ln.account AND ln.edition_year = 2020)
SELECT award_id, pe_bli, min(organization) AS organization FROM m GROUP BY 1, 2 HAVING count(*) = 1"""))
def e14(spark, sf):
    """A code's lines narrowed by the award's account; kept where one member is left."""
    lake = Lake(spark, sf)
    p = lake.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("pe_bli"), F.col("p_type").alias("account"))
    c = lake.lineitem.join(p, "l_partkey").select(F.col("l_orderkey").alias("award_id"), "pe_bli", "account").distinct()
    members = lake.lines().filter("edition_year = 2020").select("pe_bli", "account", "organization").distinct()
    m = c.join(members, ["pe_bli", "account"]).select("award_id", "pe_bli", "organization").distinct()
    return m.groupBy("award_id", "pe_bli").agg(n_rows().alias("n"), F.min("organization").alias("organization")).filter("n = 1").drop("n")


@query("E15_money_color_filter", """WITH j AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE [o_custkey % 7, o_custkey % 5] END AS a, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE [o_orderkey % 6] END AS l FROM orders) SELECT o_orderkey FROM j WHERE l IS NOT NULL AND (a IS NULL OR list_has_any(a, l))""")
def e15(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    award, line = F.when(k % 5 != 0, F.array(c % 7, c % 5)), F.when(k % 11 != 0, F.array(k % 6))
    return Lake(spark, sf).orders.filter(linking.accounts_match(award, line)).select("o_orderkey")


@query("E16_classify_shared_keys", with_sql("ln", "SELECT pe_bli, CASE WHEN count(DISTINCT account) = count(*) THEN 'ACCOUNT' WHEN count(DISTINCT organization) = count(*) THEN 'ORGANIZATION' ELSE 'UNRESOLVED' END AS split_by FROM (SELECT DISTINCT pe_bli, account, organization FROM ln WHERE edition_year = 2021) GROUP BY 1 HAVING count(*) > 1"))
def e16(spark, sf):
    m = Lake(spark, sf).lines().filter("edition_year = 2021").select("pe_bli", "account", "organization").distinct()
    s = m.groupBy("pe_bli").agg(n_rows().alias("n"), F.countDistinct("account").alias("a"), F.countDistinct("organization").alias("o")).filter("n > 1")
    return s.select("pe_bli", linking.first_true([(F.col("a") == F.col("n"), "ACCOUNT"), (F.col("o") == F.col("n"), "ORGANIZATION")], "UNRESOLVED").alias("split_by"))


# Keys of books: a code of brand and initial; some titles are told at length.
_KEY_CODE = "concat(substr(p_brand, 7), substr(p_name, 1, 1))"
_KEY_TITLE = "concat(p_name, CASE WHEN p_size % 3 = 0 THEN ' improved (MOD)' WHEN p_size % 3 = 1 THEN ' (MEMO)' ELSE '' END)"
_RESOLUTIONS = ["10s", "7c"]
_NT = "trim(regexp_replace(regexp_replace(lower({}), '\\((?:mod|memo|adv|lrip)\\)', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("E17_classify_era_keys", f"""WITH k AS (SELECT CAST(p_size % 10 + 2017 AS INTEGER) AS edition, p_type AS account, {_KEY_CODE} AS code, {_KEY_TITLE} AS title, p_partkey % 3 AS kind, CAST(p_retailprice AS DECIMAL(18,2)) AS v FROM part),
er AS (SELECT DISTINCT edition, account, code, title FROM k WHERE edition < 2024), mo AS (SELECT DISTINCT edition, account, code, title FROM k WHERE edition >= 2024),
ti AS (SELECT account, code, list(DISTINCT {_NT.format('title')}) AS ts FROM mo GROUP BY 1, 2),
yr AS (SELECT account, code, CASE kind WHEN 0 THEN edition - 2 ELSE edition - 1 END AS fy, sum(v) FILTER (WHERE kind = 1) AS e, sum(v) FILTER (WHERE kind = 0) AS a FROM k WHERE kind < 2 GROUP BY 1, 2, 3),
co AS (SELECT account, code, count(*) AS total, count(*) FILTER (WHERE greatest(abs(e), abs(a)) < 1000 OR (least(abs(e), abs(a)) * 2 >= greatest(abs(e), abs(a)) AND (e >= 0) = (a >= 0))) AS passed FROM yr WHERE e IS NOT NULL AND a IS NOT NULL GROUP BY 1, 2),
st AS (SELECT edition, code, count(DISTINCT account) > 1 AS sp FROM er GROUP BY 1, 2), sn AS (SELECT code, count(DISTINCT account) > 1 AS sp FROM mo GROUP BY 1),
j AS (SELECT er.*, ts, passed, total, st.sp AS st, sn.sp AS sn, string_split({_NT.format('title')}, ' ') AS own FROM er LEFT JOIN ti USING (account, code) LEFT JOIN co USING (account, code) JOIN st USING (edition, code) LEFT JOIN sn USING (code))
SELECT edition, account, code, title, CASE WHEN code IN ({', '.join(f"'{c}'" for c in _RESOLUTIONS)}) THEN 'CR' WHEN ts IS NULL THEN CASE WHEN sn IS NOT NULL THEN 'R2' ELSE 'H' END WHEN st AND NOT sn THEN 'R3' WHEN list_contains(ts, {_NT.format('title')}) THEN 'A1'
 WHEN list_max([len(list_intersect(list_distinct(own), string_split(t, ' '))) / len(list_distinct(list_concat(own, string_split(t, ' ')))) FOR t IN ts]) >= 0.5 AND total > 0 AND passed * 3 >= total * 2 THEN 'A2' ELSE 'R1' END AS class FROM j""")
def e17(spark, sf):
    p = Lake(spark, sf).part
    k = p.select((F.col("p_size") % 10 + 2017).cast("int").alias("edition"), F.col("p_type").alias("account"), F.expr(_KEY_CODE).alias("code"), F.expr(_KEY_TITLE).alias("title"), (F.col("p_partkey") % 3).alias("kind"), F.col("p_retailprice").cast("decimal(18,2)").alias("amount"))
    keys = k.select("edition", "account", "code", "title").distinct()
    fy = F.when(F.col("kind") == 0, F.col("edition") - 2).otherwise(F.col("edition") - 1)
    amounts = k.filter("kind < 2").select("account", "code", fy.alias("fy"), F.when(F.col("kind") == 0, "actuals").otherwise("enacted").alias("kind"), "amount")
    return linking.classify_era_keys(keys.filter("edition < 2024"), keys.filter("edition >= 2024"), amounts, _RESOLUTIONS)


@query("E18_group_chains", with_sql("ln", "SELECT pe_bli, account, string_agg(DISTINCT title, ',' ORDER BY title) AS titles, CAST(sum(amount_thousands) FILTER (WHERE amount_type LIKE '%actuals') AS DOUBLE) AS actuals, sha256(string_agg(concat_ws('|', edition_year, title, line_id), chr(10) ORDER BY concat_ws('|', edition_year, title, line_id))) AS digest FROM ln GROUP BY 1, 2"))
def e18(spark, sf):
    line = F.concat_ws("|", F.col("edition_year").cast("string"), "title", F.col("line_id").cast("string"))
    ln = Lake(spark, sf).lines()
    chains = ln.groupBy("pe_bli", "account").agg(aggs.ordered_join(F.col("title")).alias("titles"), money(F.sum(F.when(F.col("amount_type").endswith("actuals"), F.col("amount_thousands"))), "actuals"))
    return chains.join(aggs.lines_digest(ln, ["pe_bli", "account"], line), ["pe_bli", "account"])


@query("E19_precision_tally", "SELECT method, confirmed, sampled FROM (SELECT o_orderpriority AS method, year(o_orderdate) AS y, count(*) AS sampled, count(*) FILTER (WHERE o_orderstatus = 'F') AS confirmed, max(year(o_orderdate)) OVER (PARTITION BY o_orderpriority) AS m FROM orders GROUP BY o_orderpriority, year(o_orderdate)) WHERE y = m")
def e19(spark, sf):
    o = Lake(spark, sf).orders.withColumn("y", F.year("o_orderdate"))
    t = o.groupBy(F.col("o_orderpriority").alias("method"), "y").agg(n_rows().alias("sampled"), F.count_if(F.col("o_orderstatus") == "F").alias("confirmed"))
    return windows.tied_top(t, ["method"], [F.col("y").desc()]).drop("y")


@query("E20_stratified_sample", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256(concat('7|', o_orderkey)), o_orderkey) AS n FROM orders) WHERE n <= 20")
def e20(spark, sf):
    return linking.stratified_sample(Lake(spark, sf).orders, ["o_orderpriority"], ["o_orderkey"], 20, 7).select("o_orderpriority", "o_orderkey")


@query("E21_adjudicate_pairs", with_sql("lk", "SELECT pe_bli, award_id, CASE WHEN o_orderstatus = 'F' THEN 'low' WHEN o_orderstatus = 'P' AND award_id % 3 = 0 THEN 'high' WHEN o_orderstatus = 'P' THEN 'medium' ELSE confidence END AS tier FROM lk JOIN orders ON award_id = o_orderkey"))
def e21(spark, sf):
    lake = Lake(spark, sf)
    j = lake.links().join(lake.orders, F.col("award_id") == F.col("o_orderkey"))
    s = F.col("o_orderstatus")
    tier = F.when(s == "F", "low").when((s == "P") & (F.col("award_id") % 3 == 0), "high").when(s == "P", "medium").otherwise(F.col("confidence"))
    return j.select("pe_bli", "award_id", tier.alias("tier"))


@query("E22_residue_queue", "SELECT o_orderkey, o_orderpriority, CAST(floor((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) / 80) AS BIGINT) AS chunk FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_custkey NOT IN (SELECT s_suppkey FROM supplier) AND o_orderstatus <> 'F'")
def e22(spark, sf):
    lake = Lake(spark, sf)
    o = lake.orders.filter("o_orderstatus <> 'F'").join(lake.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").join(lake.supplier, F.col("o_custkey") == F.col("s_suppkey"), "left_anti")
    n = windows.numbered(o.select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], [F.col("o_orderkey")])
    return n.select("o_orderkey", "o_orderpriority", F.floor((F.col("n") - 1) / 80).alias("chunk"))


@query("E23_family_arrivals", """WITH e AS (SELECT o_custkey % 100 AS member, 'from' AS side, o_orderdate AS d, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey % 100, 'to', o_orderdate, o_orderkey FROM orders WHERE o_orderstatus = 'P')
SELECT s_suppkey AS member, side, o_orderkey AS event FROM supplier LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY member ORDER BY CASE side WHEN 'from' THEN 0 ELSE 1 END, d, o_orderkey) AS n FROM e) x ON s_suppkey = member AND n = 1""")
def e23(spark, sf):
    lake = Lake(spark, sf)
    o = lake.orders.filter(F.col("o_orderstatus").isin("F", "P"))
    e = o.select((F.col("o_custkey") % 100).alias("member"), F.when(F.col("o_orderstatus") == "F", "from").otherwise("to").alias("side"), "o_orderdate", F.col("o_orderkey").alias("event"))
    first = windows.pick_first(e, ["member"], [F.when(F.col("side") == "from", 0).otherwise(1), F.col("o_orderdate"), F.col("event")])
    return lake.supplier.select(F.col("s_suppkey").alias("member")).join(first.drop("o_orderdate"), "member", "left")


@query("E24_member_measure", with_sql("ln", "SELECT account, pe_bli, count(DISTINCT title) AS titles, string_agg(DISTINCT CAST(edition_year AS VARCHAR), ',' ORDER BY CAST(edition_year AS VARCHAR)) AS editions, sha256(string_agg(CAST(line_id AS VARCHAR), chr(10) ORDER BY CAST(line_id AS VARCHAR))) AS digest FROM ln GROUP BY 1, 2"))
def e24(spark, sf):
    ln = Lake(spark, sf).lines()
    members = ln.groupBy("account", "pe_bli").agg(F.countDistinct("title").alias("titles"), aggs.ordered_join(F.col("edition_year").cast("string")).alias("editions"))
    return members.join(aggs.lines_digest(ln, ["account", "pe_bli"], F.col("line_id")), ["account", "pe_bli"])


@query("E25_family_history", with_sql("tx xw", """, y AS (SELECT family_key, fiscal_year, sum(obligation) AS v FROM tx JOIN xw USING (recipient_id) GROUP BY 1, 2), c AS (SELECT family_key, max(fiscal_year) - min(fiscal_year) + 1 = count(*) AS complete FROM y GROUP BY 1)
SELECT family_key, fiscal_year, CAST(v AS DOUBLE) AS v, CASE WHEN complete THEN CAST(sum(v) OVER (PARTITION BY family_key ORDER BY fiscal_year ROWS UNBOUNDED PRECEDING) AS DOUBLE) END AS cumulative FROM y JOIN c USING (family_key)"""))
def e25(spark, sf):
    y = Lake(spark, sf).family_transactions(with_order=False).filter("family_key IS NOT NULL").groupBy("family_key", "fiscal_year").agg(F.sum("obligation").alias("v"))
    part = Window.partitionBy("family_key")
    complete = F.max("fiscal_year").over(part) - F.min("fiscal_year").over(part) + 1 == F.count(F.lit(1)).over(part)
    running = F.sum("v").over(part.orderBy("fiscal_year").rowsBetween(Window.unboundedPreceding, 0))
    return y.select("family_key", "fiscal_year", money(F.col("v"), "v"), F.when(complete, running.cast("double")).alias("cumulative"))


@query("E26_reconcile_details", """WITH d AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN s IS NULL AND o_totalprice < 50000 THEN 'absent' WHEN s IS NULL THEN 'missing' WHEN abs(s - CAST(o_totalprice AS DECIMAL(18,2))) <= 10000 THEN 'matches' ELSE 'differs' END AS verdict FROM orders LEFT JOIN d ON o_orderkey = l_orderkey""")
def e26(spark, sf):
    lake = Lake(spark, sf)
    d = lake.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("s"))
    j = lake.orders.join(d, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rules = [(F.col("s").isNull() & (F.col("o_totalprice") < 50000), "absent"), (F.col("s").isNull(), "missing"), (F.abs(F.col("s") - F.col("o_totalprice").cast("decimal(18,2)")) <= 10000, "matches")]
    return j.select("o_orderkey", linking.first_true(rules, "differs").alias("verdict"))


@query("E27_extraction_gaps", with_sql("ln", "SELECT DISTINCT pe_bli, account FROM ln a WHERE exhibit = 'P-1' AND NOT EXISTS (SELECT 1 FROM ln b WHERE b.exhibit = 'R-1' AND a.pe_bli = b.pe_bli AND a.account = b.account)"))
def e27(spark, sf):
    ln = Lake(spark, sf).lines()
    return ln.filter("exhibit = 'P-1'").join(ln.filter("exhibit = 'R-1'"), ["pe_bli", "account"], "left_anti").select("pe_bli", "account").distinct()


@query("E28_trace_chain", with_sql("ln lk", """, k AS (SELECT DISTINCT pe_bli, account FROM ln), d AS (SELECT DISTINCT pe_bli, account FROM ln WHERE exhibit = 'R-1'), l AS (SELECT DISTINCT pe_bli FROM lk WHERE confidence = 'high'), a AS (SELECT DISTINCT pe_bli FROM lk JOIN lineitem ON award_id = l_orderkey WHERE l_quantity > 49)
SELECT pe_bli, account, CASE WHEN d.account IS NULL THEN 'detail' WHEN l.pe_bli IS NULL THEN 'link' WHEN a.pe_bli IS NULL THEN 'award' END AS first_missing FROM k LEFT JOIN d USING (pe_bli, account) LEFT JOIN l USING (pe_bli) LEFT JOIN a USING (pe_bli)""".replace("CASE WHEN d.account IS NULL", "CASE WHEN NOT EXISTS (SELECT 1 FROM d x WHERE x.pe_bli = k.pe_bli AND x.account = k.account)").replace("SELECT pe_bli, account, CASE", "SELECT k.pe_bli, k.account, CASE").replace("LEFT JOIN d USING (pe_bli, account) LEFT JOIN l USING (pe_bli) LEFT JOIN a USING (pe_bli)", "LEFT JOIN l ON l.pe_bli = k.pe_bli LEFT JOIN a ON a.pe_bli = k.pe_bli")))
def e28(spark, sf):
    lake = Lake(spark, sf)
    ln, lk = lake.lines(), lake.links()
    yes = F.lit(True)
    k = ln.select("pe_bli", "account").distinct()
    d = ln.filter("exhibit = 'R-1'").select("pe_bli", "account").distinct().withColumn("d", yes)
    h = lk.filter("confidence = 'high'").select("pe_bli").distinct().withColumn("h", yes)
    a = lk.join(lake.lineitem.filter("l_quantity > 49"), F.col("award_id") == F.col("l_orderkey"), "left_semi").select("pe_bli").distinct().withColumn("a", yes)
    j = k.join(d, ["pe_bli", "account"], "left").join(h, "pe_bli", "left").join(a, "pe_bli", "left")
    return j.select("pe_bli", "account", linking.first_true([(F.col("d").isNull(), "detail"), (F.col("h").isNull(), "link"), (F.col("a").isNull(), "award")], None).alias("first_missing"))


@query("E29_carry_forward_acceptance", "SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS inherits FROM orders")
def e29(spark, sf):
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    accepted = F.last(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")), ignorenulls=True).over(w)
    return Lake(spark, sf).orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", accepted).alias("inherits"))


_WL = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_ASSESS = "concat(split_part(p_name, ' ', 2), ' ', p_type)", "concat('New ', p_name, ' ', p_type, ' Mk', CAST(p_size AS STRING), ' (Block I)')"


@query("E30_gao_candidates", f"""WITH t AS (SELECT DISTINCT left(p_name, 1) AS organization, concat(p_name, ' ', p_type) AS title FROM part), a AS (SELECT p_partkey AS assessment_id, left(p_name, 1) AS organization, unnest([{_ASSESS[0]}, {_ASSESS[1]}]) AS name FROM part),
m AS (SELECT DISTINCT assessment_id, organization, trim(regexp_replace(name, '\\s*\\([^()]*\\)\\s*$', '')) AS term FROM a),
w AS (SELECT assessment_id, organization, title, term, {_WL.format('title')} AS tw, {_WL.format('term')} AS mw FROM t JOIN m USING (organization)), p AS (SELECT *, concat(' ', array_to_string(tw, ' '), ' ') AS tp, concat(' ', array_to_string(mw, ' '), ' ') AS mp FROM w)
SELECT assessment_id, organization, title, term, CASE WHEN len(mw) > 0 AND contains(tp, mp) THEN 'A' ELSE 'B' END AS rule FROM p WHERE (len(mw) > 0 AND contains(tp, mp)) OR (len(tw) >= 3 AND contains(mp, tp))""")
def e30(spark, sf):
    """Terms in titles and titles of three words in terms, each looked up by its rarest word."""
    p = Lake(spark, sf).part
    org = F.substring("p_name", 1, 1).alias("organization")
    titles = p.select(org, F.concat_ws(" ", "p_name", "p_type").alias("title"))
    assessments = p.select(F.col("p_partkey").alias("assessment_id"), org, F.expr(_ASSESS[0]).alias("common_name"), F.expr(_ASSESS[1]).alias("program_name"))
    return narratives.assessment_candidates(titles, assessments, "organization", "title", "assessment_id", ["common_name", "program_name"])


@query("E31_crosswalk_precision", "WITH c AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0), v AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS ok FROM orders WHERE o_orderkey % 3 = 0) SELECT count(*) FILTER (WHERE c.k IS NOT NULL AND ok) AS accepted, count(*) FILTER (WHERE c.k IS NOT NULL AND NOT ok) AS rejected, count(*) FILTER (WHERE v.k IS NULL) AS unadjudicated, count(*) FILTER (WHERE c.k IS NULL) AS stale FROM c FULL JOIN v ON c.k = v.k")
def e31(spark, sf):
    o = Lake(spark, sf).orders
    c = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.lit(True).alias("c"))
    v = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") == "F").alias("ok"))
    return c.join(v, "k", "full_outer").agg(F.count_if(F.col("c") & F.col("ok")).alias("accepted"), F.count_if(F.col("c") & ~F.col("ok")).alias("rejected"), F.count_if(F.col("ok").isNull()).alias("unadjudicated"), F.count_if(F.col("c").isNull()).alias("stale"))


@query("E32_high_risk_mapping", "SELECT p_partkey, s_suppkey AS agency FROM part LEFT JOIN supplier ON lower(concat('part’s ', p_partkey % 200)) = lower(concat('part’s ', s_suppkey))")
def e32(spark, sf):
    lake = Lake(spark, sf)
    a = lake.part.select("p_partkey", F.lower(X.fold_quote_text(F.concat(F.lit("Part’s  "), (F.col("p_partkey") % 200).cast("string")))).alias("t"))
    b = lake.supplier.select(F.col("s_suppkey").alias("agency"), F.lower(F.concat(F.lit("part's "), F.col("s_suppkey").cast("string"))).alias("t"))
    return a.join(b, "t", "left").drop("t")


@query("E33_link_coverage", with_sql("tx", ", c AS (SELECT sub_agency, CASE WHEN quantity > 40 THEN 'a' WHEN quantity > 20 THEN 'b' WHEN quantity > 5 THEN 'c' ELSE 'd' END AS class FROM tx) SELECT sub_agency, class, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY sub_agency) AS share FROM c GROUP BY 1, 2"))
def e33(spark, sf):
    q = F.col("quantity")
    c = Lake(spark, sf).transactions().select("sub_agency", linking.first_true([(q > 40, "a"), (q > 20, "b"), (q > 5, "c")], "d").alias("class"))
    n = c.groupBy("sub_agency", "class").agg(n_rows().alias("n"))
    return n.withColumn("share", windows.share_of_total("n", ["sub_agency"]))


_FORMS_SQL = "SELECT code, account, code AS token, 'literal' AS form, [code, regexp_replace(code, '^[0-9]{{4}}([A-Z])', '\\1')] AS own FROM {0} UNION ALL SELECT code, account, regexp_replace(code, '^[0-9]{{4}}([A-Z])', '\\1'), 'short', [code, regexp_replace(code, '^[0-9]{{4}}([A-Z])', '\\1')] FROM {0} WHERE regexp_matches(code, '^[0-9]{{4}}[A-Z]') AND length(code) >= 9"


@query("E34_successor_search", with_sql("nv nc it", f""", era AS (SELECT DISTINCT code, account FROM it WHERE edition_year < 2024 AND (code, account) NOT IN (SELECT (code, account) FROM it WHERE edition_year >= 2024)), cur AS (SELECT DISTINCT code, account FROM it WHERE edition_year >= 2024),
ef AS ({_FORMS_SQL.format('era')}), cf AS ({_FORMS_SQL.format('cur')}),
t AS (SELECT narrative_id, fiscal_year, clause_no, unnest(list_distinct([w FOR w IN regexp_extract_all(clause, '\\b[A-Z0-9]{{5,}}\\b') IF regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[0-9]')])) AS token FROM nc WHERE regexp_matches(lower(clause), '{"|".join(narratives.CONTINUATIONS)}')),
o AS (SELECT * FROM t JOIN ef USING (token)), j AS (SELECT DISTINCT o.narrative_id, o.fiscal_year, o.clause_no, o.code, o.account, o.form, o.token, cf.code AS sc, cf.account AS sa FROM o JOIN t USING (narrative_id, clause_no) JOIN cf ON cf.token = t.token WHERE NOT list_contains(o.own, t.token)),
g AS (SELECT narrative_id, fiscal_year, clause_no, code, account, form, token, count(*) FILTER (WHERE sa = account) AS n_same, count(*) AS n, min(sc) FILTER (WHERE sa = account) AS c_same, min(sc) AS c, min(sa) AS a FROM j GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY code, account ORDER BY form = 'literal' DESC, fiscal_year DESC, narrative_id, clause_no, token) AS r FROM g WHERE n_same = 1 OR (n_same = 0 AND n = 1))
SELECT code, account, CASE WHEN n_same = 1 THEN c_same ELSE c END AS successor_code, CASE WHEN n_same = 1 THEN account ELSE a END AS successor_account, form AS matched_form, narrative_id, clause_no FROM k WHERE r = 1"""))
def e34(spark, sf):
    """Codes that later editions do not list, in clauses that tell of a continuation."""
    lake = Lake(spark, sf)
    items = lake.items()
    current = items.filter("edition_year >= 2024").select("code", "account").distinct()
    vanished = items.filter("edition_year < 2024").select("code", "account").distinct().join(current, ["code", "account"], "left_anti")
    return narratives.successors(vanished, current, lake.narratives(), "narrative_id", "fiscal_year", "body")


@query("E35_contradictory_claims", "SELECT o_orderkey, o_custkey FROM (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE before IS NOT NULL AND before <> o_orderpriority")
def e35(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return Lake(spark, sf).orders.withColumn("before", F.lag("o_orderpriority").over(w)).filter("before IS NOT NULL AND before <> o_orderpriority").select("o_orderkey", "o_custkey")


@query("E36_canonical_org", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'EC' WHEN 'PROMO' THEN 'PR' ELSE p_type END AS org FROM part")
def e36(spark, sf):
    names = spark.createDataFrame([("ECONOMY", "EC"), ("PROMO", "PR")], "p_type string, org string")
    return Lake(spark, sf).part.join(F.broadcast(names), "p_type", "left").select("p_partkey", F.coalesce("org", "p_type").alias("org"))


@query("E37_display_alias_overlay", "SELECT n_nationkey, CASE WHEN n_nationkey IN (3, 7) THEN concat('Alias ', n_nationkey) ELSE n_name END AS name FROM nation")
def e37(spark, sf):
    n = Lake(spark, sf).nation
    alias = spark.createDataFrame([(3, "Alias 3"), (7, "Alias 7")], "n_nationkey int, alias string")
    if not alias.join(n, "n_nationkey", "left_anti").isEmpty():
        raise ValueError("an alias names an unknown key")
    return n.join(F.broadcast(alias), "n_nationkey", "left").select("n_nationkey", F.coalesce("alias", "n_name").alias("name"))


@query("E38_classify_exclusions", with_sql("ln", "SELECT line_id, CASE WHEN line_id % 50 = 0 THEN 'override' WHEN regexp_matches(pe_bli, '#[0-9]$') THEN 'numeric_index' WHEN edition_year = 2017 THEN 'edition_specific' ELSE 'undecidable' END AS rule FROM ln"))
def e38(spark, sf):
    rules = [(F.col("line_id") % 50 == 0, "override"), (F.col("pe_bli").rlike("#[0-9]$"), "numeric_index"), (F.col("edition_year") == 2017, "edition_specific")]
    return Lake(spark, sf).lines().select("line_id", linking.first_true(rules, "undecidable").alias("rule"))
