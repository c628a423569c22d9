"""Queries P01-P33: scalar expressions on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from purselake.functions import exprs as X
from purselake.operators import aggs
from purselake.plans.bindings import Lake, with_sql
from purselake.plans.registry import query


@query(
    "P01_type_transactions",
    with_sql("tx", """SELECT transaction_key, award_type, fiscal_year, CAST(obligation AS DOUBLE) AS obligation, upper(nullif(trim(sub_agency), '')) AS sub_agency, CAST(NULL AS VARCHAR) AS registry_id FROM tx"""),
)
def p01(spark, sf):
    t = Lake(spark, sf).transactions()
    return t.select("transaction_key", "award_type", "fiscal_year", F.col("obligation").cast("double").alias("obligation"), F.upper(X.blank_to_null(F.col("sub_agency"))).alias("sub_agency"), F.lit(None).cast("string").alias("registry_id"))


@query(
    "P02_type_budget_lines",
    with_sql("ln", "SELECT line_id, pe_bli, account, organization, edition_year, amount_type, CAST(amount_thousands AS DOUBLE) AS amount_thousands, exhibit = 'R-1' AS reconciled FROM ln"),
)
def p02(spark, sf):
    raw = Lake(spark, sf).lines().withColumn("flag", F.when(F.col("exhibit") == "R-1", "True").otherwise("False"))
    return raw.select("line_id", "pe_bli", "account", "organization", "edition_year", "amount_type", F.col("amount_thousands").cast("string").try_cast("double").alias("amount_thousands"), (F.lower("flag") == "true").alias("reconciled"))


@query("P03_flag_suspect_amount", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice > 90000 OR l_extendedprice > CASE WHEN l_discount > 0.05 THEN 50000 END AS suspect FROM lineitem")
def p03(spark, sf):
    ceiling = F.when(F.col("l_discount") > 0.05, F.lit(50000))
    return Lake(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.flag_suspect_amount(F.col("l_extendedprice"), ceiling, 90000).alias("suspect"))


_CLASSES = {"1-URGENT": "full_and_open", "2-HIGH": "set_aside", "3-MEDIUM": "other_than_full"}
CLASS_SQL = "CASE sub_agency WHEN '1-URGENT' THEN 'full_and_open' WHEN '2-HIGH' THEN 'set_aside' WHEN '3-MEDIUM' THEN 'other_than_full' ELSE 'not_competed' END"


def competed_class(c):
    return X.recode(c, _CLASSES, "not_competed")


@query("P04_competed_class", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'full_and_open' WHEN '2-HIGH' THEN 'set_aside' WHEN '3-MEDIUM' THEN 'other_than_full' ELSE 'not_competed' END AS competed_class FROM orders")
def p04(spark, sf):
    return Lake(spark, sf).orders.select("o_orderkey", competed_class(F.col("o_orderpriority")).alias("competed_class"))


OFFERS = [(1, "1"), (2, "2"), (4, "3-4"), (9, "5-9")]
OFFERS_SQL = "CASE WHEN try_cast(q AS INTEGER) IS NULL OR try_cast(q AS INTEGER) < 1 THEN 'unknown' WHEN try_cast(q AS INTEGER) = 1 THEN '1' WHEN try_cast(q AS INTEGER) = 2 THEN '2' WHEN try_cast(q AS INTEGER) <= 4 THEN '3-4' WHEN try_cast(q AS INTEGER) <= 9 THEN '5-9' ELSE '10+' END"


@query("P05_bucketize", f"WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS q FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, {OFFERS_SQL} AS offers FROM t")
def p05(spark, sf):
    raw = F.when(F.col("l_tax") == 0, "n/a").otherwise(F.col("l_quantity").cast("int").cast("string"))
    return Lake(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.bucketize(raw, OFFERS, "10+").alias("offers"))


@query("P06_coalesce_label", "SELECT event_id, coalesce(upper(nullif(trim(CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END), '')), upper(nullif(trim(CASE WHEN value > 10 THEN 'high value' ELSE '' END), '')), 'UNKNOWN') AS label FROM events")
def p06(spark, sf):
    first = F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type"))
    second = F.when(F.col("value") > 10, "high value").otherwise("")
    return Lake(spark, sf).events.select("event_id", X.coalesce_label("UNKNOWN", first, second).alias("label"))


@query("P07_federal_fiscal_year", "SELECT o_orderkey, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year FROM orders")
def p07(spark, sf):
    return Lake(spark, sf).orders.select("o_orderkey", X.federal_fiscal_year(F.col("o_orderdate")).alias("fiscal_year"))


@query("P08_federal_account", """WITH a AS (SELECT p_partkey, concat(p_partkey % 9000 + 1000, CASE p_size % 6 WHEN 0 THEN 'D' WHEN 1 THEN 'N' WHEN 2 THEN 'A' WHEN 3 THEN 'F' WHEN 4 THEN 'x' ELSE '' END) AS account FROM part)
SELECT p_partkey, concat(CASE upper(regexp_extract(account, '([A-Za-z])$', 1)) WHEN 'D' THEN '097' WHEN 'N' THEN '017' WHEN 'A' THEN '021' WHEN 'F' THEN '057' ELSE '999' END, '-', regexp_replace(account, '[A-Za-z]$', '')) AS federal_account FROM a""")
def p08(spark, sf):
    letter = F.element_at(F.array(*[F.lit(x) for x in ("D", "N", "A", "F", "x", "")]), (F.col("p_size") % 6 + 1).cast("int"))
    account = F.concat((F.col("p_partkey") % 9000 + 1000).cast("string"), letter)
    return Lake(spark, sf).part.select("p_partkey", X.federal_account(account, "999").alias("federal_account"))


_AGENCIES = {"dod": "DOD", "097": "DOD", "dow": "DOD", "irs": "TREASURY", "va": "VA", "2-high": "HHS"}


@query("P09_canonical_agency", """SELECT o_orderkey, coalesce(CASE lower(o_orderpriority) WHEN '2-high' THEN 'HHS' END, upper(o_orderpriority)) AS agency, 'DOD' AS fixed FROM orders""")
def p09(spark, sf):
    return Lake(spark, sf).orders.select("o_orderkey", X.canonical_agency(F.col("o_orderpriority"), _AGENCIES).alias("agency"), X.canonical_agency(F.lit(" 097 "), _AGENCIES).alias("fixed"))


@query("P10_normalize_name", """SELECT s_suppkey, concat('SUPPLIER ', regexp_extract(s_name, '#(.*)$', 1), CASE s_suppkey % 4 WHEN 3 THEN ' DEFENSE SYSTEMS UNITED' ELSE '' END) AS clean FROM supplier""")
def p10(spark, sf):
    tail = F.element_at(F.array(*[F.lit(x) for x in (", L.L.C.", " Mission Systems, Inc.", " Company, The (Inc)", " Defense Systems United Global Corp")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return Lake(spark, sf).supplier.select("s_suppkey", X.normalize_name(F.concat(F.lit("The "), F.col("s_name"), tail)).alias("clean"))


@query("P11_hhi_band", "SELECT p_partkey, CASE WHEN floor(p_retailprice + 0.5) > 1800 THEN 'concentrated' WHEN floor(p_retailprice + 0.5) >= 1000 THEN 'moderate' ELSE 'unconcentrated' END AS band FROM part")
def p11(spark, sf):
    return Lake(spark, sf).part.select("p_partkey", X.hhi_band(F.col("p_retailprice")).alias("band"))


_STOP_SQL = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
TOKENS_SQL = f"list_sort(list_distinct(list_filter(string_split_regex(lower({{}}), '[^a-z0-9]+'), lambda w: length(w) > 3 AND w NOT IN ({_STOP_SQL}))))"


@query("P12_tokens", f"SELECT doc_id, array_to_string({TOKENS_SQL.format('text')}, ' ') AS words FROM documents")
def p12(spark, sf):
    return Lake(spark, sf).documents.select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("words"))


@query("P13_title_jaccard", """WITH p AS (SELECT p_partkey, string_split(trim(p_name), ' ') AS a, string_split(trim(concat(lower(p_type), ' ', p_name)), ' ') AS b FROM part)
SELECT p_partkey, len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b))) AS similarity FROM p""")
def p13(spark, sf):
    other = F.concat(F.col("p_type"), F.lit(" (MOD) "), F.col("p_name"))
    return Lake(spark, sf).part.select("p_partkey", X.title_jaccard(F.col("p_name"), other).alias("similarity"))


@query("P14_contiguous_tokens", "SELECT doc_id, concat(' ', trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), ' ') LIKE '% of the %' AS found FROM documents")
def p14(spark, sf):
    return Lake(spark, sf).documents.select("doc_id", X.contiguous_tokens(F.col("text"), F.lit("of the")).alias("found"))


@query("P15_word_boundary_match", "SELECT doc_id, regexp_matches(text, '(?i)(^|[^A-Za-z0-9])license($|[^A-Za-z0-9])') AS found FROM documents")
def p15(spark, sf):
    return Lake(spark, sf).documents.select("doc_id", X.word_boundary_match(F.col("text"), "license").alias("found"))


@query("P16_labelled_code_match", "SELECT event_id, user_id = 42 AS found, user_id = 42 AS plain FROM events")
def p16(spark, sf):
    e = Lake(spark, sf).events
    text = F.concat(F.lit("see P-1 line item no. "), F.col("user_id").cast("string"), F.lit(", 42.5 and 2042"))
    plain = F.concat(F.lit("code MD"), F.col("user_id").cast("string"), F.lit(" and MD421"))
    return e.select("event_id", X.labelled_code_match(text, "42").alias("found"), X.labelled_code_match(plain, "MD42").alias("plain"))


@query("P17_row_fact_id", with_sql("ln", "SELECT line_id, left(sha256(concat_ws('|', pe_bli, account, CAST(edition_year AS VARCHAR), amount_type)), 16) AS fact_id, CAST(NULL AS VARCHAR) AS no_id FROM ln"))
def p17(spark, sf):
    key = [F.col(c) for c in ("pe_bli", "account", "edition_year", "amount_type")]
    return Lake(spark, sf).lines().select("line_id", X.row_fact_id(*key).alias("fact_id"), X.row_fact_id(key[0], F.lit(None)).alias("no_id"))


@query("P18_keys_digest", with_sql("ln", "SELECT pe_bli, account, sha256(string_agg(title, chr(10) ORDER BY title)) AS digest FROM ln GROUP BY 1, 2"))
def p18(spark, sf):
    return aggs.lines_digest(Lake(spark, sf).lines(), ["pe_bli", "account"], F.col("title"))


@query("P19_is_synthetic_key", with_sql("ln", "SELECT line_id, concat(account, '-', organization, '-L', line_id) AS era_key, TRUE AS synthetic, FALSE AS native FROM ln"))
def p19(spark, sf):
    key = X.mint_key(F.col("account"), F.col("organization"), F.col("line_id"))
    return Lake(spark, sf).lines().select("line_id", key.alias("era_key"), X.is_synthetic_key(key).alias("synthetic"), X.is_synthetic_key(F.col("pe_bli")).alias("native"))


@query("P20_parse_money", "SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN o_orderkey * 1000 + 500 WHEN 1 THEN (o_orderkey % 1000) * 1000000 + 200000 ELSE (o_orderkey % 90) * 1000000000 END AS BIGINT) AS usd FROM orders")
def p20(spark, sf):
    k = F.col("o_orderkey")
    text = (
        F.when(k % 3 == 0, F.concat(F.lit("awarded $"), F.format_number(k * 1000 + 500, 0), F.lit(" on")))
        .when(k % 3 == 1, F.concat(F.lit("a $"), (k % 1000).cast("string"), F.lit(".2 million contract")))
        .otherwise(F.concat(F.lit("worth $"), (k % 90).cast("string"), F.lit(" B")))
    )
    return Lake(spark, sf).orders.select("o_orderkey", X.parse_money(text).alias("usd"))


@query("P21_normalize_award_number", "SELECT c_custkey, replace(replace(c_name, '-', ''), ' ', '') AS clean FROM customer")
def p21(spark, sf):
    return Lake(spark, sf).customer.select("c_custkey", X.normalize_award_number(F.regexp_replace("c_name", "#", "# - ")).alias("clean"))


@query("P22_normalize_service_heading", "SELECT n_nationkey, concat('US ', n_name, ' Dept') AS heading FROM nation")
def p22(spark, sf):
    return Lake(spark, sf).nation.select("n_nationkey", X.normalize_service_heading(F.concat(F.lit(" .*US&nbsp; "), F.col("n_name"), F.lit("&#160;Dept. *"))).alias("heading"))


@query("P23_alnum_words", "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS words FROM documents")
def p23(spark, sf):
    return Lake(spark, sf).documents.select("doc_id", X.alnum_words(F.col("text")).alias("words"))


@query("P24_slugify", "SELECT o_orderkey, trim(regexp_replace(lower(concat(o_orderpriority, ' / ', o_orderstatus, '!')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM orders")
def p24(spark, sf):
    return Lake(spark, sf).orders.select("o_orderkey", X.slugify(F.concat("o_orderpriority", F.lit(" / "), "o_orderstatus", F.lit("!"))).alias("slug"))


@query("P25_render_template", with_sql("ln", "SELECT line_id, concat(regexp_extract(t, '^(.*)%d', 1), edition_year, regexp_extract(t, '%d(.*)$', 1)) AS slug FROM (SELECT *, CASE exhibit WHEN 'R-1' THEN 'fy_%d_actuals' ELSE 'fy_%d_total' END AS t FROM ln)"))
def p25(spark, sf):
    lines = Lake(spark, sf).lines().withColumn("tpl", F.when(F.col("exhibit") == "R-1", "fy_%d_actuals").otherwise("fy_%d_total"))
    return lines.select("line_id", F.expr("format_string(tpl, edition_year)").alias("slug"))


@query("P26_positive_part", with_sql("tx", "SELECT transaction_key, part_id, CAST(greatest(coalesce(obligation, 0), 0) AS DOUBLE) AS positive FROM tx"))
def p26(spark, sf):
    return Lake(spark, sf).transactions(with_order=False).select("transaction_key", "part_id", X.positive_part(F.col("obligation")).cast("double").alias("positive"))


@query("P27_pct_change", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN b <> 0 THEN CAST(round((a - b) * 100 / b, 2) AS DOUBLE) END AS pct FROM (SELECT *, CAST(l_quantity AS DOUBLE) AS a, CASE WHEN l_tax = 0.04 THEN 0 WHEN l_tax <> 0.02 THEN 64.0 END AS b FROM lineitem)")
def p27(spark, sf):
    base = F.when(F.col("l_tax") == 0.04, 0.0).when(F.col("l_tax") != 0.02, 64.0)
    return Lake(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.pct_change(base, F.col("l_quantity")).alias("pct"))


@query("P28_parse_clock", "SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minutes, CAST(dayofweek(ts) AS INTEGER) AS dow, ts + INTERVAL 5 HOUR AS utc FROM events")
def p28(spark, sf):
    clock = F.date_format("ts", "h:mm a")
    return Lake(spark, sf).events.select("event_id", X.parse_clock(clock).alias("minutes"), X.day_of_week(F.col("ts")).alias("dow"), F.to_utc_timestamp("ts", "-05:00").alias("utc"))


@query("P29_next_occurrence", """SELECT event_id, CAST(CAST(ts AS DATE) + CAST(CASE WHEN (user_id % 7 - dayofweek(ts) + 7) % 7 = 0 AND 720 <= hour(ts) * 60 + minute(ts) THEN 7 ELSE (user_id % 7 - dayofweek(ts) + 7) % 7 END AS INTEGER) AS DATE) AS next_date FROM events""")
def p29(spark, sf):
    return Lake(spark, sf).events.select("event_id", X.next_occurrence(F.col("user_id") % 7, F.lit(720), F.col("ts")).alias("next_date"))


@query("P30_in_booking_window", "SELECT event_id, CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-17' AS bookable FROM events")
def p30(spark, sf):
    return Lake(spark, sf).events.select("event_id", X.in_booking_window(F.to_date("ts"), F.to_date(F.lit("2024-01-10")), 7).alias("bookable"))


@query("P31_stale_flag", """SELECT event_id, ((event_type = 'click' AND ts < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 30 MINUTE) OR (event_type = 'view' AND ts < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 60 MINUTE)) AND user_id % 5 < 3 AS stale FROM events""")
def p31(spark, sf):
    status = F.when(F.col("event_type") == "click", "claimed").when(F.col("event_type") == "view", "running").otherwise("done")
    now = F.to_timestamp(F.lit("2024-01-15 12:00:00"))
    return Lake(spark, sf).events.select("event_id", X.stale_flag(status, F.col("ts"), F.col("user_id") % 5, now).alias("stale"))


@query("P32_fold_quote_text", "SELECT doc_id, trim(regexp_replace(translate(concat(text, ' “x” – y'), '‐‑‒–—‘’“”', '-----''''\"\"'), '\\s+', ' ', 'g')) AS folded FROM documents")
def p32(spark, sf):
    return Lake(spark, sf).documents.select("doc_id", X.fold_quote_text(F.concat("text", F.lit(" “x” – y"))).alias("folded"))


@query("P33_announced_value", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0.03 THEN l_extendedprice ELSE 0 END AS announced FROM lineitem")
def p33(spark, sf):
    amounts = F.when(F.col("l_tax") > 0.03, F.array("l_extendedprice", F.lit(1.0))).otherwise(F.array().cast("array<double>"))
    return Lake(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.announced_value(amounts).alias("announced"))
