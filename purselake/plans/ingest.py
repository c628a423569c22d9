"""Queries S01-S19 (sources and sinks) and R01-R05 (streams).

Written tables go to the shared folder: ``spark.checkpoint.dir`` or a folder of our own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F


from purselake.plans.bindings import Lake, with_sql
from purselake.plans.marts import published
from purselake.plans.registry import query
from purselake.plans.relational import money
from purselake.schedule import jobs as schedule_jobs
from purselake.sources import lake as io
from purselake.streaming import jobs as streams


def scratch(spark, label: str) -> str:
    return f"{io.shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@query("S01_read_partitioned_lake", "SELECT CAST(year(o_orderdate) AS INTEGER) AS fy, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, TRUE AS named FROM orders GROUP BY 1")
def s01(spark, sf):
    path = scratch(spark, "lake")
    Lake(spark, sf).orders.withColumn("fy", F.year("o_orderdate")).write.partitionBy("fy").option("compression", "zstd").parquet(path)
    df = io.read_partitioned_lake(spark, path)
    return df.groupBy("fy").agg(F.count(F.lit(1)).alias("n"), money(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), "total"), F.bool_and(F.col("source_file").endswith(".parquet")).alias("named"))


@query("S02_read_tables", "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'orders', count(*) FROM orders")
def s02(spark, sf):
    t = io.read_tables(spark, sf, ["nation", "orders"])
    a, b = (t[n].agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(n)) for n in ("nation", "orders"))
    return a.unionByName(b)


@query("S03_read_optional", "SELECT s_suppkey, CAST(NULL AS VARCHAR) AS registered_name FROM supplier")
def s03(spark, sf):
    registry = io.read_optional(spark, f"{sf}/no_such_registry.parquet", "s_suppkey long, registered_name string")
    return Lake(spark, sf).supplier.join(registry, "s_suppkey", "left").select("s_suppkey", "registered_name")


@query("S04_csv_to_parquet", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, 2024 AS fy FROM customer")
def s04(spark, sf):
    csv, path = scratch(spark, "csv"), scratch(spark, "lake")
    Lake(spark, sf).customer.select("c_custkey", "c_name").write.csv(csv, header=True)
    io.csv_to_parquet(spark, csv, path, "fy", 2024, ["c_custkey"])
    return spark.read.parquet(path)


@query("S05_require_columns", "SELECT p_partkey, p_brand FROM part")
def s05(spark, sf):
    return io.require_columns(Lake(spark, sf).part, ["p_partkey", "p_brand"]).select("p_partkey", "p_brand")


@query("S06_guarded_overwrite", "SELECT CAST(year(o_orderdate) AS INTEGER) AS fy, count(*) FILTER (WHERE year(o_orderdate) <> 1996 OR o_orderkey % 10 > 0) AS n FROM orders GROUP BY 1")
def s06(spark, sf):
    path = scratch(spark, "guarded")
    o = Lake(spark, sf).orders.select("o_orderkey", F.year("o_orderdate").alias("fy"))
    io.guarded_overwrite(o, path, "fy")
    io.guarded_overwrite(o.filter("fy = 1996 AND o_orderkey % 10 > 0"), path, "fy")
    try:
        io.guarded_overwrite(o.filter("fy = 1997 AND o_orderkey % 10 = 0"), path, "fy")
    except io.RetentionError:
        pass
    return spark.read.parquet(path).groupBy("fy").agg(F.count(F.lit(1)).alias("n"))


@query("S07_ndjson_to_parquet", "SELECT event_id, event_type FROM events")
def s07(spark, sf):
    source, path = scratch(spark, "json"), scratch(spark, "table")
    Lake(spark, sf).events.select("event_id", "event_type").write.json(source)
    io.ndjson_to_parquet(spark, source, path, "event_id long, event_type string")
    return spark.read.parquet(path)


@query("S08_load_seed", "SELECT o_orderkey, concat(n_name, '*') AS label FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def s08(spark, sf):
    lake, path = Lake(spark, sf), scratch(spark, "seed")
    lake.nation.select("n_nationkey", F.concat("n_name", F.lit("*")).alias("label")).coalesce(1).write.csv(path, header=True)
    seed = F.broadcast(io.load_seed(spark, path, ["n_nationkey", "label"]))
    j = lake.orders.join(lake.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.join(seed, j.c_nationkey.cast("string") == seed.n_nationkey).select("o_orderkey", "label")


@query("S09_partition_refresh_review", """WITH a AS (SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_orderkey % 10 < 9), b AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 10 > 0)
SELECT (SELECT count(*) FROM a) AS prev_rows, (SELECT count(*) FROM b) AS staged_rows, count(*) FILTER (WHERE b.o_orderkey IS NULL) AS retired, count(*) FILTER (WHERE a.o_orderkey IS NULL) AS added, count(*) FILTER (WHERE a.o_orderstatus <> b.o_orderstatus) AS revised, TRUE AS retained FROM a FULL JOIN b USING (o_orderkey)""")
def s09(spark, sf):
    o = Lake(spark, sf).orders.select("o_orderkey", "o_orderdate", "o_orderstatus")
    staged = o.filter("o_orderkey % 10 > 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    r = io.partition_refresh_review(o.filter("o_orderkey % 10 < 9"), staged, "o_orderkey", "o_orderdate", ["o_orderstatus"])
    return r.select("prev_rows", "staged_rows", "retired", "added", "revised", "retained")


_RAW = "SELECT n_name, c_mktsegment, year(o_orderdate) AS y, CASE WHEN o_orderkey % 20 = 0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amt FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def raw_checkbook(lake):
    j = lake.orders.join(lake.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(lake.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select("o_orderkey", "n_name", "c_mktsegment", F.year("o_orderdate").cast("string").alias("y"), F.when(F.col("o_orderkey") % 20 == 0, "n/a").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("amt"))


_NAMES = {"department": "n_name", "category": "c_mktsegment", "fiscal_year": "y", "amount_usd": "amt"}


@query("S10_checkbook_ingest_csv", f"SELECT n_name AS department, c_mktsegment AS category, CAST(y AS VARCHAR) AS fiscal_year, CAST(sum(coalesce(try_cast(amt AS DECIMAL(20,2)), 0)) AS DOUBLE) AS amount_usd FROM ({_RAW}) GROUP BY 1, 2, 3")
def s10(spark, sf):
    path = scratch(spark, "checkbook")
    raw_checkbook(Lake(spark, sf)).write.csv(path, header=True)
    rows = io.checkbook_rows(spark.read.csv(path, header=True), _NAMES, 0.0)
    return rows.groupBy("department", "category", "fiscal_year").agg(money(F.sum("amount_usd"), "amount_usd"))


@query("S11_checkbook_ingest_json", f"SELECT n_name AS department, count(*) AS n, CAST(sum(try_cast(amt AS DECIMAL(20,2))) AS DOUBLE) AS amount_usd FROM ({_RAW}) GROUP BY 1")
def s11(spark, sf):
    path = scratch(spark, "checkbook")
    raw_checkbook(Lake(spark, sf)).write.json(path)
    rows = io.checkbook_rows(spark.read.json(path, schema="n_name string, c_mktsegment string, y string, amt string"), _NAMES, None)
    return rows.groupBy("department").agg(F.count(F.lit(1)).alias("n"), money(F.sum("amount_usd"), "amount_usd"))


@query("S12_population_unpivot", "SELECT c_nationkey AS state, CAST(y AS INTEGER) AS year, n AS population FROM (SELECT c_nationkey, unnest([2020, 2021]) AS y, unnest([count(*), nullif(count(*) FILTER (WHERE c_acctbal < 0), 0)]) AS n FROM customer GROUP BY 1) WHERE n IS NOT NULL")
def s12(spark, sf):
    wide = Lake(spark, sf).customer.groupBy(F.col("c_nationkey").alias("state")).agg(F.count(F.lit(1)).alias("POPESTIMATE2020"), F.nullif(F.count_if(F.col("c_acctbal") < 0), F.lit(0)).alias("POPESTIMATE2021"))
    return io.unpivot_years(wide, ["state"], "POPESTIMATE", "year", "population")


@query("S13_rollup_melt", "SELECT p_brand, t AS amount_type, CAST(arg_max(a, p_partkey) AS DOUBLE) AS amount FROM (SELECT p_partkey, p_brand, 'fy_2025_actuals' AS t, p_retailprice AS a FROM part UNION ALL SELECT p_partkey, p_brand, 'fy_2026_total_request', CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) END FROM part) WHERE a IS NOT NULL GROUP BY 1, 2")
def s13(spark, sf):
    sheet = Lake(spark, sf).part.select("p_partkey", "p_brand", F.col("p_retailprice").alias("FY 2025 Actuals"), F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("FY 2026 Total (Request)"))
    return io.rollup_melt(sheet, ["p_brand"], "p_partkey")


@query("S14_export_current_facts", "SELECT o_orderkey, c_custkey AS document_id, c_name AS title, concat('a', o_orderkey % 3, ',b') AS tags FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F'")
def s14(spark, sf):
    lake = Lake(spark, sf)
    facts = lake.orders.select("o_orderkey", F.col("o_custkey").alias("document_id"), (F.col("o_orderstatus") == "F").alias("superseded"), F.array(F.concat(F.lit("a"), (F.col("o_orderkey") % 3).cast("string")), F.lit("b")).alias("tags"))
    docs = lake.customer.select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("title"))
    return io.current_facts(facts, docs, "document_id", ["tags"])


_HEADS = "|".join(x.replace(".", "\\.") for x in io.SERVICES)
_BEFORE = "lower(right(z[i], 30))"


@query("S15_announcement_records", with_sql("an", f""", p AS (SELECT page_id, unnest(ps) AS raw, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS pos, m, d, y FROM (SELECT page_id, regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1) AS ps, lower(regexp_extract(html, '{io.DATED_TITLE}', 1)) AS m, regexp_extract(html, '{io.DATED_TITLE}', 2) AS d, regexp_extract(html, '{io.DATED_TITLE}', 3) AS y FROM an)),
b AS (SELECT page_id, pos, CASE WHEN y <> '' AND strpos('{io.MONTHS}', m) > 0 THEN concat(y, '-', lpad(CAST((strpos('{io.MONTHS}', m) + 2) // 3 AS VARCHAR), 2, '0'), '-', lpad(d, 2, '0')) END AS date, trim(regexp_replace(regexp_replace(raw, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM p),
h AS (SELECT *, upper(regexp_replace(body, '[ *]+$', '')) AS nm FROM b), g AS (SELECT *, length(nm) < 60 AND regexp_matches(nm, '^(?:{_HEADS})') AND NOT contains(body, '$') AS head FROM h),
s AS (SELECT *, last_value(CASE WHEN head THEN regexp_replace(nm, '\\.+$', '') END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS service FROM g),
n AS (SELECT *, regexp_extract_all(body, '{io.CONTRACT_NUMBER}') AS ns, string_split_regex(body, '{io.CONTRACT_NUMBER}') AS z, regexp_extract_all(body, '{io.MONEY}', 1) AS am, regexp_extract_all(body, '{io.MONEY}', 2) AS un FROM s WHERE NOT head)
SELECT page_id, pos, date, service, left(regexp_replace(split_part(body, ',', 1), '^[ *]+|[ *]+$', '', 'g'), 120) AS contractor,
 array_to_string([concat(CASE WHEN contains(right({_BEFORE}, 12), 'contract ') OR contains({_BEFORE}, 'to contract') THEN 'referenced:' ELSE 'award:' END, regexp_replace(ns[i], '[- ]', '', 'g')) FOR i IN range(1, len(ns) + 1)], ',') AS contract_numbers,
 array_to_string(list_slice([CAST(CAST(round(CAST(replace(am[i], ',', '') AS DECIMAL(20,4)) * CASE lower(un[i]) WHEN 'million' THEN 1000000 WHEN 'billion' THEN 1000000000 ELSE 1 END) AS BIGINT) AS VARCHAR) FOR i IN range(1, len(am) + 1)], 1, 4), ',') AS amounts, body FROM n WHERE len(ns) > 0"""))
def s15(spark, sf):
    return io.announcement_records(Lake(spark, sf).announcements(), "page_id", "html")


@query("S16_filing_dollar_normalize", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE CAST(CAST(floor(CAST(o_totalprice AS DECIMAL(18,2)) + 0.5) AS BIGINT) AS VARCHAR) END AS usd FROM orders")
def s16(spark, sf):
    raw = F.when(F.col("o_orderkey") % 9 == 0, "none").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return Lake(spark, sf).orders.select("o_orderkey", io.whole_dollars(raw).alias("usd"))


@query("S17_schedule_upsert", """WITH a AS (SELECT user_id AS k, CAST(max(ts) AS DATE) AS day, count(*) AS spots, min(event_id) AS opens FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id AS k, CAST(max(ts) AS DATE) AS day, count(*) AS spots, CASE WHEN user_id % 2 = 0 THEN max(event_id) END AS opens FROM events WHERE event_type = 'view' AND user_id % 3 > 0 GROUP BY 1)
SELECT * FROM (SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.k IS NULL THEN a.day ELSE b.day END AS day, CASE WHEN b.k IS NULL THEN a.spots ELSE b.spots END AS spots, coalesce(b.opens, a.opens) AS opens FROM a FULL JOIN b ON a.k = b.k) WHERE day >= DATE '2024-01-28'""")
def s17(spark, sf):
    e = Lake(spark, sf).events

    def slots(df, opens):
        return df.groupBy(F.col("user_id").alias("k")).agg(F.to_date(F.max("ts")).alias("day"), F.count(F.lit(1)).alias("spots"), opens.alias("opens"))

    old = slots(e.filter("event_type = 'click'"), F.min("event_id"))
    new = slots(e.filter("event_type = 'view' AND user_id % 3 > 0"), F.max(F.when(F.col("user_id") % 2 == 0, F.col("event_id"))))
    return schedule_jobs.upsert(old, new, ["k"], "opens", F.to_date(F.lit("2024-01-28")), "day")


@query("S18_guarded_link_upsert", with_sql("lk", """, a AS (SELECT pe_bli, award_id, CASE WHEN award_id % 2 = 0 THEN 'tokens' ELSE 'manual' END AS method, 1 AS score FROM lk WHERE award_id % 3 > 0), b AS (SELECT pe_bli, award_id, 'tokens' AS method, 2 AS score FROM lk WHERE award_id % 5 > 0)
SELECT coalesce(a.pe_bli, b.pe_bli) AS pe_bli, coalesce(a.award_id, b.award_id) AS award_id, CASE WHEN a.pe_bli IS NULL OR (b.pe_bli IS NOT NULL AND a.method = 'tokens') THEN b.method ELSE a.method END AS method, CASE WHEN a.pe_bli IS NULL OR (b.pe_bli IS NOT NULL AND a.method = 'tokens') THEN b.score ELSE a.score END AS score,
CASE WHEN a.pe_bli IS NULL THEN 'inserted' WHEN b.pe_bli IS NULL THEN 'kept' WHEN a.method = 'tokens' THEN 'updated' ELSE 'skipped' END AS action FROM a FULL JOIN b ON a.pe_bli = b.pe_bli AND a.award_id = b.award_id"""))
def s18(spark, sf):
    k = Lake(spark, sf).links().select("pe_bli", "award_id")
    a = k.filter("award_id % 3 > 0").withColumn("method", F.when(F.col("award_id") % 2 == 0, "tokens").otherwise("manual")).withColumn("score", F.lit(1))
    b = k.filter("award_id % 5 > 0").withColumn("method", F.lit("tokens")).withColumn("score", F.lit(2))
    return io.guarded_link_upsert(a, b, ["pe_bli", "award_id"], ["tokens"])


@query("S19_regrade_updates", with_sql("lk", "SELECT pe_bli, award_id, confidence AS from_tier, CASE WHEN award_id % 4 = 0 THEN 'low' ELSE confidence END AS to_tier FROM lk WHERE award_id % 4 = 0 AND confidence IN ('high', 'medium')"))
def s19(spark, sf):
    old = published(Lake(spark, sf))
    new = old.withColumn("confidence", F.when(F.col("award_id") % 4 == 0, "low").otherwise(F.col("confidence")))
    return io.regrade_updates(old, new, ["pe_bli", "award_id"], "confidence")


# Streams ---------------------------------------------------------------------------------


def event_stream(spark, sf):
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))


@query("R01_new_keys", "SELECT user_id, count(*) > 0 AS seen FROM events GROUP BY 1")
def r01(spark, sf):
    first = streams.new_keys(event_stream(spark, sf), ["user_id"], "ts", "40 days").select("user_id", F.lit(True).alias("seen"))
    return streams.run_once(first, "append", "keys", scratch(spark, "r01"))


@query("R02_latest_heartbeat", "SELECT user_id, max(ts) AS last_seen, arg_max(event_type, ts) AS last_status, max(ts) < TIMESTAMP '2024-01-30' AS offline FROM events GROUP BY 1")
def r02(spark, sf):
    beat = streams.latest_heartbeat(event_stream(spark, sf), "user_id", "ts", "event_type")
    out = streams.run_once(beat, "complete", "beats", scratch(spark, "r02"))
    return out.withColumn("offline", F.col("last_seen") < F.to_timestamp(F.lit("2024-01-30")))


@query("R03_rolling_success", """WITH w AS (SELECT unnest(range(CAST(date_trunc('day', ts) AS TIMESTAMP) - INTERVAL 6 DAY, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS window_start, event_type FROM events)
SELECT window_start, count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS booked FROM w GROUP BY 1""")
def r03(spark, sf):
    win = streams.rolling_success(event_stream(spark, sf), "ts", "event_type", "purchase", "7 days", "1 day", "2 days")
    return streams.run_once(win, "complete", "success", scratch(spark, "r03"))


@query("R04_incremental_upsert", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def r04(spark, sf):
    target = scratch(spark, "r04")
    rows = event_stream(spark, sf).select("user_id", "event_id", "event_type")
    q = rows.writeStream.foreachBatch(streams.upsert_batch(f"{target}/table", ["user_id"], "event_id")).option("checkpointLocation", f"{target}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return streams.BucketTable(spark, f"{target}/table", ["user_id"], "event_id").rows(rows.schema)


@query("R05_incremental_partition_guard", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def r05(spark, sf):
    target = scratch(spark, "r05")
    rows = event_stream(spark, sf).select("event_id", F.to_date("ts").alias("day"))
    q = rows.writeStream.foreachBatch(streams.guard_batch(f"{target}/table", "day")).option("checkpointLocation", f"{target}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{target}/table").groupBy("day").agg(F.count(F.lit(1)).alias("n"))
