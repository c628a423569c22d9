"""Queries B01-B07: schedule analytics on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from purselake.functions import exprs as X
from purselake.plans.bindings import Lake
from purselake.plans.registry import query
from purselake.schedule import jobs

# Slots: click events; targets: users; jobs: purchases and errors.
_SLOT_SQL = "sl AS (SELECT event_id, user_id % 5 AS studio, user_id % 3 AS location, CAST(ts AS DATE) AS class_date, CAST(dayofweek(ts) AS INTEGER) AS dow, CAST(hour(ts) AS INTEGER) AS minutes FROM events WHERE event_type = 'click')"
_TARGET_SQL = "tg AS (SELECT DISTINCT user_id AS target_id, user_id % 5 AS studio, user_id % 3 AS location, CASE WHEN user_id % 2 = 0 THEN CAST(user_id % 24 AS INTEGER) END AS want_minutes, CAST(user_id % 7 AS INTEGER) AS want_dow, CASE WHEN user_id % 11 = 0 THEN DATE '2024-01-15' END AS want_date FROM events)"


def slots(lake):
    return lake.events.filter("event_type = 'click'").select("event_id", (F.col("user_id") % 5).alias("studio"), (F.col("user_id") % 3).alias("location"), F.to_date("ts").alias("class_date"), X.day_of_week(F.col("ts")).alias("dow"), F.hour("ts").alias("minutes"))


def targets(lake):
    u = F.col("user_id")
    return lake.events.select("user_id").distinct().select(
        u.alias("target_id"), (u % 5).alias("studio"), (u % 3).alias("location"), F.when(u % 2 == 0, (u % 24).cast("int")).alias("want_minutes"),
        (u % 7).cast("int").alias("want_dow"), F.when(u % 11 == 0, F.to_date(F.lit("2024-01-15"))).alias("want_date"),
    )


@query("B01_week_calendar", f"""WITH {_TARGET_SQL}, h AS (SELECT 'history' AS kind, user_id AS owner, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS minutes FROM events WHERE event_type = 'purchase' AND ts >= DATE '2024-01-08' AND ts < DATE '2024-01-15'),
r AS (SELECT 'target', target_id, CASE WHEN want_date IS NOT NULL THEN want_date ELSE CAST(DATE '2024-01-08' + CAST((want_dow - 1 + 7) % 7 AS INTEGER) AS DATE) END, want_minutes FROM tg), u AS (SELECT * FROM h UNION ALL SELECT * FROM r) SELECT * FROM u WHERE day >= DATE '2024-01-08' AND day < DATE '2024-01-15'""")
def b01(spark, sf):
    lake = Lake(spark, sf)
    start = F.to_date(F.lit("2024-01-08"))
    h = lake.events.filter("event_type = 'purchase'").select(F.lit("history").alias("kind"), F.col("user_id").alias("owner"), F.to_date("ts").alias("day"), F.hour("ts").alias("minutes"))
    day = F.coalesce("want_date", F.date_add(start, F.pmod(F.col("want_dow") - X.day_of_week(start), F.lit(7)).cast("int")))
    r = targets(lake).select(F.lit("target").alias("kind"), F.col("target_id").alias("owner"), day.alias("day"), F.col("want_minutes").alias("minutes"))
    return h.unionByName(r).filter((F.col("day") >= start) & (F.col("day") < F.date_add(start, 7)))


_MATCH_SQL = "mt AS (SELECT event_id, target_id, class_date FROM sl JOIN tg USING (studio, location) WHERE (want_minutes IS NULL OR want_minutes = minutes) AND CASE WHEN want_date IS NOT NULL THEN want_date = class_date ELSE want_dow = dow END)"


@query("B02_target_slot_match", f"WITH {_SLOT_SQL}, {_TARGET_SQL}, {_MATCH_SQL} SELECT event_id, target_id FROM mt")
def b02(spark, sf):
    lake = Lake(spark, sf)
    return jobs.target_slot_match(slots(lake), targets(lake)).select("event_id", "target_id")


@query("B03_suppress_existing_jobs", f"WITH {_SLOT_SQL}, {_TARGET_SQL}, {_MATCH_SQL} SELECT event_id, target_id FROM mt WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.user_id = target_id AND CAST(e.ts AS DATE) = class_date)")
def b03(spark, sf):
    lake = Lake(spark, sf)
    live = lake.events.filter("event_type = 'purchase'").select(F.col("user_id").alias("target_id"), F.to_date("ts").alias("class_date"))
    return jobs.target_slot_match(slots(lake), targets(lake), live).select("event_id", "target_id")


@query("B04_complete_one_time_targets", f"WITH {_TARGET_SQL} SELECT target_id FROM tg WHERE want_date IS NOT NULL AND target_id IN (SELECT user_id FROM events WHERE event_type IN ('purchase', 'error'))")
def b04(spark, sf):
    lake = Lake(spark, sf)
    done = lake.events.filter(F.col("event_type").isin("purchase", "error")).select(F.col("user_id").alias("target_id"))
    return targets(lake).filter("want_date IS NOT NULL").join(done, "target_id", "left_semi").select("target_id")


@query("B05_job_outcome_history", "SELECT event_id, event_type, CAST(ts AS DATE) AS day FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type IN ('purchase', 'error') AND b IS DISTINCT FROM event_type")
def b05(spark, sf):
    h = jobs.outcome_history(Lake(spark, sf).events, "user_id", [F.col("ts"), F.col("event_id")], "event_type", ["purchase", "error"])
    return h.select("event_id", "event_type", F.to_date("ts").alias("day"))


@query("B06_schedule_search", f"WITH {_SLOT_SQL} SELECT event_id, class_date, minutes FROM sl WHERE studio = 2 AND class_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND dow IN (1, 3, 5) ORDER BY class_date, minutes, event_id LIMIT 200")
def b06(spark, sf):
    s = slots(Lake(spark, sf)).filter("studio = 2 AND class_date BETWEEN DATE'2024-01-05' AND DATE'2024-01-20' AND dow IN (1, 3, 5)")
    return s.orderBy("class_date", "minutes", "event_id").limit(200).select("event_id", "class_date", "minutes")


@query("B07_watched_pairs", f"WITH {_TARGET_SQL} SELECT DISTINCT studio, location FROM tg WHERE target_id % 4 > 0")
def b07(spark, sf):
    return targets(Lake(spark, sf)).filter("target_id % 4 > 0").select("studio", "location").distinct()
