"""Schedule analytics over slots, targets and jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], keep_old: str, purge_before: Column, date: str) -> DataFrame:
    """Merge on ``keys``: the new row wins, but ``keep_old`` stays where the new is null;
    rows dated before ``purge_before`` go."""
    values = [c for c in existing.columns if c not in keys]
    a = existing.select(*keys, F.struct(*values).alias("old"))
    b = new.select(*keys, F.struct(*values).alias("fresh"))
    pick = lambda c: F.when(F.col("fresh").isNotNull(), F.col(f"fresh.{c}")).otherwise(F.col(f"old.{c}"))
    merged = a.join(b, keys, "full_outer").select(*keys, *[(F.coalesce(F.col(f"fresh.{c}"), F.col(f"old.{c}")) if c == keep_old else pick(c)).alias(c) for c in values])
    return merged.filter(F.col(date) >= purge_before)


def target_slot_match(slots: DataFrame, targets: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Slots of a target's studio and location, at its clock time if it has one, on its date
    if it has one and else on its weekday. On days of ``taken`` (columns of targets and
    class_date) a target gets none.

    Matches grow with slots times targets, so none is shuffled to be suppressed: a target's
    days are laid out and those taken go before any slot is met. Few bytes then make many
    matches, so both sides keep all shuffle partitions instead of being coalesced by size."""
    out, partitions = [], int(slots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for timed in (True, False):
        for dated in (True, False):
            some = targets.filter(F.col("want_minutes").isNotNull() == timed).filter(F.col("want_date").isNotNull() == dated)
            # Each of the four shapes of a target is an equi-join on all that it asks for.
            asked = ["studio", "location", *["minutes"] * timed, "class_date" if dated else "dow"]
            wanted = {"minutes": "want_minutes", "class_date": "want_date", "dow": "want_dow"}
            keyed, rows = some.select("*", *[F.col(wanted[k]).alias(k) for k in asked if k in wanted]), slots
            if taken is not None:
                days = keyed if dated else slots.select(*asked, "class_date").distinct().join(keyed, asked)
                left, asked = days.join(taken, taken.columns, "left_anti"), [*[k for k in asked if k != "class_date"], "__day"]
                # In a struct, unknown dates of slots are equal: no day taken is one.
                keyed = left.withColumn("__day", F.struct("class_date")).drop("class_date").repartition(partitions, *asked)
                rows = slots.withColumn("__day", F.struct("class_date")).repartition(partitions, *asked)
            out.append(rows.join(keyed, asked).select(*slots.columns, *[c for c in targets.columns if c not in slots.columns]))
    return reduce(DataFrame.unionByName, out)


def outcome_history(jobs: DataFrame, job: str, order: list[Column], status: str, terminal: list[str]) -> DataFrame:
    """Rows at which a job's status changed to a terminal one."""
    before = F.lag(status).over(Window.partitionBy(job).orderBy(*order))
    return jobs.withColumn("__before", before).filter(F.col(status).isin(terminal) & ~F.col("__before").eqNullSafe(F.col(status))).drop("__before")
