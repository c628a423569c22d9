"""Window idioms; every order is total and every frame is stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from purselake.sources.lake import written


def pick_first(df: DataFrame, part: list[str], order: list[Column]) -> DataFrame:
    """First row of each part."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter("__n = 1").drop("__n")


def tied_top(df: DataFrame, part: list[str], order: list[Column]) -> DataFrame:
    """All rows that tie for the first place."""
    return df.withColumn("__n", F.rank().over(Window.partitionBy(*part).orderBy(*order))).filter("__n = 1").drop("__n")


def share_of_total(value: str, part: list[str]) -> Column:
    return F.col(value) * 100 / F.sum(value).over(Window.partitionBy(*part))


def carry_forward(value: str, part: list[str], order: list[Column]) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def candidate_pick(df: DataFrame, patterns: DataFrame, on: str, part: list[str], priority: str) -> DataFrame:
    """Rows whose ``on`` is a candidate, of the best priority in each part."""
    return tied_top(df.join(F.broadcast(patterns), on), part, [F.col(priority)])


def numbered(df: DataFrame, part: list[str], order: list[Column], name: str = "n") -> DataFrame:
    """``row_number`` of each part as column ``name``, for parts of any size.

    Rows are dealt to ranges of (part, order), written, and numbered inside each range; a
    range's rows of a part start behind those of the ranges before it, which one row a
    (range, part) tells. No task holds a part that is larger than a range. ``order`` should
    be total; a null part is a part.
    """
    dealt = df.repartitionByRange(*[F.col(c) for c in part], *order).withColumn("__range", F.spark_partition_id())
    t = written(dealt, "ranges")
    here = [F.col("__range"), *[F.col(c) for c in part]]
    local = t.withColumn("__n", F.row_number().over(Window.partitionBy(*here).orderBy(*order)))
    sizes = t.groupBy(*here).agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*part).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("__range").alias("__r"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(part)], F.coalesce(before, F.lit(0)).alias("__before"))
    on = reduce(lambda a, b: a & b, [F.col("__range") == F.col("__r"), *[F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(part)]])
    return local.join(starts, on).select(*df.columns, (F.col("__n") + F.col("__before")).alias(name))
