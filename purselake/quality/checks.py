"""Data-quality checks: each returns the rows that violate a rule, so an empty result passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purselake.operators import joins


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(~F.col(column).isin(values))


def recompute_equals(mart: DataFrame, source: DataFrame, keys: list[str], value: str, tol: float) -> DataFrame:
    """Keys whose value on two sides is absent on one or differs by more than ``tol``."""
    a = mart.select(*keys, F.col(value).alias("mart_value"))
    b = source.select(*keys, F.col(value).alias("source_value"))
    off = F.col("mart_value").isNull() | F.col("source_value").isNull() | (F.abs(F.col("mart_value") - F.col("source_value")) > tol)
    return a.join(b, keys, "full_outer").filter(off)


def wellformed(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def no_overlap(ranges: DataFrame, key: list[str], id_: str, lo: str, hi: str) -> DataFrame:
    return joins.overlap_pairs(ranges, key, id_, lo, hi)


def complete(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side that the other lacks."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("missing_on", F.lit("right")).unionByName(b.join(a, keys, "left_anti").withColumn("missing_on", F.lit("left")))


def pinned_value(df: DataFrame, value: str, expected) -> DataFrame:
    return df.filter(~F.col(value).eqNullSafe(F.lit(expected)))


def warn_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("warnings"))
