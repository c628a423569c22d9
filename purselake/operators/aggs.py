"""Aggregations used across the marts."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def hhi(df: DataFrame, group: list[str], entity: str, amount: str) -> DataFrame:
    """Concentration per group: sum of squared percentage shares of positive money.

    Two levels: entities first, so that the second shuffle moves one row an entity.
    The positive part is taken per row. Zero when a group has no positive money."""
    e = df.groupBy(*group, entity).agg(F.sum(F.greatest(F.col(amount), F.lit(0))).cast("double").alias("p"), F.sum(amount).alias("net"))
    return e.groupBy(*group).agg(
        F.coalesce(F.sum(F.col("p") * F.col("p")) * 10000 / F.nullif(F.sum("p") * F.sum("p"), F.lit(0.0)), F.lit(0.0)).alias("hhi"),
        F.sum("net").alias("total"),
        F.count(F.lit(1)).alias("entities"),
    )


def collisions(df: DataFrame, key: list[str], axis: str) -> DataFrame:
    """Keys with more than one distinct value on an axis."""
    return df.groupBy(*key).agg(F.countDistinct(axis).alias("n_values")).filter("n_values > 1")


def ordered_join(value: Column, separator: str = ",") -> Column:
    """Aggregate: distinct values, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(value)), separator)


def arg_max(value: Column, key: Column) -> Column:
    """Aggregate: value at the largest key among rows whose value is not null."""
    return F.max_by(value, F.when(value.isNotNull(), key))


def single_source(id_: Column) -> Column:
    """Aggregate: the id if the group has exactly one row."""
    return F.when(F.count(F.lit(1)) == 1, F.min(id_))


def top_n_with_other(df: DataFrame, group: list[str], key: str, value: str, n: int, listed: int = 5) -> DataFrame:
    """Per group the top ``n`` keys by value; the rest as one 'Other' row with its member
    count, total, first ``listed`` members and what those omit.

    Tasks pass on their own first ``n + listed`` rows of a group only; the rest is the
    group's totals, added up before the shuffle, less what is shown."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(value).desc(), F.col(key)))
    shown = df.withColumn("__r", rank).filter(F.col("__r") <= n + listed)
    zero = F.lit(0).cast("long")
    total_type = df.agg(F.sum(value).alias("t")).schema["t"].dataType
    own = shown.filter(F.col("__r") <= n).select(*group, F.col(key).alias("label"), F.lit(1).cast("long").alias("members"), F.col(value).cast(total_type).alias("total"), F.lit("").alias("listed"), zero.alias("omitted"), F.lit(0).cast(total_type).alias("omitted_total"))
    top = lambda c: F.coalesce(F.sum(F.when(c, F.col(value))), F.lit(0).cast(total_type))
    names = F.array_sort(F.collect_list(F.when(F.col("__r") > n, F.struct("__r", F.col(key).alias("k")))))
    first = shown.groupBy(*group).agg(top(F.col("__r") <= n).alias("__top"), top(F.lit(True)).alias("__shown"), F.array_join(F.transform(names, lambda x: x["k"]), ",").alias("listed"))
    every = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__members"), F.coalesce(F.sum(value), F.lit(0).cast(total_type)).alias("__total"))
    rest = every.filter(F.col("__members") > n).join(first, group).select(
        *group, F.lit("Other").alias("label"), (F.col("__members") - n).alias("members"), (F.col("__total") - F.col("__top")).cast(total_type).alias("total"), "listed",
        F.greatest(F.col("__members") - n - listed, zero).alias("omitted"), (F.col("__total") - F.col("__shown")).cast(total_type).alias("omitted_total"),
    )
    return own.unionByName(rest)


def lines_digest(df: DataFrame, group: list[str], line: Column, name: str = "digest") -> DataFrame:
    """(``group``, digest): SHA-256 of the group's lines, sorted and joined by newlines.

    Sorted lines stream through one running hash, so a group of any size costs no memory.
    Null lines are left out. Where only equality is asked, ``multiset_digest`` also spares
    the sort.
    """
    schema = StructType([*[df.schema[c] for c in group], StructField(name, StringType())])

    def run(frames):
        held, state = None, None

        def batch(done):
            columns = [pa.array([k[i] for k, _ in done], type=types[i]) for i in range(len(group))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([d for _, d in done], type=pa.string())], names=[*group, name])

        types = None
        for frame in frames:
            types = [frame.schema.field(i).type for i in range(len(group))]
            done, lines = [], frame.column(len(group)).to_pylist()
            for *key, text in zip(*[frame.column(i).to_pylist() for i in range(len(group))], lines):
                if state is None or key != held:
                    if state is not None:
                        done.append((held, state.hexdigest()))
                    held, state, first = key, hashlib.sha256(), True
                if text is not None:
                    state.update(text.encode() if first else b"\n" + text.encode())
                    first = False
            if done:
                yield batch(done)
        if state is not None:
            yield batch([(held, state.hexdigest())])

    rows = df.select(*group, line.cast("string").alias("__line"))
    return rows.repartition(*group).sortWithinPartitions(*group, F.col("__line").asc_nulls_first()).mapInArrow(run, schema)


def multiset_digest(line: Column) -> Column:
    """Aggregate: the same for the same lines in any order, and mergeable: four sums of
    32-bit parts of each line's SHA-256, and the number of lines."""
    sha = F.sha2(line.cast("string"), 256)
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring(sha, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")), F.lit(0))
    return F.concat_ws("-", F.count(line).cast("string"), *[part(i).cast("string") for i in range(4)])


def parentage(edges: DataFrame, src: str, dst: str, value: str) -> DataFrame:
    """Per node: distinct sources and the source of its largest inflow (ties: least name)."""
    flows = edges.groupBy(dst, src).agg(F.sum(value).alias("v"))
    return flows.groupBy(dst).agg(F.count(F.lit(1)).alias("n_sources"), F.min_by(src, F.struct(-F.col("v"), F.col(src))).alias("main_source"), F.sum("v").alias("inflow"))
