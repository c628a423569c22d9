"""Shared plumbing: reading tables, shared scratch tables, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
_KEPT: dict[tuple, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or a
    temporary folder of our own where that is unset on a single machine (tests)."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if sc.applicationId not in _OWN_DIRS:
        _OWN_DIRS[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="purselake-")
    return _OWN_DIRS[sc.applicationId]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table:
    lineage ends there, and a lost executor costs a reread only."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(key: tuple, make):
    """What this Python worker keeps under ``key`` from task to task, made by ``make`` if it is
    not there: one thing at a time, as a worker goes on to the tasks of other operators."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def keep_nothing() -> None:
    """Give up what an earlier operator's tasks left in this Python worker."""
    _KEPT.clear()


def documents_only(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a null text read as the empty text; any further
    column of the input, whatever its name, is left out."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def with_text_ids(docs: DataFrame) -> DataFrame:
    """``documents_only`` with doc_id as text, for functions over pandas frames: a column
    of whole numbers with nulls would turn into floats there and lose digits."""
    return documents_only(docs).select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")


def with_long_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def hot_aware_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, share: int = 400) -> DataFrame:
    """Inner join of many ``left`` rows with the one ``right`` row of their key.

    ``right[weight]`` is the number of left rows of the key. Keys holding more
    than 1/``share`` of ``total`` rows number at most ``share``, so they are
    broadcast under a proven bound; all others take a shuffled join, in which
    no key is hot. ``left`` and ``right`` should be staged tables, as both are
    read twice. ``weight`` stays in the output.
    """
    limit = max(total // share, 1)
    hot = right.filter(F.col(weight) > limit)
    cold = right.filter(F.col(weight) <= limit)
    hot_keys = F.broadcast(hot.select(key))
    with_hot = left.join(F.broadcast(hot), key)
    with_cold = left.join(hot_keys, key, "left_anti").join(cold, key)
    return with_hot.unionByName(with_cold)


def crc_mod(col: Column, n: int) -> Column:
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


FILTER_BITS = 1 << 27


def likely_in(left: DataFrame, key: str, keys: DataFrame, count: int) -> DataFrame:
    """Rows of ``left`` whose key is in ``keys`` (a table of ``count`` distinct keys), and
    a few others: a Bloom filter that spares rows a shuffle before an exact join.

    The filter is broadcast as 64-bit words, at most ``FILTER_BITS`` / 64 rows of 16
    bytes; for more keys than it was made for it only lets more rows through.
    """
    bits = 1 << 16
    while bits < min(16 * count, FILTER_BITS):
        bits <<= 1
    position = [F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits)) for i in range(2)]
    mark = keys.select(F.explode(F.array(*position)).alias("bit"))
    words = mark.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask"))
    columns = left.columns
    for i in range(2):
        side = F.broadcast(words.select(F.col("word").alias(f"__word{i}"), F.col("mask").alias(f"__mask{i}")))
        left = left.withColumn(f"__bit{i}", position[i])
        left = left.join(side, (F.shiftright(f"__bit{i}", 6) == F.col(f"__word{i}")) & F.expr(f"getbit(__mask{i}, cast(__bit{i} % 64 as int)) = 1"))
    return left.select(*columns)
