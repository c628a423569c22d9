"""Structured Streaming jobs over the event stream, each with a bounded batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def new_keys(stream: DataFrame, key: list[str], ts: str, ttl: str) -> DataFrame:
    """First sight of a key; a key is known for ``ttl`` of event time."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(key)


def latest_heartbeat(stream: DataFrame, worker: str, ts: str, status: str) -> DataFrame:
    return stream.groupBy(worker).agg(F.max(ts).alias("last_seen"), F.max_by(status, ts).alias("last_status"))


def rolling_success(stream: DataFrame, ts: str, status: str, good: str, length: str, slide: str, late: str) -> DataFrame:
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, length, slide).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(status) == good).alias("booked")).select(F.col("w.start").alias("window_start"), "total", "booked")


class BucketTable:
    """A keyed table in hash buckets. ``manifest/v<batch>`` tells, for each bucket, the batch
    that wrote it last; its rows lie in ``data/v<batch>/__bucket=<bucket>``.

    A batch reads and rewrites the buckets that its keys fall into and no others. It starts
    from the manifest before its own, so a replayed batch overwrites what it wrote before.
    What neither a batch's manifest nor the one before names is removed when the batch is
    written, as nothing can replay from it any more.
    """

    def __init__(self, spark: SparkSession, folder: str, key: list[str], order: str, buckets: int = 64):
        self.spark, self.folder, self.key, self.order, self.buckets = spark, folder, key, order, buckets
        self.fs, self.path = hadoop_fs(spark, folder)

    def manifests(self) -> list[int]:
        found = self.fs.listStatus(self.path(f"{self.folder}/manifest")) if self.fs.exists(self.path(f"{self.folder}/manifest")) else []
        names = [f.getPath().getName() for f in found if self.fs.exists(self.path(f"{f.getPath()}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """bucket -> batch of the last manifest (before a batch): one row a bucket."""
        numbers = [n for n in self.manifests() if before is None or n < before]
        if not numbers:
            return {}
        return {r.bucket: r.batch for r in self.spark.read.schema("bucket int, batch long").parquet(f"{self.folder}/manifest/v{numbers[-1]}").collect()}

    def rows(self, schema: StructType, manifest: dict[int, int] | None = None) -> DataFrame:
        manifest = self.manifest() if manifest is None else manifest
        paths = [f"{self.folder}/data/v{v}/__bucket={b}" for b, v in sorted(manifest.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, number: int) -> None:
        """Newest row (by ``order``) of each key, of the table and the batch."""
        place = F.pmod(F.hash(*self.key), F.lit(self.buckets))
        before = self.manifest(number)
        touched = [r[0] for r in batch.select(place).distinct().collect()]  # at most ``buckets``
        old = self.rows(batch.schema, {b: before[b] for b in touched if b in before})
        rest = [c for c in batch.columns if c not in self.key]
        newest = old.unionByName(batch).groupBy(*self.key).agg(F.max_by(F.struct(*rest), self.order).alias("r")).select(*self.key, "r.*").select(*batch.columns)
        dealt = newest.withColumn("__bucket", place).repartition("__bucket")
        dealt.write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.folder}/data/v{number}")
        after = before | dict.fromkeys(touched, number)
        table = self.spark.createDataFrame(sorted(after.items()), "bucket int, batch long").coalesce(1)
        table.write.mode("overwrite").parquet(f"{self.folder}/manifest/v{number}")
        self.clean(number, before, after)

    def clean(self, number: int, before: dict[int, int], after: dict[int, int]) -> None:
        numbers = [n for n in self.manifests() if n < number]
        for n in numbers[:-1]:
            self.fs.delete(self.path(f"{self.folder}/manifest/v{n}"), True)
        held = {(v, b) for m in (before, after) for b, v in m.items()}
        data = self.path(f"{self.folder}/data")
        for version in self.fs.listStatus(data):
            v = int(version.getPath().getName()[1:])
            parts = [p.getPath() for p in self.fs.listStatus(version.getPath()) if p.isDirectory()]
            kept = [p for p in parts if (v, int(p.getName().split("=")[1])) in held]
            if v <= number:
                for p in (p for p in parts if p not in kept):
                    self.fs.delete(p, True)
                if not kept and v != number:
                    self.fs.delete(version.getPath(), True)


def hadoop_fs(spark: SparkSession, folder: str):
    """(file system of a folder, path maker)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def upsert_batch(target: str, key: list[str], order: str, buckets: int = 64):
    """A foreachBatch writer into a ``BucketTable``."""

    def write(batch: DataFrame, number: int) -> None:
        BucketTable(batch.sparkSession, target, key, order, buckets).merge(batch, number)

    return write


def guard_batch(target: str, partition: str, floor: float = 0.8):
    """A foreachBatch writer that refuses partitions with too few rows and keeps the old;
    refusals are written to ``<target>-refused`` by batch, so that a job can read them."""
    from purselake.sources.lake import RetentionError, guarded_overwrite

    def write(batch: DataFrame, number: int) -> None:
        try:
            guarded_overwrite(batch, target, partition, floor)
        except RetentionError as e:
            note = batch.sparkSession.createDataFrame([(str(e),)], "reason string")
            note.coalesce(1).write.mode("overwrite").parquet(f"{target}-refused/batch={number}")

    return write


def run_once(df: DataFrame, mode: str, name: str, checkpoint: str) -> DataFrame:
    """Drive a stream over what is there now and return the written result."""
    spark = df.sparkSession
    if mode == "append":
        q = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{checkpoint}/{name}-log").option("path", f"{checkpoint}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{checkpoint}/{name}")
    out = f"{checkpoint}/{name}"
    last = {"n": -1}

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/v{number}")
        last["n"] = number

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/v{last['n']}")
