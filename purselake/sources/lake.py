"""Sources, sinks and ingest. Paths are any that Spark's file systems open."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all machines see. Only a session on one machine may
    do without it and gets a temporary folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return "file://" + tempfile.mkdtemp(prefix="purselake-")


def written(df: DataFrame, label: str) -> DataFrame:
    """A scan of ``df`` written to the shared folder: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_partitioned_lake(spark: SparkSession, path: str) -> DataFrame:
    """Hive-partitioned parquet, columns united by name, with the source file's name."""
    return spark.read.option("mergeSchema", True).parquet(path).withColumn("source_file", F.col("_metadata.file_name"))


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def file_stamp(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files at a path: the same as long as they are."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    out = []
    while found.hasNext():
        f = found.next()
        out.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(out))


def read_optional(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table, or an empty one of its schema where the path is absent."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def csv_to_parquet(spark: SparkSession, source: str, target: str, partition: str, value, required: list[str] = ()) -> None:
    """Header CSV, every column a string, into one zstd partition of a lake."""
    df = require_columns(spark.read.csv(source, header=True), list(required))
    df.withColumn(partition, F.lit(value)).write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(target)


def ndjson_to_parquet(spark: SparkSession, source: str, target: str, schema: StructType | str) -> None:
    spark.read.json(source, schema=schema).write.mode("overwrite").option("compression", "zstd").parquet(target)


def load_seed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Curated CSV dimension of strings; small by its nature, so joins may broadcast it."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns))


class RetentionError(ValueError):
    """A replacement would lose too many rows."""


def guarded_overwrite(new: DataFrame, target: str, partition: str, floor: float = 0.8, allow: bool = False) -> dict:
    """Replace the partitions that ``new`` holds, unless one keeps under ``floor`` of its rows."""
    spark = new.sparkSession
    fresh = new.groupBy(partition).agg(F.count(F.lit(1)).alias("n_new"))
    old = spark.read.parquet(target).groupBy(partition).agg(F.count(F.lit(1)).alias("n_old")) if exists(spark, target) else None
    if old is not None and not allow:
        short = fresh.join(old, partition).filter(F.col("n_new") < floor * F.col("n_old")).first()
        if short is not None:
            raise RetentionError(f"{partition}={short[partition]}: {short['n_new']} of {short['n_old']} rows")
    new.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(target)
    return {"replaced": old is not None}


def partition_refresh_review(prev: DataFrame, staged: DataFrame, key: str, date: str, values: list[str]) -> DataFrame:
    """One row: profiles of both sides, retired, added and revised rows, and the verdict."""

    def profile(df, name):
        return df.agg(F.count(F.lit(1)).alias(f"{name}_rows"), F.countDistinct(key).alias(f"{name}_keys"), F.count_if(F.col(key).isNull()).alias(f"{name}_missing"), F.min(date).alias(f"{name}_first"), F.max(date).alias(f"{name}_last"))

    a = prev.select(key, F.struct(*values).alias("was"), F.lit(1).alias("in_prev"))
    b = staged.select(key, F.struct(*values).alias("now"), F.lit(1).alias("in_staged"))
    moved = a.join(b, key, "full_outer").agg(
        F.count_if(F.col("in_staged").isNull()).alias("retired"),
        F.count_if(F.col("in_prev").isNull()).alias("added"),
        F.count_if(F.col("in_prev").isNotNull() & F.col("in_staged").isNotNull() & ~F.col("was").eqNullSafe(F.col("now"))).alias("revised"),
    )
    out = profile(prev, "prev").crossJoin(profile(staged, "staged")).crossJoin(moved)
    return out.withColumn("retained", F.col("staged_rows") >= 0.8 * F.col("prev_rows"))


def checkbook_rows(raw: DataFrame, names: dict[str, str], bad: float | None) -> DataFrame:
    """Named columns mapped; an amount that does not parse becomes ``bad``."""
    df = raw.select(*[F.col(src).alias(dst) for dst, src in names.items()])
    amount = F.coalesce(F.col("amount_usd").try_cast("decimal(20,2)"), F.lit(bad).cast("decimal(20,2)"))
    return df.withColumn("amount_usd", amount)


def unpivot_years(df: DataFrame, ids: list[str], prefix: str, name: str, value: str) -> DataFrame:
    """Columns ``prefix``YYYY to rows; blanks go."""
    wide = [c for c in df.columns if c.startswith(prefix)]
    long = df.unpivot(ids, wide, "__column", value)
    return long.withColumn(name, F.regexp_extract("__column", "([0-9]{4})$", 1).cast("int")).drop("__column").filter(F.col(value).isNotNull())


def rollup_melt(df: DataFrame, ids: list[str], order: str) -> DataFrame:
    """Every 'FY ...' column to (amount_type slug, amount); the last row of a key wins."""
    wide = [c for c in df.columns if c.startswith("FY ")]
    long = df.unpivot([*ids, order], wide, "label", "amount").filter(F.col("amount").isNotNull())
    slug = F.regexp_replace(F.regexp_replace(F.lower("label"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    w = Window.partitionBy(*ids, "amount_type").orderBy(F.col(order).desc())
    return long.withColumn("amount_type", slug).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "label", order)


def current_facts(facts: DataFrame, documents: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """Current, sourced rows with their document's attributes; lists become comma text."""
    kept = facts.filter(~F.coalesce("superseded", F.lit(False)) & F.col(key).isNotNull())
    out = kept.join(documents, key).drop("superseded")
    return out.select(*[F.concat_ws(",", c).alias(c) if c in lists else F.col(c) for c in out.columns])


# The shape of a contract number, of a money figure and of an announcement's
# title; names with which a service's heading begins.
CONTRACT_NUMBER = r"\b[A-Z][A-Z0-9]{4,5}[- ]?[0-9]{2}[- ]?[A-Z][- ]?[A-Z0-9]{4}\b"
MONEY = r"(?i)\$([0-9,]+(?:\.[0-9]+)?)(?:\s*(million|billion))?"
DATED_TITLE = r"Contracts?\s+[Ff]or\s+([A-Z][a-z]{2})[a-z]*\.?\s+([0-9]{1,2}),?\s+([0-9]{4})"
SERVICES = (
    "ARMY", "NAVY", "AIR FORCE", "SPACE FORCE", "DEFENSE LOGISTICS AGENCY", "MISSILE DEFENSE AGENCY", "SPECIAL OPERATIONS", "DEFENSE ADVANCED RESEARCH", "U.S.",
    "WASHINGTON HEADQUARTERS", "DEFENSE", "MARINE CORPS",
)
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def announcement_records(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """Paragraphs of an announcement that name a contract: the service of the last heading
    before, the contractor (what stands before the first comma), contract numbers without
    separators and with their role (a number after the word contract is referred to, any
    other awarded), and the first four money figures in whole dollars."""
    paragraphs = F.regexp_extract_all(html, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    found = lambda g: F.regexp_extract(html, DATED_TITLE, g)
    month = F.position(F.lower(found(1)), F.lit(MONTHS))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    date = F.when((found(3) != "") & (month > 0), F.concat_ws("-", found(3), two(((month + 2) / 3).cast("int")), two(found(2))))
    parts = pages.select(id_, date.alias("date"), F.posexplode(paragraphs))
    t = parts.select(id_, "date", "pos", F.trim(F.regexp_replace(F.regexp_replace("col", "<[^>]+>", " "), r"\s+", " ")).alias("body"))
    name = F.upper(F.regexp_replace("body", "[ *]+$", ""))
    heads = "|".join(s.replace(".", r"\.") for s in SERVICES)
    is_heading = (F.length(name) < 60) & name.rlike(f"^(?:{heads})") & ~F.contains("body", F.lit("$"))
    w = Window.partitionBy(id_).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("service", F.last(F.when(is_heading, F.regexp_replace(name, r"\.+$", "")), ignorenulls=True).over(w)).filter(~is_heading)
    t = t.withColumn("numbers", F.regexp_extract_all("body", F.lit(CONTRACT_NUMBER), F.lit(0))).filter(F.size("numbers") > 0)
    between = F.transform(F.split("body", CONTRACT_NUMBER), lambda x: F.lower(F.right(x, F.lit(30))))
    t = t.withColumn("before", between)
    referred = lambda x: F.contains(F.right(x, F.lit(12)), F.lit("contract ")) | F.contains(x, F.lit("to contract"))
    numbers = F.transform("numbers", lambda x, i: F.concat(F.when(referred(F.get("before", i)), "referenced:").otherwise("award:"), F.regexp_replace(x, "[- ]", "")))
    figures, units = (F.regexp_extract_all("body", F.lit(MONEY), F.lit(g)) for g in (1, 2))
    scale = lambda u: F.when(F.lower(u) == "million", 1_000_000).when(F.lower(u) == "billion", 1_000_000_000).otherwise(1)
    dollars = F.zip_with(figures, units, lambda v, u: F.round(F.replace(v, F.lit(",")).try_cast("decimal(20,4)") * scale(u)).try_cast("decimal(20,0)").cast("string"))
    dollars = F.slice(F.filter(dollars, lambda x: x.isNotNull()), 1, 4)
    contractor = F.substring(F.regexp_replace(F.split_part("body", F.lit(","), F.lit(1)), r"^[ *]+|[ *]+$", ""), 1, 120)
    return t.select(id_, "pos", "date", "service", contractor.alias("contractor"), F.array_join(numbers, ",").alias("contract_numbers"), F.array_join(dollars, ",").alias("amounts"), "body")


def whole_dollars(c: Column) -> Column:
    """Rounded whole-dollar text; blank where it does not parse."""
    return F.coalesce(F.round(c.try_cast("decimal(20,4)")).cast("decimal(20,0)").cast("string"), F.lit(""))


def guarded_link_upsert(existing: DataFrame, candidates: DataFrame, keys: list[str], mechanical: list[str]) -> DataFrame:
    """Insert new links; update stored ones only where their method is mechanical. ``action``
    says what happened to each row."""
    a = existing.select(*keys, F.struct("method", "score").alias("old"))
    b = candidates.select(*keys, F.struct("method", "score").alias("fresh"))
    j = a.join(b, keys, "full_outer")
    action = F.when(F.col("old").isNull(), "inserted").when(F.col("fresh").isNull(), "kept").when(F.col("old.method").isin(mechanical), "updated").otherwise("skipped")
    chosen = F.when(action.isin("inserted", "updated"), F.col("fresh")).otherwise(F.col("old"))
    return j.select(*keys, chosen.getField("method").alias("method"), chosen.getField("score").alias("score"), action.alias("action"))


def regrade_updates(old: DataFrame, new: DataFrame, keys: list[str], tier: str) -> DataFrame:
    """Rows whose tier changes; rows that only one side has are never written."""
    a = old.select(*keys, F.col(tier).alias("from_tier"))
    b = new.select(*keys, F.col(tier).alias("to_tier"))
    return a.join(b, keys).filter(~F.col("from_tier").eqNullSafe(F.col("to_tier")))
