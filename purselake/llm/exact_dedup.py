"""Exact deduplication with two-pass Bloom filtering (DataFrame functions only).

Pass one sets ``HASHES`` bits a row in a filter of at most ``MAX_BITS`` bits and
keeps the bits that two or more rows set. A row is *possibly repeated* when all
of its bits are among those: every row of a repeated text is, for its copy sets
the same bits, and few others are. Pass two sends only the possibly repeated
rows through a shuffle; the rest pass straight through as groups of one.

The kept bits travel as a broadcast of 64-bit words: at most ``MAX_BITS / 64``
rows of 16 bytes, whatever the size of the corpus. A corpus far above
``MAX_BITS / 16`` rows fills the filter; then more rows take the shuffled path,
and the result is the same.

Cases: null text counts as the empty text; all empty texts are equal. A null
doc_id sorts after all others. Of rows that repeat doc_id and text alike one
stays. An empty table gives an empty result. Further columns are carried by
``deduplicated`` and ignored by ``duplicate_groups``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purselake.llm.common import documents_only, hot_aware_join, staged, table

HASHES = 2
MAX_BITS = 1 << 27
BITS_PER_ROW = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text).cast("binary"), 256)


def filter_bits(rows: int) -> int:
    bits = 1 << 16
    while bits < min(rows * BITS_PER_ROW, MAX_BITS):
        bits <<= 1
    return bits


def bit_of(digest: Column, i: int, bits: int) -> Column:
    """Position of the i-th bit of a row: 60 bits of its digest, modulo the filter."""
    return F.pmod(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long"), F.lit(bits))


def repeated_words(digests: DataFrame, bits: int) -> DataFrame:
    """(word, mask): the filter's 64-bit words with the bits that two rows set."""
    positions = digests.select(F.explode(F.array(*[bit_of(F.col("digest"), i, bits) for i in range(HASHES)])).alias("bit"))
    twice = positions.groupBy("bit").count().filter("count > 1")
    return twice.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask"))


def with_suspicion(rows: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """``rows`` plus ``suspect``: whether all bits of the row's digest were set twice."""
    suspect = F.lit(True)
    for i in range(HASHES):
        side = F.broadcast(words.select(F.col("word").alias(f"word_{i}"), F.col("mask").alias(f"mask_{i}")))
        rows = rows.withColumn(f"bit_{i}", bit_of(F.col("digest"), i, bits))
        rows = rows.join(side, F.shiftright(f"bit_{i}", 6) == F.col(f"word_{i}"), "left")
        set_twice = F.expr(f"getbit(mask_{i}, cast(bit_{i} % 64 as int)) = 1")
        suspect = suspect & F.coalesce(set_twice, F.lit(False))
    drop = [f"{x}_{i}" for x in ("word", "mask", "bit") for i in range(HASHES)]
    return rows.withColumn("suspect", suspect).drop(*drop)


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = staged(
        docs.select("doc_id", text_digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")),
        "digests",
    )
    total = digests.count()
    bits = filter_bits(total)
    marked = staged(with_suspicion(digests, repeated_words(digests, bits), bits), "marked")
    alone = marked.filter(~F.col("suspect")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    suspects = marked.filter("suspect")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row").alias("first_row")))
    groups = staged(
        suspects.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")).select("digest", "group_size", "first.id", "first.first_row"),
        "groups",
    )
    grouped = hot_aware_join(suspects, groups, "digest", "group_size", total).select(
        "doc_id",
        F.col("id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    return alone.unionByName(grouped)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns, one row of each group of equal
    texts: that of the smallest doc_id (further ties: the smallest row)."""
    spark = docs.sparkSession
    columns = docs.columns
    digests = staged(docs.select(text_digest(F.col("text")).alias("digest")), "digests")
    bits = filter_bits(digests.count())
    words = staged(repeated_words(digests, bits), "words")
    holder = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    boxed = docs.select(text_digest(F.col("text")).alias("digest"), F.col("doc_id").alias("id"), holder.alias("row"))
    marked = with_suspicion(boxed.withColumn("place", F.monotonically_increasing_id()), words, bits)
    unbox = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)]
    alone = marked.filter(~F.col("suspect")).select(*unbox)
    chosen = (
        marked.filter("suspect")
        .groupBy("digest")
        .agg(F.min_by("row", F.struct(F.col("id").isNull().alias("no_id"), "id", "place")).alias("row"))
        .select(*unbox)
    )
    return alone.unionByName(chosen)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicate_groups(documents_only(table(spark, sf_dir, "documents")))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM n
"""
