"""A positional inverted index of texts as a written table.

One row a (document, word): ``term``, the columns kept of the document, ``first`` (place of
its first occurrence in the lower-cased text, code points from 1) and ``n`` (occurrences).
A task writes what it reads as a segment of its own, sorted by term: building shuffles
nothing, a word that every document holds is spread over all segments, and the term's
ranges in the files let a scan skip those without any term that is asked for. Text jobs
join it by term and never explode or carry a text; a text is read again, once, only where
a part of it is to be shown.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from purselake.sources.lake import file_stamp, shared_folder

WORD = "[a-z0-9]+"
BATCH_WORDS = 500_000
_BUILT: dict[tuple, str] = {}


def text_key(text: Column) -> Column:
    """Tells texts of one id apart, so that ids need not be unique."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def postings(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(term, ``keep``, first, n) of each distinct word of each row. Null texts have none."""
    schema = StructType([StructField("term", StringType()), *[docs.schema[c] for c in keep], StructField("first", IntegerType()), StructField("n", IntegerType())])

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for frame in frames:
            texts, kept = frame.column(len(keep)), [frame.column(i) for i in range(len(keep))]
            terms, rows, firsts, counts = [], [], [], []

            def flush():
                at = pa.array(rows, type=pa.int32())
                columns = [pa.array(terms, type=pa.string()), *[c.take(at) for c in kept], pa.array(firsts, type=pa.int32()), pa.array(counts, type=pa.int32())]
                for c in (terms, rows, firsts, counts):
                    c.clear()
                return pa.RecordBatch.from_arrays(columns, names=["term", *keep, "first", "n"])

            for i, low in enumerate(texts):
                found: dict[str, list[int]] = {}
                for m in word.finditer(low.as_py() or ""):
                    own = found.get(m[0])
                    if own is None:
                        found[m[0]] = [m.start() + 1, 1]
                    else:
                        own[1] += 1
                terms += found
                rows += [i] * len(found)
                firsts += [v[0] for v in found.values()]
                counts += [v[1] for v in found.values()]
                if len(terms) >= BATCH_WORDS:
                    yield flush()
            if terms:
                yield flush()

    return docs.select(*keep, F.lower(F.col(text)).alias("__low")).mapInArrow(read, schema)


def written_postings(docs: DataFrame, text: str, keep: list[str], source: str | None = None) -> DataFrame:
    """``postings`` as a written table. With ``source``, the path that ``docs`` was read
    from, a session builds it once for as long as the files there stay the same."""
    spark = docs.sparkSession
    made = (spark.sparkContext.applicationId, source, text, *keep, file_stamp(spark, source)) if source else None
    lanes = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < lanes:  # a few files or one: spread their rows
        docs = docs.repartition(lanes)
    rows = postings(docs, text, keep)
    if made not in _BUILT or made is None:
        folder = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
        rows.sortWithinPartitions("term").write.option("compression", "zstd").parquet(folder)
        if made is None:
            return spark.read.schema(rows.schema).parquet(folder)
        _BUILT[made] = folder
    return spark.read.schema(rows.schema).parquet(_BUILT[made])


def term_hits(index: DataFrame, terms: DataFrame, limit: int = 100_000) -> DataFrame:
    """Postings beside the rows of ``terms`` of their term. A few terms are sent to the
    segments; more, counted before, meet them in a shuffled join of the same rows."""
    few = terms.limit(limit + 1).count() <= limit
    return index.join(F.broadcast(terms) if few else terms, "term")
