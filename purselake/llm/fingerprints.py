"""Homomorphic multiset fingerprints of documents.

A paragraph (a line) hashes to a wide vector; a document's fingerprint is the sum of
its paragraphs' vectors, each lane modulo a power of two. Order of paragraphs does
not matter, and a paragraph is inserted or deleted by adding or subtracting its
vector (``inserted``, ``deleted``). The vector has two parts: ``IDENTITY`` 64-bit
lanes of a cryptographic hash of the paragraph, which tell multisets apart, and
``LANES`` 16-bit lanes in which each of the paragraph's word triples adds 1 or -1 to
one lane. The second part is linear too, and inner products of it estimate how many
word triples two documents share (``likeness``).

Equal texts have equal fingerprints. Lanes wrap at 2**16, so likeness, not equality,
loses meaning for a text that repeats one word triple over 32,000 times.

The edited text needs the next document in order of doc_id. Rows are dealt to ranges
of doc_id; each range also gets the first row of the next non-empty range (found by an
aggregate and joined by range), so every task streams its sorted rows once and of each
range only the first text moves twice.

Cases: a null text is the empty text, with the zero fingerprint; likeness of two
empty texts is 1, of an empty and another 0. Rows of equal doc_id follow one another
by text. Null doc_ids sort last. A single document is its own next one. An empty
table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from purselake.llm.common import documents_only, staged, table, with_long_ids

IDENTITY = 8
LANES = 256
ROWS_PER_RANGE = 4000
MAX_RANGES = 1 << 16
IDS_PER_RANGE = 64
_START = np.uint64(0x1B873593)
_M = np.uint64(0x9E3779B97F4A7C15)


def sketch_lanes(paragraphs: list[str]) -> np.ndarray:
    """Sum of the word-triple vectors of paragraphs; a triple never crosses two."""
    words = [p.split() for p in paragraphs]
    sizes = [len(w) for w in words if w]
    if not sizes:
        return np.zeros(LANES, dtype=np.uint16)
    crc = zlib.crc32
    h = np.array([crc(x.encode("utf-8", "surrogatepass")) for w in words for x in w], dtype=np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    back1, back2 = np.roll(h, 1), np.roll(h, 2)
    back1[starts] = back2[starts] = _START
    back2[np.minimum(starts + 1, len(h) - 1)[np.array(sizes) > 1]] = _START
    with np.errstate(over="ignore"):
        x = ((back2 * _M + back1) * _M + h) * _M
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    lane = (x >> np.uint64(40)).astype(np.int64) % LANES
    sign = 1.0 - 2.0 * ((x >> np.uint64(33)) & np.uint64(1)).astype(np.float64)
    return np.bincount(lane, weights=sign, minlength=LANES).astype(np.int64).astype(np.uint16)


def fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(identity lanes, sketch lanes) of a text."""
    if not text:
        return np.zeros(IDENTITY, dtype=np.uint64), np.zeros(LANES, dtype=np.uint16)
    paragraphs = text.split("\n")
    digests = b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=8 * IDENTITY).digest() for p in paragraphs)
    return np.frombuffer(digests, dtype="<u8").reshape(-1, IDENTITY).sum(axis=0, dtype=np.uint64), sketch_lanes(paragraphs)


def inserted(f, paragraph: str):
    g = fingerprint_of_paragraph(paragraph)
    return f[0] + g[0], f[1] + g[1]


def deleted(f, paragraph: str):
    g = fingerprint_of_paragraph(paragraph)
    return f[0] - g[0], f[1] - g[1]


def fingerprint_of_paragraph(paragraph: str) -> tuple[np.ndarray, np.ndarray]:
    digest = hashlib.blake2b(paragraph.encode("utf-8", "surrogatepass"), digest_size=8 * IDENTITY).digest()
    return np.frombuffer(digest, dtype="<u8").copy(), sketch_lanes([paragraph])


def as_text(f) -> str:
    return base64.b64encode(f[0].astype("<u8").tobytes() + f[1].astype("<u2").tobytes()).decode()


def likeness(f, g) -> float:
    """Shared word triples over all word triples of both, estimated; 1 for equal ones."""
    if (f[0] == g[0]).all() and (f[1] == g[1]).all():
        return 1.0
    a, b = f[1].view(np.int16).astype(np.float64), g[1].view(np.int16).astype(np.float64)
    shared, total = a @ b, a @ a + b @ b
    if total == 0:
        return 0.0
    return float(np.clip(shared / (total - shared), 0.0, 1.0))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, extra, ...) in which each range is followed by the next one's first row."""
    rows = documents_only(docs).select(F.col("doc_id").cast("long"), "text")
    n = rows.count()
    ranges = min(max(1, n // ROWS_PER_RANGE), MAX_RANGES)
    # Only the ranges' borders come from some of the ids; every row is dealt to a range.
    some = rows.select("doc_id").filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // (IDS_PER_RANGE * ranges)))) == 0)
    cuts = sorted(set(some.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    shared = docs.sparkSession.sparkContext.broadcast(np.array(cuts, dtype=np.int64))  # 512 KB at most

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, ids.to_numpy(dtype=np.int64), side="right"), dtype="int32")

    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(place(F.coalesce("doc_id", F.lit(0).cast("long"))) if cuts else F.lit(0))
    dealt = rows.withColumn("bucket", bucket)
    heads = staged(dealt.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text")).alias("head")), "heads")
    # The ranges in order: numbers alone, ``MAX_RANGES`` at most. Texts are joined to them.
    order = Window.orderBy("bucket")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(everything))
    numbers = heads.select("bucket", after.alias("after"))
    follow = numbers.join(heads.withColumnRenamed("bucket", "after"), "after").select("bucket", F.lit(True).alias("extra"), "head.no_id", "head.doc_id", "head.text")
    return dealt.select("bucket", F.lit(False).alias("extra"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "text").unionByName(follow)


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def pairs(frames):
        before = None
        for frame in frames:
            out = []
            for extra, doc_id, text in zip(frame["extra"], frame["doc_id"], frame["text"]):
                own = fingerprint(text)
                if before is not None:
                    last_id, last_text, last = before
                    half = len(last_text) // 2
                    edited_text = last_text[: len(last_text) - half] + text[:half]
                    edited = fingerprint(edited_text)
                    sha = hashlib.sha256(edited_text.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((last_id, len(last_text), sha, as_text(last), as_text(edited), likeness(last, edited), likeness(last, own)))
                before = None if extra else (doc_id, text, own)
            yield pd.DataFrame(out, columns=names)

    schema = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]
    rows = with_next(docs)
    in_order = rows.repartition("bucket").sortWithinPartitions("bucket", "extra", "no_id", "doc_id", "text")
    return with_long_ids(in_order.select("extra", F.col("doc_id").cast("string"), "text").mapInPandas(pairs, schema))


def op10_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))
