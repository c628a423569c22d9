"""Token-id files: byte- or bit-plane shuffled, zstandard-compressed id blocks.

Documents are encoded where they are read; their ids, two bytes each, are written and
then sorted by doc_id into shards (one task each), so that texts never cross the network.
A shard is gathered into chunks of whole documents. A chunk's ids are split into blocks of ``BLOCK``;
each block is transposed into planes and each plane compressed. A chunk is one
record of a Parquet folder that Spark commits, so a lost executor or a retried
task leaves no torn file: (shard, chunk, first, doc_ids, lengths, block_ids,
plane_bytes, width, payload). The columns beside ``payload`` are the chunk index;
they are read without it.

Cases: a null or empty text is a document of the end id alone. A null doc_id sorts
last. Rows of equal doc_id follow one another in scan order. An empty table writes
an empty folder and reads back empty. Columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from purselake.llm.common import new_folder, staged, table, with_long_ids, with_text_ids
from purselake.llm.wordbpe import batches, encoder

BLOCK = 1 << 16
CHUNK_IDS = 1 << 18
END_ID = 2


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Planes of one block of little-endian ids, most of them nearly constant."""
    columns = ids.view(np.uint8).reshape(len(ids), ids.dtype.itemsize)
    if bits:
        return [x.tobytes() for x in np.packbits(np.unpackbits(columns, axis=1).T, axis=1)]
    return [x.tobytes() for x in np.ascontiguousarray(columns.T)]


def from_planes(planes: list[bytes], n: int, width: int, bits: bool = False) -> np.ndarray:
    rows = np.array([np.frombuffer(p, dtype=np.uint8) for p in planes])
    if bits:
        rows = np.packbits(np.unpackbits(rows, axis=1)[:, :n].T, axis=1)
    else:
        rows = np.ascontiguousarray(rows.T)
    return rows.reshape(-1).view(f"<u{width}")


def pack_chunk(ids: np.ndarray, bits: bool = False) -> tuple[list[int], list[int], bytes]:
    """(ids of each block, bytes of each plane, payload)."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    planes = [squeeze(p) for b in blocks for p in to_planes(b, bits)]
    return [len(b) for b in blocks], [len(p) for p in planes], b"".join(planes)


def unpack_chunk(block_ids, plane_bytes, width: int, payload: bytes, bits: bool = False) -> np.ndarray:
    import zstandard

    open_up = zstandard.ZstdDecompressor().decompress
    per_block = width * 8 if bits else width
    ends = np.cumsum([0, *plane_bytes])
    planes = [open_up(payload[a:b]) for a, b in zip(ends, ends[1:])]
    parts = [from_planes(planes[k * per_block : (k + 1) * per_block], int(n), width, bits) for k, n in enumerate(block_ids)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=f"<u{width}")


CHUNK_SCHEMA = "shard int, chunk int, first long, doc_ids array<string>, lengths array<long>, block_ids array<int>, plane_bytes array<int>, width int, payload binary"


ENCODED_SCHEMA = "doc_id string, ids binary"


def encoded_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id as text, ids as the bytes of little-endian integers) of every document."""

    def encode(frames):
        worker = encoder(tokenizer_path)
        end = np.array([end_id], dtype=worker.dtype).tobytes()
        for frame in frames:
            at, ids_of = 0, frame["doc_id"]
            for texts in batches(frame["text"].tolist()):
                yield pd.DataFrame({"doc_id": ids_of[at : at + len(texts)], "ids": [x + end for x in worker.encode_bytes(texts)]})
                at += len(texts)

    return with_text_ids(docs).mapInPandas(encode, ENCODED_SCHEMA)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, bits: bool = False) -> None:
    """Encode every document and write the chunks, in ascending doc_id order."""
    width = encoder(tokenizer_path).width

    def gather(frames):
        shard, chunk, first = TaskContext.get().partitionId(), 0, 0
        held, held_ids, size = [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(held), dtype=f"<u{width}")
            block_ids, plane_bytes, payload = pack_chunk(ids, bits)
            return pd.DataFrame([(shard, chunk, first, held_ids, [len(x) // width for x in held], block_ids, plane_bytes, width, payload)], columns=names)

        for frame in frames:
            for doc_id, ids in zip(frame["doc_id"].tolist(), frame["ids"].tolist()):
                if held and size + len(ids) // width > CHUNK_IDS:
                    yield flush()
                    chunk, first = chunk + 1, first + size
                    held, held_ids, size = [], [], 0
                held.append(ids)
                held_ids.append(doc_id)
                size += len(ids) // width
        if held:
            yield flush()

    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
    order = [F.col("number").asc_nulls_last(), F.col("row")]
    rows = staged(encoded_documents(docs, tokenizer_path, end_id), "encoded").select("*", F.col("doc_id").cast("long").alias("number"), F.monotonically_increasing_id().alias("row"))
    chunks = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids").mapInPandas(gather, CHUNK_SCHEMA)
    chunks.write.option("compression", "none").parquet(folder)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False, bits: bool = False) -> DataFrame:
    """Documents of a folder: doc_id, start, n_tokens, ids_crc32 [, ids].

    ``start`` counts the ids of all documents before: the shards' totals come from
    the chunk index alone, one row a shard.
    """
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(folder)
    totals = chunks.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def decode(frames):
        for frame in frames:
            for c in frame.itertuples(index=False):
                ids = unpack_chunk(c.block_ids, c.plane_bytes, c.width, c.payload, bits).astype("<u4")
                out, at = [], 0
                for doc_id, n in zip(c.doc_ids, c.lengths):
                    own = ids[at : at + n]
                    out.append((doc_id, c.base + c.first + at, n, zlib.crc32(own), *([own] if with_ids else [])))
                    at += int(n)
                yield pd.DataFrame(out, columns=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id string, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return with_long_ids(chunks.join(F.broadcast(bases), "shard").mapInPandas(decode, schema))


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, folder)
