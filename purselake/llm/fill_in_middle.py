"""Fill-in-the-middle transformation of documents over boundary sets.

Where code points begin in a text's UTF-8 bytes, and where the text ends, is a set of
byte offsets. ``BoundarySet`` keeps it like a compressed bitmap: offsets are split into
containers of 65,536; each is an array of offsets, a bitmap, or runs, whichever is the
smallest; cumulative cardinalities stand beside them. The byte offset of the k-th code
point is a search for the container in those, then a select inside it. Both cuts of a
document are two such selects, and its three parts are slices of bytes; no text is
decoded or walked through character by character.

A document's form and cuts hang on a hash of its ``doc_id`` and ``seed`` alone, so they
do not depend on the order or the place of rows. One pass over the documents, no shuffle.
``restored`` rebuilds the exact texts with SQL functions alone.

Cases: a null or empty text is plain and empty. A text that holds a marker stays plain,
so markers in an output are always ours. A null doc_id hashes as no digits. Rows of equal
doc_id have equal hashes, and equal cuts if their texts are equal. Cuts may fall on the
same place or on an end of the text; parts are then empty. An empty table gives an empty
result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purselake.llm.common import documents_only, table

SPAN = 1 << 16
MARKERS = ("<P>", "<S>", "<M>")
PLAIN_FROM = 90
SPM_BELOW = 20
BATCH_BYTES = 8_000_000


class BoundarySet:
    """Byte offsets at which the code points of UTF-8 bytes begin, and their end."""

    def __init__(self, raw: bytes):
        self.size = len(raw)
        leads = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
        leads = np.append(leads, True)
        self.containers = [self._container(leads[i : i + SPAN]) for i in range(0, len(leads), SPAN)]
        #: Members before each container, and in all of them.
        self.before = np.cumsum([0, *(c[1] for c in self.containers)])

    @staticmethod
    def _container(flags: np.ndarray) -> tuple[str, int, np.ndarray, np.ndarray | None]:
        """(kind, cardinality, data, cumulative cardinalities inside)."""
        n = int(np.count_nonzero(flags))
        edges = np.flatnonzero(np.diff(flags, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        sizes = {"array": 2 * n, "bitmap": SPAN // 8, "run": 4 * len(starts)}
        kind = min(("run", "array", "bitmap"), key=sizes.__getitem__)
        if kind == "run":
            return kind, n, starts.astype(np.uint16), np.cumsum(ends - starts)
        if kind == "array":
            return kind, n, np.flatnonzero(flags).astype(np.uint16), None
        bits = np.packbits(flags, bitorder="little")
        return kind, n, bits, np.cumsum(np.bitwise_count(bits), dtype=np.int64)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th member, from 0: the byte offset behind k code points."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        kind, _, data, inside = self.containers[at]
        k -= int(self.before[at])
        if kind == "array":
            local = int(data[k])
        else:
            slot = int(np.searchsorted(inside, k, side="right"))
            k -= int(inside[slot - 1]) if slot else 0
            if kind == "run":
                local = int(data[slot]) + k
            else:
                local = 8 * slot + int(np.flatnonzero(np.unpackbits(data[slot : slot + 1], bitorder="little"))[k])
        return at * SPAN + local

    def cuts(self, j: int, k: int) -> tuple[int, int]:
        """Byte offsets of both cuts."""
        return self.select(j), self.select(k)


def hash_groups(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(doc_id: int | None, raw: bytes, markers: tuple[bytes, ...], seed: int, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW):
    """(n, form, prefix_chars, middle_chars, output) of one document's UTF-8 bytes."""
    bounds = BoundarySet(raw)
    n = len(bounds) - 1
    h1, h2, h3, h4 = hash_groups(doc_id, seed)
    if not raw or h3 % 100 >= plain_from or any(m in raw for m in markers):
        return n, "plain", None, None, raw
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = bounds.cuts(first, second)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    p, s, m = markers
    if h4 % 100 < spm_below:
        return n, "spm", first, second - first, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", first, second - first, b"".join((p, prefix, s, suffix, m, middle))


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def fill_in_middle(docs: DataFrame, seed: int = 1, markers: tuple[str, str, str] = MARKERS, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every document.

    ``markers`` go before prefix, suffix and middle, in this order. Of 100 hashes those
    from ``plain_from`` on stay plain; of 100 others those below ``spm_below`` have the
    suffix first.
    """
    signs = tuple(m.encode() for m in markers)

    def transform(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            held, size = [], 0
            for doc_id, text in zip(ids, texts):
                raw = text.as_py()
                held.append((doc_id, *transformed(doc_id, raw, signs, seed, plain_from, spm_below)))
                size += len(raw)
                if size > BATCH_BYTES:
                    yield as_batch(held)
                    held, size = [], 0
            if held:
                yield as_batch(held)

    def as_batch(rows):
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows = documents_only(docs).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(transform, SCHEMA).withColumn("output", F.col("output").cast("string"))


def restored(output, form, markers: tuple[str, str, str] = MARKERS):
    """Column: the text that an output of ``fill_in_middle`` was made of. Parts hold no
    marker, so the three markers cut an output into exactly its parts."""
    parts = F.split(output, "|".join(map(re.escape, markers)))
    piece = lambda i: F.get(parts, F.lit(i))
    psm = F.concat(piece(1), piece(3), piece(2))
    spm = F.concat(piece(2), piece(3), piece(1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    text = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


OP11_SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbers AS (
  SELECT doc_id, t, n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4
  FROM hashed
), formed AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), made AS (
  SELECT doc_id, n, t, form, a, b - a AS m, CASE form
    WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS output
  FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(output) AS output_sha256, sha256(t) AS restored_sha256
FROM made
"""
