"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks, matrices of up to ``BLOCK`` rows; the queries among them
into blocks of their own. Every pass scores each query block against each candidate block
in one matrix product, and none of the scores is kept:

1. A pass counts, for each query, its scores into ``BINS`` equal bins of the range in
   which its k-th best score must lie. Tasks add the counts up and cut each histogram
   below its own k-th best score, which the corpus's k-th best cannot be under; sums over
   all tasks say in which bin the k-th score lies and how many scores are above it.
2. The next pass divides that bin again, until bins are one score wide or few scores are
   left in them. Queries that are done take no part in further passes.
3. A last pass filters the scores from the bound of each query on. Of equal scores a task
   passes on those of the smallest vec_ids, at most k a query, so a vector with copies
   everywhere costs no more than another; a ranking by (score, vec_id) ends it.

Products are exact: single precision where norms prove that all sums are under 2**24,
double under 2**53, else whole numbers of 64 bits. Blocks, bounds and queries are written
tables, so lost executors cost rereads.

Cases: vectors that are null or hold null or non-finite components take no part. A null
vec_id is no query; as a candidate it comes last among ties. Rows of equal vec_id are
rows of their own, and only the query's own row is left out. A vector shorter than
another counts as filled up with zeros. A component beyond sqrt(2**62 / dimension) counts
as that bound, so that scores fit into a long. Fewer than k candidates are all returned.
An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from purselake.llm.common import staged, table

BLOCK = 2048
QUERY_BLOCK = 512
BINS = 2048
HELD_BLOCKS = 16
ENOUGH = 8
SCALE = 1024

_BLOCKS = "n int, dim int, norm double, rows binary, ids binary, known binary, matrix binary"


def whole_vectors(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """(vec_id, v): the rows that take part, components as doubles."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col(id_).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & sound)


def quantized(values: np.ndarray, dim: int, scale: int) -> np.ndarray:
    bound = np.floor(np.sqrt(2.0**62 / max(dim, 1)))
    return np.clip(np.floor(scale * values), -bound, bound).astype(np.int64)


def matrix_of(lists: pa.ListArray, scale: int) -> np.ndarray:
    """Rows of whole numbers, short ones filled up with zeros."""
    ends = np.asarray(lists.offsets)
    sizes = np.diff(ends)
    dim = int(sizes.max(initial=0))
    flat = quantized(np.asarray(lists.values)[ends[0] : ends[-1]], dim, scale)
    if (sizes == dim).all():
        return flat.reshape(len(lists), dim)
    out = np.zeros((len(lists), dim), dtype=np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def smallest(matrix: np.ndarray) -> np.ndarray:
    top = int(np.abs(matrix).max(initial=0))
    return matrix.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def packed(rows: np.ndarray, ids: np.ndarray, known: np.ndarray, matrix: np.ndarray) -> dict:
    norms = np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))
    return {
        "n": len(rows), "dim": matrix.shape[1], "norm": float(norms.max(initial=0)), "rows": rows.astype(np.int64).tobytes(),
        "ids": ids.astype(np.int64).tobytes(), "known": known.astype(np.bool_).tobytes(), "matrix": smallest(matrix).tobytes(),
    }


class Block:
    """A packed block opened up."""

    def __init__(self, r: dict, prefix: str = ""):
        self.n, self.dim, self.norm = (r[prefix + c] for c in ("n", "dim", "norm"))
        self.rows, self.ids = (np.frombuffer(r[prefix + c], dtype=np.int64) for c in ("rows", "ids"))
        self.known = np.frombuffer(r[prefix + "known"], dtype=np.bool_)
        raw = r[prefix + "matrix"]
        width = len(raw) // max(1, self.n * self.dim) if raw else 2
        self.matrix = np.frombuffer(raw, dtype=f"<i{width}").reshape(self.n, self.dim)
        self.cast: dict[type, np.ndarray] = {}

    def as_type(self, kind: type, dim: int) -> np.ndarray:
        if kind not in self.cast:
            self.cast[kind] = self.matrix.astype(kind)
        return self.cast[kind][:, :dim]


def scores(q: Block, c: Block) -> tuple[np.ndarray, np.ndarray]:
    """(scores as whole numbers, mask of the pairs that are one row)."""
    dim, most = min(q.dim, c.dim), q.norm * c.norm
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    product = q.as_type(kind, dim) @ c.as_type(kind, dim).T
    own = np.zeros(product.shape, dtype=bool)
    order = np.argsort(c.rows)
    at = np.minimum(np.searchsorted(c.rows[order], q.rows), c.n - 1)
    same = c.rows[order[at]] == q.rows
    own[np.flatnonzero(same), order[at[same]]] = True
    return product.astype(np.int32 if kind is np.float32 else np.int64), own


def candidate_blocks(vectors: DataFrame, scale: int) -> DataFrame:
    def pack(frames):
        for frame in frames:
            for i in range(0, frame.num_rows, BLOCK):
                part = frame.slice(i, BLOCK)
                ids = part.column("vec_id")
                yield pa.RecordBatch.from_pylist([packed(np.asarray(part.column("row")), np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()), matrix_of(part.column("v"), scale))], schema=_arrow(_BLOCKS))

    return vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v").mapInArrow(pack, _BLOCKS)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in ddl.split(", ")])


def queries_of(blocks: DataFrame, every: int) -> DataFrame:
    """(row, query_id, vector): the rows of blocks whose id is divisible by ``every``."""
    ddl = "row long, query_id long, dim int, vector binary"

    def pick(frames):
        for frame in frames:
            for r in frame.to_pylist():
                b = Block(r)
                found = np.flatnonzero(b.known & (b.ids % every == 0))
                vectors = b.matrix[found].astype(np.int64)
                rows = [{"row": int(b.rows[i]), "query_id": int(b.ids[i]), "dim": b.dim, "vector": v.tobytes()} for i, v in zip(found, vectors)]
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow(ddl))

    return blocks.mapInArrow(pick, ddl)


_QUERY_BLOCKS = f"{_BLOCKS}, bounds binary"


def query_blocks(queries: DataFrame, bounds: DataFrame, count: int) -> DataFrame:
    """Blocks of the queries in ``bounds`` (row, low), with their bounds."""

    def pack(frames):
        for frame in frames:
            for i in range(0, frame.num_rows, QUERY_BLOCK):
                part = frame.slice(i, QUERY_BLOCK)
                dims = np.asarray(part.column("dim"))
                matrix = np.zeros((len(dims), dims.max(initial=0)), dtype=np.int64)
                for k, raw in enumerate(part.column("vector").to_pylist()):
                    matrix[k, : dims[k]] = np.frombuffer(raw, dtype=np.int64)
                block = packed(np.asarray(part.column("row")), np.asarray(part.column("query_id")), np.ones(len(dims)), matrix)
                yield pa.RecordBatch.from_pylist([block | {"bounds": np.asarray(part.column("low")).tobytes()}], schema=_arrow(_QUERY_BLOCKS))

    rows = queries.join(bounds.select("row", "low"), "row").repartition(max(1, -(-count // QUERY_BLOCK)), "row")
    return rows.select("row", "query_id", "dim", "vector", "low").mapInArrow(pack, _QUERY_BLOCKS)


def block_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every query block beside every candidate block: the stated queries against all rows."""
    side = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    return candidates.crossJoin(side)


class Opened:
    """Blocks of pairs, each opened once while it recurs."""

    def __init__(self):
        self.kept: dict[tuple, Block] = {}

    def get(self, r: dict, prefix: str) -> Block:
        key = (prefix, r[prefix + "rows"])
        if key not in self.kept:
            if len(self.kept) >= 2 * HELD_BLOCKS:
                self.kept.clear()
            self.kept[key] = Block(r, prefix)
        return self.kept[key]


def histograms(pairs: DataFrame, shift: int, k: int) -> DataFrame:
    """(row, bin, n): scores of each query by bin of its range, from above as far as a
    task's own k-th best."""
    ddl = "row long, bin int, n long"

    def count(frames):
        opened, held = Opened(), {}

        def flush():
            for rows, counts in held.values():
                above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
                q, bins = np.nonzero((counts > 0) & (above < k))
                yield pa.RecordBatch.from_arrays([pa.array(rows[q]), pa.array(bins.astype(np.int32)), pa.array(counts[q, bins])], names=["row", "bin", "n"])
            held.clear()

        for frame in frames:
            for r in frame.to_pylist():
                q, c = opened.get(r, "q_"), opened.get(r, "")
                found, own = scores(q, c)
                low = np.frombuffer(r["q_bounds"], dtype=np.int64)
                bins = (found.astype(np.int64) - low[:, None]) >> shift
                take = (bins >= 0) & (bins < BINS) & ~own
                flat = (bins + np.arange(q.n)[:, None] * BINS)[take]
                key = r["q_rows"]
                if key not in held:
                    if len(held) >= HELD_BLOCKS:
                        yield from flush()
                    held[key] = (q.rows, np.zeros((q.n, BINS), dtype=np.int64))
                held[key][1].reshape(-1)[:] += np.bincount(flat, minlength=q.n * BINS)
        yield from flush()

    return pairs.mapInArrow(count, ddl).groupBy("row", "bin").agg(F.sum("n").alias("n"))


def kth_bins(counted: DataFrame, bounds: DataFrame, shift: int, k: int) -> DataFrame:
    """New bounds (row, low, above, inside): the bin of each query's k-th score, the
    scores above it and in it. A query with fewer than k scores keeps its lowest bound."""
    down = Window.partitionBy("row").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = counted.join(bounds, "row").withColumn("upto", F.col("above") + F.sum("n").over(down))
    t = t.filter((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k))
    found = t.select("row", (F.col("low") + F.col("bin").cast("long") * F.lit(1 << shift)).alias("low"), (F.col("upto") - F.col("n")).alias("above"), F.col("n").alias("inside"))
    few = bounds.join(found.select("row"), "row", "left_anti").select("row", "low", F.col("above"), F.lit(0).cast("long").alias("inside"))
    return found.unionByName(few)


def best_scores(pairs: DataFrame, k: int) -> DataFrame:
    """(row, query_id, vec_id, score) from each query's bound on, at most k a query from
    the blocks that a task holds together."""
    ddl = "row long, query_id long, vec_id long, score long"

    def pick(frames):
        opened, held = Opened(), {}

        def cut(parts):
            q, known, ids, score = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((ids, ~known, -score, q))
            q = q[order]
            first = np.searchsorted(q, q)
            order = order[np.arange(len(q)) - first < k]
            return [x[order] for x in (np.concatenate(y) for y in zip(*parts))]

        def flush():
            for block, parts in held.values():
                q, known, ids, score = cut(parts)
                yield pa.RecordBatch.from_arrays([pa.array(block.rows[q]), pa.array(block.ids[q]), pa.array(ids, mask=~known), pa.array(score)], names=["row", "query_id", "vec_id", "score"])
            held.clear()

        for frame in frames:
            for r in frame.to_pylist():
                q, c = opened.get(r, "q_"), opened.get(r, "")
                found, own = scores(q, c)
                low = np.frombuffer(r["q_bounds"], dtype=np.int64)
                at_q, at_c = np.nonzero((found >= low[:, None]) & ~own)
                part = cut([(at_q, c.known[at_c], c.ids[at_c], found[at_q, at_c].astype(np.int64))])
                key = r["q_rows"]
                if key not in held and len(held) >= HELD_BLOCKS:
                    yield from flush()
                parts = held.setdefault(key, (q, []))[1]
                parts.append(part)
                if len(parts) > 8:
                    parts[:] = [cut(parts)]
        yield from flush()

    return pairs.mapInArrow(pick, ddl)


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible
    by ``every``, by inner product of the vectors floor(scale * x)."""
    blocks = staged(candidate_blocks(whole_vectors(vectors, id_, vector), scale), "vector-blocks")
    queries = staged(queries_of(blocks, every), "query-vectors")
    count = queries.count()
    norm = blocks.agg(F.max("norm")).first()[0] or 0.0
    lowest = -min(int(norm * norm * 1.001) + 1, (1 << 63) - 1)
    shift = max(0, (2 * -lowest // BINS).bit_length())
    bounds = queries.select("row", F.lit(lowest).cast("long").alias("low"), F.lit(0).cast("long").alias("above"))
    done, left = [], count
    while left:
        pairs = block_pairs(query_blocks(queries, bounds, left), blocks)
        found = staged(kth_bins(histograms(pairs, shift, k), bounds, shift, k), "score-bounds")
        ready = F.lit(shift == 0) | (F.col("above") + F.col("inside") <= ENOUGH * k)
        done.append(found.filter(ready))
        bounds = found.filter(~ready)
        left = bounds.count()
        shift = max(0, shift - (BINS.bit_length() - 1))
    if not done:
        return queries.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.col("query_id").alias("score")).filter(F.lit(False))
    final = done[0]
    for d in done[1:]:
        final = final.unionByName(d)
    best = best_scores(block_pairs(query_blocks(queries, final, count), blocks), k)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op13_exact_topk(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
