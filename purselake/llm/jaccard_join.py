"""Chosen-path join: documents whose sets of five-word shingles have Jaccard
similarity of at least 0.8, as classes and link counts.

Texts with equal shingle sets are one *set* with a number of copies. Every set is
embedded as ``COORDINATES`` least hashes; two sets agree in a coordinate with
probability equal to their similarity. A run is a random tree: a node picks each
coordinate with probability 1 / (``BRANCH`` * ``COORDINATES``), all sets in the node
alike, and passes each set to the child named by its value there. Buckets of at most
``BUCKET`` sets are compared pair by pair; larger ones split again. After
``DEPTH`` levels a bucket that is still large is cut into blocks, and all pairs of
blocks are compared, so that no bucket is capped. ``RUNS`` runs bring the chance of
missing a pair of similarity 0.8 below 0.2 % at three levels and 1 % at six.

A pair meets in many buckets and is compared only in the least of them. Candidates
(by 64 one-byte least hashes) are verified exactly on their shingles inside the
bucket's task; what leaves it is one row a set: its links found there and the least
set it is joined to. Classes are the connected components of those links. Copies
never meet in pairs: they share the set's row.

Words are white-space-separated, lower-cased. Cases: a text of one to four words is
one shingle; texts without words (null, empty) have the empty set, which equals
only itself; repeated rows are copies; a null doc_id is kept and never names a class
if another member has an id; an empty table gives an empty result. Shingles are
32-bit hashes and sets 64-bit hashes; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purselake.llm.common import hot_aware_join, keep_nothing, likely_in, staged, table, with_long_ids, with_text_ids

WORDS = 5
SIMILARITY = 0.8
COORDINATES = 128
RUNS = 16
BRANCH = 0.7
BUCKET = 2048
DEPTH = 6
#: Share of 64 one-byte least hashes in which candidates agree: 4.4 deviations below 0.8.
LIKELY = 0.58

_MIX = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240)
_XOR = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit hash, with wrap-around."""
    x = np.asarray(x).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the text's five-word shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint32)
    crc = zlib.crc32
    h = np.array([crc(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)
    n = max(len(h) - WORDS + 1, 1)
    total = np.full(n, min(len(h), WORDS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(WORDS, len(h))):
            total = total * _MIX + h[k : k + n]
    return np.unique((mix(total) >> np.uint64(32)).astype(np.uint32))


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(shingles), 4096):
        some = shingles[at : at + 4096]
        np.minimum(out, ((some[None, :] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=out)
    return out


def with_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, set (64-bit hash of the shingle set), sketch, roots (the set's
    buckets one level below the ``RUNS`` roots), shingles."""
    nodes = mix(np.arange(1, RUNS + 1, dtype=np.uint64)).view(np.int64)

    def build(frames):
        keep_nothing()
        for frame in (x.iloc[at : at + 1000] for x in frames for at in range(0, len(x), 1000)):
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                s = shingle_set(text)
                name = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True)
                if len(s):
                    sketch = least_hashes(s)
                    roots = child_buckets(np.broadcast_to(sketch, (RUNS, COORDINATES)), nodes)[1].tolist()
                    rows.append((doc_id, name, sketch.tobytes(), roots, s.tobytes()))
                else:
                    rows.append((doc_id, name, None, None, b""))
            out = pd.DataFrame(rows, columns=["doc_id", "set", "sketch", "roots", "shingles"])
            out.insert(1, "text_hash", frame["text_hash"].values)
            yield out

    rows = with_text_ids(docs).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return with_long_ids(rows.mapInPandas(build, "doc_id string, text_hash long, set long, sketch binary, roots array<long>, shingles binary"))


def child_buckets(sketches: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child bucket) of each coordinate that each row's node picks."""
    coordinates = np.arange(COORDINATES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        draw = mix(nodes.view(np.uint64)[:, None] * _MIX + coordinates[None, :])
        picked = draw < np.uint64(int(2**64 / (BRANCH * COORDINATES)))
        row, at = np.nonzero(picked)
        child = mix(draw[row, at] * _MIX + sketches[row, at].astype(np.uint64))
    return row, child.view(np.int64)


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint32).reshape(-1, COORDINATES)


def descend(rows: DataFrame) -> DataFrame:
    """(bucket, set) one level below the buckets of ``rows`` (bucket, set, sketch)."""

    def split(frames):
        keep_nothing()
        for frame in frames:
            sets, sketches = frame["set"].to_numpy(np.int64), _sketches(frame["sketch"])
            row, child = child_buckets(sketches, frame["bucket"].to_numpy(np.int64))
            yield pd.DataFrame({"bucket": child, "set": sets[row]})

    return rows.mapInPandas(split, "bucket long, set long")


def one_each(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """(set, column) of the ``wanted`` sets; other rows are filtered before the shuffle."""
    count = wanted.count()
    near = likely_in(rows.select("set", column).filter(F.col(column).isNotNull()), "set", wanted, count)
    return near.groupBy("set").agg(F.first(column).alias(column)).join(wanted, "set", "left_semi")


def small_buckets(rows: DataFrame, limit: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """(bucket, set): all buckets of two to ``limit`` sets (see the module's text)."""
    roots = rows.filter(F.col("roots").isNotNull()).groupBy("set").agg(F.first("roots").alias("roots"))
    done, level = [], roots.select(F.explode("roots").alias("bucket"), "set")
    for left in range(depth - 1, -1, -1):
        level = staged(level, "paths")
        sizes = staged(level.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
        sized = staged(likely_in(level, "bucket", sizes, sizes.count()).join(sizes, "bucket"), "sized")
        done.append(sized.filter(F.col("n") <= limit).select("bucket", "set"))
        large = sized.filter(F.col("n") > limit)
        if large.isEmpty():
            break
        if left:
            sketches = one_each(rows, "sketch", large.select("set").distinct())
            level = descend(large.select("bucket", "set").join(sketches, "set"))
            continue
        blocks = F.ceil(F.col("n") / (limit // 2)).cast("long")
        own = F.pmod(F.xxhash64("set"), blocks)
        pairs = large.select("set", "bucket", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
        done.append(pairs.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "set"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def by_bucket(frames, work, columns):
    """Call ``work`` on each bucket's rows; batches are sorted by bucket and may cut one."""
    held = None
    keep_nothing()
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        keys = frame["bucket"].to_numpy(np.int64)
        cuts = np.flatnonzero(np.diff(keys)) + 1
        ends = [0, *cuts.tolist()]
        data = {c: frame[c].to_numpy() for c in frame.columns}
        out = [work({c: v[a:b] for c, v in data.items()}) for a, b in zip(ends, ends[1:])]
        held = frame.iloc[ends[-1] :]
        out = [x for x in out if x is not None]
        if out:
            yield pd.DataFrame({c: [y for x in out for y in x[k]] for k, c in enumerate(columns)})
    if held is not None and len(held):
        x = work({c: held[c].to_numpy() for c in held.columns})
        if x is not None:
            yield pd.DataFrame({c: list(x[k]) for k, c in enumerate(columns)})


def candidates(bucket: dict) -> tuple | None:
    """(bucket, set, place, partners) of the sets with a likely partner at a later place
    or an earlier one, for pairs that meet in no lesser bucket."""
    order = np.argsort(bucket["set"], kind="stable")
    sets, key = bucket["set"][order], int(bucket["bucket"][0])
    bytes_ = np.frombuffer(b"".join(bucket["brief"][order]), dtype=np.uint8).reshape(len(sets), 64)
    lesser = [{x for x in b if x < key} for b in bucket["buckets"][order]]
    partners: list[list[int]] = [[] for _ in sets]
    needed = set()
    for i in range(len(sets) - 1):
        likely = np.flatnonzero((bytes_[i + 1 :] == bytes_[i]).sum(axis=1) >= LIKELY * 64) + i + 1
        mine = lesser[i]
        found = [j for j in likely.tolist() if mine.isdisjoint(lesser[j]) and sets[i] != sets[j]]
        if found:
            partners[i] = found
            needed.update(found)
            needed.add(i)
    if not needed:
        return None
    places = sorted(needed)
    return [key] * len(places), [int(sets[p]) for p in places], places, [partners[p] for p in places]


def verified(bucket: dict) -> tuple | None:
    """(set, links, root) of the sets with a partner of at least ``SIMILARITY``."""
    order = np.argsort(bucket["place"])
    sets, copies = bucket["set"][order], bucket["copies"][order]
    at = {int(p): n for n, p in enumerate(bucket["place"][order])}
    shingles = [np.frombuffer(b, dtype=np.uint32) for b in bucket["shingles"][order]]
    links, root = np.zeros(len(sets), dtype=np.int64), list(range(len(sets)))

    def top(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for i, partners in enumerate(bucket["partners"][order]):
        if not len(partners):
            continue
        own = shingles[i]
        others = [at[int(p)] for p in partners]
        sizes = np.array([len(shingles[j]) for j in others])
        joined = np.concatenate([shingles[j] for j in others])
        place = np.minimum(np.searchsorted(own, joined), len(own) - 1)
        shared = np.add.reduceat((own[place] == joined).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        for j in np.flatnonzero(shared >= SIMILARITY * (sizes + len(own) - shared) - 1e-9):
            j = others[j]
            links[i] += copies[j]
            links[j] += copies[i]
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    linked = np.flatnonzero(links)
    if not len(linked):
        return None
    return sets[linked].tolist(), links[linked].tolist(), [int(sets[top(n)]) for n in linked]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected (a, b) edges; the component is its least node.

    Every round takes the least label among the neighbours and then the label's own
    label; rounds end when none changes. Each round is a written table.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("least"))
        stepped = staged(labels.join(seen, labels.node == seen.a).select("node", "label", F.least("label", "least").alias("next")), "labels")
        up = stepped.select(F.col("node").alias("up_node"), F.col("next").alias("up_next"))
        jumped = staged(stepped.join(up, F.col("next") == F.col("up_node")).select("node", F.least("next", "up_next").alias("label"), (F.least("next", "up_next") != F.col("label")).alias("changed")), "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("changed").isEmpty():
            return labels.withColumnRenamed("label", "component")


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, class_id (least doc_id of its class),
    n_links (other documents of similarity at least 0.8, copies included), class_set."""
    rows = staged(with_sets(docs), "sets")
    members = rows.select("doc_id", "text_hash", "set")
    total = rows.count()
    classes = staged(rows.groupBy("set").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")), "classes")
    buckets = staged(small_buckets(rows), "buckets").distinct()
    lists = staged(buckets.groupBy("set").agg(F.collect_list("bucket").alias("buckets")), "lists")
    sketches = one_each(rows, "sketch", lists.select("set"))
    brief = F.unhex(F.expr("array_join(transform(sequence(0, 63), i -> substring(hex(sketch), 8 * i + 1, 2)), '')"))
    held = lists.join(sketches, "set").select("set", "buckets", brief.alias("brief")).select(F.explode("buckets").alias("bucket"), "*")
    pairs = (
        held.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInPandas(lambda frames: by_bucket(frames, candidates, ["bucket", "set", "place", "partners"]), "bucket long, set long, place int, partners array<int>")
    )
    pairs = staged(pairs, "pairs")
    wanted = staged(pairs.select("set").distinct(), "wanted")
    copies = likely_in(classes.select("set", "copies"), "set", wanted, wanted.count())
    shingles = one_each(rows, "shingles", wanted).join(copies, "set")
    found = (
        pairs.join(shingles, "set")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInPandas(lambda frames: by_bucket(frames, verified, ["set", "links", "root"]), "set long, links long, root long")
    )
    found = staged(found, "links")
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    tree = components(found.filter("set <> root").select(F.col("set").alias("a"), F.col("root").alias("b")))
    tree = staged(tree.join(classes, tree.node == classes.set).select("node", "component", "first_id"), "tree")
    named = staged(tree.groupBy("component").agg(F.min("first_id").alias("class_id"), F.count(F.lit(1)).alias("n")), "named")
    joined = hot_aware_join(tree, named, "component", "n", max(tree.count(), 1)).select(F.col("node").alias("set"), "class_id", "component")
    info = (
        classes.join(links, "set", "left")
        .join(joined, "set", "left")
        .select(
            "set",
            "copies",
            F.coalesce("class_id", "first_id").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "set").alias("class_set"),
        )
    )
    out = hot_aware_join(members, staged(info, "info"), "set", "copies", total)
    return out.select("doc_id", "text_hash", "class_id", "n_links", "class_set")


def one_per_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all columns, one of each class: that of the least
    (doc_id, text hash); of rows equal in both, any one."""
    rows = jaccard_classes(docs).groupBy("class_set", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "n"))
    keep = staged(rows.groupBy("class_set").agg(first.alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_hash").alias("kept_hash"), "k.n"), "keep")

    def kept(chosen: DataFrame) -> DataFrame:
        same = docs["doc_id"].cast("long").eqNullSafe(chosen["kept_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == chosen["kept_hash"])
        return docs.join(chosen, same, "left_semi")

    alone, repeated = keep.filter("n = 1"), keep.filter("n > 1")
    if repeated.isEmpty():
        return kept(alone)
    holder = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    boxed = kept(repeated).select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("hash"), holder.alias("row"))
    one = boxed.groupBy("id", "hash").agg(F.first("row").alias("row")).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    return kept(alone).unionByName(one)


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
