"""Graph jobs over edge tables. Every round is written to the shared folder, so lineage
stays short and a lost executor costs one round at most; loops end on a count of zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purselake.sources.lake import written


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component): component is the least node of the connected component."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    both = written(e.union(e.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "m").alias("mid"))
        hop = labels.select(F.col("node").alias("mid"), F.col("component").alias("up"))
        nxt = written(step.join(hop, "mid").select("node", F.least("mid", "up").alias("component"), (F.least("mid", "up") != F.col("old")).alias("moved")), "labels")
        labels = nxt.select("node", "component")
        if nxt.filter("moved").isEmpty():
            return labels


def chain_ends(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(start, end, steps) of one-to-one chains: follow while out-degree and in-degree are
    one, without revisiting; pointers double every round, so rounds are logarithmic."""
    out = edges.groupBy(src).agg(F.count(F.lit(1)).alias("o"), F.min(dst).alias("d")).filter("o = 1")
    into = edges.groupBy(dst).agg(F.count(F.lit(1)).alias("i")).filter("i = 1").withColumnRenamed(dst, "d")
    hops = written(out.join(into, "d").select(F.col(src).alias("start"), F.col("d").alias("end"), F.lit(1).cast("long").alias("steps")), "hops")
    limit = max(hops.count(), 1)
    span = 1
    while span < limit:
        more = hops.select(F.col("start").alias("end"), F.col("end").alias("far"), F.col("steps").alias("extra"))
        nxt = written(hops.join(more, "end", "left").select("start", F.coalesce("far", "end").alias("end"), (F.col("steps") + F.coalesce("extra", F.lit(0))).alias("steps"), F.col("far").isNotNull().alias("moved")), "hops")
        hops, span = nxt.drop("moved"), span * 2
        if nxt.filter("moved").isEmpty():
            break
    return hops


def longest_path_depth(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, depth, cyclic): depth is the longest path to the node; nodes on or behind a
    cycle are parked one below the deepest. One round a level of the graph."""
    e = written(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct(), "edges")
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    layer = nodes.join(e, nodes.node == e.b, "left_anti").withColumn("depth", F.lit(0))
    done, left = written(layer, "layer"), e
    while True:
        left = written(left.join(done, left.a == done.node, "left_anti"), "left")
        rest = nodes.join(done, "node", "left_anti")
        free = written(rest.join(left, rest.node == left.b, "left_anti"), "free")
        if free.isEmpty():
            break
        depth = e.join(free, e.b == free.node).join(done.select(F.col("node").alias("a"), "depth"), "a").groupBy("node").agg((F.max("depth") + 1).alias("depth"))
        done = written(done.unionByName(depth), "layer")
    last = done.agg(F.coalesce(F.max("depth"), F.lit(-1)).alias("m")).first()["m"]
    parked = nodes.join(done, "node", "left_anti").select("node", F.lit(last + 1).alias("depth"), F.lit(True).alias("cyclic"))
    return done.select("node", "depth", F.lit(False).alias("cyclic")).unionByName(parked)
