"""Join shapes that Spark's join does not name: range, as-of, tolerance, bridge, fallback."""

from __future__ import annotations

import math
import struct
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null equals null; the keys come from the left side."""
    right = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    out = left.join(right, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])


def range_join(facts: DataFrame, rules: DataFrame, eq: list[str], value: str, lo: str, hi: str, optional: list[str] = ()) -> DataFrame:
    """Facts with the rules of equal ``eq`` keys whose [lo, hi] holds ``value``; a null in a
    rule's ``optional`` key matches any. The equal keys carry the hash join; ranges are a
    residual condition."""
    names = {c: f"__rule_{c}" for c in [*eq, *optional]}
    side = rules.select(*[F.col(c).alias(names.get(c, c)) for c in rules.columns])
    on = [F.col(c) == F.col(names[c]) for c in eq] + [F.col(value).between(F.col(lo), F.col(hi))]
    on += [F.col(names[c]).isNull() | (F.col(names[c]) == F.col(c)) for c in optional]
    return facts.join(side, on).drop(*names.values())


def asof_join(left: DataFrame, right: DataFrame, eq: list[str], left_t: str, right_t: str) -> DataFrame:
    """Left rows with the right row of equal keys and the latest right_t <= left_t.

    Both sides are merged into one stream per key and the last right row is carried
    forward, so a key costs its own rows and not their product."""
    values = [c for c in right.columns if c not in eq]
    l = left.select("*", F.col(left_t).alias("__t"), F.lit(1).alias("__side"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"__v_{c}") for c in values])  # noqa: E741
    r = right.select(*[F.col(c) if c in eq else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(right_t).alias("__t"), F.lit(0).alias("__side"), *[F.col(c).alias(f"__v_{c}") for c in values])
    w = Window.partitionBy(*eq).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = r.unionByName(l).select(*left.columns, "__side", *[F.last(f"__v_{c}", ignorenulls=True).over(w).alias(c) for c in values if c not in left.columns])
    return carried.filter("__side = 1").drop("__side")


def tolerance_match(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, tol: float, id_: str, other: str) -> DataFrame:
    """(``id_``, ``other``): for each left id the least ``other`` but itself of the right rows
    of equal keys with |a - b| < tol, in doubles. Ids without any are left out.

    No pairs are built. The two least ``other`` of each distinct right value run through blocks
    of 1.5 times the tolerance, upwards and downwards: what a left value reaches ends in one
    block, begins in another and holds at most one between, so three rows answer it.
    """
    size, below = 1.5 * tol, math.nextafter(tol, 0)
    # |a - b| rounds to less than tol as long as it does not pass the middle of tol and the
    # double below it; the middle itself rounds to the even one of the two.
    half, even = (tol - below) / 2, struct.unpack("<q", struct.pack("<d", below))[0] % 2 == 0
    full = lambda df: df.filter(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in df.columns]))
    known = lambda df, value, c: full(df.select(*keys, (F.col(value).cast("double") + 0.0).alias("__v"), c)).filter(F.abs("__v") < float("inf"))
    block = lambda v: F.rint(v / size) + 0.0
    none = F.lit(None).cast(right.schema[other].dataType)

    def two_least(df):
        ranked = df.withColumn("__n", F.dense_rank().over(Window.partitionBy(*keys, "__v").orderBy(other))).filter("__n <= 2")
        return ranked.groupBy(*keys, "__v").agg(F.min(other).alias("__1"), F.max(F.when(F.col("__n") == 2, F.col(other))).alias("__2"))

    def reach(df, sign, name):
        """The end of what sign * v reaches, sign * v + tol - half, as a sum of two doubles
        (``name``, ``name``_low) without any rounding."""
        df = df.withColumn("__x", sign * F.col("__v")).withColumn("__s", F.col("__x") + tol).withColumn("__z", F.col("__s") - F.col("__x"))
        df = df.withColumn("__e", (F.col("__x") - (F.col("__s") - F.col("__z"))) + (tol - F.col("__z")) - half)
        df = df.withColumn(name, F.col("__s") + F.col("__e")).withColumn("__z", F.col(name) - F.col("__s"))
        low = (F.col("__s") - (F.col(name) - F.col("__z"))) + (F.col("__e") - F.col("__z"))
        return df.withColumn(f"{name}_low", low + 0.0).withColumn(name, F.col(name) + 0.0).drop("__x", "__s", "__z", "__e")

    def running(sign, asked):
        """The two least of a block's values up to each place asked for."""
        place = lambda at, pos, low, turn, v: [*keys, at.alias("__block"), pos.alias("__pos"), low.alias("__low"), F.lit(turn).alias("__turn"), v.alias("__v")]
        zero, v = F.lit(0.0), F.col("__v")
        rows = values.select(*place(block(v), sign * v + 0.0, zero, 1, F.lit(None).cast("double")), "__1", "__2")
        for at, pos, low in asked:
            rows = rows.unionByName(near.select(*place(at, pos, low, 2 if even else 0, v), none.alias("__1"), none.alias("__2")).filter("__block IS NOT NULL"))
        w = Window.partitionBy(*keys, "__block").orderBy("__pos", "__low", "__turn")
        so_far, first = w.rowsBetween(Window.unboundedPreceding, 0), F.col("__1")
        rows = rows.withColumn("__old", F.min("__1").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        # Of a new least and the old one the greater is second, or a value's own second is.
        rows = rows.withColumn("__2", F.least("__2", F.when(first != F.col("__old"), F.greatest(first, F.col("__old")))))
        rows = rows.select(*keys, "__v", F.min("__1").over(so_far).alias("__1"), F.min("__2").over(so_far).alias("__2"))
        return rows.filter("__v IS NOT NULL")

    l = known(left, a, id_)  # noqa: E741
    values = two_least(known(right, b, other))
    ends = reach(reach(l.select(*keys, "__v").distinct(), 1, "__hi"), -1, "__lo").withColumn("__last", block(F.col("__hi"))).withColumn("__first", block(-F.col("__lo")))
    # Beyond 2**45 blocks from zero, a block holds but a few hundred doubles: there they are met.
    is_near = F.abs(F.col("__v") / size) < 2.0**45
    near, far = ends.filter(is_near), ends.filter(~is_near)
    inner = F.when(F.col("__last") - F.col("__first") > 1, F.col("__first") + 1)
    up = running(1, [(F.col("__last"), F.col("__hi"), F.col("__hi_low")), (inner, F.lit(float("inf")), F.lit(0.0))])
    down = running(-1, [(F.col("__first"), F.col("__lo"), F.col("__lo_low"))])
    beside = far.select(*keys, "__v", F.explode(F.array_distinct(F.array("__first", F.col("__first") + 1, "__last"))).alias("__block"))
    met = beside.join(values.select(*keys, block(F.col("__v")).alias("__block"), F.col("__v").alias("__w"), "__1", "__2"), [*keys, "__block"])
    met = met.filter(F.abs(F.col("__v") - F.col("__w")) < tol).select(*keys, "__v", "__1", "__2")
    found = reduce(DataFrame.unionByName, [up, down, met]).select(*keys, "__v", F.explode(F.array("__1", "__2")).alias(other))
    best = two_least(full(found))
    hit = F.when(F.col("__1") != F.col(id_), F.col("__1")).otherwise(F.col("__2"))
    return l.join(best, [*keys, "__v"]).groupBy(id_).agg(F.min(hit).alias(other)).filter(F.col(other).isNotNull())


def bridge_join(facts: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of linked keys, each once however often its key is linked."""
    return null_safe(facts, links.select(*keys).distinct(), keys, "left_semi")


def fallback_join(left: DataFrame, specific: DataFrame, general: DataFrame, keys: list[str], general_keys: list[str], value: str) -> DataFrame:
    """``value`` by all keys, else by the general ones."""
    a = specific.select(*keys, F.col(value).alias("__a"))
    b = general.select(*general_keys, F.col(value).alias("__b"))
    return left.join(a, keys, "left").join(b, general_keys, "left").withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b")


def as_long(df: DataFrame, c: str) -> Column:
    """Whole numbers in the order of a date, time or number column."""
    kind = df.schema[c].dataType.typeName()
    return F.unix_date(c).cast("long") if kind == "date" else F.unix_micros(F.col(c).cast("timestamp")) if kind.startswith("timestamp") else F.col(c).cast("long")


def overlap_pairs(ranges: DataFrame, key: list[str], id_: str, lo: str, hi: str) -> DataFrame:
    """(id_a, id_b) of closed ranges of one key that overlap, id_a < id_b.

    Two ranges overlap where one begins inside the other. A range is covered by the fewest
    binary blocks (level, number); a beginning lies in one block of each level. Beginnings
    meet ranges on equal blocks, which happens once for each pair: a key costs its ranges
    times their levels and its overlaps, not their product. Levels go as far as the longest
    range needs. A range that ends before it begins, or has a null end, overlaps nothing.
    """
    r = ranges.select(*key, F.col(id_).alias("__id"), as_long(ranges, lo).alias("__lo"), as_long(ranges, hi).alias("__hi")).filter("__lo <= __hi")
    longest = r.agg(F.max(F.col("__hi") - F.col("__lo"))).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit((longest + 1).bit_length() - 1))
    block = lambda k, n: F.struct(k.alias("level"), n.alias("block"))

    bounds = F.expr("transform(__levels, __k -> named_struct('level', __k, 'l', shiftright(__lo - 1, __k) + 1, 'r', shiftright(__hi + 1, __k)))")
    own = F.flatten(
        F.transform(
            F.filter(bounds, lambda x: x["l"] < x["r"]),
            lambda x: F.filter(F.array(F.when(x["l"] % 2 != 0, block(x["level"], x["l"])), F.when(x["r"] % 2 != 0, block(x["level"], x["r"] - 1))), lambda b: b.isNotNull()),
        )
    )
    r = r.withColumn("__levels", levels)
    spans = r.select(*key, F.col("__id").alias("a"), F.col("__lo").alias("lo_a"), F.explode(own).alias("b")).select(*key, "a", "lo_a", "b.*")
    begins = r.select(*key, F.col("__id").alias("b"), F.col("__lo").alias("lo_b"), F.explode(F.expr("transform(__levels, __k -> named_struct('level', __k, 'block', shiftright(__lo, __k)))")).alias("n"))
    begins = begins.select(*key, "b", "lo_b", "n.*")
    found = spans.join(begins, [*key, "level", "block"]).filter("a <> b AND (lo_a < lo_b OR a < b)")
    return found.select(*key, F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def conservation(in_df: DataFrame, out_df: DataFrame, keys: list[str], tol: float = 0.0) -> DataFrame:
    """Keys whose totals on two sides (column ``total``) differ by more than ``tol``."""
    a = in_df.select(*keys, F.col("total").alias("total_in"))
    b = out_df.select(*keys, F.col("total").alias("total_out"))
    gap = F.abs(F.coalesce("total_in", F.lit(0)) - F.coalesce("total_out", F.lit(0)))
    return a.join(b, keys, "full_outer").filter(gap > tol)
