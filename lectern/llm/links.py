"""Connected components and the linking of large groups, as joins and aggregations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.store import cut

#: Ids of a bucket that one task takes; a fuller bucket is dealt out over as many tasks, or pairs of them, as it needs.
PART = 4096


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id that has an edge (a, b): the smallest id it is connected to.

    Stars are formed around the smallest neighbours, by turns among larger and smaller ones, until each component is
    one star. Every round is written to the shared folder; nothing but counts reaches the driver.
    """
    edges = cut(edges.select("a", "b").filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # stars already: no id points at two others, and none that is pointed at points on
        twice = edges.groupBy("a").count().filter("count > 1").limit(1).count()
        if not twice and not edges.select("b").join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            break
        edges = cut(_small_star(_large_star(edges)))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _parts(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(PART))).cast("int")


def link(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], bound: Callable[[DataFrame], tuple[DataFrame, Callable]] | None = None) -> DataFrame:
    """(id, component) of the ids that verified links connect, among all pairs of (key, id) rows that share a key.

    No group's pairs are all formed: first each id is held against a hub of its buckets, the id whose buckets are the
    fullest (copies share more keys with what they are copied from than with each other). Then only ids that share a
    bucket and are still in different components are held against each other. Pairs inside a component can't change
    it, so the result is that of all pairs. `verify` gets pairs (a, b), a < b, and returns those that hold. Buckets of
    more than PART ids are dealt out by a hash of the id, and every two parts meet in a task of their own.

    `bound` may spare pairs that can't hold: given the ids still in question (column id) it returns a table of them with
    columns x and y, and a condition on (xa, ya, xb, yb) that every pair that holds fulfils.
    """
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(buckets.join(sizes, "key").distinct())
    degree = shared.groupBy("id").agg(F.sum("n").alias("degree"))
    hubs = shared.join(degree, "id").groupBy("key").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("hub"), F.max("n").alias("n"))
    spread = hubs.select("key", "hub", F.explode(F.sequence(F.lit(0), _parts(F.col("n")) - 1)).alias("part"))
    mine = shared.withColumn("part", F.pmod(F.xxhash64("id"), _parts(F.col("n"))).cast("int"))
    met = mine.join(spread, ["key", "part"]).filter("id != hub")
    tried = cut(met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
    first = cut(verify(tried))
    known = components(first)
    placed = shared.join(known, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    split = placed.groupBy("key").agg(F.min("c").alias("p"), F.max("c").alias("q"), F.count("*").alias("m")).filter("p < q").select("key", "m")
    placed = cut(placed.join(split, "key"))
    may = F.lit(True)
    if bound is not None:
        limits, fits = bound(placed.select("id").distinct())
        placed = cut(placed.join(limits, "id"))
        may = fits(*[F.col(c) for c in ("xa", "ya", "xb", "yb")])
    more = [c for c in ("x", "y") if c in placed.columns]
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("id"), _parts(F.col("m"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), _parts(F.col("m")) - 1))).withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    one, two = (dealt.select(F.col("key").alias(f"key{z}"), F.col("low").alias(f"low{z}"), F.col("high").alias(f"high{z}"), F.col("part").alias(f"part{z}"), F.col("id").alias(z), F.col("c").alias(f"c{z}"), *[F.col(m).alias(m + z) for m in more]) for z in "ab")
    same = (F.col("keya") == F.col("keyb")) & (F.col("lowa") == F.col("lowb")) & (F.col("higha") == F.col("highb"))
    across = (F.col("parta") != F.col("partb")) | (F.col("lowa") == F.col("higha"))
    rest = one.join(two, same & across & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & may).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    second = cut(verify(cut(rest)))
    if not second.limit(1).count():
        return known
    return components(first.union(second))
