"""Density components of segments, without comparing all pairs of a point's segments.

Segments lie in a plane of two standardised features. Cells of a quadtree (level k halves the square k times) hold how
many lie in them. A search goes down the tree from cells near it and leaves out what cannot matter; distances are worked
out inside cells of few segments only, so dense places cost no more than sparse ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.sources.scratch import settled

#: Levels of the tree; features have six digits, so a cell of the last level holds a handful of distinct places.
DEPTH = 32
#: Distinct places in a cell from which on a search goes down to its quarters.
LEAF = 32
#: Distances are compared to nine digits, bounds of cells with this to spare.
SPARE = 1e-8


def _distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.round(F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)), 9)


def standardised(features: DataFrame, x: str = "mean_ratio", y: str = "range_ratio") -> DataFrame:
    """(point, seg_id, x, y): two features less their mean over the point, in deviations, to six digits."""
    f = features.select("point", "seg_id", *[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in ((x, "a"), (y, "b"))])
    scale = f.groupBy("point").agg(*[g(c).alias(f"{n}_{c}") for c in "ab" for n, g in (("mean", F.avg), ("dev", F.stddev_pop))])
    unit = lambda c: F.round(F.when(F.col(f"dev_{c}") > 1e-12, (F.col(c) - F.col(f"mean_{c}")) / F.col(f"dev_{c}")).otherwise(0.0), 6)
    return f.join(scale, "point").select("point", "seg_id", unit("a").alias("x"), unit("b").alias("y"))


def placed(features: DataFrame, x: str = "mean_ratio", y: str = "range_ratio") -> DataFrame:
    """(point, x, y, m, low, k, x0, y0, side): distinct standardised places of each point's segments, how many are there,
    the least seg_id among them, which neighbour counts, and the point's square. A null feature counts as zero, one
    that is the same everywhere too."""
    z = standardised(features, x, y)
    places = z.groupBy("point", "x", "y").agg(F.count("*").alias("m"), F.min("seg_id").alias("low"))
    square = places.groupBy("point").agg(F.sum("m").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-6)).alias("side"))
    out = places.join(square.withColumn("side", F.col("side") * (1 + 1e-9)), "point")
    return out.withColumn("k", F.least(F.lit(2), F.col("n") - 1)).drop("n")


def _cell(level: Column) -> tuple[Column, Column]:
    """The cell of a place. Scaling by a power of two is exact, so cells nest."""
    scale = F.pow(F.lit(2.0), level)
    return F.floor((F.col("x") - F.col("x0")) / F.col("side") * scale).alias("cx"), F.floor((F.col("y") - F.col("y0")) / F.col("side") * scale).alias("cy")


def _gaps(cx: str, cy: str, level: str = "level") -> tuple[Column, Column]:
    """Least and largest distance of the place (x, y) from a cell."""
    unit = F.col("side") / F.pow(F.lit(2.0), F.col(level))
    axis = []
    for v, o, c in (("x", "x0", cx), ("y", "y0", cy)):
        a, b = F.col(o) + F.col(c) * unit - F.col(v), F.col(o) + (F.col(c) + 1) * unit - F.col(v)
        axis.append((F.greatest(F.lit(0.0), a, -b), F.greatest(F.abs(a), F.abs(b))))
    return tuple(F.sqrt(p * p + q * q) for p, q in zip(*axis))


_KEY = ["point", "level", "cx", "cy"]


def tree(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places by level and cell, cells with the segments and distinct places in them)."""
    leveled = places.select("*", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("level")).select("*", *_cell(F.col("level")))
    cells = leveled.groupBy(*_KEY).agg(F.sum("m").alias("n"), F.count("*").alias("kinds"))
    return leveled, settled(cells, "cells")


def neighbour_distances(leveled: DataFrame, cells: DataFrame) -> DataFrame:
    """(point, x, y, m, d): distance of each place's segments to their k-th other neighbour."""
    own = ["point", "x", "y", "m", "k", "x0", "y0", "side"]
    # the smallest cell around a place that holds enough: what counts is no farther than its diagonal
    full = leveled.join(cells.select(*_KEY, "n").hint("merge"), _KEY).where("n > k")
    begin = full.groupBy(*own).agg(F.max(F.struct("level", "cx", "cy")).alias("c")).select(*own, "c.level", "c.cx", "c.cy")
    steps = F.sequence(F.lit(-2), F.lit(2))
    near = begin.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    front = near.select(*own, "level", (F.col("cx") + F.col("i")).alias("cx"), (F.col("cy") + F.col("j")).alias("cy")).join(cells.hint("merge"), _KEY)
    least, most = _gaps("cx", "cy")
    by_reach = W.partitionBy("point", "x", "y").orderBy("most", "cx", "cy", "level")
    place = W.partitionBy("point", "x", "y")
    deep = (F.col("kinds") > LEAF) & (F.col("level") < DEPTH - 1)
    while True:
        seen = front.withColumn("least", least).withColumn("most", most).withColumn("upto", F.sum("n").over(by_reach))
        reach = F.min(F.when(F.col("upto") > F.col("k"), F.col("most"))).over(place)
        front = settled(seen.where("least is not null").withColumn("reach", reach).where(F.col("least") <= F.col("reach") + SPARE).select(*own, *_KEY[1:], "n", "kinds"), "front")
        if front.where(deep).isEmpty():
            break
        part = F.explode(F.sequence(F.lit(0), F.lit(3)))  # two levels down
        down = front.where(deep).drop("n", "kinds").withColumn("i", part).withColumn("j", part)
        down = down.select(*own, (F.col("level") + 2).alias("level"), (F.col("cx") * 4 + F.col("i")).alias("cx"), (F.col("cy") * 4 + F.col("j")).alias("cy")).join(cells.hint("merge"), _KEY)
        front = front.where(~deep).select(*down.columns).union(down)
    other = leveled.select(*_KEY, F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("m").alias("om"))
    d = front.join(other.hint("merge"), _KEY).withColumn("d", _distance(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")))
    same = (F.col("x") == F.col("ox")) & (F.col("y") == F.col("oy"))
    d = d.withColumn("om", F.when(same, F.col("m") - 1).otherwise(F.col("om"))).where("om > 0")
    d = d.withColumn("upto", F.sum("om").over(W.partitionBy("point", "x", "y").orderBy("d", "ox", "oy")))
    return d.where("upto >= k").groupBy("point", "x", "y", "m").agg(F.min("d").alias("d"))


def _links(nodes: DataFrame, leveled: DataFrame, cells: DataFrame) -> DataFrame:
    """(point, a, b): cells, by the least seg_id in them, that hold places within eps of each other."""
    eps, unit = F.col("eps"), F.col("side") / F.pow(F.lit(2.0), F.col("level"))
    axis = lambda a, b: F.abs(F.col(a) - F.col(b))
    gap = lambda a, b: F.greatest(axis(a, b) - 1, F.lit(0)) * unit
    span = lambda a, b: (axis(a, b) + 1) * unit
    least = F.sqrt(gap("ax", "bx") ** 2 + gap("ay", "by") ** 2)
    most = F.sqrt(span("ax", "bx") ** 2 + span("ay", "by") ** 2)
    one = nodes.select("point", "level", "side", "eps", F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("low").alias("a"))
    two = nodes.select("point", F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("low").alias("b"))
    reach = F.sequence(F.lit(-3), F.lit(3))
    pairs = one.withColumn("i", F.explode(reach)).withColumn("j", F.explode(reach)).where("i > 0 or i = 0 and j > 0")
    pairs = pairs.select("*", (F.col("ax") + F.col("i")).alias("bx"), (F.col("ay") + F.col("j")).alias("by")).drop("i", "j").join(two.hint("merge"), ["point", "bx", "by"])
    sized = lambda s, n: cells.select("point", "level", F.col("cx").alias(f"{s}x"), F.col("cy").alias(f"{s}y"), F.col("kinds").alias(n))
    columns = ["point", "a", "b", "level", "side", "eps", "ax", "ay", "bx", "by"]
    with_sizes = lambda p: p.select(*columns).join(sized("a", "na").hint("merge"), ["point", "level", "ax", "ay"]).join(sized("b", "nb").hint("merge"), ["point", "level", "bx", "by"])
    front, found = with_sizes(pairs), None
    deep = (F.greatest("na", "nb") > LEAF) & (F.col("level") < DEPTH)
    quarter = F.explode(F.sequence(F.lit(0), F.lit(1)))
    while True:
        front = settled(front.where(least <= eps + SPARE).withColumn("sure", most <= eps - SPARE), "pairs")
        new = front.where("sure").select("point", "a", "b").distinct()
        found = settled(new if found is None else found.union(new), "found")
        front = front.where("not sure").drop("sure").join(found.hint("merge"), ["point", "a", "b"], "left_anti")
        if front.where(deep).isEmpty():
            break
        down = front.where(deep)
        for c in ("ax", "ay", "bx", "by"):
            down = down.withColumn("_q", quarter).withColumn(c, F.col(c) * 2 + F.col("_q")).drop("_q")
        down = with_sizes(down.withColumn("level", F.col("level") + 1))
        front = front.where(~deep).select(*down.columns).union(down)
    at = lambda s: leveled.select("point", "level", F.col("cx").alias(f"{s}x"), F.col("cy").alias(f"{s}y"), F.col("x").alias(f"{s}_x"), F.col("y").alias(f"{s}_y"))
    exact = front.join(at("a").hint("merge"), ["point", "level", "ax", "ay"]).join(at("b").hint("merge"), ["point", "level", "bx", "by"])
    close = exact.where(_distance(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y")) <= eps)
    return found.union(close.select("point", "a", "b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(point, node, root): the least node that each node of the edges (point, a, b) is connected with. Large and small
    stars in turn, until nothing moves; rounds grow with the logarithm of the longest path."""
    edges = settled(edges.where("a <> b").select("point", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    while True:
        both = edges.union(edges.select("point", "b", "a"))
        low = both.groupBy("point", "a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low.hint("merge"), ["point", "a"]).select("point", F.col("b").alias("a"), F.col("low").alias("b"))
        large = settled(large.where("a <> b").distinct(), "stars")
        low = large.groupBy("point", "a").agg(F.min("b").alias("low"))
        small = large.join(low.hint("merge"), ["point", "a"]).select("point", F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e"))
        after = settled(small.select("point", F.greatest("e.a", "e.b").alias("a"), F.least("e.a", "e.b").alias("b")).where("a <> b").distinct(), "stars")
        moved = not after.exceptAll(edges).isEmpty() or after.count() != edges.count()
        edges = after
        if not moved:
            break
    nodes = edges.select("point", F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select("point", F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("point", "node").agg(F.min("root").alias("root"))


def density_components(features: DataFrame) -> DataFrame:
    """(point, seg_id, component): segments of a point that steps of at most eps connect, by the least seg_id.

    eps is the upper quartile of the distances to the second other neighbour (the first where a point has two
    segments) in the standardised features. Segments at one place are together; the only one of a point is alone.
    """
    places = settled(placed(features), "places")
    many = places.where("k > 0")
    leveled, cells = tree(many)
    eps = neighbour_distances(leveled, cells).groupBy("point").agg(F.round(F.percentile("d", F.lit(0.75), F.col("m")), 9).alias("eps"))
    # cells of a diagonal within eps: all places in one are together
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col("side") * F.sqrt(F.lit(2.0)) / F.greatest(F.col("eps") - SPARE, F.lit(1e-12))))).cast("int")
    dealt = settled(many.join(eps, "point").withColumn("level", level).select("*", *_cell(F.col("level"))), "dealt")
    shared = dealt.where((F.col("eps") > 0) & (F.col("level") <= DEPTH))
    nodes = shared.groupBy("point", "level", "side", "eps", "cx", "cy").agg(F.min("low").alias("low"))
    roots = connected(_links(nodes, leveled, cells)).withColumnRenamed("node", "low")
    whole = nodes.join(roots.hint("merge"), ["point", "low"], "left").select("point", "cx", "cy", F.coalesce("root", "low").alias("component"))
    grouped = shared.join(whole.hint("merge"), ["point", "cx", "cy"]).select("point", "x", "y", "component")
    alone = places.join(grouped.select("point").distinct(), "point", "left_anti").select("point", "x", "y", F.col("low").alias("component"))
    at = grouped.union(alone)
    return standardised(features).join(at.hint("merge"), ["point", "x", "y"]).select("point", "seg_id", "component")


def split_by_density(features: DataFrame) -> DataFrame:
    """(point, seg_id, is_global): the component of a point's first segment is global, the others are local."""
    first = features.groupBy("point").agg(F.min("seg_id").alias("_first"))
    return density_components(features).join(first, "point").select("point", "seg_id", (F.col("component") == F.col("_first")).alias("is_global"))
