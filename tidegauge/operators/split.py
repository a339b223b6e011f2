"""Global and local split of segments, ranking and replacement of local ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.operators.core import expanded, mask_from_segments, split_runs


def split_by_range(series: DataFrame, segments: DataFrame, th: float = 0.5) -> DataFrame:
    """`is_global`: the range of absolute values of a segment is at least th of the point's; null range is local."""
    whole = series.groupBy("point").agg((F.max(F.abs("value")) - F.min(F.abs("value"))).alias("g"))
    inside = expanded(segments, "seg_id", "start_pos", "end_pos").join(series, ["point", "pos"])
    own = inside.groupBy("point", "seg_id", "start_pos", "end_pos").agg((F.max(F.abs("value")) - F.min(F.abs("value"))).alias("r"))
    ratio = F.when(F.col("g") > 0, F.col("r") / F.col("g"))
    return own.join(whole, "point").select("point", "seg_id", "start_pos", "end_pos", F.coalesce(ratio >= th, F.lit(False)).alias("is_global"))


def most_variable(series: DataFrame, segments: DataFrame, th: float = 0.5) -> DataFrame:
    """The (1 - th) share of a point's segments with the largest coefficient of variation, one at least."""
    inside = expanded(segments, "seg_id", "start_pos", "end_pos").join(series, ["point", "pos"])
    cv = F.when(F.avg("value") != 0, F.stddev_pop("value") / F.abs(F.avg("value"))).otherwise(0.0)
    ranked = inside.groupBy("point", "seg_id", "start_pos", "end_pos").agg(F.round(cv, 9).alias("cv"))
    k = F.row_number().over(W.partitionBy("point").orderBy(F.desc("cv"), "seg_id"))
    n = F.count("*").over(W.partitionBy("point"))
    return ranked.withColumn("rank", k).withColumn("_n", n).where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * (1 - th) + 1e-9))).drop("_n")


def quadratic_replaced(series: DataFrame, segments: DataFrame) -> DataFrame:
    """series with `fitted`: inside a segment of three rows or more its least-squares parabola, elsewhere the value."""
    inside = expanded(segments, "seg_id", "start_pos", "end_pos").join(series, ["point", "pos"])
    x = (F.col("pos") - (F.col("start_pos") + F.col("end_pos")) / 2).alias("x")
    d = inside.select("point", "seg_id", "pos", "value", x)
    s = {k: F.sum(F.pow("x", F.lit(k))).alias(f"s{k}") for k in (2, 4)}
    t = {k: F.sum(F.pow("x", F.lit(k)) * F.col("value")).alias(f"t{k}") for k in (0, 1, 2)}
    sums = d.groupBy("point", "seg_id").agg(F.count("*").alias("n"), *s.values(), *t.values()).where("n >= 3")
    # positions are centred, so odd moments vanish and the 3 x 3 system falls apart
    det = F.col("n") * F.col("s4") - F.col("s2") * F.col("s2")
    fit = sums.select("point", "seg_id", ((F.col("t0") * F.col("s4") - F.col("t2") * F.col("s2")) / det).alias("a"), (F.col("t1") / F.col("s2")).alias("b"), ((F.col("n") * F.col("t2") - F.col("t0") * F.col("s2")) / det).alias("c"))
    fitted = d.join(fit, ["point", "seg_id"]).select("point", "pos", (F.col("a") + F.col("b") * F.col("x") + F.col("c") * F.col("x") * F.col("x")).alias("_f"))
    return series.join(fitted, ["point", "pos"], "left").withColumn("fitted", F.coalesce("_f", "value")).drop("_f")


def _moments(series: DataFrame) -> DataFrame:
    """Running sums of the values less the point's mean, and of their squares, up to each position."""
    w = W.partitionBy("point").orderBy("pos")
    whole = series.groupBy("point").agg(F.avg("value").alias("_m"))
    p = series.join(whole, "point").select("point", "pos", (F.col("value") - F.col("_m")).alias("_v"))
    return p.select("point", "pos", F.sum("_v").over(w).alias("s1"), F.sum(F.col("_v") * F.col("_v")).over(w).alias("s2"))


def _deviation(ranges: DataFrame, moments: DataFrame) -> DataFrame:
    """ranges with `sd`, the deviation of the values from position a to b, to six digits."""
    c = ranges.join(moments.select("point", F.col("pos").alias("b"), F.col("s1").alias("b1"), F.col("s2").alias("b2")), ["point", "b"]).withColumn("_p", F.col("a") - 1)
    c = c.join(moments.select("point", F.col("pos").alias("_p"), F.col("s1").alias("a1"), F.col("s2").alias("a2")), ["point", "_p"], "left")
    n, s1, s2 = F.col("b") - F.col("a") + 1, F.col("b1") - F.coalesce("a1", F.lit(0.0)), F.col("b2") - F.coalesce("a2", F.lit(0.0))
    return c.withColumn("sd", F.round(F.sqrt(F.greatest(F.lit(0.0), s2 / n - s1 * s1 / (n * n))), 6)).drop("_p", "a1", "a2", "b1", "b2")


def extended(series: DataFrame, segments: DataFrame, steps: int = 10) -> DataFrame:
    """Segments widened on both sides by their own length, up to `steps` times, while the deviation keeps growing."""
    p = _moments(series)
    ends = series.groupBy("point").agg(F.max("pos").alias("last"))
    length = F.col("end_pos") - F.col("start_pos") + 1
    c = segments.join(ends, "point").select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    c = c.withColumn("a", F.greatest(F.lit(0), F.col("start_pos") - F.col("k") * length)).withColumn("b", F.least("last", F.col("end_pos") + F.col("k") * length))
    c = _deviation(c, p)
    key = W.partitionBy("point", "seg_id").orderBy("k")
    stuck = F.col("k").isNotNull() & (F.col("sd") <= F.lag("sd").over(key))
    c = c.withColumn("_stuck", F.coalesce(stuck.cast("int"), F.lit(0))).withColumn("_bad", F.sum("_stuck").over(key)).where("_bad = 0")
    best = c.groupBy("point", "seg_id").agg(F.max_by(F.struct("a", "b"), "k").alias("e"))
    return best.select("point", "seg_id", F.col("e.a").alias("start_pos"), F.col("e.b").alias("end_pos"))


def refined(series: DataFrame, segments: DataFrame) -> DataFrame:
    """Each segment moved to where a window of its length varies most, within the segment and its more variable side.

    A side is as long as the segment, cut at the ends of the point; the side before wins ties, and so does the first
    window. Segments of one row, and those without any variation, have no such place and are left out.
    """
    ends = series.groupBy("point").agg(F.max("pos").alias("last"))
    n = F.col("end_pos") - F.col("start_pos") + 1
    g = segments.join(ends, "point").select("point", "seg_id", "start_pos", "end_pos", n.alias("n"), F.greatest(F.lit(0), F.col("start_pos") - n).alias("lo"), F.least("last", F.col("end_pos") + n).alias("hi")).where("n > 1")
    near = g.select("*", F.explode(F.sequence("lo", "hi")).alias("pos")).join(series.select("point", "pos", "value"), ["point", "pos"])
    side = lambda there: F.round(F.coalesce(F.stddev_pop(F.when(there, F.col("value"))), F.lit(0.0)), 6)
    later = side(F.col("pos") > F.col("end_pos")) > side(F.col("pos") < F.col("start_pos"))
    g = near.groupBy(*g.columns).agg(later.alias("later"))
    first = F.when(F.col("later"), F.col("start_pos")).otherwise(F.col("lo"))
    final = F.when(F.col("later"), F.col("hi")).otherwise(F.col("end_pos")) - F.col("n") + 1
    c = g.select("point", "seg_id", "n", F.explode(F.sequence(first, final)).alias("a")).withColumn("b", F.col("a") + F.col("n") - 1)
    c = _deviation(c, _moments(series)).where("sd > 0")
    best = c.groupBy("point", "seg_id").agg(F.max_by(F.struct("a", "b", "sd"), F.struct("sd", -F.col("a"))).alias("e"))
    return best.select("point", "seg_id", F.col("e.a").alias("start_pos"), F.col("e.b").alias("end_pos"), F.col("e.sd").alias("sd"))


def post_processed(series: DataFrame, hits: DataFrame, th: float = 0.5) -> DataFrame:
    """series with the mask of its hits: runs of hits, the most variable of them, widened while they vary more."""
    chosen = most_variable(series, split_runs(hits), th)
    again = split_runs(expanded(chosen, "seg_id", "start_pos", "end_pos").select("point", "pos"))
    return mask_from_segments(series, extended(series, again))


def split_by_two_means(features: DataFrame, iterations: int = 5) -> DataFrame:
    """`is_global` by two-means on the standardised mean_ratio and range_ratio of each point's segments.

    The centres start at the segments with the least and the largest range_ratio and move `iterations` times; a centre
    without segments stays. The cluster of the higher mean range_ratio is global, and so are segments that are all alike. A null ratio
    counts as zero. `features` is read once for each move, so pass a written table.
    """
    ratios = features.select("point", "seg_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean_ratio", "range_ratio")])
    scale = ratios.groupBy("point").agg(*[f(c).alias(f"{n}_{c}") for c in ("mean_ratio", "range_ratio") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    unit = lambda c: F.round(F.when(F.col(f"s_{c}") > 1e-12, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0), 6)
    z = ratios.join(scale, "point").select("point", "seg_id", "range_ratio", unit("mean_ratio").alias("x"), unit("range_ratio").alias("y"))
    at = lambda f, order: f(F.struct("x", "y"), order)
    ends = z.groupBy("point").agg(at(F.min_by, F.struct("y", "seg_id")).alias("l"), at(F.max_by, F.struct("y", -F.col("seg_id"))).alias("h"))
    centres = ends.select("point", *[F.col(f"{e}.{c}").alias(f"{e}{c}") for e in "lh" for c in "xy"])
    far = lambda e: F.pow(F.col("x") - F.col(f"{e}x"), F.lit(2)) + F.pow(F.col("y") - F.col(f"{e}y"), F.lit(2))
    high = F.round(far("h"), 6) < F.round(far("l"), 6)
    for _ in range(iterations):
        moved = z.join(centres, "point").withColumn("high", high)
        mean = lambda e, c: F.round(F.coalesce(F.avg(F.when(F.col("high") == (e == "h"), F.col(c))), F.first(f"{e}{c}")), 6)
        centres = moved.groupBy("point").agg(*[mean(e, c).alias(f"{e}{c}") for e in "lh" for c in "xy"])
    dealt = z.join(centres, "point").withColumn("high", high)
    means = dealt.groupBy("point").agg(*[F.avg(F.when(F.col("high") == flag, F.col("range_ratio"))).alias(n) for n, flag in (("mh", True), ("ml", False))])
    up = F.coalesce(F.round("mh", 9) >= F.round("ml", 9), F.col("mh").isNotNull())
    return dealt.join(means, "point").select("point", "seg_id", (F.col("high") == up).alias("is_global"))
