"""Scoring of segments and evaluation of detected against labelled intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.operators.core import by_point, expanded, merged_segments, split_runs


def squash(x: Column) -> Column:
    """exp(-exp(2 - x))."""
    return F.exp(-F.exp(2 - x))


def blend_weight(x: Column) -> Column:
    """(ln(1 + 25x - 25x^2) / (1 + 5x) - 1) / 5 + x / 2; null outside its domain."""
    inside = 1 + 25 * x - 25 * x * x
    return F.when(inside > 0, (F.log(inside) / (1 + 5 * x) - 1) / 5 + x / 2)


def softplus_score(p: Column, left: Column, right: Column) -> Column:
    """Score of a segment from its KS p-value and the gaps to its sides, a missing side taking the other."""
    lf = squash((F.coalesce(left, right, F.lit(0.0)) + F.coalesce(right, left, F.lit(0.0))) / 2)
    p0 = squash(-F.log(p + 1e-12))
    w = F.coalesce(blend_weight(F.abs(lf - p0)), F.lit(0.0))
    adjusted = (100 - 1e-3) * (lf * (1 - w) + p0 * w)
    return F.round(10 * F.log1p(F.exp(adjusted / 10)), 2)


def scored_segments(series: DataFrame, hits: DataFrame, gap: int = 5, share: float = 0.03) -> DataFrame:
    """start, end, length, raw_p, left, right and score of the segments of hits (point, pos).

    Running counts by value serve all segments of a point for the KS statistic; running sums over the normal rows
    give the neighbourhood means.
    """
    segments = merged_segments(split_runs(hits).select("point", "start_pos", "end_pos"), gap).select("point", "seg_id", "start_pos", "end_pos")
    flagged = series.join(hits.select("point", "pos").distinct().withColumn("_h", F.lit(1)), ["point", "pos"], "left")
    n_all = F.count("*").over(W.partitionBy("point"))
    normal = F.when(F.col("_h").isNull(), 1).otherwise(0)
    d = flagged.withColumn("_n", n_all).withColumn("_norm", normal).withColumn("_np", F.sum("_norm").over(by_point())).withColumn("_ns", F.sum(F.when(F.col("_norm") == 1, F.col("value")).otherwise(0.0)).over(by_point()))
    std = flagged.where("_h is null").groupBy("point").agg(F.stddev_pop("value").alias("sd"), F.count("*").alias("n_norm"))
    # the KS statistic: all rows against all rows without the segment, at each value of the segment and just below
    inside = expanded(segments, "seg_id", "start_pos", "end_pos").join(series.select("point", "pos", "value"), ["point", "pos"])
    ranks = series.groupBy("point", "value").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(W.partitionBy("point").orderBy("value"))).withColumn("below", F.col("upto") - F.col("c"))
    total = series.groupBy("point").agg(F.count("*").alias("n"))
    counted = inside.groupBy("point", "seg_id", "value").agg(F.count("*").alias("k"))
    run = W.partitionBy("point", "seg_id").orderBy("value")
    counted = counted.withColumn("s_upto", F.sum("k").over(run)).withColumn("m", F.sum("k").over(W.partitionBy("point", "seg_id")))
    ks = counted.join(ranks, ["point", "value"]).join(total, "point")
    rest = F.col("n") - F.col("m")
    gap_at = lambda s, a: F.abs((F.col(a) - s) / rest - F.col(a) / F.col("n"))
    stat = F.max(F.greatest(gap_at(F.col("s_upto"), "upto"), gap_at(F.col("s_upto") - F.col("k"), "below")))
    ks = ks.groupBy("point", "seg_id").agg(stat.alias("d"), F.first("n").alias("n"), F.first("m").alias("m"))
    effective = F.sqrt((F.col("n") - F.col("m")) * F.col("n") / (2 * F.col("n") - F.col("m")))
    ks = ks.withColumn("lam", effective * F.col("d"))
    # the Kolmogorov series; below 0.2 it is 1 to double precision
    series_p = F.expr("aggregate(sequence(1, 30), 0D, (a, j) -> a + if(j % 2 = 1, 2D, -2D) * exp(-2D * j * j * lam * lam))")
    ks = ks.select("point", "seg_id", F.when((F.col("n") == F.col("m")) | (F.col("lam") < 0.2), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series_p))).alias("raw_p"))
    # neighbourhoods: the nearest rows that are normal, counted in normal rows
    ends = inside.groupBy("point", "seg_id", "start_pos", "end_pos").agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    at_start = d.select("point", F.col("pos").alias("start_pos"), (F.col("_np") - F.col("_norm")).alias("np_l"), "_n")
    at_end = d.select("point", F.col("pos").alias("end_pos"), F.col("_np").alias("np_r"))
    s = ends.join(at_start, ["point", "start_pos"]).join(at_end, ["point", "end_pos"]).join(std, "point").withColumn("w", F.floor(share * F.col("_n")))
    sums = d.where("_norm = 1").select("point", F.col("_np").alias("np"), "_ns").union(series.select("point").distinct().select("point", F.lit(0).cast("long"), F.lit(0.0)))
    for side, a, b in (("left", F.greatest(F.lit(0), F.col("np_l") - F.col("w")), F.col("np_l")), ("right", F.col("np_r"), F.least(F.col("n_norm"), F.col("np_r") + F.col("w")))):
        s = s.withColumn("_a", a.cast("long")).withColumn("_b", b.cast("long"))
        s = s.join(sums.select("point", F.col("np").alias("_a"), F.col("_ns").alias("_sa")), ["point", "_a"], "left").join(sums.select("point", F.col("np").alias("_b"), F.col("_ns").alias("_sb")), ["point", "_b"], "left")
        mean = F.when(F.col("_b") > F.col("_a"), (F.col("_sb") - F.col("_sa")) / (F.col("_b") - F.col("_a")))
        gap_side = F.greatest(F.abs(mean - F.col("hi")), F.abs(mean - F.col("lo"))) / (F.col("sd") + 1e-6)
        s = s.withColumn(side, gap_side).drop("_a", "_b", "_sa", "_sb")
    out = s.join(ks, ["point", "seg_id"])
    return out.select("point", "seg_id", "start_pos", "end_pos", (F.col("end_pos") - F.col("start_pos") + 1).alias("length"), "raw_p", "left", "right", softplus_score(F.col("raw_p"), F.col("left"), F.col("right")).alias("score"))


def neighbourhoods(series: DataFrame, segments: DataFrame, share: float = 0.03) -> DataFrame:
    """Mean of the normal rows on either side of each segment: as many as `share` of the point's rows, counted in rows
    outside all segments. Null where there is none."""
    inside = expanded(segments, "seg_id").select("point", "pos").distinct().withColumn("_h", F.lit(1))
    d = series.join(inside, ["point", "pos"], "left").withColumn("_norm", F.when(F.col("_h").isNull(), 1).otherwise(0))
    d = d.withColumn("_np", F.sum("_norm").over(by_point())).withColumn("_ns", F.sum(F.when(F.col("_norm") == 1, F.col("value")).otherwise(0.0)).over(by_point()))
    sums = d.where("_norm = 1").select("point", F.col("_np").alias("np"), "_ns").union(series.select("point").distinct().select("point", F.lit(0).cast("long"), F.lit(0.0)))
    sizes = d.groupBy("point").agg(F.floor(F.count("*") * share).alias("w"), F.sum("_norm").alias("n_norm"))
    at = d.select("point", F.col("pos").alias("start_pos"), F.col("_np").alias("np"))
    s = segments.select("point", "seg_id", "start_pos").join(at, ["point", "start_pos"]).join(sizes, "point")
    for side, a, b in (("left_mean", F.greatest(F.lit(0), F.col("np") - F.col("w")), F.col("np")), ("right_mean", F.col("np"), F.least("n_norm", F.col("np") + F.col("w")))):
        s = s.withColumn("_a", a.cast("long")).withColumn("_b", b.cast("long"))
        for end in ("_a", "_b"):
            s = s.join(sums.select("point", F.col("np").alias(end), F.col("_ns").alias(f"_s{end}")), ["point", end], "left")
        s = s.withColumn(side, F.when(F.col("_b") > F.col("_a"), (F.col("_s_b") - F.col("_s_a")) / (F.col("_b") - F.col("_a")))).drop("_a", "_b", "_s_a", "_s_b")
    return s.select("point", "seg_id", "left_mean", "right_mean")


def heat_map_totals(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(column, mean, place): mean of each column over all rows of the matrix, absent cells being 0, and its place by it;
    n_set: cells that are not 0."""
    n_rows = cells.select(row).distinct().agg(F.count("*").alias("n"))
    sums = cells.groupBy(column).agg(F.sum(value).alias("s"), F.count(F.when(F.col(value) != 0, 1)).alias("n_set")).crossJoin(F.broadcast(n_rows))
    out = sums.select(column, (F.col("s") / F.col("n")).alias("mean"), "n_set")
    return out.withColumn("place", F.row_number().over(W.orderBy("mean", column)))


def batch_evaluation(series: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """All measures of each point that has rows, labels and detections; the others are left out."""
    return derived_metrics(confusion(series, truth, predicted))


def p_norm_mean(score: Column | str, p: int = 5) -> Column:
    return F.pow(F.avg(F.pow(F.abs(score), F.lit(p))), F.lit(1.0 / p))


def score_summary(segments: DataFrame, *keys: str) -> DataFrame:
    return segments.groupBy(*keys).agg(
        p_norm_mean("score").alias("score_avg"), F.max("score").alias("score_max"), F.min("score").alias("score_min"), F.percentile("score", F.lit(0.5)).alias("score_p50"), F.count("*").alias("segment_count")
    )


def confusion(series: DataFrame, truth: DataFrame, predicted: DataFrame, *keys: str) -> DataFrame:
    """tp, fp, fn, tn of two mask tables (point, pos, mask), missing rows counting as 0; points in both only."""
    t, p = truth.select("point", "pos", F.col("mask").alias("_t")), predicted.select("point", "pos", F.col("mask").alias("_p"))
    points = t.select("point").distinct().join(p.select("point").distinct(), "point")
    d = series.select("point", "pos").join(points, "point").join(t, ["point", "pos"], "left").join(p, ["point", "pos"], "left")
    a, b = F.coalesce("_t", F.lit(0)) == 1, F.coalesce("_p", F.lit(0)) == 1
    count = lambda c: F.count(F.when(c, 1))
    return d.groupBy(*(keys or ("point",))).agg(count(a & b).alias("tp"), count(~a & b).alias("fp"), count(a & ~b).alias("fn"), count(~a & ~b).alias("tn"))


def derived_metrics(c: DataFrame) -> DataFrame:
    """The eighteen measures of a confusion table, to three places; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    over = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    precision, recall, specificity, npv = over(tp, tp + fp), over(tp, tp + fn), over(tn, tn + fp), over(tn, tn + fn)
    f = lambda beta: over((1 + beta * beta) * precision * recall, beta * beta * precision + recall)
    accuracy = over(tp + tn, n)
    chance = over((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    far, mar = over(fp, fp + tn), over(fn, fn + tp)
    share = over(tp + fn, n)
    w = F.when(share < 0.01, 0.8).when(share < 0.05, 0.7).otherwise(0.6)
    values = {
        "precision": precision, "recall": recall, "specificity": specificity, "npv": npv, "f1": f(1), "f2": f(2), "f05": f(0.5),
        "balanced_accuracy": (recall + specificity) / 2, "mcc": over(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "g_mean": F.sqrt(precision * recall), "kappa": over(accuracy - chance, 1 - chance), "jaccard": over(tp, tp + fp + fn), "dice": over(2 * tp, 2 * tp + fp + fn),
        "overlap": over(tp, F.least(tp + fp, tp + fn)), "accuracy": accuracy, "far": far, "mar": mar, "harmonic_accuracy": over(F.lit(1.0), over(w, recall) + over(1 - w, specificity)),
    }
    return c.select(*c.columns, *[F.round(v, 3).alias(k) for k, v in values.items()])


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts and ratios of two masks of each point."""
    d = a.select("point", "pos", F.col("mask").alias("_a")).join(b.select("point", "pos", F.col("mask").alias("_b")), ["point", "pos"], "left").withColumn("_b", F.coalesce("_b", F.lit(0)))
    return d.groupBy("point").agg(
        F.sum("_a").alias("count_a"), F.sum("_b").alias("count_b"), F.avg("_a").alias("ratio_a"), F.avg("_b").alias("ratio_b"),
        F.avg((F.col("_a") == F.col("_b")).cast("int")).alias("agreement"), F.sum(((F.col("_a") == 1) & (F.col("_b") == 0)).cast("int")).alias("only_a"), F.sum(((F.col("_a") == 0) & (F.col("_b") == 1)).cast("int")).alias("only_b"),
    )


EVALUATORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_evaluator(name: str) -> Callable:
    """Decorator: register a function from a (truth, predicted) table to a table of measures."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        EVALUATORS[name] = f
        return f

    return add


def evaluate(df: DataFrame, name: str) -> DataFrame:
    return EVALUATORS[name](df)


@register_evaluator("simple_accuracy")
def simple_accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("truth") == F.col("predicted")).cast("int")).alias("accuracy"), F.count("*").alias("n"))
