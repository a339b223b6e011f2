"""Detectors: each returns hits or segments of a series table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.operators import clean
from tidegauge.operators import features as ft
from tidegauge.operators.core import BLOCK, TASK_ROWS, all_rows, bridged, by_point, dealt, expanded, first_by, haloed, mask_from_segments, mask_in_time, mask_intervals, rows, split_runs
from tidegauge.operators.reduce import m4
from tidegauge.sources.scratch import settled


def hits_nsigma(series: DataFrame, th: float = 3.0, value: str = "value") -> DataFrame:
    """Rows outside mean plus and minus th population deviations."""
    return beyond(series, F.col(value), value, th)


def beyond(series: DataFrame, counted: Column, value: str, th: float) -> DataFrame:
    """Rows whose value is over th deviations from the mean; both are aggregated over `counted`, so no task needs a
    whole point. There is a row for each point, which Spark broadcasts where it is small."""
    scale = series.groupBy("point").agg(F.avg(counted).alias("_mean"), F.stddev_pop(counted).alias("_dev"))
    return series.join(scale, "point").where(F.abs(F.col(value) - F.col("_mean")) > th * F.col("_dev")).drop("_mean", "_dev")


def nsigma(series: DataFrame, th: float = 3.0, bridge: int = 5, value: str = "value") -> DataFrame:
    return bridged(hits_nsigma(series, th, value), bridge)


def hits_iqr(series: DataFrame, th: float = 1.5, value: str = "value") -> DataFrame:
    """Rows outside the quartiles by th interquartile ranges."""
    q = series.groupBy("point").agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    d = series.join(q, "point")
    reach = th * (F.col("_q")[1] - F.col("_q")[0])
    return d.where((F.col(value) < F.col("_q")[0] - reach) | (F.col(value) > F.col("_q")[1] + reach)).drop("_q")


def iqr(series: DataFrame, th: float = 1.5, bridge: int = 5) -> DataFrame:
    return bridged(hits_iqr(series, th), bridge)


def standardised(series: DataFrame, th: float = 10.0, bridge: int = 5) -> DataFrame:
    """n-sigma of the detrended series."""
    return nsigma(ft.detrended(series), th, bridge, "detrended")


def hits_nonzero_nsigma(series: DataFrame, th: float = 5.0, value: str = "value") -> DataFrame:
    """n-sigma with mean and deviation over values that are not zero."""
    return beyond(series, F.when(F.col(value) != 0, F.col(value)), value, th)


def hits_hbos(series: DataFrame, bins: int = 50) -> DataFrame:
    """Rows whose histogram score is over that right after the largest upward step in time order."""
    h = ft.histogram(series, bins)
    density = F.greatest(F.lit(1e-6), F.col("n") / (F.col("total") * F.when(F.col("width") > 0, F.col("width")).otherwise(1.0)))
    scores = h.select("point", "bin", "low", "width", (-F.log(density)).alias("score"))
    ends = h.select("point", "low", "width").distinct()
    scored = series.where("value is not null").join(ends, "point").withColumn("bin", ft.bin_of(bins)).drop("low", "width").join(scores.select("point", "bin", "score"), ["point", "bin"])
    step = F.lead("score").over(by_point()) - F.col("score")
    rises = scored.withColumn("_next", F.lead("score").over(by_point())).withColumn("_step", step).where("_step > 0")
    th = rises.groupBy("point").agg(F.max_by("_next", F.struct("_step", -F.col("pos"))).alias("th"))
    return scored.join(th, "point").where("score > th").select(*series.columns, "score")


def hits_drift(series: DataFrame, scales: tuple[tuple[int, int], ...] = ((100, 3), (3000, 100), (100_000, 2000)), th: float = 5.0) -> DataFrame:
    """(point, pos) over th deviations from the mean in the double rolling difference of any scale, both taken over
    differences that are not zero. All scales share one pass over the rows and one aggregation."""
    d = ft.drifts(series.select("point", "pos", "value"), scales)
    names = [c for c in d.columns if c.startswith("drift_")]
    known = {c: F.when(F.col(c) != 0, F.col(c)) for c in names}
    scale = d.groupBy("point").agg(*[f(x).alias(f"{n}_{c}") for c, x in known.items() for n, f in (("mean", F.avg), ("dev", F.stddev_pop))])
    far = [F.abs(F.col(c) - F.col(f"mean_{c}")) > th * F.col(f"dev_{c}") for c in names]
    any_far = far[0]
    for f in far[1:]:
        any_far |= f
    return d.join(scale, "point").where(any_far).select("point", "pos").distinct()


def chord_knee(curve: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(point, knee_x, knee_y): the point of a sorted curve farthest from the chord of its ends."""
    w = W.partitionBy("point").orderBy(x)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = curve.select("*", F.first(x).over(whole).alias("_x0"), F.first(y).over(whole).alias("_y0"), F.last(x).over(whole).alias("_x1"), F.last(y).over(whole).alias("_y1"))
    far = F.abs((F.col("_y1") - F.col("_y0")) * (F.col(x) - F.col("_x0")) - (F.col("_x1") - F.col("_x0")) * (F.col(y) - F.col("_y0")))
    best = d.withColumn("_d", F.round(far, 9)).groupBy("point").agg(F.max_by(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), F.struct("_d", -F.col(x))).alias("k"))
    return best.select("point", F.col("k.x").alias("knee_x"), F.col("k.y").alias("knee_y"))


def chunk_ranges(series: DataFrame, chunks: int = 200) -> DataFrame:
    """Range of each of equal chunks as a share of the point's range, ranked upward (x from 1)."""
    d = series.withColumn("_n", F.count("*").over(all_rows())).withColumn("_g", F.max("value").over(all_rows()) - F.min("value").over(all_rows()))
    r = d.groupBy("point", F.floor(F.col("pos") * chunks / F.col("_n")).alias("chunk")).agg(F.when(F.first("_g") > 0, (F.max("value") - F.min("value")) / F.first("_g")).otherwise(0.0).alias("y"))
    return r.withColumn("x", F.row_number().over(W.partitionBy("point").orderBy("y", "chunk")))


def range_filter(series: DataFrame, runs: DataFrame, ratios: DataFrame) -> DataFrame:
    """Runs whose local range (a single row counts with the 10 rows on either side) is at least `ratio` of the point's."""
    d = series.withColumn("_g", F.max("value").over(all_rows()) - F.min("value").over(all_rows()))
    d = d.withColumn("_near", F.max("value").over(rows(-10, 9)) - F.min("value").over(rows(-10, 9)))
    inside = expanded(runs, "seg_id").join(d, ["point", "pos"])
    local = inside.groupBy("point", "seg_id").agg(F.when(F.count("*") == 1, F.first("_near")).otherwise(F.max("value") - F.min("value")).alias("local"), F.first("_g").alias("_g"))
    keep = local.join(ratios, "point").where((F.col("_g") > 0) & (F.col("local") >= F.col("ratio") * F.col("_g")))
    return runs.join(keep.select("point", "seg_id"), ["point", "seg_id"], "left_semi")


def jump_borders(series: DataFrame, ratio: float | None = None, scales: tuple[tuple[int, int], ...] = ((100, 3), (3000, 100), (100_000, 2000)), gap: int = 1, chunks: int = 200) -> DataFrame:
    """Histogram and drift hits as runs, kept where the local range is large."""
    hits = settled(hits_hbos(series).select("point", "pos").union(hits_drift(series, scales)).distinct(), "hits")
    if ratio is None:
        ratios = chord_knee(chunk_ranges(series, chunks)).select("point", F.col("knee_y").alias("ratio"))
    else:
        ratios = series.select("point").distinct().withColumn("ratio", F.lit(ratio))
    return range_filter(series, split_runs(hits, gap=gap), ratios)


def mean_shift(series: DataFrame, bins: int = 20, edge: float = 0.009, min_rows: int = 500, far: float = 0.2) -> DataFrame:
    """Runs outside the main peak of the histogram: longer than min_rows, with a mean off the peak's centre by `far`."""
    h = ft.histogram(series, bins)
    peak = h.groupBy("point").agg(F.max_by(F.struct("bin", "n"), F.struct("n", -F.col("bin"))).alias("p")).select("point", F.col("p.bin").alias("top"), F.col("p.n").alias("most"))
    d = h.join(peak, "point")
    fails = F.col("n") <= edge * F.col("most")
    sides = d.groupBy("point", "low", "width", "top").agg(F.max(F.when(fails & (F.col("bin") < F.col("top")), F.col("bin"))).alias("l"), F.min(F.when(fails & (F.col("bin") > F.col("top")), F.col("bin"))).alias("r"))
    low = F.col("low") + (F.coalesce(F.col("l"), F.lit(-1)) + 1) * F.col("width")
    high = F.col("low") + F.coalesce(F.col("r"), F.lit(bins)) * F.col("width")
    ends = sides.select("point", low.alias("_lo"), high.alias("_hi"), (F.col("low") + (F.col("top") + 0.5) * F.col("width")).alias("centre"))
    out = series.join(ends, "point").where((F.col("value") < F.col("_lo")) | (F.col("value") > F.col("_hi")))
    runs = split_runs(out.select("point", "pos"), min_size=min_rows)
    means = expanded(runs, "seg_id").join(series, ["point", "pos"]).groupBy("point", "seg_id").agg(F.avg("value").alias("mean")).join(ends, "point")
    keep = means.where(F.abs(F.col("mean") - F.col("centre")) > far * F.abs(F.col("centre")))
    return runs.join(keep.select("point", "seg_id"), ["point", "seg_id"], "left_semi")


def morphological(series: DataFrame, k: int = 4, th: float = 3.0, bridge: int = 5) -> DataFrame:
    """n-sigma on the morphological gradient of the scaled series."""
    return nsigma(ft.gradient(ft.scaled(series), k, "scaled"), th, bridge, "gradient")


def vote(masks: DataFrame, least: int) -> DataFrame:
    """Positions that at least `least` methods of (method, point, pos, mask) flag, as intervals with their times."""
    votes = masks.groupBy("point", "pos").agg(F.sum("mask").alias("votes"), F.first("ts").alias("ts"))
    return mask_intervals(votes.withColumn("mask", (F.col("votes") >= least).cast("int")), "mask")


def deviating_groups(masked: DataFrame, th: float = 0.5, most_added: float = 0.3) -> DataFrame:
    """Mask plus the unmasked islands whose trimmed mean is off the overall one by th of it; unchanged where that adds
    more than most_added of the rows. Plain means stand in where an island has no trimmed mean."""
    from tidegauge.operators.core import islands

    g = islands(masked, "mask")
    groups = g.groupBy("point", "grp").agg(F.max("mask").alias("m"), F.count("*").alias("n"), F.avg("value").alias("mean"))
    groups = groups.join(ft.trimmed(g, "point", "grp"), ["point", "grp"])
    plain = groups.groupBy("point").agg((F.count(F.when(F.col("trimmed_mean").isNull(), 1)) > 0).alias("plain"), F.sum("n").alias("total"))
    overall = ft.trimmed(masked, "point").select("point", F.col("trimmed_mean").alias("o_trim")).join(masked.groupBy("point").agg(F.avg("value").alias("o_mean")), "point")
    d = groups.join(plain, "point").join(overall, "point")
    own, all_ = F.when(F.col("plain"), F.col("mean")).otherwise(F.col("trimmed_mean")), F.when(F.col("plain"), F.col("o_mean")).otherwise(F.col("o_trim"))
    d = d.withColumn("off", (F.col("m") == 0) & (F.abs(own - all_) > th * F.abs(all_)))
    added = F.sum(F.when(F.col("off"), F.col("n")).otherwise(0)).over(W.partitionBy("point")) / F.col("total")
    d = d.select("point", "grp", (F.col("off") & (added <= most_added)).alias("off"))
    return g.join(d, ["point", "grp"]).withColumn("mask", F.when(F.col("off"), 1).otherwise(F.col("mask"))).drop("off", "grp")


def residual_runs(series: DataFrame, k: float = 3.0, min_run: int = 1, robust: bool = True) -> DataFrame:
    """Runs of abs(z) > k with their largest z; centre and scale are lower median and MAD, or mean and deviation."""
    centre = F.expr("percentile_disc(0.5) within group (order by value)") if robust else F.avg("value")
    c = series.groupBy("point").agg(centre.alias("c"), F.stddev_samp("value").alias("sd"))
    d = series.join(c, "point").withColumn("_a", F.abs(F.col("value") - F.col("c")))
    scale = F.expr("percentile_disc(0.5) within group (order by _a)") if robust else F.first("sd")
    s = d.groupBy("point").agg(scale.alias("s"), F.first("sd").alias("sd1"))
    s = s.select("point", F.when(F.col("s") > 1e-8, F.col("s")).when(F.col("sd1") > 0, F.col("sd1")).otherwise(1.0).alias("scale"))
    z = d.join(s, "point").withColumn("z", F.col("_a") / F.col("scale")).where(F.col("z") > k)
    runs = split_runs(z.select("point", "pos"), min_size=min_run)
    return expanded(runs, "seg_id", "start_pos", "end_pos").join(z.select("point", "pos", "z"), ["point", "pos"]).groupBy("point", "seg_id", "start_pos", "end_pos").agg(F.max("z").alias("score"))


#: Name to forecaster: windows as a matrix (window, lookback) to the next value of each window; register_forecaster adds.
FORECASTERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {}


def register_forecaster(name: str, forecaster: Callable[[np.ndarray], np.ndarray]) -> None:
    FORECASTERS[name] = forecaster


def forecasts(series: DataFrame, lookback: int, forecaster: Callable[[np.ndarray], np.ndarray], batch: int = 8192) -> DataFrame:
    """(point, pos, forecast) from the `lookback` known values right before each row, where there are that many.

    A block of a point with a halo of `lookback` rows goes to a task, which gives the forecaster its sliding windows in
    batches, so neither a window nor a point is ever a row of its own."""
    from numpy.lib.stride_tricks import sliding_window_view

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        value, pos, own = rows["value"].to_numpy(float), rows["pos"].to_numpy(), rows["_own"].to_numpy(bool)
        out = np.full(len(rows), np.nan)
        if len(value) > lookback:
            windows = sliding_window_view(value[:-1], lookback)
            good = np.flatnonzero(own[lookback:] & ~np.isnan(windows).any(1))
            for a in range(0, len(good), batch):
                out[lookback + good[a : a + batch]] = forecaster(windows[good[a : a + batch]])
        return pd.DataFrame({"point": rows["point"], "pos": pos, "forecast": out})[own]

    kind = series.schema["point"].dataType.simpleString()
    dealt = haloed(series.select("point", "pos", "value"), lookback, 0)
    found = dealt.groupBy("point", "_block").applyInPandas(run, f"point {kind}, pos long, forecast double")
    return found.where(F.col("forecast").isNotNull() & ~F.isnan("forecast"))


def rolling_residual(series: DataFrame, lookback: int, forecaster: str = "mean") -> DataFrame:
    """Value less its forecast from the `lookback` rows before: last, mean, linear, or a registered forecaster; a constant
    window forecasts its last value; null until the window is full."""
    if forecaster in FORECASTERS:
        own = FORECASTERS[forecaster]
        ahead = forecasts(series, lookback, lambda x: np.where(x.max(1) == x.min(1), x[:, -1], own(x)))
        return series.join(ahead, ["point", "pos"], "left").withColumn("residual", F.col("value") - F.col("forecast")).drop("forecast")
    w = rows(-lookback, -1)
    full = F.count("value").over(w) == lookback
    last = F.lag("value").over(by_point())
    if forecaster == "last":
        forecast = last
    elif forecaster == "mean":
        forecast = F.avg("value").over(w)
    elif forecaster == "linear":
        forecast = F.regr_intercept("value", "pos").over(w) + F.regr_slope("value", "pos").over(w) * F.col("pos")
    else:
        raise KeyError(forecaster)
    flat = F.max("value").over(w) == F.min("value").over(w)
    return series.withColumn("residual", F.when(full, F.col("value") - F.when(flat, last).otherwise(forecast)))


def windows(series: DataFrame, length: int, overlap: float) -> DataFrame:
    """Start of each sliding window of a point; the last window ends with the series."""
    stride = max(1, int(length * (1 - overlap)))
    n = series.groupBy("point").agg(F.count("*").alias("n"))
    last = F.greatest(F.lit(0), F.col("n") - length)
    starts = F.array_union(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long")), F.array(last))
    return n.select("point", F.explode(starts).alias("start"), F.least(F.col("n"), F.lit(length)).alias("length"))


def isolation(series: DataFrame, share: float = 0.01, trees: int = 20, sample: int = 256, bridge: int = 5, seed: int = 7) -> DataFrame:
    return bridged(hits_isolation(series, share, trees, sample, seed), bridge)


def hits_isolation(series: DataFrame, share: float = 0.01, trees: int = 20, sample: int = 256, seed: int = 7) -> DataFrame:
    """Isolation scores on one value: seeded samples of 256 rows a point and tree, depth of each value in the trees,
    and the `share` of rows that are isolated first. Trees are small tables joined to their point's rows."""
    # only rows whose hash lies under a bound that about twice the sample meets are gathered, in one pass for all trees
    want = F.lit(2.0 * sample + 100) / F.count("*")
    bounds = series.where("value is not null").groupBy("point").agg(F.when(want >= 1, (1 << 63) - 1).otherwise((want * 2.0**64 - 2.0**63).cast("long")).alias("_bound"))
    mark = lambda t: F.xxhash64("pos", F.lit(seed * 1000) + t)
    low = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: mark(t) <= F.col("_bound"))
    near = series.where("value is not null").join(bounds, "point").select("point", "pos", "value", F.explode(low).alias("tree"))
    drawn = near.groupBy("point", "tree").agg(F.slice(F.sort_array(F.collect_list(F.struct(mark(F.col("tree")).alias("h"), "pos", "value"))), 1, sample)["value"].alias("x"))
    samples = drawn.withColumn("x", F.sort_array("x")).groupBy("point").agg(F.collect_list(F.struct("tree", "x")).alias("trees"))

    def path_lengths(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Leaf edges and depths of a random tree over sorted values."""
        edges, depths = [], []

        def grow(a: int, b: int, depth: int) -> None:
            if b - a <= 1 or depth >= 8 or x[a] == x[b - 1]:
                n = b - a
                extra = 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)
                edges.append(x[b - 1])
                depths.append(depth + extra)
                return
            cut = rng.uniform(x[a], x[b - 1])
            m = min(max(int(np.searchsorted(x, cut, "right")), a + 1), b - 1)
            grow(a, m, depth + 1)
            grow(m, b, depth + 1)

        grow(0, len(x), 0)
        return np.array(edges), np.array(depths)

    def score(batches):
        """Depths of rows that follow the trees of their point, which are on a row of their own."""
        built: dict = {}
        for pdf in batches:
            for i in np.flatnonzero(pdf["trees"].notna()):
                point = pdf["point"].iat[i]
                if point not in built:
                    built[point] = [path_lengths(np.array(t["x"]), np.random.default_rng(seed + t["tree"])) for t in pdf["trees"].iat[i]]
            pdf = pdf[pdf["trees"].isna()]
            out = np.zeros(len(pdf))
            for point, at in pdf.groupby("point").indices.items():
                v = pdf["value"].to_numpy()[at]
                out[at] = np.mean([d[np.minimum(np.searchsorted(e, v), len(e) - 1)] for e, d in built[point]], axis=0)
            yield pd.DataFrame({"point": pdf["point"], "pos": pdf["pos"], "depth": out})
            # rows come sorted by point, so the trees of the last one are all that the next batch can need
            last = next(reversed(built), None)
            built = {} if last is None else {last: built[last]}

    # the trees go once to each block of a point, not with each row
    rows_of = series.where("value is not null").select("point", F.floor(F.col("pos") / BLOCK).alias("_block"), "pos", "value")
    of_blocks = rows_of.select("point", "_block").distinct().join(samples, "point")
    both = rows_of.withColumn("_kind", F.lit(1)).unionByName(of_blocks.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    tasks = max(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-series.count() // TASK_ROWS))
    scored = both.repartition(tasks, "point", "_block").sortWithinPartitions("point", "_block", "_kind").select("point", "pos", "value", "trees").mapInPandas(score, "point string, pos long, depth double")
    scored = settled(scored, "depths")
    # a point has no more depths than its trees have leaves, so ranks come from counts by depth
    counts = scored.groupBy("point", "depth").agg(F.count("*").alias("n"))
    w = W.partitionBy("point")
    before = F.sum("n").over(w.orderBy("depth")) - F.col("n")
    rank = F.coalesce(before / F.nullif(F.sum("n").over(w) - 1, F.lit(0)), F.lit(0.0))
    least = counts.withColumn("_r", rank).where(F.col("_r") < share).groupBy("point").agg(F.max("depth").alias("_depth"))
    return scored.join(least, "point").where("depth <= _depth").select("point", "pos")


def polynomial_residual(series: DataFrame, degree: int = 12) -> DataFrame:
    """Value less a Chebyshev fit over positions: one Gram matrix a point by aggregation, one small solve a point."""
    x = 2 * F.col("pos") / F.greatest(F.max("pos").over(all_rows()), F.lit(1)) - 1
    d = series.withColumn("_x", x)
    # the Chebyshev polynomials on -1..1
    basis = [F.cos(F.lit(float(k)) * F.acos("_x")) for k in range(degree + 1)]
    d = d.withColumn("_b", F.array(*basis))
    gram = [F.sum(F.col("_b")[i] * F.col("_b")[j]).alias(f"g{i}_{j}") for i in range(degree + 1) for j in range(i, degree + 1)]
    sums = d.where("value is not null").groupBy("point").agg(*gram, *[F.sum(F.col("_b")[i] * F.col("value")).alias(f"r{i}") for i in range(degree + 1)])

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                g = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(degree + 1)] for i in range(degree + 1)])
                out.append(np.linalg.lstsq(g, np.array([row[f"r{i}"] for i in range(degree + 1)]), rcond=1e-10)[0].tolist())
            yield pd.DataFrame({"point": pdf["point"], "coef": out})

    fits = sums.mapInPandas(solve, "point string, coef array<double>")
    fitted = F.aggregate(F.zip_with("_b", "coef", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return d.join(fits, "point").withColumn("residual", F.col("value") - fitted).drop("_x", "_b", "coef")


def adtk_hbos(series: DataFrame, n_out: int, scales=((20, 3), (100, 10)), dead_seconds: float = 72_000, dead_distinct: int = 10, min_rows: int = 5, ratio: float | None = 0.3) -> DataFrame:
    """The composed detector: points with a step signal are left out; on the m4 sample jump borders, mean shifts and
    (where less than 70 % of the rows are dead) dead values are found and carried back to the raw rows by time."""
    steps = ft.step_signal(series).where("is_step").select("point")
    series = first_by(dealt(series.join(steps, "point", "left_anti"), series.count(), "point", "ts"), ["point", "ts"], "pos")
    # the sample is small beside the series and read by every part; written, each part plans from a plain scan
    ds = settled(m4(series, n_out).select("point", F.col("ds_pos").alias("pos"), "ts", "value"), "sample")
    found = jump_borders(ds, ratio, scales).select("point", "start_pos", "end_pos").union(mean_shift(ds, min_rows=min_rows).select("point", "start_pos", "end_pos"))
    dead = clean.dead_values(ds, dead_seconds, dead_distinct)
    some = dead.groupBy("point").agg(F.avg("dead").alias("share")).where("share < 0.7").select("point")
    dead_runs = split_runs(dead.where("dead = 1").join(some, "point", "left_semi").select("point", "pos"))
    found = settled(found.union(dead_runs.select("point", "start_pos", "end_pos")), "found")
    spans = settled(mask_intervals(mask_from_segments(ds, found), "mask"), "spans")
    return mask_in_time(series, spans)


#: Method name to detector, each DataFrame to segments; register() adds to it.
DETECTORS: dict[str, Callable[..., DataFrame]] = {
    "nsigma": nsigma,
    "iqr": iqr,
    "standardized": standardised,
    "iforest": isolation,
    "morphological": morphological,
    "jump_borders": jump_borders,
    "mean_shift": mean_shift,
    "residual_runs": residual_runs,
}


def register(name: str, detector: Callable[..., DataFrame]) -> None:
    DETECTORS[name] = detector


def detect(series: DataFrame, method: str, **params) -> DataFrame:
    """Segments of the named method; an unknown name raises KeyError."""
    return DETECTORS[method](series, **params)
