"""Distribution, rolling and shape features of series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.operators.clean import constant_share
from tidegauge.operators.core import BLOCK, all_rows, by_point, framed, neighbour_known, rows
from tidegauge.operators.smoothing import smooth


def scaled(series: DataFrame, value: str = "value") -> DataFrame:
    """Value to 0..1 in each point; unchanged where constant."""
    low, high = F.min(value).over(all_rows()), F.max(value).over(all_rows())
    return series.withColumn("scaled", F.when(low == high, F.col(value)).otherwise((F.col(value) - low) / (high - low)))


def clipped_to_mean(series: DataFrame, th: float = 3.0) -> DataFrame:
    """Values beyond th population deviations become the mean."""
    mean, dev = F.avg("value").over(all_rows()), F.stddev_pop("value").over(all_rows())
    return series.withColumn("clipped", F.when(F.abs(F.col("value") - mean) > th * dev, mean).otherwise(F.col("value")))


def detrended(series: DataFrame) -> DataFrame:
    """Value less its least-squares line over positions."""
    w = all_rows()
    slope, start = F.regr_slope("value", "pos").over(w), F.regr_intercept("value", "pos").over(w)
    return series.withColumn("detrended", F.col("value") - (start + slope * F.col("pos")))


def histogram(series: DataFrame, bins: int) -> DataFrame:
    """Dense equi-width histogram: point, bin (0 first), low, width, n; the largest value is in the last bin."""
    ends = series.groupBy("point").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("total"))
    ends = ends.withColumn("width", (F.col("high") - F.col("low")) / bins)
    counted = series.where("value is not null").join(ends, "point").groupBy("point", bin_of(bins).alias("bin")).agg(F.count("*").alias("n"))
    dense = ends.select("point", "low", "width", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return dense.join(counted, ["point", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def bin_of(bins: int) -> Column:
    """Bin of a value joined with low and width."""
    return F.when(F.col("width") > 0, F.least(F.floor((F.col("value") - F.col("low")) / F.col("width")), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")


def step_shape(series: DataFrame, th: float = 0.25, bins: int = 20, top: int = 5) -> DataFrame:
    """Whether the values sit on separate levels: every two of the `top` fullest bins have a bin between them below
    1 % of the fullest, and at most `th` of all bins are above it."""
    h = histogram(series, bins).withColumn("most", F.max("n").over(W.partitionBy("point")))
    h = h.withColumn("low_bin", F.col("n") < 0.01 * F.col("most"))
    ranked = h.withColumn("k", F.row_number().over(W.partitionBy("point").orderBy(F.desc("n"), "bin"))).where(F.col("k") <= top)
    # `empties` is how many low bins come before a bin: two bins have one between them if their counts differ
    empties = F.sum(F.col("low_bin").cast("int")).over(W.partitionBy("point").orderBy("bin"))
    before = h.select("point", "bin", empties.alias("empties"))
    peaks = ranked.where(~F.col("low_bin")).join(before, ["point", "bin"])
    gap = F.col("empties") - F.lag("empties").over(W.partitionBy("point").orderBy("bin"))
    apart = peaks.withColumn("gap", gap).groupBy("point").agg(F.coalesce(F.min("gap") > 0, F.lit(True)).alias("apart"))
    full = h.groupBy("point").agg((F.sum((~F.col("low_bin")).cast("int")) <= th * bins).alias("sparse"))
    return full.join(apart, "point", "left").select("point", (F.col("sparse") & F.coalesce("apart", F.lit(True))).alias("is_step_shape"))


def step_signal(series: DataFrame, constant: float = 0.8, **kw) -> DataFrame:
    c, s = constant_share(series), step_shape(series, **kw)
    return c.join(s, "point").select("point", "constant_ratio", "is_step_shape", ((F.col("constant_ratio") > constant) & F.col("is_step_shape")).alias("is_step"))


def trimmed(df: DataFrame, *keys: str) -> DataFrame:
    """Mean and median of the values strictly inside the 5 and 95 % quantiles of each key. Values are added from the key's
    last row to its first, in blocks, so that the mean's last digits do not depend on how rows are dealt."""
    ends = df.groupBy(*keys).agg(F.percentile("value", F.lit(0.05)).alias("q05"), F.percentile("value", F.lit(0.95)).alias("q95"), F.max("pos").alias("_end"))
    inside = df.join(ends, list(keys)).where((F.col("value") > F.col("q05")) & (F.col("value") < F.col("q95")))
    inside = inside.withColumn("_part", F.floor((F.col("_end") - F.col("pos")) / BLOCK))
    upto = W.partitionBy(*keys, "_part").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)
    parts = inside.withColumn("_sum", F.sum("value").over(upto)).groupBy(*keys, "_part").agg(F.min_by("_sum", "pos").alias("_sum"), F.count("*").alias("_n"))
    sums = F.array_sort(F.collect_list(F.struct("_part", "_sum")))
    mean = F.aggregate(sums, F.lit(0.0), lambda total, part: total + part["_sum"]) / F.sum("_n")
    means = parts.groupBy(*keys).agg(mean.alias("trimmed_mean"))
    medians = inside.groupBy(*keys).agg(F.percentile("value", F.lit(0.5)).alias("trimmed_median"))
    return ends.select(*keys).join(means.join(medians, list(keys)), list(keys), "left")


def group_median_variance(series: DataFrame, group: str, share: float = 0.05) -> DataFrame:
    """Median of the rolling sample variance of each group; the frame is a share of the group's rows, at least 2."""
    key = W.partitionBy("point", group)
    w = key.orderBy("pos")
    d = series.withColumn("_v", F.col("value") - F.avg("value").over(key)).withColumn("_n", F.count("*").over(key)).withColumn("_i", F.row_number().over(w))
    d = d.withColumn("_w", F.greatest(F.lit(2), F.floor(F.col("_n") * share))).withColumn("_s1", F.sum("_v").over(w)).withColumn("_s2", F.sum(F.col("_v") * F.col("_v")).over(w))
    before = d.select("point", group, (F.col("_i") + F.col("_w")).alias("_i"), F.col("_s1").alias("_b1"), F.col("_s2").alias("_b2"))
    both = d.where("_i >= _w").join(before, ["point", group, "_i"], "left")
    s1, s2 = F.col("_s1") - F.coalesce("_b1", F.lit(0.0)), F.col("_s2") - F.coalesce("_b2", F.lit(0.0))
    var = F.greatest(F.lit(0.0), (s2 - s1 * s1 / F.col("_w")) / (F.col("_w") - 1))
    return both.groupBy("point", group).agg(F.percentile(var, F.lit(0.5)).alias("median_variance"))


def segment_features(series: DataFrame, marked: DataFrame) -> DataFrame:
    """Per segment of `marked` (point, seg_id, value): means, deviations, shape, and ratios to the whole point."""
    whole = series.groupBy("point").agg(F.avg("value").alias("g_mean"), (F.max("value") - F.min("value")).alias("g_range"), F.stddev_pop("value").alias("g_std"), F.count("*").alias("g_n"))
    step = F.col("value") - F.lag("value").over(W.partitionBy("point", "seg_id").orderBy("pos"))
    own = marked.withColumn("_step", step).groupBy("point", "seg_id").agg(
        F.avg("value").alias("mean"),
        (F.max("value") - F.min("value")).alias("range"),
        F.stddev_pop("value").alias("std"),
        F.count("*").alias("n"),
        F.skewness("value").alias("skew"),
        F.kurtosis("value").alias("kurt"),
        F.avg("_step").alias("diff_mean"),
        F.stddev_pop("_step").alias("diff_std"),
    )
    ratio = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    return own.join(whole, "point").select(
        "point", "seg_id", "n", "mean", "std", "skew", "kurt", "diff_mean", "diff_std",
        ratio("mean", "g_mean").alias("mean_ratio"), ratio("range", "g_range").alias("range_ratio"), ratio("std", "g_std").alias("std_ratio"),
        ratio("std", "mean").alias("cv"), (F.col("n") / F.col("g_n")).alias("length_ratio"),
    )


def double_rolling(series: DataFrame, left: int, right: int) -> DataFrame:
    """`drift` at one scale (see drifts)."""
    return drifts(series, ((left, right),)).withColumnRenamed("drift_0", "drift")


def drifts(series: DataFrame, scales: tuple[tuple[int, int], ...]) -> DataFrame:
    """drift_0, drift_1, ... for scales (left, right): abs(mean of this and the next rows, `right` in all, less the mean of
    the `left` rows before); 0 where either frame is cut by an end of the point or has no known value. Nulls count as
    rows, not as values."""
    frames = {f"_{side}{i}": (0, right - 1) if side == "a" else (-left, -1) for i, (left, right) in enumerate(scales) for side in "ab"}
    d = framed(series, frames)
    mean = lambda f, size: F.when(F.col(f"{f}_n") == size, F.col(f"{f}_s1") / F.nullif(F.col(f"{f}_k"), F.lit(0)))
    out = {f"drift_{i}": F.coalesce(F.abs(mean(f"_a{i}", right) - mean(f"_b{i}", left)), F.lit(0.0)) for i, (left, right) in enumerate(scales)}
    return d.withColumns(out).select(*series.columns, *out)


def centred_rolling(series: DataFrame, width: int) -> DataFrame:
    """Mean and sample deviation of the known values in the `width` rows around each row, where the frame is whole;
    next, then last known results elsewhere."""
    half = width // 2
    d = framed(series, {"_f": (-half, width - half - 1)}, powers=2)
    full, k = F.col("_f_n") == width, F.col("_f_k")
    mean = F.when(full & (k > 0), F.col("centre") + F.col("_f_s1") / k)
    std = F.when(full & (k > 1), F.sqrt(F.greatest(F.lit(0.0), (F.col("_f_s2") - F.col("_f_s1") * F.col("_f_s1") / k) / (k - 1))))
    d = d.select(*series.columns, mean.alias("roll_mean"), std.alias("roll_std"))
    return neighbour_known(d, "roll_mean", "roll_std")


def dilation(series: DataFrame, k: int, value: str = "value", name: str = "dilated") -> DataFrame:
    return series.withColumn(name, F.max(value).over(rows(-(k // 2), k - 1 - k // 2)))


def erosion(series: DataFrame, k: int, value: str = "value", name: str = "eroded") -> DataFrame:
    return series.withColumn(name, F.min(value).over(rows(-(k // 2), k - 1 - k // 2)))


def gradient(series: DataFrame, k: int, value: str = "value") -> DataFrame:
    return erosion(dilation(series, k, value), k, value).withColumn("gradient", F.col("dilated") - F.col("eroded"))


def opening(series: DataFrame, k: int) -> DataFrame:
    return dilation(erosion(series, k), k, "eroded", "opened")


def closing(series: DataFrame, k: int) -> DataFrame:
    return erosion(dilation(series, k), k, "dilated", "closed")


def moving_average(series: DataFrame, width: int) -> DataFrame:
    """Centred mean of the known values over whole frames of odd width, null at the ends."""
    half = width // 2
    d = framed(series, {"_f": (-half, half)})
    mean = F.when(F.col("_f_n") == width, F.col("centre") + F.col("_f_s1") / F.nullif(F.col("_f_k"), F.lit(0)))
    return d.select(*series.columns, mean.alias("smooth"))


def cubic_smooth(series: DataFrame, width: int) -> DataFrame:
    """Centre value of the least-squares cubic over a full odd frame, null at the ends. The weights of a centred cubic
    are a - b j^2 in the offset j, so three windowed moments of the position are enough."""
    m = width // 2
    j2 = sum(j * j for j in range(-m, m + 1))
    j4 = sum(j**4 for j in range(-m, m + 1))
    det = width * j4 - j2 * j2
    v = F.col("value") - F.avg("value").over(all_rows())
    w = rows(-m, m)
    d = series.withColumn("_v", v).withColumn("_c", F.avg("value").over(all_rows()))
    # moments around the row itself: sum over the frame of v and of v * j^2, j = frame position - own position
    x0, x1, x2 = F.sum("_v").over(w), F.sum(F.col("_v") * F.col("pos")).over(w), F.sum(F.col("_v") * F.col("pos") * F.col("pos")).over(w)
    q2 = x2 - 2 * F.col("pos") * x1 + F.col("pos") * F.col("pos") * x0
    fitted = (j4 * x0 - j2 * q2) / det + F.col("_c")
    return d.select(*series.columns, F.when(F.count("*").over(w) == width, fitted).alias("smooth"))


def gaussian(series: DataFrame, sigma: float = 3.0, radius: int = 12) -> DataFrame:
    """Gaussian smoothing with ends mirrored (the end row repeated)."""
    raw = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights = (raw / raw.sum()).tolist()
    # rows before the first mirror the first rows: offset -i stands at row i - 1
    ends = series.withColumn("_n", F.count("*").over(all_rows()))
    left = ends.where(F.col("pos") < radius).select("point", (-F.col("pos") - 1).alias("pos"), "value")
    right = ends.where(F.col("pos") >= F.col("_n") - radius).select("point", (2 * F.col("_n") - 1 - F.col("pos")).alias("pos"), "value")
    padded = series.select("point", "pos", "value").union(left).union(right)
    w = by_point()
    terms = [(F.lag("value", -k) if k < 0 else F.lead("value", k)).over(w) * F.lit(c) for k, c in zip(range(-radius, radius + 1), weights)]
    smooth = padded.withColumn("smooth", sum(terms[1:], terms[0]))
    return series.join(smooth.select("point", "pos", "smooth"), ["point", "pos"])


def haar_residual(series: DataFrame, level: int = 3) -> DataFrame:
    """Value less the hierarchical mean of its aligned block of 2**level rows (a pair without a partner is itself)."""
    out = series.withColumn("_m", F.col("value"))
    for k in range(1, level + 1):
        block = F.floor(F.col("pos") / (1 << k))
        key = W.partitionBy("point", block)
        half = F.floor(F.col("pos") / (1 << (k - 1)))
        first = F.avg(F.when(half % 2 == 0, F.col("_m"))).over(key)
        second = F.avg(F.when(half % 2 == 1, F.col("_m"))).over(key)
        out = out.withColumn("_m", (first + F.coalesce(second, first)) / 2)
    return out.withColumn("residual", F.col("value") - F.col("_m")).drop("_m")


#: The low-pass taps of the Daubechies wavelet with four vanishing moments.
DB4 = (0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278)


def _sized(series: DataFrame, name: str) -> DataFrame:
    """series with the rows of its point; null is a point like any other."""
    sizes = series.groupBy(F.col("point").alias("_point")).agg(F.count("*").alias(name))
    return series.join(sizes, F.col("point").eqNullSafe(F.col("_point"))).drop("_point")


def wavelet_energy(series: DataFrame, level: int = 5) -> DataFrame:
    """Share of detail energy in the total of a db4 decomposition with symmetric ends."""
    taps = len(DB4)
    low = _sized(series, "n").select("point", F.col("pos").cast("long").alias("pos"), "value", "n", F.lit(0.0).alias("detail"))
    lo_tap, hi_tap = F.array(*map(F.lit, DB4)), F.array(*[F.lit((-1) ** (i + 1) * x) for i, x in enumerate(reversed(DB4))])
    for _ in range(level):
        # a row stands at its own place and, near an end, at its mirror images
        places = F.expr(f"filter(array(pos, if(pos < {taps - 1}, -pos - 1, null), if(pos >= n - {taps - 1}, 2 * n - 1 - pos, null)), p -> p is not null)")
        placed = low.select("point", "pos", "value", "n", "detail", F.explode(places).alias("p"))
        # output k is the sum over taps of x[2k + 1 - tap]
        taken = placed.select("*", F.explode(F.expr(f"sequence(0, {taps - 1})")).alias("tap")).where(F.pmod(F.col("p") - 1 + F.col("tap"), F.lit(2)) == 0)
        k = ((F.col("p") - 1 + F.col("tap")) / 2).cast("long")
        size = F.floor((F.col("n") + taps - 1) / 2)
        taken = taken.withColumn("k", k).where((F.col("k") >= 0) & (F.col("k") < size))
        both = taken.groupBy("point", "k", size.alias("n")).agg(F.sum(F.col("value") * lo_tap[F.col("tap")]).alias("value"), F.sum(F.col("value") * hi_tap[F.col("tap")]).alias("hi"), F.sum(F.when((F.col("p") == F.col("pos")) & (F.col("tap") < 2), F.col("detail")).otherwise(0.0)).alias("detail"))
        # a row hands the energy so far to the one output that it meets at its own place with the first or second tap
        energy = F.col("detail") + F.coalesce(F.col("hi") * F.col("hi"), F.lit(0.0))
        low = both.select("point", F.col("k").alias("pos"), "value", "n", energy.alias("detail"))
    total = low.groupBy("point").agg(F.sum("detail").alias("detail"), F.sum(F.col("value") * F.col("value")).alias("rest"))
    return total.select("point", (F.col("detail") / (F.col("detail") + F.col("rest"))).alias("detail_share"))


def high_frequency_share(series: DataFrame, segment: int = 256, cut: float = 0.1) -> DataFrame:
    """Share of Welch energy at or above cut times the sampling rate: Hann segments with half overlap, means removed. A
    point of fewer rows is one segment; nulls count as 0."""
    half = segment // 2
    place = F.floor(F.col("pos") / half)
    segments = F.when(F.col("_n") < segment, F.array(F.lit(0).cast("long"))).otherwise(F.array(place, place - 1))
    dealt = _sized(series, "_n").select("point", "pos", "value", "_n", F.explode(segments).alias("seg"))
    whole = dealt.where((F.col("_n") < segment) | (F.col("seg") >= 0) & ((F.col("seg") + 2) * half <= F.col("_n")))
    arrays = whole.groupBy("point", "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("value", F.lit(0.0)).alias("value")))), lambda s: s["value"]).alias("x"))

    @F.pandas_udf("array<double>")
    def power(x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), dtype=object)
        sizes = x.map(len)
        for size in sizes.unique():
            at = np.flatnonzero(sizes == size)
            a = np.stack(x.to_numpy()[at])
            window = np.hanning(size + 1)[:-1]
            p = np.abs(np.fft.rfft((a - a.mean(1, keepdims=True)) * window, axis=1)) ** 2
            for k, row in zip(at, p):
                out.iat[k] = row
        return out

    spectra = arrays.select("point", F.size("x").alias("size"), F.posexplode(power("x")).alias("freq", "p")).groupBy("point", "size", "freq").agg(F.avg("p").alias("p"))
    return spectra.groupBy("point").agg((F.sum(F.when(F.col("freq") >= cut * F.col("size"), F.col("p")).otherwise(0.0)) / F.nullif(F.sum("p"), F.lit(0.0))).alias("high_share"))


def noisy(series: DataFrame, limit: float = 0.45) -> DataFrame:
    both = high_frequency_share(series).join(wavelet_energy(series), "point")
    return both.withColumn("noise", (F.col("high_share") + F.col("detail_share")) / 2).withColumn("is_noisy", F.col("noise") > limit)


def seasonal_trend(series: DataFrame, period: int, ends: bool = False) -> DataFrame:
    """Trend (centred moving average), seasonal (mean of the detrended phase, centred) and residual. The first and last
    half period have no trend, or with `ends` that of a line through the first or last whole one."""
    width = period if period % 2 else period + 1
    t = (smooth(series, width, 1) if ends else moving_average(series, width)).withColumnRenamed("smooth", "trend")
    phase = W.partitionBy("point", F.col("pos") % period)
    t = t.withColumn("_s", F.avg(F.col("value") - F.col("trend")).over(phase))
    level = t.groupBy("point", (F.col("pos") % period).alias("p")).agg(F.first("_s").alias("s")).groupBy("point").agg(F.avg("s").alias("_level"))
    t = t.join(level, "point").withColumn("seasonal", F.col("_s") - F.col("_level"))
    return t.withColumn("residual", F.col("value") - F.col("trend") - F.col("seasonal")).drop("_s", "_level")
