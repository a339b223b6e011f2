"""The residual pipeline: sample, gate by the kind of signal, decompose, detect in components, split, carry back.

All points go through one plan. A point with a step signal or mostly noise is gated: it keeps its rows with empty masks.
The others are decomposed; each chosen component gives hits, bridged to segments, and the components' masks add up. Runs
of hits are global or local by their range, and by clusters of their features where asked; dead stretches are global.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import clean
from tidegauge.operators import density as dn
from tidegauge.operators import detect as dt
from tidegauge.operators import features as ft
from tidegauge.operators import split as sp
from tidegauge.operators.core import bridged, dealt, expanded, first_by, mask_from_segments, split_runs, with_positions_by_bucket
from tidegauge.operators.reduce import m4
from tidegauge.operators.smoothing import piecewise_residual, smooth
from tidegauge.sources.scratch import settled

MASKS = ("outlier_mask", "global_mask", "local_mask", "global_mask_cluster", "local_mask_cluster")


def _piecewise(series: DataFrame, th: float) -> DataFrame:
    smoothed = smooth(series, 601, 3).select("point", "pos", F.col("smooth").alias("value"))
    return dt.hits_iqr(piecewise_residual(smoothed), th, "residual")


def _wavelet(series: DataFrame, th: float) -> DataFrame:
    unit = ft.scaled(series).select("point", "pos", F.col("scaled").alias("value"))
    return dt.hits_nsigma(ft.haar_residual(unit), th, "residual")


def _gradient(series: DataFrame, th: float) -> DataFrame:
    return dt.hits_nsigma(ft.gradient(ft.scaled(series), 4, "scaled"), th, "gradient")


def _standardised(series: DataFrame, th: float) -> DataFrame:
    return dt.hits_nsigma(ft.detrended(series), th, "detrended")


#: Method name to hits (point, pos) of a component (point, pos, value) at a threshold.
METHODS: dict[str, Callable[[DataFrame, float], DataFrame]] = {"piecewise_linear": _piecewise, "wavelet": _wavelet, "cv": _gradient, "standardized": _standardised, "iforest": dt.hits_isolation}
CLUSTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"kmeans": sp.split_by_two_means, "dbscan": dn.split_by_density}


def component_segments(component: DataFrame, method: str, th: float, merge: float) -> DataFrame:
    """Hits of a component, bridged where at most `merge` rows apart; below 1 that is a share of the point's rows."""
    hits = METHODS[method](component, th).select("point", "pos")
    if merge >= 1:
        return bridged(hits, int(merge))
    gaps = component.groupBy("point").agg(F.floor(F.count("*") * merge).alias("_gap"))
    return bridged(hits.join(gaps, "point"), F.col("_gap"))


def split_segments(series: DataFrame, segments: DataFrame, range_th: float, cluster: str | None) -> DataFrame:
    """segments with is_global by range and `cluster_global` by clusters of their features, which is the same where none
    are asked for or a point has one segment."""
    by_range = sp.split_by_range(series, segments, range_th)
    if cluster is None:
        return by_range.withColumn("cluster_global", F.col("is_global"))
    by_range = settled(by_range, "by-range")
    many = by_range.groupBy("point").agg(F.count("*").alias("n")).where("n > 1").select("point")
    several = segments.join(many, "point", "left_semi")
    marked = series.join(expanded(several, "seg_id"), ["point", "pos"]).select("point", "seg_id", "pos", "value")
    features = settled(ft.segment_features(series, marked).select("point", "seg_id", "mean_ratio", "range_ratio"), "features")
    found = CLUSTERS[cluster](features).withColumnRenamed("is_global", "_c")
    return by_range.join(found, ["point", "seg_id"], "left").withColumn("cluster_global", F.coalesce("_c", "is_global")).drop("_c")


def residual_pipeline(
    series: DataFrame,
    n_out: int,
    method: str = "wavelet",
    th: float = 5.0,
    merge: float = 0.01,
    components: tuple[str, ...] | None = ("trend", "residual"),
    period: int = 60,
    range_th: float = 0.1,
    cluster: str | None = None,
    dead_seconds: float = 72_000,
    dead_distinct: int = 10,
    post_filter: float | None = None,
    steps: DataFrame | None = None,
    noise: DataFrame | None = None,
    decomposed: DataFrame | None = None,
) -> DataFrame:
    """Sampled rows (point, pos, orig_pos, ts, value) with the columns of MASKS.

    `components` are those of seasonal_trend, or None for the values themselves. `post_filter` widens the global mask by
    groups that deviate that much (see deviating_groups). Steps and noise are judged on all rows: extremes that are sampled
    from a slow wave, at less than a few buckets a period, look like noise. `steps` and `noise` (point) and `decomposed` (point, pos,
    trend, seasonal, residual, by sampled position) stand in for what is worked out otherwise. Of rows with equal times
    the first counts.
    """
    series = first_by(dealt(series, series.count(), "point", "ts"), ["point", "ts"], "pos")
    sampled = settled(m4(series, n_out).select("point", F.col("ds_pos").alias("pos"), "orig_pos", "ts", "value"), "sample")
    values = sampled.select("point", "pos", "ts", "value")
    steps = ft.step_signal(series).where("is_step") if steps is None else steps
    if noise is None:
        whole = settled(with_positions_by_bucket(series, "pos").select("point", "pos", "value"), "whole")
        noise = ft.noisy(whole).where("is_noisy")
    gated = settled(steps.select("point").union(noise.select("point")).distinct(), "gated")
    open_ = values.join(gated, "point", "left_anti")
    if components is None:
        parts = {"value": open_}
    else:
        table = ft.seasonal_trend(open_, period, ends=True) if decomposed is None else decomposed.join(gated, "point", "left_anti")
        table = settled(table.select("point", "pos", *components), "components")
        parts = {c: table.select("point", "pos", F.col(c).alias("value")) for c in components}
    segments = None
    for part in parts.values():
        found = component_segments(part, method, th, merge).select("point", "start_pos", "end_pos")
        segments = found if segments is None else segments.unionByName(found)
    segments = settled(segments, "component-segments")
    hits = settled(expanded(segments), "hits")  # a row for each component that covers it
    runs = settled(split_runs(hits.distinct()), "runs")
    dead = clean.dead_values(open_, dead_seconds, dead_distinct, only_zero=True).where("dead = 1").select("point", "pos")
    sides = split_segments(values, runs, range_th, cluster)
    marks = hits.select("point", "pos", F.lit("outlier_mask").alias("mask"))
    for flag, there, else_ in (("is_global", "global_mask", "local_mask"), ("cluster_global", "global_mask_cluster", "local_mask_cluster")):
        rows = expanded(sides.select("point", "start_pos", "end_pos", F.when(F.col(flag), there).otherwise(else_).alias("mask")), "mask")
        marks = marks.unionByName(rows.select("point", "pos", "mask")).unionByName(dead.select("point", "pos", F.lit(there).alias("mask")))
    columns = [F.sum((F.col("mask") == m).cast("int")) if m == "outlier_mask" else F.max((F.col("mask") == m).cast("int")) for m in MASKS]
    wide = marks.groupBy("point", "pos").agg(*[c.cast("int").alias(m) for c, m in zip(columns, MASKS)])
    out = sampled.join(wide, ["point", "pos"], "left").fillna(0, list(MASKS))
    if post_filter is None:
        return out
    plain = settled(out, "masked")
    widened = dt.deviating_groups(plain.select("point", "pos", "value", F.col("global_mask").alias("mask")), th=post_filter)
    return plain.drop("global_mask").join(widened.select("point", "pos", F.col("mask").alias("global_mask")), ["point", "pos"]).select(*out.columns)


def to_raw_rows(series: DataFrame, sampled: DataFrame, mask: str = "global_mask") -> DataFrame:
    """series with `mask` over all rows from the first to the last row that each run of the sampled mask stands for."""
    at = sampled.select("point", "pos", "orig_pos")
    runs = split_runs(sampled.where(F.col(mask) > 0).select("point", "pos"))
    ends = runs.join(at.select("point", F.col("pos").alias("start_pos"), F.col("orig_pos").alias("_a")), ["point", "start_pos"]).join(at.select("point", F.col("pos").alias("end_pos"), F.col("orig_pos").alias("_b")), ["point", "end_pos"])
    return mask_from_segments(series, ends.select("point", F.col("_a").alias("start_pos"), F.col("_b").alias("end_pos")), mask)


def index_spaces(series: DataFrame, masks: DataFrame) -> DataFrame:
    """(point, index_space) of masks (point, pos, orig_pos, mask) over a series: unknown where a point has masks alone,
    empty where it has no mask rows, raw where there are as many as rows, raw_mapped where the others all know their
    raw position and some is hit, else downsample."""
    rows = series.groupBy("point").agg(F.count("*").alias("n_raw"))
    own = masks.groupBy("point").agg(F.count("*").alias("n_mask"), F.count("orig_pos").alias("n_at"), F.max(F.coalesce("mask", F.lit(0))).alias("hit"))
    d = rows.join(own, "point", "full")
    space = F.when(F.col("n_raw").isNull(), "unknown").when(F.col("n_mask").isNull(), "empty").when(F.col("n_mask") == F.col("n_raw"), "raw").when((F.col("n_at") == F.col("n_mask")) & (F.col("hit") > 0), "raw_mapped").otherwise("downsample")
    return d.select("point", space.alias("index_space"))


def resolved_masks(series: DataFrame, masks: DataFrame) -> DataFrame:
    """(point, pos, value, mask, index_space): the rows that an evaluation reads. A raw mask stands as it is; runs of a
    mapped one cover all raw rows between the positions of their ends; a sampled one is laid on its own rows, which are
    those at its positions, or the first ones of the point where it has none. Points with an empty mask have their rows
    unmasked; unknown points have none."""
    spaces = settled(index_spaces(series, masks), "spaces")
    tagged = masks.join(spaces, "point")
    raw = tagged.where("index_space = 'raw'").select("point", "pos", "mask")
    mapped = tagged.where("index_space = 'raw_mapped'").select("point", "pos", "orig_pos", F.col("mask").alias("global_mask"))
    runs = split_runs(mapped.where("global_mask > 0").select("point", "pos"))
    at = lambda end, name: mapped.select("point", F.col("pos").alias(end), F.col("orig_pos").alias(name))
    ends = runs.join(at("start_pos", "_a"), ["point", "start_pos"]).join(at("end_pos", "_b"), ["point", "end_pos"])
    spread = expanded(ends.select("point", F.col("_a").alias("start_pos"), F.col("_b").alias("end_pos"))).distinct().withColumn("mask", F.lit(1))
    laid = tagged.where("index_space = 'downsample'").select("point", F.coalesce("orig_pos", "pos").alias("pos"), "mask")
    read = series.select("point", "pos", "value").join(spaces, "point")
    full = read.where("index_space <> 'downsample'").join(raw.unionByName(spread), ["point", "pos"], "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    return full.select("point", "pos", "value", "mask", "index_space").unionByName(read.join(laid, ["point", "pos"]).select("point", "pos", "value", "mask", "index_space"))
