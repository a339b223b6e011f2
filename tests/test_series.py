"""Hand-made series: edges and properties of the interval algebra, filling and reduction."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import clean, core, detect, features, reduce

SCHEMA = "point string, pos long, ts timestamp, value double"
T0 = datetime(2024, 1, 1)


def series(spark, **points):
    rows = [(p, i, T0 + timedelta(minutes=i), None if v is None else float(v)) for p, values in points.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_mask_to_intervals_and_back(spark):
    s = series(spark, a=[0, 1, 1, 0, 1.0], b=[1.0], c=[0.0, 0.0]).withColumn("mask", F.col("value").cast("int"))
    found = core.mask_intervals(s, "mask")
    assert rows(found, "point", "start_pos", "end_pos") == [("a", 1, 2), ("a", 4, 4), ("b", 0, 0)]
    back = core.mask_from_segments(s.drop("mask"), found)
    assert rows(back, "point", "pos", "mask") == rows(s, "point", "pos", "mask")


def test_intervals_can_end_after_the_run(spark):
    s = series(spark, a=[1, 1, 0, 1.0]).withColumn("mask", F.col("value").cast("int"))
    assert rows(core.mask_intervals(s, "mask", "first_false"), "start_pos", "end_pos") == [(0, 2), (3, 3)]


def test_bridging_and_merging(spark):
    s = series(spark, a=[0.0] * 30).where(F.col("pos").isin(0, 3, 9, 20))
    assert rows(core.bridged(s, 5), "start_pos", "end_pos") == [(0, 3), (9, 9), (20, 20)]
    assert rows(core.merged_segments(core.bridged(s, 5), 6), "start_pos", "end_pos") == [(0, 9), (20, 20)]
    assert rows(core.merged_segments(core.bridged(s, 5), 6, strict=True), "start_pos", "end_pos") == [(0, 3), (9, 9), (20, 20)]


def test_both_numberings_agree(spark):
    s = series(spark, a=range(50), b=[1.0]).withColumn("value", F.col("value").cast("double")).drop("pos")
    assert rows(core.with_positions(s), "point", "pos", "ts") == rows(core.with_positions_by_bucket(s, bucket="hour"), "point", "pos", "ts")


def test_gap_fill_leaves_no_null(spark):
    s = series(spark, a=[1.0, None, 3.0, 4.0, None], b=[2.0]).where("not (point = 'a' and pos = 3)")
    got = rows(clean.filled(s, clean.sampling_interval(s)), "point", "value")
    assert [v for p, v in got if p == "a"] == [1.0, 3.0, 3.0, 3.0, 3.0]


def test_m4_keeps_the_extremes(spark):
    values = [float((i * 37) % 101) for i in range(500)]
    out = reduce.m4(series(spark, a=values, b=[1.0, 2.0]), 40)
    got = out.where("point = 'a'").agg(F.min("value"), F.max("value"), F.count("*")).first()
    assert (got[0], got[1]) == (min(values), max(values)) and got[2] <= 40
    assert out.where("point = 'b'").count() == 2


@pytest.mark.parametrize("values", [[], [1.0], [1.0, 1.0], [None, None], [5.0] * 20, [0.0] * 10 + [9.0] + [0.0] * 10])
def test_detectors_face_edge_series(spark, values):
    s = series(spark, a=values, z=[1.0, 2.0, 3.0])
    for method in ("nsigma", "iqr", "standardized", "morphological", "mean_shift", "residual_runs"):
        assert detect.detect(s, method).where("end_pos < start_pos").count() == 0


def test_opening_below_closing_above(spark):
    s = features.closing(features.opening(series(spark, a=[float((i * 7) % 11) for i in range(40)]), 3), 3)
    assert s.where("opened > value or closed < value").count() == 0


def test_haar_residual_sums_to_zero_on_full_blocks(spark):
    s = features.haar_residual(series(spark, a=[float((i * 7) % 11) for i in range(64)]))
    assert s.groupBy(F.floor(F.col("pos") / 8)).agg(F.abs(F.sum("residual")).alias("r")).where("r > 1e-9").count() == 0


def test_nearest_takes_the_earlier_of_equals(spark):
    left = spark.createDataFrame([("a", T0 + timedelta(seconds=90)), ("a", T0 + timedelta(minutes=9))], "point string, ts timestamp")
    assert rows(core.nearest(left, series(spark, a=[1.0, 2.0, 3.0])), "near") == [(1,), (2,)]
