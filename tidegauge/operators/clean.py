"""Continuity, gap filling and dead values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.core import all_rows, by_point, dealt, islands, mask_intervals, micros, next_known, with_positions


def deltas(series: DataFrame) -> DataFrame:
    """Seconds since the row before."""
    w = by_point("ts")
    return series.withColumn("delta", (micros("ts") - micros(F.lag("ts").over(w))) / 1e6)


def sampling_interval(series: DataFrame) -> DataFrame:
    """(point, step): the most frequent delta in seconds, the smallest of equals."""
    counted = deltas(series).where("delta is not null").groupBy("point", "delta").agg(F.count("*").alias("n"))
    return counted.groupBy("point").agg(F.min_by("delta", F.struct(-F.col("n"), "delta")).alias("step"))


def grid(series: DataFrame, steps: DataFrame) -> DataFrame:
    """(point, ts): all stamps from the first to the last row of a point, one a step."""
    ends = series.groupBy("point").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).join(steps.where("step > 0"), "point")
    return ends.select("point", F.explode(F.expr("sequence(a, b, make_dt_interval(0, 0, 0, step))")).alias("ts"))


def continuity(series: DataFrame) -> DataFrame:
    """Rows, inferred step, missing stamps and their share of the rows."""
    steps = sampling_interval(series)
    missing = grid(series, steps).join(series.select("point", "ts"), ["point", "ts"], "left_anti").groupBy("point").agg(F.count("*").alias("n_missing"))
    totals = series.groupBy("point").agg(F.count("*").alias("n_rows"))
    out = totals.join(steps, "point", "left").join(missing, "point", "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))
    return out.withColumn("missing_ratio", F.col("n_missing") / F.col("n_rows"))


def sampling_rate(series: DataFrame, first: int = 1000) -> DataFrame:
    """1 over the median delta of the first rows; 0 when that is not positive."""
    med = deltas(series.where(F.col("pos") < first)).groupBy("point").agg(F.percentile("delta", F.lit(0.5)).alias("m"))
    return med.select("point", F.when(F.col("m") > 0, 1 / F.col("m")).otherwise(0.0).alias("rate"))


def missing_slots(series: DataFrame, st: str, et: str, seconds: int) -> DataFrame:
    """Every stamp of a given range with a flag whether the point lacks rows in its slot."""
    kind = series.schema["ts"].dataType
    first, last = F.lit(st).cast(kind), F.lit(et).cast(kind)
    step = F.expr(f"make_dt_interval(0, 0, 0, {seconds})")
    slots = series.select("point").distinct().select("point", F.explode(F.sequence(first, last, step)).alias("ts"))
    offset = F.floor((micros("ts") - micros(first)) / (seconds * 1_000_000)) * (seconds * 1_000_000)
    slot = F.timestamp_micros(micros(first) + offset).cast(kind)
    seen = series.where(F.col("ts").between(first, last)).select("point", slot.alias("ts")).distinct().withColumn("_seen", F.lit(1))
    return slots.join(seen, ["point", "ts"], "left").select("point", "ts", F.col("_seen").isNull().cast("int").alias("missing"))


def gap_report(series: DataFrame, st: str, et: str, seconds: int) -> DataFrame:
    """Intervals of missing slots of each point."""
    return mask_intervals(with_positions(missing_slots(series, st, et, seconds)), "missing")


def filled(series: DataFrame, steps: DataFrame, value: str = "value") -> DataFrame:
    """The full grid of each point with the next value, or the last where none follows."""
    known = series.select("point", "ts", value)
    stamps = grid(series, steps).join(known.select("point", "ts"), ["point", "ts"], "left_anti").select("point", "ts", F.lit(None).cast("double").alias(value))
    both = known.union(stamps)
    return both.select("point", "ts", next_known(F.when(~F.isnan(value), F.col(value)), "ts").alias(value))


def dead_values(series: DataFrame, seconds: float, distinct: int, only_zero: bool = False) -> DataFrame:
    """series with `dead`: 1 in runs of one value (zero, if asked) that last over `seconds`, in points of at least
    `distinct` values."""
    marked = islands(series, "value")
    spans = marked.groupBy("point", "grp").agg(((micros(F.max("ts")) - micros(F.min("ts"))) / 1e6 > seconds).alias("_long"))
    marked = dealt(marked, series.count(), "point", "grp").join(spans.where("_long"), ["point", "grp"], "left")
    long = F.coalesce("_long", F.lit(False))
    kinds = series.groupBy("point").agg(F.count_distinct("value").alias("_kinds"))
    is_dead = long & (F.col("_kinds") >= distinct) & F.col("value").isNotNull()
    if only_zero:
        is_dead &= F.col("value") == 0
    return marked.join(kinds, "point").withColumn("dead", F.coalesce(is_dead.cast("int"), F.lit(0))).select(*series.columns, "dead")


def constant_share(series: DataFrame, longer: int = 5) -> DataFrame:
    """Runs of more than `longer` equal values and their share of the rows, to three places."""
    runs = islands(series, "value").groupBy("point", "grp").agg(F.count("*").alias("n"))
    counted = F.when(F.col("n") > longer, F.col("n"))
    return runs.groupBy("point").agg(F.count(counted).alias("n_runs"), F.round(F.coalesce(F.sum(counted), F.lit(0)) / F.sum("n"), 3).alias("constant_ratio"))


def point_totals(series: DataFrame) -> DataFrame:
    return series.withColumn("n", F.count("*").over(all_rows()))
