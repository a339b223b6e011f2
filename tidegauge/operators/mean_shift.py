"""Mean shifts by histograms, as a cascade of three rules.

Each rule names bins of a point's histogram; long runs of rows in them whose mean is off the main peak's centre are
shifts. A point goes on to the next rule only while it has none:

- edge: bins beyond the nearest one on either side of the peak that holds at most a share of the peak's count
- knee: the same with the knee of the sorted logarithms of the counts as the limit
- groups: neighbouring bins over that knee form groups, and all but the heaviest are meant

Histograms have few bins, so the rules run on small tables by point and the rows are read once for each rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.operators import features as ft
from tidegauge.operators.core import expanded, numbered_segments, split_runs
from tidegauge.operators.detect import chord_knee
from tidegauge.sources.scratch import settled

#: Share of the peak's count that the bins of one side may hold before the side counts as ordinary.
HEAVY_SIDE = 0.85


def knee_counts(histogram: DataFrame) -> DataFrame:
    """(point, limit): the count at the knee of the point's sorted log counts."""
    x = F.row_number().over(W.partitionBy("point").orderBy("n", "bin")) - 1
    curve = histogram.select("point", "n", x.alias("x"), F.log1p("n").alias("y"))
    return chord_knee(curve).join(curve, "point").where("x = knee_x").select("point", F.col("n").alias("limit"))


def beyond_borders(histogram: DataFrame, limits: DataFrame, bins: int) -> DataFrame:
    """(point, bin) outside the borders of the main peak. The first bin is no border, nor is the last. Where a side
    outweighs the peak, the peak itself is meant; a side nearly as heavy is ordinary."""
    peak = histogram.groupBy("point").agg(F.max_by(F.struct("bin", "n"), F.struct("n", -F.col("bin"))).alias("p")).select("point", F.col("p.bin").alias("top"), F.col("p.n").alias("most"))
    d = histogram.join(peak, "point").join(limits, "point")
    low, side = F.col("n") <= F.col("limit"), lambda c: F.col("bin") < F.col("top") if c == "l" else F.col("bin") > F.col("top")
    borders = d.groupBy("point", "top", "most").agg(F.max(F.when(low & side("l") & (F.col("bin") > 0), F.col("bin"))).alias("l"), F.nullif(F.min(F.when(low & side("r"), F.col("bin"))), F.lit(bins - 1)).alias("r"))
    d = histogram.join(borders, "point")
    out = {"l": F.coalesce(F.col("bin") <= F.col("l"), F.lit(False)), "r": F.coalesce(F.col("bin") >= F.col("r"), F.lit(False))}
    held = d.groupBy("point").agg(*[F.sum(F.when(out[c], F.col("n")).otherwise(0)).alias(f"sum_{c}") for c in "lr"])
    share = lambda c: F.col(f"sum_{c}") / F.col("most")
    meant = F.when((share("l") > 1) | (share("r") > 1), F.col("bin") == F.col("top")).when(share("l") > HEAVY_SIDE, out["r"]).when(share("r") > HEAVY_SIDE, out["l"]).otherwise(out["l"] | out["r"])
    return d.join(held, "point").where(meant).select("point", "bin")


def lighter_groups(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """(point, bin) of the groups of neighbouring bins over the limit, but the heaviest (the first of equals)."""
    over = histogram.join(limits, "point").where(F.col("n") > F.col("limit"))
    group = F.col("bin") - F.row_number().over(W.partitionBy("point").orderBy("bin"))
    over = over.select("point", "bin", "n", group.alias("group"))
    weights = over.groupBy("point", "group").agg(F.sum("n").alias("w"))
    heaviest = weights.groupBy("point").agg(F.max_by("group", F.struct("w", -F.col("group"))).alias("group"))
    return over.join(heaviest, ["point", "group"], "left_anti").select("point", "bin")


def shifted_runs(series: DataFrame, ends: DataFrame, flagged: DataFrame, bins: int, longer: int, far: float) -> DataFrame:
    """Runs of over `longer` rows in flagged bins with a mean over 1 + far or under 1 - far times the peak's centre."""
    rows = series.where("value is not null").join(ends, "point").withColumn("bin", ft.bin_of(bins)).join(flagged, ["point", "bin"], "left_semi")
    runs = split_runs(rows.select("point", "pos"), min_size=longer + 1)
    means = expanded(runs, "seg_id").join(series, ["point", "pos"]).groupBy("point", "seg_id").agg(F.avg("value").alias("mean")).join(ends, "point")
    off: Column = (F.col("mean") > (1 + far) * F.col("centre")) | (F.col("mean") < (1 - far) * F.col("centre"))
    return runs.join(means.where(off).select("point", "seg_id"), ["point", "seg_id"], "left_semi").select("point", "start_pos", "end_pos", "n_rows")


def mean_shift_cascade(series: DataFrame, bins: int = 20, edge: float = 0.009, longer: int = 500, far: float = 0.2) -> DataFrame:
    """(point, seg_id, start_pos, end_pos, n_rows, rule) of the first rule that finds shifts in a point. Null values are
    in no bin and end a run."""
    h = settled(ft.histogram(series, bins), "histogram")
    top = F.max_by("bin", F.struct("n", -F.col("bin"))).alias("top")
    ends = settled(h.groupBy("point", "low", "width").agg(top, F.max("n").alias("most")).withColumn("centre", F.col("low") + (F.col("top") + 0.5) * F.col("width")), "ends")
    knees = knee_counts(h)
    rules = {
        "edge": beyond_borders(h, ends.select("point", (edge * F.col("most")).alias("limit")), bins),
        "knee": beyond_borders(h, knees, bins),
        "groups": lighter_groups(h, knees),
    }
    found = None
    for rule, flagged in rules.items():
        left = series if found is None else series.join(found.select("point").distinct(), "point", "left_anti")
        new = settled(shifted_runs(left, ends.drop("top", "most"), flagged, bins, longer, far).withColumn("rule", F.lit(rule)), "shifts")
        found = new if found is None else found.union(new)
    return numbered_segments(found).select("point", "seg_id", "start_pos", "end_pos", "n_rows", "rule")
