"""Downsampling that keeps the shape of a series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.core import with_positions


def m4(series: DataFrame, n_out: int) -> DataFrame:
    """First, lowest, highest and last row of each of n_out / 4 equal buckets of positions; short points stay whole.

    Columns: point, ds_pos, orig_pos, ts, value. Buckets are aggregated in parallel, so a giant point is no single task.
    """
    n_out = max(4, n_out // 4 * 4)
    sizes = series.groupBy("point").agg(F.count("*").alias("n"))
    dealt = series.join(sizes, "point")
    bucket = F.when(F.col("n") > n_out, F.floor(F.col("pos") * (n_out // 4) / F.col("n"))).otherwise(F.col("pos"))
    known = F.col("value").isNotNull()
    low = F.min_by("pos", F.when(known, F.struct("value", "pos")))
    high = F.max_by("pos", F.when(known, F.struct("value", (-F.col("pos")).alias("pos"))))
    picks = F.array_distinct(F.array_compact(F.array(F.min("pos"), low, high, F.max("pos"))))
    kept = dealt.groupBy("point", bucket.alias("bucket")).agg(picks.alias("picks")).select("point", F.explode("picks").alias("pos"))
    out = series.join(kept, ["point", "pos"]).withColumnRenamed("pos", "orig_pos")
    return with_positions(out, "orig_pos").select("point", F.col("pos").alias("ds_pos"), "orig_pos", "ts", "value")


def every_kth(series: DataFrame, step: int) -> DataFrame:
    return series.where(F.col("pos") % step == 0)


def lttb(series: DataFrame, n_out: int, preselect: int = 4) -> DataFrame:
    """Largest-triangle selection of n_out rows from at most preselect * n_out extremes that m4 keeps of a point."""
    small = m4(series, preselect * n_out).select("point", "orig_pos", "ts", "value")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("orig_pos").dropna(subset=["value"])
        n = len(pdf)
        if n <= n_out or n_out < 3:
            return pdf
        x, y = pdf["orig_pos"].to_numpy(float), pdf["value"].to_numpy(float)
        edges = np.linspace(1, n - 1, n_out - 1).astype(int)
        keep = [0]
        for k in range(n_out - 2):
            a, b = edges[k], max(edges[k + 1], edges[k] + 1)
            c = slice(b, edges[k + 2] if k + 2 < len(edges) else n)
            cx, cy = (x[c].mean(), y[c].mean()) if len(x[c]) else (x[-1], y[-1])
            area = np.abs((x[keep[-1]] - cx) * (y[a:b] - y[keep[-1]]) - (x[keep[-1]] - x[a:b]) * (cy - y[keep[-1]]))
            keep.append(a + int(area.argmax()))
        return pdf.iloc[[*keep, n - 1]]

    return small.groupBy("point").applyInPandas(pick, small.schema)


def mask_to_raw(series: DataFrame, sampled: DataFrame, mask: str = "mask") -> DataFrame:
    """A mask on sampled rows, by orig_pos, on all rows; the others are 0."""
    got = sampled.select("point", F.col("orig_pos").alias("pos"), mask)
    return series.join(got, ["point", "pos"], "left").withColumn(mask, F.coalesce(mask, F.lit(0)))
