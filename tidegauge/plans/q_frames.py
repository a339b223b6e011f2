"""Queries of long frames over giant points with unknown values, and of smoothing up to the ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import detect as dt
from tidegauge.operators import features as ft
from tidegauge.operators import residual as rs
from tidegauge.operators.smoothing import smooth
from tidegauge.plans import fixtures as fx
from tidegauge.plans.q_features import rounded
from tidegauge.plans.registry import query

SCALES = ((100, 3), (3000, 100), (100_000, 2000))
GAPPY = fx.QUANTITY + """, gappy AS (SELECT point, pos, ts, CASE WHEN pos % 97 >= 3 THEN value END AS value FROM quantity)"""


def gappy_series(spark, d):
    """The quantities of return flags with unknown values."""
    return fx.quantity_series(spark, d).select("point", "pos", "ts", F.when(F.col("pos") % 97 >= 3, F.col("value")).alias("value"))


def _drift_sql(i: int, left: int, right: int) -> str:
    return f"""d{i} AS (SELECT point, pos, coalesce(CASE WHEN pos >= {left} AND count(*) OVER a = {right} THEN abs(avg(value) OVER a - avg(value) OVER b) END, 0) AS v FROM gappy
      WINDOW a AS (PARTITION BY point ORDER BY pos ROWS BETWEEN CURRENT ROW AND {right - 1} FOLLOWING), b AS (PARTITION BY point ORDER BY pos ROWS BETWEEN {left} PRECEDING AND 1 PRECEDING))"""


_DRIFTS = ", ".join(_drift_sql(i, *s) for i, s in enumerate(SCALES))


@query(f"WITH {GAPPY}, {_DRIFTS} SELECT d0.point, d0.pos, round(d0.v, 6) AS drift_0, round(d1.v, 6) AS drift_1, round(d2.v, 6) AS drift_2 FROM d0 JOIN d1 ON d1.point = d0.point AND d1.pos = d0.pos JOIN d2 ON d2.point = d0.point AND d2.pos = d0.pos")
def w9_surveyed_scales(spark, d):
    return rounded(ft.drifts(gappy_series(spark, d), SCALES).select("point", "pos", "drift_0", "drift_1", "drift_2"), 6, "drift_0", "drift_1", "drift_2")


_FAR = " UNION ".join(f"SELECT point, pos FROM (SELECT *, avg(nullif(v, 0)) OVER (PARTITION BY point) AS m, stddev_pop(nullif(v, 0)) OVER (PARTITION BY point) AS s FROM d{i}) WHERE abs(v - m) > 2.5 * s" for i in range(3))


@query(f"WITH {GAPPY}, {_DRIFTS} {_FAR}")
def c6_surveyed_scales(spark, d):
    return dt.hits_drift(gappy_series(spark, d), SCALES, 2.5)


@query(f"""WITH {GAPPY}, r AS (SELECT point, pos, CASE WHEN count(*) OVER w = 600 THEN avg(value) OVER w END AS m, CASE WHEN count(*) OVER w = 600 THEN stddev_samp(value) OVER w END AS s FROM gappy
    WINDOW w AS (PARTITION BY point ORDER BY pos ROWS BETWEEN 300 PRECEDING AND 299 FOLLOWING))
  SELECT point, pos, round(coalesce(first_value(m IGNORE NULLS) OVER a, last_value(m IGNORE NULLS) OVER b), 5) AS roll_mean, round(coalesce(first_value(s IGNORE NULLS) OVER a, last_value(s IGNORE NULLS) OVER b), 5) AS roll_std FROM r
  WINDOW a AS (PARTITION BY point ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), b AS (PARTITION BY point ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w10_surveyed_width(spark, d):
    return rounded(ft.centred_rolling(gappy_series(spark, d), 600).select("point", "pos", "roll_mean", "roll_std"), 5, "roll_mean", "roll_std")


def _smooth_sql(source: str, half: int, order: int) -> str:
    """Local fits by their normal equations over centred offsets, the frame moved inwards at the ends."""
    s = {k: sum(j**k for j in range(-half, half + 1)) for k in (0, 2, 4, 6)}
    even = f"(t0 * {float(s[4])!r} - t2 * {float(s[2])!r}) / {float(s[0] * s[4] - s[2] ** 2)!r} + ({float(s[0])!r} * t2 - {float(s[2])!r} * t0) / {float(s[0] * s[4] - s[2] ** 2)!r} * o * o"
    odd = f"(t1 * {float(s[6])!r} - t3 * {float(s[4])!r}) / {float(s[2] * s[6] - s[4] ** 2)!r} * o + ({float(s[2])!r} * t3 - {float(s[4])!r} * t1) / {float(s[2] * s[6] - s[4] ** 2)!r} * o * o * o"
    fit = f"{even} + {odd}" if order == 3 else f"t0 / {float(s[0])!r} + t1 / {float(s[2])!r} * o"
    return f"""nn AS (SELECT point, count(*) AS n FROM {source} GROUP BY 1), ce AS (SELECT point, pos, least(greatest(pos, {half}), n - 1 - {half}) AS c FROM {source} JOIN nn USING (point)),
  uc AS (SELECT DISTINCT point, c FROM ce), mo AS (SELECT uc.point, c, count(value) AS k, sum(value) AS t0, sum(value * (s.pos - c)) AS t1, sum(value * (s.pos - c) * (s.pos - c)) AS t2, sum(value * (s.pos - c) * (s.pos - c) * (s.pos - c)) AS t3
    FROM uc JOIN {source} s ON s.point = uc.point AND s.pos BETWEEN c - {half} AND c + {half} GROUP BY 1, 2),
  fi AS (SELECT ce.point, ce.pos, CASE WHEN k = {2 * half + 1} THEN (SELECT {fit} FROM (SELECT CAST(ce.pos - ce.c AS DOUBLE) AS o)) END AS smooth FROM ce JOIN mo ON mo.point = ce.point AND mo.c = ce.c)"""


# a value that is not known leaves every frame that holds it without a fit
_UNKNOWN = fx.SERIES + ", known AS (SELECT point, pos, CASE WHEN pos % 131 <> 77 THEN value END AS value FROM series)"


@query(f"WITH {_UNKNOWN}, {_smooth_sql('known', 30, 1)} SELECT point, pos, round(smooth, 5) AS smooth FROM fi")
def w12_line_with_ends(spark, d):
    s = fx.event_series(spark, d).withColumn("value", F.when(F.col("pos") % 131 != 77, F.col("value")))
    return rounded(smooth(s, 61, 1).select("point", "pos", "smooth"), 5, "smooth")


@query(f"WITH {fx.HOURLY}, {_smooth_sql('hourly', 30, 3)} SELECT point, pos, round(smooth, 4) AS smooth FROM fi")
def w12_cubic_with_ends(spark, d):
    return rounded(smooth(fx.hourly_series(spark, d), 61, 3).select("point", "pos", "smooth"), 4, "smooth")


_SPACES = """raw AS (SELECT CAST(user_id AS VARCHAR) AS point, user_id AS u, count(*) AS n_raw FROM events GROUP BY ALL)"""


@query(f"""WITH {fx.USERS}, {_SPACES}, k AS (SELECT point, n_raw, CASE u % 5 WHEN 0 THEN n_raw WHEN 4 THEN 0 ELSE (n_raw + 1) // 2 END AS n_mask, u % 5 AS kind FROM raw WHERE n_raw >= 3)
  SELECT point, CASE WHEN kind = 4 THEN 'empty' WHEN n_mask = n_raw THEN 'raw' WHEN kind = 1 THEN 'raw_mapped' ELSE 'downsample' END AS index_space,
    CASE WHEN kind = 4 THEN 0 WHEN kind = 0 THEN n_raw WHEN kind = 1 THEN 2 * (n_mask - 1) + 1 WHEN kind = 2 THEN 0 ELSE n_mask END AS n_marked FROM k""")
def c23_index_space(spark, d):
    """Masks of every kind for each user: whole, sampled with and without positions, sampled without a hit, and empty."""
    s = fx.user_series(spark, d)
    n = s.groupBy("point").agg(F.count("*").alias("n")).where("n >= 3")
    kind = F.col("point").cast("long") % 5
    every = s.join(n, "point").withColumn("kind", kind)
    whole = every.where("kind = 0").select("point", "pos", F.col("pos").cast("long").alias("orig_pos"), F.lit(1).alias("mask"))
    half = every.where("kind in (1, 2, 3) and pos % 2 = 0").select("point", (F.col("pos") / 2).cast("long").alias("pos"), F.when(F.col("kind") != 3, F.col("pos")).alias("orig_pos"), F.when(F.col("kind") == 2, 0).otherwise(1).alias("mask"))
    masks = whole.unionByName(half)
    marked = rs.resolved_masks(every.select("point", "pos", "ts", "value"), masks)
    return marked.groupBy("point", "index_space").agg(F.coalesce(F.sum("mask"), F.lit(0)).cast("long").alias("n_marked"))
