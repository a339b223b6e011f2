"""Queries of distribution, rolling and shape features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import features as ft
from tidegauge.operators.core import bridged, islands
from tidegauge.plans import fixtures as fx
from tidegauge.plans.registry import query


def rounded(df, places: int, *names: str):
    """The whole number nearest to the shifted value, as the twins round; F.round goes by the digits that a double prints."""

    def nearest(name):
        shifted = F.col(name) * 10.0**places
        return F.when(F.abs(shifted) < float("inf"), F.round(shifted) / 10.0**places).otherwise(F.col(name))

    return df.withColumns({n: nearest(n) for n in names})


@query(f"""WITH {fx.SERIES}, e AS (SELECT point, min(value) AS a, max(value) AS b FROM series GROUP BY 1)
  SELECT point, pos, round(CASE WHEN a = b THEN value ELSE (value - a) / (b - a) END, 6) AS scaled FROM series JOIN e USING (point)""")
def p8_min_max_scaling(spark, d):
    return rounded(ft.scaled(fx.event_series(spark, d)).select("point", "pos", "scaled"), 6, "scaled")


@query(f"""WITH {fx.SERIES}, e AS (SELECT point, avg(value) AS m, stddev_pop(value) AS s FROM series GROUP BY 1)
  SELECT point, pos, round(CASE WHEN abs(value - m) > 3 * s THEN m ELSE value END, 6) AS clipped FROM series JOIN e USING (point)""")
def p9_clip_3_sigma(spark, d):
    return rounded(ft.clipped_to_mean(fx.event_series(spark, d)).select("point", "pos", "clipped"), 6, "clipped")


@query(f"""WITH {fx.SERIES}, e AS (SELECT point, regr_slope(value, pos) AS a, regr_intercept(value, pos) AS b FROM series GROUP BY 1)
  SELECT point, pos, round(value - (b + a * pos), 5) AS detrended FROM series JOIN e USING (point)""")
def p10_detrend(spark, d):
    return rounded(ft.detrended(fx.event_series(spark, d)).select("point", "pos", "detrended"), 5, "detrended")


def _hist(source: str, bins: int) -> str:
    return f"""e AS (SELECT point, min(value) AS low, (max(value) - min(value)) / {bins} AS width, count(value) AS total FROM {source} GROUP BY 1),
  b AS (SELECT s.point, CAST(CASE WHEN width > 0 THEN least(floor((value - low) / width), {bins - 1}) ELSE 0 END AS BIGINT) AS bin, count(*) AS n FROM {source} s JOIN e USING (point) GROUP BY 1, 2),
  h AS (SELECT e.point, r.i AS bin, low, width, total, coalesce(b.n, 0) AS n FROM e CROSS JOIN range(0, {bins}) r(i) LEFT JOIN b ON b.point = e.point AND b.bin = r.i)"""


@query(f"""WITH {fx.SERIES}, {_hist('series', 50)} SELECT point, bin, round(low, 6) AS low, round(width, 9) AS width, total, n FROM h""")
def a5_histogram(spark, d):
    h = ft.histogram(fx.event_series(spark, d), 50)
    return h.select("point", "bin", F.round("low", 6).alias("low"), F.round("width", 9).alias("width"), "total", "n")


def step_shape_sql(source: str, bins: int, share: float) -> str:
    return f"""{_hist(source, bins)}, m AS (SELECT *, max(n) OVER (PARTITION BY point) AS most, row_number() OVER (PARTITION BY point ORDER BY n DESC, bin) AS k FROM h),
  p AS (SELECT a.point, bool_and(EXISTS (SELECT 1 FROM m c WHERE c.point = a.point AND c.bin > a.bin AND c.bin < b.bin AND c.n < 0.01 * c.most)) AS apart
        FROM m a JOIN m b ON a.point = b.point AND a.bin < b.bin AND a.k <= 5 AND b.k <= 5 AND a.n >= 0.01 * a.most AND b.n >= 0.01 * b.most GROUP BY 1),
  f AS (SELECT point, count(*) FILTER (WHERE n >= 0.01 * most) <= {share} * {bins} AS sparse FROM m GROUP BY 1),
  shape AS (SELECT f.point, sparse AND coalesce(apart, true) AS is_step_shape FROM f LEFT JOIN p ON f.point = p.point)"""


_STEP_SHAPE = step_shape_sql("quantity", 100, 0.6)


@query(f"WITH {fx.QUANTITY}, {_STEP_SHAPE} SELECT point, is_step_shape FROM shape")
def a6_step_distribution(spark, d):
    return ft.step_shape(fx.quantity_series(spark, d), th=0.6, bins=100)


def step_signal_sql(source: str, bins: int, share: float) -> str:
    return f"""{step_shape_sql(source, bins, share)}, c AS (SELECT *, CASE WHEN pos = 0 OR value IS DISTINCT FROM lag(value) OVER w THEN 1 ELSE 0 END AS nn FROM {source} WINDOW w AS (PARTITION BY point ORDER BY pos)),
  g AS (SELECT point, sum(nn) OVER (PARTITION BY point ORDER BY pos) AS grp FROM c), r AS (SELECT point, grp, count(*) AS n FROM g GROUP BY 1, 2),
  k AS (SELECT point, round(coalesce(sum(n) FILTER (WHERE n > 5), 0) / sum(n), 3) AS constant_ratio FROM r GROUP BY 1)
  SELECT point, constant_ratio, is_step_shape, constant_ratio > 0.8 AND is_step_shape AS is_step FROM k JOIN shape USING (point)"""


@query(f"WITH {fx.QUANTITY}, {step_signal_sql('quantity', 100, 0.6)}")
def a7_step_signal(spark, d):
    return ft.step_signal(fx.quantity_series(spark, d), th=0.6, bins=100)


_ISLANDS = """cc AS (SELECT *, CASE WHEN pos = 0 OR mask IS DISTINCT FROM lag(mask) OVER w THEN 1 ELSE 0 END AS nn FROM masked WINDOW w AS (PARTITION BY point ORDER BY pos)),
  isl AS (SELECT point, pos, value, mask, CAST(sum(nn) OVER (PARTITION BY point ORDER BY pos) AS BIGINT) AS grp FROM cc)"""


@query(f"""WITH {fx.MASKED}, {_ISLANDS}, q AS (SELECT point, grp, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM isl GROUP BY 1, 2)
  SELECT q.point, q.grp, round(avg(value), 6) AS trimmed_mean, round(quantile_cont(value, 0.5), 6) AS trimmed_median FROM q LEFT JOIN isl i ON i.point = q.point AND i.grp = q.grp AND value > a AND value < b GROUP BY 1, 2""")
def a8_trimmed_means(spark, d):
    return rounded(ft.trimmed(islands(fx.masked_series(spark, d), "mask"), "point", "grp"), 6, "trimmed_mean", "trimmed_median")


@query(f"""WITH {fx.SERIES}, g AS (SELECT point, pos, value, pos // 300 AS grp FROM series), n AS (SELECT *, greatest(2, CAST(floor(count(*) OVER (PARTITION BY point, grp) * 0.05) AS BIGINT)) AS w, row_number() OVER (PARTITION BY point, grp ORDER BY pos) AS i FROM g),
  v AS (SELECT a.point, a.grp, a.i, var_samp(b.value) AS v FROM n a JOIN n b ON a.point = b.point AND a.grp = b.grp AND b.i BETWEEN a.i - a.w + 1 AND a.i WHERE a.i >= a.w GROUP BY 1, 2, 3)
  SELECT point, grp, round(quantile_cont(v, 0.5), 4) AS median_variance FROM v GROUP BY 1, 2""")
def a9_group_median_variance(spark, d):
    g = fx.event_series(spark, d).withColumn("grp", F.floor(F.col("pos") / 300))
    return rounded(ft.group_median_variance(g, "grp"), 4, "median_variance")


_MARKED = """mk AS (SELECT s.point, g.seg_id, s.pos, s.value FROM series s JOIN segments g ON s.point = g.point AND s.pos BETWEEN g.start_pos AND g.end_pos)"""
FEATURES = f"""{_MARKED}, st AS (SELECT *, value - lag(value) OVER (PARTITION BY point, seg_id ORDER BY pos) AS step FROM mk),
  gl AS (SELECT point, avg(value) AS gm, max(value) - min(value) AS gr, stddev_pop(value) AS gs, count(*) AS gn FROM series GROUP BY 1),
  ow AS (SELECT point, seg_id, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, max(value) - min(value) AS rg, avg(step) AS dm, stddev_pop(step) AS ds FROM st GROUP BY 1, 2),
  ftr AS (SELECT point, seg_id, n, mean, std, dm, ds, mean / gm AS mean_ratio, rg / gr AS range_ratio, std / gs AS std_ratio, std / mean AS cv, CAST(n AS DOUBLE) / gn AS length_ratio FROM ow JOIN gl USING (point))"""


def marked_segments(spark, d):
    from tidegauge.operators.core import expanded

    s, g = fx.event_series(spark, d), fx.segment_table(spark, d)
    return s.join(expanded(g, "seg_id"), ["point", "pos"]).select("point", "seg_id", "pos", "value")


@query(f"""WITH {fx.SEGMENTS}, {FEATURES} SELECT point, seg_id, n, round(mean, 6) AS mean, round(std, 6) AS std, round(dm, 6) AS diff_mean, round(ds, 6) AS diff_std, round(mean_ratio, 6) AS mean_ratio,
  round(range_ratio, 6) AS range_ratio, round(std_ratio, 6) AS std_ratio, round(cv, 6) AS cv, round(length_ratio, 6) AS length_ratio FROM ftr""")
def a10_segment_features(spark, d):
    f = ft.segment_features(fx.event_series(spark, d), marked_segments(spark, d)).drop("skew", "kurt")
    return rounded(f, 6, *[c for c in f.columns if c not in ("point", "seg_id", "n")])


@query(f"""WITH {fx.SEGMENTS}, {FEATURES} SELECT point, CASE WHEN range_ratio >= 0.5 THEN 'global' ELSE 'local' END AS cluster, count(*) AS n_segments, round(avg(mean_ratio), 5) AS mean_ratio, round(max(range_ratio), 6) AS range_ratio FROM ftr GROUP BY 1, 2""")
def c36_cluster_features(spark, d):
    f = ft.segment_features(fx.event_series(spark, d), marked_segments(spark, d))
    c = F.when(F.col("range_ratio") >= 0.5, "global").otherwise("local").alias("cluster")
    return f.groupBy("point", c).agg(F.count("*").alias("n_segments"), F.round(F.avg("mean_ratio"), 5).alias("mean_ratio"), F.round(F.max("range_ratio"), 6).alias("range_ratio"))


@query(f"""WITH {fx.SERIES} SELECT point, pos, round(CASE WHEN pos >= 20 AND count(*) OVER a = 3 THEN abs(avg(value) OVER a - avg(value) OVER b) ELSE 0 END, 6) AS drift FROM series
  WINDOW a AS (PARTITION BY point ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), b AS (PARTITION BY point ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def w9_double_rolling(spark, d):
    return rounded(ft.double_rolling(fx.event_series(spark, d), 20, 3).select("point", "pos", "drift"), 6, "drift")


@query(f"""WITH {fx.SERIES}, r AS (SELECT point, pos, CASE WHEN count(*) OVER w = 60 THEN avg(value) OVER w END AS m, CASE WHEN count(*) OVER w = 60 THEN stddev_samp(value) OVER w END AS s FROM series
    WINDOW w AS (PARTITION BY point ORDER BY pos ROWS BETWEEN 30 PRECEDING AND 29 FOLLOWING))
  SELECT point, pos, round(coalesce(first_value(m IGNORE NULLS) OVER a, last_value(m IGNORE NULLS) OVER b), 5) AS roll_mean, round(coalesce(first_value(s IGNORE NULLS) OVER a, last_value(s IGNORE NULLS) OVER b), 5) AS roll_std FROM r
  WINDOW a AS (PARTITION BY point ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), b AS (PARTITION BY point ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w10_centred_rolling(spark, d):
    return rounded(ft.centred_rolling(fx.event_series(spark, d), 60).select("point", "pos", "roll_mean", "roll_std"), 5, "roll_mean", "roll_std")


_W = "PARTITION BY point ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING"
_W5 = "PARTITION BY point ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING"


@query(f"WITH {fx.SERIES} SELECT point, pos, max(value) OVER w AS dilated, min(value) OVER w AS eroded, round(max(value) OVER w - min(value) OVER w, 6) AS gradient FROM series WINDOW w AS ({_W})")
def w11_morphological_gradient(spark, d):
    return rounded(ft.gradient(fx.event_series(spark, d), 4).select("point", "pos", "dilated", "eroded", "gradient"), 6, "gradient")


@query(f"WITH {fx.SERIES}, a AS (SELECT *, min(value) OVER w AS e, max(value) OVER w AS g FROM series WINDOW w AS ({_W5})) SELECT point, pos, max(e) OVER w AS opened, min(g) OVER w AS closed FROM a WINDOW w AS ({_W5})")
def w11_opening_closing(spark, d):
    s = fx.event_series(spark, d)
    return ft.closing(ft.opening(s, 5), 5).select("point", "pos", "opened", "closed")


@query(f"""WITH {fx.SERIES} SELECT point, pos, round(CASE WHEN count(*) OVER w = 61 THEN avg(value) OVER w END, 5) AS smooth FROM series WINDOW w AS (PARTITION BY point ORDER BY pos ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING)""")
def w12_moving_average(spark, d):
    return rounded(ft.moving_average(fx.event_series(spark, d), 61).select("point", "pos", "smooth"), 5, "smooth")


@query(f"""WITH {fx.SERIES}, m AS (SELECT a.point, a.pos, count(*) AS n, sum(b.value * (3.0 * (3 * 900 + 3 * 30 - 1) - 15.0 * (b.pos - a.pos) * (b.pos - a.pos))) / ((2 * 30 + 3) * (2 * 30 + 1) * (2 * 30 - 1)) AS s
    FROM series a JOIN series b ON a.point = b.point AND b.pos BETWEEN a.pos - 30 AND a.pos + 30 GROUP BY 1, 2) SELECT point, pos, round(CASE WHEN n = 61 THEN s END, 3) AS smooth FROM m""")
def w12_cubic_smooth(spark, d):
    return rounded(ft.cubic_smooth(fx.event_series(spark, d), 61).select("point", "pos", "smooth"), 3, "smooth")


@query(f"""WITH {fx.SERIES}, n AS (SELECT point, count(*) AS n FROM series GROUP BY 1), k AS (SELECT j, exp(-0.5 * (j / 3.0) * (j / 3.0)) AS w FROM range(-12, 13) r(j)), t AS (SELECT sum(w) AS t FROM k),
  x AS (SELECT s.point, s.pos, w / t AS w, CASE WHEN s.pos + j < 0 THEN -(s.pos + j) - 1 WHEN s.pos + j >= n THEN 2 * n - 1 - (s.pos + j) ELSE s.pos + j END AS at FROM series s JOIN n USING (point) CROSS JOIN k CROSS JOIN t)
  SELECT x.point, x.pos, round(sum(w * value), 5) AS smooth FROM x JOIN series s ON s.point = x.point AND s.pos = x.at GROUP BY 1, 2""")
def w13_gaussian(spark, d):
    return rounded(ft.gaussian(fx.event_series(spark, d)).select("point", "pos", "smooth"), 5, "smooth")


@query(f"""WITH {fx.SERIES}, a AS (SELECT point, pos, value, avg(value) OVER (PARTITION BY point, pos // 2) AS m FROM series),
  b2 AS (SELECT point, pos // 2 AS k, any_value(m) AS m FROM a GROUP BY 1, 2), b4 AS (SELECT point, k // 2 AS k, avg(m) AS m FROM b2 GROUP BY 1, 2), b8 AS (SELECT point, k // 2 AS k, avg(m) AS m FROM b4 GROUP BY 1, 2)
  SELECT s.point, s.pos, round(s.value - b8.m, 6) AS residual FROM series s JOIN b8 ON b8.point = s.point AND b8.k = s.pos // 8""")
def w14_haar_residual(spark, d):
    return rounded(ft.haar_residual(fx.event_series(spark, d)).select("point", "pos", "residual"), 6, "residual")


@query()
def w15_wavelet_energy(spark, d):
    return ft.wavelet_energy(fx.event_series(spark, d))


@query()
def c19_noise_classifier(spark, d):
    return ft.noisy(fx.event_series(spark, d))


@query(f"""WITH {fx.HOURLY}, t AS (SELECT point, pos, value, CASE WHEN count(*) OVER w = 25 THEN avg(value) OVER w END AS trend FROM hourly WINDOW w AS (PARTITION BY point ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
  p AS (SELECT point, pos % 24 AS p, avg(value - trend) AS s FROM t GROUP BY 1, 2), l AS (SELECT point, avg(s) AS l FROM p GROUP BY 1)
  SELECT t.point, t.pos, round(trend, 5) AS trend, round(s - l, 5) AS seasonal, round(value - trend - (s - l), 5) AS residual FROM t JOIN p ON p.point = t.point AND p.p = t.pos % 24 JOIN l ON l.point = t.point""")
def c22_seasonal_trend(spark, d):
    t = ft.seasonal_trend(fx.hourly_series(spark, d), 24).select("point", "pos", "trend", "seasonal", "residual")
    return rounded(t, 5, "trend", "seasonal", "residual")
