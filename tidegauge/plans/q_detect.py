"""Queries of the detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import detect as dt
from tidegauge.operators.core import split_runs
from tidegauge.plans import fixtures as fx
from tidegauge.plans.q_clean import _m4_sql
from tidegauge.plans.q_features import _hist, step_signal_sql
from tidegauge.plans.registry import query


def _bridge(hits: str, gap: int = 5, out: str = "start_pos, end_pos") -> str:
    """SQL of bridged segments of a hits table (point, pos)."""
    return f"""bn AS (SELECT point, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY point ORDER BY pos) <= {gap} THEN 0 ELSE 1 END AS new FROM {hits}),
  br AS (SELECT point, pos, sum(new) OVER (PARTITION BY point ORDER BY pos) AS g FROM bn),
  seg AS (SELECT point, CAST(g AS BIGINT) AS seg_id, min(pos) AS start_pos, max(pos) AS end_pos FROM br GROUP BY point, g)"""


_OUT = "SELECT point, seg_id, start_pos, end_pos FROM seg"


@query(f"""WITH {fx.SERIES}, q AS (SELECT point, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM series GROUP BY 1),
  hits AS (SELECT point, pos FROM series JOIN q USING (point) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)), {_bridge('hits')} {_OUT}""")
def c2_iqr(spark, d):
    return dt.iqr(fx.event_series(spark, d)).select("point", "seg_id", "start_pos", "end_pos")


@query(f"""WITH {fx.SERIES}, e AS (SELECT point, regr_slope(value, pos) AS a, regr_intercept(value, pos) AS b FROM series GROUP BY 1), x AS (SELECT point, pos, value - (b + a * pos) AS v FROM series JOIN e USING (point)),
  m AS (SELECT point, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY 1), hits AS (SELECT point, pos FROM x JOIN m USING (point) WHERE abs(v - m) > 2.5 * s), {_bridge('hits')} {_OUT}""")
def c3_standardised(spark, d):
    return dt.detect(fx.event_series(spark, d), "standardized", th=2.5).select("point", "seg_id", "start_pos", "end_pos")


_NZ = "SELECT point, pos, value FROM (SELECT *, avg(CASE WHEN value <> 0 THEN value END) OVER (PARTITION BY point) AS m, stddev_pop(CASE WHEN value <> 0 THEN value END) OVER (PARTITION BY point) AS s FROM {t}) WHERE abs(value - m) > {th} * s"


@query(f"WITH {fx.SERIES} {_NZ.format(t='series', th=4)}")
def c4_nonzero_nsigma(spark, d):
    return dt.hits_nonzero_nsigma(fx.event_series(spark, d), 4.0).select("point", "pos", "value")


_HBOS = f"""{_hist('series', 50)}, sc AS (SELECT s.point, s.pos, s.value, -ln(greatest(1e-6, n / (total * CASE WHEN width > 0 THEN width ELSE 1 END))) AS score FROM series s JOIN h ON h.point = s.point
    AND h.bin = CAST(CASE WHEN width > 0 THEN least(floor((value - low) / width), 49) ELSE 0 END AS BIGINT)),
  nx AS (SELECT *, lead(score) OVER (PARTITION BY point ORDER BY pos) AS nxt FROM sc), th AS (SELECT point, arg_max(nxt, (nxt - score, -pos)) AS th FROM nx WHERE nxt > score GROUP BY 1),
  hb AS (SELECT sc.point, pos, value, score FROM sc JOIN th USING (point) WHERE score > th)"""


@query(f"WITH {fx.SERIES}, {_HBOS} SELECT point, pos, round(score, 6) AS score FROM hb")
def c5_hbos(spark, d):
    return dt.hits_hbos(fx.event_series(spark, d)).select("point", "pos", F.round("score", 6).alias("score"))


def _drift(source: str, scales) -> str:
    parts = [
        f"""d{i} AS (SELECT point, pos, CASE WHEN pos >= {left} AND count(*) OVER a = {right} THEN abs(avg(value) OVER a - avg(value) OVER b) ELSE 0 END AS value FROM {source}
      WINDOW a AS (PARTITION BY point ORDER BY pos ROWS BETWEEN CURRENT ROW AND {right - 1} FOLLOWING), b AS (PARTITION BY point ORDER BY pos ROWS BETWEEN {left} PRECEDING AND 1 PRECEDING))"""
        for i, (left, right) in enumerate(scales)
    ]
    union = " UNION ".join(f"SELECT point, pos FROM ({_NZ.format(t=f'd{i}', th='{th}')})" for i in range(len(scales)))
    return ", ".join(parts) + f", dr AS ({union})"


_SCALES = ((20, 3), (100, 10), (500, 50))


@query(f"WITH {fx.SERIES}, {_drift('series', _SCALES).format(th=3.0)} SELECT point, pos FROM dr")
def c6_multi_scale_drift(spark, d):
    return dt.hits_drift(fx.event_series(spark, d), _SCALES, 3.0)


@query(f"""WITH {fx.SERIES}, {_HBOS}, {_drift('series', _SCALES).format(th=3.0)} SELECT point, pos FROM hb UNION SELECT point, pos FROM dr""")
def u1_union_of_hits(spark, d):
    s = fx.event_series(spark, d)
    return dt.hits_hbos(s).select("point", "pos").union(dt.hits_drift(s, _SCALES, 3.0)).distinct()


_CHUNKS = """n AS (SELECT point, count(*) AS n, max(value) - min(value) AS g FROM series GROUP BY 1),
  ch AS (SELECT point, CAST(floor(pos * 100 / n) AS BIGINT) AS chunk, (max(value) - min(value)) / any_value(g) AS y FROM series JOIN n USING (point) GROUP BY 1, 2),
  cv AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY y, chunk) AS x FROM ch)"""


@query(f"WITH {fx.SERIES}, {_CHUNKS} SELECT point, chunk, x, round(y, 6) AS y FROM cv")
def w17_chunk_ranges(spark, d):
    return dt.chunk_ranges(fx.event_series(spark, d), 100).select("point", "chunk", "x", F.round("y", 6).alias("y"))


_KNEE = f"""{_CHUNKS}, ke AS (SELECT point, arg_min(x, x) AS x0, arg_min(y, x) AS y0, arg_max(x, x) AS x1, arg_max(y, x) AS y1 FROM cv GROUP BY 1),
  kd AS (SELECT point, x, y, round(abs((y1 - y0) * (x - x0) - (x1 - x0) * (y - y0)), 9) AS dist FROM cv JOIN ke USING (point)),
  kn AS (SELECT point, arg_max(x, (dist, -x)) AS knee_x, arg_max(y, (dist, -x)) AS knee_y FROM kd GROUP BY 1)"""


@query(f"WITH {fx.SERIES}, {_KNEE} SELECT point, knee_x, round(knee_y, 6) AS knee_y FROM kn")
def x4_chord_knee(spark, d):
    return dt.chord_knee(dt.chunk_ranges(fx.event_series(spark, d), 100)).select("point", "knee_x", F.round("knee_y", 6).alias("knee_y"))


def _range_filter(runs: str, ratio: str) -> str:
    return f"""nr AS (SELECT point, pos, value, max(value) OVER w - min(value) OVER w AS near, max(value) OVER (PARTITION BY point) - min(value) OVER (PARTITION BY point) AS g FROM series
    WINDOW w AS (PARTITION BY point ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)),
  lc AS (SELECT r.point, r.seg_id, start_pos, end_pos, CASE WHEN count(*) = 1 THEN any_value(near) ELSE max(value) - min(value) END AS loc, any_value(g) AS g FROM {runs} r JOIN nr ON nr.point = r.point AND nr.pos BETWEEN start_pos AND end_pos GROUP BY 1, 2, 3, 4),
  rf AS (SELECT lc.point, seg_id, start_pos, end_pos FROM lc {ratio})"""


def _runs(hits: str, least: int = 1) -> str:
    return f"""rg AS (SELECT point, pos, pos - row_number() OVER (PARTITION BY point ORDER BY pos) AS g FROM {hits}),
  rn AS (SELECT point, row_number() OVER (PARTITION BY point ORDER BY min(pos)) AS seg_id, min(pos) AS start_pos, max(pos) AS end_pos FROM rg GROUP BY point, g HAVING count(*) >= {least})"""


@query(f"WITH {fx.SERIES}, {_HBOS}, {_runs('hb')}, {_range_filter('rn', 'WHERE loc >= 0.5 * g')} SELECT point, seg_id, start_pos, end_pos FROM rf")
def w16_local_range_filter(spark, d):
    s = fx.event_series(spark, d)
    ratios = s.select("point").distinct().withColumn("ratio", F.lit(0.5))
    return dt.range_filter(s, split_runs(dt.hits_hbos(s).select("point", "pos")), ratios).select("point", "seg_id", "start_pos", "end_pos")


@query(f"""WITH {fx.SERIES}, {_HBOS}, {_drift('series', _SCALES).format(th=5.0)}, al AS (SELECT point, pos FROM hb UNION SELECT point, pos FROM dr), {_runs('al')}, {_KNEE},
  {_range_filter('rn', 'JOIN kn ON kn.point = lc.point WHERE loc >= knee_y * lc.g')} SELECT point, seg_id, start_pos, end_pos FROM rf""")
def c7_jump_borders(spark, d):
    return dt.jump_borders(fx.event_series(spark, d), scales=_SCALES, chunks=100).select("point", "seg_id", "start_pos", "end_pos")


@query(f"""WITH {fx.SERIES}, {_hist('series', 20)}, pk AS (SELECT point, arg_max(bin, (n, -bin)) AS top, max(n) AS most FROM h GROUP BY 1),
  sd AS (SELECT h.point, any_value(low) AS low, any_value(width) AS width, any_value(top) AS top, max(bin) FILTER (WHERE n <= 0.3 * most AND bin < top) AS l, min(bin) FILTER (WHERE n <= 0.3 * most AND bin > top) AS r FROM h JOIN pk USING (point) GROUP BY 1),
  en AS (SELECT point, low + (coalesce(l, -1) + 1) * width AS lo, low + coalesce(r, 20) * width AS hi, low + (top + 0.5) * width AS centre FROM sd),
  ou AS (SELECT s.point, pos FROM series s JOIN en USING (point) WHERE value < lo OR value > hi), {_runs('ou', 3)},
  mn AS (SELECT rn.point, seg_id, start_pos, end_pos, avg(value) AS m FROM rn JOIN series s ON s.point = rn.point AND s.pos BETWEEN start_pos AND end_pos GROUP BY 1, 2, 3, 4)
  SELECT mn.point, seg_id, start_pos, end_pos FROM mn JOIN en USING (point) WHERE abs(m - centre) > 0.2 * abs(centre)""")
def c8_mean_shift(spark, d):
    return dt.mean_shift(fx.event_series(spark, d), edge=0.3, min_rows=3).select("point", "seg_id", "start_pos", "end_pos")


@query(f"""WITH {fx.SERIES}, v AS (SELECT point, pos, CAST(value > 120 AS INTEGER) + CAST(value > 150 AS INTEGER) + CAST(pos % 2 = 0 AND value > 90 AS INTEGER) AS votes, ts FROM series),
  k AS (SELECT point, pos, ts FROM v WHERE votes >= 2), g AS (SELECT *, pos - row_number() OVER (PARTITION BY point ORDER BY pos) AS g FROM k)
  SELECT point, row_number() OVER (PARTITION BY point ORDER BY min(pos)) AS seg_id, min(pos) AS start_pos, max(pos) AS end_pos, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows FROM g GROUP BY point, g""")
def c12_vote(spark, d):
    s = fx.event_series(spark, d)
    rules = {"a": F.col("value") > 120, "b": F.col("value") > 150, "c": (F.col("pos") % 2 == 0) & (F.col("value") > 90)}
    masks = None
    for name, rule in rules.items():
        m = s.select(F.lit(name).alias("method"), "point", "pos", "ts", rule.cast("int").alias("mask"))
        masks = m if masks is None else masks.union(m)
    return dt.vote(masks, 2)


@query(f"""WITH {fx.SERIES}, a AS (SELECT point, pos, CAST(value > 120 AS INTEGER) AS m FROM series), b AS (SELECT point, pos, CAST(value > 150 AS INTEGER) AS m FROM series)
  SELECT point, pos, sum(m) AS mask FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2""")
def u2_mask_addition(spark, d):
    s = fx.event_series(spark, d)
    both = s.select("point", "pos", (F.col("value") > 120).cast("int").alias("m")).union(s.select("point", "pos", (F.col("value") > 150).cast("int")))
    return both.groupBy("point", "pos").agg(F.sum("m").alias("mask"))


@query(f"""WITH {fx.MASKED}, cc AS (SELECT *, CASE WHEN pos = 0 OR mask IS DISTINCT FROM lag(mask) OVER w THEN 1 ELSE 0 END AS nn FROM masked WINDOW w AS (PARTITION BY point ORDER BY pos)),
  isl AS (SELECT point, pos, value, mask, CAST(sum(nn) OVER (PARTITION BY point ORDER BY pos) AS BIGINT) AS grp FROM cc),
  q AS (SELECT point, grp, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b, max(mask) AS m, count(*) AS n, avg(value) AS mean FROM isl GROUP BY 1, 2),
  gt AS (SELECT q.point, q.grp, any_value(m) AS m, any_value(n) AS n, any_value(mean) AS mean, avg(i.value) AS tm FROM q LEFT JOIN isl i ON i.point = q.point AND i.grp = q.grp AND i.value > a AND i.value < b GROUP BY 1, 2),
  pl AS (SELECT point, bool_or(tm IS NULL) AS plain, sum(n) AS total FROM gt GROUP BY 1), oq AS (SELECT point, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b, avg(value) AS om FROM series GROUP BY 1),
  ot AS (SELECT oq.point, any_value(om) AS om, avg(s.value) AS otm FROM oq JOIN series s ON s.point = oq.point AND s.value > a AND s.value < b GROUP BY 1),
  df AS (SELECT gt.point, grp, n, total, m = 0 AND abs(CASE WHEN plain THEN mean ELSE tm END - CASE WHEN plain THEN om ELSE otm END) > 0.8 * abs(CASE WHEN plain THEN om ELSE otm END) AS off FROM gt JOIN pl USING (point) JOIN ot USING (point)),
  ad AS (SELECT *, sum(CASE WHEN off THEN n ELSE 0 END) OVER (PARTITION BY point) / total AS added FROM df)
  SELECT i.point, i.pos, CASE WHEN off AND added <= 0.3 THEN 1 ELSE i.mask END AS mask FROM isl i JOIN ad ON ad.point = i.point AND ad.grp = i.grp""")
def c13_deviating_groups(spark, d):
    return dt.deviating_groups(fx.masked_series(spark, d), th=0.8).select("point", "pos", "mask")


@query()
def c16_polynomial_residual(spark, d):
    return dt.iqr(dt.polynomial_residual(fx.event_series(spark, d)).select("point", "pos", "ts", F.col("residual").alias("value")))


@query(f"""WITH {fx.SERIES}, e AS (SELECT point, min(value) AS a, max(value) AS b FROM series GROUP BY 1), s AS (SELECT point, pos, (value - a) / (b - a) AS v FROM series JOIN e USING (point)),
  g AS (SELECT point, pos, max(v) OVER w - min(v) OVER w AS v FROM s WINDOW w AS (PARTITION BY point ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)),
  m AS (SELECT point, avg(v) AS m, stddev_pop(v) AS s FROM g GROUP BY 1), hits AS (SELECT point, pos FROM g JOIN m USING (point) WHERE abs(v - m) > 2 * s), {_bridge('hits')} {_OUT}""")
def c17_morphological(spark, d):
    return dt.morphological(fx.event_series(spark, d), th=2.0).select("point", "seg_id", "start_pos", "end_pos")


@query()
def c18_isolation(spark, d):
    return dt.detect(fx.event_series(spark, d), "iforest", share=0.02)


@query(f"""WITH {fx.SERIES}, c AS (SELECT point, quantile_disc(value, 0.5) AS c, stddev_samp(value) AS sd FROM series GROUP BY 1), a AS (SELECT point, pos, abs(value - c) AS a, sd FROM series JOIN c USING (point)),
  sc AS (SELECT point, CASE WHEN quantile_disc(a, 0.5) > 1e-8 THEN quantile_disc(a, 0.5) WHEN any_value(sd) > 0 THEN any_value(sd) ELSE 1 END AS s FROM a GROUP BY 1),
  z AS (SELECT point, pos, a / s AS z FROM a JOIN sc USING (point) WHERE a / s > 3), {_runs('z', 2)}
  SELECT rn.point, seg_id, start_pos, end_pos, round(max(z), 6) AS score FROM rn JOIN z ON z.point = rn.point AND z.pos BETWEEN start_pos AND end_pos GROUP BY 1, 2, 3, 4""")
def c20_residual_runs(spark, d):
    r = dt.residual_runs(fx.event_series(spark, d), 3.0, 2)
    return r.select("point", "seg_id", "start_pos", "end_pos", F.round("score", 6).alias("score"))


@query(f"""WITH {fx.SERIES} SELECT point, pos, round(CASE WHEN count(*) OVER w = 30 THEN value - CASE WHEN max(value) OVER w = min(value) OVER w THEN lag(value) OVER o ELSE avg(value) OVER w END END, 6) AS mean_residual,
  round(CASE WHEN count(*) OVER w = 30 THEN value - CASE WHEN max(value) OVER w = min(value) OVER w THEN lag(value) OVER o ELSE regr_intercept(value, pos) OVER w + regr_slope(value, pos) OVER w * pos END END, 4) AS linear_residual
  FROM series WINDOW w AS (PARTITION BY point ORDER BY pos ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY point ORDER BY pos)""")
def c21_rolling_residual(spark, d):
    a = dt.rolling_residual(fx.event_series(spark, d), 30).withColumnRenamed("residual", "mean_residual")
    b = dt.rolling_residual(a, 30, "linear").withColumnRenamed("residual", "linear_residual")
    return b.select("point", "pos", F.round("mean_residual", 6).alias("mean_residual"), F.round("linear_residual", 4).alias("linear_residual"))


@query(f"""WITH {fx.SERIES}, n AS (SELECT point, count(*) AS n FROM series GROUP BY 1)
  SELECT DISTINCT point, start, least(n, 128) AS length FROM (SELECT point, n, unnest(list_concat(range(0, greatest(0, n - 128) + 1, 96), [greatest(0, n - 128)])) AS start FROM n)""")
def w26_sliding_windows(spark, d):
    return dt.windows(fx.event_series(spark, d), 128, 0.25)


@query(f"""WITH {fx.SERIES} SELECT point, pos, round(CASE WHEN pos >= 20 THEN value - lag(value) OVER (PARTITION BY point ORDER BY pos) END, 6) AS residual FROM series""")
def t1_streaming_residual(spark, d):
    return dt.rolling_residual(fx.event_series(spark, d), 20, "last").select("point", "pos", F.round("residual", 6).alias("residual"))


def _shift(edge: float, least: int, name: str) -> str:
    """SQL of the mean-shift segments of `series`."""
    return f"""{name} AS (WITH {_hist('series', 20)}, pk AS (SELECT point, arg_max(bin, (n, -bin)) AS top, max(n) AS most FROM h GROUP BY 1),
    sd AS (SELECT h.point, any_value(low) AS low, any_value(width) AS width, any_value(top) AS top, max(bin) FILTER (WHERE n <= {edge} * most AND bin < top) AS l, min(bin) FILTER (WHERE n <= {edge} * most AND bin > top) AS r FROM h JOIN pk USING (point) GROUP BY 1),
    en AS (SELECT point, low + (coalesce(l, -1) + 1) * width AS lo, low + coalesce(r, 20) * width AS hi, low + (top + 0.5) * width AS centre FROM sd),
    ou AS (SELECT s.point, pos FROM series s JOIN en USING (point) WHERE value < lo OR value > hi), {_runs('ou', least)},
    mn AS (SELECT rn.point, seg_id, start_pos, end_pos, avg(value) AS m FROM rn JOIN series s ON s.point = rn.point AND s.pos BETWEEN start_pos AND end_pos GROUP BY 1, 2, 3, 4)
    SELECT mn.point, start_pos, end_pos FROM mn JOIN en USING (point) WHERE abs(m - centre) > 0.2 * abs(centre))"""


_SHORT = ((20, 3), (100, 10))


def _composed(rows: str, dead: str = "") -> str:
    """SQL of the composed detector over rows without step signals; dead gives more segments."""
    return f"""raw AS ({rows} QUALIFY row_number() OVER (PARTITION BY point, ts ORDER BY pos) = 1),
  {_m4_sql('one AS (SELECT 1)', 'raw', 400)}, series AS (SELECT point, ds_pos AS pos, ts, value FROM ds),
  jb AS (WITH {_HBOS}, {_drift('series', _SHORT).format(th=5.0)}, al AS (SELECT point, pos FROM hb UNION SELECT point, pos FROM dr), {_runs('al')}, {_range_filter('rn', 'WHERE loc >= 0.3 * g')} SELECT point, start_pos, end_pos FROM rf),
  {_shift(0.009, 2, 'ms')}, fo AS (SELECT * FROM jb UNION SELECT * FROM ms {dead}),
  mk AS (SELECT s.point, s.pos, s.ts, max(CASE WHEN fo.point IS NULL THEN 0 ELSE 1 END) AS m FROM series s LEFT JOIN fo ON fo.point = s.point AND s.pos BETWEEN start_pos AND end_pos GROUP BY 1, 2, 3),
  gi AS (SELECT point, ts, pos - row_number() OVER (PARTITION BY point ORDER BY pos) AS g FROM mk WHERE m = 1), sp AS (SELECT point, min(ts) AS a, max(ts) AS b FROM gi GROUP BY point, g),
  am AS (SELECT r.point, r.pos, max(CASE WHEN sp.point IS NULL THEN 0 ELSE 1 END) AS mask FROM raw r LEFT JOIN sp ON sp.point = r.point AND r.ts BETWEEN a AND b GROUP BY 1, 2)"""


# the values of events never repeat for most of a point, so no point is a step signal, and none has dead runs
_COMPOSED = _composed(f"WITH {fx.SERIES} SELECT * FROM series")


@query(f"WITH {_COMPOSED} SELECT point, pos, mask FROM am")
def c14_composed_detector(spark, d):
    return dt.adtk_hbos(fx.event_series(spark, d), 400, _SHORT, min_rows=2).select("point", "pos", "mask")


_GATED = f"""gated AS (WITH {fx.SERIES}, n AS (SELECT point, count(*) AS n FROM series GROUP BY 1)
  SELECT point, pos, ts, CAST(CASE WHEN point = 'view' THEN pos // 40 % 3 * 50 WHEN point = 'click' AND pos * 10 BETWEEN n * 3 AND n * 5 THEN 42 WHEN point = 'error' AND pos * 100 < n * 79 THEN 30 WHEN point = 'error' THEN pos ELSE value END AS DOUBLE) AS value FROM series JOIN n USING (point)),
  steps AS (WITH {step_signal_sql('gated', 20, 0.25)}), calm AS (SELECT * FROM gated WHERE point NOT IN (SELECT point FROM steps WHERE is_step))"""
_DEAD = f"""UNION SELECT point, start_pos, end_pos FROM (WITH di AS (SELECT *, CASE WHEN pos = 0 OR value IS DISTINCT FROM lag(value) OVER w THEN 1 ELSE 0 END AS nn FROM series WINDOW w AS (PARTITION BY point ORDER BY pos)),
  dg AS (SELECT *, sum(nn) OVER (PARTITION BY point ORDER BY pos) AS grp FROM di), dl AS (SELECT point, grp, max(ts) - min(ts) > INTERVAL 20 HOUR AS long FROM dg GROUP BY 1, 2), dk AS (SELECT point, count(DISTINCT value) AS kinds FROM series GROUP BY 1),
  dd AS (SELECT dg.point, pos, long AND kinds >= 10 AND value IS NOT NULL AS dead FROM dg JOIN dl ON dl.point = dg.point AND dl.grp = dg.grp JOIN dk ON dk.point = dg.point),
  few AS (SELECT point FROM dd GROUP BY 1 HAVING avg(CAST(dead AS INTEGER)) < 0.7), dh AS (SELECT dd.point, pos FROM dd JOIN few ON few.point = dd.point WHERE dead), {_runs('dh')} SELECT * FROM rn)"""


@query(f"WITH {_GATED}, {_composed('SELECT * FROM calm', _DEAD)} SELECT point, pos, mask FROM am")
def c14_gated_detector(spark, d):
    """One point is a step signal, one has a dead stretch and one is dead for most of its rows."""
    s = fx.event_series(spark, d)
    s = s.join(s.groupBy("point").agg(F.count("*").alias("n")), "point")
    steps = F.expr("pos div 40 % 3 * 50D")
    value = F.when(F.col("point") == "view", steps).when(F.expr("point = 'click' and pos * 10 between n * 3 and n * 5"), 42.0).when(F.expr("point = 'error' and pos * 100 < n * 79"), 30.0).when(F.col("point") == "error", F.col("pos").cast("double")).otherwise(F.col("value"))
    return dt.adtk_hbos(s.withColumn("value", value).drop("n"), 400, _SHORT, min_rows=2).select("point", "pos", "mask")
