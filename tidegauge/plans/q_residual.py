"""Queries of the mean-shift cascade, density components and the residual pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import density as dn
from tidegauge.operators import mean_shift as ms
from tidegauge.operators import residual as rs
from tidegauge.operators.features import segment_features
from tidegauge.plans import fixtures as fx
from tidegauge.plans.q_clean import _m4_sql
from tidegauge.plans.q_detect import _runs
from tidegauge.plans.q_features import _hist
from tidegauge.plans.q_features import FEATURES, marked_segments
from tidegauge.plans.registry import query
from tidegauge.sources.scratch import settled

# shapes of value for the event types: u is spread over 0..1 by event, k runs from 0 to 999 along the point
_SHIFT = """CASE point WHEN 'click' THEN 100 + 20 * u + CASE WHEN k >= 600 AND k < 640 THEN 80 ELSE 0 END
      WHEN 'purchase' THEN CASE WHEN k >= 500 AND k < 600 THEN 175 + 25 * u WHEN u < 0.68 THEN 100 + 5 * u ELSE 105 + 70 * (u - 0.68) / 0.32 END
      WHEN 'signup' THEN CASE WHEN k >= 300 AND k < 700 THEN 195 + 5 * u WHEN u < 0.75 THEN 100 + 5 * u ELSE 105 + 90 * (u - 0.75) / 0.25 END
      ELSE value END"""
_U = "CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000"
SHIFTED = f"""placed AS (SELECT event_type AS point, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n, ts, value, {_U} AS u FROM events),
  shifted AS (SELECT point, pos, ts, {_SHIFT.replace("k >=", "pos * 1000 // n >=").replace("k <", "pos * 1000 // n <")} AS value FROM placed)"""


def shifted_series(spark, d):
    """Event series of which three are reshaped so that each rule of the cascade has a point."""
    e = fx.event_series(spark, d)
    ids = fx.table(spark, d, "events").select(F.col("event_type").alias("point"), "ts", F.expr(_U).alias("u"), F.row_number().over(fx.W.partitionBy("event_type").orderBy("ts", "event_id")).alias("_k"))
    sizes = e.groupBy("point").agg(F.count("*").alias("n"))
    s = e.join(ids.select("point", (F.col("_k") - 1).cast("long").alias("pos"), "u"), ["point", "pos"]).join(sizes, "point").withColumn("k", F.floor(F.col("pos") * 1000 / F.col("n")))
    return settled(s.select("point", "pos", "ts", F.expr(_SHIFT).alias("value")), "shifted")


def _borders_sql(name: str, limit: str) -> str:
    """Bins beyond the borders of the peak, as `name`, and the runs of rows in them that are off, as `name`_r."""
    return f"""{name}_b AS (SELECT h.point, max(bin) FILTER (WHERE n <= {limit} AND bin < top AND bin > 0) AS l, nullif(min(bin) FILTER (WHERE n <= {limit} AND bin > top), 19) AS r FROM h JOIN pk USING (point) JOIN kn USING (point) GROUP BY 1),
  {name}_s AS (SELECT h.point, coalesce(sum(n) FILTER (WHERE bin <= l), 0) AS sl, coalesce(sum(n) FILTER (WHERE bin >= r), 0) AS sr FROM h JOIN {name}_b USING (point) GROUP BY 1),
  {name} AS (SELECT h.point, bin FROM h JOIN {name}_b USING (point) JOIN {name}_s USING (point) JOIN pk USING (point)
    WHERE CASE WHEN sl > most OR sr > most THEN bin = top WHEN sl / most > 0.85 THEN coalesce(bin >= r, false) WHEN sr / most > 0.85 THEN coalesce(bin <= l, false) ELSE coalesce(bin <= l, false) OR coalesce(bin >= r, false) END)"""


def _off_sql(name: str) -> str:
    return f"""{name}_r AS (WITH o AS (SELECT bn.point, bn.pos, bn.value FROM bn JOIN {name} f ON f.point = bn.point AND f.bin = bn.bin), {_runs('o', 6)}
    SELECT rn.point, start_pos, end_pos, count(*) AS n_rows FROM rn JOIN o ON o.point = rn.point AND o.pos BETWEEN start_pos AND end_pos JOIN pk ON pk.point = rn.point GROUP BY rn.point, start_pos, end_pos, centre
    HAVING avg(value) > 1.2 * centre OR avg(value) < 0.8 * centre)"""


_CASCADE = f"""{_hist('shifted', 20)},
  pk AS (SELECT point, arg_max(bin, (n, -bin)) AS top, max(n) AS most, any_value(low) + (arg_max(bin, (n, -bin)) + 0.5) * any_value(width) AS centre FROM h GROUP BY 1),
  bn AS (SELECT s.point, s.pos, s.value, CAST(CASE WHEN width > 0 THEN least(floor((value - low) / width), 19) ELSE 0 END AS BIGINT) AS bin FROM shifted s JOIN e USING (point)),
  kc AS (SELECT point, n, row_number() OVER (PARTITION BY point ORDER BY n, bin) - 1 AS x, ln(1 + n) AS y FROM h), ke AS (SELECT point, arg_min(y, x) AS y0, arg_max(y, x) AS y1 FROM kc GROUP BY 1),
  kn AS (SELECT point, arg_max(n, (round(abs((y1 - y0) * x - 19 * (y - y0)), 9), -x)) AS lim FROM kc JOIN ke USING (point) GROUP BY 1),
  {_borders_sql('fa', '0.009 * most')}, {_off_sql('fa')}, {_borders_sql('fb', 'lim')}, {_off_sql('fb')},
  gr AS (SELECT h.point, bin, n, bin - row_number() OVER (PARTITION BY h.point ORDER BY bin) AS g FROM h JOIN kn USING (point) WHERE n > lim), gw AS (SELECT point, g, sum(n) AS w FROM gr GROUP BY 1, 2), gh AS (SELECT point, arg_max(g, (w, -g)) AS g FROM gw GROUP BY 1),
  fc AS (SELECT gr.point, bin FROM gr JOIN gh USING (point) WHERE gr.g <> gh.g), {_off_sql('fc')},
  ca AS (SELECT *, 'edge' AS rule FROM fa_r UNION ALL SELECT *, 'knee' FROM fb_r WHERE point NOT IN (SELECT point FROM fa_r) UNION ALL SELECT *, 'groups' FROM fc_r WHERE point NOT IN (SELECT point FROM fa_r UNION SELECT point FROM fb_r))"""


@query(f"WITH {SHIFTED}, {_CASCADE} SELECT point, row_number() OVER (PARTITION BY point ORDER BY start_pos) AS seg_id, start_pos, end_pos, n_rows, rule FROM ca")
def c8_mean_shift_cascade(spark, d):
    return ms.mean_shift_cascade(shifted_series(spark, d), longer=5)


@query(f"""WITH RECURSIVE {fx.SEGMENTS}, {FEATURES}, f AS (SELECT point, seg_id, coalesce(mean_ratio, 0) AS a, coalesce(range_ratio, 0) AS b FROM ftr),
  sc AS (SELECT point, count(*) AS n, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM f GROUP BY 1),
  z AS (SELECT point, seg_id, n, round(CASE WHEN sa > 1e-12 THEN (a - ma) / sa ELSE 0 END, 6) AS x, round(CASE WHEN sb > 1e-12 THEN (b - mb) / sb ELSE 0 END, 6) AS y FROM f JOIN sc USING (point)),
  ds AS (SELECT p.point, p.seg_id AS a, q.seg_id AS b, p.n, round(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), 9) AS d FROM z p JOIN z q ON p.point = q.point AND p.seg_id <> q.seg_id),
  nb AS (SELECT point, a, d FROM ds QUALIFY row_number() OVER (PARTITION BY point, a ORDER BY d) = least(2, n - 1)), ep AS (SELECT point, round(quantile_cont(d, 0.75), 9) AS eps FROM nb GROUP BY 1),
  lk AS (SELECT point, a, b FROM ds JOIN ep USING (point) WHERE d <= eps), reach AS (SELECT point, min(seg_id) AS seg_id FROM z GROUP BY 1 UNION SELECT r.point, lk.b FROM reach r JOIN lk ON lk.point = r.point AND lk.a = r.seg_id)
  SELECT z.point, z.seg_id, r.seg_id IS NOT NULL AS is_global FROM z LEFT JOIN reach r ON r.point = z.point AND r.seg_id = z.seg_id""")
def c10_split_by_density(spark, d):
    features = segment_features(fx.event_series(spark, d), marked_segments(spark, d)).select("point", "seg_id", "mean_ratio", "range_ratio")
    return dn.split_by_density(settled(features, "segment-features"))


# a step point, a noisy point, and three seasonal ones with a high stretch, a dead stretch and dents
_KINDS = """CASE point WHEN 'click' THEN CAST(50 * floor(pos * 5 / n) AS DOUBLE) WHEN 'error' THEN 2 * u - 1
      WHEN 'purchase' THEN 100 + 10 * sin(2 * pi() * pos / 240) + u / 10 + CASE WHEN k BETWEEN 500 AND 519 THEN 60 ELSE 0 END
      WHEN 'signup' THEN CASE WHEN k BETWEEN 800 AND 849 THEN 0 ELSE 100 + 10 * sin(2 * pi() * pos / 240) + u / 10 END
      ELSE 100 + 10 * sin(2 * pi() * pos / 240) + u / 10 + CASE WHEN k IN (150, 550) THEN -25 ELSE 0 END END"""
KINDS = f"""placed AS (SELECT event_type AS point, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n, ts, value, {_U} AS u FROM events),
  kinds AS (SELECT point, pos, ts, {_KINDS.replace("k BETWEEN", "pos * 1000 // n BETWEEN").replace("k IN", "pos * 1000 // n IN")} AS value FROM placed)"""


def kinds_series(spark, d):
    """Event series reshaped into a step point, a noisy one and seasonal ones."""
    e = fx.table(spark, d, "events").select(F.col("event_type").alias("point"), "ts", "event_id", F.expr(_U).alias("u"))
    s = fx.with_positions(e, "event_id").withColumn("pos", F.col("pos").cast("long"))
    s = s.join(s.groupBy("point").agg(F.count("*").alias("n")), "point").withColumn("k", F.floor(F.col("pos") * 1000 / F.col("n")))
    return settled(s.select("point", "pos", "ts", F.expr(_KINDS).alias("value")), "kinds")


def _component_sql(c: str) -> str:
    """Bridged segments of a component by the Haar residual of its scaled values."""
    return f"""{c}_e AS (SELECT point, min({c}) AS a, max({c}) AS b, count(*) AS n FROM comp GROUP BY 1), {c}_v AS (SELECT point, pos, n, CASE WHEN a = b THEN {c} ELSE ({c} - a) / (b - a) END AS v FROM comp JOIN {c}_e USING (point)),
  {c}_2 AS (SELECT point, pos // 2 AS k, avg(v) AS m FROM {c}_v GROUP BY 1, 2), {c}_4 AS (SELECT point, k // 2 AS k, avg(m) AS m FROM {c}_2 GROUP BY 1, 2), {c}_8 AS (SELECT point, k // 2 AS k, avg(m) AS m FROM {c}_4 GROUP BY 1, 2),
  {c}_r AS (SELECT s.point, s.pos, n, v - m AS r FROM {c}_v s JOIN {c}_8 q ON q.point = s.point AND q.k = s.pos // 8), {c}_m AS (SELECT point, avg(r) AS m, stddev_pop(r) AS d FROM {c}_r GROUP BY 1),
  {c}_h AS (SELECT s.point, pos, CAST(floor(n * 0.01) AS BIGINT) AS gap FROM {c}_r s JOIN {c}_m USING (point) WHERE abs(r - m) > 3 * d),
  {c}_b AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY point ORDER BY pos) <= gap THEN 0 ELSE 1 END AS new FROM {c}_h), {c}_g AS (SELECT *, sum(new) OVER (PARTITION BY point ORDER BY pos) AS g FROM {c}_b),
  {c}_s AS (SELECT point, unnest(range(min(pos), max(pos) + 1)) AS pos FROM {c}_g GROUP BY point, g)"""


# the kinds of the points are known from how they are made, so the gates are lists; 96 rows are a season, 97 a frame
_PIPELINE = f"""{KINDS}, raw AS (SELECT * FROM kinds QUALIFY row_number() OVER (PARTITION BY point, ts ORDER BY pos) = 1), {_m4_sql('one AS (SELECT 1)', 'raw', 800)},
  smp AS (SELECT point, ds_pos AS pos, orig_pos, ts, value FROM ds), op AS (SELECT * FROM smp WHERE point NOT IN ('click', 'error')), nn AS (SELECT point, count(*) AS n FROM op GROUP BY 1),
  fl AS (SELECT point, regr_slope(value, pos) FILTER (WHERE pos < 97) AS b1, regr_intercept(value, pos) FILTER (WHERE pos < 97) AS a1, regr_slope(value, pos) FILTER (WHERE pos >= n - 97) AS b2, regr_intercept(value, pos) FILTER (WHERE pos >= n - 97) AS a2 FROM op JOIN nn USING (point) GROUP BY 1),
  tr AS (SELECT point, pos, value, CASE WHEN pos <= 48 THEN a1 + b1 * pos WHEN pos >= n - 49 THEN a2 + b2 * pos ELSE avg(value) OVER (PARTITION BY point ORDER BY pos ROWS BETWEEN 48 PRECEDING AND 48 FOLLOWING) END AS trend FROM op JOIN nn USING (point) JOIN fl USING (point)),
  ph AS (SELECT point, pos % 96 AS p, avg(value - trend) AS s FROM tr GROUP BY 1, 2), lv AS (SELECT point, avg(s) AS l FROM ph GROUP BY 1),
  comp AS (SELECT tr.point, tr.pos, trend, value - trend - (s - l) AS residual FROM tr JOIN ph ON ph.point = tr.point AND ph.p = tr.pos % 96 JOIN lv ON lv.point = tr.point),
  {_component_sql('trend')}, {_component_sql('residual')}, ad AS (SELECT point, pos, count(*) AS outlier_mask FROM (SELECT * FROM trend_s UNION ALL SELECT * FROM residual_s) GROUP BY 1, 2),
  rg AS (SELECT point, pos, pos - row_number() OVER (PARTITION BY point ORDER BY pos) AS g FROM ad), ra AS (SELECT rg.point, g, max(abs(value)) - min(abs(value)) AS r FROM rg JOIN smp s ON s.point = rg.point AND s.pos = rg.pos GROUP BY 1, 2),
  wh AS (SELECT point, max(abs(value)) - min(abs(value)) AS w FROM smp GROUP BY 1), sd AS (SELECT rg.point, rg.pos, r / w >= 0.5 AS is_global FROM rg JOIN ra ON ra.point = rg.point AND ra.g = rg.g JOIN wh ON wh.point = rg.point),
  ci AS (SELECT *, CASE WHEN pos = 0 OR value IS DISTINCT FROM lag(value) OVER w THEN 1 ELSE 0 END AS c FROM op WINDOW w AS (PARTITION BY point ORDER BY pos)), gi AS (SELECT *, sum(c) OVER (PARTITION BY point ORDER BY pos) AS g FROM ci),
  dd AS (SELECT point, pos FROM gi WHERE value = 0 QUALIFY max(ts) OVER (PARTITION BY point, g) - min(ts) OVER (PARTITION BY point, g) > INTERVAL 72000 SECOND),
  res AS (SELECT s.point, s.pos, s.orig_pos, coalesce(outlier_mask, 0) AS outlier_mask, CASE WHEN coalesce(is_global, false) OR dd.pos IS NOT NULL THEN 1 ELSE 0 END AS global_mask, CASE WHEN NOT is_global THEN 1 ELSE 0 END AS local_mask
    FROM smp s LEFT JOIN ad ON ad.point = s.point AND ad.pos = s.pos LEFT JOIN sd ON sd.point = s.point AND sd.pos = s.pos LEFT JOIN dd ON dd.point = s.point AND dd.pos = s.pos)"""


def _pipeline(spark, d, **kw):
    return rs.residual_pipeline(kinds_series(spark, d), 800, th=3.0, period=96, range_th=0.5, **kw)


@query(f"WITH {_PIPELINE} SELECT point, pos, orig_pos, CAST(outlier_mask AS INTEGER) AS outlier_mask, global_mask, local_mask, global_mask AS global_mask_cluster, local_mask AS local_mask_cluster FROM res")
def c15_residual_pipeline(spark, d):
    return _pipeline(spark, d).select("point", "pos", "orig_pos", *rs.MASKS)


@query(f"""WITH {_PIPELINE}, gg AS (SELECT point, orig_pos, pos - row_number() OVER (PARTITION BY point ORDER BY pos) AS g FROM res WHERE global_mask = 1), sp AS (SELECT point, min(orig_pos) AS a, max(orig_pos) AS b FROM gg GROUP BY point, g)
  SELECT k.point, k.pos, max(CASE WHEN sp.point IS NULL THEN 0 ELSE 1 END) AS global_mask FROM kinds k LEFT JOIN sp ON sp.point = k.point AND k.pos BETWEEN a AND b GROUP BY 1, 2""")
def c15_residual_raw_rows(spark, d):
    found = settled(_pipeline(spark, d), "found")
    return rs.to_raw_rows(kinds_series(spark, d), found).select("point", "pos", "global_mask")
