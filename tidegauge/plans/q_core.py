"""Queries of positions, islands, intervals and joins on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import core
from tidegauge.operators.detect import nsigma
from tidegauge.plans import fixtures as fx
from tidegauge.plans.registry import query


@query(f"""WITH {fx.SERIES}, s AS (SELECT *, avg(value) OVER (PARTITION BY point) AS m, stddev_pop(value) OVER (PARTITION BY point) AS d FROM series),
  h AS (SELECT point, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY point ORDER BY pos) <= 5 THEN 0 ELSE 1 END AS new FROM s WHERE abs(value - m) > 3 * d),
  r AS (SELECT point, pos, sum(new) OVER (PARTITION BY point ORDER BY pos) AS g FROM h),
  i AS (SELECT point, g, max(pos) - min(pos) + 1 AS n FROM r GROUP BY 1, 2), c AS (SELECT point, count(*) AS total FROM series GROUP BY 1)
  SELECT i.point, count(*) AS n_intervals, max(n) AS longest, round(CAST(sum(n) AS DOUBLE) / any_value(total), 6) AS share FROM i JOIN c ON i.point = c.point GROUP BY 1""")
def flagship_nsigma_intervals(spark, d):
    s = fx.event_series(spark, d)
    found = nsigma(s, 3.0, bridge=5)
    totals = s.groupBy("point").agg(F.count("*").alias("total"))
    n = F.col("end_pos") - F.col("start_pos") + 1
    return found.join(totals, "point").groupBy("point").agg(F.count("*").alias("n_intervals"), F.max(n).alias("longest"), F.round(F.sum(n) / F.first("total"), 6).alias("share"))


@query(f"""WITH {fx.SERIES} SELECT point, pos, ts, value FROM series""")
def w_positions_by_bucket(spark, d):
    e = fx.table(spark, d, "events").select(F.col("event_type").alias("point"), "ts", "value", "event_id")
    return core.with_positions_by_bucket(e, "event_id").select("point", "pos", "ts", "value")


@query(f"""WITH {fx.QUANTITY}, c AS (SELECT *, CASE WHEN pos = 0 OR value IS DISTINCT FROM lag(value) OVER w THEN 1 ELSE 0 END AS n FROM quantity WINDOW w AS (PARTITION BY point ORDER BY pos)),
  g AS (SELECT point, pos, value, sum(n) OVER (PARTITION BY point ORDER BY pos) AS grp FROM c)
  SELECT point, CAST(grp AS BIGINT) AS grp, any_value(value) AS value, count(*) AS n_rows, min(pos) AS start_pos FROM g GROUP BY 1, 2 HAVING count(*) > 1""")
def w1_islands(spark, d):
    g = core.islands(fx.quantity_series(spark, d), "value")
    return g.groupBy("point", "grp").agg(F.first("value").alias("value"), F.count("*").alias("n_rows"), F.min("pos").alias("start_pos")).where("n_rows > 1")


@query(f"""WITH {fx.SERIES}, h AS (SELECT point, pos, pos - row_number() OVER (PARTITION BY point ORDER BY pos) AS g FROM series WHERE value > 60),
  r AS (SELECT point, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS n_rows FROM h GROUP BY point, g HAVING count(*) >= 3)
  SELECT *, row_number() OVER (PARTITION BY point ORDER BY start_pos) AS seg_id FROM r""")
def w2_split_runs(spark, d):
    return core.split_runs(fx.event_series(spark, d).where("value > 60"), min_size=3)


@query(f"""WITH {fx.SEGMENTS} SELECT point, seg_id, start_pos, end_pos FROM segments""")
def w3_bridged_hits(spark, d):
    return fx.segment_table(spark, d)


@query(f"""WITH {fx.SEGMENTS}, n AS (SELECT *, CASE WHEN start_pos - lag(end_pos) OVER (PARTITION BY point ORDER BY start_pos) <= 12 THEN 0 ELSE 1 END AS new FROM segments),
  g AS (SELECT *, sum(new) OVER (PARTITION BY point ORDER BY start_pos) AS g FROM n)
  SELECT point, CAST(g AS BIGINT) AS seg_id, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n_merged FROM g GROUP BY point, g""")
def w4_merge_close_segments(spark, d):
    return core.merged_segments(fx.segment_table(spark, d), 12)


@query(f"""WITH {fx.SEGMENTS}, n AS (SELECT *, CASE WHEN start_pos - lag(end_pos) OVER (PARTITION BY point ORDER BY start_pos) < 12 THEN 0 ELSE 1 END AS new FROM segments),
  g AS (SELECT *, sum(new) OVER (PARTITION BY point ORDER BY start_pos) AS g FROM n),
  m AS (SELECT point, min(start_pos) AS a, max(end_pos) AS b FROM g GROUP BY point, g)
  SELECT point, unnest(range(a, b + 1)) AS pos FROM m""")
def w5_aggregate_anomalies(spark, d):
    return core.expanded(core.merged_segments(fx.segment_table(spark, d), 12, strict=True))


@query(f"""WITH {fx.MASKED}, g AS (SELECT *, pos - row_number() OVER (PARTITION BY point ORDER BY pos) AS g FROM masked WHERE mask = 1)
  SELECT point, row_number() OVER (PARTITION BY point ORDER BY min(pos)) AS seg_id, min(pos) AS start_pos, max(pos) AS end_pos, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows FROM g GROUP BY point, g""")
def w6_mask_intervals(spark, d):
    return core.mask_intervals(fx.masked_series(spark, d), "mask")


@query(f"""WITH {fx.MASKED}, n AS (SELECT *, lead(pos) OVER w AS np, lead(ts) OVER w AS nt FROM masked WINDOW w AS (PARTITION BY point ORDER BY pos)),
  g AS (SELECT *, pos - row_number() OVER (PARTITION BY point ORDER BY pos) AS g FROM n WHERE mask = 1)
  SELECT point, row_number() OVER (PARTITION BY point ORDER BY min(pos)) AS seg_id, min(pos) AS start_pos, max(coalesce(np, pos)) AS end_pos, min(ts) AS start_ts, max(coalesce(nt, ts)) AS end_ts, count(*) AS n_rows FROM g GROUP BY point, g""")
def w6_mask_intervals_end_after(spark, d):
    return core.mask_intervals(fx.masked_series(spark, d), "mask", end_mode="first_false")


@query(f"""WITH {fx.MASKED} SELECT point, pos, value FROM masked WHERE mask = 0""")
def w21_complement(spark, d):
    m = fx.masked_series(spark, d)
    return core.complement(m, m.where("mask = 1")).select("point", "pos", "value")


@query("""SELECT user_id, arg_min(event_id, ts) AS first_event, arg_max(event_id, ts) AS last_event FROM events GROUP BY 1""")
def w23_first_and_latest(spark, d):
    e = fx.table(spark, d, "events")
    first = core.first_by(e, ["user_id"], "ts").select("user_id", F.col("event_id").alias("first_event"))
    return first.join(core.first_by(e, ["user_id"], F.desc("ts")).select("user_id", F.col("event_id").alias("last_event")), "user_id")


@query("""SELECT o_orderstatus AS point, o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1, 2""")
def w24_drop_duplicate_times(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderstatus").alias("point"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"), "o_orderkey")
    return core.first_by(o, ["point", "ts"], "o_orderkey").select("point", "ts", "value")


@query(f"""WITH {fx.SEGMENTS} SELECT m.point, m.pos, CAST(EXISTS (SELECT 1 FROM segments s WHERE s.point = m.point AND m.pos BETWEEN s.start_pos AND s.end_pos) AS INTEGER) AS mask FROM series m""")
def j9_interval_expansion(spark, d):
    return core.mask_from_segments(fx.event_series(spark, d), fx.segment_table(spark, d)).select("point", "pos", "mask")


@query(f"""WITH {fx.SEGMENTS}, r AS (SELECT g.point, a.ts AS a, b.ts AS b FROM segments g JOIN series a ON a.point = g.point AND a.pos = start_pos JOIN series b ON b.point = g.point AND b.pos = end_pos)
  SELECT o.point, count(*) AS n_rows, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM r WHERE r.point = o.point AND o.ts BETWEEN r.a AND r.b)) AS masked FROM series o GROUP BY 1""")
def j10_time_range_mask(spark, d):
    s = fx.event_series(spark, d)
    g = fx.segment_table(spark, d)
    ranges = g.join(s.select("point", F.col("pos").alias("start_pos"), F.col("ts").alias("start_ts")), ["point", "start_pos"]).join(s.select("point", F.col("pos").alias("end_pos"), F.col("ts").alias("end_ts")), ["point", "end_pos"])
    return core.mask_in_time(s, ranges).groupBy("point").agg(F.count("*").alias("n_rows"), F.sum("mask").alias("masked"))


@query(f"""WITH {fx.HOURLY}, {fx.SERIES}, l AS (SELECT DISTINCT point, ts FROM hourly),
  x AS (SELECT l.point, l.ts, s.pos, abs(date_diff('microsecond', l.ts, s.ts)) AS gap, s.ts AS t FROM l JOIN series s ON l.point = s.point)
  SELECT point, ts, arg_min(pos, gap * 2 + CAST(t > ts AS INTEGER)) AS near FROM x GROUP BY 1, 2""")
def j11_nearest_time(spark, d):
    return core.nearest(fx.hourly_series(spark, d).select("point", "ts"), fx.event_series(spark, d)).select("point", "ts", "near")
