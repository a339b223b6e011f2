"""Queries of continuity, filling and downsampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import clean, reduce
from tidegauge.operators.core import prefix_sums
from tidegauge.plans import fixtures as fx
from tidegauge.plans.registry import query

_STEP = f"""{fx.HOURLY}, dl AS (SELECT point, date_diff('second', lag(ts) OVER (PARTITION BY point ORDER BY ts), ts) AS delta FROM hourly),
  step AS (SELECT point, delta AS step FROM (SELECT point, delta, row_number() OVER (PARTITION BY point ORDER BY count(*) DESC, delta) AS k FROM dl WHERE delta IS NOT NULL GROUP BY 1, 2) WHERE k = 1),
  ends AS (SELECT point, min(ts) AS a, max(ts) AS b FROM hourly GROUP BY 1),
  grid AS (SELECT point, unnest(range(a, b + INTERVAL 1 SECOND, to_seconds(step))) AS ts FROM ends JOIN step USING (point))"""


@query(f"""WITH {_STEP}, t AS (SELECT point, count(*) AS n_rows FROM hourly GROUP BY 1),
  m AS (SELECT point, count(*) AS n_missing FROM grid g WHERE NOT EXISTS (SELECT 1 FROM hourly h WHERE h.point = g.point AND h.ts = g.ts) GROUP BY 1)
  SELECT point, n_rows, CAST(step AS DOUBLE) AS step, coalesce(n_missing, 0) AS n_missing, round(coalesce(n_missing, 0) / n_rows, 6) AS missing_ratio FROM t LEFT JOIN step USING (point) LEFT JOIN m USING (point)""")
def a1_continuity(spark, d):
    return clean.continuity(fx.hourly_series(spark, d)).withColumn("missing_ratio", F.round("missing_ratio", 6))


@query(f"""WITH {fx.SERIES}, dl AS (SELECT point, date_diff('microsecond', lag(ts) OVER (PARTITION BY point ORDER BY ts), ts) / 1e6 AS delta FROM series WHERE pos < 1000)
  SELECT point, round(CASE WHEN quantile_cont(delta, 0.5) > 0 THEN 1 / quantile_cont(delta, 0.5) ELSE 0 END, 9) AS rate FROM dl GROUP BY 1""")
def a2_sampling_rate(spark, d):
    return clean.sampling_rate(fx.event_series(spark, d)).withColumn("rate", F.round("rate", 9))


_SLOTS = f"""{fx.HOURLY}, slots AS (SELECT point, unnest(range(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-10 00:00:01', INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT point FROM hourly)),
  flags AS (SELECT s.point, s.ts, CAST(NOT EXISTS (SELECT 1 FROM hourly h WHERE h.point = s.point AND h.ts = s.ts) AS INTEGER) AS missing FROM slots s)"""


@query(f"WITH {_SLOTS} SELECT point, ts, missing FROM flags")
def a3_missing_slots(spark, d):
    return clean.missing_slots(fx.hourly_series(spark, d), "2024-01-03 00:00:00", "2024-01-10 00:00:00", 3600)


@query(f"""WITH {_SLOTS}, n AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY ts) - 1 AS pos FROM flags),
  g AS (SELECT *, pos - row_number() OVER (PARTITION BY point ORDER BY pos) AS g FROM n WHERE missing = 1)
  SELECT point, row_number() OVER (PARTITION BY point ORDER BY min(pos)) AS seg_id, min(pos) AS start_pos, max(pos) AS end_pos, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows FROM g GROUP BY point, g""")
def c33_gap_report(spark, d):
    return clean.gap_report(fx.hourly_series(spark, d), "2024-01-03 00:00:00", "2024-01-10 00:00:00", 3600)


@query(f"""WITH {fx.SERIES} SELECT DISTINCT date_trunc('hour', TIMESTAMP '2024-01-03' + to_hours(CAST(i AS BIGINT))) AS ts FROM range(0, 200) r(i)
  EXCEPT SELECT date_trunc('hour', ts) FROM series WHERE point = 'click'""")
def u3_grid_minus_observed(spark, d):
    grid = spark.range(200).select(F.expr("timestamp'2024-01-03' + make_dt_interval(0, cast(id as int), 0, 0)").alias("ts"))
    seen = fx.event_series(spark, d).where("point = 'click'").select(F.date_trunc("hour", "ts").alias("ts"))
    return grid.exceptAll(grid.join(seen.distinct(), "ts", "left_semi")).distinct()


@query(f"""WITH {_STEP}, both_ AS (SELECT point, ts, value FROM hourly UNION ALL SELECT point, ts, NULL FROM grid g WHERE NOT EXISTS (SELECT 1 FROM hourly h WHERE h.point = g.point AND h.ts = g.ts))
  SELECT point, ts, coalesce(first_value(value IGNORE NULLS) OVER (PARTITION BY point ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    last_value(value IGNORE NULLS) OVER (PARTITION BY point ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS value FROM both_""")
def w7_gap_fill(spark, d):
    s = fx.hourly_series(spark, d)
    return clean.filled(s, clean.sampling_interval(s))


_ISLE = """c AS (SELECT *, CASE WHEN pos = 0 OR value IS DISTINCT FROM lag(value) OVER w THEN 1 ELSE 0 END AS n FROM {t} WINDOW w AS (PARTITION BY point ORDER BY pos)),
  g AS (SELECT *, sum(n) OVER (PARTITION BY point ORDER BY pos) AS grp FROM c)"""


@query(f"""WITH {fx.DAILY}, {_ISLE.format(t='daily')}, k AS (SELECT point, count(DISTINCT value) AS kinds FROM daily GROUP BY 1),
  r AS (SELECT point, grp, max(ts) - min(ts) > INTERVAL 1 DAY AS long FROM g GROUP BY 1, 2)
  SELECT g.point, g.pos, CAST(long AND kinds >= 4 AS INTEGER) AS dead FROM g JOIN r ON g.point = r.point AND g.grp = r.grp JOIN k ON k.point = g.point""")
def w8_dead_values(spark, d):
    return clean.dead_values(fx.daily_series(spark, d), 86_400, 4).select("point", "pos", "dead")


@query(f"""WITH z AS (SELECT l_returnflag AS point, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax) - 1 AS pos, l_shipdate AS ts, l_tax AS value FROM lineitem),
  {_ISLE.format(t='z')}, k AS (SELECT point, count(DISTINCT value) AS kinds FROM z GROUP BY 1), r AS (SELECT point, grp, max(ts) - min(ts) > INTERVAL 12 HOUR AS long FROM g GROUP BY 1, 2)
  SELECT g.point, count(*) AS n_rows, sum(CAST(long AND kinds >= 4 AND value = 0 AS BIGINT)) AS n_dead FROM g JOIN r ON g.point = r.point AND g.grp = r.grp JOIN k ON k.point = g.point GROUP BY 1""")
def w8_dead_zeros(spark, d):
    x = fx.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("point"), F.col("l_shipdate").alias("ts"), F.col("l_tax").alias("value"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    s = fx.numbered(x, "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "value")
    return clean.dead_values(s, 43_200, 4, only_zero=True).groupBy("point").agg(F.count("*").alias("n_rows"), F.sum(F.col("dead").cast("long")).alias("n_dead"))


@query(f"""WITH {fx.DAILY}, {_ISLE.format(t='daily')}, r AS (SELECT point, grp, count(*) AS n FROM g GROUP BY 1, 2)
  SELECT point, count(*) FILTER (WHERE n > 2) AS n_runs, round(coalesce(sum(n) FILTER (WHERE n > 2), 0) / sum(n), 3) AS constant_ratio FROM r GROUP BY 1""")
def a4_constant_share(spark, d):
    return clean.constant_share(fx.daily_series(spark, d), longer=2)


def _m4_sql(series: str, name: str, n: int) -> str:
    return f"""{series}, sz AS (SELECT point, count(*) AS n FROM {name} GROUP BY 1),
  bk AS (SELECT s.*, CASE WHEN n > {n} THEN floor(CAST(pos * {n // 4} AS DOUBLE) / n) ELSE pos END AS b FROM {name} s JOIN sz USING (point)),
  pk AS (SELECT point, b, min(pos) AS p1, arg_min(pos, (value, pos)) AS p2, arg_max(pos, (value, -pos)) AS p3, max(pos) AS p4 FROM bk GROUP BY 1, 2),
  kp AS (SELECT DISTINCT point, unnest([p1, p2, p3, p4]) AS pos FROM pk),
  ds AS (SELECT s.point, row_number() OVER (PARTITION BY s.point ORDER BY s.ts, s.pos) - 1 AS ds_pos, s.pos AS orig_pos, s.ts, s.value FROM {name} s JOIN kp ON kp.point = s.point AND kp.pos = s.pos)"""


@query(f"WITH {_m4_sql(fx.SERIES, 'series', 200)} SELECT point, ds_pos, orig_pos, ts, value FROM ds")
def k1_m4(spark, d):
    return reduce.m4(fx.event_series(spark, d), 200)


@query()
def k2_lttb(spark, d):
    return reduce.lttb(fx.event_series(spark, d), 100)


@query(f"WITH {fx.SERIES} SELECT point, pos, value FROM series WHERE pos % 7 = 0")
def k3_every_kth(spark, d):
    return reduce.every_kth(fx.event_series(spark, d), 7).select("point", "pos", "value")


@query(f"""WITH {_m4_sql(fx.SERIES, 'series', 200)} SELECT s.point, s.pos, coalesce(CAST(ds.value > 120 AS INTEGER), 0) AS mask FROM series s LEFT JOIN ds ON ds.point = s.point AND ds.orig_pos = s.pos""")
def j8_sampled_mask_to_raw(spark, d):
    s = fx.event_series(spark, d)
    sampled = reduce.m4(s, 200).withColumn("mask", (F.col("value") > 120).cast("int"))
    return reduce.mask_to_raw(s, sampled).select("point", "pos", "mask")


@query(f"""WITH {fx.HOURLY}, {fx.DAILY}, d AS (SELECT DISTINCT date_trunc('day', ts) AS day, point FROM hourly WHERE value > 60)
  SELECT h.point, h.ts, CAST(h.value > 55 AS INTEGER) AS a, CASE WHEN d.day IS NULL THEN 0 ELSE 1 END AS b FROM hourly h LEFT JOIN d ON d.point = h.point AND d.day = h.ts""")
def j12_align_results(spark, d):
    h = fx.hourly_series(spark, d)
    other = h.where("value > 60").select("point", F.date_trunc("day", "ts").alias("ts")).distinct().withColumn("b", F.lit(1))
    return h.join(other, ["point", "ts"], "left").select("point", "ts", (F.col("value") > 55).cast("int").alias("a"), F.coalesce("b", F.lit(0)).alias("b"))


@query(f"""WITH {_m4_sql(fx.SERIES, 'series', 200)} SELECT point, count(*) AS n, regexp_replace(point, '[^A-Za-z0-9]', '_', 'g') || '_' || strftime(min(ts), '%Y%m%d%H%M%S') || '_' || strftime(max(ts), '%Y%m%d%H%M%S') AS file_name, round(sum(value), 4) AS total FROM ds GROUP BY 1""")
def c34_acquisition(spark, d):
    ds = reduce.m4(fx.event_series(spark, d).where("value is not null"), 200)
    stamp = lambda c: F.date_format(c, "yyyyMMddHHmmss")
    name = F.concat_ws("_", F.regexp_replace("point", "[^A-Za-z0-9]", "_"), stamp(F.min("ts")), stamp(F.max("ts")))
    return ds.groupBy("point").agg(F.count("*").alias("n"), name.alias("file_name"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {fx.SERIES} SELECT point, pos, round(sum(value) OVER w, 4) AS s1, round(sum(value * value) OVER w + 3.3e-5, 1) AS s2 FROM series WINDOW w AS (PARTITION BY point ORDER BY pos)""")
def w_prefix_sums(spark, d):
    n = F.col("pos") + 1
    p = prefix_sums(fx.event_series(spark, d))
    s1 = F.col("s1") + n * F.col("centre")
    return p.select("point", "pos", F.round(s1, 4).alias("s1"), F.round(F.col("s2") + 2 * F.col("centre") * F.col("s1") + n * F.col("centre") * F.col("centre") + 3.3e-5, 1).alias("s2"))
