"""Queries of splits, annotation records and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import labels as lb
from tidegauge.operators import review as rv
from tidegauge.operators import split as sp
from tidegauge.operators.features import segment_features
from tidegauge.plans import fixtures as fx
from tidegauge.plans.q_features import FEATURES, marked_segments
from tidegauge.plans.registry import query
from tidegauge.sources.scratch import settled
from tidegauge.streaming.logs import latest

_IN = "mk AS (SELECT g.*, s.pos, s.value FROM segments g JOIN series s ON s.point = g.point AND s.pos BETWEEN start_pos AND end_pos)"


@query(f"""WITH {fx.SEGMENTS}, {_IN}, g AS (SELECT point, max(abs(value)) - min(abs(value)) AS g FROM series GROUP BY 1), o AS (SELECT point, seg_id, start_pos, end_pos, max(abs(value)) - min(abs(value)) AS r FROM mk GROUP BY 1, 2, 3, 4)
  SELECT point, seg_id, start_pos, end_pos, r / g >= 0.5 AS is_global FROM o JOIN g USING (point)""")
def c9_split_by_range(spark, d):
    return sp.split_by_range(fx.event_series(spark, d), fx.segment_table(spark, d))


@query(f"""WITH {fx.SEGMENTS}, {_IN}, c AS (SELECT point, seg_id, start_pos, end_pos, round(stddev_pop(value) / abs(avg(value)), 9) AS cv FROM mk GROUP BY 1, 2, 3, 4),
  k AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY cv DESC, seg_id) AS rank, count(*) OVER (PARTITION BY point) AS n FROM c)
  SELECT point, seg_id, rank FROM k WHERE rank <= greatest(1, floor(n * 0.5 + 1e-9))""")
def w18_most_variable_segments(spark, d):
    return sp.most_variable(fx.event_series(spark, d), fx.segment_table(spark, d)).select("point", "seg_id", "rank")


@query(f"""WITH {fx.SEGMENTS}, {_IN}, x AS (SELECT *, pos - (start_pos + end_pos) / 2.0::DOUBLE AS x FROM mk), s AS (SELECT point, seg_id, count(*) AS n, sum(x * x) AS s2, sum(x * x * x * x) AS s4, sum(value) AS t0, sum(x * value) AS t1, sum(x * x * value) AS t2 FROM x GROUP BY 1, 2 HAVING count(*) >= 3),
  f AS (SELECT x.point, pos, (t0 * s4 - t2 * s2) / (n * s4 - s2 * s2) + t1 / s2 * x + (n * t2 - t0 * s2) / (n * s4 - s2 * s2) * x * x AS f FROM x JOIN s ON s.point = x.point AND s.seg_id = x.seg_id)
  SELECT s.point, s.pos, round(coalesce(f, s.value), 4) AS fitted FROM series s LEFT JOIN f ON f.point = s.point AND f.pos = s.pos""")
def w22_quadratic_replacement(spark, d):
    r = sp.quadratic_replaced(fx.event_series(spark, d), fx.segment_table(spark, d))
    return r.select("point", "pos", F.round("fitted", 4).alias("fitted"))


def _extended_sql(segments: str) -> str:
    return f"""ends AS (SELECT point, max(pos) AS last FROM series GROUP BY 1),
  cand AS (SELECT g.point, seg_id, k, greatest(0, start_pos - k * (end_pos - start_pos + 1)) AS a, least(last, end_pos + k * (end_pos - start_pos + 1)) AS b FROM {segments} g JOIN ends USING (point), range(0, 11) t(k)),
  sds AS (SELECT c.point, seg_id, k, a, b, round(stddev_pop(value), 6) AS sd FROM cand c JOIN series s ON s.point = c.point AND s.pos BETWEEN a AND b GROUP BY ALL),
  lagged AS (SELECT *, coalesce(sd <= lag(sd) OVER (PARTITION BY point, seg_id ORDER BY k), false)::INT AS stuck FROM sds),
  grown AS (SELECT *, sum(stuck) OVER (PARTITION BY point, seg_id ORDER BY k) AS bad FROM lagged),
  wide AS (SELECT point, seg_id, arg_max(a, k) AS start_pos, arg_max(b, k) AS end_pos FROM grown WHERE bad = 0 GROUP BY 1, 2)"""


@query(f"WITH {fx.SEGMENTS}, {_extended_sql('segments')} SELECT * FROM wide")
def w20_extended_segments(spark, d):
    return sp.extended(fx.event_series(spark, d), fx.segment_table(spark, d))


@query(f"""WITH {fx.SEGMENTS}, ends AS (SELECT point, max(pos) AS last FROM series GROUP BY 1),
  g AS (SELECT g.*, end_pos - start_pos + 1 AS n, greatest(0, start_pos - (end_pos - start_pos + 1)) AS lo, least(last, end_pos + end_pos - start_pos + 1) AS hi FROM segments g JOIN ends USING (point) WHERE end_pos > start_pos),
  sides AS (SELECT g.*, round(coalesce(stddev_pop(value) FILTER (WHERE pos > end_pos), 0), 6) > round(coalesce(stddev_pop(value) FILTER (WHERE pos < start_pos), 0), 6) AS later FROM g JOIN series s ON s.point = g.point AND s.pos BETWEEN lo AND hi GROUP BY ALL),
  cand AS (SELECT point, seg_id, n, unnest(range(CASE WHEN later THEN start_pos ELSE lo END, CASE WHEN later THEN hi ELSE end_pos END - n + 2)) AS a FROM sides),
  sds AS (SELECT c.point, seg_id, a, a + n - 1 AS b, round(stddev_pop(value), 6) AS sd FROM cand c JOIN series s ON s.point = c.point AND s.pos BETWEEN a AND a + n - 1 GROUP BY ALL)
  SELECT point, seg_id, a AS start_pos, b AS end_pos, sd FROM sds WHERE sd > 0 QUALIFY row_number() OVER (PARTITION BY point, seg_id ORDER BY sd DESC, a) = 1""")
def w19_refined_segments(spark, d):
    return sp.refined(fx.event_series(spark, d), fx.segment_table(spark, d))


@query(f"""WITH {fx.MASKED}, runs AS (SELECT point, pos, pos - row_number() OVER (PARTITION BY point ORDER BY pos) AS r FROM masked WHERE mask = 1),
  segments AS (SELECT point, row_number() OVER (PARTITION BY point ORDER BY min(pos)) AS seg_id, min(pos) AS start_pos, max(pos) AS end_pos FROM runs GROUP BY point, r), {_IN},
  c AS (SELECT point, seg_id, start_pos, end_pos, round(CASE WHEN avg(value) != 0 THEN stddev_pop(value) / abs(avg(value)) ELSE 0 END, 9) AS cv FROM mk GROUP BY 1, 2, 3, 4),
  chosen AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY point ORDER BY cv DESC, seg_id) <= greatest(1, floor(count(*) OVER (PARTITION BY point) * 0.5 + 1e-9))), {_extended_sql('chosen')}
  SELECT s.point, s.pos, max(w.seg_id IS NOT NULL)::INT AS mask FROM series s LEFT JOIN wide w ON w.point = s.point AND s.pos BETWEEN w.start_pos AND w.end_pos GROUP BY 1, 2""")
def w25_post_processed_mask(spark, d):
    hits = fx.masked_series(spark, d).where("mask = 1").select("point", "pos")
    return sp.post_processed(fx.event_series(spark, d), hits).select("point", "pos", "mask")


_MOVES = "".join(
    f""", d{i} AS (SELECT *, round(power(x - hx, 2) + power(y - hy, 2), 6) < round(power(x - lx, 2) + power(y - ly, 2), 6) AS high FROM z JOIN c{i} USING (point)),
  c{i + 1} AS (SELECT point, {", ".join(f"round(coalesce(avg({c}) FILTER (WHERE {'' if e == 'h' else 'NOT '}high), any_value({e}{c})), 6) AS {e}{c}" for e in "lh" for c in "xy")} FROM d{i} GROUP BY 1)"""
    for i in range(6)
)


@query(f"""WITH {fx.SEGMENTS}, {FEATURES}, r AS (SELECT point, seg_id, coalesce(mean_ratio, 0) AS mr, coalesce(range_ratio, 0) AS rr FROM ftr),
  sc AS (SELECT point, avg(mr) AS mm, stddev_pop(mr) AS sm, avg(rr) AS ma, stddev_pop(rr) AS sa FROM r GROUP BY 1),
  z AS (SELECT point, seg_id, rr, round(CASE WHEN sm > 1e-12 THEN (mr - mm) / sm ELSE 0 END, 6) AS x, round(CASE WHEN sa > 1e-12 THEN (rr - ma) / sa ELSE 0 END, 6) AS y FROM r JOIN sc USING (point)),
  c0 AS (SELECT point, arg_min(x, (y, seg_id)) AS lx, arg_min(y, (y, seg_id)) AS ly, arg_max(x, (y, -seg_id)) AS hx, arg_max(y, (y, -seg_id)) AS hy FROM z GROUP BY 1){_MOVES},
  m AS (SELECT point, round(avg(rr) FILTER (WHERE high), 9) AS mh, round(avg(rr) FILTER (WHERE NOT high), 9) AS ml FROM d5 GROUP BY 1)
  SELECT point, seg_id, high = coalesce(mh >= ml, mh IS NOT NULL) AS is_global FROM d5 JOIN m USING (point)""")
def c11_split_by_two_means(spark, d):
    features = segment_features(fx.event_series(spark, d), marked_segments(spark, d)).select("point", "seg_id", "mean_ratio", "range_ratio")
    return sp.split_by_two_means(settled(features, "segment-features"))


@query(f"""WITH {fx.SEGMENTS}, r AS (SELECT point, start_pos // 50 AS rec, start_pos, end_pos FROM segments) SELECT point, rec, count(*) AS n,
  string_agg('{{"status":"success","detected_anomalies":[{{"interval":[' || start_pos || ',' || end_pos || '],"type":"' || point || '"}}]}}', ',' ORDER BY start_pos) AS answer FROM r GROUP BY 1, 2""")
def c27_annotation_to_conversation(spark, d):
    g = fx.segment_table(spark, d).groupBy("point", F.floor(F.col("start_pos") / 50).alias("rec")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("start_pos", "end_pos"))).alias("segments"))
    return g.select("point", "rec", "n", lb.conversation(F.col("point"), F.col("segments")).alias("answer"))


@query(f"""WITH {fx.SEGMENTS} SELECT point, start_pos AS first, end_pos AS last FROM segments""")
def x10_parse_joined_objects(spark, d):
    g = c27_annotation_to_conversation(spark, d)
    a = g.select("point", F.explode(lb.parsed_anomalies(F.col("answer"))).alias("a"))
    return a.select("point", F.col("a.interval")[0].cast("long").alias("first"), F.col("a.interval")[1].cast("long").alias("last"))


@query("""WITH a AS (SELECT user_id, CAST(event_id AS BIGINT) AS id, CAST(value AS INTEGER) // 20 * 20 AS a, event_type FROM events), f AS (SELECT user_id, a, arg_min(event_type, id) AS type FROM a GROUP BY 1, 2)
  SELECT user_id, count(*) AS n, string_agg(a || ':' || type, ';' ORDER BY a) AS merged FROM f GROUP BY 1""")
def c28_merge_records(spark, d):
    start = (F.floor(F.round("value") / 20) * 20).cast("int")
    r = fx.table(spark, d, "events").select("user_id", "event_id", F.array(start, start).alias("interval"), F.col("event_type").alias("type"))
    m = lb.merged_records(r, "user_id", "event_id")
    return m.select("user_id", F.size("anomalies").cast("long").alias("n"), F.array_join(F.transform("anomalies", lambda x: F.concat_ws(":", x["start"], x["type"])), ";").alias("merged"))


@query("""SELECT conv_id, turn, role FROM conversations""")
def c30_one_sample_each(spark, d):
    s = fx.table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
    return lb.one_sample_each(s, "turns").select("conv_id", "anomaly.turn", "anomaly.role")


@query("""WITH p AS (SELECT conv_id, turn, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM conversations), g AS (SELECT conv_id, turn, unnest(w) AS g FROM p), c AS (SELECT conv_id, turn, g, count(*) AS c FROM g GROUP BY 1, 2, 3),
  x AS (SELECT a.conv_id, sum(least(a.c, b.c)) AS common FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.g = b.g AND a.turn = 0 AND b.turn = 1 GROUP BY 1), n AS (SELECT conv_id, sum(c) FILTER (WHERE turn = 0) AS n0, sum(c) FILTER (WHERE turn = 1) AS n1 FROM c GROUP BY 1)
  SELECT n.conv_id, n0 AS n_pred, n1 AS n_label, coalesce(common, 0) AS common, round(2.0::DOUBLE * coalesce(common, 0) / (n0 + n1), 6) AS f FROM n LEFT JOIN x USING (conv_id) WHERE n0 IS NOT NULL AND n1 IS NOT NULL""")
def a34_text_overlap(spark, d):
    c = fx.table(spark, d, "conversations")
    pairs = c.where("turn = 0").select("conv_id", F.col("text").alias("p")).join(c.where("turn = 1").select("conv_id", F.col("text").alias("t")), "conv_id")
    return lb.ngram_overlap(pairs, "conv_id", "p", "t", 1).withColumn("f", F.round("f", 6))


@query(f"""WITH {fx.SERIES} SELECT point AS run, max(pos) AS step, arg_max(value, pos) AS loss, count(*) AS n FROM series GROUP BY 1""")
def t2_latest_of_log(spark, d):
    return latest(fx.event_series(spark, d).select(F.col("point").alias("run"), F.col("pos").alias("step"), F.col("value").alias("loss")))


@query("""WITH t AS (SELECT lang, list(DISTINCT source ORDER BY source) AS a FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), u AS (SELECT lang, list(DISTINCT source ORDER BY source) AS b FROM documents WHERE doc_id % 2 = 1 GROUP BY 1)
  SELECT lang, a = b AS same FROM t JOIN u USING (lang)""")
def u6_type_set_equality(spark, d):
    x = fx.table(spark, d, "documents")
    side = lambda r, n: x.where(F.col("doc_id") % 2 == r).groupBy("lang").agg(F.collect_set("source").alias(n))
    same = (F.size(F.array_except("a", "b")) == 0) & (F.size(F.array_except("b", "a")) == 0)
    return side(0, "a").join(side(1, "b"), "lang").select("lang", same.alias("same"))


@query("""SELECT p_brand, arg_max(p_name, (CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER), p_partkey)) AS latest, max(p_partkey) AS number FROM part GROUP BY 1""")
def k7_latest_checkpoint(spark, d):
    p = fx.table(spark, d, "part")
    return p.groupBy("p_brand").agg(F.max_by("p_name", F.struct(F.regexp_extract("p_brand", "[0-9]+", 0).cast("int"), "p_partkey")).alias("latest"), F.max("p_partkey").alias("number"))


@query()
def k8_support_sample(spark, d):
    return rv.support_sample(fx.table(spark, d, "documents"), "lang", "doc_id", 5)
