"""Queries of file names, inventories, registries, filters and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import names as nm
from tidegauge.operators import detect as dt
from tidegauge.operators import inventory as iv
from tidegauge.operators import matching as mt
from tidegauge.operators import records as rc
from tidegauge.operators import score as sc
from tidegauge.operators.core import mask_from_segments
from tidegauge.plans import fixtures as fx
from tidegauge.plans.registry import query


@query("""SELECT doc_id, source || '_' || doc_id || '.PV' AS record_point, source || '_' || doc_id || '.PV' AS point_id, CASE doc_id % 3 WHEN 0 THEN 'trend_resid' WHEN 1 THEN 'resid' END AS hint FROM documents""")
def p5_point_extraction(spark, d):
    point = F.concat("source", F.lit("_"), "doc_id", F.lit(".PV"))
    docs = fx.table(spark, d, "documents")
    record = F.concat(F.when(F.col("doc_id") % 2 == 0, "annotations_数据集zhlh_100_").otherwise("annotations_"), point, F.lit(".json"))
    path = F.concat(F.lit("data/v1.2/"), point, F.lit("/plot.png"))
    hint = F.concat(point, F.when(F.col("doc_id") % 3 == 0, "_trend_resid").when(F.col("doc_id") % 3 == 1, "_resid").otherwise(""))
    return docs.select("doc_id", nm.record_point(record).alias("record_point"), nm.point_id(path).alias("point_id"), nm.suffix_hint(hint).alias("hint"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events""")
def p11_normalised_times(spark, d):
    form = lambda f: F.date_format("ts", f)
    text = F.when(F.col("event_id") % 4 == 0, form("yyyy/MM/dd HH:mm:ss")).when(F.col("event_id") % 4 == 1, F.concat(form("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(F.col("event_id") % 4 == 2, F.concat(form("yyyy-MM-dd HH:mm:ss"), F.lit("+08:00"))).otherwise("soon")
    return fx.table(spark, d, "events").select("event_id", nm.normalised_time(text).alias("at"))


def _results(spark, d):
    return fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("method")).agg(F.round(F.avg("o_totalprice"), 2).alias("score_avg"), F.max("o_totalprice").alias("score_max"))


_RESULTS = "r AS (SELECT o_custkey AS id, o_orderstatus AS method, round(avg(o_totalprice), 2) AS score_avg, max(o_totalprice) AS score_max FROM orders GROUP BY 1, 2)"


@query(f"""WITH {_RESULTS} SELECT id, 'by mean' AS how FROM r WHERE method = 'F' AND score_avg >= 100000 AND score_avg <= 200000 UNION ALL SELECT id, 'by most' FROM (SELECT id FROM r WHERE score_max >= 150000 ORDER BY score_max DESC, id LIMIT 100)""")
def p13_score_filter(spark, d):
    r = _results(spark, d)
    mean = iv.filtered_results(r, " f ", 100_000, 200_000, "Mean").select("id", F.lit("by mean").alias("how"))
    return mean.union(iv.filtered_results(r, "all", 150_000, score_by="max", limit=100).select("id", F.lit("by most")))


@query("""SELECT doc_id, quality FROM labels WHERE toxic = 0""")
def p14_manual_labels(spark, d):
    marked = fx.table(spark, d, "labels").withColumn("标签", F.when(F.col("toxic") == 0, "标注").otherwise("预测"))
    return marked.where(F.col("标签") == "标注").select("doc_id", "quality")


@query(f"""WITH {fx.SERIES} SELECT point, sum(CAST(value > 100 AS BIGINT)) AS n FROM series GROUP BY 1""")
def p15_mask_choice(spark, d):
    flag = lambda th: (F.col("value") > th).cast("long")
    s = fx.event_series(spark, d).withColumns({"a_mask_cluster": flag(1), "other_mask": flag(50), "outlier_mask": flag(80), "drift_mask": flag(100)})
    return s.groupBy("point").agg(F.sum(iv.pick_mask(s.columns, "drift")).alias("n"))


def _named_records(spark, d):
    point = F.concat("source", F.lit("."), "doc_id")
    docs = fx.table(spark, d, "documents")
    kind = F.col("doc_id") % 3
    records = docs.select(F.col("doc_id").alias("record"), F.concat(point, F.lit(".csv")).alias("name"), point.alias("point"))
    files = docs.where(kind < 2).select(F.when(kind == 0, F.concat(point, F.lit(".csv"))).otherwise(F.concat(F.lit("m4_"), point, F.lit("_2024.csv"))).alias("file_name"))
    longer = docs.where(kind == 1).select(F.concat(F.lit("m4_"), point, F.lit("_20240101.csv")).alias("file_name"))
    return records, files.union(longer)


@query("""WITH r AS (SELECT doc_id AS record, source || '.' || doc_id AS point FROM documents), f AS (SELECT CASE doc_id % 3 WHEN 0 THEN source || '.' || doc_id || '.csv' ELSE 'm4_' || source || '.' || doc_id || '_2024.csv' END AS file_name FROM documents WHERE doc_id % 3 < 2
    UNION SELECT 'm4_' || source || '.' || doc_id || '_20240101.csv' FROM documents WHERE doc_id % 3 = 1), b AS (SELECT record, arg_min(file_name, (length(file_name), file_name)) AS file_name FROM r JOIN f ON contains(file_name, point) GROUP BY 1)
  SELECT record, CASE WHEN record % 3 = 0 THEN point || '.csv' ELSE b.file_name END AS file_name, CASE WHEN record % 3 = 0 THEN 'unchanged' WHEN b.file_name IS NULL THEN 'missing' ELSE 'changed' END AS outcome FROM r LEFT JOIN b USING (record)""")
def j3_repaired_names(spark, d):
    return mt.repaired_names(*_named_records(spark, d))


@query("""SELECT event_type AS path, count(*) AS n, count(DISTINCT user_id) AS n_users, min(ts) AS first_ts FROM events e JOIN (SELECT event_type, user_id FROM events GROUP BY 1, 2 HAVING count(*) > 1) u USING (event_type, user_id)
  WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' GROUP BY 1""")
def s2_config_points(spark, d):
    e = fx.table(spark, d, "events").withColumnRenamed("event_type", "path").withColumn("column", F.col("user_id").cast("string"))
    # the config asks for the users with more than one event of a type
    asked = e.groupBy("path", "column").count().where("count > 1").groupBy("path").agg(F.collect_list("column").alias("columns"))
    config = asked.select(F.to_json(F.create_map("path", F.struct("columns", F.lit("2024-01-05 00:00:00").alias("st"), F.lit("2024-01-12 00:00:00").alias("et")))).alias("config"))
    points = iv.config_points(config)
    found = e.join(points, ["path", "column"]).where(F.col("ts").between(F.col("st"), F.col("et")))
    return found.groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.min("ts").alias("first_ts"))


@query("""SELECT 'o_orderdate' AS time, 'o_orderkey' AS value, CASE WHEN count(DISTINCT o_orderstatus) <= 10 THEN 'o_orderstatus' END AS series, 'o_orderpriority' AS label, count(*) AS n FROM orders""")
def s5_column_roles(spark, d):
    o = fx.table(spark, d, "orders")
    roles = iv.column_roles(o)
    return o.agg(*[F.lit(v).alias(k) for k, v in roles.items()], F.count("*").alias("n"))


@query("""SELECT o_orderstatus AS method, count(*) AS n, count(DISTINCT o_custkey) AS n_points, round(sum(CAST(o_totalprice AS FLOAT)::DOUBLE), 2) AS total FROM orders WHERE o_orderstatus <> 'P' OR o_custkey % 2 = 1 GROUP BY 1""")
def s10_stored_results(spark, d):
    """What of the results is new: even customers of status P are there already."""
    o = fx.table(spark, d, "orders").select(F.col("o_orderstatus").alias("method"), F.col("o_custkey").alias("point"), F.col("o_totalprice").alias("value"), F.lit(1).alias("outlier_mask"))
    there = o.where("method = 'P' and point % 2 = 0").select("method", "point").distinct()
    fresh = iv.narrowed(o).join(there, ["method", "point"], "left_anti")
    return fresh.groupBy("method").agg(F.count("*").alias("n"), F.count_distinct("point").alias("n_points"), F.round(F.sum(F.col("value").cast("double")), 2).alias("total"))


@query(f"""WITH {fx.SEGMENTS}, s AS (SELECT sha256('nsigma|' || point) AS inference_id, point, (end_pos - start_pos + 1)::DOUBLE AS score FROM segments)
  SELECT inference_id, point, count(*) AS segment_count, round(pow(avg(pow(score, 5)), 0.2), 6) AS score_avg, max(score) AS score_max, count(*) AS n_stored FROM s GROUP BY 1, 2""")
def s11_stored_evaluation(spark, d):
    segments = fx.segment_table(spark, d).withColumn("score", (F.col("end_pos") - F.col("start_pos") + 1).cast("double"))
    metrics, stored = iv.evaluation_tables(segments, "nsigma")
    counted = stored.groupBy("inference_id").agg(F.count("*").alias("n_stored"))
    return metrics.join(counted, "inference_id").select("inference_id", "point", "segment_count", F.round("score_avg", 6).alias("score_avg"), "score_max", "n_stored")


@query("""SELECT doc_id AS name, CASE doc_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'gone' WHEN 2 THEN 'changed' ELSE 'same' END AS change FROM documents""")
def s12_snapshot_changes(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.col("n_chars").alias("size"))
    kind = F.col("name") % 4
    return iv.snapshot_changes(docs.where(kind != 0), docs.where(kind != 1).withColumn("size", F.when(kind == 2, F.col("size") + 1).otherwise(F.col("size"))), "name", "size")


@query("""SELECT source || '_' || doc_id || '.csv' AS name FROM documents WHERE doc_id % 3 = 0 ORDER BY n_chars DESC, name LIMIT 50""")
def s13_input_datasets(spark, d):
    plain = F.concat("source", F.lit("_"), "doc_id")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(plain, F.lit(".csv"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Adtk_hbos_"), plain, F.lit(".csv"))).otherwise(F.concat(plain, F.lit("_trend_resid.csv")))
    return iv.datasets(fx.table(spark, d, "documents").select(name.alias("name"), F.col("n_chars").alias("mtime"))).select("name")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40""")
def s14_preview(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("category_status"), F.col("o_custkey").alias("Unnamed: 0"))
    return iv.preview(o, "o_orderkey", 20, 2)


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'sharegpt' WHEN 1 THEN 'openai' WHEN 2 THEN 'alpaca' ELSE 'unknown' END AS layout FROM documents""")
def s15_record_layouts(spark, d):
    body = F.to_json(F.struct(F.col("text")))
    key = F.when(F.col("doc_id") % 4 == 0, "conversations").when(F.col("doc_id") % 4 == 1, "messages").when(F.col("doc_id") % 4 == 2, "instruction").otherwise("other")
    text = F.concat(F.lit('{"'), key, F.lit('": '), body, F.lit("}"))
    return fx.table(spark, d, "documents").select("doc_id", iv.record_layout(text).alias("layout"))


@query("""SELECT doc_id AS dataset, CASE WHEN doc_id % 5 = 0 THEN 'not registered' WHEN doc_id % 5 = 1 THEN 'no file name' WHEN doc_id % 5 = 2 THEN 'no such path' WHEN doc_id % 5 = 3 THEN 'empty folder' ELSE 'valid' END AS status FROM documents""")
def s16_registry_status(spark, d):
    kind, name = F.col("doc_id") % 5, F.concat("source", F.lit("/"), "doc_id")
    docs = fx.table(spark, d, "documents")
    registry = docs.select(F.col("doc_id").alias("dataset"), F.when(kind == 1, "").otherwise(name).alias("file_name"), (kind != 0).alias("registered"))
    return iv.registry_status(registry, docs.where(kind > 2).select(name.alias("name"), F.when(kind == 3, 0).otherwise(2).alias("n_files")))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'updated' ELSE 'skipped' END AS outcome, o_totalprice AS score FROM orders""")
def c24_backfilled_index(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    old = o.where("id % 3 <> 0").withColumn("score", F.when(F.col("id") % 3 == 1, -F.col("score")).otherwise(F.col("score")))
    index, outcomes = iv.backfilled(old, o, "id", "score")
    return index.join(outcomes, "id").select("id", "outcome", "score")


@query(f"""WITH {fx.SEGMENTS}, st AS (SELECT point, avg(value) AS m, stddev_pop(value) AS s FROM series GROUP BY 1), h AS (SELECT point, pos FROM series JOIN st USING (point) WHERE abs(value - m) > 2 * s),
  c AS (SELECT point, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY point ORDER BY pos) <= 5 THEN 0 ELSE 1 END AS new FROM h), g AS (SELECT point, pos, sum(new) OVER (PARTITION BY point ORDER BY pos) AS g FROM c),
  i AS (SELECT 'nsigma' AS method, point, min(pos) AS a, max(pos) AS b FROM g GROUP BY point, g UNION ALL SELECT 'manual', point, start_pos, end_pos FROM segments)
  SELECT method, point, count(a) AS n, coalesce(sum(b - a + 1), 0)::BIGINT AS n_rows FROM (SELECT unnest(['nsigma', 'nothing', 'manual']) AS method, point FROM (SELECT DISTINCT point FROM series)) LEFT JOIN i USING (method, point) GROUP BY 1, 2""")
def c35_method_comparison(spark, d):
    s = fx.event_series(spark, d)
    found = dt.detect(s, "nsigma", th=2.0).withColumn("method", F.lit("nsigma"))
    return iv.method_comparison(s, ["nsigma", "nothing"], found, fx.segment_table(spark, d))


@query(f"""WITH {fx.SEGMENTS}, p AS (SELECT s.point, s.pos, max(CAST(value > 100 AS INTEGER)) AS t, max(CASE WHEN g.seg_id IS NULL THEN 0 ELSE 1 END) AS p FROM series s LEFT JOIN segments g ON g.point = s.point AND s.pos BETWEEN start_pos AND end_pos WHERE s.point IN ('click', 'view', 'error') GROUP BY 1, 2),
  c AS (SELECT point, count(*) FILTER (WHERE t = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (WHERE t = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (WHERE t = 1 AND p = 0)::DOUBLE AS fn FROM p GROUP BY 1)
  SELECT point, round(tp / (tp + fp), 3) AS precision, round(tp / (tp + fn), 3) AS recall, round(tp / (tp + fp + fn), 3) AS jaccard FROM c""")
def a15_batch_evaluation(spark, d):
    s = fx.event_series(spark, d)
    truth = s.where("point <> 'signup'").withColumn("mask", (F.col("value") > 100).cast("int"))
    found = mask_from_segments(s, fx.segment_table(spark, d)).where("point <> 'purchase'")
    return sc.batch_evaluation(s, truth, found).select("point", "precision", "recall", "jaccard")


@query("""WITH c AS (SELECT o_custkey % 50 AS r, o_orderpriority AS c, count(*) FILTER (WHERE o_orderstatus = 'P') AS v FROM orders GROUP BY 1, 2), n AS (SELECT count(DISTINCT r) AS n FROM c)
  SELECT c AS priority, round(sum(v) / max(n), 6) AS mean, count(*) FILTER (WHERE v <> 0) AS n_set, row_number() OVER (ORDER BY sum(v) / max(n), c) AS place FROM c, n GROUP BY 1""")
def a19_heat_map_totals(spark, d):
    cells = fx.table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("r"), F.col("o_orderpriority").alias("priority")).agg(F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("v"))
    return sc.heat_map_totals(cells, "r", "priority", "v").withColumn("mean", F.round("mean", 6))


@query(f"""WITH {fx.SEGMENTS}, f AS (SELECT s.point, s.pos, s.value, bool_or(g.seg_id IS NOT NULL) AS h FROM series s LEFT JOIN segments g ON g.point = s.point AND s.pos BETWEEN start_pos AND end_pos GROUP BY 1, 2, 3),
  n AS (SELECT point, pos, value, row_number() OVER (PARTITION BY point ORDER BY pos) AS k FROM f WHERE NOT h), w AS (SELECT point, floor(count(*) * 0.03) AS w FROM series GROUP BY 1),
  a AS (SELECT g.point, g.seg_id, w, (SELECT count(*) FROM n WHERE n.point = g.point AND n.pos < g.start_pos) AS k FROM segments g JOIN w ON w.point = g.point)
  SELECT a.point, a.seg_id, round(avg(value) FILTER (WHERE n.k <= a.k), 6) AS left_mean, round(avg(value) FILTER (WHERE n.k > a.k), 6) AS right_mean FROM a LEFT JOIN n ON n.point = a.point AND n.k > a.k - w AND n.k <= a.k + w GROUP BY 1, 2""")
def j13_neighbourhoods(spark, d):
    n = sc.neighbourhoods(fx.event_series(spark, d), fx.segment_table(spark, d))
    return n.select("point", "seg_id", F.round("left_mean", 6).alias("left_mean"), F.round("right_mean", 6).alias("right_mean"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Q' || turn || ': ' || length(text) || ' characters' ELSE role || ' says ' || length(text) END AS prompt FROM conversations""")
def f4_prompt_templates(spark, d):
    c = fx.table(spark, d, "conversations").withColumn("name", F.when(F.col("role") == "user", "question").otherwise("other"))
    table = iv.prompt_templates(spark, {"question": "Q{turn}: {n} characters", "other": "{role} says {n}"})
    out = c.join(F.broadcast(table), "name")
    return out.select("conv_id", "turn", rc.filled_template(F.col("template"), {"turn": F.col("turn"), "n": F.length("text"), "role": F.col("role")}).alias("prompt"))


_OLD = """CASE doc_id % 4 WHEN 0 THEN concat('_chatts_P_', doc_id, '.csv') WHEN 1 THEN concat('P_', doc_id, '.csv') ELSE concat('timer_P_', doc_id, '_old.csv') END"""
_NEW = """CASE doc_id % 3 WHEN 0 THEN concat('P_', doc_id, '.csv') WHEN 1 THEN concat('_chatts_P_', doc_id, '_v2.csv') ELSE concat('m4_P_', doc_id, '.txt') END"""


@query(f"""WITH r AS (SELECT doc_id AS record, {_OLD} AS name, concat('P_', doc_id) AS point FROM documents), f AS (SELECT {_NEW} AS file_name, TIMESTAMP '2024-01-01' + INTERVAL (doc_id % 5) DAY AS modified FROM documents),
  c AS (SELECT record, file_name, modified, coalesce(contains(file_name, CASE WHEN starts_with(name, '_chatts_') THEN '_chatts_' WHEN starts_with(name, 'timer_') THEN 'timer_' END), false) AS same FROM r JOIN f ON contains(file_name, point) WHERE file_name LIKE '%.csv'),
  b AS (SELECT record, file_name FROM c QUALIFY row_number() OVER (PARTITION BY record ORDER BY same DESC, modified DESC, length(file_name), file_name) = 1)
  SELECT record, CASE WHEN name IN (SELECT file_name FROM f) THEN name ELSE b.file_name END AS file_name, CASE WHEN name IN (SELECT file_name FROM f) THEN 'unchanged' WHEN b.file_name IS NULL THEN 'missing' ELSE 'changed' END AS outcome FROM r LEFT JOIN b USING (record)""")
def j3_repair_by_prefix_and_time(spark, d):
    docs = fx.table(spark, d, "documents")
    records = docs.select(F.col("doc_id").alias("record"), F.expr(_OLD).alias("name"), F.expr("concat('P_', doc_id)").alias("point"))
    files = docs.select(F.expr(_NEW).alias("file_name"), (F.lit("2024-01-01").cast("timestamp") + F.expr("make_dt_interval(cast(doc_id % 5 as int))")).alias("modified"))
    return mt.repaired_names(records, files)
