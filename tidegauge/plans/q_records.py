"""Queries of annotation records, conversions and training samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import labels as lb
from tidegauge.operators import records as rc
from tidegauge.operators import review as rv
from tidegauge.plans import fixtures as fx
from tidegauge.plans.registry import query

_LABELS = [*rc.REASONS, *(k for k in rc.TYPES if k not in rc.REASONS), "其他"]
_N = len(_LABELS)
_LIST = "[" + ", ".join(f"'{x}'" for x in _LABELS) + "]"
_MARKED = f"""{fx.SEGMENTS}, marked AS (SELECT point, seg_id, start_pos, end_pos, {_LIST}[1 + seg_id % {_N}] AS label FROM segments)"""


def _marked(spark, d):
    """Segments with a label each, all labels in turn."""
    names = F.array(*map(F.lit, _LABELS))
    return fx.segment_table(spark, d).select("point", "seg_id", "start_pos", "end_pos", F.element_at(names, (1 + F.col("seg_id") % _N).cast("int")).alias("label"))


_TYPE_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in rc.TYPES.items())


@query(f"""WITH {_MARKED}, t(label, type) AS (VALUES {_TYPE_ROWS})
  SELECT point, seg_id, coalesce(type, '{rc.OTHER_TYPE}') AS type FROM marked LEFT JOIN t USING (label)""")
def x5_mapped_types(spark, d):
    return _marked(spark, d).select("point", "seg_id", rc.mapped_type(F.col("label")).alias("type"))


_REASON_ROWS = ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in rc.REASONS.items())


@query(f"""WITH {_MARKED}, t(label, one, many) AS (VALUES {_REASON_ROWS}),
  x AS (SELECT point, seg_id, start_pos, end_pos, CASE WHEN start_pos = end_pos THEN coalesce(one, '{rc.OTHER_REASON[0]}') ELSE coalesce(many, '{rc.OTHER_REASON[1]}') END AS r FROM marked LEFT JOIN t USING (label))
  SELECT point, seg_id, replace(replace(r, '{{start}}', start_pos::VARCHAR), '{{end}}', end_pos::VARCHAR) AS reason FROM x""")
def x6_reasons(spark, d):
    return _marked(spark, d).select("point", "seg_id", rc.reason(F.col("label"), F.col("start_pos"), F.col("end_pos")).alias("reason"))


@query("""SELECT doc_id, concat_ws('、', CASE WHEN n_chars > 2000 THEN '高频' ELSE '低频' END, CASE WHEN lang = 'en' THEN '高噪声' WHEN lang = 'fr' THEN '中等噪声' END,
  CASE WHEN doc_id % 2 = 0 THEN '有周期性' END, CASE doc_id % 3 WHEN 0 THEN '上升趋势' WHEN 1 THEN '趋势稳定' END) AS words FROM documents""")
def x7_attribute_words(spark, d):
    attributes = F.create_map(
        F.lit("trend"), F.when(F.col("doc_id") % 3 == 0, "increase").when(F.col("doc_id") % 3 == 1, "stable").otherwise("unheard of"),
        F.lit("frequency"), F.when(F.col("n_chars") > 2000, "high_freq").otherwise("low_freq"),
        F.lit("noise"), F.when(F.col("lang") == "en", "noisy").when(F.col("lang") == "fr", "clean").otherwise(""),
        F.lit("seasonal"), F.when(F.col("doc_id") % 2 == 0, "has_periodic"),
    )
    return fx.table(spark, d, "documents").select("doc_id", rc.attribute_text(attributes).alias("words"))


def _anomalies(spark, d):
    """One anomaly list for each point and fifty rows."""
    item = F.struct(F.array("start_pos", "end_pos").cast("array<int>").alias("interval"), F.col("label").alias("type"), rc.reason(F.col("label"), F.col("start_pos"), F.col("end_pos")).alias("reason"))
    return _marked(spark, d).groupBy("point", F.floor(F.col("start_pos") / 50).alias("rec")).agg(F.array_sort(F.collect_list(item)).alias("anomalies"))


@query(f"""WITH {_MARKED}, t(label, one, many) AS (VALUES {_REASON_ROWS}), x AS (SELECT point, start_pos, end_pos, label, CASE WHEN start_pos = end_pos THEN coalesce(one, '{rc.OTHER_REASON[0]}') ELSE coalesce(many, '{rc.OTHER_REASON[1]}') END AS r FROM marked LEFT JOIN t USING (label))
  SELECT point, start_pos AS first, CASE WHEN label = '点异常' THEN '尖峰' ELSE label END AS type, replace(replace(replace(replace(r, '{{start}}', start_pos::VARCHAR), '{{end}}', end_pos::VARCHAR), '点异常', '尖峰'), '孤立异常点', '尖峰点') AS reason FROM x""")
def x12_renamed_labels(spark, d):
    a = _anomalies(spark, d).select("point", F.explode(rc.relabelled(F.col("anomalies"))).alias("a"))
    return a.select("point", F.col("a.interval")[0].cast("long").alias("first"), "a.type", "a.reason")


@query("SELECT doc_id, '/pictures/' || source || '_' || doc_id || '.PV.jpg' AS image FROM documents")
def x13_image_paths(spark, d):
    old = F.concat(F.lit("data/old/"), F.when(F.col("doc_id") % 2 == 0, "zhlh_").otherwise("gdsh_"), "source", F.lit("_"), "doc_id", F.lit(".PV.png"))
    return fx.table(spark, d, "documents").select("doc_id", rc.image_path(old, "/pictures/").alias("image"))


@query("""WITH c AS (SELECT conv_id, min(text) FILTER (WHERE turn = 0) AS t, count(*) AS n, max(role) FILTER (WHERE turn = 1) AS r FROM conversations GROUP BY 1)
  SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN '<ts><ts/> ' ELSE '<ts><ts/>' || chr(10) END || t AS input, '{"role":"' || r || '","n":' || n || '}' AS output, n AS n_values FROM c WHERE conv_id % 3 <> 0 AND r IS NOT NULL AND t IS NOT NULL""")
def x14_repaired_samples(spark, d):
    c = fx.table(spark, d, "conversations").groupBy("conv_id").agg(F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("t"), F.count("*").alias("n"), F.max(F.when(F.col("turn") == 1, F.col("role"))).alias("r"), F.collect_list(F.length("text").cast("double")).alias("v"))
    c = c.where("r is not null and t is not null")
    rows = c.select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("<ts><ts/> "), "t")).otherwise(F.col("t")).alias("input"), F.struct(F.col("r").alias("role"), "n").alias("output"), F.when(F.col("conv_id") % 3 != 0, F.col("v")).alias("timeseries"))
    return rc.repaired(rows).select("conv_id", "input", "output", F.size(F.col("timeseries")[0]).cast("long").alias("n_values"))


@query(f"""WITH {fx.SEGMENTS}, g AS (SELECT *, start_pos // 50 AS rec, row_number() OVER (PARTITION BY point, start_pos // 50 ORDER BY start_pos) AS k, count(*) OVER (PARTITION BY point, start_pos // 50) AS n FROM segments)
  SELECT point, rec, CASE rec % 3 WHEN 0 THEN 'complete' ELSE 'truncated' END AS outcome, start_pos AS start, end_pos AS "end" FROM g WHERE rec % 4 <> 3 AND (rec % 3 <> 1 OR k < n OR n = 1)
  UNION ALL SELECT DISTINCT point, rec, 'missing', NULL::BIGINT, NULL::BIGINT FROM g WHERE rec % 4 = 3""")
def x15_model_intervals(spark, d):
    one = F.transform("s", lambda x: F.concat(F.lit('{"range": ['), x["start_pos"], F.lit(", "), x["end_pos"], F.lit('], "amp": 1.5, "label": "up [x]"}')))
    g = fx.segment_table(spark, d).groupBy("point", F.floor(F.col("start_pos") / 50).alias("rec")).agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos"))).alias("s"))
    body = F.array_join(one, ", ")
    # answers of one anomaly are cut after it, longer ones inside the last
    cut = F.when(F.size("s") > 1, F.expr("substring(b, 1, length(b) - 7)")).otherwise(F.col("b"))
    text = F.when(F.col("rec") % 3 == 0, F.concat(F.lit("It shows:\n```json\nanomalies = ["), "b", F.lit(",]\n``` as asked"))).when(F.col("rec") % 3 == 1, F.concat(F.lit("anomalies=["), cut)).otherwise(F.concat(F.lit("anomalies = ["), "b", F.lit(",")))
    answers = g.withColumn("b", body).select("point", "rec", F.when(F.col("rec") % 4 == 3, F.lit("no list here")).otherwise(text).alias("text"))
    return rc.model_intervals(answers).select("point", "rec", "outcome", "start", "end")


@query(f"""WITH {fx.SEGMENTS} SELECT point, count(*) FILTER (WHERE seg_id <> 2) AS n, sum(start_pos) FILTER (WHERE seg_id <> 2) AS starts FROM segments GROUP BY 1""")
def x16_removed_annotation(spark, d):
    g = fx.segment_table(spark, d).groupBy("point").agg(F.collect_list(F.struct(F.col("seg_id").alias("id"), "start_pos")).alias("a"))
    left = g.select("point", rc.without_id(F.col("a"), F.lit(2)).alias("a"))
    return left.select("point", F.size("a").cast("long").alias("n"), F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x["start_pos"]).alias("starts"))


@query("""SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) || CASE WHEN count(*) FILTER (WHERE event_type = 'signup') = 0 THEN ',signup' ELSE '' END AS labels FROM events GROUP BY 1""")
def x17_custom_label(spark, d):
    g = fx.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("l"))
    return g.select("user_id", F.array_join(rc.with_label(F.col("l"), F.lit("signup")), ",").alias("labels"))


@query("""SELECT source || doc_id AS record, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END || doc_id AS filename, CASE WHEN doc_id % 2 = 0 THEN lang ELSE lang || '-old' END AS trend, CASE WHEN doc_id % 2 = 0 THEN '2024-01-01' ELSE '2024-02-02' END AS export_time FROM documents""")
def x18_new_layout(spark, d):
    new = F.col("doc_id") % 2 == 0
    map_of = lambda c: F.create_map(F.lit("trend"), c)
    docs = fx.table(spark, d, "documents").select(
        F.concat("source", "doc_id").alias("record"), F.when(new, F.concat("lang", "doc_id")).alias("filename"), F.when(new, map_of(F.col("lang"))).alias("overall_attribute"),
        F.when(~new, map_of(F.concat("lang", F.lit("-old")))).alias("overall_attributes"), F.array("n_chars").alias("annotations"), F.when(new, F.lit("2024-01-01")).alias("export_time"),
    )
    return rc.new_layout(docs, F.lit("2024-02-02")).select("record", "filename", F.col("overall_attribute")["trend"].alias("trend"), "export_time")


@query("""WITH q AS (SELECT p_brand, p_partkey, p_name || chr(10) || 'A. ' || p_type || chr(10) || 'B. ' || p_size || chr(10) || 'Answer:' AS question, CASE WHEN p_size > 25 THEN 'B' ELSE 'A' END AS answer, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
  s AS (SELECT p_brand, string_agg(question || answer, '' ORDER BY k) AS shown FROM q WHERE k <= 2 GROUP BY 1)
  SELECT p_partkey, 'The following are multiple choice questions (with answers) about ' || p_brand || '.' || chr(10) || chr(10) || shown || question AS prompt FROM q JOIN s USING (p_brand) WHERE k > 2""")
def x19_choice_prompts(spark, d):
    p = fx.table(spark, d, "part")
    items = p.select("p_brand", "p_partkey", rc.choice_question(F.col("p_name"), {"A": F.col("p_type"), "B": F.col("p_size")}).alias("question"), F.when(F.col("p_size") > 25, "B").otherwise("A").alias("answer"))
    return rc.few_shot_prompt(items, "p_brand", "p_partkey", 2).select("p_partkey", "prompt")


@query("""SELECT lang, 'chatts_tune_' || CASE WHEN count(DISTINCT n_chars) = 1 THEN min(n_chars)::VARCHAR ELSE 'var' END || '_n' || count(*) || '_' || CASE WHEN count(DISTINCT source) = 1 THEN min(source) ELSE 'mixed' END || '_split_20240105.jsonl' AS name FROM documents GROUP BY 1""")
def x20_output_names(spark, d):
    one = lambda c, other: F.when(F.count_distinct(c) == 1, F.min(c).cast("string")).otherwise(other)
    g = fx.table(spark, d, "documents").groupBy("lang").agg(one("n_chars", "var").alias("length"), F.count("*").alias("n"), one("source", "mixed").alias("source"))
    return g.select("lang", rc.output_name(F.col("length"), F.col("n"), F.col("source"), True, F.lit("2024-01-05").cast("date")).alias("name"))


@query(f"""WITH {_MARKED}, r AS (SELECT point, start_pos // 50 AS rec, CASE WHEN label = '点异常' AND start_pos = end_pos THEN greatest(0, start_pos - 5) ELSE start_pos END AS a, CASE WHEN label = '点异常' AND start_pos = end_pos THEN end_pos + 5 ELSE end_pos END AS b, label FROM marked)
  SELECT point, rec, a AS first, b AS last, label AS type FROM r UNION ALL SELECT DISTINCT point, rec, 0, 4999, '无异常' FROM r""")
def c29_modified_annotations(spark, d):
    # written as joined objects, read back, then modified
    text = F.array_join(F.transform("anomalies", lambda a: F.to_json(F.struct(F.lit("success").alias("status"), F.array(a).alias("detected_anomalies")))), ",")
    a = _anomalies(spark, d).select("point", "rec", F.explode(rc.modified_anomalies(lb.parsed_anomalies(text))).alias("a"))
    return a.select("point", "rec", F.col("a.interval")[0].cast("long").alias("first"), F.col("a.interval")[1].cast("long").alias("last"), "a.type")


_USER_SEGMENTS = f"""{fx.USERS}, uh AS (SELECT point, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY point ORDER BY pos) <= 2 THEN 0 ELSE 1 END AS new FROM users WHERE value > 100),
  ur AS (SELECT point, pos, sum(new) OVER (PARTITION BY point ORDER BY pos) AS g FROM uh), us AS (SELECT point, min(pos) AS a, max(pos) AS b FROM ur GROUP BY point, g)"""
_SAMPLES = f"""{_USER_SEGMENTS}, o AS (SELECT point, count(*) AS n_anomalies, string_agg('{{"status":"success","detected_anomalies":[{{"interval":[' || a || ',' || b || '],"type":"high"}}]}}', ',' ORDER BY a) AS output FROM us GROUP BY 1),
  v AS (SELECT point, count(*) AS n_values, round(sum(value), 4) AS total FROM users GROUP BY 1)"""


def _samples(spark, d):
    from tidegauge.operators.core import bridged

    users = fx.user_series(spark, d)
    return rc.training_set(users, bridged(users.where("value > 100"), 2), "high", "Which rows stand out?")[0]


@query(f"""WITH {_SAMPLES} SELECT point, '<ts><ts/>' || chr(10) || 'Which rows stand out?' AS input, output, n_anomalies, n_values, total FROM o JOIN v USING (point)""")
def c31_training_set(spark, d):
    s = _samples(spark, d)
    total = F.round(F.aggregate(F.col("timeseries")[0], F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), 4)
    return s.select("point", "input", "output", "n_anomalies", F.size(F.col("timeseries")[0]).cast("long").alias("n_values"), total.alias("total"))


@query(f"""WITH {_SAMPLES} SELECT point, output FROM o WHERE point IN (SELECT doc_id::VARCHAR FROM labels WHERE quality = 1 AND toxic = 0)""")
def c32_approved_export(spark, d):
    approved = fx.table(spark, d, "labels").where("quality = 1 and toxic = 0").select(F.col("doc_id").cast("string").alias("point"))
    return _samples(spark, d).join(approved, "point", "left_semi").select("point", "output")


@query(f"""WITH {_USER_SEGMENTS} SELECT point, count(*) > 0 AS annotated, count(*) FILTER (WHERE b > a) AS n_long, count(*) AS n FROM us GROUP BY 1""")
def a21_annotation_stats(spark, d):
    from tidegauge.operators.core import bridged

    users = fx.user_series(spark, d)
    # an annotation of one row has no segments here
    note = F.struct(F.when(F.col("end_pos") > F.col("start_pos"), F.array(F.struct("start_pos", "end_pos"))).otherwise(F.expr("filter(array(struct(start_pos, end_pos)), x -> false)")).alias("segments"))
    g = bridged(users.where("value > 100"), 2).groupBy("point").agg(F.collect_list(note).alias("annotations"))
    return g.select("point", (F.size("annotations") > 0).alias("annotated"), F.size(F.filter("annotations", lambda a: F.size(a["segments"]) > 0)).cast("long").alias("n_long"), F.size("annotations").cast("long").alias("n"))


@query(f"""WITH {_MARKED} SELECT point, count(*) AS n_source, count(*) FILTER (WHERE seg_id % 5 <> 0) AS n_converted, count(*) FILTER (WHERE seg_id % 5 = 0) = 0 AS same_count,
  count(DISTINCT label) = count(DISTINCT label) FILTER (WHERE seg_id % 5 <> 0) AS same_types FROM marked GROUP BY 1""")
def a23_conversion_check(spark, d):
    m = _marked(spark, d)
    source = m.groupBy("point").agg(F.count("*").alias("n_source"), F.collect_set("label").alias("_a"))
    converted = m.where("seg_id % 5 <> 0").groupBy("point").agg(F.count("*").alias("n_converted"), F.collect_set("label").alias("_b"))
    both = source.join(converted, "point", "left").withColumn("n_converted", F.coalesce("n_converted", F.lit(0)))
    same = (F.size(F.array_except("_a", F.coalesce("_b", F.array().cast("array<string>")))) == 0) & (F.size(F.array_except(F.coalesce("_b", F.array().cast("array<string>")), "_a")) == 0)
    return both.select("point", "n_source", "n_converted", (F.col("n_source") == F.col("n_converted")).alias("same_count"), same.alias("same_types"))


@query("""WITH n AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n FROM conversations GROUP BY 1)
  SELECT count(*) AS original, count(*) FILTER (WHERE n = 0) AS n_none, count(*) FILTER (WHERE n = 1) AS n_one, count(*) FILTER (WHERE n > 1) AS n_many, sum(n)::BIGINT AS anomalies, sum(greatest(n, 1))::BIGINT AS expected FROM n""")
def a24_split_statistics(spark, d):
    n = fx.table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.when(F.col("role") == "user", 1)).alias("n"))
    having = lambda c: F.count(F.when(c, 1))
    return n.agg(F.count("*").alias("original"), having(F.col("n") == 0).alias("n_none"), having(F.col("n") == 1).alias("n_one"), having(F.col("n") > 1).alias("n_many"), F.sum("n").alias("anomalies"), F.sum(F.greatest("n", F.lit(1))).alias("expected"))


@query(f"""WITH {fx.SERIES}, t AS (SELECT point, count(*) AS n, date_diff('microsecond', min(ts), max(ts)) / 1e6 AS s, sum(value) AS v FROM series GROUP BY 1)
  SELECT point AS run, round(s / (n - 1), 6) AS step_seconds, round(s / (n - 1) * (5000000 - n), 3) AS remaining, round(n / 5000000.0::DOUBLE * 100, 2) AS percentage, round(v / s, 6) AS per_second FROM t""")
def a29_step_timing(spark, d):
    log = fx.event_series(spark, d).select(F.col("point").alias("run"), "ts", F.col("value").alias("tokens"))
    return rv.step_timing(log, "run", "ts", "tokens", 5_000_000)


@query(f"""WITH {fx.DAILY}, n AS (SELECT point, 1.8 * (1 / (1 + exp(-0.05 * count(*))) - 0.5) AS w FROM daily GROUP BY 1)
  SELECT a.point, a.pos, round(sum(CASE WHEN b.pos = 0 THEN pow(w, a.pos) ELSE (1 - w) * pow(w, a.pos - b.pos) END * b.value), 6) AS smooth FROM daily a JOIN daily b ON a.point = b.point AND b.pos <= a.pos JOIN n ON n.point = a.point GROUP BY 1, 2""")
def a30_smoothed_log(spark, d):
    return rv.smoothed(fx.daily_series(spark, d), "point", "pos", "value").select("point", "pos", F.round("smooth", 6).alias("smooth"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, row_number() OVER w AS i, CAST(l_quantity AS INTEGER) % 3 AS p, CASE WHEN l_tax < 0.02 THEN -100 ELSE l_linenumber % 3 END AS l FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)),
  s AS (SELECT a.l_orderkey, avg(CAST(a.p = b.l AS INTEGER)) AS acc FROM t a JOIN t b ON a.l_orderkey = b.l_orderkey AND b.i = a.i + 1 WHERE b.l <> -100 GROUP BY 1) SELECT round(avg(acc), 9) AS accuracy, count(*) AS n FROM s""")
def a32_token_accuracy(spark, d):
    x = fx.table(spark, d, "lineitem")
    item = F.struct("l_linenumber", "l_partkey", "l_quantity", (F.col("l_quantity").cast("int") % 3).alias("p"), F.when(F.col("l_tax") < 0.02, -100).otherwise(F.col("l_linenumber") % 3).alias("l"))
    g = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("t"))
    rows = g.select(F.transform("t", lambda s: s["p"]).alias("preds"), F.transform("t", lambda s: s["l"]).alias("labels"))
    return rv.token_accuracy(rows).withColumn("accuracy", F.round("accuracy", 9))
