"""Queries of names, joins, review queues, listings and run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.functions import names as nm
from tidegauge.operators import inventory as iv
from tidegauge.operators import matching as mt
from tidegauge.operators import review as rv
from tidegauge.plans import fixtures as fx
from tidegauge.plans.registry import query


@query("""SELECT page_id, regexp_replace(url, '[\\\\/:*?"<>|\\s]+', '_', 'g') AS name FROM pages""")
def p1_sanitize(spark, d):
    return fx.table(spark, d, "pages").select("page_id", nm.sanitized(F.col("url")).alias("name"))


@query("""SELECT event_id, event_type || '.' || user_id AS point FROM events""")
def p2_short_point_name(spark, d):
    name = F.concat_ws("", F.lit("root.dev."), F.col("event_type"), F.lit("-"), F.col("user_id"), F.lit("_"), F.date_format("ts", "yyyyMMdd"))
    return fx.table(spark, d, "events").select("event_id", F.replace(nm.short_point(name), F.lit("-"), F.lit(".")).alias("point"))


@query("""SELECT o_orderkey, 'hbos' AS method, 'm4' AS sampler, o_orderstatus || '_x' AS point, CAST(o_orderdate AS DATE) AS day FROM orders""")
def p3_parse_result_name(spark, d):
    name = F.concat_ws("_", F.lit("hbos"), F.lit("m4"), F.concat("o_orderstatus", F.lit("_x")), F.date_format("o_orderdate", "yyyyMMdd"))
    return fx.table(spark, d, "orders").select("o_orderkey", nm.parsed_result_name(name).alias("p")).select("o_orderkey", "p.*")


@query("""SELECT event_type AS point, event_type || '_' || strftime(min(ts), '%Y%m%d%H%M%S') || '_' || strftime(max(ts), '%Y%m%d%H%M%S') || '_nsigma' AS new_name FROM events GROUP BY 1""")
def p4_standard_names(spark, d):
    stamp = lambda c: F.date_format(c, "yyyyMMddHHmmss")
    e = fx.table(spark, d, "events").groupBy(F.col("event_type").alias("point")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return e.select("point", F.concat_ws("_", "point", stamp("a"), stamp("b"), F.lit("nsigma")).alias("new_name"))


@query("""SELECT page_id, split_part(url, '/', 4) AS part FROM pages WHERE split_part(url, '/', 4) <> ''""")
def p6_method_from_path(spark, d):
    return fx.table(spark, d, "pages").select("page_id", F.try_element_at(F.split("url", "/"), F.lit(4)).alias("part")).where("part <> ''")


@query("""SELECT doc_id, unnest(generate_series(0, 3)) AS rank, unnest([source || doc_id, source || doc_id || '.csv', 'annotations_' || source || doc_id, 'annotations_' || source || doc_id || '.csv']) AS candidate FROM documents""")
def p7_candidate_names(spark, d):
    name = F.concat(F.lit("annotations_"), F.col("source"), F.col("doc_id"), F.lit(".json"))
    return fx.table(spark, d, "documents").select("doc_id", F.posexplode(nm.candidate_names(name)).alias("rank", "candidate"))


@query("""SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE), 0) AS as_double, coalesce(TRY_CAST(event_type AS INTEGER), -1) AS as_int FROM events""")
def p12_safe_casts(spark, d):
    return fx.table(spark, d, "events").select("event_id", nm.safe_double(F.regexp_extract("props", "[0-9]+", 0)).alias("as_double"), nm.safe_int(F.col("event_type"), -1).alias("as_int"))


@query("""SELECT l.doc_id, quality, lang, CASE WHEN d.doc_id IS NULL THEN 'NO_FILE' WHEN text = '' THEN 'EMPTY' ELSE 'OK' END AS outcome FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id""")
def j1_annotation_join_with_reasons(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "lang", "text", F.lit(True).alias("_there"))
    reason = F.when(F.col("_there").isNull(), "NO_FILE").when(F.col("text") == "", "EMPTY").otherwise("OK")
    return fx.table(spark, d, "labels").join(docs, "doc_id", "left").select("doc_id", "quality", "lang", reason.alias("outcome"))


_FILE = """CASE p_partkey % 4 WHEN 0 THEN concat('AC_', p_partkey, '.PV_2024.csv') WHEN 1 THEN concat('m4_AC_', p_partkey, '_trend_resid_2024.csv') WHEN 2 THEN concat('_qwen_AC_', p_partkey, '.csv') ELSE concat('xAC_', p_partkey, '.csv') END"""
_FILES = f"""f AS (SELECT {_FILE} AS file_name, TIMESTAMP '2024-01-01' + INTERVAL (p_partkey % 28) DAY AS modified FROM part UNION ALL SELECT concat('AC_', p_partkey, '_resid.CSV'), TIMESTAMP '2024-02-01' FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT concat('AC_', p_partkey, '.json'), TIMESTAMP '2024-03-01' FROM part)"""


@query(f"""WITH {_FILES}, w AS (SELECT concat('AC_', p_partkey) AS point, CASE WHEN p_partkey % 5 = 0 THEN 'resid' END AS hint FROM part),
  s AS (SELECT point, file_name, modified, coalesce(contains(file_name, hint), false) AS hinted, round(CASE WHEN starts_with(file_name, point) THEN 100 ELSE 0 END + CASE WHEN contains(file_name, '_' || point) THEN 60 ELSE 0 END + 30 + CASE WHEN contains(file_name, hint) THEN 10 ELSE 0 END
      - CASE WHEN starts_with(file_name, '_') THEN 3 ELSE 0 END - CASE WHEN contains(lower(file_name), 'qwen') THEN 5 ELSE 0 END - length(file_name) / 200, 6) AS score FROM w JOIN f ON contains(file_name, point) WHERE lower(file_name) LIKE '%.csv')
  SELECT point, file_name, score FROM s QUALIFY row_number() OVER (PARTITION BY point ORDER BY hinted DESC, score DESC, modified DESC, file_name) = 1""")
def j2_ranked_fuzzy_match(spark, d):
    p = fx.table(spark, d, "part")
    day = lambda t: F.lit(t).cast("timestamp")
    points = p.select(F.expr("concat('AC_', p_partkey)").alias("point"), F.expr("CASE WHEN p_partkey % 5 = 0 THEN 'resid' END").alias("hint"))
    files = p.select(F.expr(_FILE).alias("file_name"), (day("2024-01-01") + F.expr("make_dt_interval(cast(p_partkey % 28 as int))")).alias("modified"))
    files = files.union(p.where("p_partkey % 3 = 0").select(F.expr("concat('AC_', p_partkey, '_resid.CSV')"), day("2024-02-01"))).union(p.select(F.expr("concat('AC_', p_partkey, '.json')"), day("2024-03-01")))
    return mt.best_file(points, files, extensions=(".csv",)).select("point", "file_name", "score")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || doc_id || '.csv' WHEN doc_id % 3 = 1 THEN 'annotations_' || source || doc_id END AS file_name FROM documents""")
def j4_priority_candidate_join(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("annotations_"), F.col("source"), F.col("doc_id"), F.lit(".json")).alias("record"))
    bare = F.concat("source", "doc_id")
    files = docs.where("doc_id % 3 = 0").select(F.concat(bare, F.lit(".csv")).alias("file_name")).union(docs.where("doc_id % 3 < 2").select(F.concat(F.lit("annotations_"), bare)))
    return rv.first_existing(docs, nm.candidate_names(F.col("record")), files, "doc_id").select("doc_id", "file_name")


@query("""SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def j5_queue_with_results(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", "source").join(fx.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def j6_enqueue_only_new(spark, d):
    return rv.enqueued(fx.table(spark, d, "labels"), fx.table(spark, d, "documents").select("doc_id", "source"), "doc_id")


@query("""SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)""")
def j7_approved_only(spark, d):
    approved = fx.table(spark, d, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return fx.table(spark, d, "documents").join(approved, "doc_id", "left_semi").select("doc_id", "lang", "n_chars")


@query("""SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def j15_category_lookup(spark, d):
    n, r = fx.table(spark, d, "nation"), fx.table(spark, d, "region")
    return fx.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("""SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'approved' WHEN quality = 1 THEN 'needs_fix' ELSE 'rejected' END AS status, count(*) AS n FROM labels GROUP BY ROLLUP (CASE WHEN quality = 1 AND toxic = 0 THEN 'approved' WHEN quality = 1 THEN 'needs_fix' ELSE 'rejected' END)""")
def a20_review_stats(spark, d):
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "approved").when(F.col("quality") == 1, "needs_fix").otherwise("rejected")
    return rv.status_counts(fx.table(spark, d, "labels").withColumn("status", status))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE text <> '') AS valid, count(*) FILTER (WHERE text LIKE '%|%') AS warnings, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 4) AS mean FROM documents""")
def a22_dataset_quality(spark, d):
    x = fx.table(spark, d, "documents")
    return x.agg(F.count("*").alias("total"), F.count(F.when(F.col("text") != "", 1)).alias("valid"), F.count(F.when(F.contains("text", F.lit("|")), 1)).alias("warnings"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 4).alias("mean"))


@query("""SELECT lang, CASE WHEN count(DISTINCT source) = 1 THEN min(source) ELSE 'mixed' END AS source, CASE WHEN count(DISTINCT n_chars) = 1 THEN CAST(min(n_chars) AS VARCHAR) ELSE 'var' END AS length FROM documents GROUP BY 1""")
def a25_dataset_summaries(spark, d):
    one = lambda c, other: F.when(F.count_distinct(c) == 1, F.min(c).cast("string")).otherwise(other)
    return fx.table(spark, d, "documents").groupBy("lang").agg(one("source", "mixed").alias("source"), one("n_chars", "var").alias("length"))


@query("""SELECT o_orderpriority AS method, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS success, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, round(sum(o_totalprice), 2) AS total_time, round(avg(o_totalprice), 4) AS mean_time FROM orders GROUP BY 1""")
def a26_run_summary(spark, d):
    is_ = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    return fx.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.count("*").alias("total"), is_("F").alias("success"), is_("P").alias("failed"), F.round(F.sum("o_totalprice"), 2).alias("total_time"), F.round(F.avg("o_totalprice"), 4).alias("mean_time"))


@query(f"""WITH {fx.SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY pos DESC) AS k FROM series)
  SELECT point, max(pos) AS step, arg_max(value, pos) AS loss, least(100, max(pos) // 10) AS progress, list(value ORDER BY pos) FILTER (WHERE k <= 10) AS last FROM r GROUP BY 1""")
def a27_training_progress(spark, d):
    s = fx.event_series(spark, d).withColumn("k", F.row_number().over(W.partitionBy("point").orderBy(F.desc("pos"))))
    last = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 10, F.struct("pos", "value")))), lambda x: x["value"])
    return s.groupBy("point").agg(F.max("pos").alias("step"), F.max_by("value", "pos").alias("loss"), F.least(F.lit(100), F.floor(F.max("pos") / 10)).alias("progress"), last.alias("last"))


@query(f"""WITH {fx.SERIES} SELECT pos, {", ".join(f"max(value) FILTER (WHERE point = '{x}') AS {x}" for x in ("click", "error", "purchase", "signup", "view"))} FROM series GROUP BY 1""")
def a28_multi_run_comparison(spark, d):
    return fx.event_series(spark, d).groupBy("pos").pivot("point").agg(F.max("value"))


@query("""SELECT lang, round(100 * avg(CAST(quality = 1 - toxic AS INTEGER)), 2) AS accuracy, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)""")
def a31_accuracy_by_category(spark, d):
    x = fx.table(spark, d, "labels").join(fx.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rv.rolled_accuracy(x.select("lang", F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("predicted")), "lang")


@query("""SELECT avg(CAST(a > b AS INTEGER)) AS accuracy, count(*) AS n FROM (SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS a, l_extendedprice * 0.95 AS b FROM lineitem)""")
def a33_preference_accuracy(spark, d):
    x = fx.table(spark, d, "lineitem").select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("chosen"), (F.col("l_extendedprice") * F.lit(0.95)).alias("rejected"))
    return x.agg(F.avg((F.col("chosen") > F.col("rejected")).cast("int")).alias("accuracy"), F.count("*").alias("n"))


@query("""SELECT n_nationkey, count(*) AS n, round(min(c_acctbal), 2) AS least, round(max(c_acctbal), 2) AS most FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def a35_per_path_summary(spark, d):
    c = fx.table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return c.join(fx.table(spark, d, "nation").select("n_nationkey"), "n_nationkey").groupBy("n_nationkey").agg(F.count("*").alias("n"), F.round(F.min("c_acctbal"), 2).alias("least"), F.round(F.max("c_acctbal"), 2).alias("most"))


def _results(spark, d):
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("method"))


@query("SELECT o_orderkey AS id, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey LIMIT 50")
def k4_review_top_k(spark, d):
    return rv.sampled(_results(spark, d), "top_k", 50).select("id", "score")


@query("SELECT o_orderkey AS id, o_totalprice AS score FROM orders ORDER BY o_totalprice, o_orderdate DESC, o_orderkey LIMIT 50")
def k4_review_low_score(spark, d):
    return rv.sampled(_results(spark, d), "low_score", 50).select("id", "score")


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def k5_queue_listing(spark, d):
    return rv.sampled(_results(spark, d), "newest", 200).select("id", "created_at")


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def k6_paging(spark, d):
    return rv.page(_results(spark, d).select("id"), 25, 2, "id")


@query("""WITH s AS (SELECT o_orderpriority AS source, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS turn FROM orders), m AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderpriority))
  SELECT source, id, turn FROM s, m WHERE turn <= c""")
def k9_interleave(spark, d):
    x = _results(spark, d).select(F.col("method").alias("source"), "id")
    return rv.interleaved(x, "source", "id").select("source", "id", "turn")


@query("""SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, quality, 9 AS toxic FROM labels WHERE doc_id % 2 = 1""")
def u5_append_or_replace(spark, d):
    old = fx.table(spark, d, "labels")
    return rv.upserted(old, old.where("doc_id % 2 = 1").withColumn("toxic", F.lit(9)), "doc_id")


@query("SELECT DISTINCT source FROM documents WHERE lang = 'en' EXCEPT SELECT source FROM documents WHERE n_chars > 15000")
def u4_stale_names(spark, d):
    x = fx.table(spark, d, "documents")
    return x.where("lang = 'en'").select("source").subtract(x.where("n_chars > 15000").select("source"))


@query("""SELECT conv_id, count(*) AS n_turns, string_agg(CASE WHEN role = 'user' THEN '<ts><ts/>' || length(text) ELSE role END, '|' ORDER BY turn) AS prompt FROM conversations GROUP BY 1""")
def x8_prompt_fill(spark, d):
    part = F.when(F.col("role") == "user", F.concat(F.replace(F.lit("<image>"), F.lit("<image>"), F.lit("<ts><ts/>")), F.length("text").cast("string"))).otherwise(F.col("role"))
    x = fx.table(spark, d, "conversations").select("conv_id", "turn", part.alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "p"))), lambda s: s["p"]), "|")
    return x.groupBy("conv_id").agg(F.count("*").alias("n_turns"), joined.alias("prompt"))


@query(f"""WITH {fx.SEGMENTS} SELECT point, seg_id, CASE WHEN start_pos = end_pos THEN greatest(0, start_pos - 5) ELSE start_pos END AS start_pos, CASE WHEN start_pos = end_pos THEN end_pos + 5 ELSE end_pos END AS end_pos FROM segments""")
def x9_widen_single_rows(spark, d):
    a, b = nm.widened(F.col("start_pos"), F.col("end_pos"))
    return fx.segment_table(spark, d).select("point", "seg_id", a.alias("start_pos"), b.alias("end_pos"))


@query(f"""WITH {fx.SEGMENTS} SELECT point, count(*) AS n, string_agg('[' || start_pos || ',' || end_pos || ']', ',' ORDER BY start_pos) AS segments FROM segments GROUP BY 1""")
def c25_pre_annotation(spark, d):
    g = fx.segment_table(spark, d)
    text = F.transform(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos"))), lambda s: F.concat(F.lit("["), s["start_pos"], F.lit(","), s["end_pos"], F.lit("]")))
    return g.groupBy("point").agg(F.count("*").alias("n"), F.array_join(text, ",").alias("segments"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def x11_parse_json(spark, d):
    return fx.table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' GROUP BY 1""")
def s1_point_range_scan(spark, d):
    e = fx.table(spark, d, "events").where(F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz")))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
