"""Queries that write files and tables, write them again and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import names as nm
from tidegauge.operators import review as rv
from tidegauge.operators import stores as st
from tidegauge.plans import fixtures as fx
from tidegauge.plans.registry import query
from tidegauge.sources import files
from tidegauge.sources.scratch import scratch_path


@query("""SELECT layout, count(*) AS n, count(v) AS n_values, round(sum(v), 4) AS total, date_trunc('second', min(ts)) AS first_ts FROM (
    SELECT ts, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS layout, CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 11 <> 0 THEN value END WHEN 1 THEN event_id ELSE user_id END AS v FROM events) GROUP BY 1""")
def s3_s4_series_files(spark, d):
    """Three layouts in one read: a value column with unreadable values, a time column at the end, and a stamp in front."""
    root = scratch_path(spark, "series")
    e = fx.table(spark, d, "events").withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    value = F.when(F.col("event_id") % 11 == 0, "bad").otherwise(F.col("value").cast("string"))
    layouts = {
        "a": [F.col("at").alias("date"), F.lit("x").alias("other"), value.alias("value")],
        "b": [F.lit("p, q").alias("name"), F.col("event_id").alias("level"), F.col("at").alias("Time")],
        "c": [F.col("at").alias("stamp"), F.col("user_id").alias("first"), F.col("event_id").alias("second")],
    }
    for k, (name, columns) in enumerate(layouts.items()):
        e.where(F.col("event_id") % 3 == k).select(*columns).write.option("header", True).csv(f"{root}/{name}")
    rows = files.series_files(spark, f"{root}/*", numeric=True).withColumn("layout", F.regexp_extract("file", r"/([abc])/[^/]*$", 1))
    return rows.groupBy("layout").agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first_ts"))


@query("""SELECT s_suppkey AS record, s_suppkey % 7 <> 0 AS readable, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 3 ELSE 0 END AS n, CASE WHEN s_suppkey % 7 <> 0 THEN s_name || '.csv' END AS filename FROM supplier""")
def s7_annotation_folder(spark, d):
    """A JSON file for each record; those of every seventh are cut off and stay in the result as unreadable."""
    path = scratch_path(spark, "annotations")
    spans = F.expr("transform(filter(array(1, 2), i -> i <= s_suppkey % 3), i -> named_struct('start', i, 'end', i + s_nationkey, 'label', s_name))")
    text = F.to_json(F.struct(F.concat("s_name", F.lit(".csv")).alias("filename"), spans.alias("annotations")))
    s = fx.table(spark, d, "supplier").withColumn("t", text)
    cut = F.when(F.col("s_suppkey") % 7 == 0, F.expr("substring(t, 1, length(t) - 5)")).otherwise(F.col("t"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-s.count() // 2000))  # a file costs time, so no task writes many
    s.select(F.col("s_suppkey").alias("record"), cut.alias("text")).repartition(tasks, "record").write.partitionBy("record").text(path)
    read = files.annotation_folder(spark, f"{path}/*", "filename string, annotations array<struct<start: long, end: long, label: string>>")
    good = F.col("_corrupt_record").isNull()
    n = F.when(good, F.coalesce(F.size("annotations"), F.lit(0))).otherwise(0).cast("long")
    return read.select(F.regexp_extract("file", r"record=(\d+)/", 1).cast("long").alias("record"), good.alias("readable"), n.alias("n"), F.when(good, F.col("filename")).alias("filename"))


@query("""SELECT doc_id, length(text) AS n, md5(text) AS digest FROM documents WHERE doc_id % 7 <> 0""")
def s8_s9_json_lines(spark, d):
    """Lines with blank and broken ones among them, read, written and read again."""
    first, second = scratch_path(spark, "lines"), scratch_path(spark, "lines")
    whole = F.to_json(F.struct("doc_id", "text"))
    line = F.when(F.col("doc_id") % 7 == 0, F.substring(whole, 1, 10)).otherwise(whole)
    lines = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(""), line)).otherwise(F.array(line))
    fx.table(spark, d, "documents").select(F.explode(lines)).write.text(first)
    files.sink_json_lines(files.json_lines(spark, first, "doc_id long, text string"), second)
    again = files.json_lines(spark, second, "doc_id long, text string")
    return again.select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query(f"""WITH {fx.MASKED}, n AS (SELECT count(*) FILTER (WHERE point IN ('click', 'view')) AS a, count(*) AS b FROM masked)
  SELECT m.method, point, count(*) AS n_rows, sum(mask)::BIGINT AS n_masked, round(sum(CAST(value AS FLOAT)::DOUBLE), 3) AS total, any_value(a) AS first_run, any_value(b - a) AS second_run, 0 AS third_run
  FROM masked, n, (SELECT unnest(['all', 'sampled']) AS method) m WHERE m.method = 'all' OR pos % 7 = 0 GROUP BY 1, 2""")
def s10_written_results(spark, d):
    """Results of two points, then of all, then of all again, and those of another method at sampled rows alone."""
    path = scratch_path(spark, "results")
    s = fx.masked_series(spark, d).select("point", "pos", "value", F.col("mask").alias("outlier_mask"), F.lit("all").alias("method"))
    runs = [st.write_results(x, path) for x in (s.where("point in ('click', 'view')"), s, s)]
    sampled = s.where("pos % 7 = 0").select("point", F.col("pos").alias("orig_pos"))
    for _ in range(2):
        st.write_results(s.withColumn("method", F.lit("sampled")), path, sampled)
    out = spark.read.parquet(path).groupBy("method", "point")
    counted = out.agg(F.count("*").alias("n_rows"), F.sum("outlier_mask").alias("n_masked"), F.round(F.sum(F.col("value").cast("double")), 3).alias("total"))
    return counted.select("*", *[F.lit(n).cast("long").alias(name) for n, name in zip(runs, ("first_run", "second_run", "third_run"))])


@query(f"""WITH {fx.SEGMENTS}, s AS (SELECT point, seg_id, (end_pos - start_pos + 1)::DOUBLE AS score, max(end_pos - start_pos + 1) OVER (PARTITION BY point) AS most FROM segments)
  SELECT point, CASE WHEN most >= 3 THEN 2 ELSE 1 END AS run, count(*) AS segment_count, round(pow(avg(pow(score, 5)), 0.2), 6) AS score_avg, max(score) AS score_max, sum(seg_id)::BIGINT AS ids FROM s WHERE most < 3 OR score >= 3 GROUP BY 1, 2""")
def s11_written_evaluation(spark, d):
    """Two runs, the second with the longer segments alone and written twice; points that it lacks keep the first."""
    path = scratch_path(spark, "evaluation")
    segments = fx.segment_table(spark, d).withColumn("score", (F.col("end_pos") - F.col("start_pos") + 1).cast("double"))
    for run, least in ((1, 1), (2, 3), (2, 3)):
        st.write_evaluation(segments.where(F.col("score") >= least), path, "nsigma", run)
    metrics, rows = st.stored_evaluation(spark, path)
    ids = rows.groupBy("inference_id").agg(F.sum("seg_id").alias("ids"))
    return metrics.join(ids, "inference_id").select("point", "run", "segment_count", F.round("score_avg", 6).alias("score_avg"), "score_max", "ids")


_FILE = """concat('m4_', CASE doc_id % 7 WHEN 0 THEN 'QWEN_chatts_' WHEN 1 THEN '_chatts_' WHEN 2 THEN 'timer_' WHEN 3 THEN 'adtk_hbos_' WHEN 4 THEN 'ensemble_' ELSE '' END, doc_id, CASE doc_id % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.XLSX' ELSE '.json' END)"""


@query(f"""WITH f AS (SELECT doc_id, doc_id % 20 AS dir, {_FILE} AS name, n_chars AS size FROM documents),
  k AS (SELECT doc_id, dir, name, size FROM f WHERE dir >= 10 AND doc_id % 2 = 0 UNION ALL SELECT doc_id, dir, name, size + 1 FROM f WHERE dir < 10 AND dir <> 4 AND doc_id % 4 <> 0)
  SELECT concat('/data/', dir, '/', name) AS path, CASE doc_id % 7 WHEN 0 THEN 'qwen' WHEN 1 THEN 'chatts' WHEN 2 THEN 'timer' WHEN 3 THEN 'adtk_hbos' WHEN 4 THEN 'ensemble' END AS method, size AS size_bytes FROM k WHERE doc_id % 3 < 2""")
def s12_synced_files(spark, d):
    """A file table synced over twenty folders, then twice over half of them with files gone, changed and a folder emptied."""
    path = scratch_path(spark, "files")
    dir_path = F.concat(F.lit("/data/"), F.col("doc_id") % 20)
    docs = fx.table(spark, d, "documents").withColumn("dir_path", dir_path).withColumn("file_name", F.expr(_FILE))
    found = docs.select("doc_id", F.concat("dir_path", F.lit("/"), "file_name").alias("path"), "file_name", F.col("n_chars").alias("size_bytes"), F.lit("2024-01-01").cast("timestamp").alias("modified"))
    folders = spark.range(20).select(F.concat(F.lit("/data/"), F.col("id")).alias("dir_path"))
    st.sync_files(found.where("doc_id % 2 = 0"), folders, path)
    now = found.where("doc_id % 4 <> 0 and doc_id % 20 <> 4").withColumn("size_bytes", F.col("size_bytes") + 1)
    for _ in range(2):
        st.sync_files(now, folders.where("cast(substring(dir_path, 7) as int) < 10"), path)
    return st.registered_files(spark, path).select("path", "method", "size_bytes")


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'chatts' WHEN 1 THEN 'adtk_hbos' WHEN 2 THEN '' WHEN 3 THEN '' WHEN 4 THEN '' ELSE 'timer' END AS method FROM pages""")
def p6_inference_method(spark, d):
    """Known and unknown methods, paths without the folder, paths that end in it and two such folders."""
    kinds = ["/data/inference/ChatTS/x.csv", "data/inference/adtk_hbos/2024/x.csv", "/data/inference/other/x.csv", "/data/results/qwen/x.csv", "/data/inference", "/inference/Timer/inference/qwen/x.csv"]
    path = F.element_at(F.array(*map(F.lit, kinds)), (F.col("page_id") % 6 + 1).cast("int"))
    return fx.table(spark, d, "pages").select("page_id", nm.method_from_path(path).alias("method"))


@query("""WITH s AS (SELECT o_orderpriority AS source, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WHERE o_orderpriority <> '5-LOW' OR o_orderkey % 3 = 0)
  SELECT source, id, unnest(generate_series(k, (SELECT max(n) FROM s), n)) AS turn FROM s""")
def k9_interleave_over(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("id"))
    return rv.interleaved(o.where("source <> '5-LOW' or id % 3 = 0"), "source", "id", over=True)
