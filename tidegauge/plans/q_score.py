"""Queries of scoring, evaluation and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.operators import score as sc
from tidegauge.plans import fixtures as fx
from tidegauge.plans.q_features import rounded
from tidegauge.plans.registry import query


@query()
def a11_segment_scores(spark, d):
    s = fx.event_series(spark, d)
    return sc.scored_segments(s, s.where("value > 200"))


@query()
def c23_score_summary(spark, d):
    s = fx.event_series(spark, d)
    return sc.score_summary(sc.scored_segments(s, s.where("value > 200")), "point")


@query(f"""WITH {fx.SEGMENTS} SELECT point, round(pow(avg(pow(abs(v), 5)), 0.2), 5) AS score_avg, max(v) AS score_max, min(v) AS score_min, quantile_cont(v, 0.5) AS score_p50, count(*) AS segment_count
  FROM (SELECT point, CAST(end_pos - start_pos + 1 AS DOUBLE) AS v FROM segments) GROUP BY 1""")
def a12_score_summary(spark, d):
    g = fx.segment_table(spark, d).withColumn("score", (F.col("end_pos") - F.col("start_pos") + 1).cast("double"))
    return rounded(sc.score_summary(g, "point"), 5, "score_avg")


@query("""SELECT user_id, round(exp(-exp(2 - value / 50)), 6) AS squashed, round(CASE WHEN 1 + 25 * f - 25 * f * f > 0 THEN (ln(1 + 25 * f - 25 * f * f) / (1 + 5 * f) - 1) / 5 + f / 2 END, 6) AS weight, event_id
  FROM (SELECT *, (event_id % 100) / 100.0::DOUBLE AS f FROM events)""")
def x1_x2_score_scalars(spark, d):
    f = (F.col("event_id") % 100) / F.lit(100.0)
    return fx.table(spark, d, "events").select("user_id", F.round(sc.squash(F.col("value") / 50), 6).alias("squashed"), F.round(sc.blend_weight(f), 6).alias("weight"), "event_id")


_LF = "exp(-exp(2 - (l + r) / 2))"
_P0 = "exp(-exp(2 + ln(p + 1e-12)))"
_WX = f"abs({_LF} - {_P0})"


@query(f"""WITH x AS (SELECT event_id, (event_id % 97) / 97.0::DOUBLE AS p, coalesce(CASE WHEN event_id % 5 > 0 THEN value / 40 END, (event_id % 11) / 3.0::DOUBLE) AS l, (event_id % 11) / 3.0::DOUBLE AS r FROM events),
  w AS (SELECT *, {_LF} AS lf, {_P0} AS p0, {_WX} AS x FROM x), b AS (SELECT *, coalesce(CASE WHEN 1 + 25 * x - 25 * x * x > 0 THEN (ln(1 + 25 * x - 25 * x * x) / (1 + 5 * x) - 1) / 5 + x / 2 END, 0) AS w FROM w)
  SELECT event_id, round(10 * ln(1 + exp((100 - 1e-3) * (lf * (1 - w) + p0 * w) / 10)), 2) AS score FROM b""")
def x3_softplus_score(spark, d):
    p, r = (F.col("event_id") % 97) / F.lit(97.0), (F.col("event_id") % 11) / F.lit(3.0)
    left = F.when(F.col("event_id") % 5 > 0, F.col("value") / 40)
    return fx.table(spark, d, "events").select("event_id", sc.softplus_score(p, left, r).alias("score"))


_CONF = f"""{fx.SEGMENTS}, x AS (SELECT m.point, m.pos, value > 100 AS t, EXISTS (SELECT 1 FROM segments s WHERE s.point = m.point AND m.pos BETWEEN s.start_pos AND s.end_pos) AS p FROM series m),
  cf AS (SELECT point, CAST(count(*) FILTER (WHERE t AND p) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE NOT t AND p) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE t AND NOT p) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE NOT t AND NOT p) AS DOUBLE) AS tn FROM x GROUP BY 1)"""


def _confusion(spark, d):
    from tidegauge.operators.core import mask_from_segments

    s = fx.event_series(spark, d)
    return sc.confusion(s, s.withColumn("mask", (F.col("value") > 100).cast("int")), mask_from_segments(s, fx.segment_table(spark, d)))


@query(f"WITH {_CONF} SELECT point, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn FROM cf")
def a13_confusion(spark, d):
    return _confusion(spark, d)


@query(f"""WITH {_CONF}, b AS (SELECT *, tp / (tp + fp) AS pr, tp / (tp + fn) AS re, tn / (tn + fp) AS sp, tn / (tn + fn) AS np, tp + fp + fn + tn AS n FROM cf),
  k AS (SELECT *, (tp + tn) / n AS ac, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS ch, CASE WHEN (tp + fn) / n < 0.01 THEN 0.8 WHEN (tp + fn) / n < 0.05 THEN 0.7 ELSE 0.6 END AS w FROM b)
  SELECT point, round(pr, 3) AS precision, round(re, 3) AS recall, round(sp, 3) AS specificity, round(np, 3) AS npv, round(2 * pr * re / (pr + re), 3) AS f1, round(5 * pr * re / (4 * pr + re), 3) AS f2, round(1.25 * pr * re / (0.25 * pr + re), 3) AS f05,
    round((re + sp) / 2, 3) AS balanced_accuracy, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 3) AS mcc, round(sqrt(pr * re), 3) AS g_mean, round((ac - ch) / (1 - ch), 3) AS kappa, round(tp / (tp + fp + fn), 3) AS jaccard,
    round(2 * tp / (2 * tp + fp + fn), 3) AS dice, round(tp / least(tp + fp, tp + fn), 3) AS overlap, round(ac, 3) AS accuracy, round(fp / (fp + tn), 3) AS far, round(fn / (fn + tp), 3) AS mar, round(1 / (w / re + (1 - w) / sp), 3) AS harmonic_accuracy FROM k""")
def a14_derived_metrics(spark, d):
    return sc.derived_metrics(_confusion(spark, d)).drop("tp", "fp", "fn", "tn")


@query("""SELECT avg(CAST(quality = CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS INTEGER)) AS accuracy, count(*) AS n FROM labels""")
def a16_label_accuracy(spark, d):
    pairs = fx.table(spark, d, "labels").select(F.col("quality").alias("truth"), F.when(F.col("toxic") == 1, 0).otherwise(1).alias("predicted"))
    return sc.evaluate(pairs, "simple_accuracy")


@query(f"""WITH {fx.SERIES}, x AS (SELECT point, CAST(value > 100 AS INTEGER) AS a, CAST(value > 120 AND pos % 3 > 0 OR value < 1 AS INTEGER) AS b FROM series)
  SELECT point, sum(a) AS count_a, sum(b) AS count_b, round(avg(a), 6) AS ratio_a, round(avg(b), 6) AS ratio_b, round(avg(CAST(a = b AS INTEGER)), 6) AS agreement, count(*) FILTER (WHERE a = 1 AND b = 0) AS only_a, count(*) FILTER (WHERE a = 0 AND b = 1) AS only_b FROM x GROUP BY 1""")
def a17_mask_agreement(spark, d):
    s = fx.event_series(spark, d)
    a = s.withColumn("mask", (F.col("value") > 100).cast("int"))
    b = s.withColumn("mask", (((F.col("value") > 120) & (F.col("pos") % 3 > 0)) | (F.col("value") < 1)).cast("int"))
    return rounded(sc.agreement(a, b), 6, "ratio_a", "ratio_b", "agreement")


@query("""WITH m AS (SELECT event_type, ts, CAST(value > 100 AS INTEGER) AS mask FROM events), b AS (SELECT event_type, CAST(ceil(epoch_us(ts) / 21600000000.0) AS BIGINT) * 6 AS bucket_hour, mask FROM m)
  SELECT bucket_hour, round(avg(mask) FILTER (WHERE event_type = 'click'), 6) AS click, round(avg(mask) FILTER (WHERE event_type = 'error'), 6) AS error, round(avg(mask) FILTER (WHERE event_type = 'view'), 6) AS view FROM b GROUP BY 1""")
def a18_heatmap_pivot(spark, d):
    from tidegauge.operators.core import micros

    m = fx.table(spark, d, "events").select("event_type", (F.ceil(micros("ts") / 21_600_000_000) * 6).alias("bucket_hour"), (F.col("value") > 100).cast("int").alias("mask"))
    return rounded(m.groupBy("bucket_hour").pivot("event_type", ["click", "error", "view"]).agg(F.avg("mask")), 6, "click", "error", "view")


@query("""WITH x AS (SELECT event_type AS point, date_trunc('day', ts) AS bucket, max(CAST(value > 150 AS INTEGER)) AS a, max(CAST(value > 170 AS INTEGER)) AS b FROM events GROUP BY 1, 2)
  SELECT point, bucket, a + 2 * b AS code FROM x WHERE a + b > 0""")
def j14_heatmap_comparison(spark, d):
    e = fx.table(spark, d, "events").select(F.col("event_type").alias("point"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("bucket"), "value")
    a = e.where("value > 150").select("point", "bucket").distinct().withColumn("a", F.lit(1))
    b = e.where("value > 170").select("point", "bucket").distinct().withColumn("b", F.lit(1))
    return a.join(b, ["point", "bucket"], "full").select("point", "bucket", (F.coalesce("a", F.lit(0)) + 2 * F.coalesce("b", F.lit(0))).alias("code"))


@query("""WITH m AS (SELECT event_type, props, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, arg_min(props, (-n, props)) AS props, max(n) AS n FROM m GROUP BY 1""")
def j16_largest_method(spark, d):
    m = fx.table(spark, d, "events").groupBy("event_type", "props").agg(F.count("*").alias("n"))
    k = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("n"), "props"))
    return m.withColumn("k", k).where("k = 1").select("event_type", "props", "n")
