"""Annotation records, conversation samples and text measures."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ANOMALY = "array<struct<interval:array<int>,type:string,reason:string>>"


def parsed_anomalies(text: Column) -> Column:
    """Detected anomalies of one JSON object, or of several joined by commas; empty where it cannot be read."""
    objects = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<status:string,detected_anomalies:{ANOMALY}>>")
    return F.coalesce(F.flatten(F.transform(objects, lambda o: F.coalesce(o["detected_anomalies"], F.array().cast(ANOMALY)))), F.array().cast(ANOMALY))


def conversation(point: Column, segments: Column) -> Column:
    """Answer text: one JSON object for each [start, end] of segments, joined by commas; one of no anomaly if none."""
    one = lambda s: F.to_json(F.struct(F.lit("success").alias("status"), F.array(F.struct(F.array(s["start_pos"], s["end_pos"]).alias("interval"), point.alias("type"))).alias("detected_anomalies")))
    none = F.lit('{"status":"success","detected_anomalies":[]}')
    return F.when(F.size(segments) > 0, F.array_join(F.transform(segments, one), ",")).otherwise(none)


def merged_records(records: DataFrame, key: str, order: str) -> DataFrame:
    """Anomalies of all records of a key, the first of each interval, by start; rows (key, order, interval, type)."""
    start, end = F.col("interval")[0], F.col("interval")[1]
    k = F.row_number().over(W.partitionBy(key, start, end).orderBy(order))
    kept = records.withColumn("_k", k).where("_k = 1")
    item = F.struct(start.alias("start"), end.alias("end"), F.col("type").alias("type"))
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("anomalies"))


def one_sample_each(samples: DataFrame, anomalies: str) -> DataFrame:
    """A row for each anomaly of a sample; samples of none or one stay as they are."""
    return samples.select("*", F.explode_outer(anomalies).alias("anomaly"))


def ngram_overlap(pairs: DataFrame, key: str, prediction: str, label: str, n: int) -> DataFrame:
    """Clipped count of common word n-grams, and F measure, of each pair."""

    def grams(c: str) -> DataFrame:
        words = F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
        w = pairs.select(key, words.alias("w")).where(F.size("w") >= n)
        g = w.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))).alias("g"))
        return g.groupBy(key, "g").agg(F.count("*").alias("c"))

    p, t = grams(prediction), grams(label)
    sizes = pairs.select(key).join(p.groupBy(key).agg(F.sum("c").alias("n_pred")), key, "left").join(t.groupBy(key).agg(F.sum("c").alias("n_label")), key, "left")
    common = p.join(t.withColumnRenamed("c", "c2"), [key, "g"]).groupBy(key).agg(F.sum(F.least("c", "c2")).alias("common"))
    out = sizes.join(common, key, "left").fillna(0, ["n_pred", "n_label", "common"])
    total = F.col("n_pred") + F.col("n_label")
    return out.withColumn("f", F.when(total > 0, 2 * F.col("common") / total).otherwise(0.0))


def bleu(pairs: DataFrame, key: str, prediction: str, label: str, orders: int = 4) -> DataFrame:
    """(key, bleu): character BLEU of each pair up to a length of n-grams, in percent to four digits.

    Precisions are clipped counts over the prediction's n-grams (at least 1); the k-th precision of zero counts as 1 over
    2**k of those; a prediction shorter than its label is scaled by exp(1 - label / prediction). A pair without a common
    character, or with a null or empty text, scores 0. Grams are counted row by row and never leave their pair."""

    @F.pandas_udf("array<long>")
    def common(prediction: pd.Series, label: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(prediction, label):
            a, b = a or "", b or ""
            row = []
            for n in range(1, orders + 1):
                x, y = (Counter([c[i : i + n] for i in range(len(c) - n + 1)]) for c in (a, b))
                row.append(sum(min(k, y[g]) for g, k in x.items() if g in y))
            out.append(row)
        return pd.Series(out, index=prediction.index, dtype=object)

    p, t = F.length(F.coalesce(prediction, F.lit(""))), F.length(F.coalesce(label, F.lit("")))
    d = pairs.select(key, p.alias("p"), t.alias("t"), common(F.col(prediction), F.col(label)).alias("m"))
    d = d.select(key, "p", "t", *[F.col("m")[n - 1].alias(f"m{n}") for n in range(1, orders + 1)])
    logs, zeros = F.lit(0.0), F.lit(0)
    for n in range(1, orders + 1):
        size, none = F.greatest(F.col("p") - n + 1, F.lit(1)), F.col(f"m{n}") == 0
        zeros = zeros + none.cast("int")
        logs = logs + F.log(F.when(none, 1 / (F.pow(F.lit(2.0), zeros) * size)).otherwise(F.col(f"m{n}") / size)) / orders
    short = F.when(F.col("p") > F.col("t"), 1.0).otherwise(F.exp(1 - F.col("t") / F.col("p")))
    return d.select(key, F.when(F.col("m1") > 0, F.round(100 * short * F.exp(logs), 4)).otherwise(0.0).alias("bleu"))
