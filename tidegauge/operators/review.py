"""Review queues, sampling, run summaries, listings and training-set building."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def sampled(results: DataFrame, strategy: str, k: int, score: str = "score", newest: str = "created_at", seed: int = 7) -> DataFrame:
    """top_k, low_score, newest or random rows; ties by the newest, then the id."""
    orders = {"top_k": [F.desc(score), F.desc(newest), F.asc("id")], "low_score": [F.asc(score), F.desc(newest), F.asc("id")], "newest": [F.desc(newest), F.asc("id")], "random": [F.xxhash64("id", F.lit(seed)), F.asc("id")]}
    return results.orderBy(*orders[strategy]).limit(k)


def enqueued(queue: DataFrame, candidates: DataFrame, *keys: str) -> DataFrame:
    """Candidates that are not in the queue yet."""
    return candidates.join(queue.select(*keys).distinct(), list(keys), "left_anti")


def status_counts(queue: DataFrame, status: str = "status") -> DataFrame:
    """Rows of each status and in all (null status)."""
    return queue.rollup(status).agg(F.count("*").alias("n"))


def page(df: DataFrame, size: int, number: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).offset(size * number).limit(size)


def upserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """New rows, and the old ones whose keys they do not have."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def first_existing(records: DataFrame, candidates: Column, inventory: DataFrame, key: str, name: str = "file_name") -> DataFrame:
    """For each record the first of its candidate names that the inventory has."""
    spread = records.select("*", F.posexplode(candidates).alias("_rank", name))
    found = spread.join(inventory.select(name).distinct(), name, "left_semi").groupBy(key).agg(F.min_by(name, "_rank").alias(name))
    return records.join(found, key, "left")


def hash_split(df: DataFrame, key: str, parts: int, held: int = 0) -> DataFrame:
    """df with `split`: validation where the remainder of crc32(key) is `held`, else train."""
    r = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))
    return df.withColumn("split", F.when(r == held, "validation").otherwise("train"))


def support_sample(df: DataFrame, subject: str, key: str, shots: int, seed: int = 7) -> DataFrame:
    """`shots` rows of each subject with their number k, those of the smallest hashes of key and seed; a null subject is one too."""
    order = F.xxhash64(key, F.lit(seed))
    first = F.slice(F.sort_array(F.collect_list(F.struct(order.alias("h"), F.col(key).alias("key")))), 1, shots)
    # hashes of a part of a subject first, so that no task gathers a large one
    part = F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(1024))
    parts = df.select(F.col(subject).alias("subject"), F.col(key)).groupBy("subject", part.alias("part")).agg(first.alias("x"))
    best = parts.groupBy("subject").agg(F.slice(F.sort_array(F.flatten(F.collect_list("x"))), 1, shots).alias("x"))
    return best.select(F.col("subject").alias(subject), F.posexplode("x").alias("k", "x")).select(F.col("x.key").alias(key), subject, (F.col("k") + 1).alias("k"))


def interleaved(df: DataFrame, source: str, order: str, over: bool = False) -> DataFrame:
    """Rows of the sources in turn, each cut at the size of the smallest, or with `over` repeated up to that of the largest."""
    ranked = df.withColumn("_k", F.row_number().over(W.partitionBy(source).orderBy(order)))
    sizes = df.groupBy(source).count()
    if not over:
        ends = sizes.agg(F.min("count").alias("_least"))
        return ranked.crossJoin(F.broadcast(ends)).where("_k <= _least").withColumn("turn", F.col("_k")).drop("_k", "_least")
    ends = sizes.select(F.col(source).alias("_s"), F.col("count").alias("_n")).crossJoin(F.broadcast(sizes.agg(F.max("count").alias("_most"))))
    ranked = ranked.join(ends, F.col(source).eqNullSafe(F.col("_s")))
    # a row comes back every _n turns; blocks of rounds keep the exploded arrays small
    blocks = ranked.withColumn("_rounds", F.expr("(_most - _k) div _n")).withColumn("_b", F.explode(F.expr("sequence(0L, _rounds div 1000)")))
    turns = F.explode(F.expr("transform(sequence(_b * 1000, least(_rounds, _b * 1000 + 999)), r -> _k + r * _n)"))
    return blocks.withColumn("turn", turns).drop("_k", "_s", "_n", "_most", "_rounds", "_b")


def rolled_accuracy(answers: DataFrame, category: str) -> DataFrame:
    """Percent correct of each category and on average, to two places."""
    hit = F.round(100 * F.avg((F.col("predicted") == F.col("truth")).cast("int")), 2)
    return answers.rollup(category).agg(hit.alias("accuracy"), F.count("*").alias("n"))


def smoothed(log: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """Exponential mean of each run's values; the weight grows with the length of the run. A run's log is bounded, so it
    goes to one task."""
    kinds = {f.name: f.dataType.simpleString() for f in log.schema.fields}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(step)
        w = 1.8 * (1 / (1 + np.exp(-0.05 * len(pdf))) - 0.5)
        return pd.DataFrame({run: pdf[run], step: pdf[step], "smooth": pdf[value].ewm(alpha=1 - w, adjust=False).mean()})

    return log.select(run, step, value).groupBy(run).applyInPandas(one, f"{run} {kinds[run]}, {step} {kinds[step]}, smooth double")


def step_timing(log: DataFrame, run: str, ts: str, tokens: str, total: int) -> DataFrame:
    """Mean time of a step, time left to `total` steps, percentage done, and tokens a second of each run."""
    t = log.groupBy(run).agg(F.count("*").alias("n"), ((F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1e6).alias("s"), F.sum(tokens).alias("v"))
    mean = F.col("s") / F.when(F.col("n") > 1, F.col("n") - 1)
    return t.select(run, F.round(mean, 6).alias("step_seconds"), F.round(mean * (total - F.col("n")), 3).alias("remaining"), F.round(F.col("n") / total * 100, 2).alias("percentage"), F.round(F.col("v") / F.when(F.col("s") > 0, F.col("s")), 6).alias("per_second"))


def token_accuracy(rows: DataFrame, ignore: int = -100) -> DataFrame:
    """Mean over rows (preds, labels) of the share of labels that the prediction one place before gives; ignored labels
    do not count, nor rows without others."""
    pairs = F.arrays_zip(F.expr("slice(preds, 1, size(preds) - 1)").alias("p"), F.expr("slice(labels, 2, size(labels) - 1)").alias("l"))
    known = rows.where("size(preds) > 1").select(F.filter(pairs, lambda x: x["l"] != ignore).alias("k")).where("size(k) > 0")
    own = F.size(F.filter("k", lambda x: x["p"] == x["l"])) / F.size("k")
    return known.agg(F.avg(own).alias("accuracy"), F.count("*").alias("n"))
