"""File inventories, dataset registries, result sinks and column roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: How names of generated files begin, and what marks them elsewhere.
GENERATED_PREFIXES = ("global_chatts_", "chatts_", "_chatts_", "timer_", "adtk_hbos_", "ensemble_", "_qwen", "qwen_")
GENERATED_MARK = "_trend_resid"
#: The keyword that result names of a method must have or, for the first, must not have.
RESULT_KEYWORDS = {"chatts": ("qwen", False), "qwen": ("qwen", True), "timer": ("timer", True)}


def is_generated(name: Column) -> Column:
    low = F.lower(name)
    out = F.contains(low, F.lit(GENERATED_MARK))
    for prefix in GENERATED_PREFIXES:
        out |= F.startswith(low, F.lit(prefix))
    return out


def is_result_of(name: Column, method: str) -> Column:
    if method.lower() not in RESULT_KEYWORDS:
        return F.lit(True)
    word, wanted = RESULT_KEYWORDS[method.lower()]
    return F.contains(F.lower(name), F.lit(word)) == wanted


def datasets(files: DataFrame, limit: int = 50) -> DataFrame:
    """Input files (name, mtime), newest first."""
    return files.where(~is_generated(F.col("name"))).orderBy(F.desc("mtime"), "name").limit(limit)


def snapshot_changes(before: DataFrame, now: DataFrame, key: str, *values: str) -> DataFrame:
    """(key, change) of two inventories: new, gone, changed or same."""
    a, b = (x.select(key, F.struct(*values).alias(n)) for x, n in ((before, "_a"), (now, "_b")))
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, change.alias("change"))


def preview(df: DataFrame, order: str, size: int, number: int = 0) -> DataFrame:
    """A page of rows without index and category columns."""
    keep = [c for c in df.columns if not c.startswith(("Unnamed", "category"))]
    k = F.row_number().over(W.orderBy(order))
    first = df.orderBy(order).limit(size * (number + 1))  # the page's rows and those before, so the window is small
    return first.withColumn("_k", k).where(F.col("_k") > size * number).select(*keep)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def column_roles(df: DataFrame, most_kinds: int = 10) -> dict[str, str | None]:
    """time, value, series and label column: the first datetime-like, numeric, and low-cardinality text column, and the
    next text column. One aggregation counts the values of all text columns."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    looks = df.limit(5).select(*[F.try_to_timestamp(c).alias(c) for c in texts]).collect() if texts and not times else []
    times += [c for c in texts if looks and all(r[c] is not None for r in looks)]
    texts = [c for c in texts if c not in times]
    kinds = df.agg(*[F.approx_count_distinct(c).alias(c) for c in texts]).first().asDict() if texts else {}
    series = next((c for c in texts if kinds[c] <= most_kinds), None)
    label = next((c for c in texts[texts.index(series) + 1 :]), None) if series else None
    numbers = [c for c in numeric_columns(df) if c not in times]
    return {"time": next(iter(times), None), "value": next(iter(numbers), None), "series": series, "label": label}


def pick_mask(columns: list[str], task: str) -> str | None:
    """The mask column to use: the global one, the task's, the outliers', else any that is no cluster's."""
    for name in ("global_mask", f"{task}_mask", "outlier_mask"):
        if name in columns:
            return name
    return next((c for c in columns if c.endswith("_mask") and not c.endswith("_mask_cluster")), None)


def record_layout(text: Column) -> Column:
    """How a training file is laid out, from its first 1024 characters."""
    head = F.substring(text, 1, 1024)
    has = lambda key: F.contains(head, F.lit(f'"{key}"'))
    return F.when(has("conversations"), "sharegpt").when(has("messages"), "openai").when(has("instruction") | has("input"), "alpaca").otherwise("unknown")


def registry_status(registry: DataFrame, inventory: DataFrame) -> DataFrame:
    """(dataset, status): unregistered names come from `wanted`, rows (dataset, file_name); the inventory has name, n_files."""
    both = registry.join(inventory.withColumnRenamed("name", "file_name"), "file_name", "left")
    status = F.when(~F.col("registered"), "not registered").when(F.coalesce("file_name", F.lit("")) == "", "no file name").when(F.col("n_files").isNull(), "no such path").when(F.col("n_files") == 0, "empty folder").otherwise("valid")
    return both.select("dataset", status.alias("status"))


def filtered_results(results: DataFrame, method: str | None = None, least: float | None = None, most: float | None = None, score_by: str = "score_avg", limit: int | None = None) -> DataFrame:
    """Results of a method (all, any, none or empty: every one) with a score in bounds, by the mean or the largest score."""
    score = "score_avg" if score_by.strip().lower() in ("avg", "score_avg", "mean") else "score_max"
    name = (method or "").strip().lower()
    if name not in ("", "all", "any", "none"):
        results = results.where(F.lower("method") == name)
    if least is not None:
        results = results.where(F.col(score) >= least)
    if most is not None:
        results = results.where(F.col(score) <= most)
    return results.orderBy(F.desc(score), "id").limit(limit) if limit else results


def config_points(config: DataFrame, text: str = "config") -> DataFrame:
    """(point, column, st, et) of each point in JSON maps from a path to its columns and time range."""
    spec = F.from_json(text, "map<string, struct<columns array<string>, st string, et string>>")
    paths = config.select(F.explode(spec).alias("path", "s"))
    return paths.select("path", F.explode("s.columns").alias("column"), F.to_timestamp_ntz("s.st").alias("st"), F.to_timestamp_ntz("s.et").alias("et"))


def narrowed(results: DataFrame) -> DataFrame:
    """Result rows as they are stored: values as float, masks as tinyint."""
    kinds = {c: "float" if c == "value" else "tinyint" for c in results.columns if c == "value" or c.endswith("_mask")}
    return results.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in results.columns])


def evaluation_tables(segments: DataFrame, method: str) -> tuple[DataFrame, DataFrame]:
    """(metrics, segments) as stored: one metrics row for each point and its segments, under the same inference_id."""
    from tidegauge.operators.score import score_summary

    key = F.sha2(F.concat_ws("|", F.lit(method), F.col("point")), 256).alias("inference_id")
    return score_summary(segments, "point").select(key, "*"), segments.select(key, "*")


def backfilled(index: DataFrame, results: DataFrame, key: str, *values: str) -> tuple[DataFrame, DataFrame]:
    """(new index, outcomes): results that the index lacks are created, those with other values updated, the rest skipped."""
    changes = snapshot_changes(index, results, key, *values).where("change <> 'gone'")
    outcome = F.element_at(F.create_map(F.lit("new"), F.lit("created"), F.lit("changed"), F.lit("updated"), F.lit("same"), F.lit("skipped")), F.col("change"))
    fresh = results.join(index.select(key), key, "left_anti").unionByName(results.join(index.select(key), key, "left_semi"))
    return index.join(results.select(key), key, "left_anti").unionByName(fresh.select(*index.columns)), changes.select(key, outcome.alias("outcome"))


def method_comparison(points: DataFrame, methods: list[str], intervals: DataFrame, manual: DataFrame) -> DataFrame:
    """Every asked method and the manual labels for every point: number of intervals and rows in them, 0 where none."""
    spark = points.sparkSession
    asked = spark.createDataFrame([(m,) for m in [*methods, "manual"]], "method string")
    every = intervals.select("method", "point", "start_pos", "end_pos").unionByName(manual.select(F.lit("manual").alias("method"), "point", "start_pos", "end_pos"))
    counted = every.groupBy("method", "point").agg(F.count("*").alias("n"), F.sum(F.col("end_pos") - F.col("start_pos") + 1).alias("n_rows"))
    grid = points.select("point").distinct().crossJoin(F.broadcast(asked))  # a few methods for each point
    return grid.join(counted, ["method", "point"], "left").fillna(0, ["n", "n_rows"])


def prompt_templates(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """The template table: name and text."""
    return spark.createDataFrame(sorted(templates.items()), "name string, template string")
