"""Result, evaluation and file tables that jobs write, and may write again after a failure.

Every write here can be repeated: results skip points that are there, evaluations and listings replace whole partitions
(dynamic overwrite), so a second run of the same job changes nothing. One writer at a time a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.inventory import evaluation_tables, narrowed
from tidegauge.sources.scratch import settled

#: Words of a file name that tell its method, in order of preference; the endings of series files.
NAME_METHODS = ("qwen", "chatts", "timer", "adtk_hbos", "ensemble")
SERIES_ENDINGS = (".csv", ".xls", ".xlsx")
#: Folders of stored results for each method, and rows of a point that one task writes at most.
BUCKETS, ROWS = 64, 5_000_000
FILES = "dir_path string, path string, filename string, method string, size_bytes long, mtime timestamp"


def stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet table at path, or None while nothing is written there."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def write_results(results: DataFrame, path: str, sampled: DataFrame | None = None, buckets: int = BUCKETS) -> int:
    """Append the results (method, point, pos, ...) of points that the table lacks, in a folder for each method and bucket of
    points; returns how many rows were written. `sampled` (point, orig_pos) restricts the rows to sampled ones.

    A point is there as soon as one of its rows is. Spark's committer shows the files of a write only when all are
    done, so an ended job leaves no half of a point. A long point is cut into stretches of ROWS for the tasks that write it.
    """
    if sampled is not None:
        results = results.join(sampled.select("point", F.col("orig_pos").alias("pos")).distinct(), ["point", "pos"], "left_semi")
    there = stored(results.sparkSession, path)
    if there is not None:
        results = results.join(there.select("method", "point").distinct(), ["method", "point"], "left_anti")
    fresh = narrowed(results).withColumn("bucket", F.pmod(F.xxhash64("point"), F.lit(buckets)).cast("int"))
    seen = Observation()
    fresh = fresh.repartition("method", "point", F.floor(F.col("pos") / ROWS)).observe(seen, F.count(F.lit(1)).alias("n"))
    fresh.write.mode("append").partitionBy("method", "bucket").parquet(path)
    return seen.get["n"]


def write_evaluation(segments: DataFrame, path: str, method: str, run: int) -> None:
    """Write the metrics and segments of a run to path/metrics and path/segments, in place of an earlier try of the run.

    Rows of both tables have the same `inference_id`, made of method, run and point. A run without segments writes none.
    """
    segments = settled(segments, "segments")  # read for each of the two tables
    key = F.sha2(F.concat_ws("|", F.lit(method), F.lit(run), F.col("point")), 256)
    for name, rows in zip(("metrics", "segments"), evaluation_tables(segments, method)):
        rows = rows.withColumns({"inference_id": key, "method": F.lit(method), "run": F.lit(run)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "run").parquet(f"{path}/{name}")


def stored_evaluation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metrics, segments) of the latest run that scored a point by a method."""
    metrics = spark.read.parquet(f"{path}/metrics")
    latest = metrics.groupBy("method", "point").agg(F.max("run").alias("run"))
    metrics = metrics.join(latest, ["method", "point", "run"], "left_semi")
    return metrics, spark.read.parquet(f"{path}/segments").join(metrics.select("inference_id"), "inference_id", "left_semi")


def method_of_name(name: Column) -> Column:
    """The first of NAME_METHODS that a file name holds, else null."""
    low = F.lower(name)
    return F.coalesce(*[F.when(F.contains(low, F.lit(m)), m) for m in NAME_METHODS])


def listed_files(found: DataFrame) -> DataFrame:
    """Series files of an inventory (path, file_name, size_bytes, modified) as rows of the file table."""
    low = F.lower("file_name")
    wanted = F.lit(False)
    for ending in SERIES_ENDINGS:
        wanted |= F.endswith(low, F.lit(ending))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return found.where(wanted).select(folder.alias("dir_path"), "path", F.col("file_name").alias("filename"), method_of_name(F.col("file_name")).alias("method"), "size_bytes", F.col("modified").alias("mtime"))


def sync_files(found: DataFrame, folders: DataFrame, path: str) -> None:
    """Bring the file table at path to what was found in the folders (dir_path); other folders stay as they are.

    A folder is a partition. Each synced one also gets a row without a file, so that an emptied folder is overwritten too.
    """
    folders = folders.select("dir_path").distinct()
    rows = listed_files(found).join(folders, "dir_path", "left_semi").unionByName(folders, allowMissingColumns=True)
    rows = rows.repartition("dir_path", F.pmod(F.xxhash64("path"), F.lit(8)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dir_path").parquet(path)


def registered_files(spark: SparkSession, path: str, folder: str | None = None, method: str | None = None) -> DataFrame:
    """Files of the table, newest first; folder prunes the scan."""
    files = stored(spark, path, FILES)
    if files is None:
        return spark.createDataFrame([], FILES)
    files = files.where("path is not null")
    if folder is not None:
        files = files.where(F.col("dir_path") == folder)
    if method is not None:
        files = files.where(F.col("method") == method)
    return files.orderBy(F.desc("mtime"), "path")
