"""File sources: series CSV, annotation folders, JSON lines and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.sources.scratch import settled

#: Names of a time column, in order of preference.
TIME_COLUMNS = ("date", "time", "timestamp", "Time", "Date")


def series_files(spark: SparkSession, path: str, numeric: bool = False) -> DataFrame:
    """(file, ts, value, raw) of CSV files that each have their own header.

    The time is in the first of TIME_COLUMNS that a file has, else in its first column. The value is in `value`, else (with
    `numeric`) in the first other column with a number in the file's first row, else in the second, else the last column.
    Rows without a readable time are left out; a value that is no number is null and stays readable in `raw`. Fields
    may be quoted, but not hold line ends. All files are read in one pass; what a task needs of the others is one row a file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    lines = lines.where("trim(value) <> ''")
    # lines of a block are numbered in order, so the first two of a file's first block are its header and first row
    top = lines.where("_block = 0").groupBy("file").agg(F.min(F.struct("_line", "value")).alias("h"))
    first = lines.where("_block = 0").join(top.select("file", F.col("h._line").alias("_top")), "file").where("_line > _top").groupBy("file").agg(F.min(F.struct("_line", "value")).alias("r"))
    heads = settled(top.join(first, "file", "left").select("file", F.col("h._line").alias("_top"), F.col("h.value").alias("head"), F.coalesce("r.value", F.lit("")).alias("row")), "headers")
    most = heads.agg(F.max(F.size(F.split("head", ",")))).first()[0] or 1
    schema = ", ".join(f"c{k} string" for k in range(most))
    fields = lambda c: F.array(*[F.trim(F.from_csv(c, schema)[f"c{k}"]) for k in range(most)])
    names = F.array_compact(fields("head"))
    place = lambda wanted: F.nullif(F.array_position("names", wanted), F.lit(0))
    time = F.coalesce(*[place(n) for n in TIME_COLUMNS], F.lit(1)).cast("int")
    heads = heads.select("file", "_top", names.alias("names"), fields("row").alias("row")).withColumn("_t", time)
    others = F.filter(F.sequence(F.lit(1), F.greatest(F.size("names"), F.lit(1))), lambda i: i != F.col("_t"))
    number = F.filter(others, lambda i: F.try_element_at("row", i).try_cast("double").isNotNull())
    fallback = [F.try_element_at(number, F.lit(1))] if numeric else []
    value = F.coalesce(place("value").cast("int"), *fallback, F.try_element_at(others, F.lit(1)), F.col("_t"))
    heads = heads.select("file", "_top", "_t", value.alias("_v"))
    rows = lines.join(heads, "file").where("_line <> _top or _block <> 0").withColumn("f", fields("value"))
    raw = F.try_element_at("f", F.col("_v"))
    out = rows.select("file", F.try_element_at("f", F.col("_t")).try_cast("timestamp").alias("ts"), raw.try_cast("double").alias("value"), raw.alias("raw"))
    return out.where("ts is not null")


def series_csv(spark: SparkSession, path: str) -> DataFrame:
    """(file, ts, value) of CSV files, each by its own header: `value`, else the second, else the last column."""
    return series_files(spark, path).select("file", "ts", "value")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and invalid ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def annotation_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON file, with its `file` and a `_corrupt_record` where it cannot be read."""
    read = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return read.select("*", F.col("_metadata.file_path").alias("file"))


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, file_name, size_bytes, modified) of files; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def sink_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)
