"""Stream twins of the trainer-log summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "run string, step long, loss double"


def latest(log: DataFrame) -> DataFrame:
    """Latest step and loss, and rows so far, of each run."""
    return log.groupBy("run").agg(F.max("step").alias("step"), F.max_by("loss", "step").alias("loss"), F.count("*").alias("n"))


def latest_stream(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """The same over JSON files as they arrive; write it in complete or update mode."""
    return latest(spark.readStream.schema(schema).json(folder))


class LatestTable:
    """The latest row of each run, kept in a shared folder and merged batch by batch.

    A batch writes the whole table, of one row a run, as the version of its number, from the newest version before it; so a
    batch that is sent again after a failure writes what it wrote before, and the stream itself holds no state."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> DataFrame:
        try:
            return self.spark.read.schema("run string, step long, loss double, n long, batch long").parquet(self.path)
        except Exception as e:  # no batch yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "run string, step long, loss double, n long, batch long")

    def read(self, before: int | None = None) -> DataFrame:
        """The newest version, or the newest of batches before a number."""
        every = self._versions()
        every = every if before is None else every.where(F.col("batch") < before)
        newest = every.agg(F.max("batch")).first()[0]
        return every.where(F.lit(newest).isNotNull() & (F.col("batch") == F.lit(newest).cast("long"))).drop("batch")

    def merge(self, batch: DataFrame, number: int) -> None:
        """Merge the rows (run, step, loss) of batch `number`; of equal steps the older row stands."""
        new = latest(batch).select("run", "step", "loss", "n", F.lit(1).alias("_new"))
        both = self.read(number).withColumn("_new", F.lit(0)).unionByName(new)
        best = F.max_by(F.struct("step", "loss"), F.struct("step", -F.col("_new"))).alias("b")
        merged = both.groupBy("run").agg(best, F.sum("n").alias("n")).select("run", "b.step", "b.loss", "n")
        merged.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def follow(self, folder: str, checkpoint: str, schema: str = SCHEMA) -> StreamingQuery:
        """Merge all JSON lines that have arrived in a folder, each once, and stop."""
        stream = self.spark.readStream.schema(schema).json(folder)
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
