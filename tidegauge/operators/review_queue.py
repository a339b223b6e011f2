"""A review queue that many can update: sample, enqueue, decide, list, count.

The queue is a table of buckets by id. A change writes the touched buckets anew beside the old ones and then one small
manifest, a version that names the folder of every bucket; readers use the newest version, so a change is seen whole or
not at all, and old versions stay readable. A change that leaves every row as it is writes nothing, so a batch that is
sent again does no harm. One writer at a time: two that start from one version want the same manifest, and the second
fails.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.review import enqueued, sampled, status_counts

SCHEMA = "id string, source_type string, source_id string, method string, model string, point_name string, score double, strategy string, status string, reviewer string, created_at timestamp_ntz, updated_at timestamp_ntz"
#: What a queue item may be.
STATUSES = ("pending", "approved", "rejected", "needs_fix")
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class ReviewQueue:
    """The queue in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self):
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def versions(self) -> DataFrame:
        """(version, bucket, folder) of all manifests."""
        try:
            return self.spark.read.schema("bucket int, folder string, version long").parquet(f"{self.path}/manifest")
        except Exception as e:  # no version yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "bucket int, folder string, version long")

    def _manifest(self, version: int | None = None) -> tuple[int, dict[int, str]]:
        """A version (the newest) and the folder of each bucket; there are at most `buckets` rows."""
        every = self.versions()
        number = every.agg(F.max("version")).first()[0] if version is None else version
        if number is None:
            return 0, {}
        return number, {r.bucket: r.folder for r in every.where(F.col("version") == number).collect()}

    def read(self, version: int | None = None) -> DataFrame:
        folders = sorted(self._manifest(version)[1].values())
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)

    def _replace(self, rows: DataFrame) -> int:
        """Rows (whole, by id) put in place of those with their ids, or added. Returns how many are new or differ."""
        now = self.read()
        changed = rows.select(*COLUMNS).exceptAll(now)
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        changed.write.parquet(f"{folder}/change")
        changed = self.spark.read.schema(SCHEMA).parquet(f"{folder}/change")
        touched = [r[0] for r in changed.select(self._bucket()).distinct().collect()]  # at most `buckets`
        if not touched:
            return 0
        kept = now.where(self._bucket().isin(touched)).join(changed.select("id"), "id", "left_anti").select(*COLUMNS)
        kept.union(changed).withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/rows")
        version, folders = self._manifest()
        folders |= {b: f"{folder}/rows/bucket={b}" for b in touched}
        manifest = self.spark.createDataFrame(sorted(folders.items()), "bucket int, folder string")
        manifest.coalesce(1).write.parquet(f"{self.path}/manifest/version={version + 1}")
        return changed.count()

    def enqueue(self, candidates: DataFrame, at: datetime, source_type: str = "inference", strategy: str | None = None) -> int:
        """Add candidates (source_id, and any of method, model, point_name, score) that the queue does not have, as pending.
        Their ids follow from their source, and of several with one source_id the highest score comes in."""
        given = {c: F.col(c) if c in candidates.columns else F.lit(None) for c in ("method", "model", "point_name", "score")}
        rows = candidates.select(F.col("source_id").cast("string").alias("source_id"), F.lit(source_type).alias("source_type"), *[c.alias(n) for n, c in given.items()])
        rows = rows.where("source_id is not null").groupBy("source_type", "source_id").agg(*[F.max_by(n, F.struct(F.col("score").isNotNull(), "score", "point_name", "method", "model")).alias(n) for n in given])
        stamp = F.lit(at).cast("timestamp_ntz")
        rows = enqueued(self.read(), rows, "source_type", "source_id").withColumns({"id": F.sha2(F.concat_ws("|", "source_type", "source_id"), 256), "strategy": F.lit(strategy).cast("string"), "status": F.lit("pending"), "reviewer": F.lit(None).cast("string"), "created_at": stamp, "updated_at": stamp})
        kinds = dict(c.split() for c in SCHEMA.split(", "))
        return self._replace(rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS]))

    def sample(self, results: DataFrame, strategy: str, k: int, at: datetime) -> int:
        """Enqueue k results (id, score, created_at, ...) by a strategy of review.sampled."""
        picked = sampled(results, strategy, k).withColumnRenamed("id", "source_id")
        return self.enqueue(picked, at, strategy=strategy)

    def decide(self, decisions: DataFrame, at: datetime) -> int:
        """Set status and reviewer of items by (id, status, reviewer); unknown ids are left out, and of several decisions on
        an item the greatest counts. Items that have the status and reviewer already keep their time."""
        wrong = decisions.where(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))).select("status").take(1)
        if wrong:
            raise ValueError(f"no status: {wrong[0].status!r}")
        last = decisions.groupBy("id").agg(F.max(F.struct("status", "reviewer")).alias("_d"))
        new = self.read().join(last, "id").where(~(F.col("status").eqNullSafe(F.col("_d.status")) & F.col("reviewer").eqNullSafe(F.col("_d.reviewer"))))
        return self._replace(new.withColumns({"status": F.col("_d.status"), "reviewer": F.col("_d.reviewer"), "updated_at": F.lit(at).cast("timestamp_ntz")}))

    def decide_all(self, ids: list[str], status: str, reviewer: str, at: datetime) -> int:
        """The same status for a list of ids."""
        if not ids:
            raise ValueError("no ids")
        return self.decide(self.spark.createDataFrame([(i, status, reviewer) for i in ids], "id string, status string, reviewer string"), at)

    def listing(self, results: DataFrame | None = None, limit: int | None = 200, **equal: str) -> DataFrame:
        """Items that equal the given columns, newest update first, with the `result_path` of results (id, result_path)."""
        rows = self.read()
        for column, value in equal.items():
            rows = rows.where(F.col(column) == value)
        if results is not None:
            rows = rows.join(results.select(F.col("id").cast("string").alias("source_id"), "result_path"), "source_id", "left")
        return rows.orderBy(F.desc("updated_at"), "id").limit(limit) if limit else rows

    def stats(self, **equal: str) -> DataFrame:
        """Items of each status and in all (null status)."""
        return status_counts(self.listing(limit=None, **equal))
