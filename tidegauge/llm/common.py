"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step holds at a time; longer texts make a step of their own.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; one of our own only in a local session that leaves it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read that back."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers up to which the small side of a spread_join is broadcast, and what makes a key hot beyond.
BROADCAST_ROWS, HOT_ROWS, SALTS = 1_000_000, 20_000, 64


def spread_join(left: DataFrame, right: DataFrame, on: str, bound: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row of a few numbers for each key, where many rows of left may share one.

    `bound` is the most rows that right can have. Up to BROADCAST_ROWS it is broadcast. Beyond, the hot keys of left,
    of which there are at most 1,000, are dealt over SALTS copies of their row.
    """
    if bound <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    counts = left.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS).orderBy(F.desc("_n")).limit(1000)
    hot = written(counts.select(on, F.lit(True).alias("_hot")), "hot-keys")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_hot")
    shared = right.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return dealt.join(shared, [on, "_salt"], how).drop("_salt")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32(doc_id as text) mod divisor; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def crc_of(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def words_of(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The words (runs of other characters than ASCII white space) of all texts one after another, as binary, and how
    many each text has. `lower` makes A-Z small first; null is empty."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = split.flatten().cast(pa.binary())
    full = pc.greater(pc.binary_length(flat), 0)
    counts = np.bincount(np.asarray(pc.list_parent_indices(split))[np.asarray(full)], minlength=len(texts))
    return flat.filter(full), counts


def steps(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of one hold about `most` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
        part = np.cumsum(sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def appended(df: DataFrame, fields: list[T.StructField], make: Callable[[pa.RecordBatch], list[pa.Array]], text: str = "text") -> DataFrame:
    """df with new columns that `make` computes from each batch; a column of the same name is replaced."""
    names = {f.name for f in fields}
    keep = [c for c in df.columns if c not in names]
    source = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*source.schema.fields, *fields])

    def run(batches):
        for batch in steps(batches, text):
            new = make(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *[f.name for f in fields]])

    return source.mapInArrow(run, schema)


def sums_by(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `values`, a run of length 0 giving 0."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def splitmix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit integers (the published splitmix64 finaliser)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
