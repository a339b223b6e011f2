"""Series, masks and label tables that Spark derives from the given tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.operators.core import with_positions, with_positions_by_bucket
from tidegauge.sources.scratch import settled

#: Rows of a table from which on its series is written once numbered, as its readers would each number it anew.
LARGE = 1_000_000


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """(point, pos, ts, value) of rows, numbered by day."""
    s = with_positions_by_bucket(rows, *order).select("point", "pos", "ts", "value")
    return settled(s, "series") if rows.count() > LARGE else s


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point for each event type."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("point"), "ts", "value", "event_id")
    return numbered(e, "event_id")


SERIES = """series AS (SELECT event_type AS point, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos,
            ts, value FROM events)"""


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short points, one for each user."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("point"), "ts", "value", "event_id")
    return with_positions(e, "event_id").select("point", F.col("pos").cast("long").alias("pos"), "ts", "value")


USERS = """users AS (SELECT CAST(user_id AS VARCHAR) AS point, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
            ts, value FROM events)"""


def hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of an hour with events, for each event type: a grid with gaps."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("point"), F.date_trunc("hour", "ts").alias("ts")).agg(F.round(F.avg("value"), 6).alias("value"))
    return with_positions(e).select("point", F.col("pos").cast("long").alias("pos"), "ts", "value")


HOURLY = """hourly AS (SELECT point, row_number() OVER (PARTITION BY point ORDER BY ts) - 1 AS pos, ts, value FROM (
            SELECT event_type AS point, date_trunc('hour', ts) AS ts, round(avg(value), 6) AS value FROM events GROUP BY 1, 2))"""


def quantity_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer points with repeated values, one for each return flag."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("point"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("value"), "l_orderkey", "l_linenumber", "l_partkey")
    return numbered(x, "l_orderkey", "l_linenumber", "l_partkey", "value")


QUANTITY = """quantity AS (SELECT l_returnflag AS point, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey,
            l_linenumber, l_partkey, l_quantity) - 1 AS pos, l_shipdate AS ts, l_quantity AS value FROM lineitem)"""


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a day for each order status."""
    x = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("point"), F.col("o_orderdate").alias("ts")).agg(F.count("*").cast("double").alias("value"))
    return with_positions(x).select("point", F.col("pos").cast("long").alias("pos"), "ts", "value")


DAILY = """daily AS (SELECT point, row_number() OVER (PARTITION BY point ORDER BY ts) - 1 AS pos, ts, value FROM (
            SELECT o_orderstatus AS point, o_orderdate AS ts, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2))"""


def masked_series(spark: SparkSession, sf_dir: str, limit: float = 120.0) -> DataFrame:
    """Event series with a mask of values over a limit."""
    return event_series(spark, sf_dir).withColumn("mask", F.coalesce((F.col("value") > limit).cast("int"), F.lit(0)))


MASKED = SERIES + """, masked AS (SELECT *, CAST(coalesce(value > 120, false) AS INTEGER) AS mask FROM series)"""


def segment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the mask, hits at most five rows apart joined."""
    from tidegauge.operators.core import bridged

    return bridged(masked_series(spark, sf_dir).where("mask = 1"), 5)


SEGMENTS = MASKED + """, hits AS (SELECT point, pos, CASE WHEN pos - lag(pos) OVER w <= 5 THEN 0 ELSE 1 END AS new FROM masked WHERE mask = 1
            WINDOW w AS (PARTITION BY point ORDER BY pos)),
          runs AS (SELECT point, pos, sum(new) OVER (PARTITION BY point ORDER BY pos) AS seg_id FROM hits),
          segments AS (SELECT point, CAST(seg_id AS BIGINT) AS seg_id, min(pos) AS start_pos, max(pos) AS end_pos FROM runs GROUP BY 1, 2)"""
