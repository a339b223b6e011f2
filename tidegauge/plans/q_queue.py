"""Queries of the review queue: its whole loop over the orders as results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidegauge.operators.review_queue import ReviewQueue
from tidegauge.plans import fixtures as fx
from tidegauge.plans.registry import query
from tidegauge.sources.scratch import scratch_path


def _worked_queue(spark, d) -> ReviewQueue:
    """Two samples and a whole status enqueued, one item decided, many decided, the last batch sent twice."""
    orders = fx.table(spark, d, "orders")
    results = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("method"), F.col("o_custkey").cast("string").alias("point_name"))
    queue, day = ReviewQueue(spark, scratch_path(spark, "queue"), 8), lambda n: datetime(2024, 1, n)
    queue.sample(results, "top_k", 100, day(1))
    queue.sample(results, "low_score", 100, day(2))
    whole = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("source_id"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("method"), F.col("o_custkey").cast("string").alias("point_name"))
    queue.enqueue(whole, day(3), strategy="status")
    first = queue.listing(limit=1, strategy="top_k").first()
    queue.decide_all([first.id], "approved", "ann", day(4))
    items = queue.read().where(F.col("id") != first.id)
    number = F.col("source_id").cast("long")
    batch = items.where(number % 3 == 0).select("id", F.when(number % 2 == 0, "rejected").otherwise("needs_fix").alias("status"), F.lit("bob").alias("reviewer"))
    queue.decide(batch, day(5))
    queue.decide(batch, day(6))  # sent again: nothing changes
    return queue


_QUEUE = """r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey, o_totalprice AS score, o_orderdate, o_orderstatus, o_orderpriority AS method FROM orders),
  t AS (SELECT id, 'top_k' AS strategy, 1 AS day FROM r ORDER BY score DESC, o_orderdate DESC, id LIMIT 100), l AS (SELECT id, 'low_score' AS strategy, 2 AS day FROM r ORDER BY score, o_orderdate DESC, id LIMIT 100),
  p AS (SELECT id, 'status' AS strategy, 3 AS day FROM r WHERE o_orderstatus = 'P'), q AS (SELECT id, arg_min(strategy, day) AS strategy, min(day) AS day FROM (SELECT * FROM t UNION ALL SELECT * FROM l UNION ALL SELECT * FROM p) GROUP BY 1),
  h AS (SELECT q.*, sha256('inference|' || q.id) AS item FROM q), f AS (SELECT id AS one FROM h WHERE strategy = 'top_k' ORDER BY item LIMIT 1),
  w AS (SELECT h.id AS source_id, item AS id, strategy, r.method, round(score, 2) AS score, CASE WHEN h.id = one THEN 'approved' WHEN o_orderkey % 3 <> 0 THEN 'pending' WHEN o_orderkey % 2 = 0 THEN 'rejected' ELSE 'needs_fix' END AS status,
      CASE WHEN h.id = one THEN 'ann' WHEN o_orderkey % 3 = 0 THEN 'bob' END AS reviewer, TIMESTAMP '2024-01-01' + INTERVAL (day - 1) DAY AS created_at, TIMESTAMP '2024-01-01' + INTERVAL (CASE WHEN h.id = one THEN 3 WHEN o_orderkey % 3 = 0 THEN 4 ELSE day - 1 END) DAY AS updated_at FROM h JOIN r ON r.id = h.id, f)"""


@query(f"WITH {_QUEUE} SELECT * FROM w")
def c26_review_loop(spark, d):
    rows = _worked_queue(spark, d).listing(limit=None)
    return rows.select("id", "source_id", "strategy", "method", F.round("score", 2).alias("score"), "status", "reviewer", "created_at", "updated_at")


@query(f"WITH {_QUEUE} SELECT status, count(*) AS n FROM w WHERE strategy = 'status' GROUP BY ROLLUP (status)")
def c26_review_stats(spark, d):
    return _worked_queue(spark, d).stats(strategy="status")
