"""Queries of text measures over all turns, and of registered forecasters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidegauge.operators import detect as dt
from tidegauge.operators import labels as lb
from tidegauge.plans import fixtures as fx
from tidegauge.plans.registry import query

_PAIRS = """pr AS (SELECT a.conv_id * 1000 + a.turn AS id, b.text AS p, a.text AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def _pairs(spark, d):
    c = fx.table(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("p"))
    return c.join(after, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "p", F.col("text").alias("t"))


def _grams_sql(c: str) -> str:
    return f"SELECT id, n, substr({c}, i, n) AS g, count(*) AS c FROM (SELECT id, {c}, n, unnest(range(1, length({c}) - n + 2)) AS i FROM pr, range(1, 5) r(n) WHERE length({c}) >= n) GROUP BY ALL"


@query(f"""WITH {_PAIRS}, gp AS ({_grams_sql('p')}), gt AS ({_grams_sql('t')}), m AS (SELECT gp.id, gp.n, sum(least(gp.c, gt.c)) AS m FROM gp JOIN gt ON gp.id = gt.id AND gp.n = gt.n AND gp.g = gt.g GROUP BY 1, 2),
  e AS (SELECT pr.id, n, length(p) AS lp, length(t) AS lt, coalesce(m, 0) AS m, greatest(length(p) - n + 1, 1) AS size FROM pr CROSS JOIN range(1, 5) r(n) LEFT JOIN m USING (id, n)),
  z AS (SELECT *, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS k FROM e), s AS (SELECT id, any_value(lp) AS lp, any_value(lt) AS lt, max(m) FILTER (WHERE n = 1) AS m1, sum(ln(CASE WHEN m = 0 THEN 1 / (2 ** k * size) ELSE m / size END)) / 4 AS l FROM z GROUP BY 1)
  SELECT id, CASE WHEN m1 > 0 THEN round(100 * CASE WHEN lp > lt THEN 1 ELSE exp(1 - lt / lp) END * exp(l), 4) ELSE 0 END AS bleu FROM s""")
def a34_bleu(spark, d):
    return lb.bleu(_pairs(spark, d), "id", "p", "t")


def _words_sql(c: str) -> str:
    return f"SELECT id, w[i] || ' ' || w[i + 1] AS g, count(*) AS c FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM (SELECT id, string_split(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ' ') AS w FROM pr)) GROUP BY ALL"


@query(f"""WITH {_PAIRS}, gp AS ({_words_sql('p')}), gt AS ({_words_sql('t')}), m AS (SELECT gp.id, sum(least(gp.c, gt.c)) AS m FROM gp JOIN gt USING (id, g) GROUP BY 1), np AS (SELECT id, sum(c) AS n FROM gp GROUP BY 1), nt AS (SELECT id, sum(c) AS n FROM gt GROUP BY 1)
  SELECT pr.id, round(CASE WHEN coalesce(np.n, 0) + coalesce(nt.n, 0) > 0 THEN 2 * coalesce(m, 0) / (coalesce(np.n, 0) + coalesce(nt.n, 0)) ELSE 0 END, 6) AS f FROM pr LEFT JOIN m USING (id) LEFT JOIN np USING (id) LEFT JOIN nt USING (id)""")
def a34_rouge_2(spark, d):
    return lb.ngram_overlap(_pairs(spark, d), "id", "p", "t", 2).select("id", F.round("f", 6).alias("f"))


def _line(x: np.ndarray) -> np.ndarray:
    """The value after each window on its least-squares line."""
    t = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
    return x.mean(1) + x @ t / (t @ t) * (t[-1] + 1)


dt.register_forecaster("line", _line)


@query(f"""WITH {fx.SERIES} SELECT point, pos, round(CASE WHEN count(*) OVER w = 30 THEN value - CASE WHEN max(value) OVER w = min(value) OVER w THEN lag(value) OVER o ELSE regr_intercept(value, pos) OVER w + regr_slope(value, pos) OVER w * pos END END, 4) AS residual
  FROM series WINDOW w AS (PARTITION BY point ORDER BY pos ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY point ORDER BY pos)""")
def f3_registered_forecaster(spark, d):
    return dt.rolling_residual(fx.event_series(spark, d), 30, "line").select("point", "pos", F.round("residual", 4).alias("residual"))
