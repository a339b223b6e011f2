"""Segment scores, samples and isolation against plain loops; written tables on their edges."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import detect, reduce, review, score, stores

SERIES = "point string, pos long, value double"


def table(spark, series):
    return spark.createDataFrame([(p, i, float(v)) for p, y in series.items() for i, v in enumerate(y)], SERIES).repartition(3)


def merged(at, gap=5):
    """Runs of positions whose starts are at most `gap` after the end before."""
    out = []
    for i in at:
        if out and i - out[-1][1] <= gap:
            out[-1][1] = i
        else:
            out.append([i, i])
    return out


def squash(x):
    return math.exp(-math.exp(2 - x))


def plain_scores(y, at):
    """(start, end, raw_p, left, right, score) of the merged segments of one point."""
    n, hit = len(y), np.zeros(len(y), bool)
    hit[at] = True
    sd, width, out = y[~hit].std(), math.floor(0.03 * len(y)), []
    for a, b in merged(at):
        rest, inside = np.delete(y, range(a, b + 1)), y[a : b + 1]
        edges = np.unique(y)
        d = max(abs(np.searchsorted(np.sort(rest), v, "right") / len(rest) - np.searchsorted(np.sort(y), v, "right") / n) for v in edges)
        lam = math.sqrt(len(rest) * n / (len(rest) + n)) * d
        p = 1.0 if lam < 0.2 else min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam) for j in range(1, 31))))
        sides = []
        for normal in (np.flatnonzero(~hit[:a])[-width:] if width else [], (b + 1 + np.flatnonzero(~hit[b + 1 :]))[:width]):
            mean = y[normal].mean() if len(normal) else None
            sides.append(None if mean is None else max(abs(mean - inside.max()), abs(mean - inside.min())) / (sd + 1e-6))
        left, right = sides
        lf = squash(((left if left is not None else right or 0) + (right if right is not None else left or 0)) / 2)
        p0 = squash(-math.log(p + 1e-12))
        x = abs(lf - p0)
        w = (math.log(1 + 25 * x - 25 * x * x) / (1 + 5 * x) - 1) / 5 + x / 2
        adjusted = (100 - 1e-3) * (lf * (1 - w) + p0 * w)
        out.append((a, b, p, left, right, round(10 * math.log1p(math.exp(adjusted / 10)), 2)))
    return out


def test_segment_scores_equal_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    series = {p: np.round(rng.normal(10, 2, n), 3) for p, n in (("a", 400), ("b", 150), ("c", 90))}
    series["a"][100:130] += 25
    series["b"][[0, 1, 5, 149]] += 40  # at both ends, and two runs that become one
    series["c"][40:44] -= 3
    at = {"a": list(range(100, 130)) + [300], "b": [0, 1, 5, 149], "c": [40, 41, 43]}
    hits = spark.createDataFrame([(p, i) for p, x in at.items() for i in x], "point string, pos long")
    got = score.scored_segments(table(spark, series), hits).collect()
    want = {(p, r[0], r[1]): r[2:] for p, y in series.items() for r in plain_scores(y, at[p])}
    assert {(r.point, r.start_pos, r.end_pos) for r in got} == set(want)
    for r in got:
        for mine, plain in zip((r.raw_p, r.left, r.right, r.score), want[r.point, r.start_pos, r.end_pos]):
            assert mine is None if plain is None else mine == pytest.approx(plain, abs=1e-2 if plain is want[r.point, r.start_pos, r.end_pos][3] else 1e-9)


def test_largest_triangles_equal_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    series = {"walk": rng.normal(0, 1, 3000).cumsum(), "short": rng.normal(0, 1, 12)}
    at = spark.createDataFrame([(p, i, i, float(v)) for p, y in series.items() for i, v in enumerate(y)], "point string, pos long, ts long, value double").withColumn("ts", F.timestamp_seconds("ts"))
    got = {p: [r.orig_pos for r in reduce.lttb(at, 40).where(F.col("point") == p).orderBy("orig_pos").collect()] for p in series}
    assert got["short"] == list(range(12))
    y, kept = series["walk"], []
    for k in range(40):  # first, lowest, highest and last of each bucket
        x = range(-(-k * 3000 // 40), -(-(k + 1) * 3000 // 40))
        kept += {x[0], x[-1], min(x, key=lambda i: y[i]), max(x, key=lambda i: y[i])}
    kept = sorted(kept)
    edges = [1 + int((len(kept) - 2) * k / 38) for k in range(39)]
    want = [kept[0]]
    for k in range(38):
        after = kept[edges[k + 1] : edges[k + 2] if k < 37 else len(kept)]
        cx, cy, a = np.mean(after), np.mean([y[i] for i in after]), want[-1]
        want.append(max(kept[edges[k] : edges[k + 1]], key=lambda i: abs((a - cx) * (y[i] - y[a]) - (a - i) * (cy - y[a]))))
    assert got["walk"] == [*want, kept[-1]]


def test_isolation_takes_the_share_that_stands_apart(spark):
    rng = np.random.default_rng(3)
    series = {"a": rng.normal(0, 1, 3000), "b": rng.normal(5, 1, 300), "one": np.array([1.0]), "flat": np.full(50, 2.0)}
    series["a"][[7, 1500]] = [60.0, -40.0]
    series["b"][20] = 90.0
    first = {tuple(r) for r in detect.hits_isolation(table(spark, series), 0.01).collect()}
    again = {tuple(r) for r in detect.hits_isolation(table(spark, series).repartition(7), 0.01).collect()}
    assert first == again and {("a", 7), ("a", 1500), ("b", 20)} <= first
    assert 0 < len([1 for p, _ in first if p == "a"]) <= 60 and ("one", 0) in first
    assert len([1 for p, _ in first if p == "flat"]) == 50  # ties of the first rank are all taken
    assert detect.hits_isolation(table(spark, series).limit(0)).count() == 0


def test_support_samples_equal_a_sort(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else None) for i in range(500)] + [(900, "rare")], "id long, subject string")
    hashed = df.withColumn("h", F.xxhash64("id", F.lit(7))).toPandas()
    want = {(r.id, s, k + 1) for s, g in hashed.groupby(hashed.subject.fillna("-")) for k, r in enumerate(g.sort_values("h").head(4).itertuples())}
    got = {(r.id, r.subject or "-", r.k) for r in review.support_sample(df, "subject", "id", 4).collect()}
    assert got == want and len(got) == 9


def test_interleaving_repeats_short_sources(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 7), ("b", 8)], "source string, id long")
    got = sorted((r.turn, r.source, r.id) for r in review.interleaved(df, "source", "id", over=True).collect())
    assert [x for x in got if x[1] == "b"] == [(t, "b", 7 + (t - 1) % 2) for t in range(1, 6)]
    assert [x[2] for x in got if x[1] == "a"] == [0, 1, 2, 3, 4]


def test_results_are_written_once(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([("m", p, i, float(i), 1) for p in ("a", "b", None) for i in range(10)], "method string, point string, pos long, value double, outlier_mask int")
    assert stores.write_results(rows.limit(0), path) == 0
    assert stores.write_results(rows.where("point = 'a'"), path, spark.createDataFrame([("a", 3), ("a", 3), ("b", 4)], "point string, orig_pos long")) == 1
    assert stores.write_results(rows.where("point is not null"), path) == 10
    assert stores.write_results(rows.where("point is not null"), path) == 0
    back = spark.read.parquet(path)
    assert dict(back.dtypes)["value"] == "float" and dict(back.dtypes)["outlier_mask"] == "tinyint"
    assert sorted((r.point, r.pos) for r in back.collect()) == [("a", 3)] + [("b", i) for i in range(10)]


def test_files_of_synced_folders_alone_change(spark, tmp_path):
    path = str(tmp_path / "files")
    found = lambda *names: spark.createDataFrame([(f"/d/{n}", n.split("/")[1], 1, datetime(2024, 1, 1)) for n in names], "path string, file_name string, size_bytes long, modified timestamp")
    folders = lambda *names: spark.createDataFrame([(f"/d/{n}",) for n in names], "dir_path string")
    assert stores.registered_files(spark, path).count() == 0
    stores.sync_files(found("x/Timer_a.csv", "x/b.XLS", "x/c.txt", "y/qwen_chatts.csv"), folders("x", "y"), path)
    stores.sync_files(found("y/d.csv", "x/late.csv"), folders("y"), path)
    names = lambda **kw: sorted((r.filename, r.method) for r in stores.registered_files(spark, path, **kw).collect())
    assert names() == [("Timer_a.csv", "timer"), ("b.XLS", None), ("d.csv", None)]
    assert names(folder="/d/x", method="timer") == [("Timer_a.csv", "timer")]
    stores.sync_files(found("x/a.csv").limit(0), folders("x"), path)
    assert names() == [("d.csv", None)]


def test_polynomial_residuals_equal_a_least_squares_fit(spark):
    rng = np.random.default_rng(4)
    series = {"a": np.sin(np.arange(500) / 60) * 9 + rng.normal(0, 0.1, 500), "b": 1000 + rng.normal(0, 3, 80)}
    got = {(r.point, r.pos): r.residual for r in detect.polynomial_residual(table(spark, series)).collect()}
    for p, y in series.items():
        fit = np.polynomial.chebyshev.Chebyshev.fit(np.arange(len(y)), y, 12)
        assert max(abs(got[p, i] - r) for i, r in enumerate(y - fit(np.arange(len(y))))) < 1e-6


def test_summaries_equal_their_formulas(spark):
    scores = {"a": [1.0, 5.0, 2.5], "b": [7.0]}
    rows = spark.createDataFrame([(p, x) for p, s in scores.items() for x in s], "point string, score double")
    got = {r.point: (r.score_avg, r.score_max, r.score_min, r.score_p50, r.segment_count) for r in score.score_summary(rows, "point").collect()}
    for p, s in scores.items():
        assert got[p] == pytest.approx((np.mean(np.array(s) ** 5) ** 0.2, max(s), min(s), np.median(s), len(s)))
