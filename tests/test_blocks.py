"""Steps that work by blocks of a point, against plain loops with blocks of a few rows."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import core, detect, labels, matching

SERIES = "point string, pos long, ts timestamp, value double"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(core, "BLOCK", 7)


def rows_of(seed):
    r = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(p, i, start + timedelta(hours=9 * i), r.choice([None, 0.0, 1.0, 1.0, 1.0])) for p in ("a", "b", None) for i in range(90)]


def test_islands_go_on_over_blocks(spark, small_blocks):
    rows = rows_of(1) + [("c", i, datetime(2024, 1, 1), 5.0) for i in range(50)]
    want, last = {}, {}
    for p, i, _, v in rows:
        n, before = last.get(p, (0, object()))
        last[p] = (n if before == v else n + 1, v)
        want[p, i] = last[p][0]
    found = core.islands(spark.createDataFrame(rows, SERIES), "value")
    assert {(r.point, r.pos): r.grp for r in found.collect()} == want
    assert "_block" in found._jdf.queryExecution().executedPlan().toString()


def test_masks_by_block_and_day(spark, small_blocks):
    rows = [r for r in rows_of(2) if r[0]]
    series = spark.createDataFrame(rows, SERIES)
    spans = [("a", 3, 30), ("a", 10, 12), ("b", 80, 89), ("b", 0, 0)]
    inside = lambda p, i: int(any(q == p and a <= i <= b for q, a, b in spans))
    want = {(p, i): inside(p, i) for p, i, _, _ in rows}
    segments = spark.createDataFrame(spans, "point string, start_pos long, end_pos long")
    at = {(p, i): t for p, i, t, _ in rows}
    ranges = spark.createDataFrame([(p, at[p, a], at[p, b]) for p, a, b in spans], "point string, start_ts timestamp, end_ts timestamp")
    for found in (core.mask_from_segments(series, segments), core.mask_in_time(series, ranges)):
        assert {(r.point, r.pos): r.mask for r in found.collect()} == want
        assert len(found.columns) == 5


def test_rows_without_a_time_or_a_point_are_numbered(spark):
    rows = [("a", None, 1.0), ("a", datetime(2024, 1, 2), 2.0), (None, datetime(2024, 1, 1), 3.0), (None, datetime(2024, 1, 3), 4.0)]
    found = core.with_positions_by_bucket(spark.createDataFrame(rows, "point string, ts timestamp, value double"), "value")
    assert sorted((r.value, r.pos) for r in found.collect()) == [(1.0, 0), (2.0, 1), (3.0, 0), (4.0, 1)]


def test_points_in_names(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("ab_é") for _ in range(r.randint(0, n)))
    points, names = [word(6) for _ in range(80)] + [None], [word(14) for _ in range(120)] + [None]
    frame = lambda x, c: spark.createDataFrame([(v,) for v in x], f"{c} string")
    want = {(p, n) for p in points if p for n in names if n and p in n}
    for few in (matching.FEW, 0):
        matching.FEW, kept = few, matching.FEW
        got = matching.substring_candidates(frame(points, "point"), frame(names, "file_name")).collect()
        matching.FEW = kept
        assert len(got) == len(want) and {(x.point, x.file_name) for x in got} == want


def test_bleu_of_rows_needs_no_shuffle(spark):
    pairs = spark.createDataFrame([(1, "abcab", "abcaab"), (2, None, "a"), (3, "x", "y"), (4, "日本日本", "日本語")], "id long, p string, t string")
    found = labels.bleu(pairs, "id", "p", "t")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    grams = lambda t, n: Counter(t[i : i + n] for i in range(len(t) - n + 1))
    score = {}
    for i, p, t in ((1, "abcab", "abcaab"), (4, "日本日本", "日本語")):
        zeros, out = 0, 1.0
        for n in range(1, 5):
            m, size = sum((grams(p, n) & grams(t, n)).values()), max(len(p) - n + 1, 1)
            zeros += m == 0
            out *= (m / size if m else 1 / (2**zeros * size)) ** 0.25
        score[i] = 100 * out * (1 if len(p) > len(t) else 2.718281828459045 ** (1 - len(t) / len(p)))
    got = {r.id: r.bleu for r in found.collect()}
    assert got[2] == got[3] == 0 and all(abs(got[i] - s) < 1e-3 for i, s in score.items())


def test_trees_are_sent_once_to_a_block(spark, monkeypatch):
    monkeypatch.setattr(detect, "BLOCK", 50)
    r = random.Random(5)
    rows = [(p, i, datetime(2024, 1, 1), 100.0 if i == 77 else r.random()) for p in "ab" for i in range(400)]
    found = detect.hits_isolation(spark.createDataFrame(rows, SERIES), share=0.002).collect()
    assert {("a", 77), ("b", 77)} <= {(x.point, x.pos) for x in found}
    monkeypatch.setattr(detect, "BLOCK", 1000)
    again = detect.hits_isolation(spark.createDataFrame(rows, SERIES), share=0.002).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
