"""Density components, mean shifts, the residual pipeline, file matching, the review queue and text measures."""

import math
import random
from collections import Counter, deque
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import density, detect, labels, matching, mean_shift, records, residual, split
from tidegauge.operators.review_queue import ReviewQueue
from tidegauge.plans import q_residual


def by_search(f):
    """Component of each segment by comparing all."""
    f = np.asarray(f, float)
    n, sd = len(f), f.std(0)
    z = np.round(np.where(sd > 1e-12, (f - f.mean(0)) / np.where(sd > 1e-12, sd, 1), 0), 6)
    far = lambda i: np.round(np.sqrt(((z - z[i]) ** 2).sum(1)), 9)
    label = np.full(n, -1)
    if n > 1:
        k = min(2, n - 1)
        eps = round(np.percentile([np.partition(np.delete(far(i), i), k - 1)[k - 1] for i in range(n)], 75), 9)
    for s in range(n):
        if label[s] < 0:
            label[s], queue = s, deque([s])
            while queue and n > 1:
                for j in np.flatnonzero((far(queue.popleft()) <= eps) & (label < 0)):
                    label[j] = s
                    queue.append(j)
    return label


@pytest.mark.parametrize("leaf", [4])
def test_density_components_equal_a_search(spark, monkeypatch, leaf):
    monkeypatch.setattr(density, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    points = {
        "one": [[1, 2]],
        "two": [[1, 2], [3, 4]],
        "same": [[1, 1]] * 7,
        "pairs": [[0, 0], [0, 0], [5, 5], [5, 5]],
        "null": [[None, 1], [0, 1], [9, None]],
        "even": rng.random((150, 2)),
        "dense": np.concatenate([rng.normal(0, 1e-3, (400, 2)), rng.normal(0, 1, (150, 2)), rng.normal([8, 3], 0.2, (100, 2)), np.repeat([[3.0, 3.0]], 60, 0)]),
        "line": [[i, 0] for i in range(60)],
    }
    rows = [(p, i + 1, *[None if v is None else float(v) for v in x]) for p, f in points.items() for i, x in enumerate(f)]
    table = spark.createDataFrame(rows, "point string, seg_id long, mean_ratio double, range_ratio double").repartition(3)
    got = {(r.point, r.seg_id): r.component for r in density.density_components(table).collect()}
    assert len(got) == len(rows)
    for p, f in points.items():
        want = by_search([[0 if v is None else v for v in x] for x in f])
        assert [got[p, i + 1] - 1 for i in range(len(f))] == want.tolist(), p


def test_each_rule_of_the_cascade_has_a_point(spark):
    rng = np.random.default_rng(8)
    u = rng.random(4000)
    k = np.arange(4000) // 4
    shapes = {
        "edge": 100 + 20 * u + np.where((k >= 600) & (k < 640), 80, 0),
        "knee": np.where((k >= 500) & (k < 600), 175 + 25 * u, np.where(u < 0.68, 100 + 5 * u, 105 + 70 * (u - 0.68) / 0.32)),
        "groups": np.where((k >= 300) & (k < 700), 195 + 5 * u, np.where(u < 0.75, 100 + 5 * u, 105 + 90 * (u - 0.75) / 0.25)),
        "none": 100 + u,
    }
    table = spark.createDataFrame([(p, i, float(v)) for p, y in shapes.items() for i, v in enumerate(y)], "point string, pos long, value double")
    got = {r.point: (r.rule, r.start_pos, r.end_pos) for r in mean_shift.mean_shift_cascade(table, longer=50).collect()}
    assert got.keys() == {"edge", "knee", "groups"} and all(v[0] == p for p, v in got.items())
    assert got["edge"][1:] == (2400, 2559) and got["groups"][1] == 1200
    assert mean_shift.mean_shift_cascade(table.limit(0)).count() == 0


@pytest.fixture(scope="module")
def kinds(spark, sf_dir):
    return q_residual.kinds_series(spark, sf_dir.replace("sf0.001", "sf0.01"))


ARGS = dict(n_out=800, th=3.0, period=96, range_th=0.5)


def test_gated_points_keep_their_rows(kinds):
    out = residual.residual_pipeline(kinds, **ARGS)
    hits = {r.point: (r.n, r.s) for r in out.groupBy("point").agg(F.count("*").alias("n"), F.sum("outlier_mask").alias("s")).collect()}
    # the step point's few levels leave few rows to sample
    assert len(hits) == 5 and hits["click"][1] == hits["error"][1] == 0 and min(n for n, _ in hits.values()) > 0
    assert all(hits[p][1] > 0 for p in ("purchase", "signup", "view")), hits


def test_clusters_and_post_filter_are_those_of_their_operators(spark, kinds):
    from tidegauge.operators.core import expanded, split_runs
    from tidegauge.operators.features import segment_features

    out = residual.residual_pipeline(kinds, **ARGS, cluster="dbscan", dead_seconds=1e12, post_filter=0.4)
    plain = residual.residual_pipeline(kinds, **ARGS, dead_seconds=1e12)
    runs = split_runs(plain.where("outlier_mask > 0").select("point", "pos"))
    marked = plain.join(expanded(runs, "seg_id"), ["point", "pos"]).select("point", "seg_id", "pos", "value")
    sides = density.split_by_density(segment_features(plain.select("point", "pos", "value"), marked).select("point", "seg_id", "mean_ratio", "range_ratio"))
    several = runs.groupBy("point").count().where("count > 1")
    want = {(r.point, r.pos) for r in expanded(runs.join(sides.where("is_global"), ["point", "seg_id"]).join(several, "point"), "seg_id").collect()}
    got = {(r.point, r.pos) for r in out.where("global_mask_cluster = 1").join(several, "point").collect()}
    assert got == want
    widened = detect.deviating_groups(plain.select("point", "pos", "value", F.col("global_mask").alias("mask")), th=0.4)
    assert {(r.point, r.pos, r.global_mask) for r in out.collect()} == {(r.point, r.pos, r.mask) for r in widened.collect()}


@pytest.mark.parametrize("method, th", [("piecewise_linear", 1.5), ("cv", 3.0), ("standardized", 2.0), ("iforest", 0.02)])
def test_every_method_goes_through_the_pipeline(kinds, method, th):
    out = residual.residual_pipeline(kinds, 400, method=method, th=th, merge=3, components=None)
    assert set(residual.MASKS) <= set(out.columns)
    assert out.where("outlier_mask > 0").count() > 0
    # every hit is global or local, and nothing else is local
    assert out.where("outlier_mask > 0 and global_mask + local_mask = 0 or outlier_mask = 0 and local_mask = 1").count() == 0


def test_a_slow_wave_is_no_noise_however_few_rows_are_sampled(spark):
    rng = np.random.default_rng(12)
    at = np.arange(20_000)
    shapes = {"wave": 100 + 10 * np.sin(at / 38) + rng.random(20_000) / 10 - np.where(at == 7_000, 25, 0), "noise": rng.normal(0, 1, 20_000)}
    rows = [(p, i, float(v)) for p, y in shapes.items() for i, v in enumerate(y)]
    series = spark.createDataFrame(rows, "point string, pos long, value double").withColumn("ts", F.timestamp_seconds(F.col("pos") * 60))
    out = residual.residual_pipeline(series.select("point", "pos", "ts", "value"), n_out=100, th=1.0, components=None)
    hits = {r.point: r.s for r in out.groupBy("point").agg(F.sum("outlier_mask").alias("s")).collect()}
    assert hits["noise"] == 0 and hits["wave"] > 0


def test_pipeline_of_nothing(kinds):
    assert residual.residual_pipeline(kinds.limit(0), 100, components=None).count() == 0


def test_candidates_equal_a_nested_loop(spark):
    rng = random.Random(4)
    part = lambda: "".join(rng.choice("AB_1.") for _ in range(rng.randrange(1, 6)))
    points = [*{part() for _ in range(80)}, "AC_6403B", "AC6403B", "zz", "", None]
    files = [*{part() + part() + ".csv" for _ in range(150)}, "AC_6403B_2024.csv", "AC6403B.PV_2024.csv", "m4_AC6403B_2024.csv", "a"]
    got = {tuple(r) for r in matching.substring_candidates(spark.createDataFrame([(p,) for p in points], "point string"), spark.createDataFrame([(f,) for f in files], "file_name string")).collect()}
    assert got == {(p, f) for p in points if p for f in files if p in f}
    assert ("AC_6403B", "AC_6403B_2024.csv") in got and ("AC6403B", "AC6403B.PV_2024.csv") in got


def test_ranking_of_files(spark):
    day = lambda n: datetime(2024, 1, n)
    files = [("AC_1.csv", day(1)), ("x_AC_1.csv", day(9)), ("AC_1_trend.csv", day(1)), ("_qwen_AC_1.csv", day(5)), ("AC_1.json", day(9)), ("AC_2_a.csv", day(1)), ("AC_2_b.csv", day(2)), ("AC_2_b.csv", day(1))]
    inventory = spark.createDataFrame(files, "file_name string, modified timestamp")
    points = spark.createDataFrame([(1, "AC_1", None), (2, "AC_1", "trend"), (3, "AC_2", "resid"), (4, "AC_3", None), (5, "AC_1", "qwen")], "k int, point string, hint string")
    got = {r.k: (r.file_name, r.score) for r in matching.best_file(points, inventory, "k", extensions=(".csv",)).collect()}
    # 3 has no file with its hint, so all count, and of equal scores the later one stands
    assert got == {1: ("AC_1.csv", 129.96), 2: ("AC_1_trend.csv", 139.93), 3: ("AC_2_b.csv", 129.95), 5: ("_qwen_AC_1.csv", 91.93)}


@pytest.fixture
def queue(spark, tmp_path):
    return ReviewQueue(spark, f"file://{tmp_path}/queue", 4)


def test_queue_keeps_what_it_has(spark, queue):
    at = lambda n: datetime(2024, 5, n)
    rows = spark.createDataFrame([(str(i), float(i % 5)) for i in range(40)] + [("3", 9.0), (None, 1.0)], "source_id string, score double")
    assert queue.read().count() == 0 and queue.stats().where("status is not null").count() == 0
    assert queue.enqueue(rows, at(1)) == 40 and queue.enqueue(rows, at(2)) == 0
    assert queue.read().where("source_id = '3'").first().score == 9.0
    ids = sorted(r.id for r in queue.read().collect())
    assert queue.decide_all(ids[:3] + ["nobody"], "approved", "ann", at(3)) == 3
    before = queue.read().collect()
    assert queue.decide_all(ids[:3], "approved", "ann", at(4)) == 0  # the same batch again
    assert sorted(queue.read().collect()) == sorted(before)
    assert queue.decide_all(ids[2:4], "rejected", "bob", at(5)) == 2
    assert Counter(r.status for r in queue.read().collect()) == {"approved": 2, "rejected": 2, "pending": 36}
    assert [r.updated_at for r in queue.listing(limit=2).collect()] == [at(5), at(5)]
    assert {(r.status, r.n) for r in queue.stats(reviewer="bob").collect()} == {("rejected", 2), (None, 2)}
    # old versions stay as they were
    assert Counter(r.status for r in queue.read(1).collect()) == {"pending": 40}
    assert queue.versions().select("version").distinct().count() == 3


def test_queue_refuses_wrong_decisions(spark, queue):
    queue.enqueue(spark.createDataFrame([("1", 1.0)], "source_id string, score double"), datetime(2024, 1, 1))
    with pytest.raises(ValueError):
        queue.decide_all([queue.read().first().id], "maybe", "ann", datetime(2024, 1, 2))
    with pytest.raises(ValueError):
        queue.decide_all([], "approved", "ann", datetime(2024, 1, 2))


def plain_bleu(p, t):
    logs, zeros = 0.0, 0
    for n in range(1, 5):
        a, b = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (p, t))
        hit, size = sum((a & b).values()), max(1, sum(a.values()))
        if n == 1 and not hit:
            return 0.0
        if not hit:
            zeros += 1
        logs += math.log(hit / size if hit else 1 / (2**zeros * size)) / 4
    return 100 * (1.0 if len(p) > len(t) else math.exp(1 - len(t) / len(p))) * math.exp(logs)


def test_bleu_equals_plain_python(spark):
    pairs = [("abcdefg hij", "abcxdefg hij"), ("abc", "abc"), ("a", "ab"), ("xyz", "abc"), ("", "abc"), (None, "abc"), ("abc", None), ("日本語のテスト", "日本のテスト"), ("aaaa", "aa")]
    got = {r.id: r.bleu for r in labels.bleu(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, p string, t string"), "id", "p", "t").collect()}
    for i, (p, t) in enumerate(pairs):
        assert got[i] == pytest.approx(plain_bleu(p or "", t or ""), abs=1e-4), pairs[i]


def test_all_attribute_values_have_words(spark):
    values = [(k, v, word) for k, table in records.ATTRIBUTES.items() for v, word in table.items()]
    df = spark.createDataFrame([({k: v}, word) for k, v, word in values], "a map<string,string>, word string")
    assert len(values) == 14 and df.where(records.attribute_text(F.col("a")) != F.col("word")).count() == 0


def test_index_spaces(spark):
    s = spark.createDataFrame([(p, i, float(i)) for p in "abcde" for i in range(6)], "point string, pos long, value double")
    at = [0, 2, 5]
    masks = [("a", i, i, int(i > 3)) for i in range(6)] + [("b", k, x, int(k > 0)) for k, x in enumerate(at)] + [("c", k, x, 0) for k, x in enumerate(at)] + [("d", k, None, 1) for k in range(3)] + [("z", 0, 0, 1)]
    m = spark.createDataFrame(masks, "point string, pos long, orig_pos long, mask int")
    assert {r.point: r.index_space for r in residual.index_spaces(s, m).collect()} == {"a": "raw", "b": "raw_mapped", "c": "downsample", "d": "downsample", "e": "empty", "z": "unknown"}
    got = {}
    for r in residual.resolved_masks(s, m).orderBy("pos").collect():
        got.setdefault(r.point, []).append((r.pos, r.mask))
    assert got == {"a": [(i, int(i > 3)) for i in range(6)], "b": [(i, int(i >= 2)) for i in range(6)], "c": [(0, 0), (2, 0), (5, 0)], "d": [(0, 1), (1, 1), (2, 1)], "e": [(i, 0) for i in range(6)]}
