"""The stages of the pipeline against plain loops, on the edge rows and on empty tables."""

import math
from collections import Counter

import corpus_pipeline as c
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, docs, empty, simhash, words  # noqa: F401

from tidegauge.llm import quality_model
from tidegauge.llm.common import written
from tidegauge.llm.perplexity_rules import quality_verdicts

STAGES = dict(c.STAGES)


@pytest.fixture(scope="module")
def now(docs):  # noqa: F811
    return written(docs, "docs")


def rows(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_quality_stage_keeps_what_the_rules_keep(spark, now, sf_dir):
    kept = STAGES["quality_rules"](spark, now, sf_dir)
    assert kept.columns == now.columns
    assert rows(kept) == rows(quality_verdicts(now, prefix="v_").where("v_kept"))
    assert all(len(words(t)) >= 50 for _, t in rows(kept)) and sum(rows(kept).values()) > 20


def test_near_dedup_stage_keeps_one_of_each_component(spark, now, sf_dir):
    source = [(r.doc_id, r.text) for r in now.collect()]
    fp = np.array([simhash(t) for _, t in source], np.uint64)
    label = list(range(len(source)))
    for i in range(len(source)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4):
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    first = {}
    for k, (d, _) in enumerate(source):
        first.setdefault(label[k], []).append((math.inf if d is None else d, k))
    want = Counter(source[min(x)[1]] for x in first.values())
    got = rows(STAGES["near_dedup"](spark, now, sf_dir))
    assert got == want and len(want) < len(source)


def test_substring_stage_cuts_what_an_earlier_row_has(spark, now, sf_dir):
    source = [(math.inf if r.doc_id is None else r.doc_id, r.doc_id, r.text, words(r.text)) for r in now.collect()]
    first = {}
    for i, _, _, w in source:
        for j in range(len(w) - 12):
            g = tuple(w[j : j + 13])
            first[g] = min(first.get(g, math.inf), i)
    want = Counter()
    for i, own, text, w in source:
        cut = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                cut[j : j + 13] = [True] * 13
        want[own, b" ".join(x for x, gone in zip(w, cut) if not gone).decode() if any(cut) else text] += 1
    out = STAGES["substring_dedup"](spark, now, sf_dir)
    assert out.columns == now.columns and rows(out) == want


def test_decontamination_stage_drops_planted_items_alone(spark, empty, sf_dir):  # noqa: F811
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 150").orderBy("item_id").limit(5).collect()]
    plain = " ".join(f"plain{i}" for i in range(80))
    planted = [(k, f"{plain} {t} {plain}") for k, t in enumerate(items)] + [(0, f"{items[0]} after"), (None, items[1]), (3, items[3])]
    clean = [(3, plain), (None, None), (None, plain), (10, ""), (11, " ".join(items[0].split()[:4]))]
    made = written(spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", "z") for i, t in planted + clean], SCHEMA), "made")
    assert rows(STAGES["decontamination"](spark, made, sf_dir)) == Counter(clean)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_an_empty_table(spark, empty, sf_dir, name):  # noqa: F811
    out = STAGES[name](spark, written(empty, "empty"), sf_dir)
    assert out.count() == 0 and (name == "packing" or out.columns == empty.columns)


def test_quality_scores_rank_held_out_rows(spark):
    """The share of pairs of a good and a bad held-out row that the score puts in order; a constant gives a half."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality_model.score_quality(spark.read.parquet(f"{folder}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").select("score", F.col("quality").alias("q")).collect()
    good, bad = (np.array([r.score for r in got if r.q == k]) for k in (1, 0))
    share = (np.sum(good[:, None] > bad) + np.sum(good[:, None] == bad) / 2) / (len(good) * len(bad))
    print("share", share, len(good), len(bad))
    assert min(len(good), len(bad)) > 10 and share > 0.85
