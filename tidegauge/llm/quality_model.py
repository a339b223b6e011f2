"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Boosting goes round the features in turn; a step fits a shallow tree to the
log-loss gradient over one feature's bins and adds its leaf values to that feature's table. Then the pairs of
features that explain most of what is left get tables of their own in the same way. A score is the logistic of the
intercept plus one table entry for each feature and pair, looked up for a whole batch at once.

It is fitted on at most SAMPLE labelled rows, those of the smallest hashed ids.

Edge cases: a null text is empty and scored as such; null labels are left out; several labels of a document are
rows each; with labels of one kind or none the score is their smoothed share; repeated rows are scored alike.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import remainder, steps, texts_of

DIVISOR, HELD_OUT = 3, 1
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAST_HESSIAN, SHRINK = 150, 60, 0.1, 2.0, 1.0
FEATURES = ("n_words", "word_length", "longest_word", "upper", "digits", "symbols", "bars", "bangs", "stops", "commas", "non_ascii", "lines", "line_words", "repeated_lines", "distinct_words", "top_word", "echoes", "short_words", "marked_words", "repeated_pairs")
_LETTERS = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum())


def features(b: bytes) -> list[float]:
    words = b.split()
    n = max(len(words), 1)
    size = max(len(b), 1)
    lines = [x for x in b.split(b"\n") if x.strip()]
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    letters = len(b.translate(None, _LETTERS))
    share = lambda chars: (len(b) - len(b.translate(None, chars))) / size
    lengths = list(map(len, words))
    return [
        len(words),
        sum(lengths) / n,
        max(lengths, default=0),
        share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        share(b"0123456789"),
        share(b"#*$%&<>@^~"),
        share(b"|"),
        share(b"!?"),
        share(b"."),
        share(b",;:"),
        share(bytes(range(128, 256))),
        len(lines),
        len(words) / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1),
        len(seen) / n,
        max(seen.values(), default=0) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        sum(x <= 3 for x in lengths) / n,
        letters / n,
        1 - pairs / max(len(words) - 1, 1) if pairs else 0.0,
    ]


@dataclass
class Additive:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for table, b in zip(self.tables, self.bins(x, self.edges)):
            total += table[b]
        if self.pairs:
            c = self.bins(x, self.coarse)
            for (i, j), table in zip(self.pairs, self.pair_tables):
                total += table[c[i], c[j]]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]


def _value(g, h):
    return g / (h + SHRINK)


def _gain(g, h):
    return np.where(h >= LEAST_HESSIAN, g * g / (h + SHRINK), -np.inf)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value of each bin under a tree of two levels over the ordered bins."""

    def split(a: int, b: int) -> int | None:
        if b - a < 2:
            return None
        gl, hl = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
        gain = _gain(gl, hl) + _gain(g[a:b].sum() - gl, h[a:b].sum() - hl)
        k = int(gain.argmax())
        return a + k + 1 if gain[k] > g[a:b].sum() ** 2 / (h[a:b].sum() + SHRINK) + 1e-9 else None

    cuts = {0, len(g)}
    if (root := split(0, len(g))) is not None:
        cuts |= {root} | {c for c in (split(0, root), split(root, len(g))) if c is not None}
    out = np.zeros(len(g))
    for a, b in zip(sorted(cuts), sorted(cuts)[1:]):
        out[a:b] = _value(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts either feature once."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def parts(c):
        a = c[1:-1, 1:-1]
        return np.stack([a, c[1:-1, -1:] - a, c[-1:, 1:-1] - a, c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + a])

    out = np.zeros_like(g)
    if min(g.shape) < 2:
        return 0.0, out
    pg, ph = parts(cg), parts(ch)
    gain = (pg * pg / (ph + SHRINK)).sum(0)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = _value(pg[:, i, j], ph[:, i, j])
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    model = Additive()
    positive = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(positive / (1 - positive)))
    if len(np.unique(y)) < 2:
        return model
    model.edges, model.coarse = _edges(x, BINS), _edges(x, PAIR_BINS)
    fine, rough = model.bins(x, model.edges), model.bins(x, model.coarse)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def gradient():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(fine):
            g, h = gradient()
            n = len(model.tables[j])
            step = RATE * _tree(np.bincount(b, g, n), np.bincount(b, h, n))
            model.tables[j] += step
            total += step[b]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        n, m = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        return np.bincount(rough[i] * m + rough[j], v, n * m).reshape(n, m)

    g, h = gradient()
    ranked = sorted(((_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in ranked[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = gradient()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            table += step
            total += step[rough[i], rough[j]]
    return model


def _features_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([features(t) for t in texts_of(batch.column("text"))], np.float64).reshape(-1, len(FEATURES))


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Additive:
    """docs: (doc_id, text); labels: (doc_id, label), training rows only."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)  # `sample` rows at most, so it may be broadcast

    def run(batches):
        for batch in steps(batches):
            x = _features_of(batch)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("y")], names=["x", "y"])

    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y").mapInArrow(run, "x array<double>, y double").toArrow()
    y = np.asarray(got["y"].combine_chunks())
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order in which tasks end
    return fit(x[order], y[order])


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    train = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label)).where(remainder(F.col("doc_id"), DIVISOR) != HELD_OUT)
    shared = spark.sparkContext.broadcast(train_quality(base, train, label, sample))

    def run(batches):
        for batch in steps(batches):
            s = shared.value.score(_features_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    marked = base.withColumn("held_out", remainder(F.col("doc_id"), DIVISOR) == HELD_OUT)
    return marked.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
