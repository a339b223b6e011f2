"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

n-grams of 1 to MOST characters are hashed to BUCKETS features. Their document frequencies are counted by Spark over
all training documents. The weights are trained by follow-the-regularised-leader with elastic-net penalties on at
most SAMPLE training documents. Spark counts the distinct training rows of each language, and each gets an equal share of SAMPLE,
those of its smallest hashes of id and text; what small languages leave over goes to the others. A share is never under
LEAST, so only more than SAMPLE / LEAST languages take more rows. A fifth of the sample is held back to fit a
temperature, but never all rows of a language. A language costs the driver and each worker about 0.8 MB.

Edge cases: a text that is null or has no letter is `und` with score 0; a null lang is never learned from; without
training documents every document is `und`; ties go to the first language in order; repeated rows are judged alike and
count once in the sample, null ids among them by their text; a text of any length is read whole; other columns of docs
are left out, so their names may clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import remainder, splitmix, steps, texts_of

DIVISOR, HELD_OUT = 4, 2
BITS = 15
BUCKETS = 1 << BITS
MOST = 3
SAMPLE, LEAST = 3000, 4
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.05, 0.01, 3
UNKNOWN = "und"


def buckets(text: str) -> np.ndarray:
    """Feature of every n-gram of the lower-cased text with runs of white space as one space."""
    cp = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(cp), np.uint64)
    for n in range(1, MOST + 1):
        if len(cp) < n:
            break
        h = h[: len(cp) - n + 1] * np.uint64(0x100000001B3) + cp[n - 1 :] + np.uint64(n)
        out.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64)


def counts(text: str) -> np.ndarray:
    return np.bincount(buckets(text), minlength=BUCKETS)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Languages:
    names: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, tf: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(tf)
        v = np.log1p(tf[at]) * self.idf[at]
        s = (v @ self.weights[at] / (np.sqrt(v @ v) or 1.0) + self.bias) / self.temperature
        e = np.exp(s - s.max())
        return e / e.sum()


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], held: np.ndarray, model: Languages) -> Languages:
    """rows: (features, counts, class). Those marked in `held` only calibrate."""
    n_class = len(model.names)
    z, sq = np.zeros((BUCKETS + 1, n_class)), np.zeros((BUCKETS + 1, n_class))  # the last row is the bias

    def weight(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -np.sign(zz) * np.maximum(np.abs(zz) - L1, 0) / ((BETA + np.sqrt(sq[at])) / ALPHA + L2)
        return w

    def sparse(i: int) -> tuple[np.ndarray, np.ndarray]:
        at, tf, _ = rows[i]
        v = np.log1p(tf) * model.idf[at]
        return np.append(at, BUCKETS), np.append(v / (np.linalg.norm(v) or 1.0), 1.0)

    order = np.flatnonzero(~held)
    rng = np.random.default_rng(3)
    for _ in range(EPOCHS):
        for i in rng.permutation(order).tolist():
            at, x = sparse(i)
            w = weight(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[rows[i][2]] -= 1
            g = x[:, None] * p
            grown = sq[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(sq[at])) / ALPHA * w
            sq[at] = grown
    every = weight(np.arange(BUCKETS + 1))
    model.weights, model.bias = every[:-1], every[-1]
    logits, truth = [], []
    for i in np.flatnonzero(held).tolist():
        at, x = sparse(i)
        logits.append(x @ every[at])
        truth.append(rows[i][2])
    if logits:
        s, y = np.array(logits), np.array(truth)
        grid = np.exp(np.linspace(np.log(0.05), np.log(5), 120))

        def loss(t: float) -> float:
            u = s / t
            u = u - u.max(1, keepdims=True)
            return float((np.log(np.exp(u).sum(1)) - u[np.arange(len(y)), y]).mean())

        model.temperature = float(min(grid, key=loss))
    return model


def shares(sizes: dict[str, int], sample: int) -> dict[str, int]:
    """Rows of the sample for each language: equal parts, and what small languages leave over goes to the others."""
    out, left = {}, sample
    for k, name in enumerate(sorted(sizes, key=lambda x: (sizes[x], x))):
        out[name] = min(sizes[name], max(left // (len(sizes) - k), LEAST))
        left -= out[name]
    return out


def sampled(train: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[str, int]]:
    """(h, lang, text) of distinct rows, about twice a language's share or more, and the shares. Repeated rows are one row
    before shares are dealt, so they take nothing from their language."""
    chance = F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.coalesce("text", F.lit("")))
    apart = train.select("lang", chance.alias("h")).distinct()
    sizes = {r["lang"]: (r["n"], r["low"]) for r in apart.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("low")).collect()}  # a row for each language
    share = shares({name: n for name, (n, _) in sizes.items()}, sample)

    def bound(name: str) -> int:
        """A hash under which about twice the share lies, and one row at least."""
        n, low = sizes[name]
        want = 2 * share[name] + 20
        return max(low, (1 << 64) * want // n - (1 << 63)) if want < n else (1 << 63) - 1

    bounds = train.sparkSession.createDataFrame([(name, bound(name)) for name in sizes], "lang string, bound long")
    near = train.withColumn("h", chance).join(F.broadcast(bounds), "lang").where("h <= bound")
    return near.select("h", "lang", "text").dropDuplicates(["h", "lang"]), share


def train_languages(train: DataFrame, sample: int = SAMPLE) -> Languages:
    """train: rows (doc_id, text, lang), lang not null."""

    def frequencies(batches):
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in steps(batches):
            for t in texts_of(batch.column("text")):
                seen = np.zeros(BUCKETS, bool)
                seen[buckets(t.decode("utf-8", "replace"))] = True
                total += seen
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["feature", "n"])

    df = train.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS + 1 rows at most
    at, n = np.asarray(df["feature"].combine_chunks()), np.asarray(df["n"].combine_chunks())
    docs = int(n[at == -1].sum())
    freq = np.zeros(BUCKETS)
    freq[at[at >= 0]] = n[at >= 0]
    model = Languages([], np.log((1 + docs) / (1 + freq)) + 0.1, np.zeros((BUCKETS, 0)), np.zeros(0))

    near, share = sampled(train, sample)
    if not share:
        return model

    def features(batches):
        for batch in steps(batches):
            rows = []
            for t in texts_of(batch.column("text")):
                c = counts(t.decode("utf-8", "replace"))
                at = np.flatnonzero(c)
                rows.append((at.astype("<u2").tobytes(), c[at].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), *[pa.array(list(c), pa.binary()) for c in zip(*rows)]], names=["h", "lang", "features", "tf"])

    drawn = near.mapInArrow(features, "h long, lang string, features binary, tf binary").toArrow().to_pylist()
    got, left = [], dict(share)
    for r in sorted(drawn, key=lambda r: (r["h"], r["lang"])):
        if left[r["lang"]] > 0:
            left[r["lang"]] -= 1
            got.append(r)
    model.names = sorted({r["lang"] for r in got})
    code = {name: k for k, name in enumerate(model.names)}
    rows = [(np.frombuffer(r["features"], "<u2").astype(np.int64), np.frombuffer(r["tf"], "<u4"), code[r["lang"]]) for r in got]
    held = splitmix(np.array([r["h"] for r in got], np.int64).view(np.uint64)) % np.uint64(5) == 0
    kind = np.array([code[r["lang"]] for r in got])
    for k in set(range(len(model.names))) - set(kind[~held].tolist()):
        held[np.flatnonzero(kind == k)[0]] = False
    return fit(rows, held, model)


def predict_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row."""
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    base = base.withColumn("held_out", remainder(F.col("doc_id"), DIVISOR) == HELD_OUT)
    shared = spark.sparkContext.broadcast(train_languages(base.where("not held_out and lang is not null"), sample))

    def run(batches):
        model = shared.value
        for batch in steps(batches):
            names, scores = [], []
            for t in texts_of(batch.column("text")):
                t = t.decode("utf-8", "replace")
                if not model.names or not has_letter(t):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = model.probabilities(counts(t))
                names.append(model.names[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return base.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
