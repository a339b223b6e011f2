"""Quality rules: counting rules plus perplexity bands of a modified Kneser-Ney character model.

The model is of order 4 over 64 symbols, so a 4-gram is a 24-bit number and a model has at most 2**24 entries whatever
the corpus: that is the proven bound of what is collected and broadcast. An ASCII character is one symbol. Others are
two or three, a lead and six bits each, so every script is modelled, letters of two symbols by pairs and those of three
one by one. Perplexity is per character.

Spark counts the 4-grams of every document. Documents fall into two halves by a hash of their text, and each half is
judged by the model of the other, so none is held against itself. The bands are quantiles over every document of a
language: the median plus and minus BAND_WIDTH robust deviations. On the labelled rows of sf0.1 nine of ten documents
that they reject at this width are marked as of low quality.

Edge cases: a null text has no words and fails the base rules; an empty table gives an empty result; a null
language is a language of its own; repeated rows are judged alike, by the half without them; a language whose documents
all have the same perplexity rejects none; texts of any length are judged whole; input columns that bear a result's name
are replaced, others are kept whatever their name.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidegauge.llm.common import appended, splitmix, steps, sums_by, texts_of, written

ORDER, BITS = 4, 6
CODES = 1 << BITS
#: The symbol characters of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_SHARE = 50, 50
#: Half-width of a band in robust standard deviations of log10 perplexity, and its least value.
BAND_WIDTH, LEAST_BAND = 5.0, 0.02
#: Resolution of the histogram of log10 perplexity from which the bands are read.
HIST_STEP = 0.002
#: Languages up to which the table of bands is broadcast; beyond that Spark joins and splits skewed languages.
BROADCAST_LANGUAGES = 50_000

VERDICT = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType())]


def alphabet() -> np.ndarray:
    """Symbol of each ASCII character. 0 is the edge of a text; capital letters are one symbol, and so are digits."""
    out = np.zeros(128, np.uint8)
    out[1:33], out[10] = 1, 2
    out[ord("a") : ord("z") + 1] = np.arange(3, 29)
    out[ord("0") : ord("9") + 1] = 29
    out[ord("A") : ord("Z") + 1] = 30
    marks = [c for c in range(33, 128) if not chr(c).isalnum()]
    out[marks] = 31 + np.arange(len(marks)) % 26
    return out


LETTERS = alphabet()


def symbols(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of code points one after another, and how many each has."""
    size = 1 + (cp >= 0x80) + (cp >= 0x800).astype(np.int64)
    out = np.empty(int(size.sum()), np.uint8)
    first = np.cumsum(size) - size
    out[first] = LETTERS[np.minimum(cp, 127)]
    two, three = np.flatnonzero(size == 2), np.flatnonzero(size == 3)
    out[first[two]] = 57 + (cp[two] >> 6) % 3
    out[first[two] + 1] = cp[two] & 63
    out[first[three]] = 60 + (cp[three] >> 12) % 4
    out[first[three] + 1] = cp[three] >> 6 & 63
    out[first[three] + 2] = cp[three] & 63
    return out, size


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 4-gram code at each symbol of the texts, one after another, and each text's symbols and characters."""
    decoded = [t.decode("utf-8", "replace") for t in texts]
    lengths = np.fromiter(map(len, decoded), np.int64, len(decoded))
    edge = "\0" * (ORDER - 1)
    cp = np.frombuffer((edge + edge.join(decoded)).encode("utf-32-le", "surrogatepass"), np.uint32)
    c, size = symbols(cp)
    c = c.astype(np.int32)
    code = c[3:] | c[2:-1] << BITS | c[1:-2] << 2 * BITS | c[:-3] << 3 * BITS
    upto = np.concatenate(([0], np.cumsum(size)))
    starts = np.cumsum(lengths + ORDER - 1) - lengths
    wide = upto[starts + lengths] - upto[starts]
    at = np.ones(len(code), bool)
    ends = np.cumsum(wide + ORDER - 1)[:-1] - (ORDER - 1)
    for j in range(ORDER - 1):
        at[ends + j] = False
    return code[at], wide, lengths


def base_rules(texts: list[bytes]) -> list[np.ndarray]:
    """Per text: words, characters in words, symbols, repeated lines, words in repeated 3-word windows, verdict."""
    rows = []
    for b in texts:
        words = b.split()
        n = len(words)
        spaces = len(b) - sum(map(len, words))
        chars = len(b.decode("utf-8", "replace")) - spaces
        symbols = sum(map(b.count, (bytes([s]) for s in SYMBOLS)))
        lines = [x for x in b.split(b"\n") if x and not x.isspace()]
        repeat = 0
        tri = list(zip(words, words[1:], words[2:]))
        if len(set(tri)) < len(tri):
            seen: dict = {}
            for w in tri:
                seen[w] = seen.get(w, 0) + 1
            hit = np.fromiter((seen[w] > 1 for w in tri), bool, len(tri))
            covered = np.zeros(n, bool)
            for j in range(3):
                covered[j : j + len(hit)] |= hit
            repeat = int(covered.sum())
        rows.append((n, chars, symbols, len(lines) - len(set(lines)), repeat))
    out = list(np.array(rows, np.int64).reshape(-1, 5).T)
    return [*out, (out[0] < MIN_WORDS) | (100 * out[4] > REPEAT_SHARE * out[0])]


def half_of(text: str) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(2)).cast("int")


def count_grams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(half, code, n): the 4-grams of all documents of each half, added up within each task before the shuffle."""

    def run(batches):
        total = [(np.empty(0, np.int32), np.empty(0, np.int64))] * 2
        for batch in steps(batches, text):
            for half in (0, 1):
                some = batch.filter(pc.equal(batch.column("_half"), half))
                u, k = np.unique(grams(texts_of(some.column(text)))[0], return_counts=True)
                code, n = total[half]
                code, back = np.unique(np.concatenate((code, u)), return_inverse=True)
                total[half] = code, np.bincount(back, np.concatenate((n, k)), len(code)).astype(np.int64)
        for half, (code, n) in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), half, np.int32)), pa.array(code, pa.int32()), pa.array(n, pa.int64())], names=["half", "code", "n"])

    source = docs.select(F.col(text), half_of(text).alias("_half"))
    return source.mapInArrow(run, "half int, code int, n long").groupBy("half", "code").agg(F.sum("n").alias("n"))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more (Chen and Goodman), kept inside (0, count)."""
    n = np.bincount(np.minimum(counts, 5), minlength=6).astype(float)
    if n[1] and n[2] and n[3]:
        y = n[1] / (n[1] + 2 * n[2])
        d = np.array([1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]])
    else:
        d = np.array([0.5, 0.75, 0.9])
    return np.clip(d, 0.05, [0.95, 1.95, 2.95])


@dataclass
class KneserNey:
    """Per order: sorted hashes of the grams with their probabilities, and of the contexts with their back-off weights."""

    keys: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]

    @staticmethod
    def fit(code: np.ndarray, n: np.ndarray) -> KneserNey:
        tables = [(code.astype(np.int64), n.astype(np.int64))]
        for order in range(ORDER - 1, 0, -1):  # a lower order counts in how many ways its gram continues a longer one
            tables.append(np.unique(tables[-1][0] & ((1 << BITS * order) - 1), return_counts=True))
        model = KneserNey([], [], [], [])
        for order, (grams_, counts) in enumerate(reversed(tables), 1):
            d = _discounts(counts)[np.minimum(counts, 3) - 1] if len(counts) else np.empty(0)
            context, back = np.unique(grams_ >> BITS, return_inverse=True)
            total = np.bincount(back, counts, len(context))
            weight = np.bincount(back, d, len(context)) / np.maximum(total, 1)
            lower = model.prob(grams_ & ((1 << BITS * (order - 1)) - 1), order - 1)
            p = (counts - d) / total[back] + weight[back] * lower
            for keys, values, key, value in ((model.keys, model.probs, grams_, p), (model.contexts, model.weights, context, weight)):
                at = np.argsort(hashed := splitmix(key))
                keys.append(hashed[at])
                values.append(value[at])
        return model

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)

    def prob(self, code: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order == 0:
            return np.full(len(code), 1 / CODES)
        out = np.empty(len(code))
        at, seen = self._find(self.keys[order - 1], splitmix(code))
        out[seen] = self.probs[order - 1][at[seen]]
        rest = code[~seen]
        if len(rest):
            at, known = self._find(self.contexts[order - 1], splitmix(rest >> BITS))
            weight = np.where(known, self.weights[order - 1][at] if len(self.weights[order - 1]) else 1, 1.0)
            out[~seen] = weight * self.prob(rest & ((1 << BITS * (order - 1)) - 1), order - 1)
        return out


class Scorer:
    """log10 probabilities of 4-grams; those met before in this worker are remembered by code, in steps of 1 / UNIT."""

    UNIT = 4096.0

    def __init__(self, model: KneserNey):
        self.model, self.memo = model, np.full(1 << BITS * ORDER, 1, np.int16)  # no logarithm is over 0

    def log10(self, code: np.ndarray) -> np.ndarray:
        got = self.memo[code]
        new = np.unique(code[got > 0])
        if len(new):
            self.memo[new] = np.maximum(np.rint(np.log10(self.model.prob(new.astype(np.int64))) * self.UNIT), -32768)
            got = self.memo[code]
        return got / self.UNIT

    def perplexity(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the perplexity per character; an empty text has NaN."""
        code, wide, lengths = grams(texts)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(lengths > 0, -sums_by(self.log10(code), wide) / lengths, np.nan)


_scorers: dict = {}


def scorers(shared) -> list[Scorer]:
    """The scorers of both halves' models, once for each model and Python worker."""
    if shared.id not in _scorers:
        _scorers.clear()
        _scorers[shared.id] = [Scorer(m) for m in shared.value]
    return _scorers[shared.id]


class _Shared:
    def __init__(self, broadcast, key: str):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


def train_perplexity(docs: DataFrame, text: str = "text") -> list[KneserNey]:
    """The models of both halves; what reaches the driver has at most 2**24 rows for each."""
    got = count_grams(docs, text).toArrow()
    half, code, n = (np.asarray(got[c].combine_chunks()) for c in ("half", "code", "n"))
    models = []
    for k in (0, 1):
        at = np.flatnonzero(half == k)
        at = at[np.argsort(code[at])]
        models.append(KneserNey.fit(code[at], n[at]))
    return models


def quality_verdicts(docs: DataFrame, text: str = "text", lang: str = "lang", prefix: str = "") -> DataFrame:
    """docs with base counts, log10 perplexity (`log_ppl`), the language's band (`band_low`, `band_high`) and `kept`.

    `prefix` goes before the new names; columns of docs that bear one of them are replaced.
    """
    spark = docs.sparkSession
    shared = _Shared(spark.sparkContext.broadcast(train_perplexity(docs, text)), uuid.uuid4().hex)
    names = [prefix + n for n in [*(f.name for f in VERDICT), "log_ppl", "band_low", "band_high", "kept"]]
    rest = [c for c in docs.columns if c not in names]

    def perplexities(texts: list[bytes], half: np.ndarray) -> pa.Array:
        out = np.full(len(texts), np.nan)
        for k, model in enumerate(scorers(shared)):
            at = np.flatnonzero(half != k)
            if len(at):
                out[at] = model.perplexity([texts[i] for i in at])
        return pa.array(out, pa.float64(), from_pandas=True)

    def judge(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = texts_of(batch.column("text"))
        return [*map(pa.array, base_rules(texts)), perplexities(texts, np.asarray(batch.column("half")))]

    def only_ppl(batch: pa.RecordBatch) -> list[pa.Array]:
        return [perplexities(texts_of(batch.column("text")), np.asarray(batch.column("half")))]

    # the caller's columns travel in a struct, so their names cannot clash with those used on the way
    base = docs.select(F.col(text).alias("text"), half_of(text).alias("half"), language_key(lang).alias("key"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("rest"))
    ppl = T.StructField("log_ppl", T.DoubleType())
    values = appended(base.drop("rest"), [ppl], only_ppl)
    # The histogram has a row for each language and step: small, and added up before the shuffle.
    hist = written(values.where("log_ppl is not null").groupBy("key", F.floor(F.col("log_ppl") / HIST_STEP).alias("bin")).agg(F.count("*").alias("n")), "ppl-hist")
    bands = band_table(hist)
    judged = appended(base, [*VERDICT, ppl], judge)
    # A join by language would send whole languages to single tasks; the table has a row for each language.
    if hist.select("key").distinct().count() <= BROADCAST_LANGUAGES:
        bands = F.broadcast(bands)
    out = judged.join(bands, "key", "left")
    inside = F.coalesce(F.col("log_ppl").between(F.col("band_low"), F.col("band_high")), F.lit(True))
    out = out.withColumn("kept", ~F.col("base_failed") & inside)
    return out.select(*[F.col("rest")[c].alias(c) for c in rest], *[F.col(n.removeprefix(prefix)).alias(n) for n in names])


def language_key(lang: str) -> Column:
    """A key in which a null language differs from every text."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("null"))


def band_table(hist: DataFrame) -> DataFrame:
    """Median plus and minus BAND_WIDTH robust deviations of each language, from its histogram."""

    def median(df: DataFrame, value: str, name: str) -> DataFrame:
        w = W.partitionBy("key").orderBy(value)
        run = df.groupBy("key", value).agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(W.partitionBy("key")))
        return run.where(F.col("upto") * 2 >= F.col("all")).groupBy("key").agg(F.min(value).alias(name))

    mid = median(hist, "bin", "mid")
    dev = hist.join(mid, "key").select("key", F.abs(F.col("bin") - F.col("mid")).alias("dev"), "n", "mid")
    mad = median(dev, "dev", "mad")
    both = mid.join(mad, "key")
    half = F.greatest(F.lit(LEAST_BAND), F.col("mad") * (HIST_STEP * 1.4826 * BAND_WIDTH))
    centre = (F.col("mid") + 0.5) * HIST_STEP
    return both.select("key", (centre - half).alias("band_low"), (centre + half).alias("band_high"))
