"""LM scoring with a log-bilinear neural model trained by noise-contrastive estimation.

Tokens are the words of the lower-cased text (A-Z only) and one end. Spark counts every token of the training
documents. The HEAD most frequent tokens, the end among them, are the vocabulary: each has a context vector, and the
model predicts each from the two tokens before in two levels. The OWN most frequent words are classes of their own; the
rest lie by falling count in classes of about as many words as there are such classes, so both grow with the counted
vocabulary up to HEAD. A predicted vector is the sum of the context vectors times position weights; its products with
all class vectors, normalised, are the class probabilities, and those with all words of a class the probabilities inside
it. Words beyond HEAD are one class, as context too, in which a word has its add-one share.

Training runs in numpy inside Spark tasks over every token of every training document: each task takes one pass of
noise-contrastive steps from the same start over its share, and Spark averages the vectors, weighted by how often a task
stepped them; the next of the ROUNDS begins with that average.
Scoring works out each distinct context of a step once, and each class once for all its tokens, by matrix products.

A bounded table of the HEAD most frequent tokens goes to all tasks; the counts of other words are joined by Spark,
after adding up equal words of a document.

Edge cases: a null or empty text is the end alone; a null doc_id has the remainder of an empty id; an empty table
gives an empty result; without training tokens every count is zero and the class model is uniform; repeated rows are
scored each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import remainder, steps, sums_by, words_of, written

DIVISOR, HELD_OUT = 7, 2
OWN, DIM, CONTEXT = 128, 16, 2
HEAD = 65_536
NOISE, INNER_NOISE, BATCH, RATE = 16, 6, 4096, 0.15
#: Each round trains on its share of the documents from the average of the round before.
ROUNDS = 2
#: Start of the AdaGrad sums: of tables that a batch touches widely, and of those with a row for each word.
DENSE, SPARSE = 1e-2, 1e-8
#: The end token as a key; no word contains white space.
END = b"\n"
#: Numbers of a token and of its class; vocabulary words follow from WORDS on.
OTHER, START, STOP, WORDS = 0, 1, 2, 3


def count_tokens(train: DataFrame) -> DataFrame:
    """(word, c) over all texts, added up within each task as far as memory allows before the shuffle."""

    def run(batches):
        parts: list[pa.Table] = []

        def out():
            added = pa.concat_tables(parts).group_by("word").aggregate([("c", "sum")])
            return added.select(["word", "c_sum"]).rename_columns(["word", "c"]).to_batches()

        for batch in steps(batches):
            coded = words_of(batch.column("text"), lower=True)[0].dictionary_encode()
            n = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary))
            words = pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())])
            parts.append(pa.table({"word": words, "c": np.append(n, batch.num_rows)}))
            if sum(map(len, parts)) > 1_000_000:
                yield from out()
                parts = []
        if parts:
            yield from out()

    return train.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Model:
    """Class vectors with biases, word vectors inside classes with biases (column DIM), context vectors, position weights."""

    def __init__(self, head: Head, seed: int = 7):
        rng = np.random.default_rng(seed)
        start = lambda n, more=0: (0.1 * rng.standard_normal((n, DIM + more))).astype(np.float32)
        self.target, self.source = start(head.classes), start(head.size)
        self.inner = np.pad(start(head.grouped, 1), ((0, 0), (0, 1)))  # a column of zeros, so that sums take pairs
        self.weight = np.ones((CONTEXT, DIM), np.float32)
        self.bias = np.log((head.mass + 0.5) / (head.mass + 0.5).sum()).astype(np.float32)  # the class frequencies
        self.inner[:, DIM] = np.log(head.inside)
        self.noise, self.head = head.noise, head

    def params(self) -> list[np.ndarray]:
        return [self.target, self.source, self.weight, self.bias, self.inner]

    def rows(self) -> np.ndarray:
        """All vectors, each with its bias or 0."""
        wide = [np.column_stack((self.target, self.bias)), *[np.pad(p, ((0, 0), (0, 1))) for p in (self.source, self.weight)], self.inner[:, : DIM + 1]]
        return np.concatenate(wide)

    def load(self, rows: np.ndarray) -> None:
        at = np.cumsum([len(self.target), len(self.source), len(self.weight)])
        target, source, weight, self.inner[:, : DIM + 1] = np.split(rows, at)
        self.target[...], self.bias[...] = target[:, :DIM], target[:, DIM]
        self.source[...], self.weight[...] = source[:, :DIM], weight[:, :DIM]

    def predict(self, context: np.ndarray) -> np.ndarray:
        return sum(self.source.take(context[:, j], axis=0) * self.weight[j] for j in range(CONTEXT))

    def log_norm(self, pred: np.ndarray) -> np.ndarray:
        """Log of the normaliser of each predicted vector, by matrix products over all classes but the start."""
        out = np.empty(len(pred), np.float32)
        table = np.column_stack((self.target, self.bias)).T
        table[:, START] = [*[0] * DIM, -1e30]
        wide = np.column_stack((pred, np.ones(len(pred), np.float32)))
        high = np.float32(np.sqrt((self.target * self.target).sum(1).max())), self.bias.max()
        for i in range(0, len(pred), 512):
            some = pred[i : i + 512]
            out[i : i + 512] = _log_sums(wide[i : i + 512] @ table, some, *high)
        return out

    def log_inside(self, pred: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Log probability of each token inside its class; 0 where a class has one token or is that of others."""
        head, out = self.head, np.zeros(len(word), np.float32)
        at = np.flatnonzero(word >= head.first)
        group = ((word[at] - head.first) // head.group).astype(np.uint16)
        order = np.argsort(group, kind="stable")
        at, group = at[order], group[order]
        cuts = np.searchsorted(group, np.arange(head.classes - head.first + 1)) if len(at) else [0]
        wide = np.column_stack((pred, np.ones(len(pred), np.float32)))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            table = self.inner[k * head.group : (k + 1) * head.group, : DIM + 1]
            high = np.float32(np.sqrt((table[:, :DIM] ** 2).sum(1).max())), table[:, DIM].max()
            for rows in (at[i : min(i + 1024, b)] for i in range(a, b, 1024)):
                some = wide.take(rows, axis=0)
                s = some @ table.T
                mine = s[np.arange(len(rows)), word[rows] - head.first - k * head.group]
                out[rows] = mine - _log_sums(s, some[:, :DIM], *high)
        return out


def _log_sums(s: np.ndarray, pred: np.ndarray, length: float, bias: float) -> np.ndarray:
    """Log of the sum of exponentials of each row, in place; `length` and `bias` are the largest of what pred met."""
    ones = np.ones(s.shape[1], np.float32)
    if len(s) and np.sqrt((pred * pred).sum(1).max()) * length + bias < 80:  # no row can overflow
        return np.log(np.exp(s, out=s) @ ones + np.float32(1e-37))
    top = s.max(1)
    s -= top[:, None]
    return top + np.log(np.exp(s, out=s) @ ones)


class Trainer:
    """Noise-contrastive AdaGrad steps; a batch shares its noise classes, so its products are matrix products."""

    def __init__(self, model: Model, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.square = [np.full(p.shape, sq, np.float32) for p, sq in zip(model.params(), (DENSE, SPARSE, DENSE, DENSE, SPARSE))]
        #: How often each row was stepped.
        self.hits = [np.zeros(len(p)) for p in model.params()]

    def _apply(self, which: int, rows: np.ndarray, grad: np.ndarray) -> None:
        """Add up the gradients of equal rows, then step those rows."""
        p, sq = self.m.params()[which], self.square[which]
        narrow = len(p) <= 1 << 16  # a radix sort
        order = np.argsort(rows.astype(np.uint16), kind="stable") if narrow else np.argsort(rows, kind="stable")
        sorted_rows = rows[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1])))
        at = sorted_rows[first]
        grad = np.ascontiguousarray(grad.take(order, axis=0), np.float32)
        if grad.shape[1] % 2 == 0:  # pairs are added at once
            g = np.add.reduceat(grad.view(np.complex64), first, axis=0).view(np.float32)
        else:
            g = np.add.reduceat(grad, first, axis=0)
        scale = sq.take(at, axis=0)
        scale += g * g
        sq[at] = scale
        np.sqrt(scale, out=scale)
        np.divide(g, scale, out=scale)
        scale *= np.float32(RATE)
        p[at] -= scale
        self.hits[which][at] += np.diff(np.append(first, len(rows)))

    def _inner(self, pred: np.ndarray, word: np.ndarray, g_pred: np.ndarray) -> None:
        """Step the words inside classes against INNER_NOISE even draws from each class met; adds to g_pred."""
        head = self.m.head
        at = np.flatnonzero(word >= head.first)
        if not len(at):
            return
        own = word[at] - head.first
        order = np.argsort((own // head.group).astype(np.uint16), kind="stable")
        at, own = at[order], own[order]
        group = own // head.group
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        count = np.diff(np.append(first, len(at)))
        low = group[first] * head.group
        size = np.minimum(head.group, head.grouped - low)
        drawn = low[:, None] + np.minimum((self.rng.random((len(low), INNER_NOISE)) * size[:, None]).astype(np.int64), size[:, None] - 1)
        wide = np.zeros((len(at), DIM + 2), np.float32)
        wide[:, :DIM], wide[:, DIM] = pred.take(at, axis=0), 1
        true, noise = self.m.inner.take(own, axis=0), self.m.inner.take(drawn, axis=0)
        chance = np.log(INNER_NOISE / size).astype(np.float32)
        spread = np.repeat(np.arange(len(low)), count)
        near = noise.take(spread, axis=0)
        n = np.float32(1 / len(word))
        g_true = -n / (1 + np.exp(np.clip(np.einsum("id,id->i", true, wide) - chance[spread], -30, 30)))
        g_false = n / (1 + np.exp(np.clip(chance[spread, None] - np.einsum("ikd,id->ik", near, wide), -30, 30)))
        g_pred[at] += g_true[:, None] * true[:, :DIM] + np.einsum("ik,ikd->id", g_false, near)[:, :DIM]
        g_noise = (g_false[:, :, None] * wide[:, None, :]).reshape(len(at), -1).view(np.complex64)  # pairs are added at once
        g_noise = np.add.reduceat(g_noise, first, axis=0).view(np.float32).reshape(-1, DIM + 2)
        self._apply(4, np.concatenate((own, drawn.ravel())), np.concatenate((g_true[:, None] * wide, g_noise)))

    def step(self, context: np.ndarray, token: np.ndarray) -> None:
        m = self.m
        word, classes = m.head.class_of[token], m.head.classes
        noise = self.rng.choice(classes, NOISE, p=m.noise)
        sources = [m.source.take(context[:, j], axis=0) for j in range(CONTEXT)]
        pred = sum(x * w for x, w in zip(sources, m.weight))
        offset = np.log(NOISE * m.noise).astype(np.float32) - m.bias
        target, others = m.target.take(word, axis=0), m.target[noise]
        # the classifier tells the true class of a row from the noise; gradients are means over the batch
        n = np.float32(1 / len(word))  # keeps everything in single precision
        true = offset.take(word) - np.einsum("ij,ij->i", pred, target)
        g_true = -n / (1 + np.exp(np.clip(-true, -30, 30)))  # n times (probability - 1)
        g_false = pred @ others.T
        np.subtract(offset[noise], g_false, out=g_false)
        np.minimum(g_false, 30, out=g_false)
        np.exp(g_false, out=g_false)
        g_false += 1
        np.divide(n, g_false, out=g_false)
        g_pred = g_true[:, None] * target + g_false @ others
        self._inner(pred, token, g_pred)
        g_target = np.concatenate((g_true[:, None] * pred, g_false.T @ pred))
        g_source = np.concatenate([g_pred * w for w in m.weight])
        g_weight = np.stack([np.einsum("ij,ij->j", g_pred, x) for x in sources])
        both = np.concatenate((word, noise))
        g_bias = np.bincount(both, np.concatenate((g_true, g_false.sum(0))), classes).astype(np.float32)
        self._apply(0, both, g_target)
        self._apply(1, context.T.ravel(), g_source)
        for which, g in ((2, g_weight), (3, g_bias)):
            self.square[which] += g * g
            m.params()[which][...] -= RATE * g / np.sqrt(self.square[which])
        self.hits[2] += 1

    def stepped(self) -> np.ndarray:
        """Hits of all rows, in the order of Model.rows."""
        return np.concatenate([self.hits[k] for k in (0, 1, 2, 4)])


class Head:
    """The most frequent tokens with their counts, numbers and classes."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int):
        self.words, self.end = pa.array(words, pa.binary()), words.index(END) if END in words else len(words)
        self.counts, self.total, self.distinct = np.append(counts, 0), total, distinct
        ids = {w: i + WORDS for i, w in enumerate(w for w in words if w != END)} | {END: STOP}
        #: Token number by code; an unknown word has the last code.
        self.id_of = np.array([ids[w] for w in words] + [OTHER], np.int32)
        self.size, self.first = len(ids) + WORDS - 1, OWN + WORDS
        # words from number `first` on lie in classes of `group` words
        self.grouped = max(self.size - self.first, 0)
        self.group = max(math.isqrt(max(self.grouped - 1, 0)) + 1, 1)
        self.class_of = np.arange(self.size, dtype=np.int32)
        self.class_of[self.first :] = self.first + np.arange(self.grouped) // self.group
        self.classes = int(self.class_of[-1]) + 1
        by_id = np.bincount(self.id_of[:-1], counts, self.size)
        n = np.bincount(self.class_of, by_id, self.classes)
        n[OTHER] = total - n[2:].sum()
        self.mass = n
        inside = by_id[self.first :] + 0.5
        #: Shares of the grouped words in their classes.
        self.inside = inside / np.bincount(np.arange(self.grouped) // self.group, inside)[np.arange(self.grouped) // self.group] if self.grouped else inside
        noise = (n + 1) ** 0.75
        noise[START] = 1e-9
        self.noise = noise / noise.sum()
        #: Add-one shares inside the class of others: its tokens, its distinct words and one unseen word.
        self.other_total = n[OTHER] + max(distinct - len(words), 0) + 1

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Codes of all tokens (an end after each text), tokens per text, the words, and the places of the words among
        the tokens."""
        words, counts = words_of(texts, lower=True)
        at = np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)
        out = np.full(len(words) + len(counts), self.end, np.int32)
        out[at] = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), len(self.words)))
        return out, counts + 1, words, at

    def contexts(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each token and the numbers of the CONTEXT tokens before it, nearest first."""
        c = self.id_of[codes]
        ends = np.cumsum(lengths) - 1
        c[ends] = STOP
        first = ends - lengths + 1
        place = np.arange(len(c)) - np.repeat(first, lengths)
        out = np.full((len(c), CONTEXT), START, np.int32)
        for j in range(1, CONTEXT + 1):
            at = np.flatnonzero(place >= j)
            out[at, j - 1] = c[at - j]
        return c, out


VALUES = [f"v{k}" for k in range(DIM + 1)]


def _train(head_shared, rows_shared=None):
    def run(batches):
        head = head_shared.value
        model = Model(head)
        if rows_shared:
            model.load(rows_shared.value)
        trainer = None
        for batch in steps(batches):
            texts = batch.column("text")
            trainer = trainer or Trainer(model, len(texts[0].as_py() or "") if len(texts) else 0)
            codes, lengths, *_ = head.codes(texts)
            word, context = head.contexts(codes, lengths)
            order = trainer.rng.permutation(len(word))
            for i in range(0, len(order), BATCH):
                at = order[i : i + BATCH]
                trainer.step(context[at], word[at])
        if trainer:
            hits = trainer.stepped()
            at = np.flatnonzero(hits)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(hits[at]), *map(pa.array, np.ascontiguousarray(model.rows()[at].T))], names=["i", "n", *VALUES])

    return run


def _counted(words: pa.Array, text: np.ndarray, n_texts: int) -> pa.ListArray:
    """For each text the distinct ones of its words with their counts."""
    coded = words.dictionary_encode()
    kinds = max(len(coded.dictionary), 1)
    key, n = np.unique(text * kinds + np.asarray(coded.indices), return_counts=True)
    pairs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(key % kinds)), pa.array(n.astype(np.int64))], names=["word", "n"])
    edges = np.searchsorted(key // kinds, np.arange(n_texts + 1))
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pairs)


def _score(head_shared, flat_shared):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"]

    def run(batches):
        head = head_shared.value
        model = Model(head)
        model.load(flat_shared.value)
        log_n = np.log10(head.total + head.distinct + 1)
        known = head.counts > 0
        logs = np.log10(head.counts + 1.0) - log_n
        logs[-1] = -log_n  # the count of a word outside the head is added by the join
        within = np.where(head.id_of == OTHER, np.log10(head.counts + 1.0) - np.log10(head.other_total), 0.0)
        for batch in steps(batches):
            codes, lengths, words, places = head.codes(batch.column("text"))
            word, context = head.contexts(codes, lengths)
            distinct = pa.array(context[:, 0].astype(np.int64) * head.size + context[:, 1]).dictionary_encode()
            met, back = np.asarray(distinct.dictionary), np.asarray(distinct.indices)
            once = model.predict(np.column_stack(np.divmod(met, head.size)))
            pred, kind = once.take(back, axis=0), head.class_of[word]
            exact = model.log_inside(pred, word) - model.log_norm(once)[back]
            exact += np.einsum("ij,ij->i", pred, model.target.take(kind, axis=0)) + model.bias[kind]
            log10 = exact / np.log(10) + within[codes]
            text = np.repeat(np.arange(len(lengths)), lengths - 1)
            beyond = np.flatnonzero(codes[places] == len(head.words))
            rare = _counted(words.take(pa.array(beyond)), text[beyond], len(lengths))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(lengths), pa.array(sums_by(known[codes], lengths).astype(np.int64)), pa.array(sums_by(logs[codes], lengths)), pa.array(sums_by(log10, lengths)), rare]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("held_out", remainder(F.col("doc_id"), DIVISOR) == HELD_OUT)
    train = base.where("not held_out")

    counts = written(count_tokens(train), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    words, c = top["word"].to_pylist(), np.asarray(top["c"].combine_chunks(), np.int64)
    order = np.lexsort((np.array(words, dtype=object), -c)) if len(words) else []
    words, c = [bytes(words[i]) for i in order], c[order].tolist() if len(words) else []
    if END not in words:
        own = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        words, c = [*words, END], [*c, own]
    head = Head(words, np.array(c, np.int64), total, distinct)
    head_shared = spark.sparkContext.broadcast(head)

    rows, start = Model(head).rows(), None
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS))
    for k in range(ROUNDS):
        stepped = train.where(part == k).select("text").mapInArrow(_train(head_shared, start), "i int, n double, " + ", ".join(f"{v} float" for v in VALUES))
        averaged = stepped.groupBy("i").agg(*[(F.sum(F.col(v) * F.col("n")) / F.sum("n")).cast("float").alias(v) for v in VALUES]).toArrow()  # 2 * HEAD rows and the classes at most
        rows[np.asarray(averaged["i"].combine_chunks())] = np.column_stack([np.asarray(averaged[v].combine_chunks()) for v in VALUES])
        start = spark.sparkContext.broadcast(rows.copy())

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,n:bigint>>"
    rows = base.withColumn("doc_id", F.col("doc_id").cast("long")).select("doc_id", "held_out", "text").mapInArrow(_score(head_shared, start), schema)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    # Words outside the head, each once a document, meet their counts.
    rare = rows.select("row", F.inline("rare"))
    met = rare.join(counts, "word").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("met"))
    joined = rows.join(met, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
