"""Ranked lexical search, term at a time with limited accumulators.

The items are the stated query set; they pass over all documents in blocks whose terms number at most BLOCK_TERMS (or
one longer item), so what a task knows of them is bounded whatever their number. For a block:

1. Each task tokenises whole texts and writes, for every document, its length and its counts of the block's terms: an
   index by document. Lengths and document frequencies are added up over all documents.
2. Each task reads its part of the index in batches and goes through an item's terms, rarest first. A document gets an
   accumulator when a term meets it. Once the sum of the largest contributions that the remaining terms have in the
   batch is below the k-th best partial score, or the k-th best score of the batches before, a document without one can
   no longer come in; from then on only existing accumulators are updated, with all their terms, so scores are exact.
3. A task sends at most k documents an item; Spark ranks these.

Scores are integers (see README), so results do not depend on the order of addition or on how rows are dealt.

Edge cases: a null or empty text, of a document or an item, has no term; rows that repeat a doc_id or an item_id are
documents and items of their own; equal scores are ranked by doc_id, null ids last; a text of any length is counted
whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.llm.common import steps, texts_of, written

TOP = 20
#: Distinct terms of a block of items.
BLOCK_TERMS = 200_000
#: Documents that one batch of the search holds.
BATCH_DOCS = 20_000
#: ASCII characters that are no letter or digit become spaces; A-Z become lower case.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
INDEX = "doc_id long, n long, terms array<int>, tfs array<int>"

Item = tuple[int, object, Counter]


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[Item]]:
    """(number, item_id, counted terms) of all items that have a term, in blocks."""
    block: list[Item] = []
    seen: set[bytes] = set()
    for k, row in enumerate(items.select(item_id, text).toLocalIterator()):
        counts = Counter(terms_of((row[1] or "").encode()))
        if not counts:
            continue
        if block and len(seen | counts.keys()) > BLOCK_TERMS:
            yield block
            block, seen = [], set()
        block.append((k, row[0], counts))
        seen |= counts.keys()
    if block:
        yield block


def _index(batches: Iterator[pa.RecordBatch], vocabulary: list[bytes]) -> Iterator[pa.RecordBatch]:
    known = pa.array(vocabulary, pa.binary())
    for batch in steps(batches):
        split = [terms_of(t) for t in texts_of(batch.column("text"))]
        n = np.fromiter(map(len, split), np.int64, len(split))
        flat = pa.array([w for words in split for w in words], pa.binary())
        code = np.asarray(pc.fill_null(pc.index_in(flat, value_set=known), -1)).astype(np.int64)
        row = np.repeat(np.arange(len(split)), n)[code >= 0]
        pair, tf = np.unique(row * len(vocabulary) + code[code >= 0], return_counts=True)
        ends = np.searchsorted(pair, np.arange(len(split) + 1) * len(vocabulary)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pair % len(vocabulary), tf)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])


def _frequencies(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    df = np.zeros(size, np.int64)
    for batch in batches:
        df += np.bincount(np.asarray(pc.list_flatten(batch.column("terms"))), minlength=size)
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], names=["term", "df"])


def lengths_factor(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """100 - 25 + (25 n N) div L, beyond 63 bits by Python's integers."""
    if 25 * int(n.max(initial=0)) * documents < 1 << 63:
        return 75 + 25 * n * documents // length
    return np.array([75 + 25 * int(x) * documents // length for x in n], np.int64)


class Best:
    """The best documents of an item so far, by score and then doc_id, null ids last."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.doc, self.none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def bar(self) -> int:
        """The score that a document needs, at least."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        score, doc, none = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.none, none)))
        order = np.lexsort((doc, none, -score))[: self.top]
        self.score, self.doc, self.none = score[order], doc[order], none[order]


class Postings:
    """A batch of the index by term: documents (numbered in the batch) and scaled frequencies."""

    def __init__(self, batch: pa.RecordBatch, documents: int, length: int):
        lists = batch.column("terms")
        terms, tf = np.asarray(pc.list_flatten(lists)).astype(np.int64), np.asarray(pc.list_flatten(batch.column("tfs"))).astype(np.int64)
        row = np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
        m = lengths_factor(np.asarray(batch.column("n")), documents, length)
        order = np.argsort(terms, kind="stable")
        self.row = row[order]
        self.part = (1_000_000_000 * tf // (1000 * tf + 12 * m[row]))[order]
        self.at, first = np.unique(terms[order], return_index=True)
        self.first = np.append(first, len(terms))
        self.most = np.maximum.reduceat(self.part, first) if len(first) else first
        self.n = batch.num_rows
        ids = batch.column("doc_id")
        self.doc, self.none = np.asarray(pc.fill_null(ids, 0)), np.asarray(pc.is_null(ids))

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Add the batch's documents for an item whose terms come rarest first, each with its weight."""
        where = np.searchsorted(self.at, terms)
        here = where < len(self.at)
        here[here] = self.at[where[here]] == terms[here]
        where, weights = where[here], weights[here]
        left = np.append(np.cumsum((weights * self.most[where])[::-1])[::-1], 0)
        score, has = np.zeros(self.n, np.int64), np.zeros(self.n, bool)
        creating, count = True, 0
        for k, (j, w) in enumerate(zip(where.tolist(), weights.tolist())):
            a, b = self.first[j], self.first[j + 1]
            rows, parts = self.row[a:b], self.part[a:b]
            if creating:
                bar = best.bar
                if left[k] >= bar and count >= best.top:
                    held = score[has]
                    bar = max(bar, int(np.partition(held, len(held) - best.top)[len(held) - best.top]))
                creating = left[k] >= bar
            if creating:
                has[rows] = True
                count = int(has.sum())
            else:
                old = has[rows]
                rows, parts = rows[old], parts[old]
            score[rows] += w * parts
        held = np.flatnonzero(has & (score >= best.bar))
        best.add(score[held], self.doc[held], self.none[held])


def _search(batches: Iterator[pa.RecordBatch], items: list[tuple[int, np.ndarray, np.ndarray]], documents: int, length: int, top: int) -> Iterator[pa.RecordBatch]:
    best = [Best(top) for _ in items]
    for batch in batches:
        for a in range(0, batch.num_rows, BATCH_DOCS):
            postings = Postings(batch.slice(a, BATCH_DOCS), documents, length)
            for (_, terms, weights), own in zip(items, best):
                postings.search(terms, weights, own)
    number = np.repeat(np.array([k for k, _, _ in items], np.int64), [len(b.score) for b in best])
    doc, none, score = (np.concatenate([getattr(b, c) for b in best]) if best else np.empty(0, np.int64) for c in ("doc", "none", "score"))
    yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(doc, pa.int64(), mask=none.astype(bool)), pa.array(score)], names=["item", "doc_id", "score"])


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def ranked_search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` documents by score, from 1."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    id_type = items.schema[item_id].dataType.simpleString()
    found: DataFrame | None = None
    for block in blocks(items, item_id, text):
        vocabulary = sorted(set().union(*[c.keys() for _, _, c in block]))
        shared = spark.sparkContext.broadcast(vocabulary)
        index = written(source.mapInArrow(lambda b, s=shared: _index(b, s.value), INDEX), "search-index")
        total = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        documents, length = int(total[0]), int(total[1])
        if not documents:
            continue
        size = len(vocabulary)
        counted = index.select("terms").mapInArrow(lambda b, size=size: _frequencies(b, size), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df = np.zeros(size, np.int64)  # of the block's terms alone
        df[np.asarray(counted["term"])] = np.asarray(counted["df"])
        number = {w: k for k, w in enumerate(vocabulary)}
        queries = []
        for k, _, counts in block:
            ids = np.array([number[w] for w in counts], np.int64)
            order = np.lexsort((ids, df[ids]))
            weights = np.array([weight(documents, int(d)) for d in df[ids]], np.int64) * np.array(list(counts.values()), np.int64)
            queries.append((k, ids[order], weights[order]))
        shared = spark.sparkContext.broadcast(queries)
        part = index.mapInArrow(lambda b, s=shared, n=documents, size=length: _search(b, s.value, n, size, top), "item long, doc_id long, score long")
        names = spark.createDataFrame([(k, i) for k, i, _ in block], f"item long, item_id {id_type}")
        part = part.join(F.broadcast(names), "item")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    ranked = found.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
