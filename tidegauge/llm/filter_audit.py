"""Filter interaction audit by count-weighted decision diagrams.

Five filters judge every document; what a filter order keeps, removes and hides depends on a part's documents only
through how many fail which set of filters. Spark reduces each document to a failure mask and each part to its counts
by mask (32 at most, with the good and the toxic ones). A part's counts become a decision diagram: a node of level k
asks the k-th filter of the order, equal branches are one node, and a node's weight is the sum of its branches.
Swapping two neighbouring levels rebuilds those two levels alone, and all 120 orders are visited by such swaps. The
path of passes from the root gives an order's steps: the weight of the fail branch is what the step removes.

The last filter asks whether a smaller doc_id has the same text. Rows are first added up by text and id, then by text,
part and mask with the least id and its count, so copies of one text are a few rows wherever they stand.

Edge cases: a null text is empty; a null lang is the part of the empty string; a null doc_id counts after all others,
so it is a copy of any known one and never of another null; rows that repeat a doc_id and a text are no copies of each
other; labels of one doc_id count as good or toxic if any of them says so, and those without a doc_id belong to no
document; texts are told apart by 128 bits of hash; a text of any length is judged whole; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.llm.common import steps, texts_of

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
COPY = 1 << FILTERS.index("E")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = b"#$%&*|"
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

Counts = tuple[int, int, int]


def own_failures(text: bytes, chars: int) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    short = len(words) < LEAST_WORDS
    dull = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    loud = 100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS * chars
    signs = len(text.translate(None, SIGNS)) < len(text)
    return short | dull << 1 | loud << 2 | signs << 3


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        texts = texts_of(batch.column("text"))
        chars = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
        masks = [own_failures(t, n) for t, n in zip(texts, chars)]
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(masks, pa.int32())], names=["doc_id", "part", "h1", "h2", "mask"])


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the set of filters that they fail."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    rows = rows.mapInArrow(_masks, "doc_id long, part string, h1 long, h2 long, mask int")
    one = rows.groupBy("doc_id", "part", "h1", "h2", "mask").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    one = one.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    same = one.groupBy("h1", "h2", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low"))
    least = F.min("low").over(W.partitionBy("h1", "h2"))
    first = F.when(least.isNull(), F.col("n")).when(F.col("low") == least, F.col("n_low")).otherwise(0)
    dealt = same.withColumn("first", first)
    sides = F.array(F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    flat = dealt.select("part", "good", "toxic", F.inline(sides)).where("n > 0")
    return flat.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


class Diagram:
    """Decision diagram over masks of `size` filters. A node is (pass branch, fail branch) by number, in the level of
    its filter; below the last level are counts (documents, good, toxic). No branch skips a level."""

    def __init__(self, counts: dict[int, Counts], size: int = len(FILTERS)):
        self.order = list(range(size))
        self.leaves: list[Counts] = []
        known: dict[Counts, int] = {}
        below = []
        for k in range(1 << size):  # the first filter of the order is the highest digit of k
            mask = sum(1 << f for f in range(size) if k >> (size - 1 - f) & 1)
            leaf = counts.get(mask, (0, 0, 0))
            if leaf not in known:
                known[leaf] = len(self.leaves)
                self.leaves.append(leaf)
            below.append(known[leaf])
        self.levels: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for level in reversed(range(size)):
            nodes: dict[tuple[int, int], int] = {}
            below = [nodes.setdefault(pair, len(nodes)) for pair in zip(below[::2], below[1::2])]
            self.levels[level] = list(nodes)
        self.weights: list[list[Counts]] = [[] for _ in range(size)]
        for level in reversed(range(size)):
            self.weights[level] = self._weigh(level)

    def _weigh(self, level: int) -> list[Counts]:
        under = self.under(level)
        return [tuple(a + b for a, b in zip(under[p], under[f])) for p, f in self.levels[level]]

    def under(self, level: int) -> list[Counts]:
        """Weights of what the nodes of a level branch to."""
        return self.weights[level + 1] if level + 1 < len(self.levels) else self.leaves

    def swap(self, level: int) -> None:
        """Exchange the filters of a level and the next. Nodes of other levels, and all weights above, stay."""
        lower = self.levels[level + 1]
        nodes: dict[tuple[int, int], int] = {}
        node = lambda pair: nodes.setdefault(pair, len(nodes))
        self.levels[level] = [(node((lower[p][0], lower[f][0])), node((lower[p][1], lower[f][1]))) for p, f in self.levels[level]]
        self.levels[level + 1] = list(nodes)
        self.weights[level + 1] = self._weigh(level + 1)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, Counts, Counts]]:
        """(filter, kept, removed) along the path of passes."""
        out, at = [], 0
        for level, f in enumerate(self.order):
            passed, failed = self.levels[level][at]
            out.append((f, self.under(level)[passed], self.under(level)[failed]))
            at = passed
        return out


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels whose swaps, one after another, lead through all orders of n (plain changes: each element in turn moves
    through the orders of those before it)."""
    if n < 2:
        return
    down = True
    inner = adjacent_swaps(n - 1)
    while True:
        yield from reversed(range(n - 1)) if down else range(n - 1)
        k = next(inner, None)
        if k is None:
            return
        yield k + 1 if down else k
        down = not down


def audit_part(part: str, counts: dict[int, Counts], filters: str = FILTERS) -> list[tuple]:
    """The rows of AUDIT of one part, by orders in alphabetical order."""
    size = len(filters)
    diagram = Diagram(counts, size)
    found: dict[str, list[tuple[int, Counts, Counts]]] = {}
    for k in [None, *adjacent_swaps(size)]:
        if k is not None:
            diagram.swap(k)
        found["".join(filters[f] for f in diagram.order)] = diagram.steps()
    # a filter fails the most as the first of an order, and those that fail nothing else as the last
    fails = {steps[0][0]: steps[0][2][0] for steps in found.values()}
    alone = {steps[-1][0]: steps[-1][2][0] for steps in found.values()}
    shapley = [0] * size
    for steps_ in found.values():
        for f, _, removed in steps_:
            shapley[f] += removed[0]
    return [
        (part, order, k + 1, kept[0], removed[0], fails[f] - removed[0], alone[f], removed[1], removed[2], shapley[f])
        for order, steps_ in sorted(found.items())
        for k, (f, kept, removed) in enumerate(steps_)
    ]


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, filter order and step: documents kept, removed, redundant and so on (see AUDIT)."""
    names = [f.split()[0] for f in AUDIT.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counts = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in rows.itertuples()}
        return pd.DataFrame(audit_part(rows["part"].iloc[0], counts), columns=names)

    return failure_counts(docs, labels).groupBy("part").applyInPandas(run, AUDIT)
