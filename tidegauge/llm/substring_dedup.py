"""Substring dedup by relative Lempel-Ziv parsing against routed reference blocks.

A window is WINDOW consecutive words. A document is factored against reference blocks, which hold what all documents
contain with the smallest document that contains it: a factor goes on while its windows have an earlier source, and
at a factor's boundary the windows that reach over it are looked up one by one, so that none is missed.

Parsing every document against every block would be quadratic. The parse is routed instead, without loss:

1. Of each ANCHOR_SPAN consecutive ANCHOR_WORDS-grams the one with the smallest hash is an anchor. A window of WINDOW
   words holds ANCHOR_SPAN of them, so its anchor is the same in every document. The windows of one anchor follow
   each other, and the words they cover are a phrase.
2. Reference blocks are dealt by anchor. A phrase that a smaller document has too is a factor: all its windows have
   an earlier source. An anchor with one phrase needs no more.
3. Where documents have different phrases for an anchor, a factor begins or ends nearby. The windows of the first
   document of each phrase are then compared by a 128-bit hash of their words.

An anchor in many documents, each with its own neighbours, would be a hot group. A sample names such anchors; their
phrases are dealt apart and always looked up window by window, so the sample decides where work goes, not what is found.

This is not the textbook parse: factors come from routed phrases and windows instead of a greedy scan over an index of
every block, since each block would have to read every document.

A task first settles what its own rows show and sends one row for a phrase or window, so that no block receives more
than one row for it from each step, however common it is.

Edge cases: a null text has no words; fewer than WINDOW words have no window; rows with equal doc_id do not remove
from each other, nor do null ones; a null doc_id counts after every other id (ids from 2**63 - 2**32 on count as null);
rows that repeat a doc_id are told apart by 128 bits of text hash, null ones by 160, and ids that stand once need none;
repeated rows are cut alike; a text of any length is parsed whole; carried columns must not bear a result's name; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidegauge.llm.common import appended, splitmix, steps, texts_of, written

WINDOW, ANCHOR_WORDS = 13, 5
ANCHOR_SPAN = WINDOW - ANCHOR_WORDS + 1
#: Null ids are this number and 32 bits of text hash more, and equal in order.
LAST = (1 << 63) - (1 << 32)
#: Documents in the sample that names common anchors, the share of them that an anchor must be in, and the least number.
SAMPLE, COMMON_SHARE, COMMON_LEAST = 20_000, 0.005, 50
#: Bits of a place that stands in a column of its own; further places go in a list.
PLACE_BITS = 32
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MULTIPLIERS = splitmix(np.arange(100, 100 + ANCHOR_WORDS, dtype=np.uint64)) | np.uint64(1)


class Words:
    """The words of a step's texts in one buffer, joined by single spaces, with each word's bounds."""

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        self.starts_of = np.concatenate(([0], np.cumsum(self.counts)))
        flat = [w for words in split for w in words]
        self.buf = b" ".join(flat)
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes
        self.flat = flat

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def powers(n: int) -> np.ndarray:
    """BASE ** i modulo 2**64 for i < n."""
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def phrases(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, phrase hash, first window, windows) of each anchor, windows numbered over the whole step."""
    n = len(words.flat)
    k = n - WINDOW + 1
    row = words.row_of()
    if k < 1 or not (inside := row[:k] == row[WINDOW - 1 :]).any():
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    memo: dict[bytes, int] = {}
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((memo[w] if w in memo else memo.setdefault(w, digest(w)) for w in words.flat), np.uint64, n)
    m = n - ANCHOR_WORDS + 1
    gram = splitmix(sum(h[j : j + m] * _MULTIPLIERS[j] for j in range(ANCHOR_WORDS)))
    best, where = gram[:k].copy(), np.arange(k)  # least gram of each window, the first of equals
    for j in range(1, ANCHOR_SPAN):
        less = np.flatnonzero(gram[j : j + k] < best)
        best[less], where[less] = gram[less + j], less + j
    windows = np.flatnonzero(inside)  # the others reach over into the next document
    where = where[windows]
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    start, count = windows[first], np.diff(np.append(first, len(windows)))
    power, inverse = powers(n), np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, INVERSE, np.uint64))))
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power, dtype=np.uint64)))
    size = count + WINDOW - 1
    phrase = splitmix((upto[start + size] - upto[start]) * inverse[start] + splitmix(size.astype(np.uint64)))
    return gram[where[first]], phrase, start, count


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new group of equal values begins in columns sorted together."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return new


def _lists(values: np.ndarray, new: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(new), len(values)), pa.int32()), pa.array(values))


HIGH = np.uint64(1 << 63)


def _short(hashes: np.ndarray) -> np.ndarray:
    """32 bits of a hash. Anchors only say what is compared, so two that share them cost time alone."""
    return (hashes >> np.uint64(32)).astype(np.int64)


def common_anchors(base: DataFrame) -> np.ndarray:
    """Anchors in many documents, by a sample. An anchor is in COMMON_SHARE of the sample at least, so there are at most
    anchors of a document / COMMON_SHARE."""

    def run(batches):
        for batch in steps(batches):
            words = Words(texts_of(batch.column("text")))
            anchor, _, start, _ = phrases(words)
            pairs = np.unique(np.stack((words.row_of()[start], _short(anchor))), axis=1) if len(anchor) else np.empty((2, 0), np.int64)
            kinds, n = np.unique(pairs[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], names=["anchor", "n"])

    total = base.count()
    drawn = base.select("text").where(F.pmod(F.xxhash64("text"), F.lit(max(1, total // SAMPLE))) == 0)
    least = max(COMMON_LEAST, int(COMMON_SHARE * min(total, SAMPLE)))
    counted = drawn.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.asarray(counted.select("anchor").toArrow()["anchor"].combine_chunks(), np.int64)


def _phrase_rows(batches, common: np.ndarray, bits: int):
    """Rows (anchor, phrase, doc, at, k1, k2, settled, more), the anchor negative and drawn from the phrase where it is
    common. `at` is a place, first window << 8 | windows; `more` has further places of the same phrase in the document,
    and those beyond bits. A settled row lists, in `more`, places of a document whose phrase a
    smaller document of the step has. Columns that are mostly zero stand last, where a shuffle packs them together."""
    names = ["anchor", "phrase", "doc", "at", "k1", "k2", "settled", "more"]
    for batch in steps(batches):
        words = Words(texts_of(batch.column("text")))
        anchor, phrase, start, count = phrases(words)
        if not len(anchor):
            continue
        row = words.row_of()[start]
        place = (start - words.starts_of[row]) << 8 | count
        doc, k1, k2 = (np.asarray(batch.column(c))[row] for c in ("doc", "k1", "k2"))
        anchor = _short(anchor)
        anchor = np.where(np.isin(anchor, common), (phrase | HIGH).view(np.int64), anchor)
        order = np.lexsort((place, k2, k1, doc, phrase, anchor))
        anchor, phrase, k1, k2, doc, place = anchor[order], phrase[order].view(np.int64), k1[order], k2[order], doc[order], place[order]
        new = _starts(anchor, phrase)
        later = np.minimum(doc, LAST) > np.minimum(doc, LAST)[new][np.cumsum(new) - 1]
        a, f, k, l, d, p = (c[~later] for c in (anchor, phrase, k1, k2, doc, place))
        new = _starts(a, f, k, l, d)
        wide = p >> bits != 0
        rest = ~new | wide
        sizes = np.add.reduceat(rest, np.flatnonzero(new), dtype=np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        more = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.append(sizes == 0, False)), pa.array(p[rest]))
        at = np.where(wide, 0, p)[new]
        yield pa.RecordBatch.from_arrays([*map(pa.array, (a[new], f[new], d[new], at, k[new], l[new], np.zeros(len(sizes), bool))), more], names=names)
        if later.any():
            k, l, d, p = k1[later], k2[later], doc[later], place[later]
            order = np.lexsort((d, l, k))
            k, l, d, p = k[order], l[order], d[order], p[order]
            new = _starts(k, l, d)
            n = int(new.sum())
            spread = splitmix(k[new].view(np.uint64) ^ splitmix(d[new]))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (_short(spread), spread.view(np.int64), d[new], np.zeros(n, np.int64), k[new], l[new], np.ones(n, bool))), _lists(p, new)], names=names)


def _window_rows(batches):
    """Rows (h1, h2, doc, k1, k2, settled, places). Windows of the places in `open` go to their blocks, one row for a
    window from each step; those that a smaller document of the step has, and the places in `done`, are settled."""
    names = ["h1", "h2", "doc", "k1", "k2", "settled", "places"]

    def settled(doc, k1, k2, place):
        order = np.lexsort((doc, k2, k1))
        doc, k1, k2, place = doc[order], k1[order], k2[order], place[order]
        new = _starts(doc, k1, k2)
        spread = splitmix(k1[new].view(np.uint64) ^ splitmix(doc[new])).view(np.int64)
        return pa.RecordBatch.from_arrays([*map(pa.array, (spread, spread, doc[new], k1[new], k2[new], np.ones(len(spread), bool))), _lists(place, new)], names=names)

    for batch in steps(batches):
        docs, keys1, keys2 = (np.asarray(batch.column(c)) for c in ("doc", "k1", "k2"))
        done, owner = np.asarray(pc.list_flatten(batch.column("done"))), np.asarray(pc.list_parent_indices(batch.column("done")))
        if len(done):
            yield settled(docs[owner], keys1[owner], keys2[owner], done)
        places, owner = np.asarray(pc.list_flatten(batch.column("open"))), np.asarray(pc.list_parent_indices(batch.column("open")))
        if not len(places):
            continue
        words = Words([t if n else b"" for t, n in zip(texts_of(batch.column("text")), pc.list_value_length(batch.column("open")).to_pylist())])
        count = places & 255
        row = np.repeat(owner, count)
        pos = np.repeat(places >> 8, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = words.starts_of[row] + pos
        buf, digest = words.buf, xxhash.xxh3_128_digest
        raw = b"".join([digest(buf[a:b]) for a, b in zip(words.start[at].tolist(), words.end[at + WINDOW - 1].tolist())])
        h1, h2 = np.frombuffer(raw, np.int64).reshape(-1, 2).T
        doc, k1, k2, place = docs[row], keys1[row], keys2[row], pos << 8 | 1
        order = np.lexsort((place, k2, k1, doc, h2, h1))
        h1, h2, doc, k1, k2, place = h1[order], h2[order], doc[order], k1[order], k2[order], place[order]
        new = _starts(h1, h2)
        later = np.minimum(doc, LAST) > np.minimum(doc, LAST)[new][np.cumsum(new) - 1]
        a, b, d, k, l, p = (c[~later] for c in (h1, h2, doc, k1, k2, place))
        new = _starts(a, b, d, k, l)
        yield pa.RecordBatch.from_arrays([*map(pa.array, (a[new], b[new], d[new], k[new], l[new], np.zeros(int(new.sum()), bool))), _lists(p, new)], names=names)
        if later.any():
            yield settled(doc[later], k1[later], k2[later], place[later])


def _spans(places: list[int]) -> list[tuple[int, int]]:
    """Factors: maximal runs of words under windows with an earlier source, as (first word, words)."""
    out: list[list[int]] = []
    for p in sorted(places):
        start, end = p >> 8, (p >> 8) + (p & 255) + WINDOW - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b - a) for a, b in out]


def _cut(batch: pa.RecordBatch) -> list[pa.Array]:
    rows = []
    for text, places in zip(texts_of(batch.column("text")), batch.column("places").to_pylist()):
        words = text.split()
        spans = _spans(places or [])
        kept, last = [], 0
        for a, n in spans:
            kept += words[last:a]
            last = a + n
        kept += words[last:]
        joined = b" ".join(kept)
        rows.append((len(words), len(words) - len(kept), spans, joined.decode("utf-8", "replace"), hashlib.sha256(joined).hexdigest()))
    n_words, removed, spans, kept, sha = zip(*rows)
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    return [pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array([[{"start": a, "length": n} for a, n in s] for s in spans], span), pa.array(kept, pa.string()), pa.array(sha, pa.string())]


SPANS = T.ArrayType(T.StructType().add("start", "long").add("length", "long"))
CUT = T.StructType().add("n_words", "long").add("n_removed", "long").add("spans", SPANS).add("kept_text", "string").add("kept_sha256", "string")


def substring_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row's doc_id, carried columns, text, word counts, removed spans, kept text and its SHA-256."""
    null_id = F.lit(LAST) + F.xxhash64("text").bitwiseAND(F.lit((1 << 32) - 1))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), null_id).alias("doc"), F.col(text).alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"))
    # rows of one doc_id whose texts differ are told apart by two hashes; ids that stand once have none to shuffle
    repeated = written(base.groupBy("doc").agg(F.count("*").alias("_n")).where("_n > 1").select("doc", F.lit(True).alias("_again")), "repeated-ids")
    apart = lambda seed: F.when(F.coalesce("_again", F.lit(False)) | F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), F.length("text"), "text")).otherwise(F.lit(0).cast("long"))
    base = base.join(repeated, "doc", "left").withColumns({"k1": apart(1), "k2": apart(2)}).drop("_again")
    key = ["doc", "k1", "k2"]
    shared, bits = docs.sparkSession.sparkContext.broadcast(common_anchors(base)), PLACE_BITS

    seen = base.select(*key, "text").mapInArrow(lambda batches: _phrase_rows(batches, shared.value, bits), "anchor long, phrase long, doc long, at long, k1 long, k2 long, settled boolean, more array<long>")
    meet, same = W.partitionBy("anchor", "settled"), W.partitionBy("anchor", "settled", "phrase")
    # ranks after the least and largest id, so that no rank goes through the shuffle
    ranked = lambda doc: F.least(doc, F.lit(LAST))
    unequal = (F.min("phrase").over(meet) < F.max("phrase").over(meet)) & (ranked(F.min("doc").over(meet)) < ranked(F.max("doc").over(meet)))
    # phrases of common anchors meet only their equals, so they are always opened
    seen = seen.select("*", ((F.col("anchor") < 0) | unequal).alias("differ"))
    seen = seen.withColumn("done", F.col("settled") | (ranked(F.col("doc")) > ranked(F.min("doc").over(same)))).where("done or differ")
    all_places = F.array_compact(F.concat(F.array(F.nullif("at", F.lit(0))), F.coalesce("more", F.array().cast("array<long>"))))
    lists = seen.select(*key, "done", all_places.alias("places")).groupBy(*key).agg(
        *[F.flatten(F.collect_list(F.when(F.col("done") == flag, F.col("places")))).alias(name) for name, flag in (("done", True), ("open", False))]
    )

    # all of base, so that Spark shuffles it once for this join and the last
    rows = base.join(lists, key).mapInArrow(_window_rows, "h1 long, h2 long, doc long, k1 long, k2 long, settled boolean, places array<long>")
    least = ranked(F.min("doc").over(W.partitionBy("h1", "h2", "settled")))
    sourced = rows.withColumn("least", least).where(F.col("settled") | (ranked(F.col("doc")) > F.col("least")))
    places = sourced.groupBy(*key).agg(F.flatten(F.collect_list("places")).alias("places"))

    out = appended(base.join(places, key, "left"), list(CUT), _cut)
    return out.select("doc_id", "text", *[F.col("carried")[c].alias(c) for c in carry], *[f.name for f in CUT])
