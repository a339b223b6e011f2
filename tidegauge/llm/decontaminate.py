"""Benchmark decontamination in DataFrame and SQL functions alone.

Words are runs of letters and digits of the lower-cased text; a shingle is SHINGLE words. A window of a document is
as long as the benchmark item that it is held against. Shingles weigh ln(1 + items / items with the shingle). A
window and an item match if their weighted Jaccard similarity is THRESHOLD or more.

1. Windows slide over every document, one length for each item length. A window whose shared shingles with every item
   weigh less than THRESHOLD times the item cannot match, and one that neither begins nor ends with a shared shingle
   gives way to a neighbour that shares as much; the others are left out before fingerprinting.
2. Equal windows are fingerprinted once: a 64-bit weighted SimHash.
3. Of RADIUS + 2 bit blocks, fingerprints within RADIUS bits agree on two, so a join on every two blocks finds all of
   them; unrelated fingerprints meet in one of six cases.
4. Candidates are verified by the exact weighted similarity.

Edge cases: a null or empty text, or an item without words, matches nothing; texts or items of fewer than SHINGLE
words are one shingle; a document shorter than an item is one window; repeated rows match alike; equal items are
found each; a null doc_id is kept as such; a text of any length is searched whole; other columns of docs and items are
not looked at, so their names may clash; empty tables give an empty result.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import written

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 12
#: Rows of the benchmark's shingle table up to which it is broadcast; beyond that Spark shuffles both sides.
BROADCAST_ROWS = 500_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows, grouped by document, up to which their list is broadcast to the texts; beyond that Spark shuffles both.
BROADCAST_WINDOWS = 1_000_000
#: (shift, width) of the RADIUS + 2 blocks.
CUTS = [64 * k // (RADIUS + 2) for k in range(RADIUS + 3)]
BLOCKS = [(a, b - a) for a, b in zip(CUTS, CUTS[1:])]


def shingles(text: str) -> Column:
    """Hashes of the shingles of a text column, in order; empty without a word."""
    words = f"regexp_extract_all(lower(coalesce({text}, '')), r'{WORD}', 0)"
    return F.expr(
        f"""transform(array({words}), w -> CASE WHEN size(w) = 0 THEN array()
            WHEN size(w) < {SHINGLE} THEN array(xxhash64(w))
            ELSE transform(sequence(1, size(w) - {SHINGLE - 1}), i -> xxhash64(slice(w, i, {SHINGLE}))) END)[0]"""
    ).cast("array<bigint>")


def simhash(rows: DataFrame, key: str) -> DataFrame:
    """(key, fp) from rows (key, h, weight)."""
    bit = lambda b: F.when(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1)) == 1, F.col("weight")).otherwise(-F.col("weight"))
    sums = rows.groupBy(key).agg(*[F.sum(bit(b)).alias(f"b{b}") for b in range(64)])
    value = F.lit(0).cast("long")
    for b in range(64):
        value = value.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return sums.select(key, value.alias("fp"))


def blocks(df: DataFrame) -> DataFrame:
    """A row for every two blocks of the fingerprint `fp`."""
    part = lambda s, w: F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1))
    keys = [F.lit(k << 20).bitwiseOR(F.shiftleft(part(*x), 8)).bitwiseOR(part(*y)) for k, (x, y) in enumerate(combinations(BLOCKS, 2))]
    return df.withColumn("block", F.explode(F.array(*keys)))


def promising(hits: DataFrame, longest: int) -> DataFrame:
    """(doc_id, key, k, start) of the windows that may match, from rows (doc_id, key, n, item_id, k, total, pos, weight) of the
    shingles that a document of n shingles shares with an item of k."""
    reach = f"{1 - 0.5 / longest:.12f}D"  # k - 1 shingles, whatever k
    near = lambda frame: F.expr(f"sum(weight) OVER (PARTITION BY key, item_id, doc_id ORDER BY pos / k RANGE BETWEEN {frame})")
    enough = THRESHOLD * F.col("total") - 1e-9
    once = hits.repartition("key", "item_id", "doc_id").dropDuplicates(["key", "item_id", "doc_id", "pos"])
    held = once.withColumn("_ahead", near(f"CURRENT ROW AND {reach} FOLLOWING")).withColumn("_back", near(f"{reach} PRECEDING AND CURRENT ROW"))
    last = F.greatest(F.lit(0), F.col("n") - F.col("k"))
    ahead = F.when(F.col("_ahead") >= enough, F.least("pos", last))
    back = F.when(F.col("_back") >= enough, F.least(last, F.greatest(F.lit(0), F.col("pos") - F.col("k") + 1)))
    starts = F.array_distinct(F.array_compact(F.array(ahead, back)))
    return held.select("doc_id", "key", "k", F.explode(starts).alias("start")).distinct()


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, doc_id, item_id, start_word, n_shingles, similarity, distance): the best window of each matching document
    and item. `key` is content_key() of the document."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    base = base.withColumn("key", content_key("doc_id", "text"))

    bench = items.select(F.col(item_id).alias("item_id"), shingles(item_text).alias("s")).where("size(s) > 0")
    bench = written(bench.select("item_id", F.size("s").alias("k"), F.posexplode("s").alias("at", "h")), "bench")
    n_items = bench.select("item_id").distinct().count()
    df = bench.groupBy("h").agg(F.count_distinct("item_id").alias("df"))
    weight = lambda c: F.log(1.0 + F.lit(float(n_items)) / c)
    weights = df.select("h", weight(F.col("df")).alias("weight"))
    unseen = math.log(1.0 + n_items)
    bench = bench.join(weights, "h")
    totals = bench.groupBy("item_id", "k").agg(F.sum("weight").alias("total"))
    bench = written(bench.join(totals, ["item_id", "k"]), "bench-weights")
    small = bench.count() <= BROADCAST_ROWS
    spread = F.broadcast if small else (lambda x: x)

    # 1. The windows that may match.
    longest = bench.agg(F.max("k")).first()[0] or 1
    placed = base.select("doc_id", "key", shingles("text").alias("s")).select("doc_id", "key", F.size("s").alias("n"), F.posexplode("s").alias("pos", "h"))
    own = bench.select("item_id", "k", "total", "h", "weight").distinct()
    windows = promising(placed.join(spread(own), "h").drop("h"), longest)
    windows = written(windows.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "k")).alias("windows")).withColumnRenamed("doc_id", "d"), "window-places")
    n_windows = windows.agg(F.coalesce(F.sum(F.size("windows")), F.lit(0))).first()[0]
    windows = base.join(F.broadcast(windows) if n_windows <= BROADCAST_WINDOWS else windows, "key").where("doc_id <=> d")
    windows = windows.select("doc_id", "key", shingles("text").alias("s"), "windows").select("doc_id", "key", "s", F.inline("windows"))
    windows = windows.select("doc_id", "key", "start", "k", F.expr("slice(s, start + 1, k)").alias("s"))
    windows = written(windows.withColumn("window", F.xxhash64("k", "s")), "windows")

    # 2. One fingerprint for equal windows.
    once = windows.groupBy("window").agg(F.first("s").alias("s"), F.first("k").alias("k"))
    inside = once.select("window", "k", F.explode("s").alias("h")).join(spread(weights), "h", "left").withColumn("weight", F.coalesce("weight", F.lit(unseen)))
    inside = written(inside, "window-shingles")
    marks = simhash(inside, "window").join(once.select("window", "k"), "window")
    item_marks = simhash(bench.select("item_id", "h", "weight"), "item_id").join(totals, "item_id")

    # 3. Multi-index blocks.
    left, right = blocks(marks), blocks(item_marks.select("item_id", F.col("fp").alias("fp"), "k", "total")).withColumnRenamed("fp", "item_fp")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    pairs = left.join(spread(right), ["k", "block"]).withColumn("distance", distance).where(F.col("distance") <= RADIUS)
    pairs = pairs.select("window", "item_id", "total", "distance").distinct()

    # 4. Exact weighted similarity of multisets.
    counted = inside.groupBy("window", "h", "weight").agg(F.count("*").alias("c"))
    whole = inside.groupBy("window").agg(F.sum("weight").alias("own"))
    ours = bench.groupBy("item_id", "h").agg(F.count("*").alias("ci"))
    common = pairs.join(counted, "window").join(spread(ours), ["item_id", "h"]).groupBy("window", "item_id", "total", "distance").agg(F.sum(F.col("weight") * F.least("c", "ci")).alias("common"))
    scored = common.join(whole, "window").withColumn("similarity", F.col("common") / (F.col("total") + F.col("own") - F.col("common")))
    scored = scored.where(F.col("similarity") >= THRESHOLD - 1e-9)

    best = F.max_by(F.struct("start", "k", "similarity", "distance"), F.struct("similarity", -F.col("start"))).alias("best")
    matched = windows.select("doc_id", "key", "start", "k", "window").join(scored, "window").groupBy("doc_id", "key", "item_id").agg(best)
    return matched.select("key", "doc_id", "item_id", F.col("best.start").alias("start_word"), F.col("best.k").alias("n_shingles"), F.col("best.similarity").alias("similarity"), F.col("best.distance").alias("distance"))


def content_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(doc_id, text)


def leaking_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each contaminated document: its items, the best similarity and where that window starts."""
    found = contaminated(docs, items)
    top = F.max_by(F.struct("item_id", "start_word", "similarity"), F.struct("similarity", -F.col("item_id"))).alias("top")
    out = found.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), top)
    return out.select("doc_id", "item_ids", F.col("top.item_id").alias("best_item"), F.col("top.start_word").alias("start_word"), F.col("top.similarity").alias("similarity"))
