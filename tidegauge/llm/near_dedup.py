"""SimHash near-duplicates with pivot distance tables.

Every distinct fingerprint gets its Hamming distances to PIVOTS reference fingerprints. Pairs whose distances to any
pivot differ by more than RADIUS are discarded (the triangle inequality makes that exact), and the survivors verified.

Pivots discard pairs but do not find them, so fingerprints are first dealt to buckets without loss: cut into RADIUS + c
bit blocks, any two within RADIUS bits agree on c of them, so each goes to a bucket for every c blocks. c grows with the
number of fingerprints, so that buckets of unrelated ones stay small. In a bucket fingerprints are sorted by their
distance to the first pivot and compared with those that follow within RADIUS of it. A bucket of more than CHUNK is dealt
as pairs of chunks, so no task holds more than two. A bucket gives one edge for each fingerprint that it ties to another,
so its output is linear in its size.

Edge cases: a text that is null or has no word has fingerprint zero and is linked like any other; fewer than
four words are one shingle; repeated rows share a fingerprint; components are found on fingerprints and then take
the smallest doc_id of their rows, so a component without any id has a null one and unlinked texts of one repeated id
show the same one; a text of any length is hashed whole; carried columns must not bear a result's name, other columns of
docs are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import appended, splitmix, spread_join, texts_of, written

SHINGLE, RADIUS, SEED = 4, 4, 42
PIVOTS = 16
#: Rows of a bucket that one task compares with as many others.
CHUNK = 4096


def layout(n: int) -> tuple[list[tuple[int, int]], int]:
    """Bit blocks as (shift, width) and how many of them make a key, for n fingerprints: unrelated ones should meet
    in buckets of at most a few dozen."""
    for agree in range(2, 6):
        m = RADIUS + agree
        cuts = [64 * i // m for i in range(m + 1)]
        if n >> min(agree * (64 // m), 40) <= 32:
            break
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])], agree


def pivots() -> np.ndarray:
    """The reference fingerprints: fixed well-mixed numbers."""
    return splitmix(np.arange(1, PIVOTS + 1, dtype=np.uint64))


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text."""
    buf = b" ".join(words := text.lower().split())
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(buf, SEED)
    gaps = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32)
    starts, ends = [0, *(gaps[: len(words) - SHINGLE] + 1).tolist()], [*gaps[SHINGLE - 1 :].tolist(), len(buf)]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(buf[a:b], SEED) for a, b in zip(starts, ends)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", name: str = "_fp") -> DataFrame:
    """docs with the fingerprint as a signed 64-bit column."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        memo: dict[bytes, int] = {}
        out = []
        for b in texts_of(batch.column(text)):
            if b not in memo:
                memo[b] = fingerprint(b)
            out.append(memo[b])
        return [pa.array(np.array(out, np.uint64).view(np.int64))]

    return appended(docs, [T.StructField(name, T.LongType())], make, text)


def _linked(group: np.ndarray, side: np.ndarray, fp: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Place of the first row that each row reaches inside its group; rows come sorted by group, then first pivot
    distance. Rows of one side are not compared, -1 is no side."""
    label = np.arange(len(fp))
    at, step = label, 0
    while True:
        step += 1
        at = at[: np.searchsorted(at, len(fp) - step)]
        # who is out of reach of the row before this one is out of reach of this one
        at = at[(group[at + step] == group[at]) & (marks[at + step, 0] - marks[at, 0] <= RADIUS)]
        if not len(at):
            return label
        i = at[(label[at] != label[at + step]) & ((side[at] < 0) | (side[at] != side[at + step]))]
        i = i[(np.abs(marks[i + step] - marks[i]) <= RADIUS).all(1)]
        i = i[np.bitwise_count(fp[i + step] ^ fp[i]) <= RADIUS]
        while len(i):
            a, b = label[i], label[i + step]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (flat := label[label]).tobytes() != label.tobytes():
                label = flat
            i = i[label[i] != label[i + step]]


def _bucket_edges(batches):
    """Edges (u, v) of rows (key, cell, side, node) sorted by key and cell; a batch's unfinished last cell waits for
    the next. A cell has at most some two CHUNKs of rows."""
    ref = pivots()
    rest: list[np.ndarray] = []
    names = ["key", "cell", "side", "node"]

    def solve(rows):
        new = np.concatenate(([True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])))
        group = np.cumsum(new)
        alone = new & np.append(new[1:], True)
        group, side, node = group[~alone], rows[2][~alone], rows[3][~alone]
        fp = node.view(np.uint64)
        marks = np.bitwise_count(fp[:, None] ^ ref[None, :]).astype(np.int8)
        order = np.lexsort((marks[:, 0], group))
        label = _linked(group[order], side[order], fp[order], marks[order])
        node = node[order]
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.asarray(batch.column(c)) for c in names]
        if rest:
            rows = [np.concatenate(pair) for pair in zip(rest, rows)]
        cut = int(np.searchsorted((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]), True))
        rest = [c[cut:] for c in rows]
        if cut:
            yield solve([c[:cut] for c in rows])
    if rest:
        yield solve(rest)


def links(nodes: DataFrame) -> DataFrame:
    """Distinct edges (u, v) that tie together all nodes, fingerprints, within RADIUS bits of each other."""
    blocks, agree = layout(nodes.count())
    keys = []
    for k, chosen in enumerate(combinations(blocks, agree)):
        key = F.lit(k << 42)
        shift = 0
        for at, width in chosen:
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("node", at).bitwiseAND(F.lit((1 << width) - 1)), shift))
            shift += width
        keys.append(key)
    dealt = nodes.select("node", F.explode(F.array(*keys)).alias("key"))
    # buckets over CHUNK: at most one for CHUNK rows
    hot = written(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("key", F.ceil(F.col("n") / CHUNK).alias("parts")), "hot-buckets")
    plain = dealt.withColumns({"cell": F.lit(-1).cast("long"), "side": F.lit(-1).cast("long")}).select("key", "cell", "side", "node")
    if n_hot := hot.count():
        both = spread_join(dealt, hot, "key", n_hot, "left")
        plain = both.where("parts is null").select("key", F.lit(-1).cast("long").alias("cell"), F.lit(-1).cast("long").alias("side"), "node")
        mine = F.pmod(F.xxhash64("node"), F.col("parts"))
        cells = both.where("parts is not null").withColumn("side", mine).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        cell = F.least("side", "_o") * F.col("parts") + F.greatest("side", "_o")
        plain = plain.union(cells.select("key", cell.alias("cell"), F.when(F.col("side") == F.col("_o"), -1).otherwise(F.col("side")).alias("side"), "node"))
    n = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return plain.repartition(n, "key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_bucket_edges, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest reachable node of every node in an edge, by alternating large and small stars."""
    edges = written(edges, "edges")
    n = edges.count()
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = spread_join(both.where("v > u"), low, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, "u", 2 * n)
        small = small.select(F.col("u"), F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = written(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        before, n = now, now[0]


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint, component_id, group and the carried columns) for each row of docs.

    group is the smallest fingerprint of the component. It tells apart components that share the smallest doc_id,
    through repeated ids, or that have none.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *carry)
    marked = written(fingerprints(plain).drop("text"), "fingerprints")
    nodes = written(marked.groupBy(F.col("_fp").alias("node")).agg(F.min("doc_id").alias("low")), "nodes")
    roots = components(links(nodes))
    linked = written(nodes.join(roots, "node"), "linked")
    lows = linked.groupBy("root").agg(F.min("low").alias("least"))
    linked = spread_join(linked.select("node", "root"), lows, "root", linked.count())
    labelled = nodes.join(linked, "node", "left").select(F.col("node").alias("_fp"), F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id"), F.coalesce("root", "node").alias("group"))
    hexed = F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint")
    return spread_join(marked, labelled, "_fp", nodes.count(), "left").select("doc_id", hexed, "component_id", "group", *carry)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint, component_id and the carried columns) for each row of docs."""
    return near_groups(docs, doc_id, text, carry).select("doc_id", "fingerprint", "component_id", *carry)
