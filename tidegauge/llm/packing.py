"""Best-fit packing by length patterns and non-negative least squares.

Documents are tokenised and cut into pieces of at most CAPACITY tokens. Everything after that works on the
histogram of piece lengths, which has at most CAPACITY rows whatever the corpus:

1. patterns of two or three lengths that fill a sequence exactly are enumerated (at most THIRDS third lengths for
   each longest one), and their repeat counts are fitted to the histogram by non-negative least squares;
2. the counts are rounded and clipped to what is there;
3. the residual is packed largest first, each pattern being repeated while its lengths last, so that a few
   thousand patterns cover any number of pieces.

Pieces of one length are then numbered in parallel (by salted ranks and prefix sums), and a number's place in the
plan gives its sequence and offset.

Edge cases: a null or empty text is the end token alone; repeated rows are packed each; an empty table gives an
empty result; a text of any length is tokenised whole.
"""

from __future__ import annotations

import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge.llm.common import steps, written

CAPACITY, END = 4096, 1
THIRDS = 24
#: Words that a worker remembers the tokens of; beyond that it starts anew.
MEMO = 1_200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: How the tokenizer parts a lower-case ASCII word before it merges letters.
PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: The same for other words, as far as their parts beyond ASCII are letters alone.
WIDE_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
#: A special token that stands between words that are tokenised together; `<|` marks texts that may hold one.
BETWEEN = b"<|endoftext|>"
TOGETHER = 256
#: Texts that go to the tokenizer whole: a special token is told by its case and may stand inside a word, and a mark
#: may combine with a capital letter but not with the small one, or the other way round.
WHOLE = r"<\||[A-Z]\p{M}"
#: Bytes of text that one step encodes.
STEP = 8 << 20


class Encoder:
    """Token ids of texts. The tokenizer lower-cases and never looks across white space, so the ids of a text are those
    of its words in turn, and each distinct lower-cased word is tokenised once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.between = vocabulary[BETWEEN.decode()]
        #: Whether a token ends a part.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {b"": b""}

    def _runs(self, words: list[bytes], sep: bytes) -> np.ndarray:
        joined = [sep.join(words[i : i + TOGETHER]) + sep for i in range(0, len(words), TOGETHER)]
        got = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in joined], add_special_tokens=False)
        return np.concatenate([np.array(g.ids, "<u4") for g in got])

    def _learn(self, words: list[bytes], ids: np.ndarray, last: np.ndarray, drop: int = 0) -> None:
        """Remember the ids of each word, which go up to its place in `last`, less `drop` at the end."""
        raw, ends = ids.tobytes(), (4 * (last + 1)).tolist()
        self.memo.update((w, raw[a : b - 4 * drop]) for w, a, b in zip(words, [0, *ends], ends))

    @staticmethod
    def parted(word: bytes) -> list[bytes] | None:
        """What the tokenizer parts a word into before it merges letters, None where that is left to it."""
        if word.isascii():
            return PARTS.findall(word)
        parts = WIDE_PARTS.findall(text := word.decode("utf-8", "replace"))
        if sum(map(len, parts)) < len(text) or not all(p.isascii() or p.lower().isalpha() for p in parts):
            return None
        return [p.encode() for p in parts]

    def learn(self, new: list[bytes]) -> None:
        # a word is put together from parts that many words share
        memo = self.memo
        parted = {w: self.parted(w) for w in new}
        whole = [w for w, p in parted.items() if p is None]
        parts = list({x for p in parted.values() if p for x in p}.difference(memo))
        if parts:
            ids = self._runs(parts, b" ")
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(parts):
                self._learn(parts, ids, last)
            else:  # a letter that the tokenizer takes apart
                whole = list({*whole, *parts})
        if whole:
            ids = self._runs(whole, BETWEEN)
            self._learn(whole, ids, np.flatnonzero(ids == self.between), 1)
        memo.update((w, b"".join(map(memo.__getitem__, p))) for w, p in parted.items() if p and p != [w])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column without nulls."""
        by_word = pc.invert(pc.match_substring_regex(texts, WHOLE))
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(by_word, texts, "")))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.memo) > MEMO:
            self.memo = {b"": b""}
        known = list(map(self.memo.get, words))
        if new := [w for w, k in zip(words, known) if k is None]:
            self.learn(new)
            known = list(map(self.memo.__getitem__, words))
        store = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        code = np.asarray(coded.indices)
        n = sizes[code]
        upto = np.cumsum(n)
        ids = store[np.repeat((np.cumsum(sizes) - sizes)[code] - upto + n, n) + np.arange(n.sum())]
        edges = np.concatenate(([0], upto))[np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(split)))))].tolist()
        out = [ids[a:b] for a, b in zip(edges, edges[1:])]
        for i in np.flatnonzero(~np.asarray(by_word)).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
        return out


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    end = np.array([END], "<u4")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        for batch in steps(batches, most=STEP):
            out = []
            for i, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                ids = np.concatenate((ids, end))
                for k in range(0, len(ids), CAPACITY):
                    part = ids[k : k + CAPACITY]
                    out.append((i, k // CAPACITY, k, len(part), zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(hist: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, of lengths present that fill a sequence; c is 0 for a pair."""
    there = hist > 0
    out = []
    for a in np.flatnonzero(there[: capacity]).tolist():
        if a < 1:
            continue
        rest = capacity - a
        if rest <= a and there[rest]:
            out.append(np.array([[a, rest, 0]]))
        b = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)
        if len(b):
            b = b[there[b] & there[rest - b]]
            b = b[np.unique(np.linspace(0, len(b) - 1, min(THIRDS, len(b))).astype(int))] if len(b) else b
            out.append(np.stack((np.full(len(b), a), b, rest - b), 1))
    return np.concatenate(out) if out else np.empty((0, 3), int)


def fit_counts(pats: np.ndarray, hist: np.ndarray, rounds: int = 600) -> np.ndarray:
    """min |A x - hist|, x >= 0, where A counts the lengths of a pattern: accelerated projected gradient."""
    if not len(pats):
        return np.zeros(0)
    size = len(hist)
    used = (pats > 0).astype(float)

    def forward(x):
        return sum(np.bincount(pats[:, j], x * used[:, j], size) for j in range(3))

    def back(r):
        return sum(r[pats[:, j]] * used[:, j] for j in range(3))

    v = np.ones(len(pats))
    for _ in range(30):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.02 * norm)
    target = hist.astype(float)
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * back(forward(y) - target), 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (before - 1) / t * (new - x), new
    return x


@dataclass
class Plan:
    """Which piece of a length goes where: rank r in [lo, lo + n) goes to sequence seq + (r - lo) // mult."""

    length: np.ndarray
    lo: np.ndarray
    mult: np.ndarray
    seq: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.length << 40 | self.lo, length << 40 | rank, "right") - 1
        r = rank - self.lo[at]
        return self.seq[at] + r // self.mult[at], self.offset[at] + r % self.mult[at] * length


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """hist[k]: pieces of length k, 1 to capacity."""
    left = hist.astype(np.int64).copy()
    taken = np.zeros_like(left)
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def use(parts: list[tuple[int, int]], times: int) -> None:
        nonlocal sequences
        offset = 0
        for length, mult in parts:
            rows.append((length, taken[length], mult, sequences, offset))
            taken[length] += mult * times
            left[length] -= mult * times
            offset += mult * length
        sequences += times

    if left[capacity]:
        use([(capacity, 1)], int(left[capacity]))
    pats = patterns(left, capacity)
    counts = np.rint(fit_counts(pats, left)).astype(np.int64)
    for i in np.argsort(-counts, kind="stable").tolist():
        if counts[i] < 1:
            break
        parts: dict[int, int] = {}
        for length in pats[i].tolist():
            if length:
                parts[length] = parts.get(length, 0) + 1
        times = min(int(counts[i]), *(int(left[k]) // m for k, m in parts.items()))
        if times:
            use(list(parts.items()), times)
    there = np.flatnonzero(left)
    while len(there):
        parts, room, upto = [], capacity, len(there)
        while room and upto:
            upto = int(np.searchsorted(there[:upto], room, "right"))
            if not upto:
                break
            length = int(there[upto - 1])
            mult = min(room // length, int(left[length]))
            parts.append((length, mult))
            room -= mult * length
            upto -= 1
        use(parts, min(int(left[k]) // m for k, m in parts))
        there = there[left[there] > 0]
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences)


def pack(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with their sequence_id and offset."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer or default_tokenizer(), doc_id, text), "pieces")
    hist = np.zeros(CAPACITY + 1, np.int64)
    for length, n in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # CAPACITY rows at most
        hist[length] = n
    shared = spark.sparkContext.broadcast(plan(hist))

    # The salt spreads a length that many copies share; ranks inside a salt become ranks of the length.
    salts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = ranked.join(sizes, ["length", "salt"]).withColumn("rank", (F.col("rank") + F.col("base")).cast("long"))

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        for batch in batches:
            seq, offset = shared.value.place(np.asarray(batch.column("length")), np.asarray(batch.column("rank")))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
