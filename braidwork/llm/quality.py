"""Quality classifier: random-indexing vectors and a small network.

Each token kind (a word, and a word's form) has a sparse ternary index vector
that follows from its hash. The context vector of a kind that is frequent in
the fit sample adds the index vectors of the most frequent forms next to it;
all other kinds keep their index vector. A document pools the vectors of all its tokens, and a
two-layer network scores the pool; a temperature fitted on a part of the sample
that the network has not seen calibrates its probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, repeat
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import word_blocks, written

DIM = 128
NONZERO = 8
HIDDEN = 24
#: Numbers that the network gets of a text.
POOL = DIM + 2
#: The fit sample: so many labelled rows at most.
SAMPLE_ROWS = 4000
#: Kinds that get a context vector: the most frequent of the sample.
VOCABULARY = 6000
#: Of those, the forms that count as contexts.
CONTEXTS = 256
THRESHOLD = 0.3
#: The form of a word that repeats the one before it.
SAME = b"\0="
_SEED = 11

_UPPER = re.compile(rb"[A-Z]+")
_LOWER = re.compile(rb"[a-z\x80-\xff]+")
_DIGITS = re.compile(rb"[0-9]+")


def form(word: bytes) -> bytes:
    """Runs of capitals, other letters and digits as A, a and 0; the rest as it is."""
    return b"\0" + _DIGITS.sub(b"0", _LOWER.sub(b"a", _UPPER.sub(b"A", word)))


def _blocks(text: str | None) -> Iterator[tuple[list[bytes], list[bool]]]:
    """Words of the whole text in blocks, and which repeat the one before."""
    last: list[bytes] = []
    for words in word_blocks(text):
        before = last + words
        yield words, list(map(eq, words, before)) if last else [False, *map(eq, words[1:], words)]
        last = words[-1:]


def counted(text: str | None) -> Counter[bytes]:
    """The kinds of a whole text: each word as it is and as its form. A word
    like the one before it has the form SAME."""
    words: Counter[bytes] = Counter()
    same: Counter[bytes] = Counter()
    for block, repeated in _blocks(text):
        words.update(block)
        same.update(compress(block, repeated))
    counts: Counter[bytes] = Counter()
    for word, c in words.items():
        counts[form(word)] += c - same.get(word, 0)
    counts[SAME] = sum(same.values())
    counts.update(words)
    return counts


def index_places(kinds: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sparse ternary index vectors: NONZERO places of each kind, and +1 or
    -1 at each, as the bytes of the kind's hash say."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, kinds, repeat(_SEED)), np.uint64, len(kinds))
    codes = h.view(np.uint8).reshape(len(kinds), NONZERO)
    return codes & (DIM - 1), np.where(codes >> 7, 1.0, -1.0) / np.sqrt(NONZERO)


def index_vectors(kinds: list[bytes]) -> np.ndarray:
    out = np.zeros((len(kinds), DIM))
    places, signs = index_places(kinds)
    np.add.at(out, (np.arange(len(kinds))[:, None], places), signs)
    return out


@dataclass
class Model:
    vectors: dict[bytes, int]
    table: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    @staticmethod
    def untrained(vectors: dict[bytes, int], table: np.ndarray) -> Model:
        return Model(vectors, table, np.zeros(POOL), np.ones(POOL), np.zeros((POOL, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)

    def pool(self, text: str | None) -> np.ndarray:
        """The mean vector of all kinds of the text, the logarithm of their
        number, and the share of those without a context vector, which have
        their index vector."""
        known, times, new, often, n = [], [], [], [], 0
        for kind, c in counted(text).items():
            n += c
            at = self.vectors.get(kind)
            if at is not None:
                known.append(at)
                times.append(c)
            elif c:
                new.append(kind)
                often.append(c)
        total = np.asarray(times, float) @ self.table[known] if known else np.zeros(DIM)
        for at in range(0, len(new), 1 << 16):
            places, signs = index_places(new[at : at + (1 << 16)])
            total = total + np.bincount(places.ravel(), (signs * np.asarray(often[at : at + (1 << 16)], float)[:, None]).ravel(), DIM)
        return np.concatenate([total / max(n, 1), [np.log1p(n), sum(often) / max(n, 1)]])

    def logits(self, pools: np.ndarray) -> np.ndarray:
        x = (pools - self.mean) / self.scale
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, texts: pd.Series) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        pools = np.stack([self.pool(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.logits(pools) / self.temperature, -60, 60)))


def neighbours(text: str | None, ids: dict[bytes, int], contexts: np.ndarray, near: np.ndarray) -> None:
    """Adds to ``near[kind, context]`` how often the forms ``contexts`` stand
    within two words of each kind."""
    forms, words = np.full(2, -1), np.full(2, -1)
    for block, repeated in _blocks(text):
        own = [SAME if r else form(w) for w, r in zip(block, repeated, strict=True)]
        forms = np.concatenate([forms[-2:], np.fromiter((ids.get(k, -1) for k in own), np.int64, len(own))])
        words = np.concatenate([words[-2:], np.fromiter((ids.get(w, -1) for w in block), np.int64, len(block))])
        side = np.where(forms >= 0, contexts[forms], -1)
        for step in (1, 2):  # the last two words of the block before come first
            for kinds in (forms, words):
                for a, b in ((kinds[2 - step : -step], side[2:]), (kinds[2:], side[2 - step : -step])):
                    use = (a >= 0) & (b >= 0)
                    np.add.at(near, (a[use], b[use]), 1)


def context_table(names: list[bytes], forms: list[int], near: np.ndarray) -> np.ndarray:
    """A kind's index vector and, at length one, the sum of its neighbours'."""
    index = index_vectors(names)
    total = near @ index[forms] if forms else np.zeros_like(index)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return (index + total / np.where(norm > 0, norm, 1)).astype(np.float32)


def fit_network(model: Model, x: np.ndarray, y: np.ndarray, epochs: int = 60) -> Model:
    """Train on four fifths of the pools ``x``, set the temperature on the rest."""
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-3
    rng = np.random.default_rng(_SEED)
    order = rng.permutation(len(x))
    held = order[: len(x) // 5]
    own = order[len(x) // 5 :]
    z = (x - model.mean) / model.scale
    p = [rng.normal(0, 1 / np.sqrt(DIM), (POOL, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            h = np.tanh(z[part] @ p[0] + p[1])
            out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60)))
            e = (out - y[part]) / len(part)
            back = np.outer(e, p[2]) * (1 - h * h)
            grads = [z[part].T @ back + 1e-3 * p[0], back.sum(0), h.T @ e + 1e-3 * p[2], np.array([e.sum()])]
            t += 1
            for q, g, a, b in zip(p, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                q -= 0.01 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p[0], p[1], p[2], float(p[3][0])
    if len(held):
        raw, ones = model.logits(x[held]), float(y[held].sum())
        # Smoothed labels, so that a part without errors does not ask for certainty.
        goal = np.where(y[held] == 1, (ones + 1) / (ones + 2), 1 / (len(held) - ones + 2))

        def loss(temperature: float) -> float:
            s = raw / temperature
            return float(np.mean(np.logaddexp(0, s) - goal * s))

        model.temperature = float(min(np.geomspace(0.25, 16, 49), key=lambda k: (loss(k), k)))
    return model


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``rank, quality, text`` of the rows to fit on: whole texts, written."""
    own = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other and quality in (0, 1)")
    # A third more ids than rows are drawn, as some documents may be missing.
    drawn = own.orderBy(F.xxhash64("doc_id", F.lit(_SEED)), "doc_id").limit(rows * 4 // 3).select("doc_id", "quality")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("hash"), F.xxhash64("text", F.lit(1)).alias("more"))
    order = Window.orderBy(F.xxhash64("doc_id", F.lit(_SEED)), "doc_id", "hash", "more")
    first = written(found.distinct().orderBy(F.xxhash64("doc_id", F.lit(_SEED)), "doc_id", "hash", "more").limit(rows).withColumn("rank", F.row_number().over(order)), "quality-drawn")
    both = texts.withColumns({"hash": F.xxhash64("text"), "more": F.xxhash64("text", F.lit(1))}).join(F.broadcast(first), ["doc_id", "hash", "more"])
    return written(both.dropDuplicates(["rank"]).select("rank", "quality", "text"), "quality-sample")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["kind", "n"])

    counts: Counter[bytes] = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(counted(text.as_py()))
            if len(counts) > 200_000:
                yield out()
                counts.clear()
    yield out()


def _vocabulary(sample: DataFrame) -> tuple[list[bytes], np.ndarray, list[int]]:
    """The most frequent kinds, and the places of those that are contexts."""
    counts = sample.select("text").mapInArrow(_count, "kind binary, n long").groupBy("kind").agg(F.sum("n").alias("n")).where("n > 0")
    names = [bytes(r["kind"]) for r in counts.orderBy(F.col("n").desc(), "kind").limit(VOCABULARY).collect()]
    forms = [i for i, k in enumerate(names) if k[:1] == b"\0"][:CONTEXTS]  # forms alone, so that the table is small
    contexts = np.full(len(names), -1, np.int64)
    contexts[forms] = np.arange(len(forms))
    return names, contexts, forms


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows that are not held out, chosen by a
    seeded hash of their id; their texts count whole.

    Ids with labels that contradict each other, and null ids or labels, are
    left out. Texts stay on the executors: the driver gets the VOCABULARY most
    frequent kinds, VOCABULARY x CONTEXTS counts and one pool a row. All of
    them are whole numbers or in the sample's order, so reruns agree.
    """
    sample = _sample(docs, labels, rows)
    spark = docs.sparkSession
    names, contexts, forms = _vocabulary(sample)
    ids = {k: i for i, k in enumerate(names)}
    near = np.zeros((len(names), len(forms)))
    if names:
        shared = spark.sparkContext.broadcast((ids, contexts))  # VOCABULARY names bound it

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros((len(shared.value[0]), max(1, int(shared.value[1].max()) + 1)), np.int64)
            for batch in batches:
                for text in batch.column(0):
                    neighbours(text.as_py(), *shared.value, own)
            kind, context = np.nonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(context.astype(np.int32)), pa.array(own[kind, context])], names=["kind", "context", "n"])

        got = sample.select("text").mapInArrow(pairs, "kind int, context int, n long").groupBy("kind", "context").agg(F.sum("n").alias("n")).toArrow()
        near[got["kind"].to_numpy(), got["context"].to_numpy()] = got["n"].to_numpy()
    model = Model.untrained(ids, context_table(names, forms, near) if names else np.zeros((0, DIM), np.float32))
    pools = sample.select("rank", "quality", _pools(spark, model)(F.col("text")).alias("pool")).orderBy("rank").collect()
    if not pools:
        return model
    return fit_network(model, np.array([r["pool"] for r in pools]), np.array([float(r["quality"]) for r in pools]))


def _pools(spark: SparkSession, model: Model):
    shared = spark.sparkContext.broadcast(model)  # VOCABULARY x DIM floats bound its size

    @F.pandas_udf("array<double>")
    def pools(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.pool(t) for t in text], dtype=object)

    return pools


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for each whole text, rounded to
    nine places, as ``column``; a column of that name is replaced, so choose
    another where it must stay. A null or empty text has a score like any
    other, texts of any length are read in blocks, repeated rows and ids have a
    score each, an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # VOCABULARY x DIM floats bound its size

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(np.round(shared.value.scores(text), 9))

    return docs.withColumn(column, scored(F.col("text").cast("string")))
