"""Near-duplicate texts by similarity of word shingles.

Hashes of a text's shingles give BANDS keys of ROWS minima each: two texts of
similarity s share one with a chance of 1 - (1 - s^ROWS)^BANDS, whatever their
words or lengths (at 0.8 some 3 in a million are missed). Texts that share a key are
compared: first all with the smallest text of the key, then every pair that is
not linked by then, so a dense group costs rows in proportion to its members
and no pair is left out by rank. Sketches discard pairs far from the least
similarity and decide short texts; the full sets of shingles decide the others.

With a ``radius``, texts whose SimHash fingerprints differ in so many bits or
fewer are linked first, through ``simhash``'s index; shingles are then compared
where texts are not linked yet, and a group is linked by either.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import batches_of, components, empty, row_key, word_blocks, written
from .simhash import UNIT, fingerprint, groups

SHINGLE, SIMILARITY = 5, 0.8
#: Keys of a text, and minima that make a key.
BANDS, ROWS = 32, 5
#: Shingles of a text that its sketch holds: those with the smallest hashes. Of
#: texts with fewer a similarity is exact, else off by 0.02 or less (one sigma).
SKETCH = 512
#: Pairs with sketches, and with whole sets of shingles, that Python gets at once.
SKETCHES, SETS = 1024, 64
#: Below the least similarity by so much (over five sigma), a sketch refutes a pair.
FAR = 0.1
_ODD = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _shingles(words: np.ndarray) -> np.ndarray:
    n = max(1, len(words) - SHINGLE + 1) if len(words) else 0
    shingles = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        shingles = shingles * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return np.unique(_mix(shingles))


def _words(text: str | None) -> np.ndarray:
    parts = [np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(1)), np.uint64, len(words)) for words in word_blocks(text, fold=True)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """All shingles of a text, as sorted 64-bit hashes."""
    return _shingles(_words(text))


def bands(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys; a text without words has keys of its own kind."""
    least = np.full(len(_ODD), ~np.uint64(0))
    for at in range(0, len(shingles), 512):
        h = shingles[at : at + 512] * _ODD[:, None]
        h ^= h >> np.uint64(32)
        np.minimum(least, h.min(1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(ROWS, BANDS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key


def describe(text: str | None) -> tuple[int, np.ndarray, np.ndarray, int]:
    """A key that equal word sequences share, the band keys, the sketch of the
    shingles (sorted 32-bit hashes) and the number of different shingles."""
    words = _words(text)
    key = xxhash.xxh3_64_intdigest(words.tobytes())
    shingles = _shingles(words)
    sketch = np.unique((shingles >> np.uint64(32)).astype(np.uint32))[:SKETCH]
    return key, bands(shingles), sketch, len(shingles)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of the shingle sets behind two sketches: the share that both have of all
    hashes if the sketches are whole, else of the SKETCH smallest of either."""
    both = np.union1d(a, b)
    if max(len(a), len(b)) >= SKETCH:
        both = both[:SKETCH]
    if not len(both):
        return 1.0
    return float(np.isin(both, a, assume_unique=True) @ np.isin(both, b, assume_unique=True).astype(int)) / len(both)


def _describe(prints: bool):
    """Columns doc_id, row, text; out come doc_id, row, what ``describe`` gives
    and, if ``prints``, the SimHash fingerprint (else 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows, fps = [], np.zeros(part.num_rows, np.uint64)
                for k, value in enumerate(part.column(2)):
                    text = value.as_py()
                    rows.append(describe(text))
                    if prints:
                        fps[k] = fingerprint(text)
                sizes = np.cumsum([0, *(len(r[2]) for r in rows)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(np.array([r[0] for r in rows], np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate([r[1] for r in rows]).view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([r[2] for r in rows]).view(np.int32))),
                        pa.array([r[3] for r in rows], pa.int32()),
                        pa.array(fps.view(np.int64)),
                    ],
                    names=["doc_id", "row", "key", "bands", "sketch", "n", "fp"],
                )

    return run


def _meeting(sketches: list[np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions i, j of sketches that may be similar by ``least``: what both
    hold, over the size of their union (SKETCH at most), bounds ``similarity``
    from above; for whole sketches it is over all of the union and equal to it."""
    sizes = np.array([len(x) for x in sketches])
    own = np.repeat(np.arange(len(sizes)), sizes)
    codes = np.unique(np.concatenate(sketches), return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    holders = np.split(own[order], np.flatnonzero(np.diff(codes[order])) + 1)
    ends = np.cumsum(sizes)
    for i, (lo, hi) in enumerate(zip(ends - sizes, ends, strict=True)):
        if lo < hi:
            both = np.bincount(np.concatenate([holders[c] for c in codes[lo:hi]]), minlength=len(sizes))
            whole, union = np.maximum(sizes, sizes[i]) < SKETCH, sizes[i] + sizes - both
            j = np.flatnonzero(both / np.where(whole, union, np.minimum(SKETCH, union)) >= np.where(whole, least, least - FAR))
            yield np.full(len(j), i), j


def _apart(least: float):
    """Columns unit, key, root, side, sketch, sorted by unit; out come ``a, b``:
    the pairs of a unit's keys with different roots (and different sides, where
    the unit is a pair of parts) that their sketches do not refute."""

    def pairs(key: np.ndarray, root: np.ndarray, side: np.ndarray, sketches: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if (root == root[0]).all():
            return
        for i, j in _meeting(sketches, least):
            new = (root[i] != root[j]) & ((side[i] != side[j]) | (side[i] == 0)) & (key[i] < key[j])
            if new.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[i[new]]), pa.array(key[j[new]])], names=["a", "b"])

    def units(held: list[np.ndarray], sketches: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cut = [0, *(np.flatnonzero(np.diff(held[0])) + 1), len(held[0])]
        for lo, hi in zip(cut, cut[1:], strict=False):
            yield from pairs(*(h[lo:hi] for h in held[1:]), sketches[lo:hi])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sketches = [np.zeros(0, np.int64)] * 4, []
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns[:4], strict=True)]
            sketches += [np.array(x.values) for x in batch.column(4)]
            unit = held[0]
            done = int(np.flatnonzero(unit != unit[-1])[-1]) + 1 if len(unit) and unit[0] != unit[-1] else 0
            if done:
                yield from units([h[:done] for h in held], sketches[:done])
                held, sketches = [h[done:] for h in held], sketches[done:]
        if len(held[0]):
            yield from units(held, sketches)

    return run


def alike(classes: DataFrame, radius: int, unit: int = UNIT) -> DataFrame:
    """``key, first_key`` over ``classes (key, fp)``: the smallest key of the
    group of texts that links of SimHash within ``radius`` bits join."""
    roots = groups(classes.select("fp"), radius, unit)
    least = classes.groupBy("fp").agg(F.min("key").alias("least")).join(roots, "fp")
    least = least.withColumnRenamed("fp", "print")
    first = least.groupBy("root").agg(F.min("least").alias("first_key"))
    named = least.join(first, "root").select(F.col("print").alias("fp"), "first_key")
    return written(classes.select("key", "fp").join(named, "fp").select("key", "first_key"), "near-alike")


def shared_bands(classes: DataFrame) -> DataFrame:
    """``band, key, first_key, least, least_first, n`` over ``classes (key,
    bands, first_key)``: the bands of more than one text, with the smallest of
    their keys, its first_key and their number."""
    rows = classes.select("key", "first_key", F.explode("bands").alias("band"))
    many = rows.groupBy("band").agg(F.min(F.struct("key", "first_key")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    many = written(many.select("band", F.col("least.key").alias("least"), F.col("least.first_key").alias("least_first"), "n"), "near-many")
    return written(rows.join(many, "band"), "near-shared")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def unsettled(shared: DataFrame, labels: DataFrame, sketches: DataFrame, least: float, unit: int = UNIT) -> DataFrame:
    """``a, b``: every pair of a band whose texts have different roots in
    ``labels (key, root)`` and sketches that do not refute it. Bands of over ``unit`` texts divide into parts, and
    the pairs of parts are units."""
    rows = shared.where("n > 2").join(labels, "key", "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    rows = written(rows, "near-rooted")
    open_ = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s")
    rows = rows.join(open_.select("band", F.ceil(F.col("n") * 2 / unit).cast("int").alias("parts")), "band")
    rows = rows.withColumn("parts", F.when(F.col("parts") > 2, F.col("parts")).otherwise(1)).withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(i == j, 0).when(F.col("own") == i, 1).otherwise(2).cast("long")
    units = rows.select(F.xxhash64("band", i, j).alias("unit"), "key", "root", side.alias("side")).join(sketches, "key")
    units = units.select("unit", "key", "root", "side", "sketch").repartition("unit").sortWithinPartitions("unit")
    return units.mapInArrow(_apart(least), "a long, b long").distinct()


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(np.asarray(x).view(np.uint32), np.asarray(y).view(np.uint32)) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def _exact(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([(both := len(np.intersect1d(x, y, assume_unique=True))) / (len(x) + len(y) - both) for x, y in zip(a, b, strict=True)], dtype=float)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            rows = [shingle_set(t.as_py()).view(np.int64) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["key", "shingles"])


def _both(pairs: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with the ``columns`` of ``of (key, ...)`` for a and for b."""
    for end in ("a", "b"):
        pairs = pairs.join(of.select(F.col("key").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
    return pairs


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()


def _sketches(prints: DataFrame) -> DataFrame:
    return prints.groupBy("key").agg(F.first("sketch").alias("sketch"), F.first("n").alias("n"))


def linked(asked: DataFrame, prints: DataFrame, classes: DataFrame, texts: DataFrame, least: float, name: str) -> DataFrame:
    """The rows of ``asked (a, b)`` whose similarity is ``least`` or more. Pairs
    carry sketches or whole sets, so they go to Python in small batches."""
    spark = asked.sparkSession
    # Copies are merged before the join, so that no key is hot in it.
    sketches = _sketches(prints).join(_ends(asked), "key")
    pairs = _both(asked, written(sketches, f"near-sketches-{name}"), ["sketch", "n"])
    pairs = pairs.select("a", "b", _similarity("sketch_a", "sketch_b").alias("s"), (F.greatest("n_a", "n_b") < SKETCH).alias("whole"))
    with batches_of(spark, SKETCHES):
        pairs = written(pairs.where(F.col("s") >= F.when(F.col("whole"), least).otherwise(least - FAR)), f"near-sketched-{name}")
    sure, rest = pairs.where("whole").select("a", "b"), pairs.where("not whole").select("a", "b")
    if empty(rest):
        return sure
    rows = _ends(rest).join(classes.select("key", F.col("first.row").alias("row")), "key")
    sets = texts.join(rows, "row").select("key", "text").mapInArrow(_sets, "key long, shingles array<long>")
    with batches_of(spark, SETS):
        sets = written(sets.dropDuplicates(["key"]), f"near-sets-{name}")
        exact = _both(rest, sets, ["shingles"]).select("a", "b", _exact("shingles_a", "shingles_b").alias("s"))
        return sure.unionByName(written(exact.where(F.col("s") >= least).select("a", "b"), f"near-exact-{name}"))


def one_of_each(docs: DataFrame, least: float = SIMILARITY, unit: int = UNIT, radius: int | None = None) -> DataFrame:
    """``docs`` with one row of each group of texts that are equal word for
    word (A-Z folded), linked by similarities of ``least`` or more or, with a
    ``radius``, by SimHash fingerprints that differ in so many bits or fewer.

    It is the row with the smallest doc_id (nulls last), then the smallest hash
    of all columns; of rows equal in all columns one stays. Texts without words
    (or null) are equal. An empty table gives an empty result.
    """
    keyed = docs.withColumn("_bw_row", row_key(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = keyed.select("doc_id", F.col("_bw_row").alias("row"), F.col("text").cast("string").alias("text"))
    described = named.mapInArrow(_describe(radius is not None), f"doc_id {kind}, row struct<a:long,b:long>, key long, bands array<long>, sketch array<int>, n int, fp long")
    prints = written(described, "near-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row"))
    classes = written(prints.groupBy("key").agg(first.alias("first"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "near-classes")
    if radius is None:
        near, known = classes.select("key", "bands", F.col("key").alias("first_key")), classes.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0)
    else:
        same = alike(classes, radius, unit)
        near, known = classes.select("key", "bands").join(same, "key"), same.where("key <> first_key").select(*_ordered("key", "first_key"))
    shared = shared_bands(near)
    asked = written(shared.where("first_key <> least_first").select(*_ordered("key", "least")).distinct(), "near-asked")
    texts = named.select("row", "text")
    found = written(known.unionByName(linked(asked, prints, classes, texts, least, "stars")), "near-linked")
    labels = components(found).withColumnRenamed("node", "key") if not empty(found) else classes.select("key", F.col("key").alias("root")).limit(0)
    more = written(unsettled(shared, labels, _sketches(prints).select("key", "sketch"), least, unit).join(asked, ["a", "b"], "left_anti"), "near-unsettled")
    if not empty(more):
        found = written(found.unionByName(linked(more, prints, classes, texts, least, "rest")), "near-all")
        if not empty(found):
            labels = components(found).withColumnRenamed("node", "key")
    roots = classes.select("key", "first").join(labels, "key", "left").withColumn("root", F.coalesce("root", "key"))
    kept = roots.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_bw_row")).distinct()
    counts = prints.groupBy(F.col("row").alias("_bw_row")).agg(F.count(F.lit(1)).alias("_bw_n"))
    kept = written(kept.join(counts, "_bw_row"), "near-kept")
    found = keyed.join(kept.hint("merge"), "_bw_row")  # alike at every size: texts move once
    out = found.where("_bw_n = 1")
    if not empty(kept.where("_bw_n > 1")):
        out = out.unionByName(found.where("_bw_n > 1").dropDuplicates(["_bw_row"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
