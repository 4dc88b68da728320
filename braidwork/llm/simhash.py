"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are dealt to units by the bits of a few blocks, so that
two within the radius meet in at least one unit. A unit is sorted by Gray rank,
which puts fingerprints that share bits next to each other; nodes above them
hold the bits that all below have in common, and a search of the index against
itself drops a pair of nodes as soon as the common bits differ in more places
than the radius allows. What a unit finds leaves it as a star, one row for each
fingerprint, so a dense group costs rows in proportion to its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import components, empty, row_key, word_blocks, written

RADIUS = 3
#: A unit with more fingerprints than this is divided into parts, and the pairs of parts are units.
UNIT = 8192
#: Children of a node of the index.
FAN = 8
#: Pairs of nodes that are looked at together.
FRONT = 1 << 18


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if over half the hashes of the text's shingles have it."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for words in word_blocks(text, fold=True):
        words = tail + words
        tail = words[-(shingle - 1) :] if shingle > 1 else []
        n = len(words) - shingle + 1
        if n > 0:
            joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
            h = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), np.uint64, n)
            bits = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            total += n
    if not total:
        if not tail:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(tail), seed)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def fingerprint_of(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in text], dtype="uint64").astype("int64")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Where each code stands in the order of Gray codes (uint64)."""
    rank = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


class GrayIndex:
    """Nodes over fingerprints sorted by unit and Gray rank. Each level has the
    mask of the bits that all below a node share, those bits, and the first and
    last unit below it."""

    def __init__(self, units: np.ndarray, codes: np.ndarray):
        self.units, self.codes = units, codes
        ones, zeros, first, last = codes, ~codes, units, units
        self.levels = [(np.full(len(codes), ~np.uint64(0)), codes, units, units)]
        while len(ones) > 1:
            at = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            first, last = first[at], last[np.minimum(at + FAN, len(last)) - 1]
            self.levels.append((ones | zeros, ones, first, last))

    def _kept(self, level: int, a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        mask, bits, first, last = self.levels[level]
        differ = np.bitwise_count((bits[a] ^ bits[b]) & mask[a] & mask[b])
        keep = (differ <= radius) & (last[a] >= first[b])
        return a[keep], b[keep]

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions i < j of the same unit whose codes differ in at most
        ``radius`` bits, in slices."""
        step = np.arange(FAN)
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            if level == 0:
                keep = (a < b) & (self.units[a] == self.units[b])
                if keep.any():
                    yield a[keep], b[keep]
                continue
            n = len(self.levels[level - 1][0])
            for at in range(0, len(a), FRONT // (FAN * FAN)):
                x, y = a[at : at + FRONT // (FAN * FAN)], b[at : at + FRONT // (FAN * FAN)]
                left = np.repeat((x[:, None] * FAN + step).ravel(), FAN)
                right = np.repeat((y[:, None] * FAN + step), FAN, axis=0).ravel()
                inside = (left < n) & (right < n) & (left <= right)
                left, right = self._kept(level - 1, left[inside], right[inside], radius)
                if len(left):
                    todo.append((level - 1, left, right))


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of each a and b; a label is the smallest position."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def _search(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def stars(unit: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        ids = np.unique(unit, return_inverse=True)[1].astype(np.int64)
        codes = fp.view(np.uint64)
        order = np.lexsort((gray_rank(codes), ids))
        ids, codes = ids[order], codes[order]
        labels = np.arange(len(codes))
        for i, j in GrayIndex(ids, codes).pairs(radius):
            merge(labels, i, j)
        far = np.flatnonzero(labels != np.arange(len(codes)))
        if not len(far):
            return None
        signed = codes.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[far]), pa.array(signed[labels[far]])], schema=schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last unit of a batch may go on in the next one, so it waits."""
        units, codes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            units = np.concatenate([units, batch.column(0).to_numpy(zero_copy_only=False)])
            codes = np.concatenate([codes, batch.column(1).to_numpy(zero_copy_only=False)])
            done = int(np.flatnonzero(units != units[-1])[-1]) + 1 if len(units) and units[0] != units[-1] else 0
            if done:
                if (out := stars(units[:done], codes[:done])) is not None:
                    yield out
                units, codes = units[done:], codes[done:]
        if len(units) and (out := stars(units, codes)) is not None:
            yield out

    return search


def block_masks(rows: int, radius: int = RADIUS) -> list[int]:
    """Masks of which two codes within ``radius`` agree on at least one.

    64 bits in radius + 1 or more blocks; each mask holds all but ``radius`` of
    them. More blocks make more and finer units: 16 common bits up to 2**26
    fingerprints, 25 up to 2**36, then 32.
    """
    blocks = radius + (1 if rows <= 1 << 26 else 2 if rows <= 1 << 36 else 3)
    cut = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cut, cut[1:], strict=False)]
    return [sum(block[k] for k in kept) for kept in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = RADIUS, unit: int = UNIT) -> DataFrame:
    """Stars ``a, b`` over ``distinct (fp)`` whose components are those of all
    links within ``radius``."""
    masks = block_masks(distinct.count(), radius)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(keys).alias("u")).select("u.t", "u.key", "fp")
    large = written(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > unit), "simhash-large")
    whole = rows.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    if not empty(large):
        parts = F.ceil(F.col("n") * 2 / unit).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        split = rows.join(large, ["t", "key"]).withColumn("parts", parts).withColumn("own", own)
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        split = split.select("t", "key", "fp", (F.least("own", "other") + 1).alias("i"), (F.greatest("own", "other") + 1).alias("j"))
        whole = rows.join(large, ["t", "key"], "left_anti").withColumn("i", F.lit(0)).withColumn("j", F.lit(0)).unionByName(split.select("t", "key", "fp", "i", "j"))
    keyed = whole.select(F.xxhash64("t", "key", "i", "j").alias("unit"), "fp")
    return keyed.repartition("unit").sortWithinPartitions("unit").mapInArrow(_search(radius), "a long, b long")


def groups(prints: DataFrame, radius: int = RADIUS, unit: int = UNIT) -> DataFrame:
    """``prints (fp, ...)`` to a table ``fp, root`` of one row a fingerprint."""
    distinct = written(prints.select("fp").distinct(), "simhash-distinct")
    stars = written(links(distinct, radius, unit), "simhash-stars")
    if empty(stars):
        return distinct.select("fp", F.col("fp").alias("root"))
    found = components(stars).withColumnRenamed("node", "fp")
    return written(distinct.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "simhash-groups")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row a document: ``doc_id, fingerprint, component_id``.

    A text without words (or null) has fingerprint zero. Rows with the same
    fingerprint are one node. The component's id is its smallest doc_id that is
    not null, null if it has none. An empty table gives an empty result.
    """
    prints = written(docs.select("doc_id", fingerprint_of(F.col("text").cast("string")).alias("fp")), "simhash-prints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    group = groups(prints, radius).join(least, "fp")
    smallest = group.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(group.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates.

    It is the row with the smallest doc_id (nulls last), then the smallest hash
    of all columns; of rows equal in all columns one stays.
    """
    keyed = docs.withColumn("_bw_row", row_key(docs))
    prints = written(keyed.select("doc_id", "_bw_row", fingerprint_of(F.col("text").cast("string")).alias("fp")), "simhash-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_bw_row"))
    own = prints.groupBy("fp").agg(first.alias("first"))
    kept = groups(prints, radius).join(own, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._bw_row").alias("_bw_row"))
    counts = prints.groupBy("_bw_row").agg(F.count(F.lit(1)).alias("_bw_n"))
    kept = written(kept.distinct().join(counts, "_bw_row"), "simhash-kept")
    found = keyed.join(kept.hint("merge"), "_bw_row")  # alike at every size: texts move once
    out = found.where("_bw_n = 1")
    if not empty(kept.where("_bw_n > 1")):
        out = out.unionByName(found.where("_bw_n > 1").dropDuplicates(["_bw_row"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
