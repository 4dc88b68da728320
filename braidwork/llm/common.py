"""Shared helpers: word splitting, row keys, components."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir, written

#: Fixed value: what a word is wherever sizes or shingles are counted.
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "batches_of", "components", "empty", "row_key", "shared_dir", "word_blocks", "written"]


def empty(df: DataFrame) -> bool:
    return len(df.limit(1).take(1)) == 0


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables written inside go to Python in batches of ``rows``: for rows that
    hold long arrays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def row_key(df: DataFrame) -> Column:
    """128 bits that rows share if they are equal in all columns, nulls
    included, and else with a chance of 2**-128 a pair.

    The hash function skips nulls, so each column goes in beside whether it is
    one; nested values go in as JSON that keeps null fields.
    """
    parts: list[Column] = []
    for c, t in df.dtypes:
        column = F.col(f"`{c}`")
        nested = any(kind in t for kind in ("map<", "struct<", "array<", "variant"))
        parts += [column.isNull(), F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"}) if nested else column]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_blocks(text: str | None, fold: bool = False, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a whole text, in blocks of about ``block`` bytes; ``fold``
    lower-cases A-Z.

    bytes.split() divides at the six ASCII white-space bytes, as WORD does.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    data = data.lower() if fold else data
    at = 0
    while at < len(data):
        end = at + block
        if end < len(data):
            cut = _SPACE.search(data, end)
            end = cut.start() if cut else len(data)
        words = data[at:end].split()
        if words:
            yield words
        at = end


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges (a long, b long)``: ``node, root``.

    The root is the smallest node. Labels fall to the smallest label among the
    neighbours and then jump to their label's label, so the number of rounds
    grows with the logarithm of a component's width. Both joins have one row a
    key on one side, so that a hot node is split by adaptive skew joins; every
    round is a written table.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "cc-0")
    for k in range(1, rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        to = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = lower.join(to, "root", "left").select("node", "was", F.coalesce(F.least("next", "root"), "root").alias("root"))
        step = written(step, f"cc-{k}")
        labels = step.select("node", "root")
        if empty(step.where("was <> root")):
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
