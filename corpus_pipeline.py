"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and reads it again as the next one's docs.
All but the last return the columns of docs. Null texts and ids, repeated rows,
empty tables and further columns pass through as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import decontaminate, mixing, neartext, quality, shards, simhash
from braidwork.llm.common import written

SHARDS = 40


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold. The model is fitted on a
    bounded sample of the labelled rows of ``docs``; where no label is found,
    every score is 0.5 and every document stays."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.train(docs.select("doc_id", "text"), labels)
    return quality.score(docs, model, "_bw_score").where(F.col("_bw_score") >= quality.THRESHOLD).drop("_bw_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: texts whose SimHash fingerprints (as in
    ``op3``) differ in three bits or fewer, and texts that this leaves apart but
    similarities of 0.8 or more of their five-word shingles link."""
    return neartext.one_of_each(docs, radius=simhash.RADIUS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.without_leaks(docs, benchmark)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents, as often as its target weight asks for."""
    return mixing.mixed(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs with ``shard`` and ``virtual_slot``."""
    return shards.with_shard(docs, SHARDS)


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
    ("sharding", assign_shards),
]

#: The first two stages and the mix's knapsack cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
