"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master may leave it unset and then
    gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="braidwork-")
    return _local_dirs[app]


def table_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), f"braidwork-{spark.sparkContext.applicationId}", f"{label}-{uuid.uuid4().hex}")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and read it back: the lineage ends there. The file system
    deletes the table when the application ends."""
    spark = df.sparkSession
    path = table_path(spark, label)
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """The other side of a join by run, to be sorted and merged. What a table of
    runs takes as a file says little of its rows: a few columns of millions of
    runs may pass for small, and would be gathered by the driver."""
    return df.hint("merge")
