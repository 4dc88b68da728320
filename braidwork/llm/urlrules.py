"""URL rules as a sort-merge range join.

A host is keyed by its labels in reverse, so the subtree of a rule's host is
one interval of keys. The ends of those intervals are events that carry the
stack of nested rules in force from there on. Events and urls are dealt by
range of key (and page, so that one very common url still divides), each part
is swept in order, and what is in force at a part's start comes from the last
event of the parts before it. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STACK = "array<struct<size:int,host:string,path:string,verdict:string>>"


def host_of(url: Column) -> Column:
    """From the first :// to the next /, ? or #, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each ended by byte 1."""
    return F.encode(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01")), "UTF-8")


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rule_events(rules: DataFrame) -> DataFrame:
    """``rules (host, path, verdict)`` to ``key binary, stack``: at each end of
    a host's interval, the rules in force after it, longest first."""
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null").distinct()
    hosts = rules.select("host").distinct()
    held = hosts.select(F.col("host").alias("at"), F.explode(_suffixes(F.col("host"))).alias("host")).join(rules, "host")
    one = F.struct((F.length("host") + F.length("path")).alias("size"), "host", "path", "verdict")
    stacks = held.groupBy("at").agg(F.reverse(F.array_sort(F.collect_list(one))).alias("stack"))
    low = host_key(F.col("at"))
    return stacks.select(
        F.explode(
            F.array(
                F.struct(low.alias("key"), F.col("stack")),
                F.struct(F.concat(low, F.lit(b"\xff")).alias("key"), F.filter("stack", lambda r: r["host"] != F.col("at")).alias("stack")),
            )
        ).alias("e")
    ).select("e.key", F.col("e.stack").cast(_STACK).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", parts: int | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``.

    A rule fits its host and the hosts below it if the url's path starts with
    the rule's path; the longest host-and-path wins. A null url, or one without
    ://, has an empty host and path and no rule; with no rule the verdict is
    ``default``. Rows are never joined on page_id, so null and repeated ids and
    repeated urls each keep their row; of rules alike in host and path the last
    verdict by name counts. Urls of any length are judged whole, other columns
    of ``pages`` are not read, an empty table gives an empty result.
    """
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col("url").cast("string")
    urls = pages.select(F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast(_STACK).alias("stack"))
    marks = rule_events(rules).select("key", F.lit(0).alias("kind"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack")
    dealt = urls.unionByName(marks).repartitionByRange(parts, "key", "kind", "page_id", "path").withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "url-sweep")  # part must be the same to both readers below
    # One row a part: what is in force when the part begins.
    last = dealt.groupBy("part").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("own"))
    before = last.select("part", F.last("own", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.withColumn("now", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1").join(F.broadcast(before), "part", "left")
    # A label that holds byte 1 itself lies in intervals that are not its own.
    below = lambda r: (F.col("host") == r["host"]) | F.col("host").endswith(F.concat(F.lit("."), r["host"]))
    fits = F.filter(F.coalesce("now", "before"), lambda r: F.col("path").startswith(r["path"]) & below(r))
    return swept.withColumn("hit", F.try_element_at(fits, F.lit(1))).select("page_id", "host", "path", F.concat("hit.host", "hit.path").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
