"""The invariants of a position, as a DataFrame of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.graph import Compiled
from .schema import ACTIVE, FORMAT_VERSION, STATUSES, Position, ident, valid_name


def _rows(df: DataFrame, rules: dict[str, Column], detail: Column) -> DataFrame:
    broken = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.select("run_id", F.explode(broken).alias("rule"), detail.alias("detail"))


def violations(pos: Position, graph: Compiled) -> DataFrame:
    """``run_id, rule, detail``; a sound position has no row."""
    runs, rows, groups = pos.runs, pos.invocations, pos.groups
    nodes, joins, keys = (F.array(*[F.lit(x) for x in sorted(s)]).cast("array<string>") for s in (graph.nodes, graph.joins, graph.continuations))
    edges = F.array(*[F.lit(f"{s}\x00{t}") for s, t in graph.edges]).cast("array<string>")
    out = [
        _rows(runs, {
            "header_format": F.col("format_version") != FORMAT_VERSION,
            "header_names": ~valid_name(F.col("run_id")) | ~valid_name(F.col("definition_id")),
            "header_revision": F.col("revision") < 1,
            "header_next_id": (F.col("next_id") < 3) | (F.col("schedule_cursor") >= F.col("next_id")),
            "header_final": F.col("final").isNotNull() & ~F.col("completed"),
            "failure_shape": F.col("failure").isNotNull() & (~F.col("completed") | F.col("final").isNotNull()),
            "completed_steps": F.col("completed") & (F.col("steps") <= 0) & F.col("failure").isNull(),
        }, F.lit("")),
    ]
    live = rows.join(runs.select("run_id", "next_id", "completed"), "run_id")
    twice = F.count(F.lit(1)).over(Window.partitionBy("run_id", "num")) > 1
    out.append(_rows(live.withColumn("twice", twice), {
        "id_range": (F.col("num") < 1) | (F.col("num") >= F.col("next_id")) | (F.col("call") >= F.col("next_id")),
        "id_unique": F.col("twice"),
        "status": ~F.col("status").isin(*STATUSES),
        "branch_index": (F.col("branch_index") < 0) | ((F.col("group_num") == 0) & (F.col("branch_index") != 0)),
        "continuation": (F.col("status") != "waiting") & (F.col("continuation").isNotNull() | F.col("next").isNotNull()),
        "child_group": (F.col("status") != "group") & (F.col("child_group") > 0),
        "call": F.col("status").isin("ready", "waiting") & F.col("call").isNull(),
        "resolved_call": ~F.col("status").isin("ready", "waiting") & F.col("call").isNotNull(),
        "node": F.col("status").isin("ready", "waiting") & ~F.array_contains(nodes, F.col("node")),
        "waiting_key": (F.col("status") == "waiting") & ~F.coalesce(F.array_contains(keys, F.col("continuation")), F.lit(False)),
        "waiting_targets": (F.col("status") == "waiting") & ((F.coalesce(F.size("next"), F.lit(0)) < 1) | F.exists("next", lambda t: ~F.array_contains(edges, F.concat(F.col("node"), F.lit("\x00"), t)))),
        "joined_node": (F.col("status") == "joined") & ~F.array_contains(joins, F.col("node")),
        "entry_timeout": (F.col("entry_timeout_ns") < 0) | ((F.col("entry_timeout_ns") > 0) & ~F.col("status").isin("ready", "failed")),
        "branch_error": (F.coalesce("error", F.lit("")) != "") & (F.col("status") != "failed"),
        "completed_rows": F.col("completed"),
    }, ident("i", F.col("num"))))
    calls = rows.where("call is not null").select("run_id", "call").unionByName(groups.where("call is not null").select("run_id", "call"))
    out.append(calls.groupBy("run_id", "call").count().where("count > 1").select("run_id", F.lit("call_unique").alias("rule"), ident("c", F.col("call")).alias("detail")))
    parents = rows.select("run_id", F.col("num").alias("parent"), F.col("status").alias("p_status"), F.col("child_group").alias("p_child"), F.col("node").alias("p_node"))
    kids = rows.where("group_num > 0").groupBy("run_id", F.col("group_num").alias("num")).agg(F.count(F.lit(1)).alias("kids"), F.max("branch_index").alias("last"), F.count_distinct("branch_index").alias("indexes"))
    held = groups.join(parents, ["run_id", "parent"], "left").join(kids, ["run_id", "num"], "left")
    sources = {j.source: j.name for j in graph.joins.values()}
    own = reduce(lambda c, kv: F.when(F.col("source") == kv[0], F.lit(kv[1])).otherwise(c), sources.items(), F.lit(""))
    out.append(_rows(held, {
        "group_parent": F.col("p_status").isNull() | (F.col("p_status") != "group"),
        "group_back": F.col("p_child") != F.col("num"),
        "group_source": F.col("p_node") != F.col("source"),
        "group_join": F.col("join_node") != own,
        "group_empty": (F.col("join_node") == "") & F.col("kids").isNull(),
        "group_index": (F.col("last") + 1 != F.col("kids")) | (F.col("indexes") != F.col("kids")),
        "group_cycle": F.array_contains("path", F.col("num")),
    }, ident("g", F.col("num"))))
    member = rows.where("group_num > 0").join(groups.select("run_id", F.col("num").alias("group_num"), F.col("join_node").alias("g_join"), F.lit(True).alias("there")), ["run_id", "group_num"], "left")
    out.append(_rows(member, {"member_group": F.col("there").isNull(), "member_join": (F.col("status") == "joined") & (F.col("node") != F.col("g_join"))}, ident("i", F.col("num"))))
    led = rows.where("child_group > 0").join(groups.select("run_id", F.col("num").alias("child_group"), F.lit(True).alias("there")), ["run_id", "child_group"], "left")
    out.append(_rows(led, {"child_group_missing": F.col("there").isNull()}, ident("i", F.col("num"))))
    out.append(stuck(pos).select("run_id", F.lit("stuck").alias("rule"), F.lit("").alias("detail")))
    return reduce(DataFrame.unionByName, out)


def stuck(pos: Position) -> DataFrame:
    """Active runs in which nothing is ready or waiting and no group is due."""
    rows = pos.invocations
    due = pos.groups.select("run_id", "num").join(
        rows.where("group_num > 0").groupBy("run_id", F.col("group_num").alias("num")).agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("open")), ["run_id", "num"], "left"
    ).where("coalesce(open, 0) = 0")
    going = rows.where("status in ('ready', 'waiting')").select("run_id").unionByName(due.select("run_id")).distinct()
    return pos.runs.where("not completed").select("run_id").join(going, "run_id", "left_anti")
