"""Schemas of run positions. Ids are numbers inside and text outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMAT_VERSION = 9
STATUSES = ("ready", "waiting", "group", "joined", "ended", "failed")
ACTIVE = ("ready", "waiting", "group")
FAILURE = "struct<invocation_id:string,node:string,message:string,panic_stack:string>"
DEADLINE = "context deadline exceeded"


def runs_ddl(state: str) -> str:
    return f"run_id string, definition_id string, format_version int, revision bigint, steps bigint, next_id bigint, schedule_cursor bigint, completed boolean, had_local_failures boolean, failure {FAILURE}, final {state}"


def invocations_ddl(state: str) -> str:
    return f"run_id string, num bigint, call bigint, node string, state {state}, status string, group_num bigint, group_join string, child_group bigint, branch_index int, target string, error string, entry_timeout_ns bigint, continuation string, next array<string>, path array<bigint>, seq bigint"


GROUPS_DDL = "run_id string, num bigint, call bigint, source string, parent bigint, join_node string, path array<bigint>"


def fields_of(ddl: str) -> dict[str, str]:
    """Names and types of a DDL's outer columns."""
    out, depth, begin = {}, 0, 0
    for at, ch in enumerate(ddl + ","):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            name, kind = ddl[begin:at].strip().split(" ", 1)
            out[name], begin = kind, at + 1
    return out


INVOCATION = (
    "num", "call", "node", "state", "status", "group_num", "group_join", "child_group", "branch_index", "target", "error", "entry_timeout_ns", "continuation", "next", "path", "seq",
)
GROUP = ("num", "call", "source", "parent", "join_node", "path")
HEADER = ("run_id", "definition_id", "format_version", "revision", "steps", "next_id", "schedule_cursor", "completed", "had_local_failures", "failure", "final")


def rows_ddl(state: str) -> str:
    """The type of ``Position.rows``."""
    inv = ",".join(f"{n}:{t}" for n, t in fields_of(invocations_ddl(state)).items() if n != "run_id")
    grp = ",".join(f"{n}:{t}" for n, t in fields_of(GROUPS_DDL).items() if n != "run_id")
    return f"{runs_ddl(state)}, inv array<struct<{inv}>>, grp array<struct<{grp}>>"


class Position:
    """Many runs at one committed position each.

    It is held as ``rows``: one row a run, its header beside the arrays ``inv``
    (by number) and ``grp``, so that a superstep reads and writes a run where it
    lies. ``runs``, ``invocations`` and ``groups`` are the same as flat tables;
    a position may be made of those too, and is then gathered once, by run.
    """

    def __init__(self, runs: DataFrame | None = None, invocations: DataFrame | None = None, groups: DataFrame | None = None, rows: DataFrame | None = None):
        self._runs, self._invocations, self._groups, self._rows = runs, invocations, groups, rows

    @property
    def runs(self) -> DataFrame:
        return self._rows.select(*HEADER) if self._runs is None else self._runs

    @property
    def invocations(self) -> DataFrame:
        return self._rows.select("run_id", F.inline("inv")) if self._invocations is None else self._invocations

    @property
    def groups(self) -> DataFrame:
        return self._rows.select("run_id", F.inline("grp")) if self._groups is None else self._groups

    @property
    def rows(self) -> DataFrame:
        if self._rows is not None:
            return self._rows
        inv = self._invocations.groupBy("run_id").agg(F.collect_list(F.struct(*INVOCATION)).alias("inv"))
        grp = self._groups.groupBy("run_id").agg(F.collect_list(F.struct(*GROUP)).alias("grp"))
        none = {c: F.array().cast(t.schema[c].dataType) for c, t in (("inv", inv), ("grp", grp))}
        rows = self._runs.select(*HEADER).join(inv, "run_id", "left").join(grp, "run_id", "left")
        return rows.select(*HEADER, by_number(F.coalesce("inv", none["inv"])).alias("inv"), by_number(F.coalesce("grp", none["grp"])).alias("grp"))

    def only(self, run_ids: DataFrame, how: str = "left_semi") -> Position:
        """The runs that are in ``run_ids``, or with ``left_anti`` those that are not."""
        return Position(rows=self.rows.join(run_ids.select("run_id"), "run_id", how))


def by_number(items: Column) -> Column:
    """Structs sorted by ``num``; their other fields need no order."""
    places = F.array_sort(F.transform(items, lambda x, i: F.struct(x["num"].alias("num"), i.alias("i"))))
    return F.transform(places, lambda k: F.get(items, k["i"]))


def ident(letter: str, number: Column) -> Column:
    """Text form of an id; 0 and null are the empty id."""
    return F.when(F.coalesce(number, F.lit(0)) > 0, F.concat(F.lit(letter), number)).otherwise(F.lit(""))


def public_invocations(df: DataFrame) -> DataFrame:
    return df.select(
        "run_id", ident("i", F.col("num")).alias("id"), ident("c", F.col("call")).alias("call_id"), "node", "state", "status", ident("g", F.col("group_num")).alias("group_id"),
        ident("g", F.col("child_group")).alias("child_group_id"), "branch_index", F.coalesce("continuation", F.lit("")).alias("continuation"), "next",
    )


def public_groups(df: DataFrame) -> DataFrame:
    return df.select("run_id", ident("g", F.col("num")).alias("id"), ident("c", F.col("call")).alias("call_id"), "source", ident("i", F.col("parent")).alias("parent_id"), "join_node")


def public_branches(invocations: DataFrame) -> DataFrame:
    rows = invocations.where("group_num > 0")
    return rows.select("run_id", ident("g", F.col("group_num")).alias("group_id"), "branch_index", ident("i", F.col("num")).alias("invocation_id"), "target", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("entry_timeout_ns", F.lit(0)).alias("entry_timeout_ns"))


def valid_name(name: Column) -> Column:
    """Not empty and without white space around it, in the Unicode sense."""
    return F.coalesce(name, F.lit("")).rlike(r"(?U)^\S(?:[\s\S]*\S)?$")
