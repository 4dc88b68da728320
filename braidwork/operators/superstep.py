"""Supersteps over all runs of a position, each run within its own row.

A superstep gathers the tasks of every run (merges of groups first, then ready
nodes in order), evaluates their outcomes as Columns, orders them within the
run, keeps those that the run's own order admits, and derives the run's next
row. All of it is array expressions over one row a run, so a superstep is a
chain of narrow projections: no shuffle, no join, nothing collected. Each
superstep writes one table, which ends the lineage there; runs that have no
task left stay behind in the table they finished in.

Arrays that an expression uses inside a lambda are columns of a projection
below it and are used twice, once for their size: Catalyst then computes them
once a run and not once an element.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass
from functools import cached_property, reduce
from inspect import signature
from threading import Condition, Event
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.outcomes import RESOLVED, Outcomes
from ..plans.graph import SCOPES, Compiled, JoinSpec
from ..sources.tables import written
from .pynodes import evaluate_python
from .schema import DEADLINE, FAILURE, GROUP, GROUPS_DDL, INVOCATION, by_number, fields_of, invocations_ddl

SUPERSTEP = 1 << 40  # room for the order within a superstep
#: Columns of a call beside the position's.
LIVE = ("left", "superstep", "stop", "message", "idle")
GOING = "not completed and stop is null and not idle"
#: Tables of finished runs that are united before they are written as one.
TABLES = 16


@dataclass(frozen=True)
class Options:
    """Limits of one call; zero means the default, negatives are rejected."""

    max_steps: int = 0
    max_invocations: int = 0
    failure_override: str | None = None
    #: Tasks of a superstep that run at once; it changes no result.
    max_concurrency: int = 0
    #: The last value of ids, steps and revisions: what would pass it stops the run.
    counter_limit: int = (1 << 63) - 1

    def __post_init__(self) -> None:
        if min(self.max_steps, self.max_invocations, self.max_concurrency, self.counter_limit) < 0:
            raise ValueError("limits must not be negative")
        if self.failure_override is not None and self.failure_override not in SCOPES:
            raise ValueError("failure override is unknown")

    @property
    def steps(self) -> int:
        return self.max_steps or 10_000


def _case(column: Column, cases: dict[str, Column], otherwise: Column) -> Column:
    return reduce(lambda c, kv: F.when(column == kv[0], kv[1]).otherwise(c), cases.items(), otherwise)


def _lookup(table: dict[str, str], key: Column) -> Column:
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), key)


class Limiter:
    """Permits for tasks, shared by all calls of a process that are given it."""

    def __init__(self, permits: int):
        if permits <= 0:
            raise ValueError("a limiter needs permits")
        self.free, self._changed = permits, Condition()

    @contextmanager
    def take(self, wanted: int) -> Iterator[int]:
        """As many permits as are free, at least one and ``wanted`` at most."""
        with self._changed:
            self._changed.wait_for(lambda: self.free > 0)
            got = min(wanted, self.free)
            self.free -= got
        try:
            yield got
        finally:
            with self._changed:
                self.free += got
                self._changed.notify_all()


class Cancellation:
    """Stops the calls that are given it: no superstep begins after ``cancel``,
    and one that runs is interrupted and dropped, so that every run stays at the
    position before it, with its pending identities."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self._set = spark, f"braidwork-{uuid4().hex}", Event()

    def cancel(self) -> None:
        self._set.set()
        self.spark.interruptTag(self.tag)

    def __bool__(self) -> bool:
        return self._set.is_set()

    @contextmanager
    def tagged(self) -> Iterator[None]:
        self.spark.addTag(self.tag)
        try:
            yield
        finally:
            self.spark.removeTag(self.tag)


class Steps:
    """Projections to be applied to any table of rows: a superstep's Columns are
    made once for an engine and resolved anew against each table."""

    def __init__(self) -> None:
        self.list: list[tuple[str, tuple]] = []

    def withColumns(self, columns: dict[str, Column]) -> Steps:
        self.list.append(("withColumns", (columns,)))
        return self

    def withColumn(self, name: str, column: Column) -> Steps:
        return self.withColumns({name: column})

    def drop(self, *names: str) -> Steps:
        self.list.append(("drop", names))
        return self

    def select(self, *columns: Column | str) -> Steps:
        self.list.append(("select", columns))
        return self

    def on(self, rows: DataFrame) -> DataFrame:
        return reduce(lambda df, step: getattr(df, step[0])(*step[1]), self.list, rows)


class Items:
    """An array column of structs."""

    def __init__(self, column: str | Column):
        self.column = F.col(column) if isinstance(column, str) else column

    def add(self, **new: Callable[..., Column]) -> Items:
        """More fields, each a function of the element (and its place)."""
        wide = {n: len(signature(fn).parameters) > 1 for n, fn in new.items()}

        def one(x: Column, i: Column) -> Column:
            return reduce(lambda y, kv: y.withField(kv[0], kv[1](x, i) if wide[kv[0]] else kv[1](x)), new.items(), x)

        return Items(F.transform(self.column, one))

    def where(self, condition: Callable[[Column], Column]) -> Items:
        return Items(F.filter(self.column, condition))


class Acts:
    """What is known of each task: small structs in the column ``acts``, beside
    ``own`` (the invocation a task works on) and ``outs`` (its outcome), which
    are large and never copied."""

    def __init__(self, column: Column | None = None):
        self.column = column

    def add(self, **new: Callable[..., Column]) -> Acts:
        """More fields, each a function of the task (and its place)."""
        wide = {n: len(signature(fn).parameters) > 1 for n, fn in new.items()}

        def one(z: Column, i: Column) -> Column:
            found = {n: fn(Task(z), i) if wide[n] else fn(Task(z)) for n, fn in new.items()}
            if self.column is None:
                return F.struct(*[c.alias(n) for n, c in found.items()])
            return reduce(lambda y, kv: y.withField(*kv), found.items(), z["acts"])

        zipped = F.arrays_zip("own", "outs") if self.column is None else F.arrays_zip("own", "outs", self.column.alias("acts"))
        return Acts(F.transform(zipped, one))


class Task:
    """One task: fields of its act, ``inv`` and ``o``."""

    def __init__(self, z: Column):
        self.z = z

    def __getitem__(self, name: str) -> Column:
        return self.z["own"] if name == "inv" else self.z["outs"] if name == "o" else self.z["acts"][name]


def prefix_sums(numbers: Column) -> Column:
    """Of an array column of longs: what comes before each. Blocks of a root of
    the length keep the copies that an aggregate makes short."""
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<bigint>")

    def scan(xs: Column) -> Column:
        begin = F.struct(none.alias("out"), zero.alias("sum"))
        return F.aggregate(xs, begin, lambda a, x: F.struct(F.concat(a["out"], F.array(a["sum"])).alias("out"), (a["sum"] + x).alias("sum")), lambda a: a["out"])

    width = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(numbers))).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / width).cast("int")), lambda k: F.slice(numbers, k * width + 1, width))
    before = scan(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + x)))
    long = F.flatten(F.zip_with(blocks, before, lambda b, o: F.transform(scan(b), lambda x: x + o)))
    return F.when(F.size(numbers) == 0, none).when(F.size(numbers) <= 16, scan(numbers)).otherwise(long)


def _get(items: Column, place: int) -> Column:
    return F.try_element_at(items, F.lit(place))


def _none(column: str) -> Column:
    """An empty array of the column's type."""
    return F.slice(column, F.lit(1), F.lit(0))


class Engine:
    def __init__(self, graph: Compiled, state: str, options: Options | None = None):
        self.graph, self.state, self.options = graph, state, options or Options()
        self.out = Outcomes(state)
        override = self.options.failure_override
        scopes = {override} if override else {s.on_error for s in [*graph.nodes.values(), *graph.joins.values()]}
        self.early = any(j.quorum or j.can_merge is not None for j in graph.joins.values())
        #: Whether one outcome can remove rows that another task of the step works on.
        self.removes = self.early or "fail_group" in scopes
        self.fails_groups = "fail_group" in scopes

    # --- tasks ----------------------------------------------------------------

    def scope(self, name: Column, specs: dict) -> Column:
        if self.options.failure_override:
            return F.lit(self.options.failure_override)
        return F.coalesce(_lookup({k: v.on_error for k, v in specs.items()}, name), F.lit("fail_invocation"))

    def call(self, inv: Column, **more: Column) -> Column:
        return F.struct("run_id", F.concat(F.lit("i"), inv["num"]).alias("invocation_id"), F.concat(F.lit("c"), inv["call"]).alias("call_id"), *[c.alias(n) for n, c in more.items()])

    def due(self, rows: Steps) -> Steps:
        """Column ``due``: the groups that merge or settle now, each with its
        parent's invocation, branches as its join sees them, and call."""
        branch = lambda x: F.struct(x["branch_index"].alias("index"), x["target"].alias("target"), x["node"].alias("node"), x["status"].alias("status"), x["state"].alias("state"), F.coalesce(x["error"], F.lit("")).alias("error"), x["seq"].alias("seq"))
        own = lambda g: F.filter("inv", lambda x: x["group_num"] == g["num"])
        groups = F.when(F.expr(GOING), F.col("grp")).otherwise(_none("grp"))
        held = Items(groups).add(kids=own).add(full=lambda g: F.forall(g["kids"], lambda x: x["status"].isin(*RESOLVED)))
        if self.early:
            held = held.add(parent=self._parent).add(branches=lambda g: F.transform(g["kids"], branch)).add(cut=self._cut).where(lambda g: g["full"] | g["cut"].isNotNull())
        else:
            held = held.where(lambda g: g["full"]).add(parent=self._parent, branches=lambda g: F.transform(g["kids"], branch), cut=lambda g: F.lit(None).cast("bigint"))
        seen = lambda g: F.when(g["cut"].isNotNull(), self._view(g["branches"], g["cut"])).otherwise(g["branches"])
        # Only successful branches show their state to a merge.
        held = held.add(view=lambda g: F.transform(seen(g), lambda b: b.withField("state", F.when(b["status"] == "joined", b["state"]))))
        return rows.withColumn("due", held.column)

    @staticmethod
    def _parent(group: Column) -> Column:
        return _get(F.filter("inv", lambda x: x["child_group"] == group["num"]), 1)

    def _cut(self, g: Column) -> Column:
        """The commit after which the group merges; null while it has to wait."""
        after = lambda which: F.array_sort(F.transform(F.filter(g["branches"], which), lambda b: b["seq"]))
        cut = F.lit(None).cast("bigint")
        for name, join in self.graph.joins.items():
            if join.quorum:
                cut = F.when(g["join_node"] == name, _get(after(lambda b: b["status"] == "joined"), join.quorum)).otherwise(cut)
            elif join.can_merge is not None:
                cut = F.when(g["join_node"] == name, _get(F.filter(after(lambda b: b["status"].isin(*RESOLVED)), self._met(join, g)), 1)).otherwise(cut)
        return cut

    def _met(self, join: JoinSpec, g: Column) -> Callable[[Column], Column]:
        """Whether the join's predicate held after the commit ``last``."""

        def met(last: Column) -> Column:
            return join.can_merge(g["parent"]["state"], self._view(g["branches"], last))

        return met

    @staticmethod
    def _view(branches: Column, last: Column) -> Column:
        """Branches as they stood after the commit ``last``: later ones are pending."""
        return F.transform(branches, lambda b: F.when(b["status"].isin(*RESOLVED) & (b["seq"] > last), b.withField("status", F.lit("pending")).withField("state", F.when(F.lit(False), b["state"])).withField("error", F.lit(""))).otherwise(b))

    def merges(self) -> Column:
        """The outcomes of the groups that are due."""
        g = self.graph

        def outcome(x: Column) -> Column:
            call = self.call(F.struct(x["parent"]["num"].alias("num"), x["call"].alias("call")), node=x["join_node"])
            state = _case(x["join_node"], {n: j.merge(x["parent"]["state"], x["view"], call).cast(self.state) for n, j in g.joins.items()}, F.lit(None).cast(self.state))
            errors = {n: j.error(x["parent"]["state"], x["view"]).cast("string") for n, j in g.joins.items() if j.error is not None}
            for n, j in g.joins.items():
                if j.timeout_ns and j.elapsed is not None:
                    errors[n] = F.when(j.elapsed(x["parent"]["state"], x["view"]) > j.timeout_ns, F.lit(DEADLINE)).otherwise(errors.get(n, F.lit(None).cast("string")))
            error = _case(x["join_node"], errors, F.lit(None).cast("string"))
            following = F.coalesce(_lookup({k: t for k in g.joins if (t := g.next_of(k))}, x["join_node"]), F.lit(""))
            settled = self.out._make("settle", F.when(x["join_node"] != "", state).otherwise(x["parent"]["state"]))
            merged = F.when((x["join_node"] == "") | (following == ""), settled.cast(self.out.type)).otherwise(self.out.to(state, following).cast(self.out.type))
            if not errors:
                return merged
            return F.when(error.isNotNull(), self.out.fail(error).cast(self.out.type)).otherwise(merged)

        return F.transform("due", outcome)

    def ready(self, rows: Steps) -> Steps:
        """Columns ``ready``, the ready invocations that the step budget still
        admits, in their order, ``ready_outs``, what their nodes return, and
        ``late``, the invocations beyond the budget."""
        rows = rows.withColumn("all_ready", F.filter("inv", lambda x: x["status"] == "ready"))
        places = F.array_sort(F.transform("all_ready", lambda x, i: F.struct(x["seq"].alias("seq"), x["num"].alias("num"), i.alias("i"))))
        rows = rows.withColumn("all_ready", F.when(F.size("all_ready") > 1, F.transform(places, lambda k: F.get("all_ready", k["i"]))).otherwise(F.col("all_ready")))
        rows = rows.withColumn("n_ready", F.when(F.expr(GOING), F.least(F.col("left"), F.lit((1 << 31) - 1)).cast("int")).otherwise(0))
        g = self.graph

        def outcome(x: Column, i: Column) -> Column:
            call = self.call(x, node=x["node"], step=F.col("steps") + i + 1, branch_index=x["branch_index"])
            o = _case(x["node"], {n: s.run(self.out, x["state"], call).cast(self.out.type) for n, s in g.nodes.items() if s.run is not None}, F.lit(None).cast(self.out.type))
            spent = {n: s.elapsed(x["state"]).cast("bigint") for n, s in g.nodes.items() if s.elapsed is not None}
            if spent:
                zero = F.lit(0).cast("bigint")
                limit = F.when(x["entry_timeout_ns"] > 0, x["entry_timeout_ns"]).otherwise(_case(x["node"], {n: F.lit(s.timeout_ns).cast("bigint") for n, s in g.nodes.items() if s.timeout_ns}, zero))
                o = F.when((limit > 0) & (_case(x["node"], spent, zero) > limit), self.out.fail(DEADLINE).cast(self.out.type)).otherwise(o)
            return o

        beyond = F.slice("all_ready", F.col("n_ready") + 1, F.greatest(F.lit(0), F.size("all_ready") - F.col("n_ready")))
        rows = rows.withColumns({"ready": F.slice("all_ready", F.lit(1), F.col("n_ready")), "late": F.when(F.size("all_ready") > F.col("n_ready"), beyond).otherwise(_none("all_ready"))})
        rows = rows.drop("all_ready", "n_ready").withColumn("ready_outs", F.transform("ready", outcome))
        if any(s.python for s in g.nodes.values()):
            rows = evaluate_python(rows, g, self.out.type)
        return rows

    # --- outcomes to effects --------------------------------------------------

    def effects(self, kind: Callable[..., Column], specs: dict[str, dict]) -> Acts:
        """What each task would do, and why it may not (``illegal``). ``kind``
        gives a task's (kind, node, gone) from its place, ``specs`` the nodes or
        joins of a kind."""
        g = self.graph
        names = {f"{n}\x00{a}": b for (n, a), b in g.names.items()}
        joins = F.array(*[F.lit(j) for j in sorted(g.joins)]).cast("array<string>")
        is_join = lambda t: F.array_contains(joins, t) if g.joins else F.lit(False)
        local = lambda x, t: F.coalesce(_lookup(names, F.concat(x["node"], F.lit("\x00"), t)), F.lit("")) if names else F.lit("")
        back = lambda x: _lookup(g.returns, x["node"])
        own_join = {s: j for s in g.nodes if (j := g.join_of(s))}
        acts = Acts().add(ord=lambda x, i: i + 1, what=kind, action=lambda x: x["o"]["action"], group_num=lambda x: x["inv"]["group_num"], num=lambda x: x["inv"]["num"])
        scope = lambda x: _case(x["what"]["kind"], {k: self.scope(x["what"]["node"], v) for k, v in specs.items()}, F.lit("fail_invocation"))
        acts = acts.add(kind=lambda x: x["what"]["kind"], node=lambda x: x["what"]["node"], gone=lambda x: x["what"]["gone"], scope=scope, join_node=lambda x: F.when(x["what"]["kind"] != "merge", F.coalesce(_lookup(own_join, x["what"]["node"]), F.lit(""))).otherwise(F.lit("")))

        def targets(x: Task) -> Column:
            # Merges and resumed waits name targets of the flat graph already.
            flat = F.when((x["kind"] == "node") & x["action"].isin("to", "wait"), F.transform(x["o"]["targets"], lambda t: local(x, t)))
            return flat.when(x["action"] == "return", F.when(back(x) != "", F.array(back(x)))).otherwise(x["o"]["targets"]).cast("array<string>")

        acts = acts.add(targets=targets)
        own = lambda x: F.transform(x["o"]["branches"], lambda b: local(x, b["target"]))
        none = F.array().cast("array<string>")

        def kids(x: Task) -> Column:
            """Targets of the group that the task would open."""
            many = x["action"].isin("to", "return") & (F.coalesce(F.size(x["targets"]), F.lit(0)) > 1)
            return F.when(many, x["targets"]).when(x["action"] == "fan_out", F.coalesce(own(x), none))

        acts = acts.add(n=lambda x: F.greatest(F.lit(0), F.coalesce(F.size(x["targets"]), F.lit(0))), kids=kids, to_node=lambda x: _get(x["targets"], 1))
        group_join = lambda x: F.coalesce(x["inv"]["group_join"], F.lit(""))
        to_join = lambda x: (x["n"] == 1) & is_join(F.coalesce(x["to_node"], F.lit("")))

        def illegal(x: Task) -> Column:
            action = x["action"]
            return (
                F.when(x["o"].isNull() | action.isNull(), F.lit("transition is empty"))
                .when(action.isin("to", "wait") & (x["n"] == 0), F.lit("transition has no targets"))
                .when(action.isin("to", "wait") & (F.size(F.array_distinct(x["targets"])) < x["n"]), F.lit("targets repeat"))
                .when(action.isin("to", "wait") & F.array_contains(x["targets"], ""), F.lit("edge is not declared"))
                .when((action == "fan_out") & F.exists(x["kids"], lambda t: (t == "") | is_join(t)), F.lit("branch target is not a declared node"))
                .when((action == "fan_out") & F.exists(x["o"]["branches"], lambda b: b["entry_timeout_ns"] < 0), F.lit("entry timeout is negative"))
                .when(action.isin("to", "return") & to_join(x) & (x["to_node"] != group_join(x)), F.lit("join is not the group's own"))
                .when(action.isin("to", "return") & (x["n"] > 1) & F.exists(x["targets"], lambda t: is_join(t) & (t != x["join_node"])), F.lit("join is not the group's own"))
                .when((action == "complete_branch") & (group_join(x) == ""), F.lit("no joined group"))
                .when((action == "return") & back(x).isNull(), F.lit("not in a subgraph"))
                .when((action == "wait") & ~x["o"]["continuation"].isin(*(list(g.continuations) or [""])), F.lit("continuation is unknown"))
            )

        group = lambda x: x["kids"].isNotNull() & ~((x["action"] == "fan_out") & (F.size(x["kids"]) == 0) & (x["join_node"] == ""))
        acts = acts.add(illegal=illegal, is_group=lambda x: F.coalesce(group(x), F.lit(False)))

        def ids(x: Task) -> Column:
            calls = F.size(F.filter(x["kids"], lambda t: ~is_join(t))) if g.joins else F.size(x["kids"])
            numbers = F.when(x["is_group"], 1 + (x["join_node"] != "").cast("int") + F.size(x["kids"]) + calls)
            return F.coalesce(numbers.when(x["action"].isin("to", "return") & (x["n"] == 1) & ~to_join(x), F.lit(1)).when(x["action"] == "wait", F.lit(1)).otherwise(F.lit(0)), F.lit(0)).cast("bigint")

        def status(x: Task) -> Column:
            return (
                F.when(x["is_group"], F.lit("group"))
                .when(x["action"].isin("fan_out", "end_branch", "settle"), F.lit("ended"))
                .when(x["action"] == "complete_branch", F.lit("joined"))
                .when((x["action"] == "return") & (back(x) == ""), F.lit("ended"))
                .when(x["action"].isin("to", "return") & to_join(x), F.lit("joined"))
                .when(x["action"].isin("to", "return"), F.lit("ready"))
                .when(x["action"] == "wait", F.lit("waiting"))
                .when(x["action"] == "fail", F.lit("failed"))
            )

        scope = lambda x: F.when(x["action"] == "fail", F.when((x["scope"] == "fail_group") & (x["group_num"] == 0), F.lit("fail_execution")).otherwise(x["scope"]))
        return acts.add(ids=ids, status=status, scope=scope)

    def admitted(self, rows: Steps, acts: Acts) -> Steps:
        """Column ``acts`` with what is accepted of the tasks and ids begun."""
        rows = rows.withColumn("acts", acts.column)
        if self.removes:
            both = lambda x: F.array_compact(F.array(F.when(x["gone"] > 0, F.struct(x["gone"].alias("grp"), x["ord"].alias("at"))), F.when(x["scope"] == "fail_group", F.struct(x["group_num"].alias("grp"), x["ord"].alias("at")))))
            rows = rows.withColumn("hits", F.array_sort(F.flatten(F.transform("acts", both))))
            # The first of each group is enough, however many of its tasks fail.
            rows = rows.withColumn("hits", F.when(F.size("hits") > 1, F.filter("hits", lambda h, i: (i == 0) | (F.get("hits", i - 1)["grp"] < h["grp"]))).otherwise(F.col("hits")))
            killed = lambda x: (F.size("hits") > 0) & F.exists("hits", lambda h: (h["at"] < x["ord"]) & F.array_contains(x["inv"]["path"], h["grp"]))
            rows = rows.withColumn("acts", Acts(F.col("acts")).add(killed=killed).column)
        else:
            rows = rows.withColumn("acts", F.transform("acts", lambda x: x.withField("killed", F.lit(False))))
        rows = rows.withColumn("ids", F.transform("acts", lambda x: F.when(x["killed"], F.lit(0).cast("bigint")).otherwise(x["ids"])))
        rows = rows.withColumn("before", prefix_sums(F.col("ids")))
        limit = self.options.max_invocations
        if limit:
            under = lambda x: F.when(x["killed"] | (x["gone"] == 0), F.lit(0)).otherwise(F.size(F.filter("inv", lambda v: F.array_contains(v["path"], x["gone"]))))
            born = lambda x: F.when(x["is_group"] & ~x["killed"], F.size(x["kids"])).otherwise(F.lit(0))
            rows = rows.withColumn("change", F.transform("acts", lambda x: (born(x) - under(x)).cast("bigint")))
            rows = rows.withColumn("grown", prefix_sums(F.col("change")))
        sums = ("before", "grown") if limit else ("before",)

        def verdict(x: Column, before: Column) -> Column:
            over = x["is_group"] & (F.size("inv") + before["grown"] + F.size(x["kids"]) > limit) if limit else F.lit(False)
            most = self.options.counter_limit
            spent = (x["ids"] > F.lit(most) - F.col("next_id") - before["before"]) | (F.col("revision") > F.lit(most) - x["ord"])
            why = F.when(x["illegal"].isNotNull(), F.lit("illegal")).when(spent, F.lit("execution_limit")).when(over, F.lit("max_invocations")).when(x["action"] == "interrupt", F.lit("interrupted")).when(x["action"] == "end_execution", F.lit("end_execution")).when(x["scope"] == "fail_execution", F.lit("fail_execution"))
            return x.withField("first_id", F.col("next_id") + before["before"]).withField("halt", F.when(~x["killed"], why))

        rows = rows.withColumn("acts", F.zip_with("acts", F.arrays_zip(*sums), verdict))
        rows = rows.withColumn("halt_at", F.array_min(F.transform(F.filter("acts", lambda x: x["halt"].isNotNull()), lambda x: x["ord"]))).drop("before", "grown", "ids", "hits", "change")
        at = F.col("halt_at")
        ok = lambda x: F.coalesce(~x["killed"] & (at.isNull() | (x["ord"] < at) | ((x["ord"] == at) & x["halt"].isin("end_execution", "fail_execution"))), F.lit(False))
        return rows.withColumn("acts", F.transform("acts", lambda x: x.withField("accepted", ok(x))))

    # --- the next position ----------------------------------------------------

    def commit(self, rows: Steps) -> Steps:
        """The next row of each run from its tasks, ``others`` (invocations that
        no task works on) and header."""
        seq = F.col("superstep") * SUPERSTEP
        zero = F.lit(0).cast("bigint")
        types, gtypes = fields_of(invocations_ddl(self.state)), fields_of(GROUPS_DDL)
        rows = rows.withColumn("done", F.filter("acts", lambda x: x["accepted"]))

        def changed(z: Column) -> Column:
            """The task's own invocation."""
            x, v, o = z["acts"], z["own"], z["outs"]
            status = x["status"]
            ready, wait, group = status == "ready", status == "waiting", status == "group"
            node = F.when(ready, x["to_node"]).when((status == "joined") & (x["action"] != "complete_branch"), x["to_node"]).when(status == "joined", v["group_join"])
            keeps = o["state"].isNotNull() & ~x["action"].isin("end_branch", "fail")
            new = {
                "call": F.when(ready | wait, x["first_id"]), "node": F.coalesce(node, v["node"]), "state": F.when(keeps, o["state"]).otherwise(v["state"]), "status": status, "child_group": F.when(group, x["first_id"]).otherwise(zero),
                "error": F.when(status == "failed", F.coalesce(o["error"], v["error"])).otherwise(v["error"]), "entry_timeout_ns": F.when((status != "failed") & (x["kind"] == "node"), zero).otherwise(v["entry_timeout_ns"]),
                "continuation": F.when(wait, o["continuation"]), "next": F.when(wait, x["targets"]), "seq": seq + x["ord"],
            }
            # One that ends the run has no status and stays as it is.
            body = reduce(lambda y, kv: y.withField(kv[0], kv[1].cast(types[kv[0]])), new.items(), v)
            return F.when(x["accepted"] & status.isNotNull(), body).otherwise(v)

        joins = F.array(*[F.lit(j) for j in sorted(self.graph.joins)]).cast("array<string>")
        is_join = lambda t: F.array_contains(joins, t) if self.graph.joins else F.lit(False)

        def born(z: Column) -> Column:
            """Children, numbered in branch order after the group (and its merge's call)."""
            x, o = z["acts"], z["outs"]

            def one(t: Column, k: Column) -> Column:
                # A fan-out has no join among its targets; other groups are as small as the graph.
                skipped = F.when(x["action"] != "fan_out", F.size(F.filter(F.slice(x["kids"], F.lit(1), k), is_join))).otherwise(F.lit(0)) if self.graph.joins else F.lit(0)
                number = x["first_id"] + 1 + (x["join_node"] != "").cast("int") + 2 * k - skipped
                branch = F.get(o["branches"], k)
                new = {
                    "num": number, "call": F.when(~is_join(t), number + 1), "node": t, "state": F.when(x["action"] == "fan_out", branch["state"]).otherwise(o["state"]), "status": F.when(is_join(t), F.lit("joined")).otherwise(F.lit("ready")),
                    "group_num": x["first_id"], "group_join": x["join_node"], "child_group": zero, "branch_index": k, "target": t, "entry_timeout_ns": F.when(x["action"] == "fan_out", F.coalesce(branch["entry_timeout_ns"], zero)).otherwise(zero),
                    "path": F.array_append(z["own"]["path"], x["first_id"]), "seq": seq + x["ord"],
                }
                return F.struct(*[new.get(f, F.lit(None)).cast(types[f]).alias(f) for f in INVOCATION])

            return F.transform(x["kids"], one)

        zipped = F.arrays_zip("own", "outs", "acts")
        groups = F.filter(zipped, lambda z: z["acts"]["accepted"] & z["acts"]["is_group"])
        opens = lambda x: x["is_group"]
        fresh = {"num": lambda x: x["first_id"], "call": lambda x: F.when(x["join_node"] != "", x["first_id"] + 1), "source": lambda x: x["node"], "parent": lambda x: x["num"], "join_node": lambda x: x["join_node"]}
        group = lambda z: F.struct(*[(fresh[f](z["acts"]) if f in fresh else z["own"]["path"]).cast(gtypes[f]).alias(f) for f in GROUP])
        removed = lambda x: F.array_compact(F.array(F.when(x["gone"] > 0, x["gone"]), F.when(x["scope"] == "fail_group", x["group_num"])))
        ends = _get(F.filter(zipped, lambda z: z["acts"]["accepted"] & z["acts"]["halt"].isNotNull()), 1)
        why = _get(F.filter(zipped, lambda z: ~z["acts"]["accepted"] & z["acts"]["halt"].isNotNull() & (z["acts"]["ord"] == F.col("halt_at"))), 1)
        brief = lambda z: F.when(z.isNotNull(), F.struct(z["acts"]["halt"].alias("halt"), z["acts"]["node"].alias("node"), z["acts"]["num"].alias("num"), F.coalesce(z["acts"]["illegal"], z["outs"]["error"]).alias("error"), z["outs"]["state"].alias("state")))
        rows = rows.withColumns({
            "kids": F.when(F.exists("done", opens), F.flatten(F.transform(groups, born))).otherwise(_none("others")),
            "grp": F.when(F.exists("done", opens), F.concat("grp", F.transform(groups, group))).otherwise(F.col("grp")),
            "inv": F.concat(F.transform(zipped, changed), F.col("others")), "gone": F.array_distinct(F.flatten(F.transform("done", removed))),
            "end": F.when(F.col("halt_at").isNotNull(), brief(ends)), "why": F.when(F.col("halt_at").isNotNull(), brief(why)), "n_done": F.size("done"), "n_nodes": F.size(F.filter("done", lambda x: x["kind"] == "node")),
            "n_ids": F.aggregate("done", zero, lambda a, x: a + x["ids"]), "cursor": _get(F.filter("done", lambda x: x["kind"] == "node"), -1)["num"], "n_tasks": F.size("acts"),
            "failed_here": F.coalesce(F.exists("done", lambda x: (x["status"] == "failed") & (F.coalesce(x["scope"], F.lit("")) != "fail_execution") & x["status"].isNotNull()), F.lit(False)),
        })
        if self.fails_groups:
            lost = lambda z: F.struct(z["acts"]["group_num"].alias("grp"), z["outs"]["error"].alias("error"), (seq + z["acts"]["ord"]).alias("seq"))
            rows = rows.withColumn("lost", F.transform(F.filter(zipped, lambda z: z["acts"]["accepted"] & (z["acts"]["scope"] == "fail_group")), lost))

            def failed(x: Column) -> Column:
                hit = _get(F.filter("lost", lambda y: y["grp"] == x["child_group"]), 1)
                new = {"status": F.lit("failed"), "error": F.coalesce(hit["error"], x["error"]), "child_group": zero, "seq": hit["seq"]}
                return F.when((x["child_group"] > 0) & hit.isNotNull(), reduce(lambda y, kv: y.withField(*kv), new.items(), x)).otherwise(x)

            rows = rows.withColumn("inv", F.when(F.size("lost") > 0, F.transform("inv", failed)).otherwise(F.col("inv"))).drop("lost")
        rows = rows.drop("own", "outs", "acts", "done", "others")
        stays = lambda path: ~F.arrays_overlap(path, F.col("gone"))
        every = F.concat("inv", "kids")
        rows = rows.withColumns({"inv": F.when(F.size("gone") > 0, F.filter(every, lambda x: stays(x["path"]))).otherwise(every), "grp": F.when(F.size("gone") > 0, F.filter("grp", lambda x: stays(F.array_append(x["path"], x["num"])))).otherwise(F.col("grp"))})
        active = F.exists("inv", lambda x: x["status"].isin("ready", "waiting", "group"))
        rows = rows.withColumn("over", F.when(F.expr(GOING), F.col("end").isNotNull() | ~active).otherwise(F.col("completed")))
        failure = F.when(F.col("end.halt") == "fail_execution", F.struct(F.concat(F.lit("i"), F.col("end.num")).alias("invocation_id"), F.col("end.node").alias("node"), F.col("end.error").alias("message"), F.lit("").alias("panic_stack")).cast(FAILURE))
        keeps = lambda c, kept: F.when(F.col("over"), _none(c)).otherwise(kept)
        return rows.select(
            "run_id", "definition_id", "format_version", (F.col("revision") + F.col("n_done")).alias("revision"), (F.col("steps") + F.col("n_nodes")).alias("steps"), (F.col("next_id") + F.col("n_ids")).alias("next_id"),
            F.coalesce("cursor", "schedule_cursor").alias("schedule_cursor"), F.col("over").alias("completed"), (F.col("had_local_failures") | F.col("failed_here")).alias("had_local_failures"), F.coalesce(failure, "failure").alias("failure"),
            F.coalesce(F.when(F.col("end.halt") == "end_execution", F.col("end.state")), F.col("final")).alias("final"), keeps("inv", F.when(F.size("inv") > 1, by_number(F.col("inv"))).otherwise(F.col("inv"))).alias("inv"), keeps("grp", F.col("grp")).alias("grp"),
            (F.col("left") - F.col("n_nodes")).alias("left"), (F.col("superstep") + 1).alias("superstep"), F.coalesce("stop", "why.halt").alias("stop"), F.coalesce("message", "why.error").alias("message"), (F.col("idle") | (F.col("n_tasks") == 0)).alias("idle"), F.col("n_nodes").alias("ran"), (F.col("n_done") - F.col("n_nodes")).alias("merged"), F.col("revision").alias("expected"),
        )

    @cached_property
    def _gather(self) -> Steps:
        return self._tasks(Steps())

    @cached_property
    def _step(self) -> Steps:
        return self.commit(self._tasks(Steps()))

    @cached_property
    def _applied(self) -> Steps:
        return self.commit(self._given(Steps()))

    def step(self, rows: DataFrame) -> DataFrame:
        """One superstep of runs that are going; the others pass as they are."""
        return self._step.on(rows)

    def tasks(self, rows: DataFrame) -> DataFrame:
        """Rows with a superstep's tasks, in order and judged (``own``, ``outs``
        and ``acts``), and ``others``, the invocations that none works on."""
        return self._gather.on(rows)

    def apply(self, rows: DataFrame) -> DataFrame:
        """A superstep whose tasks are ``given`` (an array of tasks). Runs without
        one are not idle for that: their nodes may be ready."""
        return self._applied.on(rows).withColumn("idle", F.lit(False))

    def _tasks(self, rows: Steps) -> Steps:
        rows = self.ready(self.due(rows))
        idle = lambda x: (x["status"] != "ready") & ((x["child_group"] == 0) | (F.size("merging") == 0) | ~F.array_contains("merging", x["child_group"]))
        rows = rows.withColumns({"merging": F.transform("due", lambda g: g["num"]), "own": F.concat(F.transform("due", lambda g: g["parent"]), F.col("ready")), "outs": F.concat(self.merges(), F.col("ready_outs"))})
        rows = rows.withColumn("others", F.concat("late", F.filter("inv", idle))).drop("merging", "late", "ready", "ready_outs")

        def kind(x: Task, i: Column) -> Column:
            group = F.get("due", i)
            merge = F.struct(F.lit("merge").alias("kind"), group["join_node"].alias("node"), group["num"].alias("gone"))
            return F.when(i < F.size("due"), merge).otherwise(F.struct(F.lit("node").alias("kind"), x["inv"]["node"].alias("node"), F.lit(0).cast("bigint").alias("gone")))

        return self.admitted(rows, self.effects(kind, {"merge": self.graph.joins, "node": self.graph.nodes})).drop("due")

    def _given(self, rows: Steps) -> Steps:
        rows = rows.withColumn("begun", F.when(F.expr(GOING), F.col("given")).otherwise(_none("given")))
        rows = rows.withColumns({"own": F.transform("begun", lambda x: x["inv"]), "outs": F.transform("begun", lambda x: x["o"]), "touched": F.transform("begun", lambda x: x["inv"]["num"])})
        rows = rows.withColumn("others", F.filter("inv", lambda x: (F.size("touched") == 0) | ~F.array_contains("touched", x["num"]))).drop("given", "touched", "begun")
        kind = lambda x: F.struct(F.lit("apply").alias("kind"), x["inv"]["node"].alias("node"), F.lit(0).cast("bigint").alias("gone"))
        return self.admitted(rows, self.effects(kind, {"apply": self.graph.nodes}))

    def drive(self, rows: DataFrame, commit: Callable[[DataFrame], None] | None = None, seen: Callable[[dict], None] | None = None, limiter: Limiter | None = None, cancel: Cancellation | None = None) -> DataFrame:
        """Supersteps until no run has a task left; gives every run's row.

        ``commit`` gets the rows after each superstep, with the revision that each
        was ``expected`` at, ``seen`` how many nodes and merges it committed.
        """
        kept: list[DataFrame] = []
        while True:
            before = rows
            try:
                if cancel:
                    raise InterruptedError
                with limiter.take(rows.rdd.getNumPartitions()) if limiter else nullcontext() as permits, cancel.tagged() if cancel is not None else nullcontext():
                    slots = min(filter(None, (permits, self.options.max_concurrency)), default=0)
                    watch = Observation()
                    sums = [F.sum(c).alias(c) for c in ("ran", "merged")] if seen else []
                    rows = written(self.step(rows.coalesce(slots) if slots else rows).observe(watch, F.count_if(F.expr(GOING)).alias("going"), *sums), "superstep")
            except Exception:
                if not cancel:
                    raise
                stopped = before.withColumn("stop", F.when(F.expr(GOING), F.lit("canceled")).otherwise(F.col("stop")))
                return reduce(DataFrame.unionByName, [*kept, stopped])
            found = watch.get
            if commit:
                commit(rows)
            if seen:
                seen(found)
            if not found.get("going"):
                return reduce(DataFrame.unionByName, [*kept, rows])
            kept.append(rows.where(f"not ({GOING})"))
            rows = rows.where(GOING)
            if len(kept) >= TABLES:
                kept = [written(reduce(DataFrame.unionByName, kept), "finished")]
