"""Run populations made from the tables, and graphs over them.

An order is a run and its line items are branches; a region is a run with two
levels of groups; a user is a run that waits once for each purchase. What a
population's call left is written once for each session and folder and shared
by the queries that look at it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.runner import Result, Runner
from ..operators.schema import Position
from ..operators.superstep import Options
from ..plans import Graph, JoinSpec, NodeSpec
from ..sources.tables import written

_shared: dict[tuple, object] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]) -> object:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


def forget() -> None:
    """Drop what earlier queries left, as for timing."""
    _shared.clear()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- orders ------------------------------------------------------------------

KID = "struct<q:bigint,f:string>"
ORDER = f"struct<key:bigint,kind:string,q:bigint,f:string,n:bigint,ok:bigint,failed:bigint,ended:bigint,pending:bigint,trace:string,kids:array<{KID}>>"

#: Branches of an order in the SQL of the queries.
BRANCHES = """b AS (
  SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) - 1 AS i,
         CAST(l_quantity AS BIGINT) AS q, l_returnflag AS f
  FROM lineitem)"""


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k, i, q, f``: line items as branches of their order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_returnflag")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return rows.select(F.col("l_orderkey").alias("k"), (F.row_number().over(order) - 1).alias("i"), F.col("l_quantity").cast("bigint").alias("q"), F.col("l_returnflag").alias("f"))


def order_state(**fields: Column) -> Column:
    names = {"key": "bigint", "kind": "string", "q": "bigint", "f": "string", "n": "bigint", "ok": "bigint", "failed": "bigint", "ended": "bigint", "pending": "bigint", "trace": "string", "kids": f"array<{KID}>"}
    return F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()])


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id, state`` of each order, its line items in order inside."""

    def make() -> DataFrame:
        line = F.struct("l_linenumber", F.col("l_quantity").cast("bigint").alias("q"), F.col("l_returnflag").alias("f"))
        lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
        orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left")
        kids = F.transform(F.coalesce("lines", F.array().cast("array<struct<l_linenumber:int,q:bigint,f:string>>")), lambda x: F.struct(x["q"].alias("q"), x["f"].alias("f")))
        state = order_state(key=F.col("o_orderkey"), kind=F.col("o_orderstatus"), kids=kids)
        return written(orders.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("run_id"), state.alias("state")), "orders")

    return shared(spark, sf_dir, "orders", make)


def kids_of(out, state: Column, target) -> Column:
    return F.transform(state["kids"], lambda x: out.to_branch(target(x) if callable(target) else target, order_state(q=x["q"], f=x["f"])))


def line_run(out, s: Column, call: Column) -> Column:
    """R fails, A ends, N delivers."""
    return F.when(s["f"] == "R", out.fail("returned")).when(s["f"] == "A", out.end_branch()).otherwise(out.complete_branch(s))


def tally(parent: Column, b: Column, call: Column) -> Column:
    """Counts, the sum of what succeeded, and the ordered trace of a group."""
    count = lambda status: F.size(F.filter(b, lambda x: x["status"] == status))
    total = F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["state"]["q"], F.lit(0)))
    trace = F.array_join(F.transform(b, lambda x: F.concat(x["index"], F.lit(":"), F.upper(F.substring(x["status"], 1, 1)))), ",")
    return order_state(key=parent["key"], kind=parent["kind"], q=total, n=F.size(b), ok=count("joined"), failed=count("failed"), ended=count("ended"), pending=F.size(b) - count("joined") - count("failed") - count("ended"), trace=trace)


def order_graph(join: JoinSpec | None, line=line_run, done: str = "end", scopes: dict[str, str] | None = None, join_edge: bool = True) -> Graph:
    """open -> lines -> bill -> done. ``scopes`` maps an order's status to the
    failure scope of its lines."""
    nodes = {v: f"line_{v}" for v in scopes.values()} if scopes else {None: "line"}

    def begin(out, s, call):
        if not scopes:
            return out.fan_out(s, kids_of(out, s, "line"))
        name = F.lit("line_fail_invocation")
        for status, scope in scopes.items():
            name = F.when(s["kind"] == status, F.lit(f"line_{scope}")).otherwise(name)
        return out.fan_out(s, kids_of(out, s, lambda x: name))

    g = Graph("open").add_node(NodeSpec("open", begin))
    for scope, name in nodes.items():
        g.add_node(NodeSpec(name, line, on_error=scope or "fail_invocation")).add_edge("open", name)
    if join is not None:
        g.add_join(join)
        if join_edge:
            last = (lambda o, s, c: o.end_execution(s)) if done == "end" else (lambda o, s, c: o.wait(s, "more", "done"))
            g.add_node(NodeSpec("done", last)).add_edge("bill", "done")
            if done != "end":
                g.add_edge("done", "done").register_continuation("more", lambda p: p, lambda o, s, p, c, t: o.to_targets(s, t))
    return g


def ran(spark: SparkSession, sf_dir: str, name: str, graph: Graph, state: str, runs: Callable[[], DataFrame], options: Options | None = None) -> tuple[Runner, Result]:
    def make() -> tuple[Runner, Result]:
        runner = Runner(graph.compile(f"{name}-v1"), state)
        return runner, runner.start(runs(), options)

    return shared(spark, sf_dir, name, make)


BILL = JoinSpec("bill", "open", tally)


def billed(spark: SparkSession, sf_dir: str) -> tuple[Runner, Result]:
    return ran(spark, sf_dir, "billed", order_graph(BILL), ORDER, lambda: order_runs(spark, sf_dir))


def held(spark: SparkSession, sf_dir: str) -> tuple[Runner, Result]:
    """Orders with one more branch that waits, so every branch can be seen."""

    def begin(out, s, call):
        more = F.array(out.to_branch("hold", order_state(q=F.lit(0), f=F.lit("H"))))
        return out.fan_out(s, F.concat(kids_of(out, s, "line"), more))

    def line(out, s, call):
        return F.when(s["f"] == "R", out.fail("returned")).when(s["f"] == "A", out.end_branch()).when(s["q"] % 2 == 0, out.to(s, "bill")).otherwise(out.complete_branch(s))

    g = Graph("open").add_node(NodeSpec("open", begin)).add_node(NodeSpec("line", line)).add_node(NodeSpec("hold", lambda o, s, c: o.wait(s, "go", "line")))
    g.add_join(BILL).add_edge("open", "line").add_edge("open", "hold").add_edge("line", "bill").add_edge("hold", "line")
    g.register_continuation("go", lambda p: p, lambda o, s, p, c, t: o.to_targets(s, t))
    return ran(spark, sf_dir, "held", g, ORDER, lambda: order_runs(spark, sf_dir))


#: What a failing line does, by the order's status.
SCOPED = {"O": "fail_invocation", "F": "fail_group", "P": "fail_execution"}


def scoped(spark: SparkSession, sf_dir: str, override: str | None = None) -> Result:
    return ran(spark, sf_dir, f"scoped-{override}", order_graph(BILL, scopes=SCOPED), ORDER, lambda: order_runs(spark, sf_dir), Options(failure_override=override))[1]


def budgeted(spark: SparkSession, sf_dir: str) -> tuple[Runner, Result]:
    return ran(spark, sf_dir, "budgeted", order_graph(BILL), ORDER, lambda: order_runs(spark, sf_dir), Options(max_steps=3))


# --- regions -----------------------------------------------------------------

REGION = "struct<name:string,level:int,n:bigint,cents:bigint,failed:bigint,nations:array<struct<name:string,customers:array<bigint>>>,customers:array<bigint>>"


def region_state(**f: Column) -> Column:
    names = {"name": "string", "level": "int", "n": "bigint", "cents": "bigint", "failed": "bigint", "nations": "array<struct<name:string,customers:array<bigint>>>", "customers": "array<bigint>"}
    return F.struct(*[f.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()])


def region_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    customers = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", cents.alias("c")))), lambda x: x["c"]).alias("customers"))
    nations = read(spark, sf_dir, "nation").join(customers, "n_nationkey").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("name"), "customers"))), lambda x: F.struct(x["name"].alias("name"), x["customers"].alias("customers"))).alias("nations"))
    rows = read(spark, sf_dir, "region").join(nations, "r_regionkey")
    return rows.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("run_id"), region_state(name=F.col("r_name"), level=F.lit(0), nations=F.col("nations")).alias("state"))


#: A region's run has as many steps as customers, whatever the size of the tables.
REGION_STEPS = Options(max_steps=1 << 62)


def region_graph(limit_cents: int | None) -> Graph:
    """region -> nations -> customers; a customer below the limit fails its nation's group."""

    def region(o, s, c):
        return o.fan_out(s, F.transform(s["nations"], lambda x: o.to_branch("nation", region_state(name=x["name"], level=F.lit(1), customers=x["customers"]))))

    def nation(o, s, c):
        return o.fan_out(s, F.transform(s["customers"], lambda x: o.to_branch("customer", region_state(level=F.lit(2), cents=x))))

    def customer(o, s, c):
        good = o.complete_branch(s)
        return good if limit_cents is None else F.when(s["cents"] < limit_cents, o.fail("in debt")).otherwise(good)

    def add(parent, b, c):
        ok = F.filter(b, lambda x: x["status"] == "joined")
        total = F.aggregate(ok, F.lit(0).cast("bigint"), lambda a, x: a + x["state"]["cents"])
        n = F.aggregate(ok, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["state"]["n"], F.lit(1)))
        return region_state(name=parent["name"], level=parent["level"], n=n, cents=total, failed=F.size(F.filter(b, lambda x: x["status"] == "failed")))

    g = Graph("region").add_node(NodeSpec("region", region)).add_node(NodeSpec("nation", nation)).add_node(NodeSpec("customer", customer, on_error="fail_group"))
    g.add_node(NodeSpec("done", lambda o, s, c: o.end_execution(s)))
    g.add_join(JoinSpec("all_nations", "region", add)).add_join(JoinSpec("all_customers", "nation", add))
    return g.add_edge("region", "nation").add_edge("nation", "customer").add_edge("all_customers", "all_nations").add_edge("all_nations", "done")


__all__ = ["BILL", "BRANCHES", "ORDER", "Position", "Window"]
