"""Subgraphs, the example workflows, the ledger and observation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import branch_values
from ..operators.observe import outcomes
from ..operators.runner import Runner
from ..operators.superstep import Engine, Options
from ..plans import Graph, JoinSpec, NodeSpec
from ..sources.tables import written
from ..streaming.inputs import receipts
from .populations import BILL, ORDER, held, line_run, order_graph, order_runs, ran, read, shared

Spark, Dir = SparkSession, str

VALUE = "struct<v:bigint>"


def value(x: Column) -> Column:
    return F.struct(x.cast("bigint").alias("v"))


# --- subgraphs ---------------------------------------------------------------


def _mounted() -> Graph:
    """+1, +2 and +3 through two mounts."""
    add = lambda n: lambda o, s, c: o.return_(value(s["v"] + n))
    inner = Graph("three").add_node(NodeSpec("three", add(3)))
    middle = Graph("two").add_node(NodeSpec("two", lambda o, s, c: o.to(value(s["v"] + 2), "inner"))).add_subgraph("inner", inner).add_node(NodeSpec("leave", lambda o, s, c: o.return_(s)))
    middle.add_edge("two", "inner").add_edge("inner", "leave")
    g = Graph("one").add_node(NodeSpec("one", lambda o, s, c: o.to(value(s["v"] + 1), "middle"))).add_subgraph("middle", middle).add_node(NodeSpec("end", lambda o, s, c: o.end_execution(s)))
    return g.add_edge("one", "middle").add_edge("middle", "end")


def subgraph_flatten(spark: Spark, d: Dir) -> DataFrame:
    g = _mounted().compile("mounts-v1")
    return spark.createDataFrame([(n, n == g.entry) for n in g.nodes], "node string, is_entry boolean")


def edge_list(spark: Spark, d: Dir) -> DataFrame:
    return _mounted().compile("mounts-v1").edge_rows(spark)


def subgraph_scope(spark: Spark, d: Dir) -> DataFrame:
    return _mounted().compile("mounts-v1").scope_rows(spark)


def subgraph_return(spark: Spark, d: Dir) -> DataFrame:
    """Each order's key, plus one, two and three on its way through."""
    runs = lambda: read(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("run_id"), value(F.col("o_orderkey")).alias("state"))
    calls = ran(spark, d, "mounts", _mounted(), VALUE, runs)[1].calls
    return calls.select("run_id", "status", F.col("final.v").alias("v"), "steps", "revision")


# --- examples ----------------------------------------------------------------


def durable_workflow(spark: Spark, d: Dir) -> DataFrame:
    """Start, wait for a number, add it: one run for each purchase."""

    def make() -> DataFrame:
        g = Graph("begin").add_node(NodeSpec("begin", lambda o, s, c: o.wait(s, "add", "finish"))).add_node(NodeSpec("finish", lambda o, s, c: o.end_execution(s))).add_edge("begin", "finish")
        g.register_continuation("add", lambda p: F.try_to_number(p.cast("string"), F.lit("999999")).cast("bigint"), lambda o, s, p, c, t: o.to_targets(value(s["v"] + p), t))
        runner = Runner(g.compile("durable-v1"), VALUE)
        rows = read(spark, d, "events").where("event_type = 'purchase'")
        r = runner.start(rows.select(F.concat(F.lit("e"), F.col("event_id")).alias("run_id"), value(F.col("event_id")).alias("state")))
        number = F.get_json_object("props", "$.k")
        # An odd event's answer is no number: it keeps waiting.
        payload = F.when(F.col("event_id") % 2 == 0, number).otherwise(F.concat(F.lit("x"), number)).cast("binary")
        answers = rows.select(F.concat(F.lit("e"), F.col("event_id")).alias("run_id"), F.lit(0).alias("ordinal"), F.lit("i1").alias("invocation_id"), F.lit("c3").alias("call_id"), payload.alias("payload"))
        return runner.advance(r.position, answers).calls

    return shared(spark, d, "durable", make).select("run_id", "status", F.col("final.v").alias("v"), "steps", "revision")


DURABLE = """SELECT 'e' || event_id AS run_id, CASE WHEN event_id % 2 = 0 THEN 'completed' ELSE 'waiting' END AS status, CASE WHEN event_id % 2 = 0 THEN event_id + CAST(json_extract(props, '$.k') AS BIGINT) END AS v,
CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS steps, CAST(CASE WHEN event_id % 2 = 0 THEN 4 ELSE 2 END AS BIGINT) AS revision FROM events WHERE event_type = 'purchase'"""


def effect_receipts(spark: Spark, d: Dir) -> DataFrame:
    """Each event's cents as an effect, sent twice; a tenth of the replays have
    another delta."""
    rows = read(spark, d, "events").select("event_id", "user_id", F.round(F.col("value") * 100).cast("bigint").alias("delta"))
    once = rows.select(F.lit("counter").alias("namespace"), F.concat(F.lit("u"), F.col("user_id")).alias("run_id"), F.concat(F.lit("c"), F.col("event_id")).alias("call_id"), "delta", (F.col("event_id") * 2).alias("seq"), F.col("user_id").alias("u"))
    again = once.withColumn("delta", F.col("delta") + (F.col("seq") % 20 == 0).cast("int")).withColumn("seq", F.col("seq") + 1_000_000_001)
    every = once.unionByName(again).withColumn("namespace", F.concat(F.lit("n"), F.col("u") % 16))
    return receipts(every.drop("u")).select("namespace", "run_id", "call_id", "seq", "delta", "value", "conflict", "replayed")


RECEIPTS = """WITH o AS (SELECT 'n' || (user_id % 16) AS namespace, 'u' || user_id AS run_id, 'c' || event_id AS call_id, CAST(round(value * 100) AS BIGINT) AS delta, event_id * 2 AS seq FROM events),
v AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY namespace ORDER BY seq) AS BIGINT) AS value FROM o)
SELECT namespace, run_id, call_id, seq, delta, value, false AS conflict, false AS replayed FROM v
UNION ALL SELECT namespace, run_id, call_id, seq + 1000000001, delta + CASE WHEN seq % 20 = 0 THEN 1 ELSE 0 END, CASE WHEN seq % 20 = 0 THEN NULL ELSE value END, seq % 20 = 0, true FROM v"""

TEAM = "struct<goal:string,tasks:bigint,task:string,depth:bigint,limit:bigint,results:array<string>,failures:array<string>,approved:boolean>"


def team_state(**f) -> Column:
    names = {"goal": "string", "tasks": "bigint", "task": "string", "depth": "bigint", "limit": "bigint", "results": "array<string>", "failures": "array<string>", "approved": "boolean"}
    return F.struct(*[f.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()])


def _team() -> Graph:
    """A lead hands out tasks to searchers and planners; planners hand out tasks
    of their own down to a limit; a tolerant merge; then an approval."""

    def assign(o, s, c):
        def one(k: Column) -> Column:
            name = F.concat(F.coalesce(F.concat(s["task"], F.lit(".")), F.lit("")), k.cast("string"))
            plans = (k % 2 == 1) & (s["depth"] + 1 < s["limit"])
            return o.to_branch(F.when(plans, F.lit("planner")).otherwise(F.lit("search")), team_state(goal=s["goal"], tasks=F.lit(2), task=name, depth=s["depth"] + 1, limit=s["limit"]))

        return o.fan_out(s, F.when(s["tasks"] > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), s["tasks"] - 1), one)).otherwise(F.array().cast(f"array<{o.branch}>")))

    def search(o, s, c):
        found = team_state(goal=s["goal"], task=s["task"], depth=s["depth"], results=F.array(F.concat(F.lit("found "), s["task"])), failures=F.array().cast("array<string>"))
        return F.when(s["task"].endswith("2"), o.fail("no result")).otherwise(o.complete_branch(found))

    def collect(parent, b, c):
        results = F.flatten(F.transform(branch_values(b), lambda s: s["results"]))
        below = F.flatten(F.transform(branch_values(b), lambda s: s["failures"]))
        own = F.transform(F.filter(b, lambda x: x["status"] == "failed"), lambda x: F.concat(x["index"].cast("string"), F.lit(": "), x["error"]))
        return team_state(goal=parent["goal"], tasks=parent["tasks"], task=parent["task"], depth=parent["depth"], limit=parent["limit"], results=results, failures=F.concat(own, below))

    g = Graph("lead").add_node(NodeSpec("lead", assign)).add_node(NodeSpec("planner", assign)).add_node(NodeSpec("search", search))
    g.add_join(JoinSpec("lead_results", "lead", collect)).add_join(JoinSpec("planner_results", "planner", collect))
    g.add_node(NodeSpec("review", lambda o, s, c: o.wait(s, "approve", "publish"))).add_node(NodeSpec("publish", lambda o, s, c: o.end_execution(s)))
    for s, t in (("lead", "search"), ("lead", "planner"), ("planner", "search"), ("planner", "planner"), ("planner_results", "lead_results"), ("lead_results", "review"), ("review", "publish")):
        g.add_edge(s, t)
    ok = lambda p: F.when(p.cast("string").isin("yes", "no"), p.cast("string") == "yes")
    return g.register_continuation("approve", ok, lambda o, s, p, c, t: o.to_targets(s.withField("approved", p), t))


def team_workflow(spark: Spark, d: Dir) -> DataFrame:
    """Customers as goals with 0 to 4 tasks, two levels deep, all approved."""

    def make() -> DataFrame:
        runner = Runner(_team().compile("team-v1"), TEAM)
        rows = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
        state = team_state(goal=F.col("c_mktsegment"), tasks=F.col("c_custkey") % 5, depth=F.lit(0), limit=F.lit(2))
        r = runner.start(rows.select(F.concat(F.lit("t"), F.col("c_custkey")).alias("run_id"), state.alias("state")))
        answers = runner.pending(r.position).select("run_id", F.lit(0).alias("ordinal"), "invocation_id", "call_id", F.lit("yes").cast("binary").alias("payload"))
        return runner.advance(r.position, answers).calls

    calls = shared(spark, d, "team", make)
    return calls.select("run_id", "status", F.array_join("final.results", ",").alias("results"), F.array_join("final.failures", ",").alias("failures"), F.col("final.approved").alias("approved"))


#: A planner (odd k) asks for k.0 and k.1, which succeed; the search of task 2 fails.
TEAM_SQL = """WITH t AS (SELECT c_custkey AS c, c_custkey % 5 AS n FROM customer),
r AS (SELECT c, n, k, CASE WHEN k % 2 = 1 THEN 'found ' || k || '.0,found ' || k || '.1' WHEN k = 2 THEN NULL ELSE 'found ' || k END AS s FROM t LEFT JOIN range(0, 4) g(k) ON k < n)
SELECT 't' || c AS run_id, CASE WHEN n > 2 THEN 'completed_with_failures' ELSE 'completed' END AS status, coalesce(string_agg(s, ',' ORDER BY k) FILTER (WHERE s IS NOT NULL), '') AS results,
CASE WHEN n > 2 THEN '2: no result' ELSE '' END AS failures, true AS approved FROM r GROUP BY c, n"""


def assignment_validation(spark: Spark, d: Dir) -> DataFrame:
    """Task lists as JSON: an id and a known target each, ids unique, at most 16."""
    kinds = F.array(F.lit("search"), F.lit("planner"))
    rows = read(spark, d, "orders").select("o_orderkey")
    k, n = F.col("o_orderkey") % 6, F.col("o_orderkey") % 20
    item = lambda i: F.struct(F.when((k == 1) & (i == 0), F.lit("nobody")).otherwise(F.lit("search")).alias("target"), F.when((k == 2), F.lit("same")).otherwise(F.concat(F.lit("t"), i)).alias("id"))
    text = F.to_json(F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), item)).otherwise(F.array().cast("array<struct<target:string,id:string>>")))
    text = F.when(k == 3, F.lit('"text"')).when(k == 4, F.lit("[{")).otherwise(text)
    rows = rows.select("o_orderkey", F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, "array<struct<target:string,id:string>>")).alias("tasks"))
    why = (
        F.when(F.col("tasks").isNull(), F.lit("not a list"))
        .when(F.size("tasks") > 16, F.lit("too many"))
        .when(F.exists("tasks", lambda t: ~F.array_contains(kinds, t["target"])), F.lit("unknown target"))
        .when(F.size(F.array_distinct(F.transform("tasks", lambda t: t["id"]))) < F.size("tasks"), F.lit("ids repeat"))
    )
    return rows.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("run_id"), F.coalesce(why, F.lit("ok")).alias("verdict"))


ASSIGNMENT = """SELECT 'o' || o_orderkey AS run_id, CASE WHEN o_orderkey % 6 IN (3, 4) THEN 'not a list' WHEN o_orderkey % 20 > 16 THEN 'too many' WHEN o_orderkey % 6 = 1 AND o_orderkey % 20 > 0 THEN 'unknown target'
WHEN o_orderkey % 6 = 2 AND o_orderkey % 20 > 1 THEN 'ids repeat' ELSE 'ok' END AS verdict FROM orders"""


# --- observation -------------------------------------------------------------


def callback_outcomes(spark: Spark, d: Dir) -> DataFrame:
    """The lines of a run whose first returned line ends it: what came before is
    committed, what came after discarded."""

    def make() -> DataFrame:
        g = order_graph(BILL, lambda o, s, c: F.when(s["f"] == "R", o.end_execution(s)).otherwise(line_run(o, s, c))).compile("outcomes-v1")
        runner = Runner(g, ORDER)
        pos = runner.start(order_runs(spark, d), Options(max_steps=1)).position
        return outcomes(written(Engine(g, ORDER).tasks(runner._live(pos, Options())), "tasks"))

    return shared(spark, d, "outcomes", make).where("node = 'line'").select("run_id", "invocation_id", "action", "outcome")


def _outcomes_sql() -> str:
    from .populations import BRANCHES

    return f"""WITH {BRANCHES}, m AS (SELECT k, min(i) FILTER (WHERE f = 'R') AS m FROM b GROUP BY k)
SELECT 'o' || k AS run_id, 'i' || (5 + 2 * i) AS invocation_id, CASE f WHEN 'R' THEN 'end_execution' WHEN 'A' THEN 'end_branch' ELSE 'complete_branch' END AS action, CASE WHEN m IS NULL OR i <= m THEN 'committed' ELSE 'discarded' END AS outcome FROM b JOIN m USING (k)"""


def events_log(spark: Spark, d: Dir) -> DataFrame:
    """Events of a call over the orders, without its times; callbacks are
    counted by superstep."""

    def make() -> list[dict]:
        log: list[dict] = []
        Runner(order_graph(BILL).compile("observed-v1"), ORDER, observer=log.append).start(order_runs(spark, d))
        return log

    rows = [(e["operation"], e["phase"], e.get("count", 0)) for e in shared(spark, d, "events", make)]
    return spark.createDataFrame(rows, "operation string, phase string, n long").groupBy("operation", "phase").agg(F.sum("n").alias("n"))


EVENTS = """SELECT 'start' AS operation, 'started' AS phase, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'start', 'finished', 0 UNION ALL SELECT 'join', 'finished', count(*) FROM orders
UNION ALL SELECT 'node', 'finished', (SELECT 2 * count(*) FROM orders) + (SELECT count(*) FROM lineitem)"""


def panic_capture(spark: Spark, d: Dir) -> DataFrame:
    """A Python node raises for every fifth region key; the others go on."""

    def body(state: dict, call: dict) -> dict:
        if state["v"] % 5 == 0:
            raise ValueError(f"cannot take {state['v']}")
        return {"action": "end_execution", "state": {"v": state["v"] * 2}}

    g = Graph("go").add_node(NodeSpec("go", python=body, on_error="fail_execution", timeout_ns=30_000_000_000))
    runs = lambda: read(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("run_id"), value(F.col("n_nationkey")).alias("state"))
    calls = ran(spark, d, "panic", g, VALUE, runs)[1].calls
    return calls.select("run_id", "status", F.col("final.v").alias("v"), F.substring_index("failure.message", "\n", 1).alias("message"))


PANIC = "SELECT 'n' || n_nationkey AS run_id, CASE WHEN n_nationkey % 5 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey * 2 AS BIGINT) END AS v, CASE WHEN n_nationkey % 5 = 0 THEN 'panic: cannot take ' || n_nationkey END AS message FROM nation"

QUERIES = {f.__name__: f for f in (subgraph_flatten, edge_list, subgraph_scope, subgraph_return, durable_workflow, effect_receipts, team_workflow, assignment_validation, callback_outcomes, events_log, panic_capture)}
SQL = {
    "events_log": EVENTS,
    "subgraph_flatten": "SELECT * FROM (VALUES ('end', false), ('middle/inner/three', false), ('middle/leave', false), ('middle/two', false), ('one', true)) t(node, is_entry)",
    "edge_list": "SELECT * FROM (VALUES ('one', 'middle/two', false), ('middle/two', 'middle/inner/three', false)) t(source, target, target_is_join)",
    "subgraph_scope": "SELECT * FROM (VALUES ('one', 'middle', 'middle/two'), ('middle/two', 'inner', 'middle/inner/three')) t(node, local_name, global_name)",
    "subgraph_return": "SELECT 'o' || o_orderkey AS run_id, 'completed' AS status, o_orderkey + 6 AS v, CAST(5 AS BIGINT) AS steps, CAST(6 AS BIGINT) AS revision FROM orders",
    "durable_workflow": DURABLE, "effect_receipts": RECEIPTS, "team_workflow": TEAM_SQL, "assignment_validation": ASSIGNMENT, "callback_outcomes": _outcomes_sql(), "panic_capture": PANIC,
}
