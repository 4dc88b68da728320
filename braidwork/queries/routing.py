"""Control-flow queries: routes, fan-outs, failures and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schema import ident, public_invocations
from ..operators.superstep import Options
from ..plans import Graph, NodeSpec
from .populations import BILL, BRANCHES, ORDER, Window, billed, branches, budgeted, held, order_graph, order_runs, order_state, ran, scoped

Spark, Dir = SparkSession, str


def _rows(spark: Spark, d: Dir, name: str, graph: Graph, steps: int = 1) -> DataFrame:
    result = ran(spark, d, name, graph, ORDER, lambda: order_runs(spark, d), Options(max_steps=steps))[1]
    return result.position.invocations


def route_single(spark: Spark, d: Dir) -> DataFrame:
    g = Graph("sort").add_node(NodeSpec("sort", lambda o, s, c: o.to(s, F.when(s["kind"] == "O", "open").when(s["kind"] == "F", "finished").otherwise("partial"))))
    for n in ("open", "finished", "partial"):
        g.add_node(NodeSpec(n, lambda o, s, c: o.end_execution(s))).add_edge("sort", n)
    return public_invocations(_rows(spark, d, "route", g)).select("run_id", "id", "call_id", "node", "status")


ROUTE_SINGLE = """SELECT 'o' || o_orderkey AS run_id, 'i1' AS id, 'c3' AS call_id,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'finished' ELSE 'partial' END AS node, 'ready' AS status FROM orders"""


def fanout_static(spark: Spark, d: Dir) -> DataFrame:
    g = Graph("open").add_node(NodeSpec("open", lambda o, s, c: o.to(s, "pick", "pack", "ship"))).add_join(BILL)
    for n in ("pick", "pack", "ship"):
        g.add_node(NodeSpec(n, lambda o, s, c: o.complete_branch(s))).add_edge("open", n)
    rows = _rows(spark, d, "static", g).where("group_num > 0")
    return public_invocations(rows).select("run_id", "id", "call_id", "group_id", "branch_index", "node", F.col("state.key").alias("state_key"))


FANOUT_STATIC = """SELECT 'o' || o_orderkey AS run_id, 'i' || (5 + 2 * i) AS id, 'c' || (6 + 2 * i) AS call_id, 'g3' AS group_id, CAST(i AS INTEGER) AS branch_index, node, o_orderkey AS state_key
FROM orders, (VALUES (0, 'pick'), (1, 'pack'), (2, 'ship')) t(i, node)"""


def route_dynamic_targets(spark: Spark, d: Dir) -> DataFrame:
    """Targets are a list made at run time: the distinct flags of an order."""

    def begin(o, s, c):
        flags = F.array_sort(F.array_distinct(F.transform(s["kids"], lambda x: x["f"])))
        return F.when(F.size(flags) > 0, o.to_targets(s, flags)).otherwise(o.to(s, "none"))

    g = Graph("open").add_node(NodeSpec("open", begin))
    for n in ("A", "N", "R", "none"):
        g.add_node(NodeSpec(n, lambda o, s, c: o.end_branch())).add_edge("open", n)
    rows = _rows(spark, d, "targets", g).where("status = 'ready'")
    return public_invocations(rows).select("run_id", "id", "call_id", "group_id", "branch_index", "node")


ROUTE_DYNAMIC = """WITH f AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS f FROM lineitem),
r AS (SELECT k, f, row_number() OVER (PARTITION BY k ORDER BY f) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM f)
SELECT 'o' || k AS run_id, CASE WHEN n = 1 THEN 'i1' ELSE 'i' || (4 + 2 * i) END AS id, CASE WHEN n = 1 THEN 'c3' ELSE 'c' || (5 + 2 * i) END AS call_id,
  CASE WHEN n = 1 THEN '' ELSE 'g3' END AS group_id, CAST(i AS INTEGER) AS branch_index, f AS node FROM r
UNION ALL SELECT 'o' || o_orderkey, 'i1', 'c3', '', 0, 'none' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""


def fanout_dynamic(spark: Spark, d: Dir) -> DataFrame:
    rows = _rows(spark, d, "dynamic", order_graph(BILL)).where("group_num > 0")
    return public_invocations(rows).select("run_id", "id", "call_id", "group_id", "branch_index", "node", "status", F.col("state.q").alias("q"), F.col("state.f").alias("f"))


FANOUT_DYNAMIC = f"""WITH {BRANCHES} SELECT 'o' || k AS run_id, 'i' || (5 + 2 * i) AS id, 'c' || (6 + 2 * i) AS call_id, 'g3' AS group_id, CAST(i AS INTEGER) AS branch_index, 'line' AS node, 'ready' AS status, q, f FROM b"""


def _unjoined(spark: Spark, d: Dir) -> DataFrame:
    def line(o, s, c):
        return F.when(s["f"] == "R", o.fail("returned")).otherwise(o.end_branch())

    return ran(spark, d, "unjoined", order_graph(None, line), ORDER, lambda: order_runs(spark, d))[1].calls


def fanout_unjoined(spark: Spark, d: Dir) -> DataFrame:
    return _unjoined(spark, d).where("steps > 1").select("run_id", "status", "steps", "revision", "next_id")


FANOUT_UNJOINED = f"""WITH {BRANCHES} SELECT 'o' || k AS run_id, CASE WHEN bool_or(f = 'R') THEN 'completed_with_failures' ELSE 'completed' END AS status,
  count(*) + 1 AS steps, count(*) + 3 AS revision, 4 + 2 * count(*) AS next_id FROM b GROUP BY k"""


def fanout_zero_unjoined(spark: Spark, d: Dir) -> DataFrame:
    return _unjoined(spark, d).where("steps = 1").select("run_id", "status", "steps", "revision", "next_id")


FANOUT_ZERO_UNJOINED = """SELECT 'o' || o_orderkey AS run_id, 'completed' AS status, CAST(1 AS BIGINT) AS steps, CAST(2 AS BIGINT) AS revision, CAST(3 AS BIGINT) AS next_id
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""


def fanout_zero_joined(spark: Spark, d: Dir) -> DataFrame:
    calls = billed(spark, d)[1].calls
    return calls.where("final.n = 0").select("run_id", "status", "steps", "revision", "next_id", F.col("final.q").alias("q"))


FANOUT_ZERO_JOINED = """SELECT 'o' || o_orderkey AS run_id, 'completed' AS status, CAST(2 AS BIGINT) AS steps, CAST(4 AS BIGINT) AS revision, CAST(6 AS BIGINT) AS next_id, CAST(0 AS BIGINT) AS q
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""


def _bad(spark: Spark, d: Dir) -> DataFrame:
    """Status O follows an undeclared edge, F branches to a join, P repeats a target."""

    def begin(o, s, c):
        wrong = o.fan_out(s, F.array(o.to_branch("bill", s)))
        return F.when(s["kind"] == "O", o.to(s, "nowhere")).when(s["kind"] == "F", wrong).otherwise(o.to(s, "line", "line"))

    g = Graph("open").add_node(NodeSpec("open", begin)).add_node(NodeSpec("line", lambda o, s, c: o.end_branch())).add_join(BILL).add_edge("open", "line")
    return ran(spark, d, "bad", g, ORDER, lambda: order_runs(spark, d))[1].calls


def illegal_transition(spark: Spark, d: Dir) -> DataFrame:
    return _bad(spark, d).select("run_id", "status", "error", "revision", "steps", "completed")


ILLEGAL = """SELECT 'o' || o_orderkey AS run_id, 'failed' AS status, CASE o_orderstatus WHEN 'O' THEN 'edge is not declared' WHEN 'F' THEN 'branch target is not a declared node' ELSE 'targets repeat' END AS error,
CAST(1 AS BIGINT) AS revision, CAST(0 AS BIGINT) AS steps, false AS completed FROM orders"""


def fanout_invalid_target(spark: Spark, d: Dir) -> DataFrame:
    return _bad(spark, d).where("error = 'branch target is not a declared node'").select("run_id")


def interrupt_prefix(spark: Spark, d: Dir) -> DataFrame:
    """The first line of 40 or more interrupts the call; what came before stays."""

    def line(o, s, c):
        return F.when(s["q"] >= 40, o.interrupt()).otherwise(o.complete_branch(s))

    r = ran(spark, d, "interrupt", order_graph(BILL, line), ORDER, lambda: order_runs(spark, d))[1]
    left = r.position.invocations.where("group_num > 0").groupBy("run_id").agg(F.count_if(F.col("status") == "joined").alias("joined"), F.count_if(F.col("status") == "ready").alias("ready"))
    return r.calls.where("status = 'interrupted'").join(left, "run_id").select("run_id", "steps", "revision", "joined", "ready")


INTERRUPT = f"""WITH {BRANCHES}, c AS (SELECT k, min(i) FILTER (WHERE q >= 40) AS m, count(*) AS n FROM b GROUP BY k)
SELECT 'o' || k AS run_id, 1 + m AS steps, 2 + m AS revision, m AS joined, n - m AS ready FROM c WHERE m IS NOT NULL"""


def _held(spark: Spark, d: Dir, status: str) -> DataFrame:
    rows = held(spark, d)[1].position.invocations.where((F.col("status") == status) & (F.col("group_num") > 0))
    return rows.select("run_id", ident("i", F.col("num")).alias("id"), "branch_index", "node", ident("c", F.col("call")).alias("call_id"), F.coalesce("error", F.lit("")).alias("error"))


def _held_sql(where: str, node: str, error: str = "") -> str:
    return f"WITH {BRANCHES} SELECT 'o' || k AS run_id, 'i' || (5 + 2 * i) AS id, CAST(i AS INTEGER) AS branch_index, '{node}' AS node, '' AS call_id, '{error}' AS error FROM b WHERE {where}"


def end_branch(spark: Spark, d: Dir) -> DataFrame:
    return _held(spark, d, "ended")


def complete_branch(spark: Spark, d: Dir) -> DataFrame:
    return _held(spark, d, "joined")


def fail_invocation(spark: Spark, d: Dir) -> DataFrame:
    return _held(spark, d, "failed")


def join_by_edge(spark: Spark, d: Dir) -> DataFrame:
    rows = held(spark, d)[1].position.invocations.where("status = 'joined' and state.q % 2 = 0")
    return rows.select("run_id", "branch_index", "node", "group_join", F.col("state.q").alias("q"))


JOIN_BY_EDGE = f"WITH {BRANCHES} SELECT 'o' || k AS run_id, CAST(i AS INTEGER) AS branch_index, 'bill' AS node, 'bill' AS group_join, q FROM b WHERE f = 'N' AND q % 2 = 0"


def wait_pending(spark: Spark, d: Dir) -> DataFrame:
    runner, r = held(spark, d)
    return runner.pending(r.position)


WAIT_PENDING = """SELECT 'o' || o_orderkey AS run_id, 'i' || (5 + 2 * n) AS invocation_id, 'c' || (7 + 2 * n) AS call_id, 'hold' AS node, 'go' AS continuation
FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"""


def end_execution(spark: Spark, d: Dir) -> DataFrame:
    """The first line with flag N ends its run with its quantity."""

    def line(o, s, c):
        return F.when(s["f"] == "N", o.end_execution(s)).otherwise(o.end_branch())

    calls = ran(spark, d, "ending", order_graph(BILL, line), ORDER, lambda: order_runs(spark, d))[1].calls
    return calls.where("final.f = 'N'").select("run_id", "status", "steps", "revision", F.col("final.q").alias("q"))


END_EXECUTION = f"""WITH {BRANCHES}, m AS (SELECT k, min(i) FILTER (WHERE f = 'N') AS i FROM b GROUP BY k)
SELECT 'o' || k AS run_id, 'completed' AS status, i + 2 AS steps, i + 3 AS revision, q FROM m JOIN b USING (k, i)"""


def loop_counter(spark: Spark, d: Dir) -> DataFrame:
    def turn(o, s, c):
        left = s["key"] % 4
        at = F.coalesce(s["n"], F.lit(0).cast("bigint"))
        return F.when(at >= left, o.end_execution(order_state(key=s["key"], n=at))).otherwise(o.to(order_state(key=s["key"], n=at + 1), "turn"))

    g = Graph("turn").add_node(NodeSpec("turn", turn)).add_edge("turn", "turn")
    calls = ran(spark, d, "loop", g, ORDER, lambda: order_runs(spark, d))[1].calls
    return calls.select("run_id", "status", F.col("final.n").alias("n"), "steps", "revision", "next_id")


LOOP = """SELECT 'o' || o_orderkey AS run_id, 'completed' AS status, o_orderkey % 4 AS n, o_orderkey % 4 + 1 AS steps, o_orderkey % 4 + 2 AS revision, o_orderkey % 4 + 3 AS next_id FROM orders"""


def _fails(spark: Spark, d: Dir, kind: str) -> DataFrame:
    calls = scoped(spark, d).calls.join(order_runs(spark, d).where(F.col("state.kind") == kind).select("run_id"), "run_id", "left_semi")
    return calls.select("run_id", "status", "steps", "revision", "next_id", F.col("failure.node").alias("failure_node"), F.col("failure.invocation_id").alias("failure_id"), F.col("final.q").alias("q"))


_FIRST = f"WITH {BRANCHES}, c AS (SELECT o_orderkey AS k, o_orderstatus AS s, min(i) FILTER (WHERE f = 'R') AS m, count(i) AS n, CAST(coalesce(sum(q) FILTER (WHERE f = 'N'), 0) AS BIGINT) AS q FROM orders LEFT JOIN b ON k = o_orderkey GROUP BY 1, 2)"


def fail_group(spark: Spark, d: Dir) -> DataFrame:
    return _fails(spark, d, "F")


FAIL_GROUP = f"""{_FIRST} SELECT 'o' || k AS run_id, CASE WHEN m IS NULL THEN 'completed' ELSE 'completed_with_failures' END AS status,
CASE WHEN m IS NULL THEN n + 2 ELSE m + 2 END AS steps, CASE WHEN m IS NULL THEN n + 4 ELSE m + 3 END AS revision, CASE WHEN m IS NULL THEN 6 + 2 * n ELSE 5 + 2 * n END AS next_id,
CAST(NULL AS VARCHAR) AS failure_node, CAST(NULL AS VARCHAR) AS failure_id, CASE WHEN m IS NULL THEN q END AS q FROM c WHERE s = 'F'"""


def fail_execution(spark: Spark, d: Dir) -> DataFrame:
    return _fails(spark, d, "P")


FAIL_EXECUTION = f"""{_FIRST} SELECT 'o' || k AS run_id, CASE WHEN m IS NULL THEN 'completed' ELSE 'failed' END AS status,
CASE WHEN m IS NULL THEN n + 2 ELSE m + 2 END AS steps, CASE WHEN m IS NULL THEN n + 4 ELSE m + 3 END AS revision, CASE WHEN m IS NULL THEN 6 + 2 * n ELSE 5 + 2 * n END AS next_id,
CASE WHEN m IS NOT NULL THEN 'line_fail_execution' END AS failure_node, CASE WHEN m IS NOT NULL THEN 'i' || (5 + 2 * m) END AS failure_id, CASE WHEN m IS NULL THEN q END AS q FROM c WHERE s = 'P'"""


def failure_override(spark: Spark, d: Dir) -> DataFrame:
    return scoped(spark, d, "fail_execution").calls.select("run_id", "status", "steps", F.col("failure.message").alias("message"))


FAILURE_OVERRIDE = f"""{_FIRST} SELECT 'o' || k AS run_id, CASE WHEN m IS NULL THEN 'completed' ELSE 'failed' END AS status, CASE WHEN m IS NULL THEN n + 2 ELSE m + 2 END AS steps, CASE WHEN m IS NOT NULL THEN 'returned' END AS message FROM c"""


def fail_group_root(spark: Spark, d: Dir) -> DataFrame:
    """A root has no group, so failing it fails the execution."""
    g = Graph("open").add_node(NodeSpec("open", lambda o, s, c: F.when(s["kind"] == "P", o.fail("partial")).otherwise(o.end_execution(s)), on_error="fail_group"))
    calls = ran(spark, d, "root", g, ORDER, lambda: order_runs(spark, d))[1].calls
    return calls.select("run_id", "status", F.col("failure.invocation_id").alias("failure_id"), F.col("failure.message").alias("message"), "steps", "revision")


FAIL_GROUP_ROOT = """SELECT 'o' || o_orderkey AS run_id, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN o_orderstatus = 'P' THEN 'i1' END AS failure_id,
CASE WHEN o_orderstatus = 'P' THEN 'partial' END AS message, CAST(1 AS BIGINT) AS steps, CAST(2 AS BIGINT) AS revision FROM orders"""


def timeout_policy(spark: Spark, d: Dir) -> DataFrame:
    """A line takes its quantity in seconds; the node allows 30 and an entry
    timeout 20 for flag A, 45 for flag N."""
    return _timed(spark, d).where("status = 'failed'").select("run_id", "branch_index", "error", "entry_timeout_ns")


def _timed(spark: Spark, d: Dir) -> DataFrame:
    def begin(o, s, c):
        limit = lambda x: F.when(x["f"] == "A", F.lit(20_000_000_000)).when(x["f"] == "N", F.lit(45_000_000_000)).otherwise(F.lit(0))
        kids = F.transform(s["kids"], lambda x: o.to_branch("line", order_state(q=x["q"], f=x["f"]), limit(x)))
        return o.fan_out(s, F.concat(kids, F.array(o.to_branch("hold", order_state(f=F.lit("H"))))))

    line = NodeSpec("line", lambda o, s, c: o.complete_branch(s), timeout_ns=30_000_000_000, elapsed=lambda s: s["q"] * 1_000_000_000)
    g = Graph("open").add_node(NodeSpec("open", begin)).add_node(line).add_node(NodeSpec("hold", lambda o, s, c: o.wait(s, "go", "line"))).add_join(BILL)
    g.add_edge("open", "line").add_edge("open", "hold").add_edge("hold", "line").register_continuation("go", lambda p: p, lambda o, s, p, c, t: o.to_targets(s, t))
    return ran(spark, d, "timed", g, ORDER, lambda: order_runs(spark, d))[1].position.invocations


TIMEOUT = f"""WITH {BRANCHES}, l AS (SELECT *, CASE f WHEN 'A' THEN 20 WHEN 'N' THEN 45 ELSE 0 END AS e FROM b)
SELECT 'o' || k AS run_id, CAST(i AS INTEGER) AS branch_index, 'context deadline exceeded' AS error, CAST(e AS BIGINT) * 1000000000 AS entry_timeout_ns FROM l WHERE q > CASE WHEN e > 0 THEN e ELSE 30 END"""


def entry_timeout_clear(spark: Spark, d: Dir) -> DataFrame:
    return _timed(spark, d).where("status = 'joined'").select("run_id", "branch_index", "entry_timeout_ns")


ENTRY_CLEAR = f"""WITH {BRANCHES}, l AS (SELECT *, CASE f WHEN 'A' THEN 20 WHEN 'N' THEN 45 ELSE 30 END AS e FROM b)
SELECT 'o' || k AS run_id, CAST(i AS INTEGER) AS branch_index, CAST(0 AS BIGINT) AS entry_timeout_ns FROM l WHERE q <= e"""


def budget_steps(spark: Spark, d: Dir) -> DataFrame:
    return budgeted(spark, d)[1].calls.select("run_id", "status", "budget_reason", "steps", "revision")


BUDGET_STEPS = f"""{_FIRST}, d AS (SELECT k, n, n < 2 AS fits, bool_or(coalesce(f, '') = 'R') AS bad FROM c LEFT JOIN b USING (k) GROUP BY 1, 2, 3)
SELECT 'o' || k AS run_id, CASE WHEN NOT fits THEN 'budget_exhausted' WHEN bad THEN 'completed_with_failures' ELSE 'completed' END AS status, CASE WHEN NOT fits THEN 'max_steps' END AS budget_reason,
CASE WHEN fits THEN n + 2 ELSE 3 END AS steps, CASE WHEN fits THEN n + 4 WHEN n = 2 THEN 5 ELSE 4 END AS revision FROM d"""


def ready_set(spark: Spark, d: Dir) -> DataFrame:
    """What the spent budget left ready, in schedule order."""
    rows = budgeted(spark, d)[1].position.invocations.where("status = 'ready'")
    turn = F.row_number().over(Window.partitionBy("run_id").orderBy("seq", "num"))
    return rows.select("run_id", ident("i", F.col("num")).alias("id"), turn.cast("bigint").alias("turn"))


READY_SET = f"""WITH {BRANCHES} SELECT 'o' || k AS run_id, 'i' || (5 + 2 * i) AS id, i - 1 AS turn FROM b WHERE i >= 2
UNION ALL SELECT 'o' || k, 'i1', CAST(1 AS BIGINT) FROM b GROUP BY k HAVING count(*) = 2"""


def budget_invocations(spark: Spark, d: Dir) -> DataFrame:
    calls = ran(spark, d, "retained", order_graph(BILL), ORDER, lambda: order_runs(spark, d), Options(max_invocations=5))[1].calls
    return calls.select("run_id", "status", "budget_reason", "steps", "revision")


BUDGET_INVOCATIONS = f"""{_FIRST} SELECT 'o' || k AS run_id, CASE WHEN n > 4 THEN 'budget_exhausted' WHEN m IS NULL THEN 'completed' ELSE 'completed_with_failures' END AS status, CASE WHEN n > 4 THEN 'max_invocations' END AS budget_reason,
CASE WHEN n > 4 THEN 0 ELSE n + 2 END AS steps, CASE WHEN n > 4 THEN 1 ELSE n + 4 END AS revision FROM c"""


def counter_limit(spark: Spark, d: Dir) -> DataFrame:
    """Ids end at 15: a fan-out of more than five lines does not begin, and five
    leave none for the call after the merge; the position stays as it was."""
    calls = ran(spark, d, "limited", order_graph(BILL), ORDER, lambda: order_runs(spark, d), Options(counter_limit=15))[1].calls
    return calls.select("run_id", F.coalesce(F.col("error") == "execution_limit", F.lit(False)).alias("exhausted"), "steps", "revision", "next_id")


COUNTER_LIMIT = f"""{_FIRST} SELECT 'o' || k AS run_id, n >= 5 AS exhausted, CASE WHEN n > 5 THEN 0 WHEN n = 5 THEN 6 ELSE n + 2 END AS steps,
CASE WHEN n > 5 THEN 1 WHEN n = 5 THEN 7 ELSE n + 4 END AS revision, CASE WHEN n > 5 THEN 3 WHEN n = 5 THEN 15 ELSE 6 + 2 * n END AS next_id FROM c"""


QUERIES = {f.__name__: f for f in (
    route_single, fanout_static, route_dynamic_targets, fanout_dynamic, fanout_unjoined, fanout_zero_unjoined, fanout_zero_joined, illegal_transition, fanout_invalid_target, interrupt_prefix, end_branch, complete_branch,
    fail_invocation, join_by_edge, wait_pending, end_execution, loop_counter, fail_group, fail_execution, failure_override, fail_group_root, timeout_policy, entry_timeout_clear, budget_steps, ready_set, budget_invocations, counter_limit,
)}
SQL = {
    "route_single": ROUTE_SINGLE, "fanout_static": FANOUT_STATIC, "route_dynamic_targets": ROUTE_DYNAMIC, "fanout_dynamic": FANOUT_DYNAMIC, "fanout_unjoined": FANOUT_UNJOINED, "fanout_zero_unjoined": FANOUT_ZERO_UNJOINED,
    "fanout_zero_joined": FANOUT_ZERO_JOINED, "illegal_transition": ILLEGAL, "fanout_invalid_target": "SELECT 'o' || o_orderkey AS run_id FROM orders WHERE o_orderstatus = 'F'", "interrupt_prefix": INTERRUPT,
    "end_branch": _held_sql("f = 'A'", "line"), "complete_branch": _held_sql("f = 'N'", "bill"), "fail_invocation": _held_sql("f = 'R'", "line", "returned"), "join_by_edge": JOIN_BY_EDGE, "wait_pending": WAIT_PENDING,
    "end_execution": END_EXECUTION, "loop_counter": LOOP, "fail_group": FAIL_GROUP, "fail_execution": FAIL_EXECUTION, "failure_override": FAILURE_OVERRIDE, "fail_group_root": FAIL_GROUP_ROOT, "timeout_policy": TIMEOUT,
    "entry_timeout_clear": ENTRY_CLEAR, "budget_steps": BUDGET_STEPS, "ready_set": READY_SET, "budget_invocations": BUDGET_INVOCATIONS, "counter_limit": COUNTER_LIMIT,
}
