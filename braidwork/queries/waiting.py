"""Waits and answers: a user waits for each purchase and is answered in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import branch_values
from ..operators.runner import Result, Runner
from ..operators.schema import ident
from ..plans import Graph, JoinSpec, NodeSpec
from ..sources.tables import written
from ..streaming.inputs import effects
from .populations import BILL, BRANCHES, ORDER, Window, order_graph, order_runs, order_state, ran, read, shared

Spark, Dir = SparkSession, str

USER = "struct<user:bigint,event:bigint,k:bigint,events:array<bigint>>"


def user_state(**f):
    names = {"user": "bigint", "event": "bigint", "k": "bigint", "events": "array<bigint>"}
    return F.struct(*[f.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()])


def _graph() -> Graph:
    """Users of remainder 2 fail their third answer, which fails the group."""

    def begin(o, s, c):
        return o.fan_out(s, F.transform(s["events"], lambda e: o.to_branch("hold", user_state(user=s["user"], event=e))))

    def answer(o, s, payload, call, targets):
        fails = (s["user"] % 5 == 2) & (call["invocation_id"] == "i9")
        return F.when(fails, o.fail("refused")).otherwise(o.to_targets(user_state(user=s["user"], event=s["event"], k=payload["k"]), targets))

    def total(parent, b, call):
        return user_state(user=parent["user"], k=F.aggregate(branch_values(b), F.lit(0).cast("bigint"), lambda a, s: a + s["k"]))

    g = Graph("buy").add_node(NodeSpec("buy", begin)).add_node(NodeSpec("hold", lambda o, s, c: o.wait(s, "confirm", "paid"), on_error="fail_group")).add_node(NodeSpec("paid", lambda o, s, c: o.complete_branch(s)))
    g.add_node(NodeSpec("done", lambda o, s, c: o.end_execution(s))).add_join(JoinSpec("sum", "buy", total))
    g.add_edge("buy", "hold").add_edge("hold", "paid").add_edge("sum", "done")
    # A payload that is no object with an integer k does not decode.
    decode = lambda p: F.when(F.from_json(p.cast("string"), "k bigint")["k"].isNotNull(), F.from_json(p.cast("string"), "k bigint"))
    return g.register_continuation("confirm", decode, answer)


def waited(spark: Spark, d: Dir) -> tuple[Runner, Result]:
    def make() -> tuple[Runner, Result]:
        rows = read(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("events"))
        runs = rows.select(F.concat(F.lit("u"), F.col("user_id")).alias("run_id"), user_state(user=F.col("user_id"), events=F.col("events")).alias("state"))
        runner = Runner(_graph().compile("users-v1"), USER)
        return runner, runner.start(runs)

    return shared(spark, d, "users", make)


def inputs(spark: Spark, d: Dir) -> DataFrame:
    """An answer to each purchase with its props. Remainder 0: the first payload
    is damaged; remainder 1: each click is sent as an answer too, to a call that
    is not waiting."""

    def make() -> DataFrame:
        rows = read(spark, d, "events").where("event_type in ('purchase', 'click')").select("event_id", "user_id", "event_type", "props")
        order = Window.partitionBy("user_id", "event_type").orderBy("event_id")
        rows = rows.withColumn("j", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id", "event_type")))
        rows = rows.where("event_type = 'purchase' or user_id % 5 = 1")
        buy = F.col("event_type") == "purchase"
        damaged = buy & (F.col("user_id") % 5 == 0) & (F.col("j") == 0)
        return written(rows.select(
            F.concat(F.lit("u"), F.col("user_id")).alias("run_id"), F.when(buy, F.col("j")).otherwise(F.col("j") + 100_000).cast("int").alias("ordinal"), F.concat(F.lit("i"), F.when(buy, 5 + 2 * F.col("j")).otherwise(F.lit(1))).alias("invocation_id"),
            F.concat(F.lit("c"), F.when(buy, 5 + 2 * F.col("n") + F.col("j")).otherwise(F.lit(2))).alias("call_id"), F.when(damaged, F.lit("{")).otherwise(F.col("props")).cast("binary").alias("payload"), "event_id",
        ), "answers")

    return shared(spark, d, "answers", make)


def answered(spark: Spark, d: Dir) -> Result:
    runner, r = waited(spark, d)
    return shared(spark, d, "answered", lambda: runner.advance(r.position, inputs(spark, d).drop("event_id")))


def _decoded(spark: Spark, d: Dir) -> DataFrame:
    runner, r = waited(spark, d)
    return runner.decoded(r.position, inputs(spark, d))


_P = """p AS (SELECT user_id AS u, event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS j, count(*) OVER (PARTITION BY user_id) AS n, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events WHERE event_type = 'purchase'),
us AS (SELECT u, max(n) AS n, CAST(sum(v) AS BIGINT) AS v FROM p GROUP BY u),
cl AS (SELECT DISTINCT user_id AS u FROM events WHERE event_type = 'click')"""


def pending_list(spark: Spark, d: Dir) -> DataFrame:
    runner, r = waited(spark, d)
    return runner.pending(r.position)


PENDING = f"WITH {_P} SELECT 'u' || u AS run_id, 'i' || (5 + 2 * j) AS invocation_id, 'c' || (5 + 2 * n + j) AS call_id, 'hold' AS node, 'confirm' AS continuation FROM p"


def resume_valid(spark: Spark, d: Dir) -> DataFrame:
    return _decoded(spark, d).where("valid").select("run_id", "event_id", "invocation_id", "call_id")


RESUME_VALID = f"WITH {_P} SELECT 'u' || u AS run_id, e AS event_id, 'i' || (5 + 2 * j) AS invocation_id, 'c' || (5 + 2 * n + j) AS call_id FROM p"


def resume_reject(spark: Spark, d: Dir) -> DataFrame:
    return _decoded(spark, d).where("not valid").select("run_id", "event_id")


RESUME_REJECT = "SELECT 'u' || user_id AS run_id, event_id FROM events WHERE event_type = 'click' AND user_id % 5 = 1"


def resume_json(spark: Spark, d: Dir) -> DataFrame:
    rows = inputs(spark, d).where("ordinal < 100000")
    text = F.col("payload").cast("string")
    return rows.select("event_id", F.from_json(text, "k bigint")["k"].alias("k"), F.from_json(text, "k bigint")["k"].isNotNull().alias("ok"))


RESUME_JSON = f"WITH {_P} SELECT e AS event_id, CASE WHEN u % 5 = 0 AND j = 0 THEN NULL ELSE v END AS k, NOT (u % 5 = 0 AND j = 0) AS ok FROM p"


def resume_decode_gate(spark: Spark, d: Dir) -> DataFrame:
    """One payload that does not decode leaves its run as it was."""
    return answered(spark, d).calls.where("error = 'decode'").select("run_id", "status", "steps", "revision")


GATE = f"WITH {_P} SELECT 'u' || u AS run_id, 'waiting' AS status, 1 + n AS steps, 2 + n AS revision FROM us WHERE u % 5 = 0"


def resume_apply(spark: Spark, d: Dir) -> DataFrame:
    calls = answered(spark, d).calls
    return calls.where("status = 'completed'").select("run_id", F.col("final.k").alias("total"), "steps", "revision")


_CLEAN = "(u % 5 IN (3, 4) OR (u % 5 = 1 AND u NOT IN (SELECT u FROM cl)) OR (u % 5 = 2 AND n < 3))"
APPLY = f"WITH {_P} SELECT 'u' || u AS run_id, v AS total, 2 + 2 * n AS steps, 4 + 3 * n AS revision FROM us WHERE {_CLEAN}"


def resume_prefix(spark: Spark, d: Dir) -> DataFrame:
    """Answers before the refused one were committed; those after it were not."""
    return answered(spark, d).calls.where("status = 'completed_with_failures'").select("run_id", "revision", "steps")


PREFIX = f"WITH {_P} SELECT 'u' || u AS run_id, 2 + n + 3 AS revision, 1 + n AS steps FROM us WHERE u % 5 = 2 AND n >= 3"


def resume_skip(spark: Spark, d: Dir) -> DataFrame:
    """How many answers each such run skipped, as their waits had gone."""
    got = answered(spark, d).calls.where("status = 'completed_with_failures'").select("run_id", "revision", "steps")
    sent = inputs(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("sent"))
    return got.join(sent, "run_id").select("run_id", (F.col("sent") - (F.col("revision") - 1 - F.col("steps"))).alias("skipped"))


SKIP = f"WITH {_P} SELECT 'u' || u AS run_id, n - 3 AS skipped FROM us WHERE u % 5 = 2 AND n >= 3"


def resume_failure(spark: Spark, d: Dir) -> DataFrame:
    """A refused answer takes the policy of the node that waits."""
    return answered(spark, d).calls.where("had_local_failures").select("run_id", "status", F.col("final").isNull().alias("no_final"))


FAILURE = f"WITH {_P} SELECT 'u' || u AS run_id, 'completed_with_failures' AS status, true AS no_final FROM us WHERE u % 5 = 2 AND n >= 3"


def advance(spark: Spark, d: Dir) -> DataFrame:
    """Where a second call leaves every run of the first."""
    return answered(spark, d).calls.select("run_id", "status", "completed")


ADVANCE = f"""WITH {_P} SELECT 'u' || u AS run_id, CASE WHEN {_CLEAN} THEN 'completed' WHEN u % 5 = 0 THEN 'waiting' WHEN u % 5 = 1 THEN 'failed' ELSE 'completed_with_failures' END AS status,
({_CLEAN} OR u % 5 = 2) AS completed FROM us"""


def call_info(spark: Spark, d: Dir) -> DataFrame:
    """Waits keep their call's identity; an answered one has a new call."""
    rows = answered(spark, d).position.invocations.where("status = 'waiting'")
    return rows.select("run_id", ident("i", F.col("num")).alias("invocation_id"), ident("c", F.col("call")).alias("call_id"), "node", "branch_index")


CALL_INFO = f"WITH {_P} SELECT 'u' || u AS run_id, 'i' || (5 + 2 * j) AS invocation_id, 'c' || (5 + 2 * n + j) AS call_id, 'hold' AS node, CAST(j AS INTEGER) AS branch_index FROM p WHERE u % 5 = 0 OR (u % 5 = 1 AND u IN (SELECT u FROM cl))"

def effect_graph(spark: Spark, d: Dir) -> DataFrame:
    """Each line adds its quantity to its order's ledger and goes on with the
    value that it gets; replays of a call would get the same one."""
    g = order_graph(BILL, lambda o, s, c: o.wait(s, "effect", "paid")).add_node(NodeSpec("paid", lambda o, s, c: o.complete_branch(s))).add_edge("line", "paid")
    g.register_continuation("effect", lambda p: p.cast("string").try_cast("bigint"), lambda o, s, p, c, t: o.to_targets(order_state(q=p, f=s["f"]), t))
    runner, r = ran(spark, d, "effects", g, ORDER, lambda: order_runs(spark, d))
    result = shared(spark, d, "effects-answered", lambda: effects(runner, r.position, "effect", lambda s: s["q"])[0])
    return result.calls.select("run_id", "status", F.col("final.q").alias("q"))


EFFECT_GRAPH = f"""WITH {BRANCHES}, r AS (SELECT k, sum(q) OVER (PARTITION BY k ORDER BY i) AS v FROM b)
SELECT 'o' || o_orderkey AS run_id, 'completed' AS status, CAST(coalesce(sum(v), 0) AS BIGINT) AS q FROM orders LEFT JOIN r ON k = o_orderkey GROUP BY o_orderkey"""


QUERIES = {f.__name__: f for f in (
    effect_graph,pending_list, resume_valid, resume_reject, resume_json, resume_decode_gate, resume_apply, resume_prefix, resume_skip, resume_failure, advance, call_info)}
SQL = {
    "effect_graph": EFFECT_GRAPH,"pending_list": PENDING, "resume_valid": RESUME_VALID, "resume_reject": RESUME_REJECT, "resume_json": RESUME_JSON, "resume_decode_gate": GATE, "resume_apply": APPLY, "resume_prefix": PREFIX, "resume_skip": SKIP, "resume_failure": FAILURE, "advance": ADVANCE, "call_info": CALL_INFO}
