"""Exact results of small graphs, and many runs against closed forms."""

import pytest
from pyspark.sql import functions as F

from braidwork.operators.runner import Runner
from braidwork.operators.superstep import Options
from braidwork.operators.validate import violations
from braidwork.plans import Graph, JoinSpec, NodeSpec

S = "struct<v:bigint>"


def val(x):
    return F.struct((x if not isinstance(x, int) else F.lit(x)).cast("bigint").alias("v"))


def ok_sum(parent, b, call):
    return val(F.aggregate(F.filter(b, lambda x: x["status"] == "joined"), parent["v"], lambda a, x: a + x["state"]["v"]))


def start(spark, g, states, options=None):
    runner = Runner(g.compile("test-v1"), S)
    runs = spark.createDataFrame([(f"r{k}", (v,)) for k, v in enumerate(states)], f"run_id string, state {S}")
    result = runner.start(runs, options)
    return runner, result, {r.run_id: r for r in result.calls.collect()}


def end(o, s, c):
    return o.end_execution(s)


def test_counter_loop(spark):
    g = Graph("n").add_node(NodeSpec("n", lambda o, s, c: F.when(s["v"] == 3, o.end_execution(s)).otherwise(o.to(val(s["v"] + 1), "n")), on_error="fail_execution")).add_edge("n", "n")
    calls = start(spark, g, [0, 2])[2]
    assert (calls["r0"].final.v, calls["r0"].steps, calls["r0"].revision) == (3, 4, 5)
    assert (calls["r1"].final.v, calls["r1"].steps) == (3, 2)


def test_ordered_merge_is_twelve(spark):
    ten = lambda p, b, c: val(F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a * 10 + x["state"]["v"]))
    g = Graph("fork").add_node(NodeSpec("fork", lambda o, s, c: o.to(s, "a", "b"))).add_node(NodeSpec("a", lambda o, s, c: o.complete_branch(val(s["v"] + 1)))).add_node(NodeSpec("b", lambda o, s, c: o.to(val(s["v"] + 2), "join")))
    g.add_join(JoinSpec("join", "fork", ten)).add_node(NodeSpec("done", end))
    for e in (("fork", "a"), ("fork", "b"), ("b", "join"), ("join", "done")):
        g.add_edge(*e)
    calls = start(spark, g, [0])[2]
    assert calls["r0"].final.v == 12 and calls["r0"].status == "completed"


def fan(line, join, states, last=end, on_error="fail_invocation"):
    """A graph that hands each of ``states`` to ``line``."""

    def begin(o, s, c):
        return o.fan_out(s, F.array(*[o.to_branch("line", val(v)) for v in states]) if states else F.array().cast(f"array<{o.branch}>"))

    g = Graph("go").add_node(NodeSpec("go", begin)).add_node(NodeSpec("line", line, on_error=on_error)).add_edge("go", "line")
    if join:
        g.add_join(join).add_node(NodeSpec("done", last)).add_edge(join.name, "done")
    return g


def test_quorum_two_of_five(spark):
    g = fan(lambda o, s, c: F.when(s["v"] >= 10, o.complete_branch(val(s["v"] + 1))).otherwise(o.to(s, "line2")), JoinSpec("j", "go", ok_sum, quorum=2), [1, 10, 2, 20, 3])
    g.add_node(NodeSpec("line2", lambda o, s, c: o.complete_branch(val(1000)))).add_edge("line", "line2")
    runner, r, calls = start(spark, g, [100])
    assert calls["r0"].final.v == 132
    assert r.position.invocations.count() == 0 and r.position.groups.count() == 0


def test_predicate_and_unmet_quorum(spark):
    met = lambda p, b: F.exists(b, lambda x: (x["status"] == "joined") & (x["state"]["v"] == 200))
    g = fan(lambda o, s, c: F.when(s["v"] == 10, o.to(s, "wait")).otherwise(o.complete_branch(s)), JoinSpec("j", "go", ok_sum, can_merge=met), [10, 200, 30])
    g.add_node(NodeSpec("wait", lambda o, s, c: o.complete_branch(s))).add_edge("line", "wait")
    assert start(spark, g, [50])[2]["r0"].final.v == 250
    g = fan(lambda o, s, c: F.when(s["v"] < 0, o.fail("no")).otherwise(o.complete_branch(s)), JoinSpec("j", "go", ok_sum, quorum=3), [10, -1, 40, -2])
    call = start(spark, g, [100])[2]["r0"]
    assert (call.final.v, call.status) == (150, "completed_with_failures")


def test_dynamic_widths(spark):
    """Any number of children; none and one still go through the merge."""

    def begin(o, s, c):
        kids = F.transform(F.sequence(F.lit(1).cast("bigint"), s["v"]), lambda i: o.to_branch("line", val(i)))
        return o.fan_out(s, F.when(s["v"] > 0, kids).otherwise(F.array().cast(f"array<{o.branch}>")))

    g = Graph("go").add_node(NodeSpec("go", begin)).add_node(NodeSpec("line", lambda o, s, c: o.complete_branch(s))).add_node(NodeSpec("done", end))
    g.add_join(JoinSpec("j", "go", ok_sum)).add_edge("go", "line").add_edge("j", "done")
    widths = [0, 1, 2, 8, 32, 128]
    calls = start(spark, g, widths)[2]
    for k, n in enumerate(widths):
        call = calls[f"r{k}"]
        assert call.final.v == n + n * (n + 1) // 2
        assert (call.steps, call.revision, call.next_id) == (n + 2, n + 4, 6 + 2 * n)


def test_group_failure_removes_the_group(spark):
    g = fan(lambda o, s, c: F.when(s["v"] == 2, o.fail("boom")).otherwise(o.wait(s, "k", "line")), JoinSpec("j", "go", ok_sum), [1, 2, 3], on_error="fail_group")
    g.add_edge("line", "line").register_continuation("k", lambda p: p, lambda o, s, p, c, t: o.to_targets(s, t))
    runner, r, calls = start(spark, g, [0])
    assert calls["r0"].status == "completed_with_failures" and calls["r0"].final is None
    assert r.position.invocations.count() == 0


def test_wait_bad_payload_resume(spark):
    g = Graph("ask").add_node(NodeSpec("ask", lambda o, s, c: o.wait(s, "add", "done"))).add_node(NodeSpec("done", end)).add_edge("ask", "done")
    number = lambda p: F.try_to_number(p.cast("string"), F.lit("999")).cast("bigint")
    g.register_continuation("add", number, lambda o, s, p, c, t: o.to_targets(val(s["v"] + p), t))
    runner, r, calls = start(spark, g, [4, 4, 4, 4])
    assert {c.status for c in calls.values()} == {"waiting"}
    assert [(x.invocation_id, x.call_id) for x in runner.pending(r.position).collect()] == [("i1", "c3")] * 4
    ddl = "run_id string, ordinal int, invocation_id string, call_id string, payload binary"
    rows = [("r0", 0, "i1", "c3", b"5"), ("r1", 0, "i1", "c3", b"bad"), ("r2", 0, "i1", "c2", b"5"), ("r3", 0, "i1", "c3", b"5"), ("r3", 1, "i1", "c3", b"5")]
    out = runner.advance(r.position, spark.createDataFrame(rows, ddl))
    got = {c.run_id: c for c in out.calls.collect()}
    assert got["r0"].final.v == 9 and got["r0"].status == "completed"
    assert got["r1"].status == "waiting" and got["r1"].revision == 2
    assert got["r2"].error == got["r3"].error == "invalid_input"
    again = runner.advance(out.position, spark.createDataFrame([("r1", 0, "i1", "c3", b"7")], ddl))
    assert {c.run_id: c.final.v for c in again.calls.collect() if c.final}["r1"] == 11


def test_options_are_checked():
    for bad in ({"max_steps": -1}, {"max_invocations": -1}, {"failure_override": "never"}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_bad_run_ids(spark):
    g = Graph("n").add_node(NodeSpec("n", end)).compile("d")
    for ids in (["a", "a"], [" a"], [""]):
        with pytest.raises(ValueError):
            Runner(g, S).new(spark.createDataFrame([(i, (1,)) for i in ids], f"run_id string, state {S}"))


def test_budget_stops_and_goes_on(spark):
    g = fan(lambda o, s, c: o.complete_branch(s), JoinSpec("j", "go", ok_sum), [1, 2, 3, 4])
    runner, r, calls = start(spark, g, [0], Options(max_steps=3))
    assert (calls["r0"].status, calls["r0"].budget_reason, calls["r0"].steps) == ("budget_exhausted", "max_steps", 3)
    assert violations(r.position, runner.graph).count() == 0
    done = runner.resume(r.position).calls.first()
    assert (done.status, done.final.v, done.steps) == ("completed", 10, 6)


def test_python_node_and_panic(spark):
    def body(state, call):
        if state["v"] < 0:
            raise ValueError("negative")
        return {"action": "end_execution", "state": {"v": state["v"] + len(call["call_id"])}}

    g = Graph("p").add_node(NodeSpec("p", python=body))
    calls = start(spark, g, [1, -1])[2]
    assert calls["r0"].final.v == 3 and calls["r1"].status == "completed_with_failures"


def test_fork(spark):
    g = Graph("ask").add_node(NodeSpec("ask", lambda o, s, c: o.wait(s, "k", "ask"))).add_edge("ask", "ask").register_continuation("k", lambda p: p, lambda o, s, p, c, t: o.to_targets(s, t))
    runner, r, _ = start(spark, g, [1, 2])
    names = spark.createDataFrame([("r0", "x0"), ("r1", "r1")], "run_id string, new_run_id string")
    pos = runner.fork(r.position, names)
    assert [(x.run_id, x.revision) for x in pos.runs.collect()] == [("x0", 1)]
    assert runner.pending(pos).first().call_id == "c3"
