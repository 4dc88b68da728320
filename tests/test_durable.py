"""Calls that commit as they go: crashes, lost acknowledgements, layers, limits."""

import time

import pytest
from pyspark.sql import functions as F

from braidwork.functions.responses import response_schema
from braidwork.operators.runner import AmbiguousCommitError, Runner
from braidwork.operators.superstep import Cancellation, Limiter, Options
from braidwork.plans import Graph, JoinSpec, NodeSpec
from braidwork.sources.store import ConflictError, LayeredStore, MemoryStore, ParquetStore

S = "struct<v:bigint>"


def val(x):
    return F.struct(x.cast("bigint").alias("v"))


def loop(last=3):
    g = Graph("n").add_node(NodeSpec("n", lambda o, s, c: F.when(s["v"] >= last, o.end_execution(s)).otherwise(o.to(val(s["v"] + 1), "n")))).add_edge("n", "n")
    return g.compile("loop-v1")


def runs(spark, *states):
    return spark.createDataFrame([(f"r{k}", (v,)) for k, v in enumerate(states)], f"run_id string, state {S}")


class Failing(LayeredStore):
    """A store that loses its process at one commit, before or after it is done."""

    def __init__(self, store, at, done):
        self.store, self.at, self.done, self.commits = store, at, done, 0
        self.create, self.load, self.load_header, self.delete = store.create, store.load, store.load_header, store.delete

    def commit(self, pos, expected):
        self.commits += 1
        if self.commits != self.at:
            return self.store.commit(pos, expected)
        if self.done:
            self.store.commit(pos, expected)
        raise RuntimeError("the connection is gone")


def test_a_crash_leaves_the_last_commit_and_recovery_goes_on(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "store"), S)
    with pytest.raises(AmbiguousCommitError):
        Runner(loop(), S, Failing(store, 3, done=False)).start(runs(spark, 0, 2))
    head = {r.run_id: (r.revision, r.completed) for r in store.load_header().collect()}
    assert head == {"r0": (3, False), "r1": (3, True)}
    calls = {r.run_id: r for r in Runner(loop(), S, store).recover().calls.collect()}
    assert {k: (c.status, c.final.v, c.revision) for k, c in calls.items()} == {"r0": ("completed", 3, 5), "r1": ("completed", 3, 3)}
    assert {r.run_id: r.revision for r in store.load_header().collect()} == {"r0": 5, "r1": 3}
    assert len(store._entry(store.head())["layers"]) == 5  # one for each superstep, of the runs that moved
    assert [t.count() for t in store._layers()] == [2, 2, 2, 1, 1]
    store.compact()
    store.vacuum(keep=1)
    assert len(store._layers()) == 1 and store.load().runs.count() == 2


def test_a_lost_acknowledgement_is_looked_up(spark):
    store = MemoryStore()
    calls = Runner(loop(), S, Failing(store, 2, done=True)).start(runs(spark, 0)).calls.first()
    assert (calls.status, calls.final.v) == ("completed", 3) and store.load_header().first().revision == 5


def test_two_callers_of_one_run_are_in_conflict(spark, tmp_path):
    store = ParquetStore.open(spark, str(tmp_path / "store"), S)
    runner = Runner(loop(), S, store)
    pos = runner.start(runs(spark, 0), Options(max_steps=1)).position
    assert runner.resume(pos).calls.first().status == "completed"
    assert runner.resume(pos).calls.count() == 0  # stale
    with pytest.raises(ConflictError):
        runner.advance(pos)
    with pytest.raises(FileNotFoundError):
        ParquetStore.open(spark, str(tmp_path / "no" / "store"), S)


def test_a_late_call_fails_only_its_own_row(spark):
    def body(state, call):
        if state["v"] == 0:
            time.sleep(4)
        return {"action": "end_execution", "state": {"v": state["v"]}}

    g = Graph("p").add_node(NodeSpec("p", python=body, timeout_ns=1_500_000_000))
    calls = Runner(g.compile("late"), S).start(runs(spark, *range(8)).coalesce(1)).calls.collect()
    assert sorted((c.run_id, c.status) for c in calls) == [("r0", "completed_with_failures"), *[(f"r{k}", "completed") for k in range(1, 8)]]


def test_a_batch_callback_gets_all_rows(spark):
    def body(states, calls):
        return [{"action": "end_execution", "state": {"v": s["v"] + len(states) * 0 + 1}} for s in states]

    g = Graph("p").add_node(NodeSpec("p", python=body, batch=True))
    assert sorted(c.final.v for c in Runner(g.compile("batch"), S).start(runs(spark, 1, 2, 3)).calls.collect()) == [2, 3, 4]


def test_a_merge_can_be_late(spark):
    total = lambda p, b, c: p
    g = Graph("go").add_node(NodeSpec("go", lambda o, s, c: o.to(s, "a", "b"))).add_join(JoinSpec("j", "go", total, timeout_ns=5, elapsed=lambda p, b: p["v"]))
    for n in ("a", "b"):
        g.add_node(NodeSpec(n, lambda o, s, c: o.complete_branch(s))).add_edge("go", n)
    calls = {c.run_id: c.status for c in Runner(g.compile("merge"), S).start(runs(spark, 5, 6)).calls.collect()}
    assert calls == {"r0": "completed", "r1": "completed_with_failures"}


def test_a_canceled_call_keeps_its_position(spark):
    cancel = Cancellation(spark)
    runner = Runner(loop(), S, cancel=cancel, limiter=Limiter(2))
    cancel.cancel()
    result = runner.start(runs(spark, 0))
    call = result.calls.first()
    assert (call.status, call.error, call.revision, call.completed) == ("canceled", "canceled", 1, False)
    assert Runner(loop(), S).advance(result.position, options=Options(max_concurrency=1)).calls.first().final.v == 3
    with pytest.raises(ValueError):
        Limiter(0)


def test_answer_schemas():
    assert response_schema("search", [])["required"] == ["text"]
    planner = response_schema("planner", ["m1", "m2"])
    assert planner["required"] == ["text", "assignments"] and planner["additionalProperties"] is False
    assert planner["properties"]["assignments"]["items"]["properties"]["model_id"]["enum"] == ["m1", "m2"]
    for role, models in (("lead", []), ("chief", ["m"])):
        with pytest.raises(ValueError):
            response_schema(role, models)
