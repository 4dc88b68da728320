"""The store contract on both stores, the stream of answers and the ledger."""

import pytest
from pyspark.sql import functions as F

from braidwork.operators.delta import conflicts
from braidwork.operators.observe import ObservedStore, Session
from braidwork.operators.runner import Runner
from braidwork.plans import Graph, NodeSpec
from braidwork.sources.store import ConflictError, CorruptError, MemoryStore, NotFoundError, ParquetStore
from braidwork.streaming.inputs import answer_stream, receipts

S = "struct<v:bigint>"
ANSWER = "run_id string, ordinal int, invocation_id string, call_id string, payload binary"


def waiting(spark, n=3):
    g = Graph("ask").add_node(NodeSpec("ask", lambda o, s, c: o.wait(s, "add", "done"))).add_node(NodeSpec("done", lambda o, s, c: o.end_execution(s))).add_edge("ask", "done")
    number = lambda p: F.try_to_number(p.cast("string"), F.lit("999")).cast("bigint")
    g.register_continuation("add", number, lambda o, s, p, c, t: o.to_targets(F.struct((s["v"] + p).alias("v")), t))
    runner = Runner(g.compile("store-v1"), S)
    return runner, runner.start(spark.createDataFrame([(f"r{k}", (k,)) for k in range(n)], f"run_id string, state {S}")).position


@pytest.mark.parametrize("kind", ["memory", "parquet"])
def test_contract(spark, tmp_path, kind):
    runner, pos = waiting(spark)
    store = MemoryStore() if kind == "memory" else ParquetStore(spark, str(tmp_path / "store"), S)
    with pytest.raises(NotFoundError):
        store.load()
    store.create(pos)
    with pytest.raises(ConflictError):
        store.create(pos)
    assert "final" not in store.load_header().columns and store.load_header().count() == 3
    result = runner.recover(store, inputs=spark.createDataFrame([("r1", 0, "i1", "c3", b"5")], ANSWER))
    store.commit(result.position, pos.runs.select("run_id", "revision"))
    head = {r.run_id: (r.revision, r.completed) for r in store.load_header().collect()}
    assert head == {"r0": (2, False), "r1": (4, True), "r2": (2, False)}
    with pytest.raises(ConflictError):
        store.commit(result.position, pos.runs.select("run_id", "revision"))
    one = spark.createDataFrame([("r0",)], "run_id string")
    store.delete(one)
    with pytest.raises(NotFoundError):
        store.delete(one)
    assert sorted(r.run_id for r in store.load().runs.collect()) == ["r1", "r2"]
    assert sorted(r.run_id for r in store.load().invocations.collect()) == ["r2"]


def test_parquet_store_is_exclusive_and_checks_its_schema(spark, tmp_path):
    _, pos = waiting(spark, 1)
    store = ParquetStore(spark, str(tmp_path / "store"), S)
    store.create(pos)
    with pytest.raises(ConflictError):
        store._claim(1, {})
    with pytest.raises(CorruptError):
        ParquetStore(spark, str(tmp_path / "store"), "struct<w:bigint>").load()


def test_answers_as_a_stream(spark, tmp_path):
    runner, pos = waiting(spark, 4)
    store = MemoryStore()
    store.create(pos)
    rows = [(f"r{k}", 0, "i1", "c3", str(k * 10).encode()) for k in range(3)]
    spark.createDataFrame(rows + rows, ANSWER).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(ANSWER).parquet(str(tmp_path / "in"))
    answer_stream(runner, store, source, str(tmp_path / "checkpoint")).awaitTermination()
    final = {r.run_id: r.final.v for r in store.load().runs.where("completed").collect()}
    assert final == {"r0": 0, "r1": 11, "r2": 22}
    assert store.load_header().where("not completed").count() == 1


def test_ledger(spark):
    rows = [("n", "r", "c1", 5, 1), ("n", "r", "c2", 7, 2), ("n", "r", "c1", 5, 3), ("n", "r", "c1", 6, 4), ("m", "r", "c1", 1, 5)]
    got = {r.seq: (r.value, r.conflict, r.replayed) for r in receipts(spark.createDataFrame(rows, "namespace string, run_id string, call_id string, delta long, seq long")).collect()}
    assert got == {1: (5, False, False), 2: (12, False, False), 3: (5, False, True), 4: (None, True, True), 5: (1, False, False)}


def test_observer_faults_stay_outside(spark):
    def broken(event):
        raise RuntimeError("observer")

    store = ObservedStore(MemoryStore(), Session(broken))
    with pytest.raises(NotFoundError):
        store.load()
    log = []
    store = ObservedStore(MemoryStore(), Session(log.append))
    store.create(waiting(spark, 1)[1])
    assert [(e["operation"], e["phase"]) for e in log] == [("create", "started"), ("create", "finished")]


def test_commits_gather_no_runs_on_the_driver(spark):
    """A few columns of many runs pass for a small table: nothing is joined to
    find what moved, and joins by run are not broadcast."""

    class Kept(MemoryStore):
        def commit(self, pos, expected):
            self.plan = pos.rows._jdf.queryExecution().executedPlan().toString()
            super().commit(pos, expected)

    runner, pos = waiting(spark)
    store = Kept()
    store.create(pos)
    inputs = spark.createDataFrame([("r1", 0, "i1", "c3", b"5")], ANSWER)
    calls = Runner(runner.graph, S, store).recover(inputs=inputs).calls.collect()
    assert {r.run_id: r.status for r in calls} == {"r0": "waiting", "r1": "completed", "r2": "waiting"}
    assert {r.run_id: r.revision for r in store.load_header().collect()} == {"r0": 2, "r1": 4, "r2": 2}
    assert "Join" not in store.plan
    behind = conflicts(store.load_header(), pos.runs.select("run_id", F.col("revision").alias("expected")))
    for frame in (behind, store.load().rows):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [r.run_id for r in behind.collect()] == ["r1"]
