"""Entry points, stores, deltas, validation and schedule order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta
from ..operators.runner import Result, Runner
from ..operators.schema import FORMAT_VERSION, Position, ident, public_invocations
from ..operators.superstep import Options
from ..operators.validate import stuck, violations
from ..sources.store import ConflictError, MemoryStore, ParquetStore, corrupt, decode, encode
from ..sources.tables import table_path, written
from .populations import BILL, BRANCHES, ORDER, SCOPED, Window, billed, branches, budgeted, held, order_graph, order_runs, scoped, shared

Spark, Dir = SparkSession, str


# --- calls -------------------------------------------------------------------


def start_runs(spark: Spark, d: Dir) -> DataFrame:
    """Revision 1 before any callback: i1 is ready with call c2."""
    pos = Runner(order_graph(BILL).compile("orders-v1"), ORDER).new(order_runs(spark, d))
    rows = public_invocations(pos.invocations).select("run_id", "id", "call_id", "node", "status")
    return rows.join(pos.runs.select("run_id", "revision", "steps", "next_id", "format_version"), "run_id")


START = "SELECT 'o' || o_orderkey AS run_id, 'i1' AS id, 'c2' AS call_id, 'open' AS node, 'ready' AS status, CAST(1 AS BIGINT) AS revision, CAST(0 AS BIGINT) AS steps, CAST(3 AS BIGINT) AS next_id, CAST(9 AS INTEGER) AS format_version FROM orders"


def fork(spark: Spark, d: Dir) -> DataFrame:
    """Active runs under a new id at revision 1; waits keep their calls."""
    runner, r = held(spark, d)
    names = r.position.runs.select("run_id", F.concat(F.lit("copy-"), F.col("run_id")).alias("new_run_id"))
    pos = runner.fork(r.position, names)
    return runner.pending(pos).join(pos.runs.select("run_id", "revision", "next_id"), "run_id").select("run_id", "invocation_id", "call_id", "revision", "next_id")


FORK = """SELECT 'copy-o' || o_orderkey AS run_id, 'i' || (5 + 2 * n) AS invocation_id, 'c' || (7 + 2 * n) AS call_id, CAST(1 AS BIGINT) AS revision, 8 + 2 * n AS next_id
FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"""


def _stored(spark: Spark, d: Dir) -> ParquetStore:
    def make() -> ParquetStore:
        store = ParquetStore(spark, table_path(spark, "store"), ORDER)
        store.create(budgeted(spark, d)[1].position)
        return store

    return shared(spark, d, "store", make)


def recover(spark: Spark, d: Dir) -> DataFrame:
    """Runs that a budget stopped, read back and driven to their end."""
    runner, _ = budgeted(spark, d)
    calls = shared(spark, d, "recovered", lambda: runner.recover(_stored(spark, d))).calls
    return calls.select("run_id", "status", F.col("final.q").alias("q"), F.col("final.trace").alias("trace"), "steps", "revision", "next_id")


_ALL = f"""WITH {BRANCHES}, t AS (SELECT o_orderkey AS k, count(i) AS n, coalesce(bool_or(f = 'R'), false) AS bad, CAST(coalesce(sum(q) FILTER (WHERE f = 'N'), 0) AS BIGINT) AS q,
 coalesce(string_agg(i || ':' || CASE f WHEN 'N' THEN 'J' WHEN 'R' THEN 'F' ELSE 'E' END, ',' ORDER BY i) FILTER (WHERE i IS NOT NULL), '') AS trace FROM orders LEFT JOIN b ON k = o_orderkey GROUP BY 1)"""
RECOVER = f"{_ALL} SELECT 'o' || k AS run_id, CASE WHEN bad THEN 'completed_with_failures' ELSE 'completed' END AS status, q, trace, n + 2 AS steps, n + 4 AS revision, 6 + 2 * n AS next_id FROM t"


def recover_failed(spark: Spark, d: Dir) -> DataFrame:
    """Failed runs come back with their stored failure; nothing runs."""

    def make() -> Result:
        store = MemoryStore()
        store.create(scoped(spark, d).position)
        return Runner(order_graph(BILL, scopes=SCOPED).compile("scoped-None-v1"), ORDER, store).recover()

    calls = shared(spark, d, "recovered-failed", make).calls.where("status = 'failed'")
    return calls.select("run_id", F.concat(F.lit("run failed: "), F.col("failure.node"), F.lit(": "), F.col("failure.message")).alias("error"))


RECOVER_FAILED = "SELECT DISTINCT 'o' || o_orderkey AS run_id, 'run failed: line_fail_execution: returned' AS error FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND l_returnflag = 'R'"


def resume_stale(spark: Spark, d: Dir) -> DataFrame:
    """Positions of which the store holds a later revision are not opened."""

    def make() -> DataFrame:
        runner, r = budgeted(spark, d)
        store = MemoryStore()
        store.create(r.position)
        later = r.position.rows.where(F.substring("run_id", 2, 20).cast("bigint") % 3 == 0)
        store.commit(Position(rows=later.withColumn("revision", F.col("revision") + 1)), later.select("run_id", "revision"))
        opened = Runner(runner.graph, ORDER, store).resume(r.position, options=Options(max_steps=1)).calls
        return written(r.position.runs.select("run_id").join(opened, "run_id", "left_anti"), "stale")

    return shared(spark, d, "stale", make)


def schedule_rotation(spark: Spark, d: Dir) -> DataFrame:
    """Reopening: ready rows in numeric order, beginning after the cursor 9."""
    pos = _position(spark, d)
    runs = pos.runs.withColumn("schedule_cursor", F.lit(9).cast("bigint"))
    rows = Runner.rotated(Position(runs, pos.invocations, pos.groups)).invocations.where("status = 'ready' and group_num > 0")
    return rows.select("run_id", ident("i", F.col("num")).alias("id"), F.col("seq").alias("turn"))


ROTATION = f"WITH {BRANCHES} SELECT 'o' || k AS run_id, 'i' || (5 + 2 * i) AS id, row_number() OVER (PARTITION BY k ORDER BY 5 + 2 * i <= 9, i) AS turn FROM b"


def snapshot_order(spark: Spark, d: Dir) -> DataFrame:
    """Snapshots sort ids as text: i1, i11, i13, i5."""
    rows = public_invocations(held(spark, d)[1].position.invocations)
    return rows.select("run_id", "id", F.row_number().over(Window.partitionBy("run_id").orderBy("id")).cast("bigint").alias("place"))


SNAPSHOT = f"""WITH {BRANCHES}, n AS (SELECT o_orderkey AS k, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
r AS (SELECT k, 'i' || (5 + 2 * i) AS id FROM b UNION ALL SELECT k, 'i' || (5 + 2 * n) FROM n UNION ALL SELECT k, 'i1' FROM n)
SELECT 'o' || k AS run_id, id, row_number() OVER (PARTITION BY k ORDER BY id) AS place FROM r"""


# --- stores ------------------------------------------------------------------


def _listed(pos: Position) -> DataFrame:
    return public_invocations(pos.invocations).select("run_id", "id", "call_id", "node", "status", "group_id", "branch_index", F.col("state.q").alias("q"))


_BUDGETED = f"""WITH {BRANCHES}, c AS (SELECT k, count(*) AS n FROM b GROUP BY k HAVING count(*) >= 2), k AS (SELECT b.*, n FROM b JOIN c USING (k)),
rows AS (SELECT 'o' || k AS run_id, 'i' || (5 + 2 * i) AS id, CASE WHEN i < 2 THEN '' ELSE 'c' || (6 + 2 * i) END AS call_id, CASE WHEN i < 2 AND f = 'N' THEN 'bill' ELSE 'line' END AS node,
 CASE WHEN i >= 2 THEN 'ready' WHEN f = 'N' THEN 'joined' WHEN f = 'R' THEN 'failed' ELSE 'ended' END AS status, 'g3' AS group_id, CAST(i AS INTEGER) AS branch_index, q FROM k WHERE n > 2
UNION ALL SELECT 'o' || k, 'i1', '', 'open', 'group', '', 0, NULL FROM c WHERE n > 2
UNION ALL SELECT 'o' || k, 'i1', 'c9' || '', 'done', 'ready', '', 0, CAST(coalesce(sum(q) FILTER (WHERE f = 'N'), 0) AS BIGINT) FROM k WHERE n = 2 GROUP BY k)
SELECT run_id, id, CASE WHEN node = 'done' THEN 'c9' ELSE call_id END AS call_id, node, status, group_id, branch_index, q FROM rows"""


def store_durable_roundtrip(spark: Spark, d: Dir) -> DataFrame:
    return _listed(_stored(spark, d).load())


def store_memory_roundtrip(spark: Spark, d: Dir) -> DataFrame:
    store = MemoryStore()
    store.create(budgeted(spark, d)[1].position)
    return _listed(store.load())


def load_header(spark: Spark, d: Dir) -> DataFrame:
    return _stored(spark, d).load_header().select("run_id", "definition_id", "revision", "steps", "completed")


HEADER = f"""{_ALL} SELECT 'o' || k AS run_id, 'budgeted-v1' AS definition_id, CASE WHEN n < 2 THEN n + 4 WHEN n = 2 THEN 5 ELSE 4 END AS revision, CASE WHEN n < 2 THEN n + 2 ELSE 3 END AS steps, n < 2 AS completed FROM t"""


def store_delete(spark: Spark, d: Dir) -> DataFrame:
    """Every tenth order's run is deleted; its rows go with it."""
    store = MemoryStore()
    store.create(budgeted(spark, d)[1].position)
    store.delete(store.load_header().where(F.substring("run_id", 2, 20).cast("bigint") % 10 == 0).select("run_id"))
    left = store.load()
    rows = left.invocations.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"))
    return left.runs.join(rows, "run_id", "left").select("run_id", F.coalesce("rows", F.lit(0)).alias("rows"))


DELETE = f"{_ALL} SELECT 'o' || k AS run_id, CASE WHEN n < 2 THEN 0 WHEN n = 2 THEN 1 ELSE n + 1 END AS rows FROM t WHERE k % 10 <> 0"


def cas_conflict(spark: Spark, d: Dir) -> DataFrame:
    """A commit that expects a revision too low for a fifth of the runs writes
    nothing and names them."""
    store = _stored(spark, d)
    runs, head = store.load_header(), store.head()
    wrong = F.substring("run_id", 2, 20).cast("bigint") % 5 == 0
    expected = runs.select("run_id", (F.col("revision") - wrong.cast("int")).alias("revision"))
    try:
        store.commit(store.load(), expected)
    except ConflictError:
        refused = store.head() == head
    else:
        refused = False
    rows = delta.conflicts(store.load_header(), expected.withColumnRenamed("revision", "expected"))
    return rows.where(F.lit(refused)).select("run_id", (F.col("stored") - F.col("expected")).alias("behind"))


def codec_json_roundtrip(spark: Spark, d: Dir) -> DataFrame:
    """State to JSON text and back; null fields stay null."""
    rows = order_runs(spark, d).select("run_id", encode(F.col("state")).alias("text")).select("run_id", decode(F.col("text"), ORDER).alias("s"))
    return rows.select("run_id", F.col("s.key").alias("key"), F.col("s.q").alias("q"), F.size("s.kids").alias("kids"), F.aggregate("s.kids", F.lit(0).cast("bigint"), lambda a, x: a + x["q"]).alias("total"))


CODEC = "SELECT 'o' || o_orderkey AS run_id, o_orderkey AS key, CAST(NULL AS BIGINT) AS q, CAST(count(l_orderkey) AS INTEGER) AS kids, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"


def clone_json_roundtrip(spark: Spark, d: Dir) -> DataFrame:
    """A JSON copy of a state equals it."""
    rows = order_runs(spark, d).select("run_id", "state", decode(encode(F.col("state")), ORDER).alias("copy"))
    return rows.select("run_id", F.col("state").eqNullSafe(F.col("copy")).alias("same"))


def corrupt_detect(spark: Spark, d: Dir) -> DataFrame:
    """Each seventh state text has lost its end."""
    text = encode(F.col("state"))
    broken = F.substring("run_id", 2, 20).cast("bigint") % 7 == 0
    rows = order_runs(spark, d).select("run_id", F.when(broken, F.substring(text, F.lit(1), F.length(text) - 5)).otherwise(text).alias("text"))
    return corrupt(rows, "text", ORDER).select("run_id")


# --- deltas ------------------------------------------------------------------


def _versions(spark: Spark, d: Dir) -> tuple[DataFrame, DataFrame]:
    """Before: all branches but those of flag N at odd places; after: all but
    those of flag R, with quantities of even places raised."""
    b = branches(spark, d)
    before = b.where("not (f = 'N' and i % 2 = 1)")
    after = b.where("f <> 'R'").withColumn("q", F.when(F.col("i") % 2 == 0, F.col("q") + 1).otherwise(F.col("q")))
    return before, after


_VERSIONS = f"WITH {BRANCHES}, x AS (SELECT * FROM b WHERE NOT (f = 'N' AND i % 2 = 1)), y AS (SELECT k, i, CASE WHEN i % 2 = 0 THEN q + 1 ELSE q END AS q, f FROM b WHERE f <> 'R')"


def delta_diff(spark: Spark, d: Dir) -> DataFrame:
    upserts, deletes = delta.diff(*_versions(spark, d), ["k", "i"])
    return upserts.select("k", F.col("i").cast("bigint").alias("i"), "q", F.lit("upsert").alias("kind")).unionByName(deletes.select("k", F.col("i").cast("bigint").alias("i"), F.lit(None).cast("bigint").alias("q"), F.lit("delete").alias("kind")))


DIFF = f"""{_VERSIONS} SELECT y.k, y.i, y.q, 'upsert' AS kind FROM y LEFT JOIN x ON x.k = y.k AND x.i = y.i WHERE x.k IS NULL OR x.q <> y.q OR x.f <> y.f
UNION ALL SELECT x.k, x.i, NULL, 'delete' FROM x LEFT JOIN y ON x.k = y.k AND x.i = y.i WHERE y.k IS NULL"""


def delta_apply(spark: Spark, d: Dir) -> DataFrame:
    before, after = _versions(spark, d)
    upserts, deletes = delta.diff(before, after, ["k", "i"])
    return delta.apply(before, upserts, deletes, ["k", "i"]).select("k", F.col("i").cast("bigint").alias("i"), "q", "f")


def change_invalid(spark: Spark, d: Dir) -> DataFrame:
    """Changes made from the orders, each with at most a few faults."""
    k = F.substring("run_id", 2, 20).cast("bigint")
    runs = billed(spark, d)[1].position.runs.where(k % 7 != 6)
    one = lambda cond, a, b: F.when(cond, a).otherwise(b)
    changes = runs.select(
        "run_id", one(k % 7 == 0, F.lit(" padded"), F.col("definition_id")).alias("definition_id"), F.lit(FORMAT_VERSION).alias("format_version"), (F.col("revision") - 1 - (k % 7 == 1).cast("int")).alias("expected"), "revision",
        one(k % 7 == 2, F.lit(False), F.lit(True)).alias("completed"), F.lit(True).alias("has_final"), (k % 7 == 3).alias("has_failure"),
        one(k % 7 == 4, F.array(F.lit("i1"), F.lit("i1")), F.array().cast("array<string>")).alias("upserts"), one(k % 7 == 4, F.array(F.lit("i1")), F.array().cast("array<string>")).alias("deletes"),
    )
    return delta.change_violations(changes)


CHANGE = """SELECT 'o' || o_orderkey AS run_id, r.rule FROM orders JOIN (VALUES (0, 'names'), (1, 'revision'), (2, 'final'), (3, 'final_and_failure'), (4, 'completed_upserts'), (4, 'duplicate_upsert'), (4, 'upsert_and_delete')) r(m, rule) ON o_orderkey % 7 = r.m"""


def advance_invalid(spark: Spark, d: Dir) -> DataFrame:
    k = F.substring("run_id", 2, 20).cast("bigint")
    before = budgeted(spark, d)[1].position.runs.drop("final", "failure").withColumn("had_local_failures", F.lit(True))
    after = before.withColumns({
        "definition_id": F.when(k % 5 == 0, F.lit("other-v1")).otherwise(F.col("definition_id")), "steps": F.col("steps") - (k % 5 == 1).cast("int"), "next_id": F.col("next_id") - (k % 5 == 2).cast("int"), "had_local_failures": k % 5 != 3,
    })
    return delta.advance_violations(before, after)


ADVANCE_INVALID = f"""{_ALL} SELECT 'o' || k AS run_id, r.rule FROM t JOIN (VALUES (0, 'identity'), (1, 'steps'), (2, 'next_id'), (3, 'failures_cleared')) r(m, rule) ON k % 5 = r.m
UNION ALL SELECT 'o' || k, 'terminal' FROM t WHERE n < 2"""


# --- validation --------------------------------------------------------------


def _position(spark: Spark, d: Dir) -> Position:
    """Orders right after their fan-out, all lines ready."""

    def make() -> Position:
        return Runner(order_graph(BILL).compile("orders-v1"), ORDER).start(order_runs(spark, d), Options(max_steps=1)).position

    return shared(spark, d, "opened", make)


def validate_ok(spark: Spark, d: Dir) -> DataFrame:
    """Positions that calls leave break no rule."""
    graph = order_graph(BILL).compile("orders-v1")
    bad = violations(_position(spark, d), graph).select("run_id").distinct().withColumn("bad", F.lit(True))
    return _position(spark, d).runs.join(bad, "run_id", "left").select("run_id", F.col("bad").isNull().alias("sound"))


def _damaged(spark: Spark, d: Dir) -> Position:
    pos = _position(spark, d)
    k = F.substring("run_id", 2, 20).cast("bigint")
    runs = pos.runs.withColumn("format_version", F.when(k % 11 == 0, F.lit(8)).otherwise(F.col("format_version")))
    first = (F.col("group_num") > 0) & (F.col("branch_index") == 0)
    rows = pos.invocations.withColumns({
        "node": F.when((k % 11 == 1) & first, F.lit("nowhere")).otherwise(F.col("node")),
        "call": F.when((k % 11 == 2) & first, F.lit(None)).otherwise(F.col("call")),
        "num": F.when((k % 11 == 3) & first, F.lit(10**6)).otherwise(F.col("num")),
        "status": F.when((k % 11 == 4) & first, F.lit("lost")).otherwise(F.col("status")),
        "entry_timeout_ns": F.when((k % 11 == 5) & first, F.lit(-1)).otherwise(F.col("entry_timeout_ns")),
    })
    rows = rows.where(~((k % 11 == 6) & first))
    groups = pos.groups.withColumn("source", F.when(k % 11 == 7, F.lit("line")).otherwise(F.col("source")))
    return Position(runs, rows, groups)


def validate_bad(spark: Spark, d: Dir) -> DataFrame:
    bad = violations(_damaged(spark, d), order_graph(BILL).compile("orders-v1")).where("rule <> 'stuck'")
    return bad.select("run_id", "rule").distinct()


BAD = f"""{_ALL} SELECT 'o' || k AS run_id, r.rule FROM t JOIN (VALUES (0, 0, 'header_format'), (1, 1, 'node'), (2, 1, 'call'), (3, 1, 'id_range'), (4, 1, 'status'), (4, 1, 'resolved_call'), (5, 1, 'entry_timeout'), (6, 2, 'group_index'), (7, 1, 'group_source'), (7, 1, 'group_join')) r(m, least, rule)
ON k % 11 = r.m AND t.n >= r.least"""


def stuck_runs(spark: Spark, d: Dir) -> DataFrame:
    """Every ninth run has lost all its places in the schedule."""
    pos = _position(spark, d)
    k = F.substring("run_id", 2, 20).cast("bigint")
    rows = pos.invocations.withColumn("status", F.when((k % 9 == 0) & (F.col("status") == "ready"), F.lit("group")).otherwise(F.col("status")))
    return stuck(Position(pos.runs, rows, pos.groups))


STUCK = "SELECT 'o' || o_orderkey AS run_id FROM orders WHERE o_orderkey % 9 = 0"

QUERIES = {f.__name__: f for f in (
    start_runs, fork, recover, recover_failed, resume_stale, schedule_rotation, snapshot_order, store_durable_roundtrip, store_memory_roundtrip, load_header, store_delete, cas_conflict, codec_json_roundtrip, clone_json_roundtrip, corrupt_detect,
    delta_diff, delta_apply, change_invalid, advance_invalid, validate_ok, validate_bad, stuck_runs,
)}
SQL = {
    "start_runs": START, "fork": FORK, "recover": RECOVER, "recover_failed": RECOVER_FAILED, "resume_stale": "SELECT 'o' || o_orderkey AS run_id FROM orders WHERE o_orderkey % 3 = 0", "schedule_rotation": ROTATION, "snapshot_order": SNAPSHOT,
    "store_durable_roundtrip": _BUDGETED, "store_memory_roundtrip": _BUDGETED, "load_header": HEADER, "store_delete": DELETE, "cas_conflict": "SELECT 'o' || o_orderkey AS run_id, CAST(1 AS BIGINT) AS behind FROM orders WHERE o_orderkey % 5 = 0",
    "codec_json_roundtrip": CODEC, "clone_json_roundtrip": "SELECT 'o' || o_orderkey AS run_id, true AS same FROM orders", "corrupt_detect": "SELECT 'o' || o_orderkey AS run_id FROM orders WHERE o_orderkey % 7 = 0", "delta_diff": DIFF,
    "delta_apply": f"{_VERSIONS} SELECT k, i, q, f FROM y", "change_invalid": CHANGE, "advance_invalid": ADVANCE_INVALID, "validate_ok": "SELECT 'o' || o_orderkey AS run_id, true AS sound FROM orders", "validate_bad": BAD, "stuck_runs": STUCK,
}
