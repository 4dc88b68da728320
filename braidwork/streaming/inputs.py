"""Answers to waits that arrive as a stream.

Each micro-batch is one call of ``Runner.advance`` over the stored runs that it
addresses; an answer that came before (same run, invocation and call) is dropped
by the stream's own state, so replays do no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators.runner import Result, Runner
from ..operators.schema import Position, ident
from ..operators.superstep import Options
from ..sources.store import Store
from ..sources.tables import written


def answer(runner: Runner, store: Store, inputs: DataFrame, options: Options | None = None) -> DataFrame:
    """Answer one batch: load the runs it addresses, advance, commit; gives the
    calls' results."""
    ids = inputs.select("run_id").distinct()
    before = Position(rows=written(store.load(ids).rows, "addressed"))
    order = Window.partitionBy("run_id").orderBy("ordinal", "invocation_id", "call_id")
    result = runner.advance(before, inputs.withColumn("ordinal", F.row_number().over(order) - 1), options)
    store.commit(result.position, before.runs.select("run_id", "revision"))
    return result.calls


def answer_stream(runner: Runner, store: Store, inputs: DataFrame, checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """``inputs`` is a stream of run_id, ordinal, invocation_id, call_id, payload."""
    once = inputs.dropDuplicates(["run_id", "invocation_id", "call_id"])

    def batch(df: DataFrame, _: int) -> None:
        held = df.persist()
        if held.limit(1).take(1):
            answer(runner, store, held, options)
        held.unpersist()

    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def effects(runner: Runner, pos: Position, key: str, delta: Callable[[Column], Column], options: Options | None = None) -> tuple[Result, DataFrame]:
    """Runs that wait under the continuation ``key`` for an effect: the ledger
    takes ``delta(state)`` once for each call, and its values answer the waits.
    A run is a namespace of its own; calls count in the order of their ids."""
    waits = pos.invocations.where((F.col("status") == "waiting") & (F.col("continuation") == key))
    asked = waits.select(F.col("run_id").alias("namespace"), "run_id", ident("i", F.col("num")).alias("invocation_id"), ident("c", F.col("call")).alias("call_id"), delta(F.col("state")).cast("bigint").alias("delta"), F.col("call").alias("seq"))
    got = receipts(asked.drop("invocation_id"))
    answers = asked.join(got.select("run_id", "call_id", "value"), ["run_id", "call_id"])
    inputs = answers.select("run_id", F.col("seq").alias("ordinal"), "invocation_id", "call_id", F.col("value").cast("string").cast("binary").alias("payload"))
    return runner.advance(pos, inputs, options), got


def receipts(effects: DataFrame) -> DataFrame:
    """The effect ledger: ``namespace, run_id, call_id, delta, seq`` to receipts.

    The first delta under a key counts; a replay gets the value it got then; a
    replay with another delta is a conflict. The running value is one window a
    namespace over first receipts only.
    """
    key = Window.partitionBy("namespace", "run_id", "call_id").orderBy("seq")
    rows = effects.withColumn("first_seq", F.first("seq").over(key)).withColumn("first_delta", F.first("delta").over(key))
    once = rows.where("seq = first_seq")
    value = F.sum("delta").over(Window.partitionBy("namespace").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    once = once.select("namespace", "run_id", "call_id", value.alias("value"))
    rows = rows.join(once, ["namespace", "run_id", "call_id"])
    same = F.col("delta") == F.col("first_delta")
    return rows.select("namespace", "run_id", "call_id", "seq", "delta", F.when(same, F.col("value")).alias("value"), (~same).alias("conflict"), (F.col("seq") != F.col("first_seq")).alias("replayed"))
