"""Python nodes: the second choice, opaque to the optimizer.

A callback maps a state and call (dicts) to an outcome dict; one with ``batch``
gets lists of both and gives a list. It runs in Arrow batches on the executors;
an exception becomes a failure with its traceback. Spark may run a task again,
so an effectful callback should use the call id as its idempotency key.
"""

from __future__ import annotations

import json
import threading
import traceback
from queue import Empty, SimpleQueue

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..plans.graph import Compiled
from .schema import DEADLINE


def evaluate_python(rows, graph: Compiled, outcome: str):
    """Fill ``ready_outs`` of those in ``ready`` whose node has a Python
    callback; ``rows`` is the steps to a table."""
    nodes = {n: (s.python, s.timeout_ns, s.batch) for n, s in graph.nodes.items() if s.python}

    @F.pandas_udf(ArrayType(StringType()))
    def call(asked: pd.Series) -> pd.Series:
        flat = [json.loads(t) for texts in asked for t in texts]
        results, worker = [None] * len(flat), _Worker()
        for name, (function, limit, batch) in nodes.items():
            own = [k for k, t in enumerate(flat) if t["node"] == name]
            if batch and own:
                for k, result in zip(own, _batch(function, [flat[k] for k in own]), strict=True):
                    results[k] = result
            for k in [] if batch else own:
                results[k] = worker.run(function, flat[k], flat[k].get("limit") or limit)
        out, at = [], 0
        for texts in asked:
            out.append(results[at : at + len(texts)])
            at += len(texts)
        return pd.Series(out, dtype=object)

    info = lambda x, i: F.struct("run_id", F.concat(F.lit("i"), x["num"]).alias("invocation_id"), F.concat(F.lit("c"), x["call"]).alias("call_id"), x["node"].alias("node"), (F.col("steps") + i + 1).alias("step"), x["branch_index"].alias("branch_index"))
    one = lambda x, i: F.to_json(F.struct(x["node"].alias("node"), x["state"].alias("state"), info(x, i).alias("call"), x["entry_timeout_ns"].alias("limit")))
    rows = rows.withColumn("answers", call(F.transform("ready", one)))
    both = F.arrays_zip("ready", "ready_outs", "answers")
    out = lambda z: F.when(z["ready"]["node"].isin(*nodes), F.from_json(z["answers"], outcome)).otherwise(z["ready_outs"])
    return rows.withColumn("ready_outs", F.transform(both, out)).drop("answers")


def _fail(error: str) -> str:
    return json.dumps({"action": "fail", "error": error})


def _one(function, task: dict) -> str:
    try:
        return json.dumps(function(task.get("state"), task["call"]))
    except Exception as e:
        return _fail(f"panic: {e}\n{traceback.format_exc()}")


def _batch(function, tasks: list[dict]) -> list[str]:
    """Outcomes of one call over many tasks; if it raises, all of them fail."""
    try:
        results = list(function([t.get("state") for t in tasks], [t["call"] for t in tasks]))
        if len(results) != len(tasks):
            raise ValueError(f"{len(results)} outcomes for {len(tasks)} calls")
        return [json.dumps(r) for r in results]
    except Exception as e:
        return [_fail(f"panic: {e}\n{traceback.format_exc()}")] * len(tasks)


class _Worker:
    """A thread that runs calls with a limit, each timed from its own start. A
    late call keeps its thread, which is left behind, and the next call gets a
    fresh one."""

    def __init__(self) -> None:
        self.todo: SimpleQueue | None = None

    def run(self, function, task: dict, limit_ns: int) -> str:
        if not limit_ns:
            return _one(function, task)
        if self.todo is None:
            self.todo, self.done = SimpleQueue(), SimpleQueue()
            threading.Thread(target=self._work, args=(self.todo, self.done), daemon=True).start()
        self.todo.put((function, task))
        try:
            return self.done.get(timeout=limit_ns / 1e9)
        except Empty:
            self.todo.put(None)
            self.todo = None
            return _fail(DEADLINE)

    @staticmethod
    def _work(todo: SimpleQueue, done: SimpleQueue) -> None:
        while (job := todo.get()) is not None:
            done.put(_one(*job))
