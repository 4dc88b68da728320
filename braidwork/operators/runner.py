"""Entry points: start, advance, resume, recover and fork many runs at once."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.graph import Compiled
from ..sources.store import ConflictError, Store
from ..sources.tables import merged, written
from .observe import Session
from .schema import FORMAT_VERSION, GROUPS_DDL, HEADER, INVOCATION, Position, by_number, fields_of, invocations_ddl, public_invocations, runs_ddl, valid_name
from .superstep import SUPERSTEP, Cancellation, Engine, Items, Limiter, Options


@dataclass
class Result:
    """Where a call left its runs. ``calls`` has a row for each run: status,
    revision, steps, final, failure, and why the call stopped short."""

    position: Position
    calls: DataFrame


def status_of(completed: Column, failed: Column, local: Column, stop: Column) -> Column:
    return (
        F.when(stop == "max_invocations", F.lit("budget_exhausted"))
        .when(stop.isNotNull() & (stop != "max_steps"), F.when(stop.isin("interrupted", "canceled"), stop).when(stop == "decode", F.lit("waiting")).otherwise(F.lit("failed")))
        .when(completed & failed, F.lit("failed"))
        .when(completed & local, F.lit("completed_with_failures"))
        .when(completed, F.lit("completed"))
        .when(stop == "max_steps", F.lit("budget_exhausted"))
        .otherwise(F.lit("waiting"))
    )


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt by run to as many parts as a shuffle or the cluster has, so
    that the projections that follow keep all cores busy."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, "run_id")


class AmbiguousCommitError(RuntimeError):
    """A commit failed and the store holds neither what was before nor after it."""


class Runner:
    """Drives runs of one compiled graph whose state has the type ``state``.

    With a ``store``, ``start`` creates the runs there and every superstep is
    committed under the revisions that it began at, before the next one begins.
    ``observer`` gets the events of calls and the counters of supersteps;
    ``limiter`` bounds the tasks that run at once, ``cancel`` can stop a call.
    """

    def __init__(self, graph: Compiled, state: str, store: Store | None = None, observer: Callable[[dict], None] | None = None, limiter: Limiter | None = None, cancel: Cancellation | None = None):
        self.graph, self.state, self.store, self.limiter, self.cancel = graph, state, store, limiter, cancel
        self.session = Session(observer) if observer else None

    # --- opening --------------------------------------------------------------

    def new(self, runs: DataFrame) -> Position:
        """``runs (run_id, state)`` at revision 1: i1 is ready with call c2.
        Ids that are empty, padded or repeated are rejected."""
        bad = runs.where(~valid_name(F.col("run_id"))).select("run_id").unionByName(runs.groupBy("run_id").count().where("count > 1").select("run_id"))
        if bad.limit(1).take(1):
            raise ValueError("run ids must be unique, not empty and without white space around them")
        zero = F.lit(0).cast("bigint")
        begin = {"num": F.lit(1), "call": F.lit(2), "node": F.lit(self.graph.entry), "state": F.col("state"), "status": F.lit("ready"), "group_num": zero, "group_join": F.lit(""), "child_group": zero, "branch_index": zero, "entry_timeout_ns": zero, "path": F.array(), "seq": zero}
        types = fields_of(invocations_ddl(self.state))
        first = F.struct(*[begin.get(f, F.lit(None)).cast(types[f]).alias(f) for f in INVOCATION])
        header = {"run_id": F.col("run_id"), "definition_id": F.lit(self.graph.definition_id), "format_version": F.lit(FORMAT_VERSION), "revision": F.lit(1), "steps": zero, "next_id": F.lit(3), "schedule_cursor": zero, "completed": F.lit(False), "had_local_failures": F.lit(False)}
        kinds = fields_of(runs_ddl(self.state))
        groups = ",".join(f"{n}:{t}" for n, t in fields_of(GROUPS_DDL).items() if n != "run_id")
        return Position(rows=runs.select(*[header.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in HEADER], F.array(first).alias("inv"), F.array().cast(f"array<struct<{groups}>>").alias("grp")))

    def _live(self, pos: Position, options: Options) -> DataFrame:
        none = F.lit(None).cast("string")
        return pos.rows.withColumns({"left": F.lit(options.steps).cast("bigint"), "superstep": F.lit(1).cast("bigint"), "stop": none, "message": none, "idle": F.lit(False)})

    @staticmethod
    def rotated(pos: Position) -> Position:
        """Ready rows in numeric order, beginning after the saved cursor."""
        ready = F.filter("inv", lambda x: x["status"] == "ready")  # by number, as ``inv`` is
        rows = pos.rows.withColumns({"early": F.filter(ready, lambda x: x["num"] <= F.col("schedule_cursor")), "after": F.filter(ready, lambda x: x["num"] > F.col("schedule_cursor"))})
        turned = F.transform(F.concat("after", "early"), lambda x, i: x.withField("seq", (i + 1).cast("bigint")))
        rest = F.transform(F.filter("inv", lambda x: x["status"] != "ready"), lambda x: x.withField("seq", x["seq"] % SUPERSTEP))
        rows = rows.withColumn("inv", F.concat(turned, rest)).drop("early", "after")
        return Position(rows=rows.withColumn("inv", by_number(F.col("inv"))))

    def _finish(self, rows: DataFrame) -> Result:
        more = ~F.col("completed") & F.array_contains("inv.status", "ready")
        rows = rows.withColumn("stop", F.coalesce("stop", F.when(more, F.lit("max_steps"))))
        calls = rows.select(
            "run_id", status_of(F.col("completed"), F.col("failure").isNotNull(), F.col("had_local_failures"), F.col("stop")).alias("status"), "revision", "steps", "next_id", "final", "failure",
            F.when(F.col("stop").isin("max_steps", "max_invocations"), F.col("stop")).alias("budget_reason"), F.when(F.col("stop").isin("illegal", "decode", "invalid_input", "execution_limit", "canceled"), F.coalesce("message", "stop")).alias("error"), "had_local_failures", "completed",
        )
        return Result(Position(rows=rows.select(*HEADER, "inv", "grp")), calls)

    # --- calls ----------------------------------------------------------------

    def _span(self, operation: str):
        return self.session.span(operation, definition_id=self.graph.definition_id) if self.session else nullcontext()

    def _seen(self) -> Callable[[dict], None] | None:
        """Events ``node`` and ``join`` with the number of callbacks that a
        superstep committed."""
        if self.session is None:
            return None

        def seen(sums: dict) -> None:
            self.session.counted("node", int(sums.get("ran") or 0))
            self.session.counted("join", int(sums.get("merged") or 0))

        return seen

    def _commit(self, after: DataFrame) -> None:
        """One written superstep's runs that moved, as a change from their revisions."""
        moved = after.where("revision <> expected")
        if not moved.limit(1).take(1):
            return
        pos = Position(rows=moved.select(*HEADER, "inv", "grp"))
        try:
            self.store.commit(pos, moved.select("run_id", F.col("expected").alias("revision")))
        except ConflictError:
            raise
        except Exception as error:  # the acknowledgement may be what was lost
            stored = self.store.load_header().select("run_id", F.col("revision").alias("stored"))
            off = moved.join(merged(stored), "run_id", "left").where(~F.col("stored").eqNullSafe(F.col("revision")))
            if off.limit(1).take(1):
                raise AmbiguousCommitError("the commit's outcome is not known; recover from the store") from error

    def _drive(self, engine: Engine, rows: DataFrame) -> Result:
        return self._finish(engine.drive(rows, self._commit if self.store is not None else None, self._seen(), self.limiter, self.cancel))

    def start(self, runs: DataFrame, options: Options | None = None) -> Result:
        options = options or Options()
        with self._span("start"):
            pos = self.new(runs)
            pos = Position(rows=written(spread(pos.rows), "new"))
            if self.store is not None:
                self.store.create(pos)
            return self._drive(Engine(self.graph, self.state, options), self._live(pos, options))

    def advance(self, pos: Position, inputs: DataFrame | None = None, options: Options | None = None) -> Result:
        """Answer waits (``inputs``: run_id, ordinal, invocation_id, call_id,
        payload) and drive on. A run whose inputs are not all valid is left as it
        is, with ``invalid_input``; one whose payloads do not all decode, with
        ``waiting``. Completed runs are left as they are."""
        options = options or Options()
        with self._span("advance"):
            engine = Engine(self.graph, self.state, options)
            rows = self._live(pos, options)
            if inputs is not None:
                rows = written(engine.apply(self._answered(engine, rows, inputs)), "applied")
                if self.store is not None:
                    self._commit(rows)
            return self._drive(engine, rows)

    def _answered(self, engine: Engine, rows: DataFrame, inputs: DataFrame) -> DataFrame:
        """Rows with the tasks ``given`` by their inputs, in the inputs' order;
        runs whose inputs are not valid or do not decode stop and get none."""
        asked = inputs.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "invocation_id", "call_id", "payload"))).alias("asked"))
        rows = rows.join(merged(asked), "run_id", "left")
        named = lambda v, a: (v["status"] == "waiting") & (F.concat(F.lit("i"), v["num"]) == a["invocation_id"]) & (F.concat(F.lit("c"), v["call"]) == a["call_id"])
        items = Items("asked").add(v=lambda a: F.try_element_at(F.filter("inv", lambda v: named(v, a)), F.lit(1)), times=lambda a: F.size(F.filter("asked", lambda b: b["invocation_id"] == a["invocation_id"])))
        pairs = self.graph.continuations.items()

        def ok(a: Column) -> Column:
            out = F.lit(False)
            for key, (decode, _) in pairs:
                out = F.when(a["v"]["continuation"] == key, decode(a["payload"]).isNotNull()).otherwise(out)
            return out

        def outcome(a: Column) -> Column:
            """What the continuation makes of it: a state, or an outcome for failures."""
            out, v = F.lit(None).cast(engine.out.type), a["v"]
            call = F.struct(F.col("run_id"), a["invocation_id"].alias("invocation_id"), a["call_id"].alias("call_id"), v["node"].alias("node"))
            for key, (decode, apply) in pairs:
                out = F.when(v["continuation"] == key, apply(engine.out, v["state"], decode(a["payload"]), call, v["next"]).cast(engine.out.type)).otherwise(out)
            return out

        rows = rows.withColumn("asked", items.add(ok=ok).column)
        valid = F.forall("asked", lambda a: a["v"].isNotNull() & (a["times"] == 1))
        good = F.forall("asked", lambda a: F.coalesce(a["ok"], F.lit(False)))
        rows = rows.withColumn("stop", F.when(~F.col("completed") & F.col("asked").isNotNull(), F.when(~valid, F.lit("invalid_input")).when(~good, F.lit("decode"))))
        task = lambda a: F.struct(a["v"].alias("inv"), outcome(a).alias("o"))
        usable = F.when(F.col("stop").isNull() & ~F.col("completed"), F.col("asked"))
        return rows.withColumn("given", F.transform(F.coalesce(usable, F.slice(F.coalesce("asked", F.array()), F.lit(1), F.lit(0))), task)).drop("asked")

    def decoded(self, pos: Position, inputs: DataFrame) -> DataFrame:
        """Each input with its waiting row (``valid``) and whether it decodes (``ok``)."""
        waiting = pos.invocations.where("status = 'waiting'").select("run_id", F.concat(F.lit("i"), F.col("num")).alias("invocation_id"), F.concat(F.lit("c"), F.col("call")).alias("call_id"), "num", "node", "state", "continuation", F.col("next").alias("targets"), "group_num", "group_join", "path")
        several = F.count(F.lit(1)).over(Window.partitionBy("run_id", "invocation_id"))
        rows = inputs.withColumn("several", several).join(waiting, ["run_id", "invocation_id", "call_id"], "left")
        rows = rows.withColumn("valid", F.col("num").isNotNull() & (F.col("several") == 1))
        ok = F.lit(False)
        for key, (decode, _) in self.graph.continuations.items():
            ok = F.when(F.col("continuation") == key, decode(F.col("payload")).isNotNull()).otherwise(ok)
        return rows.withColumn("ok", ok)

    def resume(self, pos: Position, inputs: DataFrame | None = None, options: Options | None = None, stored: DataFrame | None = None) -> Result:
        """Open a supplied position; runs whose stored header (``stored``, or the
        store's) differs are stale and dropped before anything runs."""
        with self._span("resume"):
            if stored is None and self.store is not None:
                stored = self.store.load_header()
            if stored is not None:
                rows = pos.rows.join(merged(stored.select("run_id", "definition_id", "revision")), ["run_id", "definition_id", "revision"], "left_semi")
                pos = Position(rows=rows)
            return self.advance(self.rotated(pos), inputs, options)

    def recover(self, store: Store | None = None, run_ids: DataFrame | None = None, inputs: DataFrame | None = None, options: Options | None = None) -> Result:
        """Open stored runs and drive them; terminal ones come back as they are."""
        with self._span("recover"):
            pos = (store if store is not None else self.store).load(run_ids)
            return self.advance(self.rotated(pos), inputs, options)

    def fork(self, pos: Position, names: DataFrame) -> Position:
        """``names (run_id, new_run_id)``: active runs under a new id at revision
        1; calls that are pending keep their ids; nothing runs."""
        names = names.where((F.col("run_id") != F.col("new_run_id")) & valid_name(F.col("new_run_id")))
        rows = pos.rows.where("not completed").join(merged(names), "run_id")
        return Position(rows=rows.withColumns({"run_id": F.col("new_run_id"), "revision": F.lit(1).cast("bigint")}).select(*HEADER, "inv", "grp"))

    def pending(self, pos: Position) -> DataFrame:
        """The waits to be answered: identities without state."""
        rows = public_invocations(pos.invocations.where("status = 'waiting'"))
        return rows.select("run_id", F.col("id").alias("invocation_id"), "call_id", "node", "continuation")


__all__ = ["AmbiguousCommitError", "Result", "Runner", "status_of"]
