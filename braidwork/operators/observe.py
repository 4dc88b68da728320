"""Observation: events of calls, callbacks and stores; never part of results."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store
from .schema import Position

# The operations that events name.
OPERATIONS = ("start", "resume", "advance", "recover", "node", "join", "decode", "apply", "create", "load", "commit", "delete")
PUBLIC = OPERATIONS[:4]


@dataclass
class Session:
    """Sends events to an observer; what the observer raises stays there."""

    observer: Callable[[dict], None]
    _next: int = field(default=0)

    def emit(self, event: dict) -> None:
        try:
            self.observer(event)
        except Exception:  # an observer must not change a result
            logging.getLogger(__name__).debug("observer failed", exc_info=True)

    def counted(self, operation: str, count: int) -> None:
        """Callbacks of one superstep, which finish together."""
        if count:
            self._next += 1
            self.emit({"operation": operation, "operation_id": self._next, "phase": "finished", "time": time.time(), "count": count})

    @contextmanager
    def span(self, operation: str, **about: object) -> Iterator[dict]:
        self._next += 1
        base = {"operation": operation, "operation_id": self._next, **about}
        self.emit(base | {"phase": "started", "time": time.time()})
        begun, extra = time.perf_counter_ns(), {}
        try:
            yield extra
        except Exception as e:
            self.emit(base | extra | {"phase": "finished", "time": time.time(), "duration_ns": time.perf_counter_ns() - begun, "err": str(e)})
            raise
        self.emit(base | extra | {"phase": "finished", "time": time.time(), "duration_ns": time.perf_counter_ns() - begun})


class ObservedStore(Store):
    """A store that reports each of its calls; a header read counts as a load."""

    def __init__(self, store: Store, session: Session):
        self.store, self.session = store, session

    def create(self, pos: Position) -> None:
        with self.session.span("create"):
            self.store.create(pos)

    def load(self, run_ids: DataFrame | None = None) -> Position:
        with self.session.span("load"):
            return self.store.load(run_ids)

    def load_header(self) -> DataFrame:
        with self.session.span("load"):
            return self.store.load_header()

    def commit(self, pos: Position, expected: DataFrame) -> None:
        with self.session.span("commit"):
            self.store.commit(pos, expected)

    def delete(self, run_ids: DataFrame) -> None:
        with self.session.span("delete"):
            self.store.delete(run_ids)


def log_observer(logger: logging.Logger) -> Callable[[dict], None]:
    """Public calls at info, the rest at debug, errors at error."""

    def observe(event: dict) -> None:
        level = logging.ERROR if event.get("err") else logging.INFO if event["operation"] in PUBLIC else logging.DEBUG
        logger.log(level, "%s %s", event["operation"], event["phase"], extra={"event": event})

    return observe


def outcomes(rows: DataFrame) -> DataFrame:
    """What became of each task of ``Engine.tasks``, once written (fields of an
    array that is still an expression would repeat it): committed or discarded."""
    acts = rows.select("run_id", F.inline("acts"))
    return acts.select("run_id", "kind", F.concat(F.lit("i"), F.col("num")).alias("invocation_id"), "node", "action", F.when(F.col("accepted"), F.lit("committed")).otherwise(F.lit("discarded")).alias("outcome"))
