"""What a node may return, as typed struct Columns; and views of branches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESOLVED = ("joined", "ended", "failed")


class Outcomes:
    """Constructors of the control decisions of a graph with state ``ddl``."""

    def __init__(self, ddl: str):
        self.ddl = ddl
        self.branch = f"struct<target:string,state:{ddl},entry_timeout_ns:bigint>"
        self.type = f"struct<action:string,state:{ddl},targets:array<string>,branches:array<{self.branch}>,continuation:string,error:string>"

    def _make(self, action: str, state: Column | None = None, targets: Column | None = None, branches: Column | None = None, continuation: str | None = None, error: Column | None = None) -> Column:
        none = F.lit(None)
        one = F.struct(
            F.lit(action).alias("action"),
            (none if state is None else state).cast(self.ddl).alias("state"),
            (none if targets is None else targets).cast("array<string>").alias("targets"),
            (none if branches is None else branches).cast(f"array<{self.branch}>").alias("branches"),
            F.lit(continuation).cast("string").alias("continuation"),
            (none if error is None else error).cast("string").alias("error"),
        )
        return one

    def to(self, state: Column, target: str | Column, *more: str | Column) -> Column:
        """Follow one declared edge, or start a group of several with a state each alike."""
        return self.to_targets(state, F.array(*[t if isinstance(t, Column) else F.lit(t) for t in (target, *more)]))

    def to_targets(self, state: Column, targets: Column) -> Column:
        return self._make("to", state, targets)

    def fan_out(self, parent: Column, branches: Column) -> Column:
        """A group of any number of children, each with target and own state."""
        return self._make("fan_out", parent, branches=branches)

    def to_branch(self, target: str | Column, state: Column, entry_timeout_ns: int | Column = 0) -> Column:
        limit = entry_timeout_ns if isinstance(entry_timeout_ns, Column) else F.lit(entry_timeout_ns)
        return F.struct((target if isinstance(target, Column) else F.lit(target)).alias("target"), state.cast(self.ddl).alias("state"), limit.cast("bigint").alias("entry_timeout_ns"))

    def wait(self, state: Column, key: str, target: str, *more: str) -> Column:
        return self._make("wait", state, F.array(*[F.lit(t) for t in (target, *more)]), continuation=key)

    def complete_branch(self, state: Column) -> Column:
        return self._make("complete_branch", state)

    def end_branch(self) -> Column:
        return self._make("end_branch")

    def end_execution(self, state: Column) -> Column:
        return self._make("end_execution", state)

    def return_(self, state: Column) -> Column:
        return self._make("return", state)

    def interrupt(self, cause: str | Column = "interrupted") -> Column:
        return self._make("interrupt", error=cause if isinstance(cause, Column) else F.lit(cause))

    def fail(self, message: str | Column) -> Column:
        return self._make("fail", error=message if isinstance(message, Column) else F.lit(message))


def joined(b: Column) -> Column:
    return b["status"] == "joined"


def failed(b: Column) -> Column:
    return b["status"] == "failed"


def ended(b: Column) -> Column:
    return b["status"] == "ended"


def resolved(b: Column) -> Column:
    return b["status"].isin(*RESOLVED)


def pending(b: Column) -> Column:
    return ~resolved(b)


def branch_values(branches: Column) -> Column:
    """The states of the successful branches, in branch order."""
    return F.transform(F.filter(branches, joined), lambda b: b["state"])
