"""Graph builder, validation, subgraph flattening and Mermaid export."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

SCOPES = ("fail_invocation", "fail_group", "fail_execution")
ENDED = ""


class GraphError(ValueError):
    pass


def fingerprint(config: object) -> str:
    """A definition id from a configuration: SHA-256 of its canonical JSON."""
    text = json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()


def valid_name(name: object) -> bool:
    """Not empty and without white space around it."""
    return isinstance(name, str) and name != "" and name == name.strip()


@dataclass(frozen=True)
class NodeSpec:
    """``run(out, state, call)`` gives an outcome Column; ``python`` instead maps
    a dict state and call to an outcome dict, row by row in Arrow batches, or
    with ``batch`` lists of both to a list of outcomes, without a limit of time.
    ``elapsed(state)`` is the modelled time of an attempt in nanoseconds."""

    name: str
    run: Callable[..., Column] | None = None
    python: Callable[..., dict] | None = None
    on_error: str = "fail_invocation"
    timeout_ns: int = 0
    elapsed: Callable[[Column], Column] | None = None
    batch: bool = False


@dataclass(frozen=True)
class JoinSpec:
    """``merge(parent, branches, call)`` gives a state Column; branches are an
    array of (index, target, node, status, state, error) in branch order.
    ``error(parent, branches)`` may give a message that fails the merge, as does
    an ``elapsed(parent, branches)``, modelled nanoseconds, above ``timeout_ns``."""

    name: str
    source: str
    merge: Callable[..., Column]
    quorum: int = 0
    can_merge: Callable[[Column, Column], Column] | None = None
    error: Callable[[Column, Column], Column] | None = None
    on_error: str = "fail_invocation"
    timeout_ns: int = 0
    elapsed: Callable[[Column, Column], Column] | None = None


@dataclass(frozen=True)
class Compiled:
    definition_id: str
    entry: str
    nodes: dict[str, NodeSpec]
    joins: dict[str, JoinSpec]
    edges: tuple[tuple[str, str], ...]
    #: (node, name it uses) -> name in the flat graph, for each legal target
    names: dict[tuple[str, str], str]
    #: node of a mounted graph -> where Return leads, ENDED if nowhere
    returns: dict[str, str]
    continuations: dict[str, tuple[Callable[[Column], Column], Callable[..., Column]]]

    def next_of(self, join: str) -> str:
        return next((t for s, t in self.edges if s == join), ENDED)

    def join_of(self, source: str) -> str:
        return next((j.name for j in self.joins.values() if j.source == source), "")

    def edge_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s, t, t in self.joins) for s, t in self.edges], "source string, target string, target_is_join boolean")

    def return_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.returns.items()), "node string, return_target string")

    def scope_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, a, b) for (n, a), b in sorted(self.names.items())], "node string, local_name string, global_name string")

    def mermaid(self) -> str:
        ids = {n: f"n{k}" for k, n in enumerate(sorted([*self.nodes, *self.joins]))}
        lines = ["flowchart TD", *(f'    {ids[n]}{"{{" if n in self.joins else "["}"{_label(n)}"{"}}" if n in self.joins else "]"}' for n in sorted(ids))]
        lines += [f"    {ids[s]} --> {ids[t]}" for s, t in self.edges]
        lines += [f"    {ids[s]} -. return .-> {ids[t]}" for s, t in sorted(self.returns.items()) if t]
        return "\n".join([*lines, ""])


def _label(text: str) -> str:
    return text.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;").replace("\n", "<br/>")


@dataclass
class Graph:
    """A mutable builder; ``compile`` copies it into an immutable graph."""

    entry: str
    nodes: dict[str, NodeSpec] = field(default_factory=dict)
    joins: dict[str, JoinSpec] = field(default_factory=dict)
    mounts: dict[str, Graph] = field(default_factory=dict)
    edges: set[tuple[str, str]] = field(default_factory=set)
    continuations: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not valid_name(self.entry):
            raise GraphError("entry name is invalid")

    def _free(self, name: str) -> None:
        if not valid_name(name) or "/" in name:
            raise GraphError(f"name {name!r} is invalid")
        if name in self.nodes or name in self.joins or name in self.mounts:
            raise GraphError(f"name {name!r} is taken")

    def add_node(self, spec: NodeSpec) -> Graph:
        self._free(spec.name)
        if spec.on_error not in SCOPES:
            raise GraphError(f"failure scope {spec.on_error!r} is unknown")
        if spec.timeout_ns < 0:
            raise GraphError("timeout is negative")
        if (spec.run is None) == (spec.python is None):
            raise GraphError("a node needs one callback")
        self.nodes[spec.name] = spec
        return self

    def add_join(self, spec: JoinSpec) -> Graph:
        self._free(spec.name)
        if spec.on_error not in SCOPES:
            raise GraphError(f"failure scope {spec.on_error!r} is unknown")
        if spec.quorum < 0:
            raise GraphError("quorum is negative")
        if spec.timeout_ns < 0:
            raise GraphError("timeout is negative")
        if not valid_name(spec.source):
            raise GraphError("join source is invalid")
        self.joins[spec.name] = spec
        return self

    def add_subgraph(self, name: str, child: Graph) -> Graph:
        self._free(name)
        self.mounts[name] = child
        return self

    def add_edge(self, source: str, target: str) -> Graph:
        if not valid_name(source) or not valid_name(target):
            raise GraphError("edge name is invalid")
        if (source, target) in self.edges:
            raise GraphError(f"edge {source!r} -> {target!r} is there already")
        self.edges.add((source, target))
        return self

    def register_continuation(self, key: str, decode: Callable[[Column], Column], apply: Callable[..., Column]) -> Graph:
        if not valid_name(key) or key in self.continuations:
            raise GraphError(f"continuation {key!r} is invalid or taken")
        self.continuations[key] = (decode, apply)
        return self

    def compile(self, definition_id: str) -> Compiled:
        if not valid_name(definition_id):
            raise GraphError("definition id is invalid")
        flat = Compiled(definition_id, "", {}, {}, (), {}, {}, {})
        edges: set[tuple[str, str]] = set()
        entry = self._expand("", None, flat, edges, ())
        return Compiled(definition_id, entry, dict(sorted(flat.nodes.items())), dict(sorted(flat.joins.items())), tuple(sorted(edges)), flat.names, flat.returns, dict(sorted(flat.continuations.items())))

    def _entry(self, prefix: str, seen: tuple[int, ...] = ()) -> str:
        if id(self) in seen:
            raise GraphError("a graph mounts itself")
        if self.entry in self.nodes:
            return prefix + self.entry
        if self.entry in self.mounts:
            return self.mounts[self.entry]._entry(f"{prefix}{self.entry}/", (*seen, id(self)))
        raise GraphError(f"entry {self.entry!r} is not a node")

    def _flat(self, prefix: str, name: str) -> str:
        if name in self.mounts:
            return self.mounts[name]._entry(f"{prefix}{name}/", (id(self),))
        if name not in self.nodes and name not in self.joins:
            raise GraphError(f"{name!r} is unknown")
        return prefix + name

    def _expand(self, prefix: str, back: str | None, flat: Compiled, edges: set[tuple[str, str]], active: tuple[int, ...]) -> str:
        if id(self) in active:
            raise GraphError("a graph mounts itself")
        active = (*active, id(self))
        entry = self._entry(prefix)
        sources = set()
        for join in self.joins.values():
            if join.source not in self.nodes:
                raise GraphError(f"join {join.name!r} has no source node")
            if join.source in sources:
                raise GraphError(f"node {join.source!r} has two joins")
            if join.quorum and join.can_merge is not None:
                raise GraphError(f"join {join.name!r} has a quorum and a predicate")
            if sum(s == join.name for s, _ in self.edges) > 1:
                raise GraphError(f"join {join.name!r} has two edges")
            sources.add(join.source)
            flat.joins[prefix + join.name] = replace(join, name=prefix + join.name, source=prefix + join.source)
        for node in self.nodes.values():
            flat.nodes[prefix + node.name] = replace(node, name=prefix + node.name)
            if back is not None:
                flat.returns[prefix + node.name] = back
        for key, pair in self.continuations.items():
            flat.continuations[prefix + key] = pair
        for source, target in sorted(self.edges):
            to = self._flat(prefix, target)
            if source in self.mounts:
                continue
            self._flat(prefix, source)
            edges.add((prefix + source, to))
            flat.names[prefix + source, target] = to
        for name, child in self.mounts.items():
            exits = sorted(t for s, t in self.edges if s == name)
            if len(exits) > 1:
                raise GraphError(f"subgraph {name!r} has two exit edges")
            child._expand(f"{prefix}{name}/", self._flat(prefix, exits[0]) if exits else ENDED, flat, edges, active)
        return entry

    def mermaid(self) -> str:
        lines = ["flowchart TD"]

        def draw(graph: Graph, prefix: str, pad: str, active: tuple[int, ...]) -> None:
            if id(graph) in active:
                raise GraphError("a graph mounts itself")
            for n in sorted([*graph.nodes, *graph.joins]):
                lines.append(f'{pad}{_id(prefix + n)}["{_label(n)}"]')
            for n, child in sorted(graph.mounts.items()):
                lines.append(f'{pad}subgraph {_id(prefix + n)}["{_label(n)}"]')
                draw(child, f"{prefix}{n}/", pad + "    ", (*active, id(graph)))
                lines.append(f"{pad}end")
            lines.extend(f"{pad}{_id(prefix + s)} --> {_id(prefix + t)}" for s, t in sorted(graph.edges))

        draw(self, "", "    ", ())
        return "\n".join([*lines, ""])


def _id(name: str) -> str:
    return "n_" + re.sub(r"[^0-9A-Za-z]", lambda m: f"_{ord(m[0]):x}_", name)
