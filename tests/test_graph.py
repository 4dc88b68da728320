import pytest
from pyspark.sql import functions as F

from braidwork.plans import Graph, GraphError, JoinSpec, NodeSpec, fingerprint


def node(name, **k):
    return NodeSpec(name, lambda o, s, c: o.end_branch(), **k)


def test_names_and_duplicates():
    for bad in ("", " a", "a\t", "a/b"):
        with pytest.raises(GraphError):
            Graph("a").add_node(node(bad))
    g = Graph("a").add_node(node("a"))
    for again in (lambda: g.add_node(node("a")), lambda: g.add_join(JoinSpec("a", "a", None)), lambda: g.add_subgraph("a", Graph("b"))):
        with pytest.raises(GraphError):
            again()
    g.add_edge("a", "a")
    with pytest.raises(GraphError):
        g.add_edge("a", "a")
    with pytest.raises(GraphError):
        Graph("a").add_node(node("a", on_error="never"))
    with pytest.raises(GraphError):
        Graph("a").add_node(node("a", timeout_ns=-1))
    with pytest.raises(GraphError):
        Graph("a").add_node(NodeSpec("a"))


def test_compile_checks():
    with pytest.raises(GraphError):
        Graph("nobody").compile("d")
    with pytest.raises(GraphError):
        Graph("a").add_node(node("a")).compile(" ")
    with pytest.raises(GraphError):
        Graph("a").add_node(node("a")).add_edge("a", "b").compile("d")
    join = lambda n, **k: JoinSpec(n, "a", lambda p, b, c: p, **k)
    with pytest.raises(GraphError):
        Graph("a").add_node(node("a")).add_join(join("j")).add_join(join("k")).compile("d")
    with pytest.raises(GraphError):
        Graph("a").add_node(node("a")).add_join(join("j", quorum=1, can_merge=lambda p, b: F.lit(True))).compile("d")
    with pytest.raises(GraphError):
        Graph("a").add_join(join("j", quorum=-1))
    g = Graph("a").add_node(node("a"))
    g.add_subgraph("m", g).add_edge("a", "m")
    with pytest.raises(GraphError):
        g.compile("d")
    with pytest.raises(GraphError):
        g.mermaid()


def test_flatten_and_mermaid():
    inner = Graph("x").add_node(node("x"))
    outer = Graph("in").add_subgraph("in", inner).add_node(node("y")).add_edge("in", "y")
    top = Graph("m").add_subgraph("m", outer).add_node(node("z")).add_edge("m", "z")
    c = top.compile("d")
    assert c.entry == "m/in/x"
    assert sorted(c.nodes) == ["m/in/x", "m/y", "z"]
    assert c.returns == {"m/in/x": "m/y", "m/y": "z"}
    assert "return" in c.mermaid() and c.mermaid() == top.compile("d").mermaid()
    assert top.mermaid().count("subgraph") == 2
    two = Graph("m").add_subgraph("m", inner).add_node(node("z")).add_node(node("w")).add_edge("m", "z").add_edge("m", "w")
    with pytest.raises(GraphError):
        two.compile("d")


def test_fingerprint_does_not_depend_on_order():
    assert fingerprint({"a": 1, "b": [1, 2]}) == fingerprint({"b": [1, 2], "a": 1}) != fingerprint({"b": [2, 1], "a": 1})
