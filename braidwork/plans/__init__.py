"""Graph definitions: built and compiled on the driver, never as DataFrames."""

from .graph import ENDED, Compiled, Graph, GraphError, JoinSpec, NodeSpec, fingerprint

__all__ = ["ENDED", "Compiled", "Graph", "GraphError", "JoinSpec", "NodeSpec", "fingerprint"]
