"""Connected components of an edge table, as the library's other operators find them."""

from strandwise.operators.graph import connected_components

__all__ = ["connected_components"]
