"""Connected components: the one contraction of the library, in which a hub's edges are spread over many tasks."""

from vaultlens.operators.graph import components

__all__ = ["components"]
