"""Connected components; see :mod:`spotweave.operators.components`."""

from spotweave.operators.components import connected_components

__all__ = ["connected_components"]
