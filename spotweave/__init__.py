"""Spatial usage analytics on Spark.

Given counts of features at places, the grouping of features, and coordinates
or a graph of the places, tests whether the composition or abundance of each
group varies over space, and whether it goes with covariates.
"""

from __future__ import annotations

import importlib

_EXPORTS = {
    "PlaceModel": "plans.models", "RasterModel": "plans.models", "LogitModel": "plans.models", "gene_count_test": "plans.models",
    "Dataset": "schema", "session": "session", "connected_components": "operators.components", "car_kernel": "operators.kernels",
    "ratios": "operators.ratios", "counts_and_ratios": "operators.ratios", "load_bins": "sources.visium", "load_probes": "sources.visium",
}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    """Public names, imported when they are first asked for."""
    if name not in _EXPORTS:
        raise AttributeError(f"no {name} in {__name__}")
    return getattr(importlib.import_module(f"{__name__}.{_EXPORTS[name]}"), name)
