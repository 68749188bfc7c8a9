"""Simulated counts: totals times multinomial shares with covariate effects and
spatial fields, group by group with seeds of their own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from spotweave.blas import one_thread
from spotweave.operators.glm import softmax

one_thread()


def simulate_group(rng: np.random.Generator, low: np.ndarray, n_features: int, design: np.ndarray, beta: float | np.ndarray = 1.0, s2: float = 0.6, theta: float = 0.5, mean_total: float = 10.0) -> np.ndarray:
    """Counts (places, features). ``low``: Cholesky factor of the spatial
    correlation; the field is s2 (theta K + (1 - theta) I)."""
    n = len(low)
    field = np.sqrt(s2 * theta) * low @ rng.standard_normal((n, n_features - 1)) + np.sqrt(s2 * (1 - theta)) * rng.standard_normal((n, n_features - 1))
    effect = design @ (np.full((design.shape[1], n_features - 1), beta) if np.isscalar(beta) else beta) if design.shape[1] else 0.0
    return np.stack([rng.multinomial(t, p) for t, p in zip(rng.poisson(mean_total, n), softmax(field + effect), strict=True)])


def simulate(spark: SparkSession, correlation: np.ndarray, n_groups: int, n_features: int = 3, design: np.ndarray | None = None, seed: int = 0, **options: float) -> DataFrame:
    """(gene_id, iso_id, spot_id, n) non-zero counts of ``n_groups`` groups over
    the places of a correlation matrix."""
    low = np.linalg.cholesky(correlation + 1e-9 * np.eye(len(correlation)))
    x = np.zeros((len(low), 0)) if design is None else design
    known = spark.sparkContext.broadcast((low, x))

    def run(pdfs):
        for pdf in pdfs:
            for g in pdf["id"]:
                low, x = known.value
                c = simulate_group(np.random.default_rng([seed, int(g)]), low, n_features, x, **options)
                at, k = np.nonzero(c)
                yield pd.DataFrame({"gene_id": f"gene_{g}", "iso_id": [f"gene_{g}_iso_{j}" for j in k], "spot_id": at, "n": c[at, k].astype(float)})

    return spark.range(n_groups).mapInPandas(run, "gene_id string, iso_id string, spot_id long, n double")
