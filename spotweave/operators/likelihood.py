"""Log-likelihoods of counts (as aggregates of long tables) and of Gaussians."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.blas import one_thread
from spotweave.functions.dist import log_gamma

one_thread()


def multinomial(rows: DataFrame, keys: list[str], mask: str | None = None, constant: bool = True) -> DataFrame:
    """(keys, ll) for rows (keys, spot_id, n, prob): log-likelihood of the counts
    of each place given its probabilities, added over places. ``mask``: a column
    that is true for rows to leave out. Without ``constant``, only sum n ln p."""
    rows = rows if mask is None else rows.where(~F.col(mask))
    core = F.when(F.col("n") > 0, F.col("n") * F.ln("prob")).otherwise(0.0)
    if not constant:
        return rows.groupBy(*keys).agg(F.sum(core).alias("ll"))
    place = rows.groupBy(*keys, "spot_id").agg(F.sum("n").alias("t"), F.sum(core - log_gamma(F.col("n") + 1)).alias("c"))
    return place.groupBy(*keys).agg(F.sum(F.col("c") + log_gamma(F.col("t") + 1)).alias("ll"))


def dirichlet_multinomial(rows: DataFrame, keys: list[str], mask: str | None = None, constant: bool = True) -> DataFrame:
    """The same with concentrations in the column ``conc``."""
    rows = rows if mask is None else rows.where(~F.col(mask))
    core = log_gamma(F.col("n") + F.col("conc")) - log_gamma(F.col("conc"))
    if constant:
        core = core - log_gamma(F.col("n") + 1)
    place = rows.groupBy(*keys, "spot_id").agg(F.sum("n").alias("t"), F.sum("conc").alias("a"), F.sum(core).alias("c"))
    whole = F.col("c") + log_gamma(F.col("a")) - log_gamma(F.col("t") + F.col("a"))
    if constant:
        whole = whole + log_gamma(F.col("t") + 1)
    return place.groupBy(*keys).agg(F.sum(whole).alias("ll"))


def gaussian(x: np.ndarray, cov: np.ndarray, mean: np.ndarray | float = 0.0) -> float:
    """Log density of the rows of x (m, n) under N(mean, cov), added up."""
    low = np.linalg.cholesky(cov)
    z = np.linalg.solve(low, (np.atleast_2d(x) - mean).T)
    return float(-0.5 * ((z * z).sum() + z.shape[1] * (2 * np.log(np.diag(low)).sum() + len(cov) * np.log(2 * np.pi))))


def gaussian_low_rank(x: np.ndarray, q: np.ndarray, lam: np.ndarray, noise: float, mean: np.ndarray | float = 0.0) -> float:
    """The same for the covariance q diag(lam) q' + noise I with orthonormal q."""
    y = np.atleast_2d(x) - mean
    n, k = q.shape
    z = y @ q
    rest = (y * y).sum() - (z * z).sum()
    det = np.log(lam + noise).sum() + (n - k) * np.log(noise)
    return float(-0.5 * ((z * z / (lam + noise)).sum() + rest / noise + len(y) * (det + n * np.log(2 * np.pi))))
