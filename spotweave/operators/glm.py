"""Multinomial logit models of composition, without and with spatial effects.

One group of features is one task: ``groupBy(gene_id).applyInPandas``. The last
feature is the reference. The spatial model adds to each logit a field with
covariance s2 (theta K + (1 - theta) I), integrated out by Laplace's method in
the kernel's eigenbasis, or, where the kernel is the inverse of a sparse precision
with a factor over levels of places, by such factors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.blas import one_thread
from spotweave.functions.dist import chi2_sf
from spotweave.functions.fdr import adjust
from spotweave.operators.kernels import SparseKernel
from spotweave.operators.levels import Blocks, Factor
from spotweave.schema import Dataset, one_of

one_thread()

#: A spatial fit in an eigenbasis solves for places x (features - 1) unknowns at once, up to so many.
MOST_UNKNOWNS = 4000


def softmax(eta: np.ndarray) -> np.ndarray:
    """Probabilities from logits of all but the last feature."""
    full = np.concatenate((eta, np.zeros((len(eta), 1))), axis=1)
    e = np.exp(full - full.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Logit:
    """A fitted model: coefficients (1 + covariates, features - 1), the first row
    intercepts; negative Hessian; log-likelihood; steps taken; whether settled."""

    beta: np.ndarray
    info: np.ndarray
    ll: float
    steps: int
    converged: bool
    history: list[float] = field(default_factory=list)


def fit_logit(counts: np.ndarray, design: np.ndarray, method: str = "iwls", steps: int = 200, tol: float = 1e-8, patience: int = 5, ridge: float = 1e-8) -> Logit:
    """Maximum likelihood for counts (places, features) and design (places, D).

    ``iwls`` takes full Fisher steps and halves those that don't improve,
    ``newton`` damps every step to nine tenths, ``gd`` descends with step
    control. The best state seen is returned.
    """
    one_of(method, ("iwls", "newton", "gd"), "fit method")
    x = np.concatenate((np.ones((len(counts), 1)), design), axis=1)
    total, p = counts.sum(1), counts.shape[1] - 1
    share = np.maximum(counts.sum(0), 0.5)
    beta = np.zeros((x.shape[1], p))
    beta[0] = np.log(share[:-1] / share[-1])

    def state(b: np.ndarray) -> tuple[float, np.ndarray]:
        pr = softmax(x @ b)
        return float((counts * np.log(np.maximum(pr, 1e-300))).sum()), pr

    def information(pr: np.ndarray) -> np.ndarray:
        w = -np.einsum("s,sa,sb->sab", total, pr[:, :-1], pr[:, :-1])
        w[:, np.arange(p), np.arange(p)] += total[:, None] * pr[:, :-1]
        return np.einsum("sd,se,sab->adbe", x, x, w, optimize=True).reshape(p * x.shape[1], -1)

    ll, pr = state(beta)
    best, history, idle, rate = (ll, beta.copy()), [ll], 0, 1.0
    step = 0
    for step in range(1, steps + 1):
        grad = x.T @ (counts - total[:, None] * pr)[:, :-1]
        if method == "gd":
            move = grad / max(1.0, total.sum() / 4)
        else:
            h = information(pr)
            move = np.linalg.solve(h + ridge * np.eye(len(h)) * max(1.0, np.trace(h) / len(h)), grad.T.ravel()).reshape(p, -1).T * (0.9 if method == "newton" else 1.0)
        scale = rate if method == "gd" else 1.0
        for _ in range(30):
            new, pr_new = state(beta + scale * move)
            if np.isfinite(new) and new >= ll - 1e-12 * abs(ll):
                break
            scale /= 2
        else:
            break
        rate = min(64.0, scale * 2)
        beta, pr, gain, ll = beta + scale * move, pr_new, new - ll, new
        history.append(ll)
        if ll > best[0]:
            best = (ll, beta.copy())
        idle = idle + 1 if abs(gain) <= tol * (1 + abs(ll)) else 0
        if idle >= (1 if method == "iwls" else patience):
            break
    ll, beta = best
    return Logit(beta, information(state(beta)[1]), ll, step, idle > 0, history)


def wald(model: Logit) -> np.ndarray:
    """b'Ib of each covariate's coefficients with its own block of the information."""
    d, p = model.beta.shape
    info = model.info.reshape(p, d, p, d)
    return np.array([model.beta[k] @ info[:, k, :, k] @ model.beta[k] for k in range(1, d)])


@dataclass
class SpatialLogit:
    """A fitted spatial model: intercepts and coefficients, variance, spatial
    share, Laplace log marginal likelihood, fitted ratios (places, features), field
    (places, features less one)."""

    beta: np.ndarray
    s2: float
    theta: float
    ll: float
    ratio: np.ndarray
    steps: int
    field: np.ndarray


def _laplace(counts: np.ndarray, x: np.ndarray, lam: np.ndarray, q: np.ndarray, s2: float, theta: float, beta: np.ndarray, nu: np.ndarray, steps: int = 30, tol: float = 1e-8) -> tuple[float, np.ndarray, np.ndarray, int]:
    """(log marginal likelihood, coefficients, field, steps): Newton's method on
    coefficients and field together, then the Gaussian integral at the mode."""
    n, p = counts.shape[0], counts.shape[1] - 1
    total = counts.sum(1)
    prior = s2 * (theta * lam + 1 - theta)  # variances in the eigenbasis
    inv = (q / prior) @ q.T
    k = x.shape[1]

    def value(b: np.ndarray, v: np.ndarray) -> tuple[float, np.ndarray]:
        pr = softmax(x @ b + v)
        z = q.T @ v
        return float((counts * np.log(np.maximum(pr, 1e-300))).sum() - 0.5 * (z * z / prior[:, None]).sum()), pr

    now, pr = value(beta, nu)
    h = None
    step = 0
    for step in range(1, steps + 1):
        w = -np.einsum("s,sa,sb->sab", total, pr[:, :-1], pr[:, :-1])
        w[:, np.arange(p), np.arange(p)] += total[:, None] * pr[:, :-1]
        h = np.zeros((p, n, p, n))
        h[:, np.arange(n), :, np.arange(n)] = w
        for a in range(p):
            h[a, :, a, :] += inv
        h = h.reshape(p * n, p * n)
        hb = np.einsum("sd,sab->adbs", x, w).reshape(p * k, p * n)
        bb = np.einsum("sd,se,sab->adbe", x, x, w).reshape(p * k, p * k) + 1e-8 * np.eye(p * k)
        res = (counts - total[:, None] * pr)[:, :-1]
        gb, gv = (x.T @ res).T.ravel(), (res - inv @ nu).T.ravel()
        sol = np.linalg.solve(h, np.concatenate((hb.T, gv[:, None]), axis=1))
        db = np.linalg.solve(bb - hb @ sol[:, :-1], gb - hb @ sol[:, -1])
        dv = sol[:, -1] - sol[:, :-1] @ db
        db, dv = db.reshape(p, k).T, dv.reshape(p, n).T
        scale = 1.0
        for _ in range(20):
            new, pr_new = value(beta + scale * db, nu + scale * dv)
            if np.isfinite(new) and new >= now - 1e-10 * abs(now):
                break
            scale /= 2
        gain, now, pr = new - now, new, pr_new
        beta, nu = beta + scale * db, nu + scale * dv
        if abs(gain) < tol * (1 + abs(now)):
            break
    sign, det = np.linalg.slogdet(h)
    return now - 0.5 * (p * np.log(prior).sum() + det), beta, nu, step


class SparsePrior:
    """Fields of covariance a K + c I per logit, K = S M^-1 S with sparse M.

    With A = K^-1 / a and weights W, (W + (a K + c I)^-1)^-1 = c T + T (A + W T)^-1 T
    where T = (I + c W)^-1 at each place: only A + W T is factored.
    """

    def __init__(self, kernel: SparseKernel, rows: int = 16):
        s = np.ones(kernel.n) if kernel.scale is None else kernel.scale
        self.blocks = Blocks(kernel.row, kernel.col, kernel.v / (s[kernel.row] * s[kernel.col]), kernel.n, rows)
        self.logdet = Factor(self.blocks).logdet

    def whitened(self, u: np.ndarray, a: float, c: float) -> np.ndarray:
        """(a K + c I)^-1 u."""
        if a == 0:
            return u / c
        own = np.full((len(u), 1, 1), 1 / c)
        return u / c - Factor(self.blocks, 1, 1 / a, own).solve(u) / c**2


def _laplace_sparse(counts: np.ndarray, x: np.ndarray, prior: SparsePrior, s2: float, theta: float, beta: np.ndarray, nu: np.ndarray, steps: int = 30, tol: float = 1e-8) -> tuple[float, np.ndarray, np.ndarray, int]:
    """_laplace with a SparsePrior."""
    n, p, k = counts.shape[0], counts.shape[1] - 1, x.shape[1]
    total, one = counts.sum(1), np.eye(p)
    a, c = s2 * theta, s2 * (1 - theta)
    alpha = prior.whitened(nu, a, c)  # the prior's inverse times the field

    def value(b: np.ndarray, v: np.ndarray, u: np.ndarray) -> tuple[float, np.ndarray]:
        pr = softmax(x @ b + v)
        return float((counts * np.log(np.maximum(pr, 1e-300))).sum() - 0.5 * (v * u).sum()), pr

    now, pr = value(beta, nu, alpha)
    det = 0.0
    step = 0
    for step in range(1, steps + 1):
        w = -np.einsum("s,sa,sb->sab", total, pr[:, :-1], pr[:, :-1])
        w[:, np.arange(p), np.arange(p)] += total[:, None] * pr[:, :-1]
        t = np.linalg.inv(one + c * w)
        det = -float(np.linalg.slogdet(t)[1].sum())
        inner = None
        if a > 0:
            wt = w @ t
            inner = Factor(prior.blocks, p, 1 / a, (wt + wt.transpose(0, 2, 1)) / 2)
            det += p * (n * np.log(a) - prior.logdet) + inner.logdet
        hb = np.einsum("sd,sab->sbad", x, w).reshape(n, p, p * k)
        bb = np.einsum("sd,se,sab->adbe", x, x, w, optimize=True).reshape(p * k, p * k) + 1e-8 * np.eye(p * k)
        res = (counts - total[:, None] * pr)[:, :-1]
        gb, gv = (x.T @ res).T.ravel(), res - alpha
        right = np.concatenate((hb, gv[:, :, None]), axis=2)
        tr = t @ right
        sol = c * tr if inner is None else c * tr + t @ inner.solve(tr)
        cross = np.einsum("sbi,sbj->ij", hb, sol)
        db = np.linalg.solve(bb - cross[:, :-1], gb - cross[:, -1])
        dv = sol[:, :, -1] - sol[:, :, :-1] @ db
        du = gv - hb @ db - np.einsum("sab,sb->sa", w, dv)
        db = db.reshape(p, k).T
        scale = 1.0
        for _ in range(20):
            new, pr_new = value(beta + scale * db, nu + scale * dv, alpha + scale * du)
            if np.isfinite(new) and new >= now - 1e-10 * abs(now):
                break
            scale /= 2
        gain, now, pr = new - now, new, pr_new
        beta, nu, alpha = beta + scale * db, nu + scale * dv, alpha + scale * du
        if abs(gain) < tol * (1 + abs(now)):
            break
    return now - 0.5 * det, beta, nu, step


def fit_spatial_logit(counts: np.ndarray, design: np.ndarray, lam: np.ndarray | SparseKernel, q: np.ndarray | None, theta: float | None = None, prior: str = "none", method: str = "marginal_newton") -> SpatialLogit:
    """The variance and (unless given) the spatial share by maximum Laplace
    marginal likelihood, or for ``joint`` methods by the joint one at the mode.

    ``lam``, ``q``: the kernel's eigenpairs, or a sparse kernel with a factor and
    None. A grid over both is refined twice. ``prior``: ``none``, ``gamma`` (2, 0.3) or
    ``inv_gamma`` (2, 0.1) on the standard deviation.
    """
    one_of(prior, ("none", "gamma", "inv_gamma"), "variance prior")
    one_of(method, ("joint_gd", "joint_newton", "marginal_gd", "marginal_newton"), "fit method")
    n, p = counts.shape[0], counts.shape[1] - 1
    sparse = SparsePrior(lam) if isinstance(lam, SparseKernel) else None
    if sparse is None and n * p > MOST_UNKNOWNS:
        raise ValueError(f"{n} places x {p} logits are over {MOST_UNKNOWNS} unknowns; use fewer places or the logit model")
    x = np.concatenate((np.ones((n, 1)), design), axis=1)
    start = fit_logit(counts, design).beta

    def penalty(s2: float) -> float:
        s = np.sqrt(s2)
        return {"none": 0.0, "gamma": np.log(s) - s / 0.3, "inv_gamma": -3 * np.log(s) - 0.1 / s}[prior]

    best, used = None, 0
    nu = np.zeros((n, p))
    centre, width = np.array([np.log(0.05), 0.0]), np.array([3.0, 3.0])
    for _ in range(3):
        for a in np.linspace(-1, 1, 5):
            for b in [0.0] if theta is not None else np.linspace(-1, 1, 5):
                ls2, lt = centre + width * (a, b)
                s2, th = float(np.exp(np.clip(ls2, -9, 3))), theta if theta is not None else float(1 / (1 + np.exp(-np.clip(lt, -6, 6))))
                th = min(th, 1 - 1e-4)
                at = s2, th, start if best is None else best[2], nu if best is None else best[3]
                ll, be, v, k = _laplace(counts, x, lam, q, *at) if sparse is None else _laplace_sparse(counts, x, sparse, *at)
                used += k
                if best is None or ll + penalty(s2) > best[0] + penalty(best[4]):
                    best = (ll, (ls2, lt), be, v, s2, th)
        centre, width = np.array(best[1]), width / 3
    ll, _, beta, nu, s2, th = best
    return SpatialLogit(beta, s2, th, ll, softmax(x @ beta + nu), used, nu)


def _tables(pdf: pd.DataFrame, n: int) -> tuple[np.ndarray, list[str]]:
    code, names = pd.factorize(pdf["iso_id"], sort=True)
    c = np.zeros((n, len(names)))
    c[pdf["pos"].to_numpy(), code] = pdf["n"].to_numpy()
    return c, list(names)


def _grouped(data: Dataset, index: DataFrame) -> DataFrame:
    held = data.counts.where("n <> 0").join(data.isoforms.select("iso_id", "gene_id", "ord"), "iso_id").join(index.select("spot_id", "pos"), "spot_id")
    return held.select("gene_id", F.format_string("%09d|%s", "ord", "iso_id").alias("iso_id"), "pos", "n")


_PARAMS = "gene_id string, model string, features array<string>, beta array<double>, n_covariates int, s2 double, theta double, ll double, steps int, converged boolean, wald array<double>, field array<double>"


def fit_models(data: Dataset, index: DataFrame, n: int, design: np.ndarray | None = None, model: str = "glm", eigen: tuple[np.ndarray, np.ndarray] | tuple[SparseKernel, None] | None = None, method: str | None = None, prior: str = "none", theta: float | None = None) -> DataFrame:
    """One row of parameters a group (``glm``, ``glmm-full`` or ``glmm-null``,
    the last with spatial share 0); write it as Parquet to keep the models.

    ``design``: (n, D), broadcast with the kernel's eigenpairs, or the kernel and None.
    """
    one_of(model, ("glm", "glmm-full", "glmm-null"), "model type")
    x = np.zeros((n, 0)) if design is None else design
    known = data.counts.sparkSession.sparkContext.broadcast((x, eigen))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, eig = known.value
        c, names = _tables(pdf, n)
        row = {"gene_id": pdf["gene_id"].iloc[0], "model": model, "features": [s.split("|", 1)[1] for s in names], "n_covariates": x.shape[1], "s2": 0.0, "theta": 0.0, "converged": True, "wald": np.zeros(0), "field": np.zeros(0)}
        if c.shape[1] < 2:
            return pd.DataFrame([row | {"beta": np.zeros(0), "ll": 0.0, "steps": 0}])[[f.split()[0] for f in _PARAMS.split(", ")]]
        if model == "glm":
            m = fit_logit(c, x, method or "iwls")
            row |= {"beta": m.beta.ravel(), "ll": m.ll, "steps": m.steps, "converged": m.converged, "wald": wald(m)}
        else:
            lam, q = eig
            s = fit_spatial_logit(c, x, lam, q, 0.0 if model == "glmm-null" else theta, prior, method or "marginal_newton")
            row |= {"beta": s.beta.ravel(), "ll": s.ll, "steps": s.steps, "s2": s.s2, "theta": s.theta, "field": s.field.ravel()}
        return pd.DataFrame([row])[[f.split()[0] for f in _PARAMS.split(", ")]]

    return _grouped(data, index).groupBy("gene_id").applyInPandas(run, _PARAMS)


def wald_test(models: DataFrame, factors: list[str]) -> DataFrame:
    """(gene_id, covariate, statistic, pvalue, pvalue_adj) of models fitted with covariates."""
    names = F.array(*(F.lit(f) for f in factors))
    long = models.where(F.size("features") > 1).select("gene_id", (F.size("features") - 1).alias("df"), F.posexplode("wald").alias("k", "statistic"))
    out = long.select("gene_id", F.element_at(names, F.col("k") + 1).alias("covariate"), "statistic", chi2_sf(F.col("statistic"), F.col("df")).alias("pvalue"))
    return adjust(out, by=["covariate"], order=["gene_id"])


def llr_test(full: DataFrame, null: DataFrame, df: int = 1) -> DataFrame:
    """(gene_id, statistic, pvalue, pvalue_adj): twice the gain in log marginal
    likelihood by a spatial share, against chi-squared. Known to be only roughly
    calibrated; the permutation version is exact."""
    both = full.select("gene_id", F.col("ll").alias("a"), F.size("features").alias("k")).join(null.select("gene_id", F.col("ll").alias("b")), "gene_id")
    stat = F.when(F.col("k") > 1, F.greatest(2 * (F.col("a") - F.col("b")), F.lit(0.0))).otherwise(0.0)
    return adjust(both.select("gene_id", stat.alias("statistic"), chi2_sf(stat, float(df)).alias("pvalue")), order=["gene_id"])


def llr_permutation_test(data: Dataset, index: DataFrame, n: int, eigen: tuple[np.ndarray, np.ndarray] | tuple[SparseKernel, None], permutations: int = 20, seed: int = 0) -> DataFrame:
    """The same gain against those of permuted places: one task a group and permutation."""
    known = data.counts.sparkSession.sparkContext.broadcast(eigen)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, _ = _tables(pdf, n)
        b = int(pdf["b"].iloc[0])
        gain = 0.0
        if c.shape[1] > 1:
            lam, q = known.value
            c = c if b == 0 else c[np.random.default_rng([seed, b]).permutation(n)]
            none = np.zeros((n, 0))
            gain = 2 * (fit_spatial_logit(c, none, lam, q).ll - fit_spatial_logit(c, none, lam, q, theta=0.0).ll)
        return pd.DataFrame({"gene_id": [pdf["gene_id"].iloc[0]], "b": [b], "llr": [max(0.0, gain)]})

    rows = _grouped(data, index).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    gains = rows.groupBy("gene_id", "b").applyInPandas(run, "gene_id string, b int, llr double")
    per = gains.groupBy("gene_id").agg(F.max(F.when(F.col("b") == 0, F.col("llr"))).alias("statistic"), F.collect_list(F.when(F.col("b") > 0, F.col("llr"))).alias("null"))
    p = (1 + F.size(F.filter("null", lambda x: x >= F.col("statistic")))) / F.lit(permutations + 1.0)
    return adjust(per.select("gene_id", "statistic", p.alias("pvalue")), order=["gene_id"])


def fitted_ratios(models: DataFrame, index: DataFrame, design: np.ndarray | None = None) -> DataFrame:
    """(gene_id, iso_id, pos, ratio) of logit models, with their field where they
    have one; ``design`` as they were fitted with. Spark takes the rows, one a
    feature and place, for as few as the models: join them by :func:`at_places`."""
    n = index.count()
    x = np.zeros((n, 0)) if design is None else design
    known = models.sparkSession.sparkContext.broadcast(np.concatenate((np.ones((n, 1)), x), axis=1))

    def run(pdfs):
        for pdf in pdfs:
            for g, names, beta, field in zip(pdf["gene_id"], pdf["features"], pdf["beta"], pdf["field"], strict=True):
                x = known.value
                eta = x @ np.asarray(beta).reshape(x.shape[1], -1) if len(names) > 1 else None
                if eta is not None and len(field):
                    eta = eta + np.asarray(field).reshape(eta.shape)
                r = softmax(eta) if eta is not None else np.ones((len(x), 1))
                for k, name in enumerate(names):
                    yield pd.DataFrame({"gene_id": g, "iso_id": name, "pos": np.arange(len(x), dtype=np.int64), "ratio": r[:, k]})

    held = models.select("gene_id", "features", "beta", "field")
    return held.repartition(max(1, held.sparkSession.sparkContext.defaultParallelism), "gene_id").mapInPandas(run, "gene_id string, iso_id string, pos long, ratio double")


def at_places(fitted: DataFrame, index: DataFrame) -> DataFrame:
    """(gene_id, iso_id, spot_id, ratio) by a join that broadcasts neither side."""
    return fitted.hint("merge").join(index, "pos").select("gene_id", "iso_id", "spot_id", "ratio")
