"""Spatial kernels as operators on columns of values over places.

``TorusKernel`` is diagonal in the discrete Fourier basis of a raster.
``DenseKernel`` holds the inverse of a small precision matrix. ``SparseKernel``
keeps the precision and solves by its factor, or by conjugate gradients. Each can be broadcast to
workers; none is ever a DataFrame of n x n entries. ``distributed_apply`` works
where not even the precision fits one machine.
"""

from __future__ import annotations

import warnings
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.blas import one_thread
from spotweave.operators.levels import Blocks, Factor
from spotweave.store import drop_table, write_table

one_thread()

#: Up to so many places the kernel is inverted densely on the driver.
DENSE_LIMIT = 5000
#: Kernels cut to so few places are held densely.
FEW = 64
#: Up to so many precision entries (16 bytes each) are broadcast; beyond, use distributed_apply.
BROADCAST_ENTRIES = 20_000_000


class Kernel(Protocol):
    """A positive semi-definite operator on n values."""

    n: int

    def apply(self, x: np.ndarray) -> np.ndarray:
        """K x for x of shape (n, m)."""

    def eigenvalues(self, k: int | None = None) -> np.ndarray: ...


def quadratic(kernel: Kernel, x: np.ndarray) -> np.ndarray:
    """x'Kx for x of shape (n, m)."""
    return x.T @ kernel.apply(x)


class IdentityKernel:
    def __init__(self, n: int, centred: bool = True):
        self.n, self.centred = n, centred

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x - x.mean(0) if self.centred else x

    def eigenvalues(self, k: int | None = None) -> np.ndarray:
        out = np.ones(self.n)
        if self.centred and self.n:
            out[-1] = 0.0
        return out[:k]


class TorusKernel:
    """Autoregressive kernel of a periodic raster, places row by row.

    Neighbours are the cells within the ``degree``-th distinct distance; ``rho``
    is held to 0.99.
    """

    def __init__(self, shape: tuple[int, int], spacing: tuple[float, float] = (1.0, 1.0), rho: float = 0.99, degree: int = 1, centred: bool = True):
        if len(shape) != 2 or min(shape) < 1:
            raise ValueError("a raster has two positive sides")
        if degree < 1:
            raise ValueError("the neighbour degree is at least 1")
        if rho > 0.99:
            warnings.warn("rho is held to 0.99 on a raster", stacklevel=2)
        self.shape, self.spacing, self.rho, self.n = tuple(shape), spacing, min(rho, 0.99), shape[0] * shape[1]
        around = [np.minimum(np.arange(s), s - np.arange(s)) * step for s, step in zip(shape, spacing, strict=True)]
        d2 = np.add.outer(around[0] ** 2, around[1] ** 2)
        rings = np.unique(d2)
        ring = (d2 <= rings[min(degree, len(rings) - 1)]).astype(float)
        ring[0, 0] = 0
        self.spectrum = 1 / (1 - self.rho * np.fft.fft2(ring).real / ring.sum()) if ring.sum() else np.ones(shape)
        if centred:
            self.spectrum[0, 0] = 0.0  # constants are the first basis vector

    def apply(self, x: np.ndarray) -> np.ndarray:
        cube = x.reshape(*self.shape, -1)
        return np.fft.ifft2(np.fft.fft2(cube, axes=(0, 1)) * self.spectrum[..., None], axes=(0, 1)).real.reshape(x.shape)

    def quadratic_diagonal(self, x: np.ndarray) -> np.ndarray:
        power = np.abs(np.fft.fft2(x.reshape(*self.shape, -1), axes=(0, 1))) ** 2
        return np.einsum("yx,yxc->c", self.spectrum, power) / self.n

    def residual(self, x: np.ndarray, eps: float) -> np.ndarray:
        """eps (K + eps)^-1 x."""
        cube = np.fft.fft2(x.reshape(*self.shape, -1), axes=(0, 1)) * (eps / (self.spectrum + eps))[..., None]
        return np.fft.ifft2(cube, axes=(0, 1)).real.reshape(x.shape)

    def eigenvalues(self, k: int | None = None) -> np.ndarray:
        return np.sort(self.spectrum.ravel())[::-1][:k]

    def cumulants(self) -> dict[int, float]:
        return {p: float((self.spectrum**p).sum()) for p in (1, 2, 3, 4)}

    def radial_profile(self, bins: int = 50) -> tuple[np.ndarray, np.ndarray]:
        """Mid-frequencies and mean eigenvalues of ``bins`` equal radial bins (the
        last one closed); empty bins are left out."""
        if bins < 1:
            raise ValueError("at least one bin")
        f = np.hypot.outer(*(np.fft.fftfreq(s, d) for s, d in zip(self.shape, self.spacing, strict=True))).ravel()
        edge = np.linspace(0, f.max(), bins + 1)
        at = np.minimum(np.searchsorted(edge, f, side="right") - 1, bins - 1)
        count = np.bincount(at, minlength=bins)
        total = np.bincount(at, self.spectrum.ravel(), minlength=bins)
        full = count > 0
        return ((edge[:-1] + edge[1:]) / 2)[full], total[full] / count[full]


def _standardised(k: np.ndarray) -> np.ndarray:
    s = 1 / np.sqrt(np.diag(k))
    return k * s[:, None] * s[None, :]


class DenseKernel:
    """A kernel matrix; ``places`` are the ids of its rows."""

    def __init__(self, matrix: np.ndarray, places: np.ndarray, centred: bool = True, standardise: bool = False):
        k = _standardised(matrix) if standardise else matrix
        if centred:
            k = k - k.mean(0) - k.mean(1)[:, None] + k.mean()
        self.matrix, self.places, self.n = (k + k.T) / 2, places, len(k)
        self._eigen: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def from_precision(cls, i: np.ndarray, j: np.ndarray, v: np.ndarray, centred: bool = True, standardise: bool = False) -> DenseKernel:
        places = np.unique(np.concatenate((i, j)))
        m = np.zeros((len(places), len(places)))
        np.add.at(m, (np.searchsorted(places, i), np.searchsorted(places, j)), v)
        return cls(np.linalg.inv(m), places, centred, standardise)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.matrix @ x

    def eigen(self) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues, the largest first, and their vectors."""
        if self._eigen is None:
            w, q = np.linalg.eigh(self.matrix)
            self._eigen = w[::-1], q[:, ::-1]
        return self._eigen

    def eigenvalues(self, k: int | None = None) -> np.ndarray:
        return self.eigen()[0][:k]

    def quadratic_rank(self, x: np.ndarray, k: int) -> np.ndarray:
        """x'Kx by the k leading eigenpairs."""
        w, q = self.eigen()
        z = q[:, :k].T @ x
        return (z * w[:k, None]).T @ z

    def cumulants(self) -> dict[int, float]:
        w = self.eigenvalues()
        return {p: float((w**p).sum()) for p in (1, 2, 3, 4)}

    def masked(self, valid: np.ndarray) -> DenseKernel:
        """The kernel on some of the places, centred on them."""
        return DenseKernel(self.matrix[np.ix_(valid, valid)], self.places[valid], centred=True)


class SparseKernel:
    """Inverse of a sparse precision, by its factor over levels of places. Where
    levels are too large for that, by conjugate gradients on all columns at once:
    with rho = 0.99 the precision's spectrum lies in [0.01, 1.99], so some 170
    steps reach ten digits."""

    def __init__(self, i: np.ndarray, j: np.ndarray, v: np.ndarray, places: np.ndarray | None = None, centred: bool = True, scale: np.ndarray | None = None, tol: float = 1e-10, steps: int = 1000):
        self.places = np.unique(np.concatenate((i, j))) if places is None else places
        order = np.lexsort((j, i))
        self.row = np.searchsorted(self.places, i[order])
        self.col = np.searchsorted(self.places, j[order])
        self.v, self.n, self.centred, self.scale, self.tol, self.steps = v[order], len(self.places), centred, scale, tol, steps
        self.head = np.searchsorted(self.row, np.arange(self.n))
        self._factor: list[Factor | None] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_factor": []}  # made again where it is used: it is larger than the precision

    def blocks(self, rows: int | None = None) -> Blocks:
        return Blocks(self.row, self.col, self.v, self.n, *([] if rows is None else [rows]))

    def factor(self) -> Factor | None:
        """The precision's factor; None if its blocks are too large or it isn't
        positive definite."""
        if not self._factor:
            b = self.blocks()
            try:
                self._factor.append(None if b.diag is None else Factor(b))
            except np.linalg.LinAlgError:
                self._factor.append(None)
        return self._factor[0]

    def _times(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.v[:, None] * x[self.col], self.head, axis=0)

    def solve(self, b: np.ndarray) -> np.ndarray:
        f = self.factor()
        if f is not None:
            return f.solve(b)
        x, r = np.zeros_like(b), b.copy()
        p, rr = r.copy(), (r * r).sum(0)
        goal = self.tol**2 * np.maximum(rr, 1e-300)
        for _ in range(self.steps):
            if (rr <= goal).all():
                break
            mp = self._times(p)
            a = np.where(rr > goal, rr / np.maximum((p * mp).sum(0), 1e-300), 0.0)
            x += a * p
            r -= a * mp
            new = (r * r).sum(0)
            p = r + np.where(rr > goal, new / np.maximum(rr, 1e-300), 0.0) * p
            rr = new
        return x

    def apply(self, x: np.ndarray) -> np.ndarray:
        c = (lambda z: z - z.mean(0)) if self.centred else (lambda z: z)
        s = 1.0 if self.scale is None else self.scale[:, None]
        return c(s * self.solve(s * c(x)))

    def standardised(self, batch: int = 128) -> SparseKernel:
        """Scaled to unit variances: without a factor it takes a solve for every place."""
        f = self.factor()
        diag = np.empty(self.n) if f is None else f.inverse_diagonal()
        for lo in range(0, self.n if f is None else 0, batch):
            e = np.zeros((self.n, min(batch, self.n - lo)))
            e[np.arange(lo, lo + e.shape[1]), np.arange(e.shape[1])] = 1
            diag[lo : lo + e.shape[1]] = self.solve(e)[np.arange(lo, lo + e.shape[1]), np.arange(e.shape[1])]
        out = SparseKernel.__new__(SparseKernel)
        out.__dict__.update(self.__dict__, scale=1 / np.sqrt(diag))
        return out

    def eigenvalues(self, k: int | None = None, rounds: int = 30, seed: int = 0) -> np.ndarray:
        """The k (default 32) leading eigenvalues by block subspace iteration."""
        k = min(k or 32, self.n)
        q = np.linalg.qr(np.random.default_rng(seed).standard_normal((self.n, min(self.n, k + 8))))[0]
        for _ in range(rounds):
            q = np.linalg.qr(self.apply(q))[0]
        return np.sort(np.linalg.eigvalsh(q.T @ self.apply(q)))[::-1][:k]

    def cumulants(self, probes: int = 60, seed: int = 0) -> dict[int, float]:
        return self.cut_cumulants(np.arange(self.n), self.centred) or hutchinson(self, probes, seed)

    def cut_cumulants(self, valid: np.ndarray, centred: bool) -> dict[int, float] | None:
        """tr K^p, p = 1..4, of the kernel cut to some places and, if ``centred``,
        centred on them; None without a factor.

        det(1 + t HKH) is det(1 + t K) times a series in 1'K^p 1 / m, so that
        centring costs two applications."""
        f = self.factor()
        if f is None:
            return None
        weight = np.zeros(self.n)
        weight[valid] = 1.0 if self.scale is None else self.scale[valid] ** 2
        out = f.power_traces(weight)
        if centred and len(valid):
            root = np.sqrt(weight)[:, None]
            cut = lambda z: root * f.solve(root * z)
            one = (root > 0).astype(float)
            a = cut(one)
            b = cut(a)
            u = np.array([(one * a).sum(), (a * a).sum(), (a * b).sum(), (b * b).sum()]) / len(valid)
            log = np.zeros(5)  # p times the p-th term of -ln(1 - t u1 + t^2 u2 - ...), signs aside
            for p in range(1, 5):
                log[p] = p * u[p - 1] - sum(u[i - 1] * log[p - i] for i in range(1, p))
            out = np.maximum(out - log[1:], 0.0)
        return {p: float(out[p - 1]) for p in (1, 2, 3, 4)}


def hutchinson(kernel: Kernel, probes: int = 60, seed: int = 0) -> dict[int, float]:
    """Estimates of tr K^p, p = 1..4, from two applications on random signs."""
    z = np.random.default_rng(seed).choice([-1.0, 1.0], (kernel.n, probes))
    a = kernel.apply(z)
    b = kernel.apply(a)
    return {1: float((z * a).sum() / probes), 2: float((a * a).sum() / probes), 3: float((a * b).sum() / probes), 4: float((b * b).sum() / probes)}


def car_kernel(precision: DataFrame, n: int, standardise: bool = False, centred: bool = True, dense_limit: int = DENSE_LIMIT) -> DenseKernel | SparseKernel:
    """The kernel of a precision table (i, j, v), dense or sparse by its size.
    The entries come to the driver only if there are at most BROADCAST_ENTRIES."""
    entries = precision.count()
    if entries > BROADCAST_ENTRIES:
        raise ValueError(f"{entries} precision entries are too many for one machine; use distributed_apply")
    t = precision.toArrow()
    i, j, v = (t[c].to_numpy() for c in ("i", "j", "v"))
    if n <= dense_limit:
        return DenseKernel.from_precision(i, j, v, centred, standardise)
    k = SparseKernel(i, j, v, centred=centred)
    return k.standardised() if standardise else k


def distributed_apply(precision: DataFrame, values: DataFrame, rho: float = 0.99, tol: float = 1e-6, cut: int = 5) -> DataFrame:
    """K x for long columns (gene_id, ch, spot_id, y) with both tables distributed.

    Chebyshev iteration for M u = x on [1 - rho, 1 + rho]: each step is one join
    of the columns with the precision on the place. Every ``cut`` steps the
    columns are written to the shared folder.
    """
    mid, half = 1.0, rho
    steps = int(np.ceil(np.log(2 / tol) / np.log((1 + np.sqrt((1 - rho) / (1 + rho))) / (1 - np.sqrt((1 - rho) / (1 + rho))))))
    state = values.select("gene_id", "ch", "spot_id", F.lit(0.0).alias("u"), F.col("y").alias("r"), F.lit(0.0).alias("p"))
    alpha = 0.0
    last = None
    for s in range(steps):
        if s == 0:
            alpha, beta = 1 / mid, 0.0
        else:
            beta = 0.5 * (half * alpha) ** 2 if s == 1 else (half * alpha / 2) ** 2
            alpha = 1 / (mid - beta / alpha)
        state = state.withColumn("p", F.col("r") + F.lit(beta) * F.col("p")).withColumn("u", F.col("u") + F.lit(alpha) * F.col("p"))
        mp = state.select("gene_id", "ch", F.col("spot_id").alias("j"), "p").join(precision, "j").groupBy("gene_id", "ch", F.col("i").alias("spot_id")).agg(F.sum(F.col("v") * F.col("p")).alias("mp"))
        state = state.join(mp, ["gene_id", "ch", "spot_id"]).select("gene_id", "ch", "spot_id", "u", (F.col("r") - F.lit(alpha) * F.col("mp")).alias("r"), "p")
        if (s + 1) % cut == 0:
            state = write_table(state, "chebyshev")
            if last is not None:
                drop_table(last)
            last = state
    return state.select("gene_id", "ch", "spot_id", F.col("u").alias("y"))


class MaskedKernel:
    """A kernel on the valid places only, centred on them. ``base`` must not be
    centred itself."""

    def __init__(self, base: Kernel, valid: np.ndarray):
        self.base, self.valid, self.n = base, np.flatnonzero(valid) if valid.dtype == bool else valid, int(valid.sum()) if valid.dtype == bool else len(valid)

    def apply(self, x: np.ndarray) -> np.ndarray:
        full = np.zeros((self.base.n, x.shape[1]))
        full[self.valid] = x - x.mean(0)
        out = self.base.apply(full)[self.valid]
        return out - out.mean(0)

    def cumulants(self, probes: int = 60, seed: int = 0) -> dict[int, float]:
        exact = self.base.cut_cumulants(self.valid, True) if self.n > FEW and isinstance(self.base, SparseKernel) else None
        if exact is not None:
            return exact
        if self.n > DENSE_LIMIT:
            return hutchinson(self, probes, seed)
        k = self.base.masked(self.valid).matrix if isinstance(self.base, DenseKernel) else self.apply(np.eye(self.n))
        k2 = k @ k
        return {1: float(np.trace(k)), 2: float((k * k).sum()), 3: float((k * k2).sum()), 4: float((k2 * k2).sum())}
