"""Residuals of values after smooth spatial trends: eps (K + eps I)^-1 y for a
Gaussian-process kernel K = s2 * RBF, with s2 and eps by marginal likelihood.

With the length scale fixed, everything depends on K's eigenvalues and the
values' coordinates in its eigenbasis, so one decomposition serves all columns
and a likelihood costs O(n). Backends: dense (small n, or hyper-parameters from
a subset and prediction in batches), periodic raster by FFT, and Fourier
features for irregular places in any number, where workers only add up small
Gram matrices. On a lattice the features' kernel is a product over the axes, and so
is its decomposition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.blas import one_thread
from spotweave.schema import one_of

one_thread()

S2_BOUNDS = (1e-3, 1e3)
EPS_BOUNDS = (1e-5, 1e1)
#: Above so many places, dense hyper-parameters come from a subset of this size.
SUBSET = 5000


def fit_scale_noise(lam: np.ndarray, power: np.ndarray, m: int, rest: tuple[int, float] = (0, 0.0), s2_bounds: tuple[float, float] | None = S2_BOUNDS, eps_bounds: tuple[float, float] = EPS_BOUNDS, s2: float = 1.0) -> tuple[float, float]:
    """(s2, eps) maximising the marginal likelihood.

    ``lam``: eigenvalues of the unit kernel; ``power``: sums over the ``m``
    columns of squared coordinates; ``rest``: number of further directions with
    eigenvalue 0 and the power in them. With ``s2_bounds`` None, s2 is fixed.
    A coarse grid over both is refined around its best cell.
    """
    k, far = rest

    def cost(a: np.ndarray, e: np.ndarray) -> np.ndarray:
        v = a[:, None] * lam + e[:, None]
        return 0.5 * (m * np.log(v).sum(1) + (power / v).sum(1) + m * k * np.log(e) + far / e)

    los = np.log([s2 if s2_bounds is None else s2_bounds[0], eps_bounds[0]])
    his = np.log([s2 if s2_bounds is None else s2_bounds[1], eps_bounds[1]])
    lo, hi = los.copy(), his.copy()
    best = (lo + hi) / 2
    for _ in range(12):
        grid = [np.linspace(a, b, 1 if a == b else 17) for a, b in zip(lo, hi, strict=True)]
        a, e = (g.ravel() for g in np.meshgrid(*grid, indexing="ij"))
        best_at = int(np.argmin(cost(np.exp(a), np.exp(e))))
        best = np.array([a[best_at], e[best_at]])
        width = (hi - lo) / 8
        lo, hi = np.maximum(los, best - width), np.minimum(his, best + width)
    return float(np.exp(best[0])), float(np.exp(best[1]))


def rbf(x: np.ndarray, y: np.ndarray, length: float) -> np.ndarray:
    d2 = (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T
    return np.exp(-np.maximum(d2, 0) / (2 * length**2))


class DenseGP:
    """Exact residuals; from SUBSET rows' hyper-parameters where there are more."""

    def __init__(self, coords: np.ndarray, length: float = 1.0, seed: int = 0, subset: int = SUBSET):
        self.coords, self.length = coords, length
        n = len(coords)
        self.rows = np.arange(n) if n <= subset else np.sort(np.random.default_rng(seed).choice(n, subset, replace=False))
        self.lam, self.q = np.linalg.eigh(rbf(coords[self.rows], coords[self.rows], length))
        self.lam = np.maximum(self.lam, 0)

    def residuals(self, y: np.ndarray, batch: int = 10_000, **bounds) -> np.ndarray:
        """Residuals of the columns of y, with hyper-parameters shared by them;
        rows with missing values stay missing."""
        y = y.reshape(len(y), -1)
        ok = np.isfinite(y).all(1)
        if not ok.all():
            out = np.full(y.shape, np.nan)
            out[ok] = DenseGP(self.coords[ok], self.length, subset=len(self.rows)).residuals(y[ok], batch, **bounds)
            return out
        z = self.q.T @ y[self.rows]
        s2, eps = fit_scale_noise(self.lam, (z**2).sum(1), y.shape[1], **bounds)
        if len(self.rows) == len(y):
            return self.q @ (z * (eps / (s2 * self.lam + eps))[:, None])
        weight = self.q @ (z / (s2 * self.lam + eps)[:, None])
        out = np.empty_like(y, dtype=float)
        for lo in range(0, len(y), batch):
            out[lo : lo + batch] = y[lo : lo + batch] - s2 * rbf(self.coords[lo : lo + batch], self.coords[self.rows], self.length) @ weight
        return out


def periodic_spectrum(shape: tuple[int, int], spacing: tuple[float, float], length: float) -> np.ndarray:
    """Eigenvalues of the RBF kernel on a periodic raster."""
    around = [np.minimum(np.arange(s), s - np.arange(s)) * d for s, d in zip(shape, spacing, strict=True)]
    d2 = np.add.outer(around[0] ** 2, around[1] ** 2)
    return np.maximum(np.fft.fft2(np.exp(-d2 / (2 * length**2))).real, 0)


class RasterGP:
    """Residuals on a raster; a free length scale is searched over a grid."""

    def __init__(self, shape: tuple[int, int], spacing: tuple[float, float] = (1.0, 1.0), length: float = 1.0, length_bounds: tuple[float, float] | None = None):
        self.shape, self.spacing, self.length, self.length_bounds = shape, spacing, length, length_bounds

    def residuals(self, y: np.ndarray, **bounds) -> np.ndarray:
        cube = np.fft.fft2(y.reshape(*self.shape, -1), axes=(0, 1))
        n, m = cube.shape[0] * cube.shape[1], cube.shape[2]
        power = (np.abs(cube) ** 2).sum(2).ravel() / n
        lengths = [self.length] if self.length_bounds is None else np.geomspace(*self.length_bounds, 15)
        best = None
        for length in lengths:
            lam = periodic_spectrum(self.shape, self.spacing, length).ravel()
            s2, eps = fit_scale_noise(lam, power, m, **bounds)
            v = s2 * lam + eps
            cost = 0.5 * (m * np.log(v).sum() + (power / v).sum())
            if best is None or cost < best[0]:
                best = (cost, eps / v)
        return np.fft.ifft2(cube * best[1].reshape(*self.shape, 1), axes=(0, 1)).real.reshape(y.shape)


def raster_of(coords: np.ndarray, tol: float = 1e-4) -> tuple[tuple[int, int], tuple[float, float]] | None:
    """Sides and spacing if the places fill an evenly spaced raster, else None."""
    axes = [np.unique(c) for c in coords.T]
    if len(axes) != 2 or len(axes[0]) * len(axes[1]) != len(coords) or len(np.unique(coords, axis=0)) != len(coords):
        return None
    steps = []
    for a in axes:
        d = np.diff(a)
        if len(d) and (np.abs(d - d.mean()) > tol * d.mean()).any():
            return None
        steps.append(float(d.mean()) if len(d) else 1.0)
    return (len(axes[0]), len(axes[1])), (steps[0], steps[1])


def fourier_modes(lo: np.ndarray, hi: np.ndarray, length: float, most: int | None = None, tail: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, weights) of the RBF kernel on a box padded by five length
    scales: all of weight over ``tail`` of the largest, or the ``most`` heaviest."""
    side = (hi - lo) + 10 * length
    reach = [int(np.ceil(s / (2 * np.pi * length) * np.sqrt(2 * np.log(1 / tail)))) for s in side]
    k = np.stack([g.ravel() for g in np.meshgrid(*(np.arange(-r, r + 1) for r in reach), indexing="ij")], axis=1)
    half = [tuple(v) > tuple(-v) or not v.any() for v in k]  # one of each pair of opposite frequencies
    k = k[np.array(half)]
    w = 2 * np.pi * k / side
    s = np.exp(-(length**2) * (w**2).sum(1) / 2) * np.prod(length * np.sqrt(2 * np.pi) / side)
    s = np.where(k.any(1), 2 * s, s)
    order = np.argsort(-s, kind="stable")[:most]
    return w[order], s[order]


def fourier_features(coords: np.ndarray, w: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Columns whose products add up to the kernel."""
    phase = coords @ w.T
    root = np.sqrt(s)
    return np.concatenate((np.cos(phase) * root, (np.sin(phase) * root)[:, w.any(1)]), axis=1)


def fourier_residuals(values: DataFrame, dims: int, length: float = 1.0, most: int | None = None) -> DataFrame:
    """(series, spot_id, res) for rows (series, spot_id, coords, y): Gaussian
    process residuals of each series by Fourier features.

    Workers add up features' Gram matrices and their products with the values,
    one series at a time; sums are brought together by blocks of rows, so that a
    task holds one matrix of a series, and a second pass makes the residuals.
    """
    spark = values.sparkSession
    box = values.agg(*[f(F.col("coords")[d]).alias(f"{f.__name__}{d}") for d in range(dims) for f in (F.min, F.max)], F.count(F.lit(1)).alias("rows"), F.count_distinct("series").alias("series")).first()
    lo, hi = (np.array([box[f"{f}{d}"] for d in range(dims)]) for f in ("min", "max"))
    w, s = fourier_modes(lo, hi, length, most)

    size = len(s) + int(w.any(1).sum())
    rows_at_once, height = max(1, (1 << 21) // size), max(1, (1 << 16) // size)

    def features(part: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray]]:
        x = np.stack(part["coords"].to_numpy())
        for lo in range(0, len(x), rows_at_once):
            at = slice(lo, lo + rows_at_once)
            yield at, fourier_features(x[at], w, s)

    def sums(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, g, b, yy, n = None, None, None, 0.0, 0

        def blocks() -> Iterator[pd.DataFrame]:
            for k, lo in enumerate(range(0, size, height)):
                yield pd.DataFrame({"series": [name], "k": [k], "g": [g[lo : lo + height].ravel()], "b": [b[lo : lo + height]], "yy": [yy if k == 0 else 0.0], "n": [n if k == 0 else 0]})

        for pdf in pdfs:
            for new, part in pdf.groupby("series"):
                if new != name:
                    if name is not None:
                        yield from blocks()
                    name, g, b, yy, n = new, np.zeros((size, size)), np.zeros(size), 0.0, 0
                y = part["y"].to_numpy()
                for at, phi in features(part):
                    g += phi.T @ phi
                    b += phi.T @ y[at]
                yy, n = yy + float(y @ y), n + len(y)
        if name is not None:
            yield from blocks()

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], "k": [pdf["k"].iloc[0]], "g": [sum(pdf["g"])], "b": [sum(pdf["b"])], "yy": [pdf["yy"].sum()], "n": [pdf["n"].sum()]})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        b = np.concatenate(list(pdf["b"]))
        g = np.concatenate(list(pdf["g"])).reshape(size, size)
        lam, q = np.linalg.eigh(g)
        lam = np.maximum(lam, 0)
        good = lam > lam.max() * 1e-12
        z = (q.T @ b)[good]
        power = z**2 / lam[good]
        n = int(pdf["n"].sum())
        s2, eps = fit_scale_noise(lam[good], power, 1, rest=(max(0, n - int(good.sum())), max(0.0, float(pdf["yy"].sum() - power.sum()))))
        weight = q[:, good] @ (z / (lam[good] + eps / s2))
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], "weight": [weight], "s2": [s2], "eps": [eps]})

    rows = values.select("series", "spot_id", "coords", "y")
    kind = "series string, k int, g array<double>, b array<double>, yy double, n long"
    # A matrix moves for every few times as many rows as it has.
    deal = F.pmod(F.xxhash64("spot_id"), F.lit(max(1, box["rows"] // max(1, box["series"] * 4 * size))))
    parts = rows.repartition("series", deal).sortWithinPartitions("series").mapInPandas(sums, kind).groupBy("series", "k").applyInPandas(added, kind)
    fits = parts.groupBy("series").applyInPandas(solve, "series string, weight array<double>, s2 double, eps double")
    known = spark.sparkContext.broadcast({r["series"]: np.array(r["weight"]) for r in fits.collect()})  # a vector a series

    def residuals(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for name, part in pdf.groupby("series"):
                fit = np.concatenate([phi @ known.value[name] for _, phi in features(part)])
                yield pd.DataFrame({"series": name, "spot_id": part["spot_id"], "res": part["y"].to_numpy() - fit})

    return rows.mapInPandas(residuals, "series string, spot_id long, res double")


#: Lattice sides up to this are decomposed in each series' own task.
SHORT_AXIS = 1024


def lattice_axes(spots: DataFrame, dims: int) -> list[np.ndarray] | None:
    """The sorted coordinates along each axis if the places fill their lattice."""
    c = [F.col("coords")[d] for d in range(dims)]
    size = spots.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*c).alias("pairs"), *(F.count_distinct(a).alias(f"k{d}") for d, a in enumerate(c))).first()
    if not size["n"] or size["pairs"] != size["n"] or np.prod([size[f"k{d}"] for d in range(dims)], dtype=float) != size["n"]:
        return None
    return [np.sort([r["v"] for r in spots.select(a.alias("v")).distinct().collect()]).astype(float) for a in c]


def axis_kernel(axis: np.ndarray, length: float, tail: float = 1e-6) -> np.ndarray:
    """One axis' factor of the kernel that all features of fourier_modes add up to."""
    side = axis[-1] - axis[0] + 10 * length
    w = 2 * np.pi * np.arange(int(np.ceil(side / (2 * np.pi * length) * np.sqrt(2 * np.log(1 / tail)))) + 1) / side
    g = np.exp(-(length**2) * w**2 / 2) * length * np.sqrt(2 * np.pi) / side * np.where(w > 0, 2, 1)
    phase = axis[:, None] * w
    return (np.cos(phase) * g) @ np.cos(phase).T + (np.sin(phase) * g) @ np.sin(phase).T


def feature_count(axes: list[np.ndarray], length: float, tail: float = 1e-6) -> int:
    """Columns that fourier_features has over the box of ``axes``."""
    return math.prod(2 * int(np.ceil((a[-1] - a[0] + 10 * length) / (2 * np.pi * length) * np.sqrt(2 * np.log(1 / tail)))) + 1 for a in axes)


def lattice_residuals(values: DataFrame, axes: list[np.ndarray], length: float = 1.0) -> DataFrame:
    """The residuals of fourier_residuals where the places of each series fill the
    lattice of ``axes``: a decomposition an axis takes the place of one of all
    features. A long axis is decomposed once, in one task for all series."""
    shape = tuple(len(a) for a in axes)

    def turned(y: np.ndarray, qs: list[np.ndarray]) -> np.ndarray:
        for d, q in enumerate(qs):
            y = np.moveaxis(np.tensordot(q, y, axes=(1, d)), 0, d)
        return y

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        eig = [np.linalg.eigh(axis_kernel(a, length)) for a in axes]
        lam = np.ones(())
        for v, _ in eig:
            lam = np.multiply.outer(lam, np.maximum(v, 0))
        good, out = lam > lam.max() * 1e-12, []
        for name, part in pdf.groupby("series"):
            at = tuple(np.searchsorted(a, c) for a, c in zip(axes, np.stack(part["coords"].to_numpy()).T, strict=True))
            y = np.zeros(shape)
            y[at] = part["y"].to_numpy()
            z = turned(y, [q.T for _, q in eig])
            s2, eps = fit_scale_noise(lam[good], z[good] ** 2, 1, rest=(int((~good).sum()), float((z[~good] ** 2).sum())))
            res = turned(np.where(good, z * (eps / (s2 * lam + eps)), z), [q for _, q in eig])
            out.append(pd.DataFrame({"series": name, "spot_id": part["spot_id"].to_numpy(), "res": res[at]}))
        return pd.concat(out)

    key = F.col("series") if max(shape) <= SHORT_AXIS else F.lit("")
    return values.select("series", "spot_id", "coords", "y").groupBy(key.alias("unit")).applyInPandas(run, "series string, spot_id long, res double")


BACKENDS = ("dense", "raster", "fourier", "auto")
#: Other libraries' names for the same residuals.
_ALIASES = {"sklearn": "dense", "gpytorch": "dense", "fft": "raster", "nufft": "fourier", "finufft": "fourier"}


def backend(name: str) -> str:
    return one_of(_ALIASES.get(name, name), BACKENDS, "GP backend")


def residual_columns(values: DataFrame, spots: DataFrame, n: int, method: str = "auto", length: float = 1.0) -> DataFrame:
    """(series, spot_id, res) for long columns (series, spot_id, y), absent rows
    zero, over ``spots`` (spot_id, coords).

    Up to SUBSET places each series is one task with the shared decomposition of
    the kernel; beyond, or by name, Fourier features, by axes where the places fill
    a lattice whose axes are shorter than the features are many. A raster by name is one
    transform a series for any number of places.
    """
    method = backend(method)
    if method == "fourier" or (method == "auto" and n > SUBSET):
        series = values.select("series").distinct()
        full = spots.select("spot_id", "coords").crossJoin(series).join(values, ["spot_id", "series"], "left")
        dims = spots.select(F.size("coords")).first()[0]
        full = full.select("series", "spot_id", "coords", F.coalesce("y", F.lit(0.0)).alias("y"))
        axes = lattice_axes(spots, dims)
        if axes is not None and sum(len(a) ** 3 for a in axes) <= feature_count(axes, length) ** 3:
            return lattice_residuals(full, axes, length)
        return fourier_residuals(full, dims, length)
    t = spots.select("spot_id", "coords").orderBy("spot_id").toArrow()  # small by the test above, or three numbers a raster cell
    ids, coords = t["spot_id"].to_numpy(), t["coords"].combine_chunks().flatten().to_numpy().astype(float).reshape(len(t), -1)
    found = raster_of(coords) if method in ("auto", "raster") else None
    if method == "raster" and found is None:
        raise ValueError("the places don't fill a raster")
    order = np.lexsort((coords[:, 1], coords[:, 0])) if found else np.arange(len(ids))
    gp = RasterGP(*found, length=length) if method == "raster" else DenseGP(coords, length)
    known = values.sparkSession.sparkContext.broadcast((gp, ids, order))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gp, ids, order = known.value
        y = np.zeros(len(ids))
        y[np.searchsorted(ids, pdf["spot_id"].to_numpy())] = pdf["y"].to_numpy()
        if isinstance(gp, RasterGP):
            res = np.empty(len(ids))
            res[order] = gp.residuals(y[order]).ravel()
        else:
            res = gp.residuals(y).ravel()
        return pd.DataFrame({"series": pdf["series"].iloc[0], "spot_id": ids, "res": res})

    return values.select("series", "spot_id", "y").groupBy("series").applyInPandas(run, "series string, spot_id long, res double")
