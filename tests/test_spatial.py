"""The spatial engine against dense NumPy and stated cases."""

import functools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.functions import dist, fdr
from spotweave.operators import design as dz
from spotweave.operators import filters, glm, gp, graph, hsic, kernels, likelihood, ratios, simulate, summaries, usage
from spotweave.operators.kernels import DenseKernel, IdentityKernel, MaskedKernel, SparseKernel, TorusKernel, distributed_apply, hutchinson, quadratic
from spotweave.plans import chunks, models
from spotweave.schema import Dataset
from spotweave.store import write_table

RNG = np.random.default_rng(0)
COUNTS = RNG.poisson(2, (30, 6)).astype(float)
COUNTS[:5, :2] = 0  # no coverage of the first gene at five places
COUNTS[15:, 0] += 3
GENES = ["g1", "g1", "g2", "g2", "g2", "g3"]


@pytest.fixture(scope="module")
def data(spark):
    spots = spark.createDataFrame([(i, i // 5, i % 5, float(i % 5), float(i // 5), float(i) / 3, i % 2, "ab"[i % 2]) for i in range(30)], "spot_id long, row int, col int, x double, y double, age double, half int, side string")
    iso = spark.createDataFrame([(f"i{k}", g, g.upper(), k) for k, g in enumerate(GENES)], "iso_id string, gene_id string, gene_name string, ord int")
    held = [(int(s), f"i{k}", float(COUNTS[s, k])) for s, k in zip(*np.nonzero(COUNTS), strict=True)]
    return Dataset(spots, iso, spark.createDataFrame(held, "spot_id long, iso_id string, n double"), design=dz.design_table(spots, ["age", "half", "side"]))


def dense_ratio(g):
    c = COUNTS[:, [k for k, x in enumerate(GENES) if x == g]]
    t = c.sum(1, keepdims=True)
    return np.where(t > 0, c / np.where(t > 0, t, 1), np.nan)


def centred(r):
    return np.nan_to_num(r - np.nanmean(r, axis=0))


def cell(df, col):
    return df.select(col.alias("v")).first().v


def test_tails(spark):
    one = spark.range(1)
    assert cell(one, dist.chi2_sf(F.lit(3.0), 2.0)) == pytest.approx(math.exp(-1.5))
    assert cell(one, dist.t_sf2(F.lit(2.5), F.lit(3.0))) == pytest.approx(0.0877066, rel=1e-5)
    assert cell(one, dist.t_sf2(F.lit(0.0), F.lit(5.0))) == pytest.approx(1.0)
    draws = np.random.default_rng(1).noncentral_chisquare(4, 0.8, 2_000_000)
    assert cell(one, dist.ncx2_sf(F.lit(6.0), F.lit(4.0), F.lit(0.8))) == pytest.approx((draws > 6).mean(), abs=2e-3)
    lam = np.array([2.5, 1.0, 0.25, 0.1])
    mix = (np.random.default_rng(2).chisquare(1, (1_000_000, 4)) * lam).sum(1)
    c = [F.lit(float((lam**p).sum())) for p in (1, 2, 3, 4)]
    for t in (3.0, 8.0, 15.0):  # the fit is one of the upper tail
        assert cell(one, dist.liu_sf(F.lit(t), *c)) == pytest.approx((mix > t).mean(), abs=0.03)
    assert cell(one, dist.liu_sf(F.lit(1.0), *[F.lit(0.0)] * 4)) == 0.0
    assert cell(one, dist.liu_sf(F.lit(0.0), *[F.lit(0.0)] * 4)) == 1.0
    for x in (0.3, 1.0, 4.5, 1000.25):
        assert cell(one, dist.log_gamma(F.lit(x))) == pytest.approx(math.lgamma(x), abs=1e-9, rel=1e-12)
    with pytest.warns(DeprecationWarning):
        assert dist.null_method("eig") == "liu"
    with pytest.raises(ValueError):
        dist.null_method("nonsense")


def test_fdr(spark):
    def run(ps, **kw):
        df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "k int, pvalue double")
        return [r.pvalue_adj for r in fdr.adjust(df, order=["k"], **kw).orderBy("k").collect()]

    assert run([0.1, None, 0.5]) == [pytest.approx(0.3), None, pytest.approx(0.75)]
    assert run([0.01, 0.02, 0.2], method="by") == pytest.approx([0.055, 0.055, 0.2 * 11 / 6])
    assert run([0.3]) == [0.3]
    with pytest.raises(Exception, match="between 0 and 1"):
        run([1.2, 0.1])


def test_dependent_fdr_sums_its_factor_once_a_group(spark, monkeypatch):
    many = spark.range(300_000).select("id", (F.col("id") % 3).alias("g"), ((F.col("id") + 1) / 1e12).alias("pvalue"))
    began = time.monotonic()
    got = fdr.adjust(many, by=["g"], method="by", order=["id"]).agg(F.max("pvalue_adj").alias("v"))
    assert cell(got, F.col("v")) == pytest.approx(3e-7 * sum(1 / i for i in range(1, 100_001)), rel=1e-4)
    assert time.monotonic() - began < 60
    monkeypatch.setattr(fdr, "TERMS", 2)
    for k in range(1, 6):
        assert cell(spark.range(1), fdr._harmonic(F.lit(k).cast("long"))) == pytest.approx(sum(1 / i for i in range(1, k + 1)))


@pytest.mark.parametrize("transform", ratios.TRANSFORMS)
def test_ratios(spark, data, transform):
    got = {}
    for r in ratios.ratios(data, transform).collect():
        got[(r.spot_id, r.iso_id)] = r.r
    for g in ("g1", "g2"):
        idx = [k for k, x in enumerate(GENES) if x == g]
        c = COUNTS[:, idx]
        on = c.sum(1) > 0
        if transform in ("none", "radial"):
            want = c / np.where(on, c.sum(1), 1)[:, None]
            if transform == "radial":
                want = want / np.where(on, np.linalg.norm(want, axis=1), 1)[:, None]
            cols = idx
        else:
            v = 0.99 * c + 0.01 * c.mean(0)
            lo = np.log(v / v.sum(1, keepdims=True))
            if transform == "clr":
                want, cols = lo - lo.mean(1, keepdims=True), idx
            elif transform == "alr":
                want, cols = lo[:, 1:] - lo[:, :1], idx[1:]
            else:
                want, cols = np.stack([math.sqrt(k / (k + 1)) * (lo[:, :k].mean(1) - lo[:, k]) for k in range(1, len(idx))], axis=1), idx[1:]
        have = np.array([[got.get((s, f"i{k}"), np.nan) for k in cols] for s in range(30)])
        assert np.isnan(have[~on]).all() and have[on] == pytest.approx(want[on])


def test_ratio_layers_and_fills(spark, data):
    full = {(r.spot_id, r.iso_id): r.ratio for r in ratios.ratio_layer(data, fill_mean=True).collect()}
    assert len(full) == 180 and full[(0, "i0")] == pytest.approx(np.nanmean(dense_ratio("g1")[:, 0]))
    assert ratios.ratio_layer(data).count() == (COUNTS > 0).sum()
    assert ratios.ratios_filled_before(data, "clr").where("gene_id = 'g2'").count() == 90


@pytest.mark.parametrize("kind", hsic.KINDS)
@pytest.mark.parametrize("null", ["liu", "welch"])
def test_raster_statistic_and_null(spark, data, kind, null):
    m = models.RasterModel().setup_data(data, (6, 5), min_counts=0, filter_single_iso_genes=False)
    got = {r.gene_id: r for r in m.test_spatial_variability(f"hsic-{kind}", null).collect()}
    k = TorusKernel((6, 5)).apply(np.eye(30))
    for g in ("g1", "g2"):
        idx = [i for i, x in enumerate(GENES) if x == g]
        y = centred(dense_ratio(g)) if kind == "ir" else COUNTS[:, idx] - COUNTS[:, idx].mean(0)
        y = y.sum(1, keepdims=True) if kind == "gc" else y
        assert got[g].statistic == pytest.approx(np.trace(y.T @ k @ y) / 29**2)
        assert 0 <= got[g].pvalue <= 1
    if kind == "ir":
        assert (got["g3"].statistic, got["g3"].pvalue) == (0, 1)
    assert m.results(with_summary=True).columns[:5] == ["gene", "statistic", "pvalue", "pvalue_adj", "n_isos"]


def test_permutation_agrees_and_repeats(spark, data):
    m = models.RasterModel().setup_data(data, (6, 5), min_counts=0)
    a, b = (sorted(map(tuple, m.test_spatial_variability("hsic-ir", "perm", permutations=200).collect())) for _ in range(2))
    assert a == b
    liu = {r.gene_id: r.pvalue for r in m.test_spatial_variability("hsic-ir").collect()}
    assert all(abs(r[2] - liu[r[0]]) < 0.15 for r in a)


def test_traces_equal_relational_ones(spark, data):
    v = hsic.sparse_values(data, "ic")
    got = {r.gene_id: r for r in hsic.feature_cumulants(v, 30).collect()}
    y = COUNTS[:, 2:5] - COUNTS[:, 2:5].mean(0)
    w = np.linalg.eigvalsh(y.T @ y)
    assert [got["g2"][f"f{p}"] for p in (1, 2, 3, 4)] == pytest.approx([(w**p).sum() for p in (1, 2, 3, 4)])
    assert hsic.traces(COUNTS[:, 2:5]) == pytest.approx([(w**p).sum() for p in (1, 2, 3, 4)])


def test_kernels_agree(spark):
    xy = np.stack([g.ravel() for g in np.meshgrid(range(5), range(5))], axis=1).astype(float)
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(xy)], "spot_id long, coords array<double>")
    adj = graph.adjacency(pts, 4)
    p = graph.car_precision(pts, adj, 0.9).toArrow()
    i, j, v = (p[c].to_numpy() for c in "ijv")
    m = np.zeros((25, 25))
    m[i, j] = v
    assert m == pytest.approx(m.T)
    x = np.random.default_rng(4).normal(size=(25, 3))
    h = np.eye(25) - 1 / 25
    want = h @ np.linalg.inv(m) @ h @ x
    dense, sparse = DenseKernel.from_precision(i, j, v), SparseKernel(i, j, v)
    assert dense.apply(x) == pytest.approx(want) and sparse.apply(x) == pytest.approx(want, abs=1e-7)
    std = DenseKernel.from_precision(i, j, v, centred=False, standardise=True)
    assert np.diag(std.matrix) == pytest.approx(np.ones(25))
    assert SparseKernel(i, j, v, centred=False).standardised().apply(x) == pytest.approx(std.apply(x), abs=1e-6)
    assert dense.eigenvalues(4) == pytest.approx(sparse.eigenvalues(4), rel=1e-4)
    assert dense.quadratic_rank(x, 25) == pytest.approx(quadratic(dense, x))
    exact, guess = dense.cumulants(), hutchinson(sparse, 4000)
    assert all(guess[q] == pytest.approx(exact[q], rel=0.1) for q in exact)
    raw, mask = DenseKernel.from_precision(i, j, v, centred=False), np.arange(25) % 3 > 0
    assert MaskedKernel(raw, mask).apply(x[mask]) == pytest.approx(raw.masked(np.flatnonzero(mask)).apply(x[mask] - x[mask].mean(0)), abs=1e-9)
    assert IdentityKernel(25).apply(x) == pytest.approx(h @ x)
    cols = spark.createDataFrame([("g", "c", int(s), float(a)) for s, a in enumerate(x[:, 0])], "gene_id string, ch string, spot_id long, y double")
    far = {r.spot_id: r.y for r in distributed_apply(graph.car_precision(pts, adj, 0.5), cols, rho=0.5, tol=1e-6, cut=4).collect()}
    q = graph.car_precision(pts, adj, 0.5).toArrow()
    m5 = np.zeros((25, 25))
    m5[q["i"].to_numpy(), q["j"].to_numpy()] = q["v"].to_numpy()
    assert [far[s] for s in range(25)] == pytest.approx(np.linalg.solve(m5, x[:, 0]), abs=1e-4)


def test_torus():
    k = TorusKernel((4, 3), rho=0.0, centred=False)
    assert k.spectrum == pytest.approx(np.ones((4, 3)))
    k = TorusKernel((6, 5), rho=0.9, degree=2)
    x = np.random.default_rng(1).normal(size=(30, 2))
    assert k.quadratic_diagonal(x) == pytest.approx(np.diag(x.T @ k.apply(x)))
    m = k.apply(np.eye(30))
    assert k.residual(x, 0.3) == pytest.approx(0.3 * np.linalg.solve(m + 0.3 * np.eye(30), x))
    f, p = k.radial_profile(6)
    assert len(f) == len(p) and (p >= 0).all()
    with pytest.warns(UserWarning):
        assert TorusKernel((3, 3), rho=0.999).rho == 0.99
    with pytest.raises(ValueError):
        TorusKernel((0, 3))


@pytest.mark.parametrize("dims", [2, 3, 5])
def test_neighbours_equal_brute_force(spark, dims):
    x = np.random.default_rng(dims).integers(0, 6, (80, dims)).astype(float)
    x[:10] += 500  # far away
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "spot_id long, coords array<double>")
    got = sorted((r.i, r.rank, r.j) for r in graph.knn(pts, 4).collect())
    want = []
    for i in range(80):
        d = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in range(80) if j != i)[:4]
        want += [(i, k + 1, j) for k, (_, j) in enumerate(d)]
    assert got == sorted(want)
    assert graph.knn(pts.limit(1), 4).count() == 0


def test_graph_repairs_lonely_places(spark):
    pts = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [1.5]), (3, [9.0])], "spot_id long, coords array<double>")
    assert sorted(map(tuple, graph.adjacency(pts, 1).collect())) == [(0, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0), (3, 3, 1.0)]


def test_filters(spark, data):
    assert filters.as_share(5) == 0.05
    kept = filters.filter_features(data, min_counts=COUNTS[:, 2].sum() + 0.5, single_isoform=True)
    good = [k for k in range(6) if COUNTS[:, k].sum() >= COUNTS[:, 2].sum() + 0.5]
    groups = {g for g in GENES if sum(GENES[k] == g for k in good) >= 2}
    assert {r.iso_id for r in kept.isoforms.collect()} == {f"i{k}" for k in good if GENES[k] in groups}
    edges = [(i, i + 1) for i in range(7)] + [(8, 9)]
    adj = spark.createDataFrame([(a, b, 1.0) for a, b in edges] + [(b, a, 1.0) for a, b in edges], "i long, j long, w double")
    small = data.with_(spots=data.spots.where("spot_id < 10"), adjacency=adj)
    assert filters.filter_components(small, 3).spots.count() == 8
    assert filters.filter_components(small, 2).spots.count() == 10
    with pytest.raises(ValueError):
        models.RasterModel().setup_data(data, (6, 5), min_counts=1e9)


def test_summaries(spark, data):
    g = {r.gene_id: r for r in summaries.gene_summary(data).collect()}
    c = COUNTS[:, :2]
    p = c.sum(0) / c.sum()
    assert g["g1"].perplexity == pytest.approx(math.exp(-(p * np.log(p)).sum()))
    assert (g["g1"].pct_bin_on, g["g1"].count_std) == pytest.approx(((c.sum(1) > 0).mean(), c.sum(1).std()))
    i = {r.iso_id: r for r in summaries.isoform_summary(data).collect()}
    assert (i["i0"].ratio_avg, i["i0"].ratio_std) == pytest.approx((np.nanmean(dense_ratio("g1")[:, 0]), np.nanstd(dense_ratio("g1")[:, 0])))
    assert "n_iso" in summaries.gene_level_statistics(data).columns


def test_usage(spark, data):
    m = models.RasterModel().setup_data(data, (6, 5), min_counts=0)
    got = {(r.gene_id, r.covariate): r for r in m.test_differential_usage("hsic").collect()}
    z = np.arange(30) / 3
    y = centred(dense_ratio("g1"))
    assert got[("g1", "age")].statistic == pytest.approx(((y.T @ (z - z.mean())) ** 2).sum() / 29**2)
    assert {c for _, c in got} == {"age", "half", "side_a", "side_b"}
    binary = data.with_(design=data.design.where("factor <> 'age'"))
    t = {r.iso_id: r for r in usage.two_sample(binary, binary.design, 30).where("covariate = 'half'").collect()}
    r = dense_ratio("g1")[:, 0]
    a, b = (r[(np.arange(30) % 2 == h) & ~np.isnan(r)] for h in (0, 1))
    s = math.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2) * (1 / len(a) + 1 / len(b)))
    assert t["i0"].t == pytest.approx((a.mean() - b.mean()) / s)
    with pytest.raises(ValueError, match="two groups"):
        m.test_differential_usage("t-fisher")
    res = models.RasterModel().setup_data(binary, (6, 5), min_counts=0).test_differential_usage("t-tippett").collect()
    assert all(0 <= x.pvalue <= 1 for x in res)


def test_fourier_features_hold_the_whole_kernel(spark):
    for high in (9.0, 99.0, 999.0):
        assert gp.fourier_modes(np.zeros(2), np.array([9.0, high]), 2.0)[1].sum() == pytest.approx(1, abs=1e-3)
    rng = np.random.default_rng(2)
    xy = np.stack([g.ravel() for g in np.meshgrid(range(10), range(24), indexing="ij")], axis=1).astype(float)
    y = np.linalg.cholesky(gp.rbf(xy, xy, 1.0) + 0.01 * np.eye(240)) @ rng.normal(size=240)
    rows = spark.createDataFrame([(s, i, xy[i].tolist(), float(k * y[i])) for k, s in enumerate("ab", 1) for i in range(240)], "series string, spot_id long, coords array<double>, y double").repartition(3)
    got = {(r.series, r.spot_id): r.res for r in gp.fourier_residuals(rows, 2, 1.0).collect()}
    for k, s in enumerate("ab", 1):
        assert np.array([got[s, i] for i in range(240)]) == pytest.approx(gp.DenseGP(xy).residuals(k * y).ravel(), abs=1e-2)


def test_rasters_of_any_size_keep_their_transform(spark, data, monkeypatch):
    use = lambda: {(r.gene_id, r.covariate): (r.statistic, r.pvalue) for r in models.RasterModel().setup_data(data, (6, 5), min_counts=0).test_differential_usage("hsic-gp", residualize="both").collect()}
    want = use()
    monkeypatch.setattr(gp, "SUBSET", 10)
    got = use()
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9)


def test_residual_processes(spark):
    rng = np.random.default_rng(5)
    xy = np.stack([g.ravel() for g in np.meshgrid(range(8), range(8), indexing="ij")], axis=1) * 0.5
    y = np.sin(xy[:, 0]) * 2 + 0.1 * rng.normal(size=64)
    dense = gp.DenseGP(xy).residuals(y).ravel()
    assert dense.std() < 0.3 * y.std()
    lam, q = np.linalg.eigh(gp.rbf(xy, xy, 1.0))
    s2, eps = gp.fit_scale_noise(np.maximum(lam, 0), (q.T @ y) ** 2, 1)
    assert dense == pytest.approx(eps * np.linalg.solve(s2 * gp.rbf(xy, xy, 1.0) + eps * np.eye(64), y), abs=1e-6)
    rows = spark.createDataFrame([("s", i, v.tolist(), float(a)) for i, (v, a) in enumerate(zip(xy, y, strict=True))], "series string, spot_id long, coords array<double>, y double")
    far = {r.spot_id: r.res for r in gp.fourier_residuals(rows, 2, 1.0).collect()}
    assert np.corrcoef([far[i] for i in range(64)], dense)[0, 1] > 0.98
    assert gp.raster_of(xy) == ((8, 8), (0.5, 0.5)) and gp.raster_of(xy[1:]) is None
    ring = np.sin(2 * np.pi * np.arange(64) / 64)[:, None] * np.ones(64) + 0.1 * rng.normal(size=(64, 64))
    assert gp.RasterGP((64, 64), length=4.0).residuals(ring.ravel()).std() < 0.2 * ring.std()
    y[3] = np.nan
    assert np.isnan(gp.DenseGP(xy).residuals(y)[3]).all()
    assert gp.backend("nufft") == "fourier"


def test_conditional_usage(spark, data):
    m = models.PlaceModel().setup_data(data.with_(design=data.design.where("factor = 'age'")), min_counts=0)
    for both in ("cov_only", "both"):
        res = m.test_differential_usage("hsic-gp", residualize=both).collect()
        assert len(res) == 2 and all(0 <= r.pvalue <= 1 for r in res)
    sv = {r.gene_id: r.pvalue for r in m.test_spatial_variability("hsic-ir").collect()}
    masked = {r.gene_id: r.pvalue for r in m.test_spatial_variability("hsic-ir", nan_filling="none").collect()}
    assert set(sv) == set(masked) == {"g1", "g2"} and abs(sv["g2"] - masked["g2"]) < 0.2
    assert m.test_spatial_variability("spark-x").count() == 2


def test_logit_models(spark, data):
    rng = np.random.default_rng(6)
    z = rng.normal(size=(400, 1))
    pr = glm.softmax(np.concatenate((0.5 + z, -0.3 - 0.5 * z), axis=1))
    c = np.stack([rng.multinomial(20, p) for p in pr]).astype(float)
    fits = [glm.fit_logit(c, z, m, steps=3000, tol=1e-11) for m in ("iwls", "newton", "gd")]
    assert fits[0].beta == pytest.approx(np.array([[0.5, -0.3], [1.0, -0.5]]), abs=0.1)
    assert all(f.ll == pytest.approx(fits[0].ll, rel=1e-5) for f in fits)
    eps = 1e-4
    up = glm.softmax(np.concatenate((np.ones((400, 1)), z), axis=1) @ (fits[0].beta + eps * np.array([[1, 0], [0, 0]])))
    down = glm.softmax(np.concatenate((np.ones((400, 1)), z), axis=1) @ (fits[0].beta - eps * np.array([[1, 0], [0, 0]])))
    assert fits[0].info[0, 0] == pytest.approx(-((c * np.log(up)).sum() + (c * np.log(down)).sum() - 2 * fits[0].ll) / eps**2, rel=1e-3)
    m = models.LogitModel("glm").setup_data(data.with_(design=data.design.where("factor = 'age'")), min_counts=0)
    m.fit()
    score = {r.gene_id: r for r in m.test_differential_usage("score").collect()}
    t = COUNTS[:, 2:5]
    pi, zz = t.sum(0) / t.sum(), np.arange(30) / 3
    s = zz @ (t - t.sum(1, keepdims=True) * pi)
    info = (zz**2 @ t.sum(1)) * (np.diag(pi) - np.outer(pi, pi))[:2, :2]
    assert score["g2"].statistic == pytest.approx(s[:2] @ np.linalg.solve(info, s[:2]))
    with pytest.raises(ValueError):
        m.test_differential_usage("wald")
    m.fit(with_design=True)
    assert m.test_differential_usage("wald").count() == 2
    assert m.training_summary().where("converged").count() == 2 and m.gene_model("g1").count() == 1
    assert glm.fitted_ratios(m.fit(), m.index).groupBy("gene_id", "pos").agg(F.sum("ratio").alias("s")).where("abs(s - 1) > 1e-9").isEmpty()


def test_spatial_logit_finds_fields():
    rng = np.random.default_rng(7)
    xy = np.stack([g.ravel() for g in np.meshgrid(range(6), range(6))], axis=1).astype(float)
    k = gp.rbf(xy, xy, 1.5) + 1e-6 * np.eye(36)
    lam, q = np.linalg.eigh(k)
    c = simulate.simulate_group(rng, np.linalg.cholesky(k), 2, np.zeros((36, 0)), s2=2.0, theta=0.95, mean_total=60).astype(float)
    none = np.zeros((36, 0))
    gain = glm.fit_spatial_logit(c, none, lam, q).ll - glm.fit_spatial_logit(c, none, lam, q, theta=0.0).ll
    shuffled = c[rng.permutation(36)]
    null = glm.fit_spatial_logit(shuffled, none, lam, q).ll - glm.fit_spatial_logit(shuffled, none, lam, q, theta=0.0).ll
    assert gain > 3 and gain > null


def test_likelihoods(spark):
    c, p = np.array([[1, 3, 2], [0, 4, 1]]), np.array([0.2, 0.5, 0.3])
    rows = spark.createDataFrame([("g", s, float(c[s, k]), float(p[k]), float(4 * p[k])) for s in range(2) for k in range(3)], "gene string, spot_id int, n double, prob double, conc double")
    lg = math.lgamma
    mult = sum(lg(r.sum() + 1) - sum(lg(x + 1) for x in r) + (r * np.log(p)).sum() for r in c)
    dm = sum(lg(r.sum() + 1) + lg(4) - lg(r.sum() + 4) + sum(lg(x + a) - lg(a) - lg(x + 1) for x, a in zip(r, 4 * p, strict=True)) for r in c)
    assert likelihood.multinomial(rows, ["gene"]).first().ll == pytest.approx(mult)
    assert likelihood.dirichlet_multinomial(rows, ["gene"]).first().ll == pytest.approx(dm)
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(6, 2)))
    cov = q @ np.diag([2.0, 0.5]) @ q.T + 0.3 * np.eye(6)
    x = np.random.default_rng(2).normal(size=(3, 6))
    assert likelihood.gaussian_low_rank(x, q, np.array([2.0, 0.5]), 0.3) == pytest.approx(likelihood.gaussian(x, cov))


def test_simulation_is_seeded(spark):
    k = np.eye(9)
    a, b = (sorted(map(tuple, simulate.simulate(spark, k, 4, seed=3).collect())) for _ in range(2))
    assert a == b and {r[0] for r in a} == {f"gene_{i}" for i in range(4)}


def test_chunks():
    assert chunks.pack([3, 4, 40, 2, 30], 32) == [[0, 1], [2], [3, 4]]
    assert chunks.chunk_columns(1000) == 32 and chunks.chunk_columns(1 << 28) == 1
    assert chunks.workers(3) == 3 and chunks.workers(-1) >= 1
    with pytest.raises(ValueError):
        chunks.workers(0)


def test_constant_covariates(spark, data):
    flat = data.spots.select("spot_id", F.lit("c").alias("factor"), F.lit(2.0).alias("z"))
    with pytest.raises(ValueError, match="without variance"):
        models.RasterModel().setup_data(data.with_(design=flat), (6, 5), min_counts=0).test_differential_usage("hsic")


def test_user_events_keep_every_user(spark):
    from spotweave.plans import catalog

    d = "/root/testdata/sf0.1"
    users = {r.user_id for r in spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct().collect()}
    assert len(users) > 150 and {r.spot_id for r in catalog._user_events(spark, d).spots.collect()} == users


def test_masked_permutation_null(spark, data):
    """Valid places of each group are permuted among themselves."""
    m = models.PlaceModel().setup_data(data, min_counts=0)
    turn = lambda n, b: np.roll(np.arange(n), b + 1)
    kernel = models.car_kernel(m.precision, m.n, m.standardise, centred=False)
    got = {r.gene_id: r for r in hsic.spatial_variability(m.data, m.index, kernel, m.n, "ir", "perm", "none", "none", 19, turn).collect()}
    order = [r.spot_id for r in m.index.orderBy("pos").collect()]
    for gene, cols in (("g1", slice(0, 2)), ("g2", slice(2, 5))):
        c = COUNTS[order][:, cols]
        valid = np.flatnonzero(c.sum(1) > 0)
        x = c[valid] / c[valid].sum(1, keepdims=True)
        x = x - x.mean(0)
        k = MaskedKernel(kernel, valid)
        form = lambda y: float((y * k.apply(y)).sum())  # noqa: B023, E731
        want = (1 + sum(form(x[turn(len(x), b)]) >= form(x) * (1 - 1e-12) for b in range(19))) / 20
        assert got[gene].pvalue == pytest.approx(want)
    none = hsic.spatial_variability(m.data, m.index, kernel, m.n, "ir", "none", "none", "none")
    assert {r.pvalue for r in none.collect()} == {1.0}


def test_missing_covariates_leave_their_places_out(spark, data):
    spots = data.spots.withColumn("age", F.when(F.col("spot_id") % 4 != 1, F.col("spot_id") / 3.0)).withColumn("two", F.when(F.col("spot_id") != 2, (F.col("spot_id") > 14).cast("int")))
    d = dz.design_table(spots, ["age", "two"])
    gone = spots.where("age IS NULL").count()
    assert dz.missing(d) == {"age": gone, "two": 1}
    moments = {r.factor: r for r in dz.factor_moments(d, 30).collect()}
    ages = [r.age for r in spots.where("age IS NOT NULL").collect()]
    assert moments["age"]["mean"] == pytest.approx(np.mean(ages)) and moments["two"]["levels"] == 2
    y = hsic.sparse_values(data, "ir", "none", 30)
    got = {r.gene_id: r for r in usage.complete_hsic(y, d, 30).where("covariate = 'age'").collect()}
    here = spots.where("age IS NOT NULL").select("spot_id")
    want = usage.linear_hsic(y.join(here, "spot_id", "left_semi"), d.where("factor = 'age' AND NOT isnan(z)"), 30 - gone)
    assert {r.gene_id: r.statistic for r in want.collect()} == pytest.approx({g: r.statistic for g, r in got.items()})
    assert usage.t_test_usage(data, d.where("factor = 'two'"), 30).count() == 3  # all groups have a row


def test_saved_spatial_models(spark, data, tmp_path):
    m = models.LogitModel("glmm-full").setup_data(data, min_counts=0)
    m.fit()
    ratio = {(r.gene_id, r.iso_id, r.spot_id): r.ratio for r in m.fitted_ratios().collect()}
    spread = np.std([v for (g, i, _), v in ratio.items() if i == min(k[1] for k in ratio if k[0] == g)])
    assert spread > 0 and all(r.s == pytest.approx(1) for r in m.fitted_ratios().groupBy("gene_id", "spot_id").agg(F.sum("ratio").alias("s")).collect())
    m.save(str(tmp_path / "m"))
    back = models.LogitModel.load(spark, str(tmp_path / "m"))
    assert back.model_type == "glmm-full" and back.training_summary().count() == 2
    assert {(r.gene_id, r.iso_id, r.spot_id): r.ratio for r in back.fitted_ratios().collect()} == pytest.approx(ratio)


def test_exports_and_old_names(spark, data):
    import spotweave

    assert spotweave.PlaceModel is models.PlaceModel and "ratios" in dir(spotweave) + spotweave.__all__
    with pytest.raises(AttributeError):
        spotweave.nothing  # noqa: B018
    with pytest.warns(DeprecationWarning):
        out = spotweave.counts_and_ratios(data)
    assert {r.gene_id for r in out.select("gene_id").distinct().collect()} == {"g1", "g2"}


def test_tables_need_a_shared_folder():
    from types import SimpleNamespace

    from spotweave import store

    unset = SimpleNamespace(get=lambda *a: None)
    far = SimpleNamespace(sparkContext=SimpleNamespace(master="yarn", getConf=lambda: unset), conf=unset)
    with pytest.raises(ValueError):
        store.shared_dir(far)


def lattice_precision(high, wide, rho=0.99, kept=1.0):
    at = np.arange(high * wide).reshape(high, wide)
    e = np.concatenate((np.stack((at[:-1].ravel(), at[1:].ravel())), np.stack((at[:, :-1].ravel(), at[:, 1:].ravel()))), axis=1)
    e = e[:, np.random.default_rng(3).random(e.shape[1]) <= kept]
    i, j, own = np.concatenate((e[0], e[1])), np.concatenate((e[1], e[0])), at.ravel()
    d = np.maximum(np.bincount(i, minlength=at.size), 1)
    return np.concatenate((i, own)), np.concatenate((j, own)), np.concatenate((-rho / np.sqrt(d[i] * d[j]), np.ones(at.size)))


def no_iteration(self, x):
    raise AssertionError("conjugate gradients")


def test_sparse_kernels_solve_by_levels(monkeypatch):
    monkeypatch.setattr(SparseKernel, "_times", no_iteration)
    for kept in (1.0, 0.6, 0.2):  # connected, and in pieces
        i, j, v = lattice_precision(20, 15, kept=kept)
        want = DenseKernel.from_precision(i, j, v, standardise=True)
        got, x = SparseKernel(i, j, v).standardised(), np.random.default_rng(4).normal(size=(300, 2))
        assert got.apply(x) == pytest.approx(want.apply(x), abs=1e-9)
        assert got.factor().logdet == pytest.approx(np.linalg.slogdet(np.linalg.inv(DenseKernel.from_precision(i, j, v, centred=False).matrix))[1])
    far = SparseKernel(*lattice_precision(600, 10), centred=False).standardised()
    one = np.eye(6000, 1, -3000)
    assert far.apply(one)[3000, 0] == pytest.approx(1.0)
    with pytest.raises(AssertionError, match="gradients"):  # not positive definite: left to the iteration
        SparseKernel(i, j, -v).solve(np.ones((300, 1)))


def test_conditional_usage_makes_no_kernel(spark, data, monkeypatch):
    monkeypatch.setattr(models, "car_kernel", lambda *a, **k: pytest.fail("a kernel was made"))
    m = models.PlaceModel().setup_data(data.with_(design=data.design.where("factor = 'age'")), min_counts=0)
    assert m.test_differential_usage("hsic-gp").count() == 2


def test_masked_tests_make_one_kernel_of_any_size(spark, data, monkeypatch):
    run = lambda: {r.gene_id: (r.statistic, r.pvalue) for r in models.PlaceModel().setup_data(data, min_counts=0).test_spatial_variability("hsic-ir", nan_filling="none").collect()}
    want, made = run(), []
    monkeypatch.setattr(SparseKernel, "_times", no_iteration)
    sparse = functools.partial(models.car_kernel, dense_limit=10)
    monkeypatch.setattr(models, "car_kernel", lambda *a, **k: made.append(sparse(*a, **k)) or made[-1])
    got = run()
    assert len(made) == 1 and isinstance(made[0], SparseKernel) and got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-8)


def test_gene_counts_on_sparse_kernels(spark, data, monkeypatch):
    run = lambda: {r.gene_id: r.statistic for r in models.gene_count_test(data).collect()}
    want = run()
    monkeypatch.setattr(SparseKernel, "_times", no_iteration)
    monkeypatch.setattr(models, "car_kernel", functools.partial(models.car_kernel, dense_limit=10))
    assert run() == {k: pytest.approx(v, rel=1e-8) for k, v in want.items()}


def test_fitted_ratios_are_never_broadcast(spark, data):
    m = models.LogitModel("glm").setup_data(data, min_counts=0)
    m.fit()
    plan = m.fitted_ratios()
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.groupBy("gene_id", "spot_id").agg(F.sum("ratio").alias("s")).where("abs(s - 1) < 1e-9").count() == 2 * 30


def test_sparse_spatial_logit_equals_the_dense_one():
    i, j, v = lattice_precision(8, 5, kept=0.8)
    dense, sparse = DenseKernel.from_precision(i, j, v, centred=False, standardise=True), SparseKernel(i, j, v, centred=False).standardised()
    rng, z = np.random.default_rng(8), np.random.default_rng(9).normal(size=(40, 1))
    c = simulate.simulate_group(rng, np.linalg.cholesky(dense.matrix), 3, np.zeros((40, 0)), s2=1.0, theta=0.8, mean_total=30).astype(float)
    for design, theta in ((np.zeros((40, 0)), None), (np.zeros((40, 0)), 0.0), (z, 0.5)):
        a, b = glm.fit_spatial_logit(c, design, *dense.eigen(), theta=theta), glm.fit_spatial_logit(c, design, sparse, None, theta=theta)
        assert (b.ll, b.s2, b.theta) == pytest.approx((a.ll, a.s2, a.theta), rel=1e-6)
        assert b.ratio == pytest.approx(a.ratio, abs=1e-5) and b.beta == pytest.approx(a.beta, abs=1e-4)


def test_spatial_logit_takes_more_places_than_dense_algebra():
    kernel = SparseKernel(*lattice_precision(300, 15), centred=False).standardised()
    c = np.random.default_rng(1).poisson(5, (4500, 3)).astype(float)
    assert glm.fit_spatial_logit(c, np.zeros((4500, 0)), kernel, None, theta=0.0).ll < 0


def test_fourier_residuals_on_lattices_by_axes(spark, monkeypatch):
    xy = np.stack([g.ravel() for g in np.meshgrid(range(5), range(30), indexing="ij")], axis=1).astype(float)
    y = np.random.default_rng(2).normal(size=150) + np.sin(xy[:, 1] / 3)
    spots = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(xy)], "spot_id long, coords array<double>")
    rows = spark.createDataFrame([(s, i, float(k * y[i])) for k, s in enumerate("ab", 1) for i in range(150) if i % 7], "series string, spot_id long, y double")
    assert gp.feature_count(gp.lattice_axes(spots, 2), 2.0) == 2 * len(gp.fourier_modes(xy.min(0), xy.max(0), 2.0)[0]) - 1
    full = spots.crossJoin(rows.select("series").distinct()).join(rows, ["spot_id", "series"], "left").fillna(0.0, ["y"])
    want = {(r.series, r.spot_id): r.res for r in gp.fourier_residuals(full, 2, 2.0).collect()}
    monkeypatch.setattr(gp, "fourier_residuals", lambda *a: pytest.fail("one matrix of all features"))
    for axis in (gp.SHORT_AXIS, 10):
        monkeypatch.setattr(gp, "SHORT_AXIS", axis)
        got = {(r.series, r.spot_id): r.res for r in gp.residual_columns(rows, spots, 150, "fourier", 2.0).collect()}
        assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    assert gp.lattice_axes(spots.where("spot_id <> 3"), 2) is None


def counted(spark, data):
    """``data``, and how many rows of its counts are read."""
    seen = spark.sparkContext.accumulator(0)

    def look(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    return data.with_(counts=data.counts.mapInPandas(look, data.counts.schema)), seen


def test_masked_tests_read_counts_once(spark, data):
    held, seen = counted(spark, data)
    assert models.PlaceModel().setup_data(held, min_counts=0).test_spatial_variability("hsic-ir", nan_filling="none").count()
    assert seen.value == data.counts.count()


def test_neighbours_on_a_lattice_take_one_search(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "write_table", lambda df, tag: written.append(tag) or write_table(df, tag))
    points = spark.range(120).select(F.col("id").alias("spot_id"), F.array((F.col("id") % 10).cast("double"), F.floor(F.col("id") / 10).cast("double")).alias("coords"))
    found = {(r.i, r.j) for r in graph.knn(points, 4).collect()}
    xy = np.array([(i % 10, i // 10) for i in range(120)], dtype=float)
    d = ((xy[:, None] - xy[None]) ** 2).sum(2) + np.where(np.eye(120) > 0, np.inf, 0)
    assert found == {(i, int(j)) for i in range(120) for j in np.lexsort((np.arange(120), d[i]))[:4]}
    assert written == ["knn"]


def test_traces_of_sparse_kernels_are_exact(monkeypatch):
    i, j, v = lattice_precision(20, 6)
    sparse = SparseKernel(i, j, v, centred=False).standardised()
    full = sparse.apply(np.eye(sparse.n))
    monkeypatch.setattr(kernels, "DENSE_LIMIT", 10)
    for valid in (np.arange(sparse.n), np.flatnonzero(np.arange(sparse.n) % 4 > 0), np.arange(40)):
        k = full[np.ix_(valid, valid)]
        w = np.linalg.eigvalsh(k - k.mean(0) - k.mean(1)[:, None] + k.mean())
        if len(valid) > kernels.FEW:
            assert MaskedKernel(sparse, valid).cumulants() == {p: pytest.approx((w**p).sum(), rel=1e-9) for p in (1, 2, 3, 4)}
        assert sparse.cut_cumulants(valid, True) == {p: pytest.approx((w**p).sum(), rel=1e-9) for p in (1, 2, 3, 4)}
    assert sparse.cumulants() == {p: pytest.approx((np.linalg.eigvalsh(full) ** p).sum(), rel=1e-9) for p in (1, 2, 3, 4)}


def test_gene_counts_read_counts_once(spark, data):
    held, seen = counted(spark, data)
    assert models.gene_count_test(held, min_counts=1).count()
    assert seen.value == data.counts.count()
