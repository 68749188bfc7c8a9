"""Registered queries of the spatial engine on the driver's tables, each with
the same computation in DuckDB SQL where SQL can express it. Numbers that come
from long sums are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.functions import fdr
from spotweave.operators import filters, glm, gp, graph, hsic, likelihood, ratios, simulate, summaries, usage
from spotweave.operators.design import design_table, factor_moments
from spotweave.operators.kernels import TorusKernel, distributed_apply
from spotweave.plans import models, sqltext as q, views
from spotweave.schema import Dataset
from spotweave.session import ship
from spotweave.sources import visium, xenium

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _round(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns))


# Compositions ---------------------------------------------------------------

def _ratio_query(transform: str) -> Query:
    return lambda spark, d: _round(ratios.ratios(views.suppliers(spark, d), transform).drop("ord"), r=8)


for _t in ratios.TRANSFORMS:
    add(f"ratios_{_t}", f"WITH {q.VIEW}, {q.BASE}, {q.RATIOS[_t]} SELECT gene_id, spot_id, iso_id, round(r, 8) AS r FROM rat")(_ratio_query(_t))


@add("ratios_mean_filled", f"WITH {q.VIEW}, {q.BASE}, {q.RATIOS['none']}, {q.FILLED} SELECT gene_id, spot_id, iso_id, round(r, 8) AS r FROM fill")
def ratios_mean_filled(spark: SparkSession, d: str) -> DataFrame:
    data = views.suppliers(spark, d)
    return _round(ratios.fill_with_means(ratios.ratios(data), data).drop("ord"), r=8)


@add(
    "ratios_legacy_fill",
    f"""WITH {q.VIEW}, {q.BASE}, {q.RATIOS['none']}, {q.FILLED}, gap AS (SELECT f.* FROM fill f WHERE NOT EXISTS (SELECT 1 FROM cov c WHERE c.gene_id = f.gene_id AND c.spot_id = f.spot_id) AND r > 0),
{q._LOG} clr AS (SELECT gene_id, spot_id, iso_id, l - avg(l) OVER (PARTITION BY gene_id, spot_id) AS r FROM lg UNION ALL SELECT gene_id, spot_id, iso_id, ln(r) - avg(ln(r)) OVER (PARTITION BY gene_id, spot_id) FROM gap)
SELECT gene_id, spot_id, iso_id, round(r, 8) AS r FROM clr""",
)
def ratios_legacy_fill(spark: SparkSession, d: str) -> DataFrame:
    return _round(ratios.ratios_filled_before(views.suppliers(spark, d), "clr").drop("ord"), r=8)


@add("ratio_layer", f"WITH {q.VIEW} SELECT spot_id, iso_id, round(n / sum(n) OVER (PARTITION BY spot_id, gene_id), 8) AS ratio FROM ct")
def ratio_layer(spark: SparkSession, d: str) -> DataFrame:
    return _round(ratios.ratio_layer(views.suppliers(spark, d)), ratio=8)


@add("ratio_layer_filled", f"WITH {q.VIEW}, {q.BASE}, {q.RATIOS['none']}, {q.FILLED} SELECT sp.spot_id, i.iso_id, round(coalesce(f.r, 0), 8) AS ratio FROM sp CROSS JOIN isoo i LEFT JOIN fill f ON f.spot_id = sp.spot_id AND f.iso_id = i.iso_id")
def ratio_layer_filled(spark: SparkSession, d: str) -> DataFrame:
    return _round(ratios.ratio_layer(views.suppliers(spark, d), fill_mean=True), ratio=8)


@add("gene_totals", f"WITH {q.VIEW} SELECT gene_id, spot_id, sum(n) AS total FROM ct GROUP BY ALL")
def gene_totals(spark: SparkSession, d: str) -> DataFrame:
    return ratios.group_totals(views.suppliers(spark, d))


# Filters ---------------------------------------------------------------------

_SUPPORT = "sup AS (SELECT i.iso_id, i.gene_id, coalesce(sum(c.n), 0) AS total, count(c.n) AS seen FROM isoo i LEFT JOIN ct c USING (iso_id) GROUP BY ALL)"


@add("filter_min_counts", f"WITH {q.VIEW}, {_SUPPORT}, cutoff AS (SELECT avg(total) AS t FROM sup) SELECT iso_id, gene_id FROM sup, cutoff WHERE total >= t")
def filter_min_counts(spark: SparkSession, d: str) -> DataFrame:
    data = views.suppliers(spark, d)
    cut = filters.feature_support(data).agg(F.avg("count_total")).first()[0]
    return filters.filter_features(data, cut, single_isoform=False).isoforms.select("iso_id", "gene_id")


@add("filter_prevalence", f"WITH {q.VIEW}, {_SUPPORT} SELECT iso_id, gene_id FROM sup, nn WHERE seen / n >= 0.95::DOUBLE")
def filter_prevalence(spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_features(views.suppliers(spark, d), min_bin_pct=95, single_isoform=False).isoforms.select("iso_id", "gene_id")


@add("filter_single_iso", f"WITH {q.VIEW}, {_SUPPORT}, good AS (SELECT iso_id, gene_id, count(*) OVER (PARTITION BY gene_id) AS k FROM sup, nn WHERE seen / n >= 0.97::DOUBLE AND total >= 10) SELECT iso_id, gene_id FROM good WHERE k >= 2")
def filter_single_iso(spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_features(views.suppliers(spark, d), 10, 0.97).isoforms.select("iso_id", "gene_id")


@add("filter_groups", f"WITH {q.VIEW}, g AS (SELECT gene_id, spot_id, sum(n) AS t FROM ct GROUP BY ALL) SELECT gene_id FROM g, nn GROUP BY gene_id, n HAVING sum(t) >= 1000 AND count(*) FILTER (t > 0) / n >= 0.5::DOUBLE")
def filter_groups(spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_groups(views.suppliers(spark, d), 1000, 0.5).isoforms.select("gene_id").distinct()


# Summaries -------------------------------------------------------------------

@add(
    "gene_summary",
    f"""WITH {q.VIEW}, t AS (SELECT gene_id, spot_id, sum(n) AS t FROM ct GROUP BY ALL), a AS (SELECT gene_id, sum(t) AS t1, sum(t * t) AS t2, count(*) AS valid FROM t GROUP BY 1),
p AS (SELECT i.gene_id, i.iso_id, coalesce(sum(c.n), 0) AS c FROM isoo i LEFT JOIN ct c USING (iso_id) GROUP BY ALL)
SELECT p.gene_id, p.gene_id AS gene, count(*) AS n_isos, round(exp(-sum(CASE WHEN c > 0 THEN c / t1 * ln(c / t1) ELSE 0 END)), 8) AS perplexity, round(any_value(valid / n), 8) AS pct_bin_on, round(any_value(t1 / n), 8) AS count_avg,
 round(any_value(sqrt(greatest(t2 / n - (t1 / n) ** 2, 0))), 6) AS count_std, round(max(c / t1), 8) AS major_ratio_avg FROM p JOIN a USING (gene_id), nn GROUP BY p.gene_id""",
)
def gene_summary(spark: SparkSession, d: str) -> DataFrame:
    return _round(summaries.gene_summary(views.suppliers(spark, d)), perplexity=8, pct_bin_on=8, count_avg=8, count_std=6, major_ratio_avg=8)


@add(
    "isoform_summary",
    f"""WITH {q.VIEW}, {q.BASE}, a AS (SELECT iso_id, sum(n) AS c, sum(n * n) AS n2, count(*) FILTER (n <> 0) AS seen, sum(total) AS gt, count(*) AS valid, sum(n / total) AS r1, sum((n / total) ** 2) AS r2 FROM base GROUP BY 1)
SELECT iso_id, gene_id, gene_id AS gene_name, ord::INT AS ord, round(seen / n, 8) AS pct_bin_on, c AS count_total, round(c / n, 8) AS count_avg, round(sqrt(greatest(n2 / n - (c / n) ** 2, 0)), 6) AS count_std, round(c / gt, 8) AS ratio_total, round(r1 / valid, 8) AS ratio_avg,
 round(sqrt(greatest(r2 / valid - (r1 / valid) ** 2, 0)), 6) AS ratio_std FROM isoo JOIN a USING (iso_id), nn""",
)
def isoform_summary(spark: SparkSession, d: str) -> DataFrame:
    return _round(summaries.isoform_summary(views.suppliers(spark, d)), pct_bin_on=8, count_avg=8, count_std=6, ratio_total=8, ratio_avg=8, ratio_std=6)


# Spatial variability on the raster ---------------------------------------------

def _raster(spark: SparkSession, d: str) -> models.RasterModel:
    return models.RasterModel().setup_data(views.suppliers(spark, d), views.raster_shape(spark, d), min_counts=0)


def _sv_query(kind: str, transform: str, null: str) -> Query:
    return lambda spark, d: _round(_raster(spark, d).test_spatial_variability(f"hsic-{kind}", null, transform), statistic=8, pvalue=6, pvalue_adj=6)


def _sv_sql(kind: str, transform: str, null: str) -> str:
    c = ", ".join(f"k{p} * f{p} / (n - 1) ** {p} AS c{p}" for p in (1, 2, 3, 4))
    tail = q.liu("cum") if null == "liu" else f"SELECT *, {q.gamma_q('c1 * c1 / c2 / 2', 'q * c1 / c2 / 2')} AS p FROM cum"
    return f"""WITH {q.VIEW}, {q.values(kind, transform)}, {q.GRAM}, {q.TORUS}, {q.FORM}, cum AS MATERIALIZED (SELECT gene_id, hs AS q, n, {c} FROM hs JOIN f USING (gene_id), k, nn), tail AS MATERIALIZED ({tail}),
res AS MATERIALIZED (SELECT gene_id, q / (n - 1) ** 2 AS statistic, p AS pvalue FROM tail), adj AS ({q.adjusted("res")})
SELECT gene_id, round(statistic, 8) AS statistic, round(pvalue, 6) AS pvalue, round(pvalue_adj, 6) AS pvalue_adj FROM adj"""


for _name, _k, _t, _n in [("sv_gc_torus", "gc", "none", "liu"), ("sv_ic_torus", "ic", "none", "liu"), ("sv_ir_torus", "ir", "none", "liu"), ("sv_welch", "ir", "none", "welch"), *((f"sv_ir_{t}", "ir", t, "liu") for t in ("clr", "alr", "ilr", "radial"))]:
    add(_name, _sv_sql(_k, _t, _n))(_sv_query(_k, _t, _n))

_B = 19


@add(
    "sv_perm_affine",
    f"""WITH {q.VIEW}, {q.values('gc')}, {q.TORUS}, perm AS (SELECT b, (SELECT min(a) FROM range(2 * b + 1, 2 * b + 2 + n::INT) t(a) WHERE gcd(a, n::INT) = 1) AS a, 7 * b AS c FROM nn, range({_B}) t(b)),
moved AS MATERIALIZED (SELECT gene_id, b, p.pos // ww AS r, p.pos % ww AS q, y FROM v JOIN sp USING (spot_id), dims, (SELECT b, pos, ((a * pos + c) % n::INT)::INT AS src FROM perm, nn, range(10000) t(pos) WHERE pos < n) p WHERE p.src = sp.r * ww + sp.q),
every AS (SELECT gene_id, -1 AS b, r, q, y FROM v JOIN sp USING (spot_id) UNION ALL SELECT * FROM moved),
four AS (SELECT gene_id, b, h, w, l, sum(y * cos(2 * pi() * (h * r / hh::DOUBLE + w * q / ww::DOUBLE))) AS re, sum(y * sin(2 * pi() * (h * r / hh::DOUBLE + w * q / ww::DOUBLE))) AS im FROM every, lam, dims GROUP BY ALL),
hs AS MATERIALIZED (SELECT gene_id, b, sum(l * (re * re + im * im)) / any_value(n) AS hs FROM four, nn GROUP BY gene_id, b),
res AS MATERIALIZED (SELECT o.gene_id, o.hs / (any_value(n) - 1) ** 2 AS statistic, (1 + count(*) FILTER (p.hs >= o.hs * (1 - 1e-9))) / {_B + 1}.0::DOUBLE AS pvalue FROM hs o JOIN hs p ON o.gene_id = p.gene_id AND o.b = -1 AND p.b >= 0, nn GROUP BY o.gene_id, o.hs), adj AS ({q.adjusted("res")})
SELECT gene_id, round(statistic, 8) AS statistic, round(pvalue, 6) AS pvalue, round(pvalue_adj, 6) AS pvalue_adj FROM adj""",
)
def sv_perm_affine(spark: SparkSession, d: str) -> DataFrame:
    return _round(_raster(spark, d).test_spatial_variability("hsic-gc", "perm", permutations=_B, permutation=hsic.affine_permutation), statistic=8, pvalue=6, pvalue_adj=6)


@add("feature_cumulants", f"WITH {q.VIEW}, {q.values('ir')}, {q.GRAM} SELECT gene_id, " + ", ".join(f"round(f{p}, 6) AS f{p}" for p in (1, 2, 3, 4)) + " FROM f")
def feature_cumulants(spark: SparkSession, d: str) -> DataFrame:
    data = views.suppliers(spark, d)
    n = data.n_spots()
    return _round(hsic.feature_cumulants(hsic.sparse_values(data, "ir", n_spots=n), n), f1=6, f2=6, f3=6, f4=6)


@add("kernel_cumulants", f"WITH {q.VIEW}, {q.TORUS} SELECT round(k1, 6) AS k1, round(k2, 6) AS k2, round(k3, 4) AS k3, round(k4, 2) AS k4 FROM k")
def kernel_cumulants(spark: SparkSession, d: str) -> DataFrame:
    c = TorusKernel(views.raster_shape(spark, d)).cumulants()
    return _round(spark.createDataFrame([tuple(c[p] for p in (1, 2, 3, 4))], "k1 double, k2 double, k3 double, k4 double"), k1=6, k2=6, k3=4, k4=2)


@add(
    "radial_psd",
    f"""WITH {q.VIEW}, {q.TORUS}, fr AS (SELECT l, sqrt((CASE WHEN h < (hh + 1) // 2 THEN h ELSE h - hh END / hh::DOUBLE) ** 2 + (CASE WHEN w < (ww + 1) // 2 THEN w ELSE w - ww END / ww::DOUBLE) ** 2) AS f FROM lam, dims),
top AS (SELECT max(f) AS m FROM fr), bins AS (SELECT list_max(list_filter(range(0, 7), lambda i: i / 7.0::DOUBLE * m <= f)) AS bin, l, m FROM fr, top)
SELECT bin::INT AS bin, round(any_value((bin + 0.5) / 7 * m), 8) AS freq, round(avg(l), 8) AS power FROM bins GROUP BY bin""",
)
def radial_psd(spark: SparkSession, d: str) -> DataFrame:
    kernel = TorusKernel(views.raster_shape(spark, d))
    f, p = kernel.radial_profile(7)
    top = f[-1] / (6.5 / 7) if len(f) else 1.0
    return _round(spark.createDataFrame([(int(round(a / top * 7 - 0.5)), float(a), float(b)) for a, b in zip(f, p, strict=True)], "bin int, freq double, power double"), freq=8, power=8)


@add("rasterize", f"WITH {q.VIEW}, cells AS (SELECT spot_id, r AS row, q AS col FROM sp) SELECT row, col, i.iso_id, coalesce(n, 0) AS n FROM cells CROSS JOIN isoo i LEFT JOIN ct c ON c.spot_id = cells.spot_id AND c.iso_id = i.iso_id")
def rasterize(spark: SparkSession, d: str) -> DataFrame:
    data = models.rasterise(views.suppliers(spark, d), views.raster_shape(spark, d))
    every = data.spots.select("spot_id", "row", "col").crossJoin(data.isoforms.select("iso_id"))
    return every.join(data.counts, ["spot_id", "iso_id"], "left").select("row", "col", "iso_id", F.coalesce("n", F.lit(0.0)).alias("n"))


# Differential usage -------------------------------------------------------------

def _du(df: DataFrame) -> DataFrame:
    return _round(df, statistic=6, pvalue=6, pvalue_adj=6)


_DU_OUT = "SELECT gene_id, covariate, round(statistic, 6) AS statistic, round(pvalue, 6) AS pvalue, round(pvalue_adj, 6) AS pvalue_adj FROM adj"
_ZM = "zm AS (SELECT factor, sum(z) / any_value(n) AS zm, greatest(sum(z * z) - sum(z) ** 2 / any_value(n), 0) AS ss FROM des, nn GROUP BY factor)"


@add("one_hot_design", f"WITH {q.VIEW}, {q.DESIGN} SELECT * FROM des")
def one_hot_design(spark: SparkSession, d: str) -> DataFrame:
    return design_table(views.suppliers(spark, d).spots, ["s_acctbal", "high", "region"])


@add("factor_moments", f"WITH {q.VIEW}, {q.DESIGN}, {_ZM} SELECT factor, round(zm, 6) AS mean, round(ss, 2) AS ss FROM zm")
def factor_moments_query(spark: SparkSession, d: str) -> DataFrame:
    data = views.suppliers(spark, d)
    return _round(factor_moments(data.design, data.n_spots()).select("factor", "mean", "ss"), mean=6, ss=2)


@add(
    "du_hsic",
    f"""WITH {q.VIEW}, {q.DESIGN}, {q.values('ir')}, {q.GRAM}, {_ZM},
yz AS (SELECT v.gene_id, v.ch, d.factor, sum(y * (z - 0)) AS yz FROM v JOIN des d USING (spot_id) GROUP BY ALL), ys AS (SELECT gene_id, ch, sum(y) AS ys FROM v GROUP BY ALL),
hq AS (SELECT ys.gene_id, zm.factor, zm.ss, sum((coalesce(yz, 0) - ys * zm) ** 2) AS h FROM ys CROSS JOIN zm LEFT JOIN yz ON yz.gene_id = ys.gene_id AND yz.ch = ys.ch AND yz.factor = zm.factor GROUP BY ALL),
cum AS MATERIALIZED (SELECT gene_id, factor, h, n, h * n AS q, f1 * ss AS c1, f2 * ss ** 2 AS c2, f3 * ss ** 3 AS c3, f4 * ss ** 4 AS c4 FROM hq JOIN f USING (gene_id), nn), tail AS MATERIALIZED ({q.liu("cum")}),
res AS MATERIALIZED (SELECT gene_id, factor AS covariate, h / (n - 1) ** 2 AS statistic, p AS pvalue FROM tail), adj AS ({q.adjusted("res", "covariate")}) {_DU_OUT}""",
)
def du_hsic(spark: SparkSession, d: str) -> DataFrame:
    return _du(_raster(spark, d).test_differential_usage("hsic"))


def _binary(spark: SparkSession, d: str) -> Dataset:
    data = views.suppliers(spark, d)
    return data.with_(design=data.design.where("factor <> 's_acctbal'"))


_TT = f"""{q.VIEW}, {q.DESIGN}, {q.BASE}, {q.RATIOS['none']}, bd AS (SELECT * FROM des WHERE factor <> 's_acctbal'), fac AS (SELECT DISTINCT factor FROM bd),
grp AS (SELECT sp.spot_id, fac.factor, coalesce(bd.z, 0) > 0.5 AS g FROM sp CROSS JOIN fac LEFT JOIN bd ON bd.spot_id = sp.spot_id AND bd.factor = fac.factor),
st AS (SELECT gene_id, factor, iso_id, count(*) FILTER (NOT g) AS n0, count(*) FILTER (g) AS n1, avg(r) FILTER (NOT g) AS m0, avg(r) FILTER (g) AS m1, var_samp(r) FILTER (NOT g) AS v0, var_samp(r) FILTER (g) AS v1 FROM rat JOIN grp USING (spot_id) GROUP BY ALL),
tt AS MATERIALIZED (SELECT *, (n0 + n1 - 2)::DOUBLE AS df, (m0 - m1) / sqrt((coalesce((n0 - 1) * v0, 0) + coalesce((n1 - 1) * v1, 0)) / (n0 + n1 - 2) * (1 / n0::DOUBLE + 1 / n1::DOUBLE)) AS t FROM st WHERE n0 > 0 AND n1 > 0),
pp AS MATERIALIZED (SELECT *, {q.beta_i('df / 2', '0.5::DOUBLE', '(df / (df + t * t))')} AS p FROM tt)"""


def _combined(stat: str, p: str) -> str:
    return f"""WITH {_TT}, res AS MATERIALIZED (SELECT gene_id, factor AS covariate, {stat} AS statistic, {p} AS pvalue FROM (SELECT gene_id, factor, sum(ln(p)) AS lp, min(p) AS lo, count(*) AS k FROM pp GROUP BY ALL)), adj AS ({q.adjusted("res", "covariate")}) {_DU_OUT}"""


def _t_query(method: str, raster: bool) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        data = _binary(spark, d)
        return _du(usage.t_test_usage(data, data.design, data.n_spots(), method, raster))

    return run


add("du_t_fisher", _combined("-2 * lp", q.gamma_q("k", "(-lp)")))(_t_query("t-fisher", False))
add("du_t_tippett", _combined("lo", "1 - (1 - lo) ** k"))(_t_query("t-tippett", False))
add("du_t_tippett_raster", _combined("-log10(lo)", "1 - (1 - lo) ** k"))(_t_query("t-tippett", True))


@add(
    "glm_score",
    f"""WITH {q.VIEW}, {q.DESIGN}, po AS (SELECT gene_id, iso_id, c / sum(c) OVER (PARTITION BY gene_id) AS pi, count(*) OVER (PARTITION BY gene_id) AS k FROM (SELECT gene_id, iso_id, sum(n) AS c FROM ct GROUP BY ALL)),
zn AS (SELECT gene_id, iso_id, factor, sum(n * z) AS zn, sum(n * z * z) AS zzn FROM ct JOIN des USING (spot_id) GROUP BY ALL), zt AS (SELECT gene_id, factor, sum(zn) AS zt, sum(zzn) AS a FROM zn GROUP BY ALL),
sc AS (SELECT po.gene_id, zt.factor, any_value(k) AS k, sum((coalesce(zn, 0) - pi * zt) ** 2 / pi) / any_value(a) AS s FROM po JOIN zt USING (gene_id) LEFT JOIN zn ON zn.gene_id = po.gene_id AND zn.iso_id = po.iso_id AND zn.factor = zt.factor GROUP BY po.gene_id, zt.factor),
res AS MATERIALIZED (SELECT gene_id, factor AS covariate, s AS statistic, {q.gamma_q("(k - 1) / 2.0::DOUBLE", "s / 2")} AS pvalue FROM sc), adj AS ({q.adjusted("res", "covariate")}) {_DU_OUT}""",
)
def glm_score(spark: SparkSession, d: str) -> DataFrame:
    data = views.suppliers(spark, d)
    return _du(usage.score_test(data, data.design, data.n_spots()))


def _fdr_sql(factor: str) -> str:
    return f"""WITH pv AS (SELECT o_orderkey AS gene_id, (o_orderkey * 7919 % 1009 + 0.5::DOUBLE) / 1009 * (o_totalprice / 1e6) AS pvalue, o_orderpriority AS covariate FROM orders WHERE o_totalprice < 1e6), adj AS ({q.adjusted("pv", "covariate", "gene_id", factor)}) SELECT gene_id, covariate, round(pvalue_adj, 8) AS pvalue_adj FROM adj"""


def _fdr_query(method: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        o = views.table(spark, d, "orders").where("o_totalprice < 1e6")
        p = o.select(F.col("o_orderkey").alias("gene_id"), ((F.col("o_orderkey") * 7919 % 1009 + 0.5) / 1009 * (F.col("o_totalprice") / 1e6)).alias("pvalue"), F.col("o_orderpriority").alias("covariate"))
        return _round(fdr.adjust(p, by=["covariate"], method=method, order=["gene_id"]).drop("pvalue"), pvalue_adj=8)

    return run


add("fdr_bh", _fdr_sql("1.0"))(_fdr_query("bh"))
add("fdr_by", _fdr_sql("list_sum(list_transform(range(1, m_ + 1), lambda i: 1 / i::DOUBLE))"))(_fdr_query("by"))


# Graphs ---------------------------------------------------------------------------

_PTS = """pts AS MATERIALIZED (SELECT vec_id AS spot_id, embedding::DOUBLE[] AS c FROM embeddings),
dist AS MATERIALIZED (SELECT a.spot_id AS i, b.spot_id AS j, list_sum(list_transform(list_zip(a.c, b.c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d2 FROM pts a JOIN pts b ON a.spot_id <> b.spot_id),
knn AS MATERIALIZED (SELECT i, j, d2, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rank FROM dist) WHERE rank <= 6)"""
_LATTICE = f"""{q.VIEW}, dist AS MATERIALIZED (SELECT a.spot_id AS i, b.spot_id AS j, ((a.q - b.q) ** 2 + (a.r - b.r) ** 2)::DOUBLE AS d2 FROM sp a JOIN sp b ON a.spot_id <> b.spot_id),
knn AS MATERIALIZED (SELECT i, j, d2, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rank FROM dist) WHERE rank <= 4)"""
_ADJ = """mut AS (SELECT a.i, a.j, 1.0::DOUBLE AS w FROM knn a JOIN knn b ON a.i = b.j AND a.j = b.i), adj AS MATERIALIZED (SELECT * FROM mut UNION ALL SELECT spot_id, spot_id, 1.0 FROM {p} WHERE spot_id NOT IN (SELECT i FROM mut))"""
_PREC = """deg AS (SELECT i, sum(w) AS d FROM adj GROUP BY 1), prec AS MATERIALIZED (SELECT i, j, sum(v) AS v FROM (SELECT a.i, a.j, -0.99::DOUBLE * w / sqrt(x.d) / sqrt(y.d) AS v FROM adj a JOIN deg x ON x.i = a.i JOIN deg y ON y.i = a.j UNION ALL SELECT spot_id, spot_id, 1.0 FROM {p}) GROUP BY ALL)"""
_ROOT = """walk AS MATERIALIZED (WITH RECURSIVE w(a, b) AS (SELECT spot_id, spot_id FROM {p} UNION SELECT w.a, e.j FROM w JOIN (SELECT i, j FROM adj WHERE i <> j) e ON e.i = w.b) SELECT a, min(b) AS component FROM w GROUP BY a),
comp AS (SELECT a AS spot_id, component, count(*) OVER (PARTITION BY component) AS size FROM walk)"""


def _lattice_points(spark: SparkSession, d: str) -> DataFrame:
    return graph.with_coords(views.suppliers(spark, d).spots)


@add("knn_embedding", f"WITH {_PTS} SELECT i, j, round(d2, 6) AS d2, rank::INT AS rank FROM knn")
def knn_embedding(spark: SparkSession, d: str) -> DataFrame:
    return _round(graph.knn(views.embeddings(spark, d), 6), d2=6)


@add("knn_lattice", f"WITH {_LATTICE} SELECT i, j, d2, rank::INT AS rank FROM knn")
def knn_lattice(spark: SparkSession, d: str) -> DataFrame:
    return graph.knn(_lattice_points(spark, d), 4)


@add("mutual_knn", f"WITH {_PTS}, {_ADJ.format(p='pts')} SELECT * FROM adj")
def mutual_knn(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(views.embeddings(spark, d), 6)


@add("symmetric_knn", f"WITH {_LATTICE} SELECT i, j, sum(w) AS w FROM (SELECT i, j, 0.5::DOUBLE AS w FROM knn UNION ALL SELECT j, i, 0.5 FROM knn) GROUP BY ALL")
def symmetric_knn(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(_lattice_points(spark, d), 4, mutual_only=False)


@add("car_precision", f"WITH {_PTS}, {_ADJ.format(p='pts')}, {_PREC.format(p='pts')} SELECT i, j, round(v, 10) AS v FROM prec")
def car_precision(spark: SparkSession, d: str) -> DataFrame:
    p = views.embeddings(spark, d)
    return _round(graph.car_precision(p, graph.adjacency(p, 6)), v=10)


@add("precision_quadform", f"WITH {_LATTICE}, {_ADJ.format(p='sp')}, {_PREC.format(p='sp')}, {q.values('ir')} SELECT x.gene_id, x.ch, round(sum(v.v * x.y * y.y), 6) AS q FROM prec v JOIN v x ON x.spot_id = v.i JOIN v y ON y.spot_id = v.j AND y.gene_id = x.gene_id AND y.ch = x.ch GROUP BY ALL")
def precision_quadform(spark: SparkSession, d: str) -> DataFrame:
    data = views.suppliers(spark, d)
    p = graph.with_coords(data.spots)
    return _round(graph.precision_quadratic_form(graph.car_precision(p, graph.adjacency(p, 4)), hsic.sparse_values(data, "ir")), q=6)


@add("components", f"WITH {_PTS}, {_ADJ.format(p='pts')}, {_ROOT.format(p='pts')} SELECT * FROM comp")
def components(spark: SparkSession, d: str) -> DataFrame:
    p = views.embeddings(spark, d)
    return filters.component_sizes(p, graph.adjacency(p, 6))


@add("component_filter", f"WITH {_PTS}, {_ADJ.format(p='pts')}, {_ROOT.format(p='pts')} SELECT spot_id FROM comp WHERE size >= 3")
def component_filter(spark: SparkSession, d: str) -> DataFrame:
    p = views.embeddings(spark, d)
    data = Dataset(p, spark.createDataFrame([], "iso_id string, gene_id string, gene_name string, ord int"), spark.createDataFrame([], "spot_id long, iso_id string, n double"), graph.adjacency(p, 6))
    return filters.filter_components(data, 3).spots.select("spot_id")


# Loaders ----------------------------------------------------------------------------

_TRANS = """ev AS MATERIALIZED (SELECT user_id::DOUBLE AS x, date_sub('second', (SELECT min(ts) FROM events), ts) / 60.0::DOUBLE AS y, value AS qv, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS cw, 'cell_' || user_id AS cell_id FROM events)"""
_ORIGIN = f"{_TRANS}, og AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM ev)"


def _bin_query(size: float) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = views.transcripts(spark, d)
        return xenium.bin_transcripts(t, xenium.assigned(views.codewords(spark)), xenium.Grid.around(t, size))

    return run


for _s in (8.0, 16.0, 2.5):
    add(
        f"bin_transcripts_{xenium.resolution_name(_s).removeprefix('square_')}",
        f"WITH {_ORIGIN} SELECT floor((y - y0) / {_s})::INT AS row, floor((x - x0) / {_s})::INT AS col, cw::INT AS codeword_index, count(*)::DOUBLE AS n FROM ev, og WHERE qv >= 20 AND cw < 4 AND x >= x0 AND y >= y0 GROUP BY ALL",
    )(_bin_query(_s))


@add("bin_table", f"WITH {_ORIGIN}, rr AS (SELECT unnest(range((floor((y1 - y0) / 100) + 1)::BIGINT)) AS r FROM og), cc AS (SELECT unnest(range((floor((x1 - x0) / 100) + 1)::BIGINT)) AS c FROM og) SELECT printf('s_100um_%05d_%05d-1', r, c) AS barcode, r::INT AS row, c::INT AS col, x0 + (c + 0.5::DOUBLE) * 100 AS x, y0 + (r + 0.5::DOUBLE) * 100 AS y FROM rr, cc, og")
def bin_table(spark: SparkSession, d: str) -> DataFrame:
    return xenium.bin_table(spark, xenium.Grid.around(views.transcripts(spark, d), 100), xenium.resolution_name(100)).drop("corners")


@add("cell_codeword", f"WITH {_TRANS} SELECT cell_id, cw::INT AS codeword_index, count(*)::DOUBLE AS n FROM ev WHERE qv >= 20 AND cw < 4 GROUP BY ALL")
def cell_codeword(spark: SparkSession, d: str) -> DataFrame:
    t = views.transcripts(spark, d)
    cells = t.select("cell_id").distinct()
    return xenium.cell_codewords(t, views.codewords(spark), cells)[0]


@add("bin_aggregate_mapping", f"WITH {q.VIEW} SELECT 'bin_' || (spot_id // 4) AS barcode, iso_id AS feature, sum(n) AS n FROM ct GROUP BY ALL")
def bin_aggregate_mapping(spark: SparkSession, d: str) -> DataFrame:
    data = views.suppliers(spark, d)
    small = lambda c: F.concat(F.lit("s_"), c.cast("string"))
    mapping = data.spots.select(small(F.col("spot_id")).alias("square_002um"), F.concat(F.lit("bin_"), F.floor(F.col("spot_id") / 4).cast("string")).alias("square_008um"))
    counts = data.counts.select(small(F.col("spot_id")).alias("barcode"), F.col("iso_id").alias("feature"), "n")
    return visium.aggregate_bins(counts, mapping, visium.bin_name(8))[0]


@add("in_tissue_semijoin", f"WITH {q.VIEW} SELECT spot_id AS barcode, iso_id, n FROM ct JOIN sp USING (spot_id) WHERE s_acctbal > 0")
def in_tissue_semijoin(spark: SparkSession, d: str) -> DataFrame:
    data = views.suppliers(spark, d)
    positions = data.spots.select(F.col("spot_id").alias("barcode"), (F.col("s_acctbal") > 0).cast("int").alias("in_tissue"))
    return visium.in_tissue(data.counts.withColumnRenamed("spot_id", "barcode"), positions)


# Likelihoods and models ---------------------------------------------------------------

_PROB = f"{q.VIEW}, po AS (SELECT gene_id, iso_id, c / sum(c) OVER (PARTITION BY gene_id) AS p FROM (SELECT gene_id, iso_id, sum(n) AS c FROM ct GROUP BY ALL))"


def _with_pooled(spark: SparkSession, d: str) -> DataFrame:
    data = views.suppliers(spark, d)
    held = data.counts.join(data.isoforms.select("iso_id", "gene_id"), "iso_id")
    total = held.groupBy("gene_id").agg(F.sum("n").alias("t"))
    pooled = held.groupBy("gene_id", "iso_id").agg(F.sum("n").alias("c")).join(total, "gene_id").select("iso_id", (F.col("c") / F.col("t")).alias("prob"))
    return ratios.covered_counts(data).join(pooled, "iso_id").withColumn("conc", 5.0 * F.col("prob"))


@add("loglik_multinomial", f"WITH {_PROB}, tot AS (SELECT gene_id, spot_id, sum(n) AS t, sum(n * ln(p) - lgamma(n + 1)) AS c FROM ct JOIN po USING (gene_id, iso_id) GROUP BY ALL) SELECT gene_id, round(sum(c + lgamma(t + 1)), 4) AS ll FROM tot GROUP BY 1")
def loglik_multinomial(spark: SparkSession, d: str) -> DataFrame:
    return _round(likelihood.multinomial(_with_pooled(spark, d), ["gene_id"]), ll=4)


@add(
    "loglik_dm",
    f"""WITH {_PROB}, {q.BASE}, x AS (SELECT b.gene_id, spot_id, n, 5 * p AS a FROM base b JOIN po USING (gene_id, iso_id)),
s AS (SELECT gene_id, spot_id, sum(n) AS t, sum(a) AS a, sum(lgamma(n + a) - lgamma(a) - lgamma(n + 1)) AS c FROM x GROUP BY ALL) SELECT gene_id, round(sum(c + lgamma(a) - lgamma(t + a) + lgamma(t + 1)), 4) AS ll FROM s GROUP BY 1""",
)
def loglik_dm(spark: SparkSession, d: str) -> DataFrame:
    return _round(likelihood.dirichlet_multinomial(_with_pooled(spark, d), ["gene_id"]), ll=4)


@add(
    "sv_projection",
    f"""WITH {q.VIEW}, {q.values('gc')}, m AS (SELECT avg(q) AS mu, avg(r) AS mv, var_pop(q) * any_value(n) AS suu, var_pop(r) * any_value(n) AS svv, covar_pop(q, r) * any_value(n) AS suv FROM sp, nn),
s AS (SELECT gene_id, sum(y) AS s1, sum(y * y) AS s2, sum(y * (q - mu)) AS a, sum(y * (r - mv)) AS b FROM v JOIN sp USING (spot_id), m GROUP BY 1),
st AS MATERIALIZED (SELECT gene_id, n * (a * a * svv - 2 * a * b * suv + b * b * suu) / (suu * svv - suv * suv) / (s2 - s1 * s1 / n) AS statistic FROM s, m, nn),
res AS MATERIALIZED (SELECT *, exp(-statistic / 2) AS pvalue FROM st), adj AS ({q.adjusted("res")}) SELECT gene_id, round(statistic, 6) AS statistic, round(pvalue, 6) AS pvalue, round(pvalue_adj, 6) AS pvalue_adj FROM adj""",
)
def sv_projection(spark: SparkSession, d: str) -> DataFrame:
    data = views.suppliers(spark, d)
    return _round(models.projection_test(data, graph.with_coords(data.spots), data.n_spots()), statistic=6, pvalue=6, pvalue_adj=6)


def _places(spark: SparkSession, d: str) -> models.PlaceModel:
    return models.PlaceModel().setup_data(views.suppliers(spark, d), min_counts=0)


@add("sv_car_dense")
def sv_car_dense(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).test_spatial_variability("hsic-ir")


@add("sv_car_masked")
def sv_car_masked(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).test_spatial_variability("hsic-ir", nan_filling="none")


@add("sv_gene_counts")
def sv_gene_counts(spark: SparkSession, d: str) -> DataFrame:
    return models.gene_count_test(views.suppliers(spark, d), min_counts=100, min_bin_pct=0.1)


@add("du_hsic_gp")
def du_hsic_gp(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).test_differential_usage("hsic-gp")


@add("du_hsic_gp_raster")
def du_hsic_gp_raster(spark: SparkSession, d: str) -> DataFrame:
    return _raster(spark, d).test_differential_usage("hsic-gp", residualize="both")


@add("gp_fourier")
def gp_fourier(spark: SparkSession, d: str) -> DataFrame:
    data = views.suppliers(spark, d)
    design = data.design.select(F.col("factor").alias("series"), "spot_id", F.col("z").alias("y"))
    return gp.residual_columns(design, _lattice_points(spark, d), data.n_spots(), "fourier", length=2.0)


@add("glm_wald")
def glm_wald(spark: SparkSession, d: str) -> DataFrame:
    data = views.suppliers(spark, d)
    scaled = data.design.where("factor <> 'region_AFRICA'").withColumn("z", F.when(F.col("factor") == "s_acctbal", F.col("z") / 10_000).otherwise(F.col("z")))
    m = models.LogitModel("glm").setup_data(data.with_(design=scaled), min_counts=0)
    m.fit(with_design=True)
    return m.test_differential_usage("wald")


@add("glm_fitted_ratios", f"WITH {q.VIEW}, ty AS (SELECT gene_id, iso_id, count(*) OVER (PARTITION BY gene_id) AS k FROM isoo), su AS (SELECT iso_id, sum(n) AS c FROM ct GROUP BY 1), pr AS (SELECT gene_id, iso_id, coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY gene_id) AS ratio FROM ty LEFT JOIN su USING (iso_id) WHERE k > 1) SELECT gene_id, iso_id, spot_id, round(ratio, 5) AS ratio FROM pr, sp WHERE ratio > 0")
def glm_fitted_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Without covariates the fitted ratios are the pooled shares."""
    m = models.LogitModel("glm").setup_data(views.suppliers(spark, d), min_counts=0)
    return _round(glm.at_places(glm.fitted_ratios(m.fit(), m.index), m.index), ratio=5)


@add("glmm_llr")
def glmm_llr(spark: SparkSession, d: str) -> DataFrame:
    """On the events view's smaller lattice: users and event types."""
    m = models.LogitModel("glmm-full").setup_data(_user_events(spark, d), min_counts=0)
    return m.test_spatial_variability()


def _user_events(spark: SparkSession, d: str) -> Dataset:
    """Users on a lattice fifteen wide; event types in two groups."""
    e = views.table(spark, d, "events").select(F.col("user_id").alias("spot_id"), F.concat(F.lit("g"), (F.crc32("event_type") % 2).cast("string")).alias("gene_id"), F.col("event_type").alias("iso_id"))
    spots = e.select("spot_id").distinct().select("spot_id", (F.col("spot_id") % 15).cast("double").alias("x"), F.floor(F.col("spot_id") / 15).cast("double").alias("y"))
    counts = e.groupBy("spot_id", "iso_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return Dataset(spots, views._isoforms(e.select("iso_id", "gene_id")), counts)


@add("kernel_apply_distributed")
def kernel_apply_distributed(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed totals with kernel and columns both distributed (moderate rho)."""
    data = views.suppliers(spark, d)
    p = graph.with_coords(data.spots)
    full = p.select("spot_id").crossJoin(data.isoforms.select("gene_id").distinct())
    v = full.join(hsic.sparse_values(data, "gc"), ["gene_id", "spot_id"], "left").select("gene_id", F.col("gene_id").alias("ch"), "spot_id", F.coalesce("y", F.lit(0.0)).alias("y"))
    return distributed_apply(graph.car_precision(p, graph.adjacency(p, 4), 0.5), v, rho=0.5, tol=1e-4)


@add("simulate_counts")
def simulate_counts(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    side = np.arange(6)
    xy = np.stack([g.ravel() for g in np.meshgrid(side, side)], axis=1).astype(float)
    return simulate.simulate(spark, gp.rbf(xy, xy, 1.5), n_groups=10, n_features=3)
