"""Differential usage: does a group's profile go with a covariate?

Everything is sums over places: cross products of centred responses with
covariates, Gram matrices, group means and variances.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave.functions.dist import chi2_sf, fisher_combine, liu_sf, t_sf2, tippett_combine
from spotweave.functions.fdr import adjust
from spotweave.operators.design import factor_moments, missing
from spotweave.operators.hsic import feature_cumulants, sparse_values
from spotweave.operators.ratios import ratios
from spotweave.schema import Dataset, one_of


def _all_pairs(data: Dataset, design: DataFrame) -> DataFrame:
    """(gene_id, n_isos, covariate): the rows a result must have. Both sides are
    short lists (groups and covariates), not data."""
    groups = data.isoforms.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n_isos"))
    return groups.crossJoin(design.select(F.col("factor").alias("covariate")).distinct())


def linear_hsic(values: DataFrame, design: DataFrame, n_spots: int) -> DataFrame:
    """(gene_id, covariate, statistic, pvalue) of |Y'Z|^2/(n-1)^2 for values
    (gene_id, ch, spot_id, y; absent rows zero) and each covariate.

    The null is a weighted sum of chi-squares with weights the products of the
    eigenvalues of Y'Y and Z'Z over n.
    """
    n = F.lit(float(n_spots))
    z = factor_moments(design, n_spots).select("factor", F.col("mean").alias("zm"), "ss")
    cross = values.join(design, "spot_id").groupBy("gene_id", "factor", "ch").agg(F.sum(F.col("y") * F.col("z")).alias("yz"))
    total = values.groupBy("gene_id", "ch").agg(F.sum("y").alias("ys"))
    per = total.crossJoin(F.broadcast(z)).join(cross, ["gene_id", "factor", "ch"], "left")
    scaled = per.groupBy("gene_id", "factor", "ss").agg(F.sum(F.pow(F.coalesce("yz", F.lit(0.0)) - F.col("ys") * F.col("zm"), F.lit(2))).alias("q"))
    both = scaled.join(feature_cumulants(values, n_spots), "gene_id")
    c = [F.col(f"f{p}") * F.pow("ss", F.lit(p)) for p in (1, 2, 3, 4)]
    return both.select("gene_id", F.col("factor").alias("covariate"), (F.col("q") / F.pow(F.greatest(n - 1, F.lit(1.0)), F.lit(2))).alias("statistic"), liu_sf(F.col("q") * n, *c).alias("pvalue"))


def complete_hsic(values: DataFrame, design: DataFrame, n_spots: int) -> DataFrame:
    """linear_hsic, where each covariate is tested on the places at which it is
    not missing."""
    gaps = missing(design)
    out = linear_hsic(values, design.where(~F.col("factor").isin(list(gaps))), n_spots)
    for factor, k in gaps.items():
        own = design.where(F.col("factor") == factor)
        here = values.join(own.where(F.isnan("z")).select("spot_id").distinct(), "spot_id", "left_anti")
        if n_spots - k > 1:
            out = out.union(linear_hsic(here, own.where(~F.isnan("z")), n_spots - k))
    return out


def _finish(data: Dataset, design: DataFrame, tested: DataFrame) -> DataFrame:
    out = _all_pairs(data, design).join(tested, ["gene_id", "covariate"], "left")
    out = out.select("gene_id", "covariate", F.coalesce("statistic", F.lit(0.0)).alias("statistic"), F.coalesce("pvalue", F.lit(1.0)).alias("pvalue"))
    return adjust(out, by=["covariate"], order=["gene_id"])


def differential_usage(data: Dataset, design: DataFrame, n_spots: int, kind: str = "ir", transform: str = "none") -> DataFrame:
    """(gene_id, covariate, statistic, pvalue, pvalue_adj) by linear HSIC; the
    adjustment is within each covariate. A covariate with missing numbers is
    tested on the places that have it."""
    return _finish(data, design, complete_hsic(sparse_values(data, kind, transform, n_spots), design, n_spots))


def two_sample(data: Dataset, design: DataFrame, n_spots: int, full_places: bool = False) -> DataFrame:
    """(gene_id, covariate, iso_id, t, df, p, n0, n1): pooled Student tests of
    each feature's ratios between the two values of each covariate. Places
    without ratio are left out."""
    level = factor_moments(design, n_spots).where("levels = 2").select("factor", F.col("lo"), F.col("hi"))
    group = data.spots.select("spot_id").crossJoin(F.broadcast(level)).join(design, ["spot_id", "factor"], "left")
    group = group.where(~F.coalesce(F.isnan("z"), F.lit(False))).select("spot_id", F.col("factor").alias("covariate"), (F.coalesce("z", F.lit(0.0)) > (F.col("lo") + F.col("hi")) / 2).cast("int").alias("g"))
    r = ratios(data, "none", n_spots)
    s = r.join(group, "spot_id").groupBy("gene_id", "covariate", "iso_id").agg(
        *(f(F.when(F.col("g") == g, F.col("r"))).alias(f"{name}{g}") for g in (0, 1) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)))
    )
    df = (F.col("n0") + F.col("n1") - 2).cast("double")
    pooled = (F.coalesce((F.col("n0") - 1) * F.col("v0"), F.lit(0.0)) + F.coalesce((F.col("n1") - 1) * F.col("v1"), F.lit(0.0))) / F.nullif(df, F.lit(0.0))
    t = F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(F.nullif(pooled, F.lit(0.0)) * (F.try_divide(F.lit(1.0), F.col("n0")) + F.try_divide(F.lit(1.0), F.col("n1")))))
    return s.select("gene_id", "covariate", "iso_id", t.alias("t"), df.alias("df"), t_sf2(t, df).alias("p"), "n0", "n1")


def t_test_usage(data: Dataset, design: DataFrame, n_spots: int, method: str = "t-fisher", raster: bool = False) -> DataFrame:
    """(gene_id, covariate, statistic, pvalue, pvalue_adj): the features' t-tests
    combined by Fisher's or Tippett's rule.

    On a raster, features with fewer than three places in a group count with
    p = 1 and Tippett's statistic is -log10 of the least p; else it is that p.
    """
    one_of(method, ("t-fisher", "t-tippett"), "method")
    each = two_sample(data, design, n_spots)
    if raster:
        each = each.withColumn("p", F.when((F.col("n0") < 3) | (F.col("n1") < 3) | F.col("p").isNull(), 1.0).otherwise(F.col("p")))
        each = data.isoforms.select("gene_id", "iso_id").crossJoin(design.select(F.col("factor").alias("covariate")).distinct()).join(each.drop("gene_id"), ["iso_id", "covariate"], "left").fillna(1.0, ["p"])
    each = each.where("p is not null")
    per = each.groupBy("gene_id", "covariate").agg(F.sum(F.ln(F.greatest("p", F.lit(1e-300)))).alias("lp"), F.min("p").alias("least"), F.count(F.lit(1)).alias("k"))
    if method == "t-fisher":
        tested = per.select("gene_id", "covariate", (-2 * F.col("lp")).alias("statistic"), fisher_combine(F.col("lp"), F.col("k")).alias("pvalue"))
    else:
        stat = -F.log10(F.greatest("least", F.lit(1e-300))) if raster else F.col("least")
        tested = per.select("gene_id", "covariate", stat.alias("statistic"), tippett_combine(F.col("least"), F.col("k")).alias("pvalue"))
    return _finish(data, design, tested)


def score_test(data: Dataset, design: DataFrame, n_spots: int) -> DataFrame:
    """(gene_id, covariate, statistic, pvalue, pvalue_adj): score test of each
    covariate in a multinomial logit model without covariates.

    That model's fit is the pooled ratios, so with scores s and places' totals N
    the statistic is sum(s_j^2/pi_j) / sum(z^2 N) over all features: the inverse
    of diag(pi) - pi pi' is known. Chi-squared with one less than the group's
    seen features.
    """
    iso = data.isoforms.select("iso_id", "gene_id")
    held = data.counts.where("n <> 0").join(iso, "iso_id")
    pooled = held.groupBy("gene_id", "iso_id").agg(F.sum("n").alias("c"))
    pooled = pooled.withColumn("pi", F.col("c") / F.sum("c").over(Window.partitionBy("gene_id"))).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("gene_id")))
    zn = held.join(design, "spot_id").groupBy("gene_id", "iso_id", F.col("factor").alias("covariate")).agg(F.sum(F.col("n") * F.col("z")).alias("zn"), F.sum(F.col("n") * F.col("z") * F.col("z")).alias("zzn"))
    zt = zn.groupBy("gene_id", "covariate").agg(F.sum("zn").alias("zt"), F.sum("zzn").alias("a"))
    per = pooled.join(zt, "gene_id").join(zn.select("gene_id", "iso_id", "covariate", "zn"), ["gene_id", "iso_id", "covariate"], "left")
    s = F.coalesce("zn", F.lit(0.0)) - F.col("pi") * F.col("zt")
    out = per.groupBy("gene_id", "covariate", "k", "a").agg(F.sum(s * s / F.col("pi")).alias("q"))
    stat = F.coalesce(F.try_divide("q", "a"), F.lit(0.0))
    tested = out.select("gene_id", "covariate", stat.alias("statistic"), F.when(F.col("k") <= 1, 1.0).otherwise(chi2_sf(stat, F.col("k") - 1)).alias("pvalue"))
    return _finish(data, design, tested)
