"""The three kinds of analysis, each set up, tested, and read as tables.

Models hold plans and small driver state (a kernel, its traces), never data.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotweave.functions.dist import chi2_sf, null_method
from spotweave.functions.fdr import adjust
from spotweave.operators import design as dz
from spotweave.operators import glm, gp, graph, hsic, summaries, usage
from spotweave.operators.filters import filter_components, filter_features, filter_groups, require_rows
from spotweave.operators.kernels import DENSE_LIMIT, IdentityKernel, Kernel, TorusKernel, car_kernel
from spotweave.plans.chunks import workers
from spotweave.schema import Dataset, one_of
from spotweave.sources.sinks import formatted, load, save
from spotweave.store import write_table

SV_METHODS = ("hsic-ir", "hsic-ic", "hsic-gc")
DU_METHODS = ("hsic", "hsic-gp", "t-fisher", "t-tippett")


def dense_index(spots: DataFrame) -> DataFrame:
    """(spot_id, pos): places numbered 0.. by id, without one task for all: ranks
    within range partitions plus the sizes of those before."""
    ranged = write_table(spots.select("spot_id").distinct().repartitionByRange("spot_id").withColumn("part", F.spark_partition_id()), "index")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    before = sizes.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))  # a row a partition
    at = F.row_number().over(Window.partitionBy("part").orderBy("spot_id")) - 1
    return ranged.withColumn("at", at).join(F.broadcast(before), "part").select("spot_id", (F.col("before") + F.col("at")).alias("pos"))


def with_features(kept: Dataset, data: Dataset) -> Dataset:
    """``kept``, a filter's choice of the features of ``data``, with them written
    as a table."""
    iso = write_table(kept.isoforms, "features")
    return kept.with_(isoforms=iso, counts=data.counts.join(iso.select("iso_id"), "iso_id", "left_semi"))


class _Model:
    data: Dataset
    n: int

    def _setup(self, data: Dataset, min_counts: float, min_bin_pct: float, single_isoform: bool, min_component_size: int = 1, stored: bool = False) -> None:
        """``stored``: counts are a table already."""
        data = filter_components(data.checked(), min_component_size)
        self.n = data.n_spots()
        if not self.n:
            raise ValueError("no place is left after filtering")
        if not stored:  # filters and tests read them many times
            data = data.with_(counts=write_table(data.counts, "counts"))
        self.data = with_features(filter_features(data, min_counts, min_bin_pct, single_isoform, self.n), data)
        require_rows(self.data.isoforms, "no feature is left after filtering")
        self.sv: DataFrame | None = None
        self.du: DataFrame | None = None

    def feature_summary(self, level: str = "gene") -> DataFrame:
        one_of(level, ("gene", "isoform"), "level")
        return summaries.gene_summary(self.data, self.n) if level == "gene" else summaries.isoform_summary(self.data, self.n)

    def results(self, which: str = "sv", with_summary: bool = False) -> DataFrame:
        one_of(which, ("sv", "du"), "result")
        found = self.sv if which == "sv" else self.du
        if found is None:
            raise ValueError(f"no {which} test has been run")
        return formatted(found, self.data.isoforms, self.feature_summary() if with_summary else None)

    def design_long(self) -> DataFrame:
        if self.data.design is None:
            raise ValueError("no covariates were set up")
        return self.data.design

    def _residual_usage(self, spots: DataFrame, method: str, both: bool, length: float) -> DataFrame:
        """Linear HSIC of ratios with covariates' GP residuals, scaled to unit
        variance; with ``both``, the ratios' residuals too."""
        d = self.design_long()
        dz.check_variance(d, self.n, 0.0)
        dz.check_variance(d, self.n, 1e-5, strict=False)
        gaps = dz.missing(d)
        if gaps:
            raise ValueError(f"missing numbers in {', '.join(sorted(gaps))}: fill them or leave those places out")
        res = gp.residual_columns(d.select(F.col("factor").alias("series"), "spot_id", F.col("z").alias("y")), spots, self.n, method, length)
        w = Window.partitionBy("series")
        centred = (F.col("res") - F.avg("res").over(w)) / F.nullif(F.stddev_pop("res").over(w), F.lit(0.0))
        z = write_table(res.select("spot_id", F.col("series").alias("factor"), F.coalesce(centred, F.lit(0.0)).alias("z")), "gp-covariates")
        y = hsic.sparse_values(self.data, "ir", "none", self.n)
        if both:
            key = F.to_json(F.struct("gene_id", "ch"))
            out = gp.residual_columns(y.select(key.alias("series"), "spot_id", "y"), spots, self.n, method, length)
            part = F.from_json("series", "gene_id string, ch string")
            y = out.select(part["gene_id"].alias("gene_id"), part["ch"].alias("ch"), "spot_id", F.col("res").alias("y"))
        return usage._finish(self.data, d, usage.linear_hsic(write_table(y, "gp-responses"), z, self.n))


class PlaceModel(_Model):
    """Tests on places anywhere, with a neighbour graph given or built."""

    def __init__(self, k_neighbors: int = 4, rho: float = 0.99, standardize_cov: bool = True, mutual: bool = True):
        self.k, self.rho, self.standardise, self.mutual = k_neighbors, rho, standardize_cov, mutual

    def setup_data(self, data: Dataset, min_counts: float = 10, min_bin_pct: float = 0.0, filter_single_iso_genes: bool = True, min_component_size: int = 1, skip_kernel: bool = False) -> PlaceModel:
        data = data.checked()
        data = data.with_(spots=write_table(data.spots, "places"))
        points = graph.with_coords(data.spots)
        with ThreadPoolExecutor(1) as beside:  # the graph takes many short jobs, which leave room for the counts
            counts = beside.submit(write_table, data.counts, "counts")
            if data.adjacency is None:
                data = data.with_(adjacency=write_table(graph.adjacency(points, self.k, self.mutual), "adjacency"))
            else:
                data = data.with_(adjacency=graph.checked_adjacency(data.adjacency, data.n_spots()))
            data = data.with_(counts=counts.result())
        self._setup(data, min_counts, min_bin_pct, filter_single_iso_genes, min_component_size, stored=True)
        self.points = graph.with_coords(self.data.spots)
        self.index = dense_index(self.data.spots)
        self.precision = None if skip_kernel else write_table(graph.car_precision(self.points, self.data.adjacency, self.rho), "precision")
        self._kernel: Kernel | None = IdentityKernel(self.n) if skip_kernel else None
        return self

    @property
    def kernel(self) -> Kernel:
        """Made when a test first asks for it."""
        if self._kernel is None:
            self._kernel = car_kernel(self.precision, self.n, self.standardise)
        return self._kernel

    def test_spatial_variability(self, method: str = "hsic-ir", null: str = "liu", ratio_transformation: str = "none", nan_filling: str = "mean", permutations: int = 1000, n_jobs: int = -1, seed: int = 0) -> DataFrame:
        workers(n_jobs)
        if method == "spark-x":
            self.sv = projection_test(self.data, self.points, self.n)
            return self.sv
        one_of(method, SV_METHODS, "method")
        if nan_filling == "none" and method == "hsic-ir":
            kernel = car_kernel(self.precision, self.n, self.standardise, centred=False)
        else:
            kernel = self.kernel
        self.sv = hsic.spatial_variability(self.data, self.index, kernel, self.n, method[-2:], null, ratio_transformation, nan_filling, permutations, seed=seed)
        return self.sv

    def test_differential_usage(self, method: str = "hsic-gp", ratio_transformation: str = "none", gpr_backend: str = "auto", residualize: str = "cov_only", length_scale: float = 1.0, n_jobs: int = -1) -> DataFrame:
        workers(n_jobs)
        one_of(method, DU_METHODS, "method")
        one_of(residualize, ("cov_only", "both"), "residualize")
        d = self.design_long()
        if method == "hsic":
            dz.check_variance(d, self.n)
            self.du = usage.differential_usage(self.data, d, self.n, "ir", ratio_transformation)
        elif method == "hsic-gp":
            scaled = dz.zscore(self.data.spots.select("spot_id", "x", "y")) if "coords" not in self.data.spots.columns else self.points
            self.du = self._residual_usage(graph.with_coords(scaled), gpr_backend, residualize == "both", length_scale)
        else:
            dz.check_binary(d, self.n)
            self.du = usage.t_test_usage(self.data, d, self.n, method)
        return self.du


class RasterModel(_Model):
    """Tests on a raster taken as periodic; every cell is a place."""

    def __init__(self, rho: float = 0.99, neighbor_degree: int = 1, spacing: tuple[float, float] = (1.0, 1.0)):
        self.rho, self.degree, self.spacing = rho, neighbor_degree, spacing

    def setup_data(self, data: Dataset, shape: tuple[int, int], min_counts: float = 10, min_bin_pct: float = 0.0, filter_single_iso_genes: bool = True) -> RasterModel:
        self.shape = shape
        self._setup(rasterise(data, shape), min_counts, min_bin_pct, filter_single_iso_genes)
        self.index = self.data.spots.select("spot_id", (F.col("row") * shape[1] + F.col("col")).alias("pos"))
        self.kernel = TorusKernel(shape, self.spacing, self.rho, self.degree)
        return self

    def test_spatial_variability(self, method: str = "hsic-ir", null: str = "liu", ratio_transformation: str = "none", permutations: int = 1000, n_jobs: int = -1, permutation=None) -> DataFrame:
        workers(n_jobs)
        one_of(method, SV_METHODS, "method")
        self.sv = hsic.spatial_variability(self.data, self.index, self.kernel, self.n, method[-2:], null, ratio_transformation, permutations=permutations, permutation=permutation)
        return self.sv

    def test_differential_usage(self, method: str = "hsic-gp", ratio_transformation: str = "none", residualize: str = "cov_only", length_scale: float = 1.0, n_jobs: int = -1) -> DataFrame:
        workers(n_jobs)
        one_of(method, DU_METHODS, "method")
        d = self.design_long()
        if method == "hsic":
            dz.check_variance(d, self.n)
            self.du = usage.differential_usage(self.data, d, self.n, "ir", ratio_transformation)
        elif method == "hsic-gp":
            cells = self.data.spots.select("spot_id", F.array(F.col("row") * self.spacing[0], F.col("col") * self.spacing[1]).alias("coords"))
            self.du = self._residual_usage(cells, "raster", residualize == "both", length_scale)
        else:
            dz.check_binary(d, self.n)
            self.du = usage.t_test_usage(self.data, d, self.n, method, raster=True)
        return self.du


class LogitModel(_Model):
    """Multinomial logit models, with or without spatial effects."""

    def __init__(self, model_type: str = "glmm-full", k_neighbors: int = 4, rho: float = 0.99, standardize_cov: bool = True, approx_rank: int | None = None, fitting_method: str | None = None, var_prior: str = "none"):
        self.model_type = one_of(model_type, ("glm", "glmm-full", "glmm-null"), "model type")
        self.k, self.rho, self.standardise, self.rank, self.method, self.prior = k_neighbors, rho, standardize_cov, approx_rank, fitting_method, var_prior

    def setup_data(self, data: Dataset, min_counts: float = 10, min_bin_pct: float = 0.0, filter_single_iso_genes: bool = True, min_component_size: int = 1) -> LogitModel:
        if self.model_type != "glm" and data.adjacency is None:
            data = data.with_(adjacency=write_table(graph.adjacency(graph.with_coords(data.spots), self.k), "adjacency"))
        self._setup(data, min_counts, min_bin_pct, filter_single_iso_genes, min_component_size)
        self.index = write_table(dense_index(self.data.spots), "index")
        self.eigen = None
        if self.model_type != "glm":
            precision = graph.car_precision(graph.with_coords(self.data.spots), self.data.adjacency, self.rho)
            if self.rank is None or self.rank >= self.n:
                kernel = car_kernel(write_table(precision, "precision"), self.n, self.standardise, centred=False, dense_limit=0)
                if kernel.factor() is not None:
                    self.eigen = (kernel, None)
                    return self
            if self.n > DENSE_LIMIT:
                raise ValueError(f"spatial logit models without a factor over levels of places, or of a lower rank, take up to {DENSE_LIMIT} places")
            kernel = car_kernel(precision, self.n, self.standardise, centred=False)
            rank = self.rank or (self.n if self.n <= DENSE_LIMIT else math.ceil(4 * math.sqrt(self.n)))
            lam, q = kernel.eigen()
            self.eigen = (np.maximum(np.where(np.arange(self.n) < rank, lam, lam[rank - 1] if rank < self.n else lam), 1e-6), q)
        return self

    def design_matrix(self) -> tuple[np.ndarray, list[str]]:
        d = self.design_long()
        names = sorted(r["factor"] for r in d.select("factor").distinct().collect())
        t = d.join(self.index, "spot_id").select("pos", "factor", "z").toArrow()
        x = np.zeros((self.n, len(names)))
        x[t["pos"].to_numpy(), np.searchsorted(names, t["factor"].to_pylist())] = t["z"].to_numpy()
        return x, names

    def fit(self, with_design: bool = False, model: str | None = None) -> DataFrame:
        """One row of parameters a group, written to the shared folder."""
        self.factors: list[str] = []
        x = None
        if with_design:
            x, self.factors = self.design_matrix()
        self.models = write_table(glm.fit_models(self.data, self.index, self.n, x, model or self.model_type, self.eigen, self.method, self.prior), "models")
        return self.models

    def save(self, path: str) -> None:
        """Fitted models, numbered places and settings, as Parquet under ``path``."""
        spark = self.models.sparkSession
        kept = {"model_type": self.model_type, "k_neighbors": self.k, "rho": self.rho, "standardize_cov": self.standardise, "approx_rank": self.rank, "fitting_method": self.method, "var_prior": self.prior}
        save(self.models, f"{path}/models")
        save(self.index, f"{path}/index")
        save(self.data.isoforms, f"{path}/isoforms")
        save(spark.createDataFrame([(json.dumps({"settings": kept, "factors": self.factors, "n": self.n}),)], "value string"), f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LogitModel:
        """A saved model: its parameters, summaries, fitted ratios and Wald test
        are there; tests that need counts need ``setup_data`` first."""
        kept = json.loads(load(spark, f"{path}/settings").first()[0])
        out = cls(**kept["settings"])
        out.factors, out.n, out.sv, out.du = kept["factors"], kept["n"], None, None
        out.models, out.index = load(spark, f"{path}/models"), load(spark, f"{path}/index")
        out.data = Dataset(out.index.select("spot_id"), load(spark, f"{path}/isoforms"), None)
        return out

    def fitted_ratios(self) -> DataFrame:
        """(gene_id, iso_id, spot_id, ratio) of the fitted models."""
        x = self.design_matrix()[0] if self.factors else None
        return glm.at_places(glm.fitted_ratios(self.models, self.index, x), self.index)

    def training_summary(self) -> DataFrame:
        return self.models.select("gene_id", "model", "ll", "steps", "converged", "s2", "theta")

    def gene_model(self, gene_id: str) -> DataFrame:
        return require_rows(self.models.where(F.col("gene_id") == gene_id), f"no model of {gene_id}")

    def test_spatial_variability(self, permutations: int = 0, seed: int = 0) -> DataFrame:
        if self.model_type == "glm":
            raise ValueError("a model without spatial effects has no spatial test")
        if permutations:
            self.sv = glm.llr_permutation_test(self.data, self.index, self.n, self.eigen, permutations, seed)
        else:
            self.sv = glm.llr_test(self.fit(model="glmm-full"), glm.fit_models(self.data, self.index, self.n, None, "glmm-null", self.eigen, self.method, self.prior))
        return self.sv

    def test_differential_usage(self, method: str = "score") -> DataFrame:
        """``score`` needs a fit without covariates, ``wald`` one with them."""
        one_of(method, ("score", "wald"), "method")
        fitted = bool(getattr(self, "factors", []))
        if method == "wald" and not fitted:
            raise ValueError("the Wald test needs models fitted with covariates")
        if method == "score" and fitted:
            raise ValueError("the score test needs models fitted without covariates")
        self.du = glm.wald_test(self.models, self.factors) if method == "wald" else usage.score_test(self.data, self.design_long(), self.n)
        return self.du


def rasterise(data: Dataset, shape: tuple[int, int]) -> Dataset:
    """Every cell of the raster a place; cells without a place are new ones with
    ids -1 - cell number, and have no counts."""
    spark = data.spots.sparkSession
    grid = spark.range(shape[0] * shape[1]).select((F.col("id") / shape[1]).cast("int").alias("row"), (F.col("id") % shape[1]).cast("int").alias("col"), "id")
    outside = data.spots.where((F.col("row") < 0) | (F.col("row") >= shape[0]) | (F.col("col") < 0) | (F.col("col") >= shape[1]))
    if not outside.isEmpty():
        raise ValueError(f"places lie outside the {shape[0]} x {shape[1]} raster")
    spots = grid.join(data.spots, ["row", "col"], "left").withColumn("spot_id", F.coalesce("spot_id", -1 - F.col("id"))).drop("id")
    return data.with_(spots=spots)


def gene_count_test(data: Dataset, min_counts: float = 0, min_bin_pct: float = 0.0, null: str = "liu", min_component_size: int = 1, k_neighbors: int = 4, rho: float = 0.99, standardize_cov: bool = True) -> DataFrame:
    """Spatial variability of group totals alone, with filters on the totals."""
    m = PlaceModel(k_neighbors, rho, standardize_cov)
    m.setup_data(data, 0, 0.0, False, min_component_size)
    kept = with_features(filter_groups(m.data, min_counts, min_bin_pct, m.n), m.data)
    require_rows(kept.isoforms, "no group is left after filtering")
    return hsic.spatial_variability(kept, m.index, m.kernel, m.n, "gc", null_method(null))


def projection_test(data: Dataset, points: DataFrame, n: int) -> DataFrame:
    """(gene_id, statistic, pvalue, pvalue_adj): covariance test of totals with
    the plane of coordinates (projection kernels): n times the explained share of
    the centred sum of squares is compared with a chi-square of two degrees."""
    xy = points.select("spot_id", F.col("coords")[0].alias("u"), F.col("coords")[1].alias("v"))
    m = xy.agg(F.avg("u").alias("mu"), F.avg("v").alias("mv"), (F.var_pop("u") * n).alias("suu"), (F.var_pop("v") * n).alias("svv"), (F.covar_pop("u", "v") * n).alias("suv")).first()
    det = m["suu"] * m["svv"] - m["suv"] ** 2
    t = hsic.sparse_values(data, "gc").join(xy, "spot_id").withColumn("u", F.col("u") - m["mu"]).withColumn("v", F.col("v") - m["mv"])
    s = t.groupBy("gene_id").agg(F.sum("y").alias("s1"), F.sum(F.col("y") * F.col("y")).alias("s2"), F.sum(F.col("y") * F.col("u")).alias("a"), F.sum(F.col("y") * F.col("v")).alias("b"))
    explained = (F.col("a") * F.col("a") * m["svv"] - 2 * F.col("a") * F.col("b") * m["suv"] + F.col("b") * F.col("b") * m["suu"]) / (det or 1.0)
    whole = F.col("s2") - F.col("s1") * F.col("s1") / n
    stat = F.coalesce(n * explained / F.nullif(whole, F.lit(0.0)), F.lit(0.0)) if det > 0 else F.lit(0.0)
    out = data.isoforms.select("gene_id").distinct().join(s, "gene_id", "left").select("gene_id", F.coalesce(stat, F.lit(0.0)).alias("statistic"))
    return adjust(out.withColumn("pvalue", chi2_sf(F.col("statistic"), 2.0)), order=["gene_id"])
