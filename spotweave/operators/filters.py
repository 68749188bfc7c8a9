"""Filters on features and places, in the order places first, then features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave.operators.components import connected_components
from spotweave.schema import Dataset


def as_share(x: float) -> float:
    """Shares above 1 are percentages."""
    return x / 100.0 if x > 1 else float(x)


def feature_support(data: Dataset) -> DataFrame:
    """(iso_id, gene_id, count_total, spots_on) of every feature, seen or not."""
    held = data.counts.groupBy("iso_id").agg(F.sum("n").alias("count_total"), F.count_if(F.col("n") != 0).alias("spots_on"))
    return data.isoforms.join(held, "iso_id", "left").withColumn("count_total", F.coalesce("count_total", F.lit(0.0))).withColumn("spots_on", F.coalesce("spots_on", F.lit(0)))


def filter_features(data: Dataset, min_counts: float = 0, min_bin_pct: float = 0.0, single_isoform: bool = True, n_spots: int | None = None) -> Dataset:
    """Features with at least ``min_counts`` in all, on at least ``min_bin_pct``
    of the places; with ``single_isoform``, groups left with one feature go."""
    support = feature_support(data)
    keep = support.where(F.col("count_total") >= min_counts)
    if min_bin_pct > 0:
        n = n_spots if n_spots is not None else data.n_spots()
        keep = keep.where(F.col("spots_on") / F.lit(float(max(1, n))) >= as_share(min_bin_pct))
    if single_isoform:
        keep = keep.withColumn("__k", F.count(F.lit(1)).over(Window.partitionBy("gene_id"))).where("__k >= 2")
    iso = keep.select(*data.isoforms.columns)
    return data.with_(isoforms=iso, counts=data.counts.join(iso.select("iso_id"), "iso_id", "left_semi"))


def filter_groups(data: Dataset, min_counts: float = 0, min_bin_pct: float = 0.0, n_spots: int | None = None) -> Dataset:
    """Groups whose total and share of places (a plain fraction) suffice."""
    n = n_spots if n_spots is not None else data.n_spots()
    iso = data.isoforms.select("iso_id", "gene_id")
    at = data.counts.join(iso, "iso_id").groupBy("gene_id", "spot_id").agg(F.sum("n").alias("t"))
    good = at.groupBy("gene_id").agg(F.sum("t").alias("total"), F.count_if(F.col("t") > 0).alias("on")).where((F.col("total") >= min_counts) & (F.col("on") / F.lit(float(max(1, n))) >= min_bin_pct)).select("gene_id")
    kept = data.isoforms.join(good, "gene_id", "left_semi").select(*data.isoforms.columns)
    return data.with_(isoforms=kept, counts=data.counts.join(kept.select("iso_id"), "iso_id", "left_semi"))


def component_sizes(spots: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(spot_id, component, size): component is the least place of it."""
    root = connected_components(adjacency.where("i <> j and w <> 0"), "i", "j").withColumnRenamed("node", "spot_id")
    all_ = spots.select("spot_id").join(root, "spot_id", "left").select("spot_id", F.coalesce("root", "spot_id").alias("component"))
    size = all_.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return all_.join(size, "component").select("spot_id", "component", "size")


def filter_components(data: Dataset, min_size: int) -> Dataset:
    """Without places in graph components smaller than ``min_size``; counts,
    covariates and the graph follow."""
    if min_size <= 1 or data.adjacency is None:
        return data
    keep = component_sizes(data.spots, data.adjacency).where(F.col("size") >= min_size).select("spot_id")
    spots = data.spots.join(keep, "spot_id", "left_semi")
    adj = data.adjacency.join(keep.withColumnRenamed("spot_id", "i"), "i", "left_semi").join(keep.withColumnRenamed("spot_id", "j"), "j", "left_semi").select("i", "j", "w")
    design = None if data.design is None else data.design.join(keep, "spot_id", "left_semi")
    return data.with_(spots=spots, counts=data.counts.join(keep, "spot_id", "left_semi"), adjacency=adj, design=design)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df
