"""Compositions: each feature's share of its group at each place.

Long form throughout. Only places where the group has counts are rows; a place
without counts has no ratio, which after centring is the same as a ratio equal
to the mean, so filling is needed only where the caller asks for full tables.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave.schema import Dataset, one_of

TRANSFORMS = ("none", "clr", "alr", "ilr", "radial")
#: Share of the column mean mixed into counts before taking logarithms.
PSEUDO = 0.01


def group_totals(data: Dataset) -> DataFrame:
    """(gene_id, spot_id, total) where the total isn't zero."""
    iso = data.isoforms.select("iso_id", "gene_id")
    return data.counts.join(iso, "iso_id").groupBy("gene_id", "spot_id").agg(F.sum("n").alias("total")).where("total <> 0")


def covered_counts(data: Dataset) -> DataFrame:
    """(gene_id, spot_id, iso_id, ord, n, total) for all features of a group at
    every place where the group has counts, zeros included.

    One shuffle by (gene, spot): counts become a map, and the group's list of
    features (a small table) is laid over it.
    """
    iso = data.isoforms.select("iso_id", "gene_id", "ord")
    held = data.counts.where("n <> 0").join(iso.select("iso_id", "gene_id"), "iso_id").repartition("gene_id", "spot_id").groupBy("gene_id", "spot_id", "iso_id").agg(F.sum("n").alias("n"))
    at = held.groupBy("gene_id", "spot_id").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("iso_id", "n"))).alias("m")).where("total <> 0")
    members = iso.groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("ord", "iso_id"))).alias("isos"))
    wide = at.join(members, "gene_id").select("gene_id", "spot_id", "total", "m", F.explode("isos").alias("i"))
    return wide.select("gene_id", "spot_id", F.col("i.iso_id").alias("iso_id"), F.col("i.ord").alias("ord"), F.coalesce(F.col("m")[F.col("i.iso_id")], F.lit(0.0)).alias("n"), "total")


def ratios(data: Dataset, transform: str = "none", n_spots: int | None = None, alr_reference: str = "first") -> DataFrame:
    """(gene_id, spot_id, iso_id, ord, r) at places with counts.

    clr, alr and ilr take logarithms of shares after mixing in PSEUDO of each
    feature's mean over all places. alr drops the reference feature (the group's
    first, or last); ilr uses the Helmert basis and drops the first. radial
    divides by the Euclidean norm.
    """
    one_of(transform, TRANSFORMS, "transformation")
    one_of(alr_reference, ("first", "last"), "alr reference")
    base = covered_counts(data)
    here = Window.partitionBy("gene_id", "spot_id")
    if transform in ("none", "radial"):
        r = base.withColumn("r", F.col("n") / F.col("total"))
        if transform == "radial":
            r = r.withColumn("r", F.col("r") / F.sqrt(F.sum(F.col("r") * F.col("r")).over(here)))
        return r.select("gene_id", "spot_id", "iso_id", "ord", "r")
    places = n_spots if n_spots is not None else data.n_spots()
    mean = data.counts.groupBy("iso_id").agg((F.sum("n") / F.lit(float(places))).alias("mean"))
    mixed = base.join(mean, "iso_id", "left").withColumn("v", (1 - PSEUDO) * F.col("n") + PSEUDO * F.coalesce("mean", F.lit(0.0)))
    mixed = mixed.where("v > 0").withColumn("l", F.ln(F.col("v") / F.sum("v").over(here)))
    ranked = here.orderBy("ord", "iso_id")
    if transform == "clr":
        out = mixed.withColumn("r", F.col("l") - F.avg("l").over(here))
    elif transform == "alr":
        edge = ranked if alr_reference == "first" else here.orderBy(F.desc("ord"), F.desc("iso_id"))
        out = mixed.withColumn("at", F.row_number().over(edge)).withColumn("ref", F.first("l").over(edge.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        out = out.withColumn("r", F.col("l") - F.col("ref")).where("at > 1")
    else:
        before = ranked.rowsBetween(Window.unboundedPreceding, -1)
        out = mixed.withColumn("at", F.row_number().over(ranked)).withColumn("m", F.avg("l").over(before)).where("at > 1")
        out = out.withColumn("r", F.sqrt((F.col("at") - 1) / F.col("at")) * (F.col("m") - F.col("l")))
    return out.select("gene_id", "spot_id", "iso_id", "ord", "r")


def fill_with_means(r: DataFrame, data: Dataset) -> DataFrame:
    """Ratios at all places: those without counts get the feature's mean."""
    mean = r.groupBy("gene_id", "iso_id", "ord").agg(F.avg("r").alias("mean"))
    full = data.spots.select("spot_id").crossJoin(mean)
    return full.join(r.select("spot_id", "iso_id", "r"), ["spot_id", "iso_id"], "left").select("gene_id", "spot_id", "iso_id", "ord", F.coalesce("r", "mean").alias("r"))


def ratios_filled_before(data: Dataset, transform: str = "clr", n_spots: int | None = None) -> DataFrame:
    """The older order for clr: places without counts get the mean raw ratio
    first and are transformed with the others."""
    one_of(transform, ("none", "clr", "radial"), "transformation")
    raw = fill_with_means(ratios(data, "none"), data)
    if transform == "none":
        return raw
    here = Window.partitionBy("gene_id", "spot_id")
    if transform == "radial":
        return raw.withColumn("r", F.col("r") / F.sqrt(F.sum(F.col("r") * F.col("r")).over(here)))
    done = ratios(data, "clr", n_spots)
    covered = done.select("gene_id", "spot_id").distinct()
    rest = raw.join(covered, ["gene_id", "spot_id"], "left_anti").where("r > 0")
    rest = rest.withColumn("r", F.ln("r") - F.avg(F.ln("r")).over(here))
    return done.unionByName(rest)


def ratio_layer(data: Dataset, fill_mean: bool = False) -> DataFrame:
    """(spot_id, iso_id, ratio): a layer as sparse as the counts, or with
    ``fill_mean`` a full one where places without counts get the feature's mean
    (0 for features never seen)."""
    if fill_mean:
        full = fill_with_means(ratios(data, "none"), data)
        every = data.spots.select("spot_id").crossJoin(data.isoforms.select("iso_id"))
        return every.join(full.select("spot_id", "iso_id", "r"), ["spot_id", "iso_id"], "left").select("spot_id", "iso_id", F.coalesce("r", F.lit(0.0)).alias("ratio"))
    iso = data.isoforms.select("iso_id", "gene_id")
    held = data.counts.where("n <> 0").join(iso, "iso_id")
    total = F.sum("n").over(Window.partitionBy("spot_id", "gene_id"))
    return held.withColumn("ratio", F.col("n") / total).select("spot_id", "iso_id", "ratio")


def counts_and_ratios(data: Dataset, filter_single_iso_genes: bool = True) -> DataFrame:
    """(gene_id, iso_id, spot_id, n, ratio) by group, feature and place, in order.
    Deprecated: use the counts of the dataset and :func:`ratio_layer`."""
    warnings.warn("counts_and_ratios is deprecated; use ratio_layer", DeprecationWarning, stacklevel=2)
    iso = data.isoforms.select("iso_id", "gene_id")
    if filter_single_iso_genes:
        iso = iso.join(iso.groupBy("gene_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("gene_id"), "gene_id", "left_semi")
    held = data.counts.where("n <> 0").join(ratio_layer(data), ["spot_id", "iso_id"]).join(iso, "iso_id")
    return held.select("gene_id", "iso_id", "spot_id", "n", "ratio").orderBy("gene_id", "iso_id", "spot_id")


def responses(data: Dataset, kind: str, transform: str = "none", n_spots: int | None = None) -> DataFrame:
    """Centred responses (gene_id, ch, spot_id, y, n_isos) for a test kind:
    ``gc`` group totals, ``ic`` feature counts, ``ir`` feature ratios.

    For gc and ic the mean is over all places, so places without counts hold
    minus the mean; those rows are made here. For ir places without ratio are
    exactly zero and are left out.
    """
    one_of(kind, ("gc", "ic", "ir"), "kind")
    n = n_spots if n_spots is not None else data.n_spots()
    if kind == "ir":
        r = ratios(data, transform, n)
        return r.withColumn("y", F.col("r") - F.avg("r").over(Window.partitionBy("gene_id", "iso_id"))).select("gene_id", F.col("iso_id").alias("ch"), "spot_id", "y")
    if kind == "gc":
        held = group_totals(data).select("gene_id", F.col("gene_id").alias("ch"), "spot_id", F.col("total").alias("n"))
    else:
        held = data.counts.where("n <> 0").join(data.isoforms.select("iso_id", "gene_id"), "iso_id").select("gene_id", F.col("iso_id").alias("ch"), "spot_id", "n")
    mean = held.groupBy("gene_id", "ch").agg((F.sum("n") / F.lit(float(n))).alias("mean"))
    full = data.spots.select("spot_id").crossJoin(mean).join(held.select("ch", "spot_id", "n"), ["ch", "spot_id"], "left")
    return full.select("gene_id", "ch", "spot_id", (F.coalesce("n", F.lit(0.0)) - F.col("mean")).alias("y"))


