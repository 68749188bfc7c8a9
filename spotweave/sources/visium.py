"""Probe counts on spots and on square bins.

Matrices come as long tables (barcode, feature, n), from ``read_mtx`` or Parquet.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names of a positions file without header.
POSITIONS = ["barcode", "in_tissue", "array_row", "array_col", "pxl_row_in_fullres", "pxl_col_in_fullres"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_positions(spark: SparkSession, folder: str) -> DataFrame:
    """The positions of all spots, from the newer or the older file."""
    new, old = f"{folder}/tissue_positions.csv", f"{folder}/tissue_positions_list.csv"
    if _exists(spark, new):
        df = spark.read.option("header", True).csv(new)
    elif _exists(spark, old):
        df = spark.read.csv(old).toDF(*POSITIONS)
    else:
        raise FileNotFoundError(f"no positions file in {folder}")
    return df.select("barcode", *(F.col(c).cast("int") for c in POSITIONS[1:]))


def scale_factors(spark: SparkSession, folder: str) -> dict[str, float]:
    return json.loads(spark.read.text(f"{folder}/scalefactors_json.json", wholetext=True).first()[0])


def with_positions(spots: DataFrame, positions: DataFrame) -> DataFrame:
    """Spots with positions and coordinates (x: pixel column, y: pixel row)."""
    own = [c for c in positions.columns if c == "barcode" or c not in spots.columns]
    out = spots.join(positions.select(*own), "barcode", "left")
    return out.withColumn("x", F.col("pxl_col_in_fullres").cast("double")).withColumn("y", F.col("pxl_row_in_fullres").cast("double"))


def load_probes(raw: DataFrame, filtered_barcodes: DataFrame, positions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts, spots): probe counts of barcodes that the filtered matrix has."""
    spots = filtered_barcodes.select("barcode").distinct()
    counts = raw.join(spots, "barcode", "left_semi")
    return counts, spots if positions is None else with_positions(spots, positions)


def in_tissue(counts: DataFrame, positions: DataFrame) -> DataFrame:
    return counts.join(positions.where("in_tissue = 1").select("barcode"), "barcode", "left_semi")


def bin_name(size: int | str) -> str:
    """``square_008um`` for 8, 8.0, "8", "8um" or the name itself; sizes are whole."""
    found = re.fullmatch(r"(?:square_)?0*(\d+)(?:\.0+)?(?:um)?", str(size).strip())
    if not found:
        raise ValueError(f"no whole bin size in {size!r}")
    return f"square_{int(found[1]):03d}um"


def aggregate_bins(counts: DataFrame, mapping: DataFrame, target: str, source: str = "square_002um", template: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts, bins): counts of small bins added up to larger ones or to cells.

    ``mapping``: one row a small bin with its larger ones. With ``template``
    (barcode), its bins are the result's, with or without counts.
    """
    pairs = mapping.select(F.col(source).alias("__s"), F.col(target).alias("__t")).dropna().distinct()
    out = counts.join(pairs, F.col("barcode") == F.col("__s")).groupBy(F.col("__t").alias("barcode"), "feature").agg(F.sum("n").alias("n"))
    bins = pairs.select(F.col("__t").alias("barcode")).distinct()
    if template is not None:
        bins = template.select("barcode").distinct()
        out = out.join(bins, "barcode", "left_semi")
    return out, bins


def load_bins(counts: DataFrame, mapping: DataFrame, sizes: list[int | str], cells: bool = False, templates: dict[str, DataFrame] | None = None) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Aggregates at several bin sizes, and cells, by name. A size with a template
    (barcode) has its bins, with or without counts, and no others."""
    names = [bin_name(s) for s in sizes] + (["cell_id"] if cells else [])
    templates = templates or {}
    out = {}
    for n in names:
        if n != "square_002um":
            out[n] = aggregate_bins(counts, mapping, n, template=templates.get(n))
        elif n in templates:
            bins = templates[n].select("barcode").distinct()
            out[n] = counts.join(bins, "barcode", "left_semi"), bins
        else:
            out[n] = counts, mapping.select(F.col("square_002um").alias("barcode")).dropna().distinct()
    return out
