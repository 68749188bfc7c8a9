"""Transcript tables: points with quality and codeword, binned to squares or
counted by cell."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.sources.visium import _exists


@dataclass(frozen=True)
class Grid:
    """Square bins of side ``size`` from (x0, y0)."""

    x0: float
    y0: float
    size: float
    n_rows: int
    n_cols: int

    @classmethod
    def over(cls, x0: float, x1: float, y0: float, y1: float, size: float) -> Grid:
        return cls(x0, y0, size, max(1, math.ceil((y1 - y0) / size)), max(1, math.ceil((x1 - x0) / size)))

    @classmethod
    def around(cls, points: DataFrame, size: float) -> Grid:
        """The grid from the least coordinates that holds all points (one aggregate)."""
        x0, x1, y0, y1 = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if x0 is None:
            return cls(0.0, 0.0, size, 1, 1)
        return cls(x0, y0, size, math.floor((y1 - y0) / size) + 1, math.floor((x1 - x0) / size) + 1)


def outs_folder(spark: SparkSession, path: str) -> str:
    """The folder with the tables: ``path`` or its ``outs``."""
    for p in (f"{path}/outs", path):
        if _exists(spark, f"{p}/transcripts.parquet"):
            return p
    raise FileNotFoundError(f"no transcripts.parquet under {path}")


def resolution_name(size: float) -> str:
    """``square_008um``, or ``square_2p5um`` for fractions."""
    return f"square_{int(size):03d}um" if float(size).is_integer() else "square_" + f"{size:g}".replace(".", "p") + "um"


def assigned(codewords: DataFrame) -> DataFrame:
    """Codewords (codeword_index, name, ...) without the unassigned ones."""
    return codewords.where(~F.col("name").startswith("UnassignedCodeword"))


def good_transcripts(t: DataFrame, codewords: DataFrame, quality: float) -> DataFrame:
    """Transcripts of at least that quality with a wanted codeword; the quality
    filter and the columns reach the file scan."""
    return t.where(F.col("qv") >= quality).join(codewords.select("codeword_index").distinct(), "codeword_index", "left_semi")


def bin_transcripts(t: DataFrame, codewords: DataFrame, grid: Grid, quality: float = 20.0) -> DataFrame:
    """(row, col, codeword_index, n): bins are half open, points outside the grid
    are left out."""
    kept = good_transcripts(t, codewords, quality)
    at = kept.select(F.floor((F.col("y") - F.lit(grid.y0)) / grid.size).cast("int").alias("row"), F.floor((F.col("x") - F.lit(grid.x0)) / grid.size).cast("int").alias("col"), "codeword_index")
    at = at.where((F.col("row") >= 0) & (F.col("row") < grid.n_rows) & (F.col("col") >= 0) & (F.col("col") < grid.n_cols))
    return at.groupBy("row", "col", "codeword_index").agg(F.count(F.lit(1)).cast("double").alias("n"))


def bin_table(spark: SparkSession, grid: Grid, name: str) -> DataFrame:
    """All bins of a grid with ids, centres and corners, with or without counts."""
    i = F.col("id")
    out = spark.range(grid.n_rows * grid.n_cols).select((i / grid.n_cols).cast("int").alias("row"), (i % grid.n_cols).cast("int").alias("col"))
    x, y = F.lit(grid.x0) + F.col("col") * grid.size, F.lit(grid.y0) + F.col("row") * grid.size
    return out.select(
        F.format_string(f"s_{name.removeprefix('square_')}_%05d_%05d-1", "row", "col").alias("barcode"), "row", "col", (x + grid.size / 2).alias("x"), (y + grid.size / 2).alias("y"),
        F.array(F.array(x, y), F.array(x + grid.size, y), F.array(x + grid.size, y + grid.size), F.array(x, y + grid.size)).alias("corners"),
    )


def bin_all(t: DataFrame, codewords: DataFrame, bounds: tuple[float, float, float, float], sizes: list[float], quality: float = 20.0) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(counts, bins) at each bin size, by name. ``bounds``: x0, x1, y0, y1."""
    spark, wanted = t.sparkSession, assigned(codewords)
    grids = {resolution_name(s): Grid.over(*bounds, s) for s in sizes}
    return {n: (bin_transcripts(t, wanted, g, quality), bin_table(spark, g, n)) for n, g in grids.items()}


def cell_codewords(t: DataFrame, codewords: DataFrame, cells: DataFrame, quality: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """(counts, cells): (cell_id, codeword_index, n) of known cells."""
    decoded = t.withColumn("cell_id", F.decode("cell_id", "utf-8")) if dict(t.dtypes)["cell_id"] == "binary" else t
    kept = good_transcripts(decoded, assigned(codewords), quality).join(cells.select("cell_id"), "cell_id", "left_semi")
    return kept.groupBy("cell_id", "codeword_index").agg(F.count(F.lit(1)).cast("double").alias("n")), cells


def with_cell_meta(cells: DataFrame, meta: DataFrame, suffix: str = "_meta") -> DataFrame:
    """Cells with further columns; names that clash get the suffix."""
    clash = {c: c + suffix for c in meta.columns if c in cells.columns and c != "cell_id"}
    return cells.join(meta.withColumnsRenamed(clash), "cell_id", "left")
