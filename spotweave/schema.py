"""Canonical tables and their checks."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPOTS = T.StructType([T.StructField("spot_id", T.LongType(), False), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
ISOFORMS = T.StructType([T.StructField("iso_id", T.StringType(), False), T.StructField("gene_id", T.StringType(), False), T.StructField("gene_name", T.StringType()), T.StructField("ord", T.IntegerType())])
COUNTS = T.StructType([T.StructField("spot_id", T.LongType(), False), T.StructField("iso_id", T.StringType(), False), T.StructField("n", T.DoubleType(), False)])
DESIGN = T.StructType([T.StructField("spot_id", T.LongType(), False), T.StructField("factor", T.StringType(), False), T.StructField("z", T.DoubleType())])
ADJACENCY = T.StructType([T.StructField("i", T.LongType(), False), T.StructField("j", T.LongType(), False), T.StructField("w", T.DoubleType(), False)])


def require(df: DataFrame, *names: str, what: str = "table") -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df


def one_of(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return value


@dataclass(frozen=True)
class Dataset:
    """Places, features with their groups, non-zero counts, and optionally a
    graph and covariates. Counts that aren't there are zero; a group with no
    count at a place has no ratio there."""

    spots: DataFrame
    isoforms: DataFrame
    counts: DataFrame
    adjacency: DataFrame | None = None
    design: DataFrame | None = None

    def checked(self) -> Dataset:
        require(self.spots, "spot_id", what="spots")
        require(self.isoforms, "iso_id", "gene_id", "gene_name", "ord", what="isoforms")
        require(self.counts, "spot_id", "iso_id", "n", what="counts")
        if self.adjacency is not None:
            require(self.adjacency, "i", "j", "w", what="adjacency")
        if self.design is not None:
            require(self.design, "spot_id", "factor", "z", what="design")
        return self

    def with_(self, **changes: DataFrame | None) -> Dataset:
        return replace(self, **changes)

    def n_spots(self) -> int:
        return self.spots.count()
