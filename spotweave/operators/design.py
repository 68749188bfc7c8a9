"""Covariates in long form: (spot_id, factor, z), numbers as they are, texts as
one indicator a level (no level dropped)."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def design_table(spots: DataFrame, columns: list[str], names: list[str] | None = None) -> DataFrame:
    """Indicators are named ``column_level``; their zeros are left out. Missing
    numbers are NaN: tests leave such places out (see :func:`missing`)."""
    if names is not None and len(names) != len(columns):
        raise ValueError(f"{len(names)} names for {len(columns)} columns")
    parts = []
    for i, c in enumerate(columns):
        kind, name = spots.schema[c].dataType, (names[i] if names else c)
        if isinstance(kind, T.NumericType | T.BooleanType):
            parts.append(F.struct(F.lit(name).alias("factor"), F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias("z")))
        else:
            parts.append(F.struct(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}_"), F.col(c).cast("string"))).alias("factor"), F.lit(1.0).alias("z")))
    long = spots.select("spot_id", F.explode(F.array(*parts)).alias("f")).select("spot_id", "f.factor", "f.z")
    return long.where(F.col("factor").isNotNull() & F.col("z").isNotNull())


def missing(design: DataFrame) -> dict[str, int]:
    """Covariates (a short list) with missing numbers, and at how many places."""
    return {r["factor"]: r["k"] for r in design.where(F.isnan("z")).groupBy("factor").agg(F.count_distinct("spot_id").alias("k")).collect()}


def factor_moments(design: DataFrame, n_spots: int) -> DataFrame:
    """(factor, mean, ss, sd, lo, hi, levels) over all places, absent ones zero
    and NaN ones left out: ``ss`` is the centred sum of squares."""
    n = F.lit(float(n_spots)) - F.col("gone")
    z = F.when(~F.isnan("z"), F.col("z"))
    s = design.groupBy("factor").agg(F.sum(z).alias("s1"), F.sum(z * z).alias("s2"), F.count(z).alias("k"), F.min(z).alias("lo0"), F.max(z).alias("hi0"), F.count_distinct(z).alias("d0"), F.count_if(F.col("z") == 0).alias("z0"), F.count_if(F.isnan("z")).alias("gone"))
    gap = F.col("k") < n
    s = s.withColumn("mean", F.col("s1") / n).withColumn("ss", F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / n, F.lit(0.0)))
    s = s.withColumn("sd", F.sqrt(F.col("ss") / F.greatest(n - 1, F.lit(1.0))))
    return s.select("factor", "mean", "ss", "sd", F.when(gap, F.least("lo0", F.lit(0.0))).otherwise(F.col("lo0")).alias("lo"), F.when(gap, F.greatest("hi0", F.lit(0.0))).otherwise(F.col("hi0")).alias("hi"), (F.col("d0") + F.when(gap & (F.col("z0") == 0), 1).otherwise(0)).alias("levels"))


def check_variance(design: DataFrame, n_spots: int, least: float = 1e-5, strict: bool = True) -> None:
    """Covariates (a short list) with no spread are an error, or a warning."""
    flat = [r["factor"] for r in factor_moments(design, n_spots).where(F.col("sd") <= least).select("factor").collect()]
    if flat and strict:
        raise ValueError(f"covariates without variance: {', '.join(flat)}")
    if flat:
        warnings.warn(f"covariates with almost no variance: {', '.join(flat)}", stacklevel=2)


def check_binary(design: DataFrame, n_spots: int) -> None:
    many = [r["factor"] for r in factor_moments(design, n_spots).where("levels <> 2").select("factor").collect()]
    if many:
        raise ValueError(f"a t-test needs two groups; not so: {', '.join(many)}")


def zscore(spots: DataFrame, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Columns as (value - mean) / max(sample standard deviation, 1e-8)."""
    m = spots.agg(*[f(c).alias(f"__{f.__name__}_{c}") for c in columns for f in (F.avg, F.stddev_samp)])
    out = spots.crossJoin(F.broadcast(m))  # one row
    for c in columns:
        out = out.withColumn(c, (F.col(c) - F.col(f"__avg_{c}")) / F.greatest(F.coalesce(F.col(f"__stddev_samp_{c}"), F.lit(0.0)), F.lit(1e-8)))
    return out.select(*spots.columns)
