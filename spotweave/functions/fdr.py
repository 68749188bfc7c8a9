"""False discovery control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.schema import one_of


#: Terms of a harmonic sum held as one array.
TERMS = 1 << 16


def _harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m, added in this order, by arrays of TERMS numbers."""
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((m - 1) / F.lit(TERMS)))
    block = lambda b: F.sequence(b * TERMS + 1, F.least(m, (b + 1) * TERMS))
    return F.aggregate(blocks, F.lit(0.0), lambda s, b: F.aggregate(block(b), s, lambda a, i: a + F.lit(1.0) / i))


def adjust(df: DataFrame, p: str = "pvalue", out: str = "pvalue_adj", by: list[str] | None = None, method: str = "bh", order: list[str] | None = None) -> DataFrame:
    """Adjusted p-values within each group of ``by``.

    Benjamini-Hochberg, or Benjamini-Yekutieli for any dependence. Missing
    p-values stay missing but count as tests. A single test isn't changed.
    Ranks run over one row a test and group: a result table, not data.
    """
    one_of(method, ("bh", "by"), "method")
    group = Window.partitionBy(*(by or []))
    value = F.when(F.isnan(p), F.lit(None)).otherwise(F.col(p))
    out_of = F.raise_error(F.lit("p-values must lie between 0 and 1"))
    value = F.when((F.col(p) < 0) | ((F.col(p) > 1) & ~F.isnan(p)), out_of.cast("double")).otherwise(value)
    ranked = df.withColumn("__p", value).withColumn("__m", F.count(F.lit(1)).over(group))
    ranked = ranked.withColumn("__i", F.row_number().over(group.orderBy(F.asc_nulls_last("__p"), *(order or []))))
    scale = F.lit(1.0)
    if method == "by":  # summed at one row of a group
        ranked = ranked.withColumn("__h", F.max(F.when(F.col("__i") == 1, _harmonic(F.col("__m")))).over(group))
        scale = F.col("__h")
    q = F.col("__p") * F.col("__m") / F.col("__i") * scale
    ranked = ranked.withColumn("__q", q)
    least = F.min("__q").over(group.orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    adj = F.when(F.col("__p").isNull(), F.col(p)).when(F.col("__m") <= 1, F.col("__p")).otherwise(F.least(least, F.lit(1.0)))
    return ranked.withColumn(out, adj).drop("__p", "__m", "__i", "__h", "__q")
