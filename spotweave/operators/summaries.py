"""Summary tables of groups and features. Zeros are absent rows, so means and
deviations divide by the number of places (population deviations)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.operators.ratios import covered_counts, group_totals
from spotweave.schema import Dataset


def _sd(sumsq, mean, n):
    return F.sqrt(F.greatest(sumsq / n - mean * mean, F.lit(0.0)))


def isoform_summary(data: Dataset, n_spots: int | None = None) -> DataFrame:
    """One row a feature: support, count and ratio moments. Ratio moments are
    over places where the group has counts."""
    n = F.lit(float(n_spots if n_spots is not None else data.n_spots()))
    rows = covered_counts(data).withColumn("r", F.col("n") / F.col("total"))
    per = rows.groupBy("iso_id").agg(
        F.sum("n").alias("count_total"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count_if(F.col("n") != 0).alias("on"),
        F.sum("total").alias("gene_total"), F.count(F.lit(1)).alias("valid"), F.sum("r").alias("r1"), F.sum(F.col("r") * F.col("r")).alias("r2"),
    )
    out = data.isoforms.join(per, "iso_id", "left").fillna(0.0, ["count_total", "n2", "gene_total", "r1", "r2"]).fillna(0, ["on", "valid"])
    avg, valid = F.col("count_total") / n, F.greatest(F.col("valid").cast("double"), F.lit(1.0))
    ravg = F.col("r1") / valid
    return out.select(
        *data.isoforms.columns, (F.col("on") / n).alias("pct_bin_on"), "count_total", avg.alias("count_avg"), _sd(F.col("n2"), avg, n).alias("count_std"),
        F.coalesce(F.try_divide("count_total", "gene_total"), F.lit(0.0)).alias("ratio_total"), ravg.alias("ratio_avg"), _sd(F.col("r2"), ravg, valid).alias("ratio_std"),
    )


def gene_summary(data: Dataset, n_spots: int | None = None) -> DataFrame:
    """One row a group: size, perplexity of the pooled ratios, support, count
    moments, largest pooled ratio."""
    n = F.lit(float(n_spots if n_spots is not None else data.n_spots()))
    iso = data.isoforms.join(data.counts.groupBy("iso_id").agg(F.sum("n").alias("c")), "iso_id", "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    sums = group_totals(data).groupBy("gene_id").agg(F.sum("total").alias("t1"), F.sum(F.col("total") * F.col("total")).alias("t2"), F.count(F.lit(1)).alias("valid"))
    both = iso.join(sums, "gene_id", "left").withColumn("p", F.coalesce(F.try_divide("c", "t1"), F.lit(0.0)))
    per = both.groupBy("gene_id").agg(
        F.min("gene_name").alias("gene"), F.count(F.lit(1)).alias("n_isos"), F.exp(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(0.0))).alias("perplexity"),
        F.max("p").alias("major_ratio_avg"), F.max("t1").alias("t1"), F.max("t2").alias("t2"), F.max("valid").alias("valid"),
    ).fillna(0.0, ["t1", "t2"]).fillna(0, ["valid"])
    avg = F.col("t1") / n
    return per.select("gene_id", "gene", "n_isos", "perplexity", (F.col("valid") / n).alias("pct_bin_on"), avg.alias("count_avg"), _sd(F.col("t2"), avg, n).alias("count_std"), "major_ratio_avg")


def gene_level_statistics(data: Dataset, n_spots: int | None = None) -> DataFrame:
    """The older column names."""
    return gene_summary(data, n_spots).withColumnsRenamed({"n_isos": "n_iso", "pct_bin_on": "pct_spot_on"})
