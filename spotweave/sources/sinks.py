"""Results and models as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def formatted(results: DataFrame, isoforms: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Results with display names first; with ``summary`` its columns follow.
    Joined by id, so names that repeat don't multiply rows."""
    names = isoforms.select("gene_id", "gene_name").distinct().groupBy("gene_id").agg({"gene_name": "min"}).withColumnRenamed("min(gene_name)", "gene")
    out = results.join(names, "gene_id", "left")
    own = [c for c in results.columns if c != "gene_id"]
    if summary is not None:
        more = [c for c in summary.columns if c not in ("gene", *own)]
        out = out.join(summary.select(*more), "gene_id", "left")
        own += [c for c in more if c != "gene_id"]
    return out.select("gene", *own)


def save(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
