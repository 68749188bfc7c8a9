"""Count matrices in Matrix Market form, and gene tables of GFF/GTF files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def normalise_barcode(c):
    """Barcodes without path-like prefixes, with a ``-1`` suffix."""
    bare = F.regexp_replace(F.trim(c), r"^.*[/:]", "")
    return F.when(bare.rlike(r"-\d+$"), bare).otherwise(F.concat(bare, F.lit("-1")))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a names file with their 1-based numbers; names files are short
    (one line a row or column of the matrix)."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n+$", ""), "\n")).alias("at", "line"))
    return lines.select((F.col("at") + 1).cast("long").alias("at"), F.split("line", "\t").alias("f"))


def read_mtx(spark: SparkSession, matrix: str, features: str, barcodes: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, features, barcodes) of a coordinate-format matrix.

    Counts are (barcode, feature, n). Entries are read in parallel; the size line
    is the one entry whose numbers equal the sizes of the names files.
    """
    rows = _numbered(spark, features).select("at", F.col("f")[0].alias("feature"), F.coalesce(F.try_element_at("f", F.lit(2)), F.col("f")[0]).alias("name"))
    cols = _numbered(spark, barcodes).select("at", normalise_barcode(F.col("f")[0]).alias("barcode"))
    text = spark.read.text(matrix).where(~F.col("value").startswith("%"))
    part = F.split(F.trim("value"), r"\s+")
    entries = text.select(part[0].cast("long").alias("r"), part[1].cast("long").alias("c"), F.try_element_at(part, F.lit(3)).cast("double").alias("n"))
    n_rows, n_cols, n_entries = rows.count(), cols.count(), entries.count() - 1
    entries = entries.where(~((F.col("r") == n_rows) & (F.col("c") == n_cols) & (F.col("n") == n_entries))) if n_entries >= 0 else entries
    counts = entries.where("n <> 0").join(rows.select(F.col("at").alias("r"), "feature"), "r").join(cols.select(F.col("at").alias("c"), "barcode"), "c")
    return counts.select("barcode", "feature", "n"), rows.drop("at"), cols.drop("at")


def gff_genes(spark: SparkSession, path: str, feature: str = "transcript") -> DataFrame:
    """(transcript_id, gene_id, gene_name) of a GFF3 or GTF file."""
    rows = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").csv(path).toDF(*[f"c{i}" for i in range(9)])
    tag = lambda *names: F.coalesce(*(F.nullif(F.regexp_extract("c8", rf"(?:^|;\s*){n}[= ]\"?([^\";]+)\"?", 1), F.lit("")) for n in names))
    return rows.where(F.col("c2") == feature).select(tag("transcript_id", "ID").alias("transcript_id"), tag("gene_id", "Parent").alias("gene_id"), F.coalesce(tag("gene_name", "gene"), tag("gene_id", "Parent")).alias("gene_name")).distinct()


def transcript_counts(counts: DataFrame, genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, isoforms) in canonical form from transcript-level counts."""
    known = genes.select(F.col("transcript_id").alias("iso_id"), "gene_id", "gene_name")
    iso = known.join(counts.select(F.col("feature").alias("iso_id")).distinct(), "iso_id", "left_semi")
    iso = iso.withColumn("ord", F.row_number().over(Window.partitionBy("gene_id").orderBy("iso_id")))
    return counts.withColumnRenamed("feature", "iso_id").join(iso.select("iso_id"), "iso_id", "left_semi"), iso


def umi_counts(spark: SparkSession, path: str) -> DataFrame:
    """(barcode, feature, n) from a tab-separated table gene, cell, count."""
    return spark.read.option("sep", "\t").option("header", True).csv(path).toDF("feature", "barcode", "n").select(normalise_barcode(F.col("barcode")).alias("barcode"), "feature", F.col("n").cast("double").alias("n"))
