"""The driver's tables read as places, features and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotweave.operators.design import design_table
from spotweave.schema import Dataset
from spotweave.session import ship

WIDTH = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _isoforms(pairs: DataFrame) -> DataFrame:
    return pairs.distinct().withColumn("gene_name", F.col("gene_id")).withColumn("ord", F.row_number().over(Window.partitionBy("gene_id").orderBy("iso_id")))


def suppliers(spark: SparkSession, sf_dir: str) -> Dataset:
    """Suppliers on a lattice ten wide; brands are groups, brand and type are
    features; counts are lines supplied. Covariates: account balance, whether it
    is over 5000, region."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("gene_id"), F.concat_ws("/", "p_brand", "p_type").alias("iso_id"))
    where = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    s = table(spark, sf_dir, "supplier").join(where, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    k = F.col("s_suppkey")
    spots = s.select(k.alias("spot_id"), F.floor(k / WIDTH).cast("int").alias("row"), (k % WIDTH).cast("int").alias("col"), (k % WIDTH).cast("double").alias("x"), F.floor(k / WIDTH).cast("double").alias("y"), "s_acctbal", (F.col("s_acctbal") > 5000).cast("int").alias("high"), "region")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("spot_id"), "l_partkey")
    counts = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("spot_id", "iso_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return Dataset(spots, _isoforms(part.select("iso_id", "gene_id")), counts, design=design_table(spots, ["s_acctbal", "high", "region"]))


def raster_shape(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    return (-(-table(spark, sf_dir, "supplier").count() // WIDTH), WIDTH)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spot_id, coords) of the embedding vectors."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spot_id"), F.col("embedding").cast("array<double>").alias("coords"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: user across, minutes since the first event down."""
    e = table(spark, sf_dir, "events")
    start = e.agg(F.min("ts").alias("t0"))
    minutes = F.timestamp_diff("SECOND", F.col("t0"), F.col("ts")) / 60.0
    kinds = F.array(*(F.lit(k) for k in EVENT_TYPES))
    return e.crossJoin(F.broadcast(start)).select(F.col("user_id").cast("double").alias("x"), minutes.alias("y"), F.col("value").alias("qv"), (F.array_position(kinds, F.col("event_type")) - 1).cast("int").alias("codeword_index"), F.concat(F.lit("cell_"), F.col("user_id").cast("string")).alias("cell_id"), "event_id")


#: The event types, in order of their codewords.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def codewords(spark: SparkSession) -> DataFrame:
    """All codewords but the last, which counts as unassigned."""
    names = [(i, t if i < len(EVENT_TYPES) - 1 else f"UnassignedCodeword_{i}") for i, t in enumerate(EVENT_TYPES)]
    return spark.createDataFrame(names, "codeword_index int, name string")
