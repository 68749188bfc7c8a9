"""A corpus from raw documents: five stages, each an operator of ``spotweave.llm``.

Each stage takes what the one before kept, as a Parquet table, and its decisions
take effect: documents that the classifier rejects go; boilerplate lines go; one
document of each group of near copies stays; documents that hold benchmark
passages go; the rest is mixed to the sources' target weights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.llm.decontaminate import decontaminate
from spotweave.llm.jaccard_join import keep_one
from spotweave.llm.line_dedup import line_dedup
from spotweave.llm.mixing import mix_sources
from spotweave.llm.quality import fit_quality, score_quality
from spotweave.llm.store import read, write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A document stays if its quality is at least this probable.
LEAST_QUALITY = 0.5
#: A line goes if more than this share of its source's documents, and at least LEAST_DOCUMENTS, have it.
MOST_OFTEN, LEAST_DOCUMENTS = 0.1, 5
#: Documents are near copies if of the distinct SHINGLE-word shingles of both at least this percentage is shared.
SHINGLE, SIMILAR = 5, 80
#: A benchmark passage is so many consecutive words.
PASSAGE = 10


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    return score_quality(docs, model, keep=COLUMNS, name="__quality").where(F.col("__quality") >= LEAST_QUALITY).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup(docs.select(*COLUMNS), ratio=MOST_OFTEN, min_pages=LEAST_DOCUMENTS, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs.select(*COLUMNS), shingle=SHINGLE, num=SIMILAR, den=100)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(docs, read(spark, sf_dir, "benchmark"), span=PASSAGE, keep=COLUMNS)
    return found.where(F.size("hits") == 0).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents taken, with ``taken`` words of ``size`` each (repeats counted)."""
    return mix_sources(docs, keep=COLUMNS).where(F.col("taken") > 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("mixture", mixture),
]

#: SQL can't express the fitted classifier; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = write_table(docs, f"pipeline-{name}")
    return docs
