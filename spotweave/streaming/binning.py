"""Transcripts that arrive in files: running bin counts by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from spotweave.sources.xenium import Grid, bin_transcripts


def transcript_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def streaming_bins(stream: DataFrame, codewords: DataFrame, grid: Grid, quality: float = 20.0) -> DataFrame:
    """Running (row, col, codeword_index, n); state is one row a bin and codeword."""
    return bin_transcripts(stream, codewords, grid, quality)


def start(bins: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """A query that handles what there is and keeps the counts in a table ``name``."""
    return bins.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
