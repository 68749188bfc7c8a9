"""Tables in the folder that all executors share, and bounded Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spotweave.session import ship
from spotweave.store import drop_table, shared_dir, write_table

#: Bytes of an Arrow batch on its way to Python, unless the session sets another bound.
BATCH_BYTES = 8 << 20
_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower Spark's default bound of Arrow batches (64 MB), of which a worker
    holds several, with what it makes of them."""
    if spark.conf.get(_KEY, None) in (None, "67108864b", str(64 << 20)):
        spark.conf.set(_KEY, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has (case apart)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        n = 0
        while (made := f"__{name}{n or ''}") in taken:
            n += 1
        taken.add(made)
        out.append(made)
    return out


__all__ = ["bound_batches", "drop_table", "fresh", "read", "shared_dir", "write_table"]
