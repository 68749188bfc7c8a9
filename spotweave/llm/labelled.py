"""Bounded samples of labelled documents for fitting on the driver."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.llm.store import drop_table, write_table

#: Bytes of text of each class that a fit takes at most.
SAMPLE_BYTES = 16 << 20


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the held-out remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y) of the rows one may learn from; repeated ids by majority (ties: 1)."""
    fit = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    return fit.groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y"))


def chosen_within(sizes: list[tuple], most: int) -> list:
    """Of (group, name, size) in order: the names whose sizes add up to ``most``
    a group at most; what doesn't fit is passed over."""
    used: dict = {}
    out = []
    for group, name, size in sizes:
        if used.get(group, 0) + size <= most:
            used[group] = used.get(group, 0) + size
            out.append(name)
    return out


def free_memory() -> None:
    """Hand back to the system what a fit on the driver no longer needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def bounded_sample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    per_class: int,
    most_bytes: int,
    features: Callable[[pa.Array], Iterator[tuple[int, np.ndarray]]],
    kind: pa.DataType,
) -> tuple[list[np.ndarray], np.ndarray, dict[int, int]]:
    """Features and labels of a sample by id, and how many ids each class has in all.

    The sample has at most ``per_class`` labelled ids of each class, those of the
    least hashes; of each the text of the least hash, whole; and of these texts
    as many as ``most_bytes`` a class hold (one that doesn't fit is passed over).
    Nothing else reaches the driver, however often an id is repeated.
    """
    spark = docs.sparkSession
    known = training_labels(labels, id_col, label_col)
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(count) < 2:
        return [], np.zeros(0, dtype=np.int64), count
    rows = [(r["id"], y, n) for y in (0, 1) for n, r in enumerate(known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class).collect())]
    few = spark.createDataFrame(rows, f"i {docs.schema[id_col].dataType.simpleString()}, y int, place int")  # 2 * per_class rows at most
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), text.alias("t")).join(F.broadcast(few), F.col("id") == F.col("i"))
    own = own.groupBy("id", "y", "place").agg(F.min(F.struct(F.xxhash64("t").alias("x"), "t"))["t"].alias("t"))
    own = write_table(own.coalesce(32), "labelled-sample")
    sizes = sorted(tuple(r) for r in own.select("y", "place", F.octet_length("t")).collect())
    taken = chosen_within([(y, (y, place), size) for y, place, size in sizes], most_bytes)
    if not taken:
        drop_table(own)
        return [], np.zeros(0, dtype=np.int64), count
    pick = spark.createDataFrame(taken, "py int, pp int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for _, x in features(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(kind))], names=["place", "y", "f"])

    sql = {pa.int32(): "int", pa.int64(): "long"}[kind]
    few = own.join(F.broadcast(pick), (F.col("y") == F.col("py")) & (F.col("place") == F.col("pp")))
    got = few.select("place", "y", "t").mapInArrow(run, f"place int, y int, f array<{sql}>").toArrow()
    drop_table(own)
    y, place = got["y"].to_numpy().astype(np.int64), got["place"].to_numpy()
    flat = got["f"].combine_chunks()
    values, offs = flat.values.to_numpy(), flat.offsets.to_numpy()
    order = np.lexsort((y, place))
    return [values[offs[i] : offs[i + 1]] for i in order], y[order], count
