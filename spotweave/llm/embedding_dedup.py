"""Embedding near-dedup by random hyperplanes.

Vectors are hashed in several tables by the signs of projections on random
directions. Vectors of one label that share a hash in a table are compared by
cosine in double precision; links feed distributed connected components.

Equal vectors of a label form one class, compared once whatever their number.
The number of bits follows the label's size, so that a bucket holds about BUCKET
unrelated vectors, and the number of tables follows the bits, so that a pair at
the threshold is missed with probability under ``miss``. A bucket is cut into
blocks of about BLOCK classes; a task takes two blocks (or one) as matrices, and
one product gives all their cosines. A pair that meets in several tables counts
in the first only. Pairs never become rows: a task hands out, for each class,
the number of its links there and one class that they connect it to.

Vectors that are null, empty, zero or hold null or non-finite parts, and rows
without label, link with nothing. Vectors of different lengths never link. A
null id takes part but names no component unless all its ids are null. Repeated
rows are kept. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.blas import one_thread
from spotweave.llm import vectext as vt
from spotweave.llm.components import connected_components
from spotweave.llm.store import drop_table, write_table

one_thread()


#: Unrelated vectors that a bucket holds about; classes that a task takes as one block.
BUCKET, BLOCK = 1024, 1024
#: Up to so many large labels or buckets (24 MB) they are broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000


def plan_tables(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits, tables) for a label of ``n`` classes: about BUCKET unrelated vectors
    a bucket; the miss probability at the threshold holds."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, n) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def _hyperplanes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, bits]).standard_normal((dim, bits * tables))


def unit_rows(packed: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as rows of length 1; scaled first, so that no square
    over- or underflows."""
    x = np.frombuffer(b"".join(packed), dtype=kind).reshape(len(packed), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def forest(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the least row of its component."""
    n = len(link)
    low = np.arange(n)
    while True:
        new = np.minimum(low, np.where(link, low[None], n).min(1))
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _hashes(classes: DataFrame, threshold: float, miss: float, seed: int, kind: str) -> DataFrame:
    """(node, many, lab, vec, sig, keys): the hash of each table, and the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for whole in batches:
            for at in range(0, len(whole), 4096):
                batch = whole.slice(at, 4096)
                packed = batch.column(3).to_pylist()
                lab, n = batch.column(2).to_numpy(), batch.column(4).to_numpy()
                size = np.array([len(v) for v in packed])
                sig: list[bytes] = [b""] * len(batch)
                keys: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(batch)
                plan = np.array([plan_tables(int(x), threshold, miss) for x in n])
                for wide, bits, tables in {(int(s), int(b), int(t)) for s, (b, t) in zip(size, plan, strict=True)}:
                    rows = np.flatnonzero((size == wide) & (plan[:, 0] == bits))
                    x = unit_rows([packed[i] for i in rows], kind)
                    if (x.shape[1], bits) not in planes:
                        planes[x.shape[1], bits] = _hyperplanes(x.shape[1], bits, tables, seed)
                    on = (x @ planes[x.shape[1], bits] >= 0).reshape(len(rows), tables, bits)
                    h = (on.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(2, dtype=np.uint32)
                    table = (np.arange(tables, dtype=np.uint64) << np.uint64(40)) + np.uint64(wide << 32)
                    key = vt.splitmix(lab[rows].view(np.uint64)[:, None] ^ vt.splitmix(table + h))
                    for j, i in enumerate(rows):
                        sig[i] = h[j].tobytes()
                        keys[i] = key[j].view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "many", "lab", "vec", "sig", "keys"])

    return classes.select("node", "many", "lab", "vec", "n").mapInArrow(run, "node long, many long, lab long, vec binary, sig binary, keys array<long>")


def embedding_links(classes: DataFrame, threshold: float, miss: float, seed: int, kind: str) -> DataFrame:
    """(a, b, far) of classes (node, many, lab, vec, n): class ``a`` has links with
    classes of ``far`` vectors in one block of one table, which connect it to ``b``."""
    hashed = write_table(_hashes(classes, threshold, miss, seed, kind), "embedding-hashes")
    spread = hashed.select("node", "many", "lab", "vec", "sig", F.posexplode("keys").alias("t", "key"))
    large = hashed.select(F.explode("keys").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK)
    large = write_table(large.select("k", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb")), "embedding-large")
    near = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    rows = spread.join(near, F.col("key") == F.col("k"), "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("key", F.least("i", "j").alias("b1"), F.greatest("i", "j").alias("b2"), "t", "i", "node", "many", "lab", "vec", "sig")

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Links within one block, or between two."""
        i, node, many, lab, t = (rows.column(c).to_numpy() for c in ("i", "node", "many", "lab", "t"))
        cross = rows.column("b1")[0].as_py() != rows.column("b2")[0].as_py()
        packed, sig, t = rows.column("vec").to_pylist(), rows.column("sig").to_pylist(), int(t[0])
        if len({len(v) for v in packed}) > 1 or (lab != lab[0]).any():  # buckets whose names clash
            kinds = [(int(x), len(v)) for x, v in zip(lab, packed, strict=True)]
            for kind_ in set(kinds):
                yield from compare(rows.filter(pa.array([x == kind_ for x in kinds])))
            return
        x = unit_rows(packed, kind)
        link = x @ x.T >= threshold
        np.fill_diagonal(link, False)
        if cross:
            link &= i[:, None] != i[None]
        if t and link.any():
            # Pairs that an earlier table has too.
            before = np.frombuffer(b"".join(sig), dtype=np.uint32).reshape(len(sig), -1)[:, :t]
            p, q = np.nonzero(link)
            for s in range(0, len(p), 1 << 18):
                u, v = p[s : s + (1 << 18)], q[s : s + (1 << 18)]
                link[u, v] = ~(before[u] == before[v]).any(1)
        on = link.any(1)
        if on.any():
            low, far = forest(link), link @ many
            yield pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(node[low[on]]), pa.array(far[on])], names=["a", "b", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            part = [batch.column(c).to_numpy() for c in range(3)]
            cut = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in part])) + 1
            bounds = [0, *cut.tolist(), len(batch)]
            if held and any(held[0].column(c)[0].as_py() != part[c][0] for c in range(3)):
                yield from compare(pa.Table.from_batches(held))
                held = []
            for s, e in zip(bounds[:-2], bounds[1:-1], strict=True):
                if held or e - s > 1:
                    yield from compare(pa.Table.from_batches([*held, batch.slice(s, e - s)]))
                held = []
            held.append(batch.slice(bounds[-2]))
        if held:
            yield from compare(pa.Table.from_batches(held))

    ordered = rows.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")
    links = write_table(ordered.mapInArrow(run, "a long, b long, far long"), "embedding-links")
    drop_table(hashed)
    drop_table(large)
    return links


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, miss: float = 0.001, seed: int = 7) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    parts = F.col(vec_col).cast("array<double>")
    sound = F.col(label_col).isNotNull() & parts.isNotNull() & (F.size(parts) > 0)
    sound = sound & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(parts, lambda x: x != 0)

    kind = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.values.to_numpy(zero_copy_only=False)
            offs = lists.offsets.to_numpy()
            # Zero has one sign.
            vec = [(flat[offs[i] : offs[i + 1]] + 0.0).astype(kind).tobytes() if ok else None for i, ok in enumerate(batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vec, pa.binary())], names=["id", "lab", "vec"])

    rows = vectors.select(F.col(id_col).alias("id"), F.xxhash64(F.col(label_col)).alias("lab"), F.coalesce(parts, F.array().cast("array<double>")).alias("x"), F.coalesce(sound, F.lit(False)).alias("ok"))
    rows = rows.mapInArrow(packed, f"id {rows.schema['id'].dataType.simpleString()}, lab long, vec binary")
    rows = write_table(rows, "embedding-rows")
    for salt in range(4):
        node = F.xxhash64(F.lit(salt), "lab", "vec")
        classes = rows.where("vec is not null").groupBy(node.alias("node"), "lab", "vec").agg(F.count(F.lit(1)).alias("many"), F.min("id").alias("least"))
        classes = write_table(classes, "embedding-classes")
        if classes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break  # else two different vectors share a name: name them anew
    # Labels of one bucket's size or less are all alike; the others are few.
    wide = write_table(classes.groupBy(F.col("lab").alias("l")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET), "embedding-labels")
    near = F.broadcast(wide) if wide.count() <= BROADCAST_ROWS else wide
    links = embedding_links(classes.join(near, F.col("lab") == F.col("l"), "left").withColumn("n", F.coalesce("n", F.lit(1))), threshold, miss, seed, kind)
    roots = write_table(connected_components(links), "embedding-roots")
    degree = links.groupBy(F.col("a").alias("n1")).agg(F.sum("far").alias("far"))
    named = classes.join(degree, F.col("node") == F.col("n1"), "left").join(roots.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left")
    named = named.select("node", (F.coalesce("far", F.lit(0)) + F.col("many") - 1).alias("n_links"), "least", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(least, "root").select(F.col("node").alias("k"), "n_links", "component_id")
    out = rows.select("id", F.when(F.col("vec").isNotNull(), node).alias("node")).join(of, F.col("node") == F.col("k"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
