"""Neighbour graphs of places and the precision of the autoregressive kernel."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from spotweave.blas import one_thread
from spotweave.operators.components import connected_components
from spotweave.store import drop_table, write_table

one_thread()

#: Up to so many coordinates, neighbours are searched in grid cells; beyond, by blocks of all pairs.
GRID_DIMS = 3
#: Places in a block of the all-pairs search.
BLOCK = 4096


def with_coords(spots: DataFrame, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(spot_id, coords ARRAY<DOUBLE>) from single columns or a coords column."""
    if "coords" in spots.columns:
        return spots.select("spot_id", F.col("coords").cast("array<double>").alias("coords"))
    return spots.select("spot_id", F.array(*(F.col(c).cast("double") for c in columns)).alias("coords"))


def _square_distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, t: s + t)


def knn(points: DataFrame, k: int) -> DataFrame:
    """(i, j, d2, rank): the k nearest other places of each place; ties go to the
    lesser id. ``points``: (spot_id, coords)."""
    points = points.where(F.col("coords").isNotNull())
    corners = [f(F.get("coords", F.lit(d))).alias(f"{f.__name__}{d}") for d in range(GRID_DIMS) for f in (F.min, F.max)]
    box = points.agg(F.max(F.size("coords")).alias("d"), F.count(F.lit(1)).alias("n"), *corners).first()
    if not box["n"] or box["n"] < 2 or k < 1:
        return points.sparkSession.createDataFrame([], "i long, j long, d2 double, rank int")
    return _grid_knn(points, k, box) if box["d"] <= GRID_DIMS else _block_knn(points, k, box["n"])


def _grid_knn(points: DataFrame, k: int, box: Row) -> DataFrame:
    """Search in the cells around a place, of a side that doubles for places
    whose k-th candidate may lie beyond these cells. No place lies beyond the box."""
    dims, n = box["d"], box["n"]
    lo = [box[f"min{d}"] for d in range(dims)]
    extent = [box[f"max{d}"] - box[f"min{d}"] for d in range(dims)]
    wide = [e for e in extent if e > 0]
    # A little wider than for k places, so that corners of a lattice are settled at once too.
    side = 1.125 * (math.prod(wide) * k / n) ** (1 / len(wide)) if wide else 1.0
    todo, done, left = points, None, n
    while True:
        cells = lambda d: F.floor((F.col("coords")[d] - F.lit(lo[d])) / F.lit(side))  # noqa: E731, B023
        last = [math.floor(e / side) for e in extent]
        # How far the cells around a place reach at least; to either side, unless they hold the box's edge there.
        edges = [w for d in range(dims) for w in (
            F.when(cells(d) > 1, F.col("coords")[d] - F.lit(lo[d]) - (cells(d) - 1) * F.lit(side)),
            F.when(cells(d) < last[d] - 1, (cells(d) + 2) * F.lit(side) - (F.col("coords")[d] - F.lit(lo[d]))),
        )]
        reach = F.array_min(F.array(*edges, F.lit(float("inf")))) * F.lit(1 - 1e-9)
        all_ = points.select(F.col("spot_id").alias("j"), F.col("coords").alias("cj"), F.array(*(cells(d) for d in range(dims))).alias("cell"))
        offsets = [o - 1 for o in range(3)]
        near = todo.select(F.col("spot_id").alias("i"), F.col("coords").alias("ci"), reach.alias("reach"), *(F.explode(F.array(*(cells(d) + o for o in offsets))).alias(f"c{d}") for d in range(1)))
        for d in range(1, dims):
            near = near.withColumn(f"c{d}", F.explode(F.array(*(F.floor((F.col("ci")[d] - F.lit(lo[d])) / F.lit(side)) + o for o in offsets))))
        near = near.withColumn("cell", F.array(*(F.col(f"c{d}") for d in range(dims))))
        met = near.join(all_, "cell").where("i <> j").withColumn("d2", _square_distance(F.col("ci"), F.col("cj")))
        top = met.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d2", "j"))).where(F.col("rank") <= k).select("i", "j", "d2", "rank", "reach")
        stored = write_table(top, "knn")
        top = stored.drop("reach")
        if side >= max(wide, default=0):
            return top if done is None else done.union(top)
        sure = stored.where((F.col("rank") == min(k, n - 1)) & (F.sqrt("d2") < F.col("reach"))).select("i")
        left -= sure.count()
        found = top.join(sure, "i", "left_semi") if left else top
        done = found if done is None else done.union(found)
        if not left:
            return done
        todo = write_table(todo.join(sure.withColumnRenamed("i", "spot_id"), "spot_id", "left_anti"), "knn-left")
        side *= 2


def _block_knn(points: DataFrame, k: int, n: int) -> DataFrame:
    """All pairs by blocks: each pair of blocks is one task's matrix product,
    and only the k best of each block survive it."""
    blocks = max(1, -(-n // BLOCK))
    b = points.withColumn("b", F.pmod(F.xxhash64("spot_id"), F.lit(blocks)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = b.select("spot_id", "coords", F.col("b").alias("bi"), every.alias("bj"))
    right = b.select("spot_id", "coords", every.alias("bi"), F.col("b").alias("bj"))

    def best(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"i": [], "j": [], "d2": []}).astype({"i": "int64", "j": "int64"})
        x, y = np.stack(p["coords"].to_numpy()), np.stack(q["coords"].to_numpy())
        ids, others = p["spot_id"].to_numpy(), q["spot_id"].to_numpy()
        out = []
        for r in range(0, len(x), 256):
            rough = (x[r : r + 256] ** 2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x[r : r + 256] @ y.T
            m = min(len(y), k + 9)
            some = np.argpartition(rough, m - 1, axis=1)[:, :m]
            # Candidates by the fast formula, distances by the exact one, all that tie with the last.
            for a, cand in enumerate(some):
                bound = rough[a, cand].max()
                cand = np.flatnonzero(rough[a] <= bound + 1e-9 * (1 + abs(bound)))
                cand = cand[others[cand] != ids[r + a]]
                d = np.zeros(len(cand))
                for c in range(x.shape[1]):  # summed in order, as SQL does
                    d += (x[r + a, c] - y[cand, c]) ** 2
                top = np.lexsort((others[cand], d))[:k]
                out.append(pd.DataFrame({"i": ids[r + a], "j": others[cand][top], "d2": d[top]}))
        return pd.concat(out)

    met = left.groupBy("bi", "bj").cogroup(right.groupBy("bi", "bj")).applyInPandas(best, "i long, j long, d2 double")
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d2", "j"))).where(F.col("rank") <= k)


def mutual(edges: DataFrame) -> DataFrame:
    """(i, j, w = 1) where each place lists the other."""
    e = edges.select("i", "j")
    back = e.select(F.col("j").alias("i"), F.col("i").alias("j"))
    return e.join(back, ["i", "j"], "left_semi").distinct().withColumn("w", F.lit(1.0))


def symmetrise(edges: DataFrame) -> DataFrame:
    """(W + W') / 2."""
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    e = edges.select("i", "j", (w / 2).alias("w"))
    return e.union(e.select("j", "i", "w")).groupBy("i", "j").agg(F.sum("w").alias("w"))


def adjacency(points: DataFrame, k: int = 4, mutual_only: bool = True) -> DataFrame:
    """Symmetric neighbour graph without loops, but with a loop of weight 1 at
    places that would have no neighbour. ``points``: (spot_id, coords)."""
    near = write_table(knn(points, k).select("i", "j"), "knn-edges")
    w = (mutual(near) if mutual_only else symmetrise(near)).where("i <> j and w <> 0")
    return with_loops(points, w)


def with_loops(points: DataFrame, w: DataFrame) -> DataFrame:
    lone = points.select(F.col("spot_id").alias("i")).join(w.select("i").distinct(), "i", "left_anti")
    return w.select("i", "j", "w").union(lone.select("i", F.col("i").alias("j"), F.lit(1.0)))


def checked_adjacency(adj: DataFrame, n: int) -> DataFrame:
    """A caller's graph, made symmetric by averaging; dense ones draw a warning."""
    out = symmetrise(adj)
    if out.count() > 0.1 * n * n:
        warnings.warn("the graph holds over a tenth of all pairs", stacklevel=2)
    return out


def degrees(adj: DataFrame) -> DataFrame:
    return adj.groupBy("i").agg(F.sum("w").alias("degree"))


def car_precision(points: DataFrame, adj: DataFrame, rho: float = 0.99) -> DataFrame:
    """(i, j, v): I - rho D^-1/2 W D^-1/2."""
    d = degrees(adj).withColumn("s", 1 / F.sqrt(F.greatest("degree", F.lit(1e-12)))).select("i", "s")
    off = adj.join(d, "i").join(d.withColumnsRenamed({"i": "j", "s": "t"}), "j").select("i", "j", (-rho * F.col("w") * F.col("s") * F.col("t")).alias("v"))
    one = points.select(F.col("spot_id").alias("i"), F.col("spot_id").alias("j"), F.lit(1.0).alias("v"))
    return off.union(one).groupBy("i", "j").agg(F.sum("v").alias("v"))


def precision_quadratic_form(precision: DataFrame, values: DataFrame) -> DataFrame:
    """(gene_id, ch, q): x'Mx for long columns (gene_id, ch, spot_id, y)."""
    a = values.select("gene_id", "ch", F.col("spot_id").alias("i"), F.col("y").alias("a"))
    b = values.select("gene_id", "ch", F.col("spot_id").alias("j"), F.col("y").alias("b"))
    return precision.join(a, "i").join(b, ["gene_id", "ch", "j"]).groupBy("gene_id", "ch").agg(F.sum(F.col("v") * F.col("a") * F.col("b")).alias("q"))


__all__ = ["adjacency", "car_precision", "checked_adjacency", "connected_components", "degrees", "drop_table", "knn", "mutual", "precision_quadratic_form", "symmetrise", "with_coords", "with_loops"]
