"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a fixed hash. A source whose target is q whole passes over
itself plus a remainder takes each document q times, and once more those whose
hash lies below a threshold. Thresholds for all sources are found together
without sorting documents: sizes are summed by source and hash bucket, the
bucket in which the running sum passes the remainder is refined by the next hash
bits, and so on down to one hash value. Thresholds are nested: a larger target
only adds documents. Only DataFrame operations are used.

Defined cases: null text has size 0; null is a source of its own, last in
order; rows with equal ids share a hash and are taken together; a null id hashes
like an empty one; a source of size 0 has target 0; an empty table gives an
empty result; further columns are passed through, whatever their names, unless a
result column has their name. Sources of equal name are one; names differ by
code points. All sources' sizes, a row each, are ordered in one task: a million
sources are about 100 MB there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.llm.store import write_table

WORD = r"[^\x20\x09-\x0D]+"
#: The hash has LEVELS * BITS bits; each level's histogram has 2**BITS buckets a source.
BITS, LEVELS = 12, 5
#: Up to so many sources (a row of about 100 bytes each), per-source tables are broadcast; beyond, Spark joins by shuffle.
BROADCAST_SOURCES = 20_000


def hash60(key: Column) -> Column:
    """60 bits of MD5 of the key as text, as BIGINT."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per source key ``__s``: source_size and target.

    Sources in code point order (null last) get ``weights`` in turn and share
    ``share`` times all sizes; a target stops at ``most`` times its source and
    what is above goes to the others by weight. That is a water level: the
    least level at which sum(min(level * weight, cap)) reaches the total.
    """
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.partitionBy().orderBy(F.col("__null"), F.col("__s"))
    by_level = Window.partitionBy().orderBy("__full_at", "__s")
    so_far = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = sizes.groupBy("__s").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("__null", F.col("__s") == "n")
    per = per.withColumn("__rank", F.row_number().over(by_name))
    per = per.withColumn("__w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("__cap", F.col("source_size") * F.lit(float(most))).withColumn("__full_at", F.col("__cap") / F.col("__w"))
    per = per.withColumn("__total", F.sum("source_size").over(every) * F.lit(float(share)))
    # The level if all sources before this one, by the level that fills them, are full.
    left = F.col("__total") - (F.sum("__cap").over(so_far) - F.col("__cap"))
    open_w = F.sum("__w").over(every) - (F.sum("__w").over(so_far) - F.col("__w"))
    per = per.withColumn("__at", F.row_number().over(by_level)).withColumn("__level", left / open_w)
    first = F.min(F.when(F.col("__level") <= F.col("__full_at"), F.struct("__at", "__level"))).over(every)["__level"]
    per = per.withColumn("target", F.coalesce(F.least(first * F.col("__w"), F.col("__cap")), F.col("__cap")))
    return per.select("__s", "source_size", "target")


def _refine(rows: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """From (source, prefix of hash bits, remaining budget) to the same with
    BITS more bits: the bucket in which the running sum passes the budget."""
    top = BITS * (LEVELS - level)
    inside = rows.join(state, "__s").where(F.shiftright("__h", top) == F.col("__prefix"))
    hist = inside.groupBy("__s", "__rest", F.shiftright("__h", top - BITS).alias("__b")).agg(F.sum("size").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hist = hist.withColumn("__before", upto - F.col("__n"))
    hit = hist.where((F.col("__before") <= F.col("__rest")) & (F.col("__before") + F.col("__n") > F.col("__rest")))
    return hit.select("__s", F.col("__b").alias("__prefix"), (F.col("__rest") - F.col("__before")).alias("__rest"), F.col("__n").alias("__bound"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words taken of the
    document, repeats counted). A source's taken words differ from its target by
    at most half of one document (or of one group of equal ids)."""
    made = ("size", "source_size", "target", "taken")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    own = [f"__k{i}" for i in range(len(keep))]  # so that no kept name meets a helper's
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    plain = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, own, strict=True)), key.alias("__s"), hash60(F.col(id_col)).alias("__h"), word_count(F.col(text_col)).alias("size"))
    # The text is read once for counting; all later steps read this narrow table.
    sizes = write_table(plain if text_col not in keep else plain.drop(own[keep.index(text_col)]), "mix-sizes")
    goal = write_table(targets(sizes, weights, share, most), "mix-targets")
    small = goal.count() <= BROADCAST_SOURCES
    near = (lambda df: F.broadcast(df)) if small else (lambda df: df)

    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("__passes", passes)
    state = goal.where(F.col("source_size") > 0).select("__s", F.lit(0).cast("long").alias("__prefix"), (F.col("target") - F.col("__passes") * F.col("source_size")).alias("__rest"))
    rows = sizes.where(F.col("size") > 0).select("__s", "__h", "size")
    state = write_table(_refine(rows, near(state), 0), "mix-level")
    # Only the boundary bucket of each source is looked at again.
    rest = write_table(rows.join(near(state.select("__s", "__prefix")), "__s").where(F.shiftright("__h", BITS * (LEVELS - 1)) == F.col("__prefix")).drop("__prefix"), "mix-boundary")
    for level in range(1, LEVELS):
        state = _refine(rest, near(state.drop("__bound")), level)
    below = state.select("__s", (F.col("__prefix") + F.when(F.col("__bound") < 2 * F.col("__rest"), 1).otherwise(0)).alias("__below"))
    goal = write_table(goal.join(below, "__s", "left"), "mix-thresholds")
    times = F.col("__passes") + F.when(F.col("__h") < F.col("__below"), 1).otherwise(0)
    body = sizes if text_col not in keep else plain
    return body.join(near(goal), "__s").select(*(F.col(k).alias(c) for c, k in zip(keep, own, strict=True)), "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))
