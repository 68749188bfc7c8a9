"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles. Its parity sketch flips one bit a
shingle, so the Hamming distance of two sketches never exceeds the size of the
symmetric difference of the sets. Sets of sizes a and b with similarity t differ in at
most D = (a + b)(1 - t)/(1 + t) elements, so if the sketch is cut into D + 1
segments (and a few to spare, as empty ones say nothing), linked documents agree
in one segment at least. Sizes fall into bands
such that partners lie in the same or the next band; each band pair is a level
with its own number of segments. (A segment is kept as one 64-bit value: the
exclusive or of a random value for each bit set. Segments of equal bits have
equal values.)

Work is on classes, one for each distinct set: a text's copies send their keys
once a task. Documents that agree in a segment are not paired with each other.
Instead:

1. Segments with the same classes are one group. Its class in most groups is its
   pivot; all members are held against the pivot. Where a task has many members
   of one segment, all but their least one go to other partitions, so that a hot
   segment doesn't meet in one task.
2. A group in which a member failed and is still of another component than its
   pivot has its members held against each other by whole sketches, in blocks,
   without making rows of pairs.

A pair is ruled out if its sketches differ in more than D bits; what remains is
compared exactly. No link is lost. A group of n near copies costs n comparisons
of texts, and rows for possible pairs across components only. Components of the
links follow by stars. Tables on the way are deleted when nothing reads them.

Defined cases: a null or wordless text has an empty set, size 0 and no links; a
text with fewer words than a shingle is one shingle; copies share a class;
repeated rows are kept, each with the component of its text; a null id takes
part but never names a component unless all its ids are null; an empty table
gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm import vectext as vt
from spotweave.llm.components import connected_components
from spotweave.llm.store import drop_table, fresh, write_table

#: Up to so many candidate ids (16 MB) they are broadcast to pick texts; beyond, texts are picked by a shuffled join.
BROADCAST_IDS = 1_000_000
#: Members of a key that a task holds against as many others, and bytes of sketches it holds against each other at once.
BLOCK, STRIP_BYTES = 8000, 4 << 20
#: Keys that a task groups before it sends them; members of one key beyond which all but the least are sent apart; parts they are dealt into.
WINDOW, MANY, PARTS = 400_000, 8, 256
#: Rows of one key that a task holds to name the group by its members; a larger group keeps its key as name.
HELD = 100_000
#: Partitions of the sketch tried before empty segments are used as they are.
SEEDS = 6


@lru_cache(maxsize=8)
def bands(num: int, den: int, most: int = 1 << 31) -> np.ndarray:
    """Lower bounds of the size bands, for similarity num/den: sizes two bands
    apart are never similar enough."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, (out[-1] - 1) * den // num + 1))
    return np.array(out)


def most_apart(total: int, num: int, den: int) -> int:
    """The largest symmetric difference of similar sets with sizes adding to ``total``."""
    return total * (den - num) // (den + num)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a word hash sequence."""
    if not len(h):
        return h
    return np.unique(vt.ngrams(h, min(k, len(h))))


@lru_cache(maxsize=4096)
def spare_segments(d: int, least: int) -> int:
    """Segments beyond d + 1, so that sets of ``least`` or more elements seldom
    have more empty ones: the expected number and three deviations."""
    spare = 0
    for _ in range(8):
        p = d + 1 + spare
        empty = p * math.exp(-least / p)
        need = math.ceil(empty + 3 * math.sqrt(empty)) if empty > 0.01 else 0
        if need <= spare:
            break
        spare = need
    return min(spare, d + 1)


def segment_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Join keys of a set: its sketch segments at the levels of its band."""
    n = len(s)
    b = bands(num, den)
    band = int(np.searchsorted(b, n, side="right")) - 1
    out = []
    for level in (band, band - 1):
        if level < 0:
            continue
        d = most_apart(int(b[level + 1] - 1 + b[level + 2] - 1), num, den)
        if d < 1:
            continue  # only equal sets are that close, and they are one class
        spare = spare_segments(d, int(b[level]))
        p = d + 1 + spare
        step = (1 << 64) // p
        bounds = np.arange(1, p, dtype=np.uint64) * np.uint64(step)
        for seed in range(SEEDS):
            token = s if not seed else np.sort(vt.splitmix(s ^ np.uint64(seed)))
            bit = vt.splitmix(token & np.uint64(0xFFFFFFFF))
            at = np.concatenate(([0], np.searchsorted(token, bounds), [n]))
            run = np.concatenate((np.zeros(1, dtype=np.uint64), np.bitwise_xor.accumulate(bit)))
            value = run[at[1:]] ^ run[at[:-1]]
            tag = vt.splitmix(np.arange(p, dtype=np.uint64) + np.uint64((level << 40) + (seed << 32)))
            full = at[1:] > at[:-1]
            if seed == SEEDS - 1:
                out.append(vt.splitmix(value ^ tag))
                break
            out.append(vt.splitmix(value ^ tag)[full])
            # Linked sets agree in spare + 1 segments. If one of them has no more
            # than ``spare`` empty ones, they agree in a full one; else both go on.
            if (~full).sum() <= spare:
                break
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64)


def _text_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, _, data, at in vt.text_chunks(texts):
        words = vt.Words(data, at, vt.NOT_SPACE)
        for d in range(len(at) - 1):
            yield i + d, shingle_set(words.hash[words.first[d] : words.first[d + 1]], k)


def _node(s: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 63/64-bit digests of a set."""
    x = vt.splitmix(s + np.uint64(seed))
    y = vt.splitmix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    a = int(vt.splitmix(np.array([np.bitwise_xor.reduce(x) + np.uint64(len(s))]))[0] >> np.uint64(1))
    return a, int(np.add.reduce(y).view(np.int64))


def document_sets(docs: DataFrame, id_col: str, text_col: str, k: int, seed: int = 0) -> DataFrame:
    """(id, x, n_shingles, node, check): ``node`` names the distinct set, ``x``
    with the id finds the text again."""
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("x"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, check = [0] * len(batch), [None] * len(batch), [None] * len(batch)
            for i, s in _text_sets(batch.column(2), k):
                n[i] = len(s)
                if len(s):
                    node[i], check[i] = _node(s, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64())], names=["id", "x", "n_shingles", "node", "check"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, x long, n_shingles long, node long, check long")


def window_groups(key: np.ndarray, node: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the least node of its key, and whether the key has more than ``most`` rows."""
    order = np.lexsort((node, key))
    sorted_key = key[order]
    head = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
    size = np.diff(np.concatenate((head, [len(key)])))
    rep, many = np.empty_like(node), np.empty(len(node), dtype=bool)
    rep[order], many[order] = np.repeat(node[order][head], size), np.repeat(size > most, size)
    return rep, many


def _keys(docs: DataFrame, text_col: str, k: int, num: int, den: int, seed: int) -> DataFrame:
    """(key, node, rep) of every document with a set, once for each set and window of a task."""
    src = docs.select(F.col(text_col).cast("string").alias("t"))

    def flush(keys: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        # Rows stay in the order of nodes, which makes them smaller when they are sent.
        key, node = vt.as_long(np.concatenate(keys)), np.repeat(np.array(nodes, dtype=np.int64), [len(x) for x in keys])
        rep, many = window_groups(key, node, MANY)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(rep, mask=~many)], names=["key", "node", "rep"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        nodes: list[int] = []
        size, seen = 0, set()
        for batch in batches:
            for _, s in _text_sets(batch.column(0), k):
                if not len(s):
                    continue
                node = _node(s, seed)[0]
                if node in seen:
                    continue
                seen.add(node)
                keys.append(segment_keys(s, num, den))
                nodes.append(node)
                size += len(keys[-1])
                if size > WINDOW:
                    out = flush(keys, nodes)
                    for at in range(0, len(out), 100_000):
                        yield out.slice(at, 100_000)
                    keys, nodes, size = [], [], 0
                    if len(seen) > WINDOW:
                        seen = set()
        if size:
            yield flush(keys, nodes)

    return src.mapInArrow(run, "key long, node long, rep long")


def _groups(keys: DataFrame) -> DataFrame:
    """The distinct (g, node) of keys with two nodes or more. ``g`` is a hash of
    the nodes of the key, so that keys of the same nodes are one group, or the
    key itself where its nodes don't meet in one task.

    Keys are sent once. A partition is sorted and read as a stream that holds at
    most HELD rows of one key, so a key of any number of documents needs no memory.
    """

    def named(key: np.ndarray, node: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(g, node) of whole keys."""
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((head, [len(key)])))
        led = np.logical_or.reduceat(lead, head)
        total = np.add.reduceat(vt.splitmix(node.view(np.uint64)), head)
        g = np.where(led, key[head], vt.as_long(vt.splitmix(total)))
        many = np.repeat(led | (size > 1), size)
        return np.repeat(g, size)[many], node[many]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        key, node, lead = none, none, none.astype(bool)  # rows of the key under way
        large: int | None = None  # a key with more than HELD rows
        for batch in batches:
            k, n, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).fill_null(-1).to_numpy()
            apart = (rep >= 0) & (rep != n)
            out = [(k[apart], n[apart])]
            key, node, lead = (np.concatenate(x) for x in ((key, k[~apart]), (node, n[~apart]), (lead, rep[~apart] >= 0)))
            fresh_row = np.concatenate((np.ones(min(1, len(key)), dtype=bool), (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
            if len(key):
                # A row may lead in one task and not in another.
                lead = np.logical_or.reduceat(lead, np.flatnonzero(fresh_row))
                key, node = key[fresh_row], node[fresh_row]
                cut = int(np.searchsorted(key, key[-1]))
                if large is not None:
                    upto = int((key == large).sum())
                    out.append((key[:upto], node[:upto]))
                    key, node, lead, cut = key[upto:], node[upto:], lead[upto:], max(0, cut - upto)
                    large = large if not len(key) else None
                if cut:
                    out.append(named(key[:cut], node[:cut], lead[:cut]))
                key, node, lead = key[cut:], node[cut:], lead[cut:]
                if len(key) > HELD:
                    large = int(key[-1])
                    out.append((key, node))
                    key, node, lead = none, none, none.astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in out])), pa.array(np.concatenate([y for _, y in out]))], names=["g", "node"])
        if len(key):
            g, n = named(key, node, lead)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["g", "node"])

    apart = F.coalesce(F.col("rep") != F.col("node"), F.lit(False))
    home = F.when(apart, F.xxhash64("key", F.pmod("node", F.lit(PARTS)))).otherwise(F.col("key"))
    return keys.repartition(home).sortWithinPartitions(apart.desc(), "key", "node").mapInArrow(run, "g long, node long").distinct()


def _starred(groups: DataFrame) -> DataFrame:
    """(g, node, pivot): the pivot is the group's node that is in most groups
    (ties: the greatest)."""
    weight = write_table(groups.groupBy(F.col("node").alias("w")).agg(F.count(F.lit(1)).alias("weight")), "jaccard-weights")
    near = F.broadcast(weight) if weight.count() <= BROADCAST_IDS else weight
    heavy = groups.join(near, F.col("node") == F.col("w"))
    pivots = heavy.groupBy(F.col("g").alias("p")).agg(F.max(F.struct("weight", "node"))["node"].alias("pivot"))
    out = write_table(groups.join(pivots, F.col("g") == F.col("p")).select("g", "node", "pivot"), "jaccard-starred")
    drop_table(weight)
    return out


def sketch(s: np.ndarray, num: int, den: int) -> bytes:
    """Parity sketch with 16 bits or more for each element that may differ; the
    number of bits is a power of two, so that a longer sketch folds to a shorter."""
    d = max(1, most_apart(2 * len(s), num, den))
    bits = max(64, 1 << (16 * d - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Sketches, one a row, shortened to ``width`` bytes."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def sketch_rows(sketches: pa.Array, width: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their sketches as a matrix of bytes) for each length of sketches;
    with ``width``, one matrix of all, folded to it."""
    flat = sketches.cast(pa.large_binary())
    _, offs, body = flat.buffers()
    at = np.frombuffer(offs, dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = np.frombuffer(body, dtype=np.uint8) if len(flat) else np.zeros(0, dtype=np.uint8)
    size = np.diff(at)
    whole = np.empty((len(size), width), dtype=np.uint8) if width else None
    for wide in np.unique(size):
        rows = np.flatnonzero(size == wide)
        bits = raw[at[rows][:, None] + np.arange(wide)]
        if whole is None:
            yield rows, bits
        else:
            whole[rows] = fold(bits, width)
    if whole is not None:
        yield np.arange(len(size)), whole


def _bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(a).view(np.uint64) ^ np.ascontiguousarray(b).view(np.uint64)).sum(-1, dtype=np.int64)


def may_link(n: np.ndarray, m: np.ndarray, apart: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sizes and the differing bits of sketches allow sets to be similar;
    never wrong if the answer is no."""
    return (den * np.minimum(n, m) >= num * np.maximum(n, m)) & (apart <= (n + m) * (den - num) // (den + num))


def _texts(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, text) of the documents that stand for ``nodes`` (rows that repeat
    stay), and a table to drop when they are read."""
    one = classes.join(nodes, F.col("node") == F.col("w")).select("node", F.col("row.id").alias("i"), F.col("row.x").alias("y"))
    one = write_table(one, "jaccard-wanted")
    pick = F.broadcast(one) if one.count() <= BROADCAST_IDS else one
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("x"), F.col(text_col).cast("string").alias("text"))
    return texts.join(pick, F.col("id").eqNullSafe(F.col("i")) & (F.col("x") == F.col("y"))).select("node", "text"), one


def _sketches(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, n, sk) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(len(s), sketch(s, num, den)) for _, s in _text_sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([s for _, s in made], pa.binary())], names=["node", "n", "sk"])

    return texts.select("node", "text").mapInArrow(run, "node long, n long, sk binary").dropDuplicates(["node"])


def _possible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (c, x) that their sketches don't rule out."""
    left, right = (sketches.select(F.col("node").alias(v), F.col("n").alias(f"n{v}"), F.col("sk").alias(f"s{v}")) for v in "cx")
    both = pairs.select("c", "x").join(left, "c").join(right, "x").select("c", "x", "nc", "sc", "nx", "sx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
                ok = np.zeros(len(batch), dtype=bool)
                other = {len(y[0]): (r, y) for r, y in sketch_rows(batch.column(5))}
                for rows, x in sketch_rows(batch.column(3)):
                    for at_y, y in other.values():
                        both, i, j = np.intersect1d(rows, at_y, assume_unique=True, return_indices=True)
                        if len(both):
                            width = min(x.shape[1], y.shape[1])
                            ok[both] = may_link(n[both], m[both], _bits_apart(fold(x[i], width), fold(y[j], width)), num, den)
                keep = pa.array(ok)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["c", "x"])

    return both.mapInArrow(run, "c long, x long")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (c, x) that are similar by their exact sets."""
    t = texts.select("node", "text")
    both = pairs.join(t.select(F.col("node").alias("x"), F.col("text").alias("tx")), "x").join(t.select(F.col("node").alias("c"), F.col("text").alias("tc")), "c").select("c", "x", "tc", "tx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, np.ndarray] = (None, np.zeros(0, dtype=np.uint64))
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                linked = []
                for i, sx in _text_sets(part.column(3), k):
                    c = part.column(0)[i].as_py()
                    if held[0] != c:
                        held = (c, next(s for _, s in _text_sets(part.column(2).slice(i, 1), k)))
                    shared = len(np.intersect1d(sx, held[1], assume_unique=True))
                    linked.append(den * shared >= num * (len(sx) + len(held[1]) - shared))
                ok = pa.array(linked, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], names=["c", "x"])

    return both.mapInArrow(run, "c long, x long")


def _open_groups(starred: DataFrame, pairs: DataFrame, near: DataFrame, roots: DataFrame) -> DataFrame | None:
    """(g) of groups whose nodes aren't of one component yet: a member of such a
    group failed against its pivot and is of another component than it."""
    ends = [roots.select(F.col("node").alias(f"n{v}"), F.col("root").alias(f"r{v}")) for v in "cx"]
    failed = pairs.join(near, ["c", "x"], "left_anti").join(ends[0], F.col("c") == F.col("nc"), "left").join(ends[1], F.col("x") == F.col("nx"), "left")
    failed = write_table(failed.where(F.coalesce("rc", "c") != F.coalesce("rx", "x")).select("c", "x"), "jaccard-failed")
    n = failed.count()
    if not n:
        drop_table(failed)
        return None
    small = F.broadcast(failed) if n <= BROADCAST_IDS else failed
    groups = starred.join(small, (F.col("pivot") == F.col("c")) & (F.col("node") == F.col("x")), "left_semi").select("g").distinct()
    groups = write_table(groups, "jaccard-open")
    drop_table(failed)
    return groups


def _apart(starred: DataFrame, groups: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root, m) of the members of ``groups`` of three nodes or more,
    which are m."""
    near = F.broadcast(groups) if groups.count() <= BROADCAST_IDS else groups
    rows = starred.join(near, "g", "left_semi").select(F.col("g").alias("key"), "node")
    rows = rows.join(roots.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    rows = write_table(rows, "jaccard-apart")
    many = rows.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("m")).where("m > 2")
    return rows.join(many, F.col("key") == F.col("k")).select("key", "node", "root", "m")


def _within_keys(apart: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of nodes of one key but different components that their sketches
    don't rule out. A key's nodes are dealt into blocks of about BLOCK; a task
    takes two blocks, so no group is too large for one. Pairs are compared by
    their sketches where they lie, and only possible ones become rows."""
    sk = sketches.select(F.col("node").alias("s"), "n", "sk")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = apart.withColumn("nb", blocks).withColumn("i", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    rows = rows.select("key", "node", "root", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
    rows = rows.select("key", "node", "root", "i", F.least("i", "j").alias("b1"), F.greatest("i", "j").alias("b2"))
    rows = rows.join(sk, F.col("node") == F.col("s")).select("key", "b1", "b2", "i", "node", "root", "n", "sk")

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Possible pairs of one key and two of its blocks (or one)."""
        i, node, root, n = (rows.column(c).to_numpy() for c in ("i", "node", "root", "n"))
        if len(node) < 2 or (root == root[0]).all():
            return
        sk = rows.column("sk").combine_chunks()
        width = int(pa.compute.min(pa.compute.binary_length(sk)).as_py())
        [(_, bits)] = sketch_rows(sk, width)
        bits = bits.view(np.uint64)
        cross = rows.column("b1")[0].as_py() != rows.column("b2")[0].as_py()
        order = np.argsort(n, kind="stable")
        bits, i, node, root, n = bits[order], i[order], node[order], root[order], n[order]
        step = max(1, STRIP_BYTES // max(1, bits.nbytes))
        for lo in range(0, len(n), step):
            hi = min(len(n), lo + step)
            # Sizes rise, so partners that are small enough stand in a row.
            to = int(np.searchsorted(n, n[hi - 1] * den // num, side="right"))
            far = np.bitwise_count(bits[lo:hi, None] ^ bits[None, lo:to]).sum(2, dtype=np.int64)
            ok = may_link(n[lo:hi, None], n[None, lo:to], far, num, den) & (root[lo:hi, None] != root[None, lo:to])
            ok &= np.arange(lo, hi)[:, None] < np.arange(lo, to)
            if cross:
                ok &= i[lo:hi, None] != i[None, lo:to]
            p, q = np.nonzero(ok)
            if len(p):
                a, b = node[lo + p], node[lo + q]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["c", "x"])

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
                yield from compare(pa.Table.from_batches([*held, batch.slice(s, e - s)]))
                held = []
            held.append(batch.slice(bounds[-2]))
        if held:
            yield from compare(pa.Table.from_batches(held))

    ordered = rows.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")
    return ordered.mapInArrow(run, "c long, x long").distinct()


def similar_links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, seed: int) -> DataFrame:
    """Links (a, b) between nodes, as a table; enough of them to connect all that links connect."""

    def linked(pairs: DataFrame, tag: str) -> DataFrame:
        ends = pairs.select(F.col("c").alias("w")).union(pairs.select(F.col("x").alias("w"))).distinct()
        texts, one = _texts(docs, id_col, text_col, classes, ends)
        texts = write_table(texts.dropDuplicates(["node"]), "jaccard-texts")
        out = write_table(_verified(pairs, texts, k, num, den), tag)
        drop_table(texts)
        drop_table(one)
        return out

    groups = write_table(_groups(_keys(docs, text_col, k, num, den, seed)), "jaccard-groups")
    starred = _starred(groups)
    texts, one = _texts(docs, id_col, text_col, classes, groups.select(F.col("node").alias("w")).distinct())
    sketches = write_table(_sketches(texts, k, num, den), "jaccard-sketches")
    drop_table(one)
    drop_table(groups)

    pairs = write_table(starred.where("node <> pivot").select(F.col("pivot").alias("c"), F.col("node").alias("x")).distinct(), "jaccard-pairs")
    possible = write_table(_possible(pairs, sketches, num, den), "jaccard-possible")
    near = linked(possible, "jaccard-near")
    links = near.select(F.col("c").alias("a"), F.col("x").alias("b"))
    roots = write_table(connected_components(near, "c", "x"), "jaccard-stars")
    done = [starred, sketches, pairs, possible, roots]
    left = _open_groups(starred, pairs, near, roots)
    if left is not None:
        # What pivots leave apart: members of one group in different components.
        cross = _within_keys(_apart(starred, left, roots), sketches, num, den)
        tried = pairs.select(F.least("c", "x").alias("c"), F.greatest("c", "x").alias("x"))
        cross = write_table(cross.join(tried, ["c", "x"], "left_anti"), "jaccard-cross")
        done += [left, cross]
        if not cross.isEmpty():
            more = linked(cross, "jaccard-more")
            links = links.union(more.select("c", "x"))
    for table in done:
        drop_table(table)
    return links


def _solve(docs: DataFrame, id_col: str, text_col: str, shingle: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows as (id, x, n_shingles, node), and (node, least, root) of all nodes
    with the least id."""
    for seed in range(4):
        sets = write_table(document_sets(docs, id_col, text_col, shingle, seed), "jaccard-sets")
        classes = sets.where("node is not null").groupBy("node").agg(F.min(F.struct("id", "x")).alias("row"), F.min("id").alias("least"), F.min("check").alias("lo"), F.max("check").alias("hi"))
        classes = write_table(classes, "jaccard-classes")
        if classes.where("lo <> hi").isEmpty():
            break  # else two different sets share a name: name them anew
    links = similar_links(docs, classes, id_col, text_col, shingle, num, den, seed)
    roots = write_table(connected_components(links), "jaccard-roots")
    of = roots.select(F.col("node").alias("n"), "root")
    # A table, as are the picks by root: joins of two scans are split where one node or root is hot.
    nodes = write_table(classes.join(of, F.col("node") == F.col("n"), "left").select("node", "least", F.coalesce("root", "node").alias("root")), "jaccard-nodes")
    drop_table(roots)
    drop_table(classes)
    return sets, nodes


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) for every row: documents link when
    den * |A & B| >= num * |A | B| for their sets of ``shingle``-word shingles;
    component_id is the least id reachable by links."""
    sets, nodes = _solve(docs, id_col, text_col, shingle, num, den)
    least = write_table(nodes.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id")), "jaccard-least")
    of = nodes.join(least, F.col("root") == F.col("r")).select(F.col("node").alias("k"), "component_id")
    out = sets.select("id", "n_shingles", "node").join(of, F.col("node") == F.col("k"), "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component: that of the least id (ties:
    the text of the least hash; null ids last), once if rows repeat. Texts
    without words all stay. Further columns pass through, whatever their names."""
    sets, nodes = _solve(docs, id_col, text_col, shingle, num, den)
    rows = sets.where("node is not null").groupBy("id", "x", "node").agg(F.count(F.lit(1)).alias("many")).join(nodes.select("node", "root"), "node")
    rows = write_table(rows, "jaccard-rows")
    best = rows.groupBy(F.col("root").alias("r")).agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "x")).alias("best"))
    best = write_table(best, "jaccard-best")
    both = rows.join(best, F.col("root") == F.col("r")).withColumn("stays", F.struct("id", "x").eqNullSafe(F.struct("best.id", "best.x")))
    i, y, x, stays = fresh(docs, "id", "y", "x", "stays")
    marked = both.where(~F.col("stays") | (F.col("many") > 1)).select(F.col("id").alias(i), F.col("x").alias(y), F.col("stays").alias(stays))
    marked = write_table(marked, "jaccard-marked")
    for table in (sets, nodes, rows, best):
        drop_table(table)
    near = F.broadcast(marked) if marked.count() <= BROADCAST_IDS else marked
    all_docs = docs.withColumn(x, F.xxhash64(F.col(text_col).cast("string"))).join(near, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(x) == F.col(y)), "left")
    once = all_docs.where(F.col(stays)).dropDuplicates([id_col, x])
    return all_docs.where(F.col(stays).isNull()).union(once).select(*docs.columns)
