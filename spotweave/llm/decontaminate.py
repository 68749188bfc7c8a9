"""Benchmark decontamination by winnowing.

Both sides are reduced to fingerprints: of every ``window`` consecutive k-gram
hashes the least is kept, with k + window - 1 equal to the shared length that
must not be missed, so any such shared span has a common fingerprint. Fingerprints are
joined (a probe of the document's fingerprints in the item table), each common
one fixes an alignment of document and item, and along it the match is extended
left and right word by word. Items shorter than that length are one span; for
each such length the k-gram is the whole item and the window is one.

The benchmark is taken in blocks of bounded size, whatever its total; a block's
table is broadcast. Documents are never shuffled; with several blocks they are
written once for each block but the last, with what was found so far. A phrase
that many items share costs a few steps of NumPy an item and place.

Null or empty texts have no words. Repeated documents each get their row;
repeated items count once by id; items without id count as hits but are not
named. An empty benchmark or document table gives no hits or no rows. Further
columns pass through, whatever their names, unless a result column has their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm import vectext as vt
from spotweave.llm.store import fresh, write_table

#: Bytes of benchmark text whose table is broadcast at once.
BLOCK_BYTES = 32 << 20
KGRAM = 5
#: Pairs of a document's fingerprint and an item's that are extended at once.
PAIRS = 1 << 18


class ItemIndex:
    """Words and fingerprints of one block of items."""

    def __init__(self, ids: list, texts: list, span: int, k: int = KGRAM):
        self.span, self.k = span, min(k, span)
        self.window = span - self.k + 1
        words, self.ids = [], []
        for i, t in zip(ids, texts, strict=True):
            data = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
            h = vt.Words(data, np.array([0, len(data)]), vt.ALNUM).hash
            if len(h):
                words.append(h)
                self.ids.append(None if i is None else str(i))
        self.size = np.array([len(h) for h in words], dtype=np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.size)))
        self.flat = np.concatenate([*words, np.zeros(0, dtype=np.uint64)])
        entries: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for n, h in enumerate(words):
            if len(h) >= span:
                g = vt.ngrams(h, self.k)
                at = np.flatnonzero(winnow(g, self.window))
                entries.setdefault(self.k + (self.window << 8), []).append((g[at], np.full(len(at), n), at))
            else:
                g = vt.ngrams(h, len(h))
                entries.setdefault(len(h) + (1 << 8), []).append((g, np.array([n]), np.array([0])))
        #: (k, window) -> fingerprints in order, their items and places.
        self.tables = {}
        for key, parts in entries.items():
            fp, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(fp, kind="stable")
            self.tables[(key & 255, key >> 8)] = (fp[order], item[order], at[order])


def winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Which k-gram hashes are the least of some ``window`` consecutive ones
    (all equal least ones count); fewer than ``window`` hashes are one window."""
    n = len(g)
    if window <= 1 or n == 0:
        return np.ones(n, dtype=bool)
    window = min(window, n)
    low = g[: n - window + 1].copy()
    for j in range(1, window):
        np.minimum(low, g[j : n - window + 1 + j], out=low)
    keep = np.zeros(n, dtype=bool)
    for j in range(window):
        keep[j : n - window + 1 + j] |= g[j : n - window + 1 + j] == low
    return keep


def _extended(h: np.ndarray, w: np.ndarray, p: np.ndarray, q: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many words, ``most`` at most, agree in a row from places p of ``h`` and q
    of ``w`` on, towards ``step``, within [first, last) and [low, high)."""
    alike = np.ones(len(p), dtype=bool)
    far = np.zeros(len(p), dtype=np.int64)
    for j in range(most):
        u, v = p + step * j, q + step * j
        alike &= (u >= first) & (u < last) & (v >= low) & (v < high)
        at = np.flatnonzero(alike)
        if not len(at):
            break
        alike[at] = h[u[at]] == w[v[at]]
        far += alike
    return far


def match_chunk(words: vt.Words, index: ItemIndex) -> dict[int, tuple[np.ndarray, set]]:
    """text number -> (its hit words, items found) for texts with a hit."""
    h, first = words.hash, words.first
    cover = np.zeros(len(h) + 1, dtype=np.int64)
    named: list[np.ndarray] = []
    for (k, window), (fp, items, places) in index.tables.items():
        g = vt.ngrams(h, k)
        if not len(g):
            continue
        cand = np.flatnonzero(winnow(g, window)) if window > 1 else np.arange(len(g))
        lo, hi = np.searchsorted(fp, g[cand]), np.searchsorted(fp, g[cand], side="right")
        doc = np.searchsorted(first, cand, side="right") - 1
        keep = (hi > lo) & (cand + k <= first[np.minimum(doc + 1, len(first) - 1)])
        cand, lo, doc, many = cand[keep], lo[keep], doc[keep], (hi - lo)[keep]
        upto = np.cumsum(many)
        for s in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
            r = np.arange(s, min(s + PAIRS, int(upto[-1])))
            c = np.searchsorted(upto, r, side="right")
            entry = lo[c] + r - (upto[c] - many[c])
            p, d, n = cand[c], doc[c], items[entry]
            q = index.begin[n] + places[entry]
            bounds = (first[d], first[d + 1], index.begin[n], index.begin[n + 1])
            x = _extended(h, index.flat, p - 1, q - 1, *bounds, -1, window - 1)
            y = _extended(h, index.flat, p + k, q + k, *bounds, 1, window - 1)
            ok = x + y >= window - 1
            np.add.at(cover, (p - x)[ok], 1)
            np.add.at(cover, (p + k + y)[ok], -1)
            named.append(np.unique(d[ok] * len(index.ids) + n[ok]))
    every = np.unique(np.concatenate(named)) if named else np.zeros(0, dtype=np.int64)
    if not len(every):
        return {}
    hit = np.cumsum(cover[:-1]) > 0
    found: dict[int, tuple[np.ndarray, set]] = {}
    for d, n in zip((every // len(index.ids)).tolist(), (every % len(index.ids)).tolist(), strict=True):
        if d not in found:
            found[d] = (hit[first[d] : first[d + 1]], set())
        found[d][1].add(n)
    return found


def _runs(hit: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))).tolist()


def _blocks(bench: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[tuple[list, list]]:
    """The items in blocks of about ``limit`` bytes, each fetched on its own."""
    items = bench.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // limit))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        rows = part.toArrow()
        yield rows["i"].to_pylist(), rows["t"].to_pylist()


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = 10, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hits (word bounds [start, end, start, end, ...] of
    what benchmark windows cover) and items (ids with occurring windows, sorted
    as strings). A window is ``span`` consecutive item words, or a shorter item.
    """
    made = ("n_words", "hits", "items")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    spark = docs.sparkSession
    # The text travels once, whether it is kept or only read.
    [own] = fresh(docs, "t")
    read = text_col if text_col in keep else own
    src = docs.select(*keep, *([] if text_col in keep else [F.col(text_col).alias(own)]), F.lit(None).cast("array<int>").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    types = {f.name: f.dataType.simpleString() for f in src.schema}
    blocks = _blocks(bench, item_id, item_text, block_bytes)
    following = next(blocks)
    while following is not None:
        ids, texts = following
        following = next(blocks, None)
        last = following is None
        index = spark.sparkContext.broadcast(ItemIndex(ids, texts, span))
        through = keep if last or read in keep else [*keep, read]

        def run(batches: Iterator[pa.RecordBatch], index=index, last=last, through=through) -> Iterator[pa.RecordBatch]:
            table = index.value
            for batch in batches:
                col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                hits, items = col["hits"].to_pylist(), col["items"].to_pylist()
                size = np.zeros(len(batch), dtype=np.int64)
                for i, j, data, at in vt.text_chunks(col[read]):
                    words = vt.Words(data, at, vt.ALNUM)
                    size[i:j] = np.diff(words.first)
                    for d, (mask, which) in match_chunk(words, table).items():
                        if hits[i + d]:
                            for s, e in zip(hits[i + d][::2], hits[i + d][1::2], strict=True):
                                mask[s:e] = True
                        hits[i + d] = _runs(mask)
                        items[i + d] = sorted({table.ids[n] for n in which if table.ids[n] is not None} | set(items[i + d] or ()))
                tail = [pa.array(size)] if last else []
                yield pa.RecordBatch.from_arrays(
                    [*(col[c] for c in through), pa.array([x or [] for x in hits], pa.list_(pa.int32())), pa.array([x or [] for x in items], pa.list_(pa.string())), *tail],
                    names=[*through, "hits", "items", *(["n_words"] if last else [])],
                )

        out = [*through, "hits", "items"]
        src = src.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in out) + (", n_words long" if last else ""))
        if not last:
            src = write_table(src, "decontaminate")
    return src


def hit_count(runs: str = "hits"):
    """Number of hit words from the bounds [start, end, ...]."""
    return F.expr(f"aggregate(transform({runs}, (x, i) -> IF(i % 2 = 1, x, -x)), 0, (a, x) -> a + x)").cast("long")
