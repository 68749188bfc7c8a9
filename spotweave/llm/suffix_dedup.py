"""Suffix-array dedup with sparse suffix arrays.

Only suffixes at content-selected positions are looked at: those whose ``kgram``-word
hash is the least of some ``window`` consecutive ones, so that every passage of
``span`` = kgram + window - 1 words holds such a position, the same one wherever
it occurs. Suffixes whose first k-gram occurs in one document only are dropped by a count.

What is left of every document are its passages of ``span`` words whose least
k-gram is one of the others. Each is hashed whole, and the hashes are counted by
document: a passage is repeated where the least and the greatest document of its
hash differ. The count is summed up before rows move, so a passage of any number
of documents is one row a task, and neither the size of a group nor the bounds of
partitions decide what is found. Equal hashes (64 bits) count as equal passages.

Words are lower-cased runs of non-space. A passage must occur in two different
documents; repeats inside one document alone don't count. In a run of one word
over and over only the first suffix is kept; where its passage is repeated, the
whole run is, as all its windows are equal. Null and short texts have
no spans. Rows that repeat both id and text are one document and get the same
row each. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm import vectext as vt
from spotweave.llm.decontaminate import winnow
from spotweave.llm.store import write_table


def run_lengths(h: np.ndarray) -> np.ndarray:
    """For each item, how often it stands from there on in a row."""
    stop = np.flatnonzero(np.append(h[1:] != h[:-1], True)) + 1
    at = np.arange(len(h))
    return stop[np.searchsorted(stop, at, side="right")] - at


def minimisers(h: np.ndarray, g: np.ndarray, kgram: int, window: int) -> np.ndarray:
    """Positions of least k-gram hashes ``g`` of a document's words ``h``.

    K-grams of one word only never compete, so that what a window keeps depends
    on its words alone; of a run of one word that fills a window, the first counts.
    """
    if len(g) < window:
        return np.zeros(0, dtype=np.int64)
    run = run_lengths(h)
    same = run[: len(g)] >= kgram
    g = np.where(same, np.uint64((1 << 64) - 1), g >> np.uint64(1))
    head = np.append(True, h[1:] != h[:-1]) & (run >= kgram + window - 1)
    return np.flatnonzero((winnow(g, window) & ~same) | head[: len(g)])


def _document_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col).cast("string")))


def _positions(docs: DataFrame, id_col: str, text_col: str, kgram: int, window: int) -> DataFrame:
    """(id, dk, n_words, h, p): k-gram hashes and places of the kept suffixes."""
    src = docs.select(F.col(id_col).alias("id"), _document_key(id_col, text_col).alias("dk"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, hs, ps = np.zeros(len(batch), dtype=np.int64), [], []
            for i, j, data, at in vt.text_chunks(batch.column(2)):
                words = vt.Words(data, at, vt.NOT_SPACE)
                size[i:j] = np.diff(words.first)
                g = words.ngrams(kgram)
                for f, e in zip(words.first[:-1], words.first[1:], strict=True):
                    own = g[f : max(f, e - kgram + 1)].copy()
                    p = minimisers(words.hash[f:e], own, kgram, window)
                    hs.append(vt.as_long(own[p]))
                    ps.append(p.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(hs, pa.list_(pa.int64())), pa.array(ps, pa.list_(pa.int32()))], names=["id", "dk", "n_words", "h", "p"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, dk long, n_words long, h array<long>, p array<int>")


def _least(g: np.ndarray, window: int) -> np.ndarray:
    """The least of each ``window`` consecutive items."""
    wide = 1
    while 2 * wide <= window:
        g, wide = np.minimum(g[:-wide], g[wide:]), 2 * wide
    return np.minimum(g[: len(g) - (window - wide)], g[window - wide :])


def _passages(texts: DataFrame, kgram: int, window: int) -> DataFrame:
    """(h, dk, first, last): hashes and word bounds of the passages of kgram +
    window - 1 words whose least k-gram stands at one of ``places``; for a run of
    one word the hash of its first passage and the bounds of the run."""
    span = kgram + window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            places, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, j, data, at in vt.text_chunks(batch.column(2)):
                words = vt.Words(data, at, vt.NOT_SPACE)
                whole = words.ngrams(span)
                if not len(whole):
                    continue
                here = np.repeat(words.first[:-1], np.diff(bounds[i : j + 1])) + places[bounds[i] : bounds[j]]
                length = run_lengths(words.hash)
                g = words.ngrams(kgram)
                same = length[: len(g)] >= kgram
                least = _least(np.where(same, np.uint64((1 << 64) - 1), g >> np.uint64(1)), window)
                heads = here[same[here]]
                start = np.flatnonzero(np.isin(least, g[here[~same[here]]] >> np.uint64(1)))
                end = words.first[np.searchsorted(words.first, start, side="right")]
                start = start[start + span <= end]
                start, last = np.concatenate((start, heads)), np.concatenate((start + span, heads + length[heads]))
                doc = np.searchsorted(words.first, start, side="right") - 1
                first = words.first[doc]
                last = np.minimum(last, words.first[doc + 1])
                yield pa.RecordBatch.from_arrays([pa.array(vt.as_long(whole[start])), batch.column(0).take(pa.array(doc + i)), pa.array((start - first).astype(np.int32)), pa.array((last - first).astype(np.int32))], names=["h", "dk", "first", "last"])

    return texts.select("dk", "places", "text").mapInArrow(run, "h long, dk long, first int, last int")


def _merged(found: DataFrame) -> DataFrame:
    """(dk, spans, other) with overlapping and touching bounds of ``all`` merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            x, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
            x = x[bounds[0] : bounds[-1]]
            doc = np.repeat(np.arange(len(batch)), np.diff(bounds))
            order = np.lexsort((x, doc))
            doc, first, last = doc[order], x[order] >> 32, x[order] & 0xFFFFFFFF
            upto = np.maximum.accumulate((doc << 32) | last)
            new = np.append(True, ((doc[1:] << 32) | first[1:]) > upto[:-1])[: len(doc)]
            at = np.flatnonzero(new)
            stop = np.append(at[1:], len(doc))[: len(at)] - 1
            flat = np.stack((first[at], upto[stop] & 0xFFFFFFFF), axis=1).ravel().astype(np.int32)
            offsets = 2 * np.searchsorted(doc[at], np.arange(len(batch) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)), batch.column(2)], names=["k", "spans", "next"])

    return found.select("dk", "all", "next").mapInArrow(run, "k long, spans array<int>, next long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kgram: int = 20, window: int = 31) -> DataFrame:
    """(id, n_words, spans, n_repeated, other) for every row: word bounds
    [start, end, ...] of passages of kgram + window - 1 words or more that another
    document has too, the number of their words, and the id of one such document."""
    base = write_table(_positions(docs, id_col, text_col, kgram, window), "suffix-positions")
    each = base.select("dk", F.explode(F.arrays_zip("h", "p")).alias("s")).select("dk", F.col("s.h").alias("h"), F.col("s.p").alias("p"))
    often = each.groupBy("h").agg(F.min("dk").alias("lo"), F.max("dk").alias("hi")).where("lo <> hi").select("h")
    # As a table of its own, so that a join with a very common passage can be split.
    often = write_table(often, "suffix-often")
    places = write_table(each.join(often, "h").groupBy("dk").agg(F.collect_list("p").alias("places")).withColumnRenamed("dk", "k"), "suffix-places")
    texts = docs.select(F.col(id_col).alias("id"), _document_key(id_col, text_col).alias("dk"), F.col(text_col).cast("string").alias("text"))
    each = write_table(_passages(texts.join(places, F.col("dk") == F.col("k")), kgram, window), "suffix-passages")
    often = write_table(each.groupBy("h").agg(F.min("dk").alias("lo"), F.max("dk").alias("hi")).where("lo <> hi"), "suffix-repeated")
    bounds = F.shiftleft(F.col("first").cast("long"), 32).bitwiseOR(F.col("last").cast("long"))
    found = each.join(often, "h").groupBy("dk").agg(F.collect_set(bounds).alias("all"), F.min(F.when(F.col("dk") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))).alias("next"))
    ids = base.groupBy("dk").agg(F.min("id").alias("other")).withColumnRenamed("dk", "next")
    spans = _merged(found).join(ids, "next", "left")
    out = base.select("id", "dk", "n_words").join(spans, F.col("dk") == F.col("k"), "left")
    flat = F.coalesce("spans", F.array().cast("array<int>"))
    total = F.aggregate(F.transform(flat, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(F.col("id").alias(id_col), "n_words", flat.alias("spans"), total.alias("n_repeated"), "other")
