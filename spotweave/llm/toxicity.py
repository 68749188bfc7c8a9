"""Toxicity by a factorization machine over hashed terms.

Terms are hashes of words and of their first letters. Besides a weight, each
term has a short vector; products of vectors score pairs of terms that occur in
one text, such as an insult with a mention of a group, which added weights miss.

Fitting takes at most ``per_class`` labelled ids of each class to the driver (as
term hashes), one text an id and ``most_bytes`` of text a class at most. It keeps
at most ``most_terms`` terms that tell the classes apart or are frequent, and as many
as a quarter of that which don't, but do so together with another term. It learns by
AdaGrad on the log loss. Scores become probabilities by the best rising
steps (isotonic regression, with a logistic curve to order ties) on scores of
documents outside the fold that made them, weighted to the classes' true shares. Scoring covers every whole text. Null and empty texts have no
terms and get the constant's score. Without labels of both classes the score is
the smoothed share of label 1. Ids labelled more than once count by majority
(ties: 1). Repeated rows repeat their score; other columns pass through, whatever
their names, unless a result column has their name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm import vectext as vt
from spotweave.llm.labelled import SAMPLE_BYTES, bounded_sample, free_memory
from spotweave.llm.quality import logistic_curve
from spotweave.llm.store import fresh

PREFIXES = (4, 5)
#: A pair of terms counts as telling if it is in so many documents of label 1, and they are so many deviations more than its terms alone explain.
PAIR_DOCUMENTS, PAIR_DEVIATIONS = 8, 4.5
#: Terms of a document whose pairs are looked for (a random choice of a longer document's; counts of pairs found are of whole documents).
PAIR_TERMS = 256


def _chunk_terms(data: np.ndarray, at: np.ndarray) -> tuple[vt.Words, list[np.ndarray]]:
    words = vt.Words(data, at, vt.ALNUM)
    long = words.end - words.start
    out = [words.hash]
    for k in PREFIXES:
        h = words.hash_spans(words.start, np.minimum(words.start + k, words.end))
        out.append(np.where(long >= k, vt.splitmix(h + np.uint64(k)), words.hash))
    return words, out


def document_terms(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct term hashes) of each text."""
    for i, _, data, at in vt.text_chunks(texts):
        words, terms = _chunk_terms(data, at)
        for d in range(len(at) - 1):
            f, e = words.first[d], words.first[d + 1]
            yield i + d, np.unique(np.concatenate([t[f:e] for t in terms]))


def log_odds(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Smoothed log odds ratio of being in a of n1 documents and in b of n0."""
    return np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))


def pair_strength(rows: list[np.ndarray], y: np.ndarray, every: np.ndarray, a: np.ndarray, b: np.ndarray, seed: int = 1) -> np.ndarray:
    """For each of the sorted terms ``every``, in a documents of label 1 and b of
    label 0: by how many deviations its best pair is in more documents of label 1
    than the log odds of both terms add up to (0: no pair is telling). Terms in
    more than half of the documents are left out."""
    n = len(y)
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    best = np.zeros(len(every))
    some = np.flatnonzero((a >= PAIR_DOCUMENTS) & (a + b <= n / 2))
    if len(some) < 2:
        return best
    odds = log_odds(a[some], b[some], n1, n0)
    number = np.full(len(every), -1, dtype=np.int64)
    number[some] = np.arange(len(some))
    bits = np.zeros((len(some), (n + 63) // 64), dtype=np.uint64)  # the documents of each term
    for d, row in enumerate(rows):
        ids = number[np.searchsorted(every, row)]
        bits[ids[ids >= 0], d // 64] |= np.uint64(1 << (d % 64))
    # Terms of the same documents (a word and its first letters) have the same pairs.
    _, one, same = np.unique(bits.view(f"V{bits.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    bits, odds = bits[one], odds[one]
    rng = np.random.default_rng(seed)
    toxic: list[np.ndarray] = []
    for d in np.flatnonzero(y):
        ids = np.flatnonzero(bits[:, d // 64] & np.uint64(1 << (int(d) % 64)))
        toxic.append(ids if len(ids) <= PAIR_TERMS else np.sort(rng.choice(ids, PAIR_TERMS, replace=False)))
    high, low = np.tril_indices(PAIR_TERMS, -1)  # those of fewer terms come first

    def pairs(ids: np.ndarray) -> np.ndarray:
        n = len(ids) * (len(ids) - 1) // 2
        return ids[low[:n]] * len(one) + ids[high[:n]]

    def cell(code: np.ndarray) -> np.ndarray:
        return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).view(np.int64)

    # Cells never undercount, so a pair that is frequent enough is never passed over.
    table = np.zeros(1 << 24, dtype=np.uint16)
    for ids in toxic:
        at = cell(pairs(ids))
        table[at] += table[at] < 60000
    # With h documents, all of label 1, a pair is sqrt(h / ratio) deviations out, where
    # ratio is the odds of label 1 that its terms add up to; fewer can't be telling.
    ratio = np.exp(odds)
    found, held = [np.zeros(0, dtype=np.int64)], 0
    for ids in toxic:
        code, e = pairs(ids), ratio[ids]
        n = len(code)
        need = PAIR_DEVIATIONS**2 * np.clip(n1 / n0 * e[low[:n]] * e[high[:n]], 0.02 / 0.98, 0.98 / 0.02)
        found.append(code[table[cell(code)] >= np.maximum(need, PAIR_DOCUMENTS)])
        held += len(found[-1])
        if held > 1 << 22:
            found, held = [np.unique(np.concatenate(found))], 0
    del table
    codes = np.unique(np.concatenate(found))
    label = np.zeros(bits.shape[1], dtype=np.uint64)
    for d in np.flatnonzero(y):
        label[d // 64] |= np.uint64(1 << (int(d) % 64))
    strength = np.zeros(len(one))
    for lo in range(0, len(codes), 1 << 15):
        i, j = np.divmod(codes[lo : lo + (1 << 15)], len(one))
        both = bits[i] & bits[j]
        m, hit = np.bitwise_count(both).sum(1, dtype=np.int64), np.bitwise_count(both & label).sum(1, dtype=np.int64)
        p = np.clip(1 / (1 + np.exp(-(math.log(n1 / n0) + odds[i] + odds[j]))), 0.02, 0.98)
        z = (hit - m * p) / np.sqrt(np.maximum(m, 1) * p * (1 - p))
        z = np.where((hit >= PAIR_DOCUMENTS) & (z >= PAIR_DEVIATIONS), z, 0)
        np.maximum.at(strength, i, z)
        np.maximum.at(strength, j, z)
    best[some] = strength[same]
    return best


class FactorizationMachine:
    """``terms``: the hashes known, in order; ``value``: what each counts; ``w0``,
    ``w``, ``v``: constant, weights and vectors; ``curve``: slope and shift to log odds;
    ``steps``: scores and the probabilities they stand for."""

    curve = (1.0, 0.0)
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, rank: int = 4, epochs: int = 15, most_terms: int = 2048, rate: float = 0.1, decay: float = 1e-4, seed: int = 1):
        self._choose(rows, y, most_terms)
        known = [self.find(r) for r in rows]
        rng = np.random.default_rng(seed)
        n = len(self.terms)
        w0, w, v = 0.0, np.zeros(n), rng.normal(0, 0.05, (n, rank))
        g0, gw, gv = 1e-8, np.full(n, 1e-8), np.full((n, rank), 1e-8)
        for _ in range(epochs):
            for i in rng.permutation(len(y)):
                ids = known[i]
                x = self.value[ids]
                vi = v[ids] * x[:, None]
                s = vi.sum(0)
                z = w0 + (x * w[ids]).sum() + 0.5 * ((s * s).sum() - (vi * vi).sum())
                g = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[i]
                g0 += g * g
                w0 -= rate * g / np.sqrt(g0)
                if len(ids):
                    d = g * x + decay * w[ids]
                    gw[ids] += d * d
                    w[ids] -= rate * d / np.sqrt(gw[ids])
                    d = g * x[:, None] * (s - vi) + decay * v[ids]
                    gv[ids] += d * d
                    v[ids] -= rate * d / np.sqrt(gv[ids])
        self.w0, self.w, self.v = w0, w, v

    def _choose(self, rows: list[np.ndarray], y: np.ndarray, most: int) -> None:
        """Terms in three documents or more that differ most between the classes
        (z score of the log odds), an eighth of ``most`` by frequency, and up to a
        quarter by their best pair."""
        n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
        pos, pc = np.unique(np.concatenate([r for r, t in zip(rows, y, strict=True) if t]), return_counts=True)
        neg, nc = np.unique(np.concatenate([r for r, t in zip(rows, y, strict=True) if not t]), return_counts=True)
        every = np.union1d(pos, neg)
        a, b = np.zeros(len(every)), np.zeros(len(every))
        a[np.searchsorted(every, pos)] = pc
        b[np.searchsorted(every, neg)] = nc
        z = log_odds(a, b, n1, n0)
        z /= np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        often = a + b >= 3
        order = np.argsort(-np.abs(z) * often, kind="stable")[: most - most // 8]
        order = order[(np.abs(z) * often)[order] >= 1.5]
        common = np.argsort(-(a + b), kind="stable")[: most // 8]
        common = common[often[common]]
        pair = pair_strength(rows, y, every, a, b)
        paired = np.argsort(-pair, kind="stable")[: most // 4]
        paired = np.setdiff1d(paired[pair[paired] > 0], order)
        chosen = np.unique(np.concatenate((order, common, paired)))
        self.terms = every[chosen]
        # A term counts by how it tells the classes apart, alone or in a pair, so that neutral ones don't drown the others.
        z[paired] = np.maximum(np.abs(z[paired]), pair[paired])
        self.value = np.clip(np.abs(z[chosen]) / 6, 0.05, 1.0)
        self._quick()

    def _quick(self) -> None:
        self.mask = np.zeros(1 << 16, dtype=bool)
        self.mask[(self.terms >> np.uint64(48)).astype(np.int64)] = True

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Numbers of the known ones among ``terms``."""
        if not len(self.terms):
            return np.zeros(0, dtype=np.int64)
        some = terms[self.mask[(terms >> np.uint64(48)).astype(np.int64)]]
        at = np.minimum(np.searchsorted(self.terms, some), len(self.terms) - 1)
        return np.unique(at[self.terms[at] == some])

    def logit(self, ids: np.ndarray) -> float:
        x = self.value[ids]
        vi = self.v[ids] * x[:, None]
        s = vi.sum(0)
        return float(self.w0 + (x * self.w[ids]).sum() + 0.5 * ((s * s).sum() - (vi * vi).sum()))

    def score_texts(self, texts: pa.Array) -> list[float]:
        out = [0.0] * len(texts)
        for i, _, data, at in vt.text_chunks(texts):
            words, terms = _chunk_terms(data, at)
            first = words.first
            hits, where = [], []
            for t in terms:
                p = np.flatnonzero(self.mask[(t >> np.uint64(48)).astype(np.int64)]) if len(self.terms) else np.zeros(0, dtype=np.int64)
                k = np.minimum(np.searchsorted(self.terms, t[p]), max(0, len(self.terms) - 1))
                ok = self.terms[k] == t[p] if len(p) else np.zeros(0, dtype=bool)
                hits.append(k[ok])
                where.append(np.searchsorted(first, p[ok], side="right") - 1)
            hit, doc = np.concatenate(hits), np.concatenate(where)
            pair = np.unique(doc * (len(self.terms) + 1) + hit)
            doc, hit = pair // (len(self.terms) + 1), pair % (len(self.terms) + 1)
            cut = np.searchsorted(doc, np.arange(len(at)))
            for d in range(len(at) - 1):
                z = self.logit(hit[cut[d] : cut[d + 1]])
                p = 1 / (1 + np.exp(-np.clip(self.curve[0] * z + self.curve[1], -35, 35)))
                out[i + d] = float(p if self.steps is None else 0.95 * np.interp(z, *self.steps) + 0.05 * p)
        return out


def rising_steps(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on x: both ends of each step and its share of 1,
    with half a document of each class added to each step; between steps a line."""
    order = np.argsort(x, kind="stable")
    light = float(weight.min())
    blocks: list[list[float]] = []  # weight of 1, weight, least x, largest x
    for v, t, w in zip(x[order], y[order], weight[order], strict=True):
        blocks.append([w * t, w, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a, b, _, hi = blocks.pop()
            blocks[-1][0] += a
            blocks[-1][1] += b
            blocks[-1][3] = hi
    p = np.array([(a + light / 2) / (b + light) for a, b, _, _ in blocks])
    return np.array([e for _, _, lo, hi in blocks for e in (lo, hi)]), np.repeat(np.maximum.accumulate(p), 2)


def fit_calibrated(rows: list[np.ndarray], y: np.ndarray, share: dict[int, int], folds: int = 3, **options) -> FactorizationMachine:
    """A machine whose curve is fitted on scores across ``folds``."""
    logit = np.zeros(len(y))
    fold = np.arange(len(y)) % folds
    for f in range(folds):
        inside = np.flatnonzero(fold != f)
        if not 0 < y[inside].sum() < len(inside):
            continue
        part = FactorizationMachine([rows[i] for i in inside], y[inside], **options)
        for i in np.flatnonzero(fold == f):
            logit[i] = part.logit(part.find(rows[i]))
    whole = FactorizationMachine(rows, y, **options)
    taken = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.where(y > 0, share[1] / taken[1], share[0] / taken[0]) * len(y) / sum(share.values())
    whole.curve, whole.steps = logistic_curve(logit, y, weight), rising_steps(logit, y, weight)
    return whole


def _signed_terms(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for i, x in document_terms(texts):
        yield i, vt.as_long(x)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2500, most_bytes: int = SAMPLE_BYTES) -> FactorizationMachine | float:
    """A model, or the share of label 1 where there is nothing to tell apart."""
    rows, y, share = bounded_sample(docs, labels, id_col, text_col, label_col, per_class, most_bytes, _signed_terms, pa.int64())
    rows = [x.view(np.uint64) for x in rows]
    model = fit_calibrated(rows, y, share) if 0 < y.sum() < len(y) else (share.get(1, 0) + 1) / (sum(share.values()) + 2)
    del rows
    free_memory()
    return model


def score_toxicity(docs: DataFrame, model: FactorizationMachine | float, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    if not isinstance(model, FactorizationMachine):
        return docs.select(*keep, F.lit(float(model)).alias(name))
    known = docs.sparkSession.sparkContext.broadcast(model)
    # The text travels once, whether it is kept or only read.
    [own] = fresh(docs, "t")
    read = text_col if text_col in keep else own
    src = docs.select(*keep, *([] if text_col in keep else [F.col(text_col).alias(own)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = known.value.score_texts(b.column(b.schema.get_field_index(read)))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(out, pa.float64())], names=[*keep, name])

    return src.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != own), f"`{name}` double"]))
