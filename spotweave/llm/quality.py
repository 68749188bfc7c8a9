"""Quality classifier: naive Bayes support vectors.

Documents are sets of hashed n-gram indicators: byte trigrams (case and symbols
kept), unigrams to trigrams of word shapes, word unigrams and pairs, and n-grams of immediate
repetition. Each indicator is scaled by its class log-count ratio, rows are
scaled to unit length, and a linear hinge-loss model is fitted by dual coordinate
descent. Margins become probabilities by a logistic curve fitted on margins of
documents outside the fold that made them, weighted to the classes' true shares.

Fitting takes at most ``per_class`` labelled ids of each class to the driver (as
indicator numbers), one text an id and ``most_bytes`` of text a class at most;
scoring covers every whole text. Null and empty texts have no indicators but get
a score like any other. Without labels of both classes the score is the smoothed
share of label 1. Ids labelled more than once count by majority (ties: 1).
Repeated rows repeat their score; other columns pass through, whatever their
names, unless a result column has their name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm import vectext as vt
from spotweave.llm.labelled import SAMPLE_BYTES, bounded_sample, free_memory
from spotweave.llm.store import fresh

BITS = 18
DIM = 1 << BITS

# Byte classes: upper, lower, digit, beyond ASCII, sentence mark, other symbol.
_CLASS = np.full(256, 32, dtype=np.uint8)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 1, 2, 4, 8
for _c in b".,;:'\"()-?":
    _CLASS[_c] = 16
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def indicators(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct indicator numbers) of each text."""
    for i, _, data, at in vt.text_chunks(texts):
        words = vt.Words(data, at, vt.NOT_SPACE)
        wide = data.astype(np.uint32)
        tri = (((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS) if len(data) > 2 else np.zeros(0, dtype=np.uint32)
        tri = tri.astype(np.int32)
        kind = _CLASS[data]
        if len(words.start):
            span = np.stack((words.start, words.end), axis=1).ravel()
            span[-1] = min(span[-1], len(data))
            seen = np.bitwise_or.reduceat(kind, span[:-1] if span[-1] >= len(data) else span)[::2]
            shape = (seen.astype(np.uint64) << np.uint64(16)) | (kind[words.start].astype(np.uint64) << np.uint64(8)) | kind[words.end - 1].astype(np.uint64)
        else:
            shape = np.zeros(0, dtype=np.uint64)
        grams = []
        for k, seq in ((1, shape), (2, shape), (3, shape), (1, words.hash), (2, words.hash)):
            g = _slot(vt.splitmix(vt.ngrams(seq, k) + np.uint64(k + (100 if seq is shape else 0))))
            grams.append((k, g))
        same = np.zeros(len(words.hash), dtype=bool)
        same[1:] = words.hash[1:] == words.hash[:-1]
        for d in range(len(at) - 1):
            f, e, s, t = words.first[d], words.first[d + 1], at[d], at[d + 1]
            parts = [tri[s : max(s, t - 2)]]
            parts += [g[f : max(f, e - k + 1)] for k, g in grams]
            n = int(e - f)
            if n:
                again = int(same[f + 1 : e].sum())
                caps = int((seen[f:e] & 3 == 1).sum())
                odd = int((seen[f:e] & 32 != 0).sum())
                # n-grams of repetition and of kinds of words, as indicators of their share
                share = [again, caps, odd]
                parts.append(np.array([_slot(vt.splitmix(np.array([977 * (j + 1) + min(10, 10 * x // n) * 31 + (x > 0)], dtype=np.uint64)))[0] for j, x in enumerate(share)], dtype=np.int32))
            yield i + d, np.unique(np.concatenate(parts))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p = np.full(DIM, alpha)
    q = np.full(DIM, alpha)
    for ids, label in zip(rows, y, strict=True):
        (p if label else q)[ids] += 1
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    return np.log((p / (n1 + 2 * alpha)) / (q / (n0 + 2 * alpha))).astype(np.float32)


class UnitRows:
    """Values of rows, scaled by ``r`` and to unit length, made as they are asked
    for (all of them would take twice the memory of the rows)."""

    def __init__(self, rows: list[np.ndarray], r: np.ndarray):
        self.rows, self.r = rows, r

    def __getitem__(self, i: int) -> np.ndarray:
        return _unit(self.rows[i], self.r)

    def __len__(self) -> int:
        return len(self.rows)


def dual_coordinate_descent(rows: list[np.ndarray], values: Sequence[np.ndarray], y: np.ndarray, c: float, epochs: int, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + c * sum of hinge losses, classes balanced."""
    w, b = np.zeros(DIM), 0.0
    sign = np.where(y > 0, 1.0, -1.0)
    most = np.where(y > 0, c * len(y) / (2 * max(1, y.sum())), c * len(y) / (2 * max(1, (1 - y).sum())))
    a = np.zeros(len(y))
    norm = np.array([float((v := values[i]) @ v) + 1.0 for i in range(len(values))])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            ids, v = rows[i], values[i]
            g = sign[i] * (float(w[ids] @ v) + b) - 1.0
            new = min(max(a[i] - g / norm[i], 0.0), most[i])
            step = (new - a[i]) * sign[i]
            if step:
                a[i] = new
                w[ids] += step * v
                b += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, b


def _unit(ids: np.ndarray, r: np.ndarray) -> np.ndarray:
    v = r[ids].astype(np.float64)
    n = np.sqrt(v @ v)
    return v / n if n > 0 else v


def logistic_curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) with P(1) = 1/(1 + exp(-(a * margin + b))), by damped Newton steps."""
    x = np.stack((margin, np.ones_like(margin)), axis=1)
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    beta = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        g = x.T @ (weight * (p - t)) + 1e-6 * beta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta = beta - step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


class Model:
    """A fitted classifier: indicator scales and weights, bias, curve."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, share: dict[int, int], c: float = 1.0, epochs: int = 20, folds: int = 3):
        def fit(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
            some, label = [rows[i] for i in keep], y[keep]
            r = log_count_ratios(some, label)
            w, b = dual_coordinate_descent(some, UnitRows(some, r), label, c, epochs)
            return r, w, b

        margin = np.zeros(len(y))
        for f in range(folds):
            inside = np.arange(len(y)) % folds == f
            r, w, b = fit(np.flatnonzero(~inside))
            for i in np.flatnonzero(inside):
                margin[i] = w[rows[i]] @ _unit(rows[i], r) + b
        r, w, self.bias = fit(np.arange(len(y)))
        self.scale, self.weight = r, (w * r).astype(np.float32)
        taken = {k: max(1, int((y == k).sum())) for k in (0, 1)}
        total = sum(share.values())
        weight = np.where(y > 0, share[1] / taken[1], share[0] / taken[0]) * len(y) / total
        self.curve = logistic_curve(margin, y, weight)

    def score(self, ids: np.ndarray) -> float:
        r = self.scale[ids].astype(np.float64)
        n = np.sqrt(r @ r)
        m = (float(self.weight[ids].sum(dtype=np.float64)) / n if n > 0 else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] * m + self.curve[1], -35, 35))))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 2500, most_bytes: int = SAMPLE_BYTES) -> Model | float:
    """A model, or the share of label 1 where there is nothing to tell apart."""
    rows, y, share = bounded_sample(docs, labels, id_col, text_col, label_col, per_class, most_bytes, indicators, pa.int32())
    model = Model(rows, y, share) if 0 < y.sum() < len(y) else (share.get(1, 0) + 1) / (sum(share.values()) + 2)
    del rows
    free_memory()
    return model


def score_quality(docs: DataFrame, model: Model | float, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    if not isinstance(model, Model):
        return docs.select(*keep, F.lit(float(model)).alias(name))
    known = docs.sparkSession.sparkContext.broadcast(model)
    # The text travels once, whether it is kept or only read.
    [own] = fresh(docs, "t")
    read = text_col if text_col in keep else own
    src = docs.select(*keep, *([] if text_col in keep else [F.col(text_col).alias(own)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(read))
            out = [known.value.score(x) for _, x in indicators(texts)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(out, pa.float64())], names=[*keep, name])

    return src.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != own), f"`{name}` double"]))
