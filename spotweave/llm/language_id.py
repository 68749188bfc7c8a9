"""Language identification by a linear-chain conditional random field.

Words get scores for each language from hashed features (the word itself, its
first and last one to three bytes, its byte trigrams with the bounds marked);
learned transitions join neighbouring words; forward-backward gives every word's
posterior, so text that switches language is labelled word by word. A document's
prediction is the language with the largest mean posterior over its words with
letters, and that mean is its score.

Every value of ``lang`` is learned. Learning takes about ``per_lang`` documents of
each to the driver, chosen by hash of the id, one text an id, and of these as
many whole texts as ``most_chars`` a language (MOST_CHARS over all) hold. It cuts them into pieces and strings pieces of
different languages together, so that transitions at switches are learned too.

``und`` is predicted for null texts and texts without a letter, with score 0,
and for all if no language is known. Between languages of equal mean posterior
the first by code point is predicted. Repeated rows repeat their result; other
columns pass through, whatever their names, unless a result column has their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm import vectext as vt
from spotweave.llm.labelled import chosen_within, free_memory, held_out
from spotweave.llm.store import drop_table, fresh, write_table

BITS = 17
DIM = 1 << BITS
#: Characters of text that a fit takes at most, over all languages.
MOST_CHARS = 32_000_000
_AFFIXES = (1, 2, 3)


def _slot(h: np.ndarray, tag: int) -> np.ndarray:
    return (vt.splitmix(h + np.uint64(tag * 1_000_003)) >> np.uint64(64 - BITS)).astype(np.int32)


def _trigrams(data: np.ndarray, words: vt.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the byte trigrams of all words, each word with a mark on both
    sides, and where each word's trigrams start and how many there are."""
    size = words.end - words.start + 2
    at = np.concatenate(([0], np.cumsum(size)))
    padded = np.full(at[-1], 0x20, dtype=np.uint32)
    inside = np.ones(at[-1], dtype=bool)
    inside[at[:-1]] = False
    inside[at[1:] - 1] = False
    # Words are runs of word bytes, so their bytes in order are all word bytes.
    take = np.repeat(words.start - at[:-1] - 1, size) + np.arange(at[-1])
    padded[inside] = vt.LOWER[data[take[inside]]]
    g = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:] if at[-1] > 2 else np.zeros(0, dtype=np.uint32)
    slot = ((g * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)
    return slot, at[:-1], size - 2


def word_features(data: np.ndarray, words: vt.Words) -> list[np.ndarray]:
    """One slot a word for the lexicon and each affix length."""
    out = [_slot(words.hash, 1)]
    size = words.end - words.start
    for k in _AFFIXES:
        out.append(_slot(words.hash_spans(words.start, words.start + np.minimum(k, size)), 10 + k))
        out.append(_slot(words.hash_spans(words.end - np.minimum(k, size), words.end), 20 + k))
    return out


class Crf:
    """Feature weights ``w`` (slots x languages), ``trans`` and ``start`` scores."""

    def __init__(self, langs: list[str], texts: list[str], gold: list[int], epochs: int = 4, piece: int = 64, batch: int = 64, rate: float = 0.1, seed: int = 5):
        self.langs, n = langs, len(langs)
        rng = np.random.default_rng(seed)
        words, label = [], []
        for text, y in zip(texts, gold, strict=True):
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            found = vt.Words(data, np.array([0, len(data)]), vt.ALNUM)
            if not len(found.start):
                continue
            tri, at, many = _trigrams(data, found)
            flat = np.stack(word_features(data, found), axis=1)
            i = 0
            while i < len(flat):
                j = min(len(flat), i + int(rng.integers(3, 40)))
                words.append([np.concatenate((flat[k], tri[at[k] : at[k] + many[k]])) for k in range(i, j)])
                label.append(y)
                i = j
        # Pieces in random order, strung together and cut to equal length.
        order = rng.permutation(len(words))
        seq = [w for p in order for w in words[p]]
        tag = np.concatenate([np.full(len(words[p]), label[p]) for p in order]) if len(order) else np.zeros(0, dtype=int)
        self.w, self.trans, self.start = np.zeros((DIM, n), dtype=np.float32), np.zeros((n, n)), np.zeros(n)
        gw, gt, gs = np.full((DIM, n), 1e-6, dtype=np.float32), np.full((n, n), 1e-6), np.full(n, 1e-6)
        total = len(seq) // piece
        if total == 0 and len(seq):
            piece, total = len(seq), 1
        for _ in range(epochs):
            for lo in range(0, total, batch):
                hi = min(total, lo + batch)
                some = seq[lo * piece : hi * piece]
                y = tag[lo * piece : hi * piece].reshape(hi - lo, piece)
                ids = np.concatenate(some)
                size = np.array([len(x) for x in some])
                at = np.concatenate(([0], np.cumsum(size)[:-1]))
                e = np.add.reduceat(self.w[ids], at, axis=0).reshape(hi - lo, piece, n)
                post, pair, first = self._expect(e)
                d = post.copy()
                np.put_along_axis(d, y[:, :, None], np.take_along_axis(d, y[:, :, None], 2) - 1, 2)
                gold_pair = np.zeros((n, n))
                np.add.at(gold_pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
                flat = np.repeat(d.reshape(-1, n), size, axis=0)
                uniq, inv = np.unique(ids, return_inverse=True)
                g = np.stack([np.bincount(inv, flat[:, k], len(uniq)) for k in range(n)], axis=1) / (hi - lo) + 1e-5 * self.w[uniq]
                gw[uniq] += g * g
                self.w[uniq] -= rate * g / np.sqrt(gw[uniq])
                g = (pair - gold_pair) / (hi - lo)
                gt += g * g
                self.trans -= rate * g / np.sqrt(gt)
                g = first.sum(0) / (hi - lo) - np.bincount(y[:, 0], minlength=n) / (hi - lo)
                gs += g * g
                self.start -= rate * g / np.sqrt(gs)

    def _expect(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posteriors, expected transition counts and first-word posteriors of
        equally long sequences with emission scores ``e``."""
        b, t, n = e.shape
        m = np.exp(self.trans)
        x = np.exp(e - e.max(2, keepdims=True))
        alpha, beta = np.zeros_like(x), np.ones_like(x)
        a = np.exp(self.start - self.start.max()) * x[:, 0]
        alpha[:, 0] = a / a.sum(1, keepdims=True)
        for i in range(1, t):
            a = (alpha[:, i - 1] @ m) * x[:, i]
            alpha[:, i] = a / a.sum(1, keepdims=True)
        for i in range(t - 2, -1, -1):
            z = (x[:, i + 1] * beta[:, i + 1]) @ m.T
            beta[:, i] = z / z.sum(1, keepdims=True)
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        pair = np.zeros((n, n))
        if t > 1:
            z = alpha[:, :-1, :, None] * m * (x[:, 1:] * beta[:, 1:])[:, :, None, :]
            pair = (z / z.sum((2, 3), keepdims=True)).sum((0, 1))
        return post, pair, post[:, 0]

    def emissions(self, data: np.ndarray, words: vt.Words) -> np.ndarray:
        e = np.zeros((len(words.start), len(self.langs)), dtype=np.float32)
        for slot in word_features(data, words):
            e += self.w[slot]
        tri, at, many = _trigrams(data, words)
        run = np.concatenate((np.zeros((1, e.shape[1])), np.cumsum(self.w[tri], axis=0, dtype=np.float64)))
        e += (run[at + many] - run[at]).astype(np.float32)
        return e

    def posteriors(self, e: np.ndarray, first: np.ndarray, lane: int = 64) -> np.ndarray:
        """Forward-backward over all documents of a chunk at once; ``first``:
        the first word of each document, and the number of words.

        Each step is a matrix (the first word of a document forgets what was
        before). Steps are multiplied up within lanes of ``lane`` words side by
        side, lanes are chained one by one, and then all lanes run together.
        """
        n, k = e.shape
        if not n:
            return np.zeros((0, k))
        x = np.exp(e - e.max(1, keepdims=True)).astype(np.float64)
        p = np.exp(self.trans - self.trans.max())[None] * x[:, None, :]
        begin = np.unique(first[first < n])
        p[begin] = (np.exp(self.start - self.start.max()) * x[begin])[:, None, :]
        lanes = -(-n // lane)
        pad = lanes * lane - n
        if pad:
            p = np.concatenate((p, np.broadcast_to(np.eye(k), (pad, k, k))))
        p = p.reshape(lanes, lane, k, k)
        q = p[:, 0].copy()
        for t in range(1, lane):
            q = q @ p[:, t]
            q /= q.max((1, 2), keepdims=True)
        head, tail = np.empty((lanes, k)), np.empty((lanes, k))
        a = np.full(k, 1.0 / k)
        for s in range(lanes):
            head[s] = a
            a = a @ q[s]
            a /= a.sum()
        b = np.ones(k)
        for s in range(lanes - 1, -1, -1):
            tail[s] = b
            b = q[s] @ b
            b /= b.sum()
        out = np.empty((lanes, lane, k))
        a = head
        for t in range(lane):
            a = np.einsum("sl,slm->sm", a, p[:, t])
            a /= a.sum(1, keepdims=True)
            out[:, t] = a
        b = tail
        for t in range(lane - 1, -1, -1):
            out[:, t] *= b
            b = np.einsum("slm,sm->sl", p[:, t], b)
            b /= b.sum(1, keepdims=True)
        out = out.reshape(-1, k)[:n]
        return out / out.sum(1, keepdims=True)

    def label(self, texts: pa.Array, spans: bool) -> tuple[list[str], list[float], list[list[str]]]:
        """Language, score and runs ``lang:first word:end word`` of each text."""
        lang, score, runs = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in range(len(texts))]
        for i, _, data, at in vt.text_chunks(texts, max(1 << 14, (1 << 22) // max(4, len(self.langs)) ** 2 * 4)):
            words = vt.Words(data, at, vt.ALNUM)
            if not len(words.start):
                continue
            post = self.posteriors(self.emissions(data, words), words.first)
            letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
            has = (letters[words.end] - letters[words.start]) > 0
            high = np.concatenate(([0], np.cumsum(data >= 0x80)))
            # Words without an ASCII letter count if they hold another letter.
            for w in np.flatnonzero(~has & ((high[words.end] - high[words.start]) > 0)):
                has[w] = any(c.isalpha() for c in data[words.start[w] : words.end[w]].tobytes().decode("utf-8", "replace"))
            total = np.concatenate((np.zeros((1, post.shape[1])), np.cumsum(post * has[:, None], axis=0)))
            count = np.concatenate(([0], np.cumsum(has)))
            best = post.argmax(1)
            for d in range(len(at) - 1):
                f, e = words.first[d], words.first[d + 1]
                n = int(count[e] - count[f])
                if n:
                    mean = (total[e] - total[f]) / n
                    k = int(mean.argmax())
                    lang[i + d], score[i + d] = self.langs[k], float(min(1.0, max(0.0, mean[k])))
                if spans and e > f:
                    cut = np.flatnonzero(np.diff(best[f:e])) + 1
                    bounds = [0, *cut.tolist(), int(e - f)]
                    runs[i + d] = [f"{self.langs[best[f + s]]}:{s}:{t}" for s, t in zip(bounds[:-1], bounds[1:], strict=True)]
        return lang, score, runs


_LETTER = np.zeros(256, dtype=np.int64)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = 1


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 250, most_chars: int = 2_000_000) -> Crf | None:
    """A model learned from about ``per_lang`` documents of each language whose
    id isn't held out, with texts of ``most_chars`` characters a language at most
    (those of the least hashes, whole; one that doesn't fit is passed over)."""
    spark = docs.sparkSession
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language")), F.lit(1 << 30))
    known = known.select(F.col(lang_col).alias("l"), place.alias("p"), F.col(text_col).cast("string").alias("t"))
    counts = known.groupBy("l").agg(F.approx_count_distinct("p").alias("n")).collect()  # a row a language
    if not counts:
        return None
    langs = sorted(r["l"] for r in counts)
    few = spark.createDataFrame([(r["l"], min(1.0, per_lang / r["n"]) * (1 << 30)) for r in counts], "k string, upto double")
    rows = known.join(F.broadcast(few), (F.col("l") == F.col("k")) & (F.col("p") <= F.col("upto")))
    rows = write_table(rows.groupBy("l", "p").agg(F.min(F.struct(F.xxhash64("t").alias("x"), "t"))["t"].alias("t")).coalesce(32), "language-sample")
    sizes = sorted(tuple(r) for r in rows.select("l", "p", F.length("t")).collect())
    taken = chosen_within([(lang, (lang, p), size) for lang, p, size in sizes], min(most_chars, MOST_CHARS // len(langs)))
    pick = spark.createDataFrame(taken, "k string, q long")
    got = rows.join(F.broadcast(pick), (F.col("l") == F.col("k")) & (F.col("p") == F.col("q"))).select("l", "p", "t").toArrow()
    drop_table(rows)
    found = sorted(zip(got["l"].to_pylist(), got["p"].to_pylist(), got["t"].to_pylist(), strict=True))
    number = {x: i for i, x in enumerate(langs)}
    model = Crf(langs, [t for *_, t in found], [number[x] for x, *_ in found])
    del got, found
    free_memory()
    return model


def identify_language(docs: DataFrame, model: Crf | None, text_col: str = "text", keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score, and with ``spans`` the runs of words
    of one language as ``lang:first:end`` strings in lang_spans."""
    made = ["lang_pred", "score"] + ["lang_spans"] * spans
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), *([F.array().cast("array<string>").alias("lang_spans")] * spans))
    known = docs.sparkSession.sparkContext.broadcast(model)
    [own] = fresh(docs, "t")
    src = docs.select(*keep, F.col(text_col).cast("string").alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, runs = known.value.label(b.column(b.schema.get_field_index(own)), spans)
            cols = [pa.array(lang, pa.string()), pa.array(score, pa.float64())] + [pa.array(runs, pa.list_(pa.string()))] * spans
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *cols], names=[*keep, *made])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != own), "lang_pred string", "score double"]) + ", lang_spans array<string>" * spans
    return src.mapInArrow(run, schema)
