"""Vectorised tokenising and hashing of Arrow text batches.

Texts stay in their UTF-8 Arrow buffer; word bounds, word hashes and word
n-gram hashes are computed for a whole chunk of documents by NumPy, so the cost
is a few nanoseconds a byte and no Python object per word is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from spotweave.blas import one_thread

one_thread()

#: Texts are handled in chunks of about this many bytes (one longer text makes
#: a chunk of its own), which bounds the memory of the NumPy work arrays.
CHUNK_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_MASK = (1 << 64) - 1


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = splitmix(np.arange(256, dtype=np.uint64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK_BYTES, 1 << (n - 1).bit_length()) if n else CHUNK_BYTES
    if size not in _POWERS:
        made = []
        for base in (_ODD, _INV):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > 8 * CHUNK_BYTES:
            return made[0], made[1]  # for one huge text only; not kept
        _POWERS[size] = (made[0], made[1])
    return _POWERS[size]


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()
#: Words are runs of anything but space and tab..carriage return.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of digits, lower-case letters (after lower-casing) and
#: non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class Words:
    """The words of a chunk of texts.

    ``start``/``end``: byte bounds in ``data``; ``hash``: 64-bit hash of the
    (lower-cased) word; ``first``: index of each text's first word, with the
    number of all words at the end.
    """

    __slots__ = ("data", "doc_at", "start", "end", "hash", "first")

    def __init__(self, data: np.ndarray, doc_at: np.ndarray, is_word: np.ndarray, lower: bool = True, hashes: bool = True):
        n = len(data)
        inside = is_word[data]
        edge = np.empty(n + 1, dtype=bool)
        edge[0] = n > 0
        if n:
            edge[n] = True
            np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
            cut = doc_at[(doc_at > 0) & (doc_at < n)]
            edge[cut] = True
        at = np.flatnonzero(edge)
        if len(at):
            seg_in = inside[at[:-1]] if len(at) > 1 else np.zeros(0, dtype=bool)
            self.start, self.end = at[:-1][seg_in], at[1:][seg_in]
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.data, self.doc_at = data, doc_at
        self.first = np.searchsorted(self.start, doc_at)
        self.hash = self.hash_spans(self.start, self.end, lower) if hashes else None

    def hash_spans(self, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
        """Hashes of the byte spans [start, end) of ``data``."""
        n = len(self.data)
        up, down = _powers(n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_BYTE[LOWER] if lower else _BYTE)[self.data] * up[:n], out=total[1:])
        return splitmix((total[end] - total[start]) * down[np.minimum(start, max(n - 1, 0))] + (end - start).astype(np.uint64))

    def ngrams(self, k: int) -> np.ndarray:
        return ngrams(self.hash, k)


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` items; entry i covers h[i:i+k]. Runs that
    cross texts are included, callers leave them out."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    m = len(h) - k + 1
    out = np.zeros(m, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD1342543DE82EF95) + h[j : j + m]
    return splitmix(out)


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte bound of each text and the end) for
    consecutive rows; null texts count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, body = texts.buffers()
    at = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def as_long(x: np.ndarray) -> np.ndarray:
    """uint64 hashes as Spark's BIGINT."""
    return x.view(np.int64)
