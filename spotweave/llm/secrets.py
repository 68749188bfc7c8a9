"""Secret scans: multipart credential linking.

Strong ("base") parts are found by pattern alone. Weak parts (login names,
long random-looking strings, service endpoints) are far too common to report
by themselves; they are reported only when complementary parts co-occur: an
interval join pairs all identifiers, secrets and endpoints whose neighbourhoods
overlap inside one scope (a block of lines without a blank line between). The
neighbourhood is the whole scope unless ``reach`` bounds it.

All offsets are code points, ends exclusive. A null or empty text has no spans.
Rows are independent of each other: repeated rows repeat their results, and
other columns of the input are passed through unless they share a name with a
result column, which replaces them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm.store import fresh

ASSIGN = re.compile(r"""(?:(?ia:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Maximal runs of hexadecimal digits; shorter runs fail the length test anyway.
HEX = re.compile(r"[0-9a-f]{24,}")
WEAK_ID = re.compile(r"""(?ia:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_-])")
ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{3,}")
BLANK = re.compile(r"\n[ \t\r]*\n")

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
_RANK = {k: i for i, k in enumerate(KINDS)}


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Strong parts by pattern, leftmost and non-overlapping for each kind."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], _RANK[s[0]], s[2]))


def linked_spans(text: str, base: list[tuple[str, int, int]], reach: int | None, min_entropy: float) -> tuple[list[tuple[str, int, int]], list[tuple]]:
    """Weak parts that complement others, and the links between parts.

    A part's interval is its scope, or its span widened by ``reach`` on both sides
    and cut to its scope; two parts join when the interval of one meets the other.
    Identifiers don't overlap each other, nor do endpoints, so those that join a
    secret stand in a row; secrets with the same ones share a link.
    """
    ids = [s for s in base if s[0] == "access"]
    keys = [s for s in base if s[0] != "access"]
    ends = [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    weak_ids = [("weak_id", *m.span(1)) for m in WEAK_ID.finditer(text)] if ("=" in text or ":" in text) else []
    if not (ids or weak_ids or ends):
        return [], []
    taken = sorted((s, e) for _, s, e in base + ends)
    starts = [s for s, _ in taken]

    def free(s: int, e: int) -> bool:
        i = bisect_right(starts, s)
        return not (i and taken[i - 1][1] > s) and not (i < len(taken) and taken[i][0] < e)

    weak_ids = [x for x in weak_ids if free(x[1], x[2])]
    weak_keys = [
        ("weak_secret", *m.span())
        for m in WEAK_SECRET.finditer(text)
        if free(*m.span()) and re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and entropy(m[0]) >= min_entropy
    ]
    cuts = [0, *(m.end() for m in BLANK.finditer(text)), len(text) + 1]
    ids, keys = _order(ids + weak_ids), _order(keys + weak_keys)
    ends = _order(ends)
    strong = [0, *accumulate(x[0] == "access" for x in ids)]

    def joined(to: tuple[str, int, int], starts: list[int], stops: list[int]) -> tuple[int, int]:
        """Bounds of the parts of the same scope whose interval meets that of ``to``."""
        k = bisect_right(cuts, to[1])
        i, j = bisect_left(starts, cuts[k - 1]), bisect_left(starts, cuts[k])
        if reach is not None:
            i, j = max(i, bisect_left(stops, to[1] - reach)), min(j, bisect_right(starts, to[2] + reach))
        return i, max(i, j)

    at = [([x[1] for x in among], [x[2] for x in among]) for among in (ids, ends)]
    groups: dict[tuple[int, int, int, int], list[tuple[str, int, int]]] = {}
    for key in keys:
        (i, j), (m, n) = (joined(key, *x) for x in at)
        # A weak secret needs a strong identifier, or an identifier and an endpoint.
        if (i < j or m < n) if key[0] != "weak_secret" else (strong[i] < strong[j] or (i < j and m < n)):
            groups.setdefault((i, j, m, n), []).append(key)
    links = [(*ids[i:j], *held, *ends[m:n]) for (i, j, m, n), held in groups.items()]
    return list({x for link in links for x in link} - set(base)), links


def scan(text: str | None, reach: int | None = None, min_entropy: float = 3.5) -> dict:
    """All spans of one text; see :func:`scan_secrets` for the fields."""
    text = text or ""
    base = _order(base_spans(text))
    extra, links = linked_spans(text, base, reach, min_entropy)
    show = lambda xs: ",".join(f"{k}:{s}:{e}" for k, s, e in xs)
    kinds = Counter(k for k, _, _ in base)
    return {
        "n_assign": kinds["assign"],
        "n_access": kinds["access"],
        "n_hex": kinds["hex"],
        "base": show(base),
        "spans": show(_order(base + extra)),
        "links": ";".join("+".join(f"{k}:{s}:{e}" for k, s, e in link) for link in links),
    }


_FIELDS = [("n_assign", "long", pa.int64()), ("n_access", "long", pa.int64()), ("n_hex", "long", pa.int64()), ("base", "string", pa.string()), ("spans", "string", pa.string()), ("links", "string", pa.string())]


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, reach: int | None = None, min_entropy: float = 3.5) -> DataFrame:
    """Spans of every whole text: counts by kind, ``base`` and ``spans`` as
    ``kind:start:end`` lists by start, and ``links`` between parts: identifiers,
    secrets and endpoints that join, one list for secrets that join the same ones.

    ``keep``: columns to pass through (all but the text by default).
    """
    names = {n for n, *_ in _FIELDS}
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in names and c != text_col]
    [own] = fresh(docs, "text")
    src = docs.select(*keep, F.col(text_col).alias(own))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != own), *(f"{n} {t}" for n, t, _ in _FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(own))
            for at in range(0, len(texts), 512):
                found = [scan(t.as_py(), reach, min_entropy) for t in texts.slice(at, 512)]
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in keep), *(pa.array([x[n] for x in found], type=t) for n, _, t in _FIELDS)],
                    names=[*keep, *(n for n, *_ in _FIELDS)],
                )

    return src.mapInArrow(run, schema)
