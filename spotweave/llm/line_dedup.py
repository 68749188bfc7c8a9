"""Line dedup by site-relative frequency.

For each host, the share of its pages that contain a line tells boilerplate
(menus, banners, notices) from content. Lines above the ratio are dropped from
every page of that host. Only DataFrame operations are used.

Lines are compared without surrounding white space; blank lines are neither
counted nor dropped. A line counts once a page. Null is a host of its own. A
null text stays null. A page that loses all lines keeps an empty text. Rows that repeat
are pages of their own. A line on exactly ``ratio`` of the pages stays. Further
columns pass through, whatever their names; result columns replace columns of the
same name.

The set of lines dropped on a host is bounded: no more than (mean number of
distinct lines a page) / ratio lines can each be on more than that ratio of the
pages. So it can travel as one array a host, and pages are never regrouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.llm.store import fresh, write_table

#: Up to so many hosts with boilerplate and so many dropped lines in all, the
#: arrays are broadcast (under 16 MB); beyond, the join shuffles by host.
BROADCAST_LINES = 1_000_000

_NOISE = r"(?is)<!--.*?-->|<(script|style|head|template|noscript)\b[^>]*>.*?</(script|style|head|template|noscript)\s*>"
_BLOCK = r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>"
_TAG = r"<[/!?a-zA-Z][^>]*>"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def html_text(html: Column) -> Column:
    """Text of a page: comments, scripts, styles and head go, block tags become
    line ends, other tags go, blank lines go."""
    out = F.regexp_replace(html, _NOISE, "\n")
    out = F.regexp_replace(F.regexp_replace(out, _BLOCK, "\n"), _TAG, "")
    return F.regexp_replace(out, r"[ \t\r]*\n[ \t\r\n]*", "\n")


def url_host(url: Column) -> Column:
    """Lower-case host of a URL without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, _HOST, 1))


def _bare(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\f\x0b", "    "))


def boilerplate(pages: DataFrame, host: str, hashes: str, ratio: float, min_pages: int) -> DataFrame:
    """(``__host``, ``__drop``): hashes of each host's boilerplate lines."""
    one = pages.select(F.col(host).alias("__host"), F.explode(F.array_distinct(hashes)).alias("__line"))
    on = one.groupBy("__host", "__line").agg(F.count(F.lit(1)).alias("__on"))
    total = pages.groupBy(F.col(host).alias("__h")).agg(F.count(F.lit(1)).alias("__pages"))
    often = on.where(F.col("__on") >= min_pages).join(total, F.col("__host").eqNullSafe(F.col("__h")))
    often = often.where((F.col("__on") > F.lit(ratio) * F.col("__pages")) & (F.col("__line") != F.xxhash64(F.lit(""))))
    return often.groupBy("__host").agg(F.collect_set("__line").alias("__drop"))


def line_dedup(pages: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = 0.1, min_pages: int = 5, counts: bool = True) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text_col``.

    A line is boilerplate on a host if more than ``ratio`` of the host's pages
    and at least ``min_pages`` pages contain it. With ``counts``, columns
    n_lines (non-blank lines) and n_dropped are added.
    """
    made = ("n_lines", "n_dropped") if counts else ()
    out = [c for c in pages.columns if c not in made]
    lines = F.split(F.col(text_col), "\n", -1)
    own, site, gone_lines = fresh(pages, "hash", "host", "drop")
    # Lines are split and hashed once; the passes below read the hashes.
    base = write_table(pages.select(*out, F.transform(lines, lambda x: F.xxhash64(_bare(x))).alias(own)), "line-hashes")
    drop = write_table(boilerplate(base, host_col, own, ratio, min_pages).toDF(site, gone_lines), "line-drop")
    size = drop.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size(gone_lines)), F.lit(0))).first()[0]
    both = base.join(F.broadcast(drop) if size <= BROADCAST_LINES else drop, F.col(host_col).eqNullSafe(F.col(site)), "left")
    hit = F.coalesce(F.arrays_overlap(own, gone_lines), F.lit(False))
    stays = F.filter(lines, lambda x, i: ~F.array_contains(F.col(gone_lines), F.col(own)[i]))
    text = F.when(hit, F.array_join(stays, "\n")).otherwise(F.col(text_col))
    cols = [text.alias(c) if c == text_col else F.col(c) for c in out]
    if counts:
        filled = F.coalesce(F.size(F.array_remove(own, F.xxhash64(F.lit("")))), F.lit(0))
        gone = F.when(hit, F.size(F.filter(own, lambda h: F.array_contains(F.col(gone_lines), h)))).otherwise(0)
        cols += [F.when(F.col(text_col).isNull(), 0).otherwise(filled).cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped")]
    return both.select(*cols)
