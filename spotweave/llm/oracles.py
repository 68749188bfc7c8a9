"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from spotweave.llm.line_dedup import _BLOCK, _HOST, _NOISE, _TAG

LINES = """
one AS (SELECT host, doc, unnest(list_distinct(list_transform(string_split(t, chr(10)), lambda x: trim(translate(x, chr(9) || chr(13) || chr(12) || chr(11), '    '), ' ')))) AS line FROM src),
total AS (SELECT host, count(*) AS n FROM src GROUP BY host),
gone AS (SELECT o.host, o.line FROM (SELECT host, line, count(*) AS k FROM one WHERE line <> '' GROUP BY host, line) o JOIN total t ON o.host IS NOT DISTINCT FROM t.host WHERE k >= {min_pages} AND k > {ratio} * n),
gones AS (SELECT host, list(line) AS lines FROM gone GROUP BY host),
kept AS (SELECT s.*, CASE WHEN g.lines IS NULL THEN t ELSE array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT list_contains(g.lines, trim(translate(x, chr(9) || chr(13) || chr(12) || chr(11), '    '), ' '))), chr(10)) END AS kept
         FROM src s LEFT JOIN gones g ON s.host IS NOT DISTINCT FROM g.host)
"""


def _filled(x: str) -> str:
    return f"coalesce(len(list_filter(string_split({x}, chr(10)), lambda y: trim(translate(y, chr(9) || chr(13) || chr(12) || chr(11), '    '), ' ') <> '')), 0)"


OP1 = rf"""
WITH src AS MATERIALIZED (
  SELECT page_id AS doc, lower(regexp_extract(url, '{_HOST}', 1)) AS host,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{_NOISE}', chr(10), 'g'), '{_BLOCK}', chr(10), 'g'), '{_TAG}', '', 'g'), '[ \t\r]*\n[ \t\r\n]*', chr(10), 'g') AS t
  FROM pages),
{LINES.format(ratio="0.1::DOUBLE", min_pages=5)}
SELECT doc AS page_id, host, kept AS text, {_filled("t")}::BIGINT AS n_lines, ({_filled("t")} - {_filled("kept")})::BIGINT AS n_dropped FROM kept
"""

MIX = r"""
sized AS MATERIALIZED (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM docs),
per0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
per1 AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3)::INT + 1] AS w FROM per0),
per2 AS (SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM per1),
per3 AS (SELECT *, sum(cap) OVER o AS caps, sum(w) OVER o AS ws, sum(w) OVER () AS allw, row_number() OVER o AS pos
         FROM per2 WINDOW o AS (ORDER BY cap / w, source ROWS UNBOUNDED PRECEDING)),
lev AS (SELECT arg_min(level, pos) AS level FROM (SELECT pos, (total - (caps - cap)) / (allw - (ws - w)) AS level, cap / w AS full_at FROM per3) WHERE level <= full_at),
goal AS (SELECT source, source_size, coalesce(least(level * w, cap), cap) AS target,
         CASE WHEN source_size > 0 THEN floor(coalesce(least(level * w, cap), cap) / source_size) ELSE 0 END::BIGINT AS passes FROM per3, lev),
run AS (SELECT s.*, source_size, target, passes, target - passes * source_size AS rest,
        sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto, sum(size) OVER (PARTITION BY s.source, h)::BIGINT AS own
        FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
mixed AS (SELECT *, (size * (passes + CASE WHEN upto <= rest OR (upto - own <= rest AND own < 2 * (rest - (upto - own))) THEN 1 ELSE 0 END))::BIGINT AS taken FROM run)
"""

OP2 = f"WITH docs AS (SELECT doc_id, text, source FROM documents), {MIX} SELECT doc_id, size, source_size, target, taken FROM mixed"

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = rf"regexp_extract_all({_FOLD.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

HITS = f"""
iw AS MATERIALIZED (SELECT row_number() OVER () AS irow, item_id, {_BENCH_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS MATERIALIZED (
  SELECT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT *, least(len(w), 10) AS n FROM iw WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) AS r(s)),
lens AS (SELECT DISTINCT n FROM win),
dw AS MATERIALIZED (SELECT row_number() OVER () AS drow, *, coalesce({_BENCH_WORDS}, []) AS w FROM docs),
dwin AS (SELECT drow, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM dw, lens, unnest(range(1, len(w) - n + 2)) AS r(s) WHERE len(w) >= n),
hit AS MATERIALIZED (SELECT d.drow, d.s, d.n, x.item_id FROM dwin d JOIN win x ON d.win = x.win AND d.n = x.n),
words AS (SELECT drow, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT drow, s, n FROM hit), unnest(range(s, s + n)) AS r(p) GROUP BY drow),
named AS (SELECT drow, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id COLLATE "C") AS ids FROM (SELECT DISTINCT drow, item_id::VARCHAR AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY drow)
"""

OP4 = f"""
WITH docs AS (SELECT doc_id, text FROM documents), {HITS}
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (drow) LEFT JOIN named USING (drow)
"""

ORACLES = {"op1_line_dedup": OP1, "op2_mix_sources": OP2, "op4_decontaminate": OP4}


def jaccard(k: int, num: int, den: int, table: str = "docs") -> str:
    """CTEs ``comp(drow, component_id)`` over rows of ``table``(doc_id, text)."""
    words = rf"regexp_extract_all({_FOLD.format('text')}, '[^\x20\x09-\x0D]+')"
    return f"""
jw AS MATERIALIZED (SELECT row_number() OVER () AS drow, *, coalesce({words}, []) AS ww FROM {table}),
jset AS MATERIALIZED (SELECT drow, list_sort(list_distinct(list_transform(range(1, greatest(len(ww) - {k} + 1, least(len(ww), 1)) + 1), lambda s: array_to_string(ww[s:s + {k} - 1], ' ')))) AS sh FROM jw),
jclass AS MATERIALIZED (SELECT drow, len(sh) AS n, sh, dense_rank() OVER (ORDER BY sh) AS cls FROM jset),
jone AS MATERIALIZED (SELECT cls, any_value(sh) AS sh, any_value(n) AS n FROM jclass WHERE n > 0 GROUP BY cls),
jtok AS MATERIALIZED (SELECT cls, n, unnest(sh) AS t FROM jone),
jpair AS MATERIALIZED (SELECT a.cls AS a, b.cls AS b FROM jtok a JOIN jtok b ON a.t = b.t AND a.cls < b.cls AND {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n)
  GROUP BY a.cls, b.cls, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
jreach AS MATERIALIZED (WITH RECURSIVE r(x, y) AS (SELECT cls, cls FROM jone UNION SELECT r.x, p.y FROM r JOIN (SELECT a AS x, b AS y FROM jpair UNION ALL SELECT b, a FROM jpair) p ON r.y = p.x) SELECT x, y FROM r),
jleast AS MATERIALIZED (SELECT cls, min(doc_id) AS doc_id FROM jclass JOIN jw USING (drow) GROUP BY cls),
jcomp AS MATERIALIZED (SELECT x AS cls, min(doc_id) AS component_id FROM jreach JOIN jleast ON y = cls GROUP BY x),
comp AS MATERIALIZED (SELECT jw.*, c.n, CASE WHEN c.n = 0 THEN jw.doc_id ELSE component_id END AS component_id FROM jw JOIN jclass c USING (drow) LEFT JOIN jcomp USING (cls))
"""


OP3 = f"WITH docs AS (SELECT doc_id, text FROM documents), {jaccard(3, 90, 100)} SELECT doc_id, n::BIGINT AS n_shingles, component_id FROM comp"
ORACLES["op3_ngram_jaccard_join"] = OP3

OP8 = rf"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS drow, doc_id, coalesce(regexp_extract_all({_FOLD.format('text')}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS MATERIALIZED (SELECT drow, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM w, unnest(range(1, len(w) - 48)) AS r(s)),
rep AS (SELECT h FROM win GROUP BY h HAVING min(drow) <> max(drow)),
hit AS MATERIALIZED (SELECT DISTINCT drow, p FROM win JOIN rep USING (h), unnest(range(s - 1, s + 49)) AS r(p)),
runs AS (SELECT drow, min(p) AS s, max(p) + 1 AS e FROM (SELECT drow, p, p - row_number() OVER (PARTITION BY drow ORDER BY p) AS g FROM hit) GROUP BY drow, g),
per AS (SELECT drow, sum(e - s)::BIGINT AS n, string_agg(s || ',' || e, ',' ORDER BY s) AS spans FROM runs GROUP BY drow)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_repeated, coalesce(spans, '') AS spans, coalesce(n, 0) > 0 AS repeated FROM w LEFT JOIN per USING (drow)
"""
ORACLES["op8_suffix_array_dedup"] = OP8

OP10 = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.93::DOUBLE),
reach AS MATERIALIZED (WITH RECURSIVE w(a, b) AS (SELECT r, r FROM v UNION SELECT w.a, l.b FROM w JOIN link l ON l.a = w.b) SELECT a, b FROM w),
comp AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
deg AS (SELECT a AS r, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp USING (r) LEFT JOIN deg USING (r)
"""
ORACLES["op10_embedding_dedup"] = OP10
