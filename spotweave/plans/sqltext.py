"""Pieces of DuckDB SQL that restate the operators, for checks side by side."""

from __future__ import annotations

VIEW = """
sp AS MATERIALIZED (SELECT s_suppkey AS spot_id, (s_suppkey // 10)::INT AS r, (s_suppkey % 10)::INT AS q, s_acctbal, r_name AS region
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
isoo AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY iso_id) AS ord FROM (SELECT DISTINCT p_brand || '/' || p_type AS iso_id, p_brand AS gene_id FROM part)),
ct AS MATERIALIZED (SELECT l_suppkey AS spot_id, p_brand || '/' || p_type AS iso_id, p_brand AS gene_id, count(*)::DOUBLE AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
nn AS (SELECT count(*)::DOUBLE AS n FROM sp),
dims AS (SELECT ((count(*) + 9) // 10)::INT AS hh, 10 AS ww FROM sp)
"""

DESIGN = """
des AS MATERIALIZED (SELECT spot_id, 's_acctbal' AS factor, s_acctbal AS z FROM sp UNION ALL SELECT spot_id, 'high', CASE WHEN s_acctbal > 5000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM sp
  UNION ALL SELECT spot_id, 'region_' || region, 1.0::DOUBLE FROM sp)
"""

BASE = """
cov AS (SELECT gene_id, spot_id, sum(n) AS total FROM ct GROUP BY ALL),
base AS MATERIALIZED (SELECT c.gene_id, c.spot_id, i.iso_id, i.ord, coalesce(t.n, 0) AS n, total FROM cov c JOIN isoo i USING (gene_id) LEFT JOIN ct t ON t.spot_id = c.spot_id AND t.iso_id = i.iso_id)
"""

_LOG = """
mean AS (SELECT iso_id, sum(ct.n) / any_value(nn.n) AS m FROM ct, nn GROUP BY 1),
mix AS (SELECT b.*, 0.99::DOUBLE * n + 0.01::DOUBLE * coalesce(m, 0) AS v FROM base b LEFT JOIN mean USING (iso_id)),
lg AS MATERIALIZED (SELECT *, ln(v / sum(v) OVER (PARTITION BY gene_id, spot_id)) AS l FROM mix WHERE v > 0),
"""

RATIOS = {
    "none": "rat AS MATERIALIZED (SELECT gene_id, spot_id, iso_id, ord, n / total AS r FROM base)",
    "radial": "rat AS MATERIALIZED (SELECT gene_id, spot_id, iso_id, ord, n / total / sqrt(sum((n / total) * (n / total)) OVER (PARTITION BY gene_id, spot_id)) AS r FROM base)",
    "clr": _LOG + "rat AS MATERIALIZED (SELECT gene_id, spot_id, iso_id, ord, l - avg(l) OVER (PARTITION BY gene_id, spot_id) AS r FROM lg)",
    "alr": _LOG + "rat AS MATERIALIZED (SELECT gene_id, spot_id, iso_id, ord, r FROM (SELECT *, l - first_value(l) OVER w AS r, row_number() OVER w AS k FROM lg WINDOW w AS (PARTITION BY gene_id, spot_id ORDER BY ord)) WHERE k > 1)",
    "ilr": _LOG + "rat AS MATERIALIZED (SELECT gene_id, spot_id, iso_id, ord, sqrt((k - 1) / k::DOUBLE) * (m0 - l) AS r FROM (SELECT *, avg(l) OVER (PARTITION BY gene_id, spot_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m0, row_number() OVER (PARTITION BY gene_id, spot_id ORDER BY ord) AS k FROM lg) WHERE k > 1)",
}

FILLED = """
fill AS MATERIALIZED (SELECT m.gene_id, sp.spot_id, m.iso_id, m.ord, coalesce(rat.r, m.m) AS r FROM sp CROSS JOIN (SELECT gene_id, iso_id, ord, avg(r) AS m FROM rat GROUP BY ALL) m LEFT JOIN rat ON rat.spot_id = sp.spot_id AND rat.iso_id = m.iso_id)
"""


def values(kind: str, transform: str = "none") -> str:
    """CTEs up to v(gene_id, ch, spot_id, y)."""
    if kind == "gc":
        return "v AS MATERIALIZED (SELECT gene_id, gene_id AS ch, spot_id, sum(n) AS y FROM ct GROUP BY ALL)"
    if kind == "ic":
        return "v AS MATERIALIZED (SELECT gene_id, iso_id AS ch, spot_id, n AS y FROM ct)"
    return f"{BASE}, {RATIOS[transform]}, v AS MATERIALIZED (SELECT gene_id, iso_id AS ch, spot_id, r - avg(r) OVER (PARTITION BY gene_id, iso_id) AS y FROM rat)"


GRAM = """
m AS (SELECT gene_id, ch, sum(y) / any_value(n) AS m FROM v, nn GROUP BY gene_id, ch),
g AS MATERIALIZED (SELECT a.gene_id, a.ch AS a, b.ch AS b, coalesce(s, 0) - n * a.m * b.m AS g FROM m a JOIN m b USING (gene_id) CROSS JOIN nn
  LEFT JOIN (SELECT x.gene_id, x.ch AS a, y.ch AS b, sum(x.y * y.y) AS s FROM v x JOIN v y ON x.gene_id = y.gene_id AND x.spot_id = y.spot_id GROUP BY ALL) p ON p.gene_id = a.gene_id AND p.a = a.ch AND p.b = b.ch),
g2 AS (SELECT x.gene_id, x.a, y.b, sum(x.g * y.g) AS g2 FROM g x JOIN g y ON x.gene_id = y.gene_id AND x.b = y.a GROUP BY ALL),
f AS MATERIALIZED (SELECT gene_id, sum(CASE WHEN a = b THEN g ELSE 0 END) AS f1, sum(g * g) AS f2, sum(g * g2) AS f3, sum(g2 * g2) AS f4 FROM g JOIN g2 USING (gene_id, a, b) GROUP BY 1)
"""

TORUS = """
cell AS (SELECT h, w, least(h, hh - h) ** 2 + least(w, ww - w) ** 2 AS d2 FROM dims, unnest(range(hh)) t(h), unnest(range(ww)) u(w)),
cut AS (SELECT d2 FROM (SELECT DISTINCT d2 FROM cell) ORDER BY d2 LIMIT 1 OFFSET 1),
ring AS (SELECT h, w FROM cell, cut WHERE cell.d2 <= cut.d2 AND NOT (h = 0 AND w = 0)),
lam AS MATERIALIZED (SELECT c.h, c.w, CASE WHEN c.h = 0 AND c.w = 0 THEN 0 ELSE 1 / (1 - 0.99::DOUBLE * avg(cos(2 * pi() * (c.h * r.h / hh::DOUBLE + c.w * r.w / ww::DOUBLE)))) END AS l FROM cell c, ring r, dims GROUP BY c.h, c.w),
k AS (SELECT sum(l) AS k1, sum(l ** 2) AS k2, sum(l ** 3) AS k3, sum(l ** 4) AS k4 FROM lam)
"""

FORM = """
four AS (SELECT gene_id, ch, h, w, l, sum(y * cos(2 * pi() * (h * r / hh::DOUBLE + w * q / ww::DOUBLE))) AS re, sum(y * sin(2 * pi() * (h * r / hh::DOUBLE + w * q / ww::DOUBLE))) AS im FROM v JOIN sp USING (spot_id), lam, dims GROUP BY ALL),
hs AS (SELECT gene_id, sum(l * (re * re + im * im)) / any_value(n) AS hs FROM four, nn GROUP BY gene_id)
"""


def gamma_q(a: str, x: str, terms: int = 1500) -> str:
    """Upper regularised incomplete gamma function by its series."""
    return f"(CASE WHEN {x} <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 1 - list_sum(list_transform(range(0, {terms}), lambda g_: exp(({a}) * ln({x}) - ({x}) + g_ * ln({x}) - lgamma(({a}) + g_ + 1)))))) END)"


def liu(q: str, c: str = "c{}") -> str:
    """A query that adds p to rows with q and c1..c4 (Liu's tail); ``q`` is the source table."""
    c1, c2, c3, c4 = (c.format(i) for i in (1, 2, 3, 4))
    return f"""
SELECT *, CASE WHEN {c2} <= 1e-10 THEN (CASE WHEN q > {c1} + 1e-10 THEN 0.0 ELSE 1.0 END)
  WHEN half <= 1e-9 THEN {gamma_q("df / 2", "x / 2")}
  ELSE least(1.0, list_sum(list_transform(range(0, ceil(half + 12 * sqrt(half) + 30)::INT + 1), lambda j_: exp(-half + j_ * ln(half) - lgamma(j_ + 1)) * {gamma_q("df / 2 + j_", "x / 2")}))) END AS p
FROM (SELECT *, (q - {c1}) / sqrt(2 * {c2}) * sqrt(2 * (df + 4 * half)) + df + 2 * half AS x
 FROM (SELECT *, CASE WHEN s1 * s1 > s2 THEN a * a - 4 * half ELSE a * a END AS df
  FROM (SELECT *, CASE WHEN s1 * s1 > s2 THEN greatest(s1 * a ** 3 - a * a, 0) / 2 ELSE 0 END AS half
   FROM (SELECT *, CASE WHEN s1 * s1 > s2 THEN 1 / (s1 - sqrt(greatest(s1 * s1 - s2, 0))) ELSE 1 / s1 END AS a
    FROM (SELECT *, {c3} / {c2} ** 1.5 AS s1, {c4} / ({c2} * {c2}) AS s2 FROM {q})))))
"""


def beta_i(a: str, b: str, x: str, terms: int = 2500) -> str:
    """Regularised incomplete beta function by its series on the nearer side."""

    def side(a: str, b: str, x: str) -> str:
        front = f"exp(({a}) * ln({x}) + ({b}) * ln(1 - ({x})) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma(({a}) + ({b})))"
        return f"({front} * (1 + list_sum(list_transform(range(0, {terms}), lambda b_: exp(lgamma(({a}) + 1) + lgamma(({a}) + ({b}) + b_ + 1) - lgamma(({a}) + b_ + 2) - lgamma(({a}) + ({b})) + (b_ + 1) * ln({x}))))))"

    return f"(CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 WHEN {x} < (({a}) + 1) / (({a}) + ({b}) + 2) THEN {side(a, b, x)} ELSE 1 - {side(b, a, f'(1 - {x})')} END)"


def adjusted(source: str, by: str = "", tie: str = "gene_id", factor: str = "1.0") -> str:
    """``source`` with pvalue_adj by Benjamini-Hochberg (times ``factor``)."""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
SELECT * EXCLUDE (i_, m_, q_), CASE WHEN m_ <= 1 THEN pvalue ELSE least(1.0, min(q_) OVER ({part} ORDER BY i_ DESC ROWS UNBOUNDED PRECEDING)) END AS pvalue_adj
FROM (SELECT *, pvalue * m_ / i_ * {factor} AS q_ FROM (SELECT *, row_number() OVER ({part} ORDER BY pvalue, {tie}) AS i_, count(*) OVER ({part}) AS m_ FROM {source}))
"""
