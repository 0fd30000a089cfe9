"""Hybrid (fused) product search queries."""

from __future__ import annotations

from shopflow.operators import hybrid as H
from shopflow.plans.registry import register
from shopflow.plans.sqlparts import FILTER_OK, PROD, REQ
from shopflow.sources import requests as RQ
from shopflow.sources import tables as TB

_TOK = r"list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) > 0)"


def _emb(name: str, src: str, key: str, text: str, dims: int = 64) -> str:
    """Hashed embedding CTEs ``{name}`` (key, v, nrm) of ``text`` over ``src`` (same rule as the Spark encoder)."""
    bucket = f"(('0x' || substr(md5(t), 31, 2))::INTEGER % {dims})"
    sign = "(CASE WHEN ('0x' || substr(md5(t), 1, 1))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END)"
    return f"""{name}_c AS (SELECT {key} AS k, list_transform(range(0, {dims}), lambda i: coalesce(list_sum(list_transform(
        {_TOK.format(t=text)}, lambda t: CASE WHEN {bucket} = i THEN {sign} ELSE 0.0 END)), 0.0)) AS c FROM {src}),
{name}_n AS (SELECT k, c, sqrt(coalesce(list_sum(list_transform(c, lambda x: x * x)), 0.0)) AS nrm FROM {name}_c),
{name} AS (SELECT k, CAST(list_transform(c, lambda x: CAST(CASE WHEN nrm > 0 THEN x / nrm ELSE 0.0 END AS FLOAT)) AS DOUBLE[]) AS v,
       nrm FROM {name}_n)"""


def _bm25_field(f: str) -> str:
    return f"""dt_{f} AS (SELECT id, {_TOK.format(t=f)} AS toks FROM prod),
dl_{f} AS (SELECT id, len(toks) AS dl FROM dt_{f}),
st_{f} AS (SELECT COUNT(*) AS n_docs, AVG(dl) AS avgdl FROM dl_{f}),
tf_{f} AS (SELECT id, term, COUNT(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM dt_{f}) GROUP BY ALL),
idf_{f} AS (SELECT term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf, avgdl
            FROM (SELECT term, COUNT(*) AS df FROM tf_{f} GROUP BY term), st_{f}),
sc_{f} AS (SELECT q.qn, t.id, SUM(q.qtf * i.idf * t.tf * 2.2 / (t.tf + 1.2 * (1 - 0.75 + 0.75 * d.dl / i.avgdl))) * 2.0 AS s
           FROM qt q JOIN idf_{f} i USING (term) JOIN tf_{f} t USING (term) JOIN dl_{f} d ON d.id = t.id GROUP BY ALL)"""


def _knn(name: str, pv: str, k: int, boost: float) -> str:
    return f"""{name} AS (SELECT qn, id, (1 + sim) / 2 * {boost} AS s FROM (
      SELECT q.k AS qn, p.k AS id, sim, ROW_NUMBER() OVER (PARTITION BY q.k ORDER BY sim DESC, p.k) AS r FROM (
        SELECT q.k, p.k, ROUND(CASE WHEN q.nrm > 0 AND p.nrm > 0 THEN list_cosine_similarity(q.v, p.v) ELSE 0.0 END, 9) AS sim
        FROM qv q, {pv} p) x(qk, pk, sim) JOIN qv q ON q.k = x.qk JOIN {pv} p ON p.k = x.pk) WHERE r <= {k})"""


_HYBRID = f"""{PROD}, {REQ},
keys AS (SELECT lower(query) AS qn, filter_key, any_value(f_color) AS f_color, any_value(f_onsale) AS f_onsale,
                any_value(f_brand) AS f_brand, any_value(f_pmin) AS f_pmin, any_value(f_pmax) AS f_pmax,
                MAX(off + lim) AS max_end FROM req GROUP BY ALL),
qs AS (SELECT DISTINCT qn FROM keys),
qt AS (SELECT qn, term, COUNT(*) AS qtf FROM (SELECT qn, unnest({_TOK.format(t='qn')}) AS term FROM qs) GROUP BY ALL),
{_bm25_field('title')}, {_bm25_field('description')}, {_bm25_field('brand')},
{_emb('qv', 'qs', 'qn', 'qn')}, {_emb('tv', 'prod', 'id', 'title')}, {_emb('dv', 'prod', 'id', 'description')},
{_knn('kt', 'tv', 100, 1.5)}, {_knn('kd', 'dv', 100, 1.0)},
fused AS (SELECT qn, id, ROUND(SUM(s), 9) AS score FROM (
    SELECT * FROM sc_title UNION ALL SELECT * FROM sc_description UNION ALL SELECT * FROM sc_brand
    UNION ALL SELECT * FROM kt UNION ALL SELECT * FROM kd) GROUP BY ALL),
m AS (SELECT k.qn, k.filter_key, f.id, f.score, p.title FROM fused f JOIN keys k ON k.qn = f.qn JOIN prod p ON p.id = f.id
      WHERE {FILTER_OK} AND (k.f_brand IS NULL OR p.brand = k.f_brand)),
tot AS (SELECT qn, filter_key, COUNT(*) AS total FROM m GROUP BY ALL),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qn, filter_key ORDER BY score DESC, id) AS r FROM m)"""


@register("hybrid_search", f"""
WITH {_HYBRID}
SELECT q.query_id, CAST(rk.r AS INTEGER) AS rank, rk.id, ROUND(rk.score, 6) AS score,
       CASE WHEN contains(lower(rk.title), rk.qn) THEN 'exact' WHEN rk.score > 1.5 THEN 'ngram' ELSE 'vector' END AS matchType,
       CAST(t.total AS BIGINT) AS total
FROM req q JOIN rk ON rk.qn = lower(q.query) AND rk.filter_key = q.filter_key
JOIN tot t ON t.qn = rk.qn AND t.filter_key = rk.filter_key WHERE rk.r > q.off AND rk.r <= q.off + q.lim""")
def hybrid_search(spark, sf_dir):
    return H.hybrid_search(RQ.search_requests(spark, sf_dir), TB.products(spark, sf_dir))
