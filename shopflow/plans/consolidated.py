"""Consolidated search in full (R4, R5, T3, V2, V3, P20) over requests about every product and benchmark text."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopflow.operators import consolidated as C
from shopflow.plans.hybrid import _emb
from shopflow.plans.registry import register
from shopflow.plans.sqlparts import PROD
from shopflow.sources import requests as RQ
from shopflow.sources import tables as TB

_TOK = r"list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) > 0)"

TREQ = """treq AS (SELECT * FROM (SELECT p_partkey AS query_id, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_type
        WHEN 2 THEN substr(split_part(p_name, ' ', 2), 1, 1) || substr(split_part(p_name, ' ', 2), 3) WHEN 3 THEN p_brand
        WHEN 4 THEN substr(p_name, 1, 4) ELSE substr(p_name, 1, 2) END AS query, (p_partkey // 6) % 2 = 0 AS include_vector FROM part
    UNION ALL SELECT -1 - item_id, text, item_id % 2 = 0 FROM benchmark) WHERE query IS NOT NULL),
asked AS (SELECT DISTINCT query, include_vector FROM treq),
texts AS (SELECT DISTINCT query FROM asked),
qt AS (SELECT query, term, COUNT(*) AS qtf FROM (SELECT query, unnest(""" + _TOK.format(t="query") + """) AS term FROM texts) GROUP BY ALL),
gated AS (SELECT DISTINCT query FROM asked WHERE include_vector AND contains(query, ' '))"""


def _field(f: str) -> str:
    return f"""dt_{f} AS (SELECT id, {_TOK.format(t=f)} AS toks FROM prod),
dl_{f} AS (SELECT id, len(toks) AS dl FROM dt_{f}),
tf_{f} AS (SELECT id, term, COUNT(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM dt_{f}) GROUP BY ALL),
im_{f} AS (SELECT t.id, t.term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (1 - 0.75 + 0.75 * d.dl / avgdl)) AS imp
           FROM tf_{f} t JOIN dl_{f} d USING (id) JOIN (SELECT term, COUNT(*) AS df FROM tf_{f} GROUP BY term) USING (term),
                (SELECT COUNT(*) AS n_docs, AVG(dl) AS avgdl FROM dl_{f}))"""


# DuckDB counts edits in bytes: other than ASCII characters, which no title has, count as one
_NEAR = r"""gr AS (SELECT word, substr(word, 1, l) AS gram FROM (SELECT DISTINCT term AS word FROM tf_title), range(1, 65536) r(l)
       WHERE l <= length(word) AND (l >= 3 OR l = length(word))),
near AS (SELECT t, word, MAX(CASE WHEN gram = t THEN 1.0::DOUBLE ELSE 1 - 1.0::DOUBLE / least(length(t), length(gram)) END
                             * length(gram) / length(word)) AS likeness
         FROM (SELECT DISTINCT term AS t FROM qt) JOIN gr ON levenshtein(regexp_replace(t, '[^\x00-\x7F]', '?', 'g'), gram) <= 1 GROUP BY ALL),
fz AS (SELECT q.query, i.id, SUM(q.qtf * n.likeness * i.imp) AS s FROM qt q JOIN near n ON n.t = q.term AND n.likeness > 0
       JOIN im_title i ON i.term = n.word GROUP BY ALL)"""

_SIM = """{name} AS (SELECT q.k AS query, p.k AS id, ROUND(CASE WHEN q.nrm > 0 AND p.nrm > 0 THEN list_cosine_similarity(q.v, p.v) ELSE 0.0 END, 9) AS sim
         FROM qv q, {pv} p)"""


@register("fuzzy_relevance", f"""WITH {PROD}, {TREQ}, {_field('title')}, {_NEAR},
rk AS (SELECT query, id, ROUND(s, 9) AS score, ROW_NUMBER() OVER (PARTITION BY query ORDER BY ROUND(s, 9) DESC, id) AS r FROM fz WHERE ROUND(s, 9) > 0)
SELECT query, CAST(r AS INTEGER) AS rank, id, ROUND(score, 6) AS score FROM rk WHERE r <= 10""")
def fuzzy_relevance(spark, sf_dir):
    r = C.fuzzy_relevance(RQ.text_requests(spark, sf_dir), TB.products(spark, sf_dir))
    return r.select("query", F.col("rank").cast("int").alias("rank"), "id", F.round("score", 6).alias("score"))


_CLOSE = f"""{_emb('qv', 'gated', 'query', 'query')}, {_emb('tv', 'prod', 'id', 'title')}, {_SIM.format(name='ts', pv='tv')},
nn AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY sim DESC, id) AS r FROM ts) WHERE r <= 50)"""


@register("vector_clause", f"""WITH {PROD}, {TREQ}, {_CLOSE}
SELECT query, CAST(r AS INTEGER) AS rank, id, ROUND((1 + sim) / 2, 6) AS score FROM nn""")
def vector_clause(spark, sf_dir):
    r = C.title_neighbours(RQ.text_requests(spark, sf_dir), TB.products(spark, sf_dir))
    return r.select("query", F.col("rank").cast("int").alias("rank"), "id", F.round((1 + F.col("sim")) / 2, 6).alias("score"))


_FUSED = f"""{_field('title')}, {_field('description')}, {_field('brand')}, {_NEAR}, {_CLOSE},
ac AS (SELECT query, id, COUNT(*) * 2.0::DOUBLE AS s FROM (SELECT DISTINCT q.query, t.id, q.term FROM qt q JOIN tf_title t
       ON length(q.term) >= 2 AND starts_with(t.term, q.term)) GROUP BY ALL),
tx AS (SELECT query, id, ROUND(SUM(s), 9) AS s FROM (
    SELECT q.query, i.id, q.qtf * i.imp * 5.0 AS s FROM qt q JOIN im_title i USING (term)
    UNION ALL SELECT q.query, i.id, q.qtf * i.imp * 5.0 FROM qt q JOIN im_description i USING (term)
    UNION ALL SELECT q.query, i.id, q.qtf * i.imp * 5.0 FROM qt q JOIN im_brand i USING (term)
    UNION ALL SELECT query, id, s * 3.0 FROM fz UNION ALL SELECT * FROM ac) GROUP BY ALL),
fu AS (SELECT a.query, a.include_vector, id, s AS score FROM asked a JOIN tx USING (query)
         WHERE NOT (a.include_vector AND EXISTS (SELECT 1 FROM nn WHERE nn.query = a.query AND nn.id = tx.id))
       UNION ALL SELECT nn.query, true, nn.id, ROUND(coalesce(tx.s, 0.0) + (1 + sim) / 2, 9) FROM nn LEFT JOIN tx ON tx.query = nn.query AND tx.id = nn.id),
fr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query, include_vector ORDER BY score DESC, id) AS r FROM fu WHERE length(query) >= 3 AND score > 0),
dim AS (SELECT cat_id, cat_name, cat_slug, COUNT(*) AS n FROM prod GROUP BY ALL),
cr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY n DESC, cat_id) AS r FROM (SELECT q.query, d.cat_id, MIN(d.cat_name) AS name, SUM(d.n) AS n
       FROM texts q JOIN dim d ON contains(lower(d.cat_name), lower(q.query)) OR contains(lower(d.cat_slug), lower(q.query)) WHERE length(query) >= 3 GROUP BY ALL)),
br AS (SELECT q.query, b.brand, b.n, ROW_NUMBER() OVER (PARTITION BY q.query ORDER BY b.n DESC, b.brand) AS r
       FROM texts q JOIN (SELECT brand, COUNT(*) AS n FROM prod GROUP BY brand) b ON contains(lower(b.brand), lower(q.query)) WHERE length(query) >= 3),
rws AS (SELECT a.query, a.include_vector, 'category' AS kind, r AS rank, cat_id AS id, name, CAST(n AS BIGINT) AS product_count, NULL::DOUBLE AS score, NULL AS matchType
        FROM cr JOIN asked a USING (query) WHERE r <= 5
    UNION ALL SELECT a.query, a.include_vector, 'brand', r, brand, brand, n, NULL, NULL FROM br JOIN asked a USING (query) WHERE r <= 5
    UNION ALL SELECT f.query, f.include_vector, 'product', r, CAST(f.id AS VARCHAR), p.title, NULL, score,
        CASE WHEN contains(lower(p.title), lower(f.query)) THEN 'exact' WHEN score > 1.5 THEN 'ngram' ELSE 'vector' END
        FROM fr f JOIN prod p ON p.id = f.id WHERE r <= 10)"""


@register("consolidated_rows", f"""WITH {PROD}, {TREQ}, {_FUSED}
SELECT query, include_vector, kind, CAST(rank AS INTEGER) AS rank, id, name, product_count, ROUND(score, 6) AS score, matchType,
       COUNT(*) OVER (PARTITION BY query, include_vector) AS total_results FROM rws
UNION ALL SELECT query, include_vector, 'rejected', 1, NULL, 'fewer than 3 characters', NULL, NULL, NULL, 0 FROM asked WHERE length(query) < 3""")
def consolidated_rows(spark, sf_dir):
    r = C.consolidated_rows(RQ.text_requests(spark, sf_dir), TB.products(spark, sf_dir))
    return r.withColumn("score", F.round("score", 6))


_STRATEGIES = f"""{_emb('qv', 'gated', 'query', 'query')}, {_emb('tv', 'prod', 'id', 'title')}, {_emb('dv', 'prod', 'id', 'description')},
{_SIM.format(name='ts', pv='tv')}, {_SIM.format(name='ds', pv='dv')},
cand AS (SELECT q.query, p.id, regexp_matches(p.title || chr(1) || p.description, '(?i)\\b' || regexp_escape(q.query) || '\\b') AS is_exact
         FROM texts q JOIN prod p ON contains(lower(p.title || chr(1) || p.description), lower(q.query))),
ex AS (SELECT * FROM (SELECT query, id, ROW_NUMBER() OVER (PARTITION BY query ORDER BY id) AS sr FROM cand WHERE is_exact) WHERE sr <= 10),
sb AS (SELECT * FROM (SELECT query, id, ROW_NUMBER() OVER (PARTITION BY query ORDER BY id) AS sr FROM cand WHERE length(query) >= 3) WHERE sr <= 20),
early AS (SELECT query, id, 1.0::DOUBLE AS score, 'exact' AS matchType, 0 AS src, sr FROM ex
          UNION ALL SELECT query, id, 0.8::DOUBLE, 'ngram', 1, sr FROM sb ANTI JOIN ex USING (query, id)),
vm AS (SELECT query, id, MAX(sim) AS score FROM (SELECT * FROM ts WHERE sim > 0.5 UNION ALL SELECT * FROM ds WHERE sim > 0.5) ANTI JOIN early USING (query, id)
       GROUP BY ALL)"""


@register("vector_matches", f"""WITH {PROD}, {TREQ}, {_STRATEGIES}
SELECT query, id, ROUND(score, 6) AS score FROM vm""")
def vector_matches(spark, sf_dir):
    from shopflow.operators import search as S
    req, products = RQ.text_requests(spark, sf_dir), TB.products(spark, sf_dir)
    earlier = S.consolidated_candidates(req.withColumn("max_products", F.lit(10)), products)
    return C.vector_matches(req, products, earlier).select("query", "id", F.round("score", 6).alias("score"))


@register("consolidated_strategies", f"""WITH {PROD}, {TREQ}, {_STRATEGIES},
mg AS (SELECT * FROM early UNION ALL SELECT query, id, score, 'vector', 2, 0 FROM vm),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, src, sr, id) AS r FROM mg)
SELECT rk.query, CAST(r AS INTEGER) AS rank, rk.id, p.title, ROUND(score, 6) AS score, matchType FROM rk JOIN prod p ON p.id = rk.id WHERE r <= 10""")
def consolidated_strategies(spark, sf_dir):
    return C.three_strategies(RQ.text_requests(spark, sf_dir), TB.products(spark, sf_dir))
