"""Search queries (T3-T8, P4-P11, A1-A4, A29-A31, R4-R5) over requests derived from events x part."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopflow.operators import search as S
from shopflow.plans.registry import register
from shopflow.plans.sqlparts import MATCHED, PROD, REQ, SUGGEST
from shopflow.sources import requests as RQ
from shopflow.sources import tables as TB


@register("substring_search_page", f"""
WITH {PROD}, {REQ}, {MATCHED},
rk AS (SELECT qn, filter_key, id, ROW_NUMBER() OVER (PARTITION BY qn, filter_key ORDER BY id) AS r FROM m)
SELECT r.query_id, CAST(rk.r AS INTEGER) AS rank, rk.id, p.title, t.total
FROM req r JOIN rk ON lower(r.query) = rk.qn AND r.filter_key = rk.filter_key
JOIN tot t ON t.qn = rk.qn AND t.filter_key = rk.filter_key JOIN prod p ON p.id = rk.id
WHERE rk.r > r.off AND rk.r <= r.off + r.lim""")
def substring_search_page(spark, sf_dir):
    return S.search_page(RQ.search_requests(spark, sf_dir), TB.products(spark, sf_dir))


@register("search_total_count", f"""
WITH {PROD}, {REQ}, {MATCHED}
SELECT r.query_id, CAST(coalesce(t.total, 0) AS BIGINT) AS total
FROM req r LEFT JOIN tot t ON lower(r.query) = t.qn AND r.filter_key = t.filter_key""")
def search_total_count(spark, sf_dir):
    return S.search_totals(RQ.search_requests(spark, sf_dir), TB.products(spark, sf_dir))


def _facet_sql(src: str, group: str) -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group}, field" if group else "PARTITION BY field"
    return f"""fv AS (SELECT {g}'brand' AS field, brand AS value FROM {src}
      UNION ALL SELECT {g}'color', color FROM {src}
      UNION ALL SELECT {g}'productType', productType FROM {src}
      UNION ALL SELECT {g}'isOnSale', CAST(isOnSale AS VARCHAR) FROM {src}
      UNION ALL SELECT {g}'seasons', unnest(seasons) FROM {src}),
fc AS (SELECT {g}field, value, COUNT(*) AS count FROM fv WHERE value IS NOT NULL GROUP BY ALL),
fr AS (SELECT *, ROW_NUMBER() OVER ({part} ORDER BY count DESC, value) AS rank FROM fc)"""


@register("facets_matched", f"""
WITH {PROD}, {REQ}, {MATCHED},
mp AS (SELECT m.qn AS query, m.filter_key, p.* FROM m JOIN tot USING (qn, filter_key) JOIN prod p ON p.id = m.id),
{_facet_sql('mp', 'query, filter_key')}
SELECT query, filter_key, field, value, count, CAST(rank AS INTEGER) AS rank FROM fr WHERE rank <= 10""")
def facets_matched(spark, sf_dir):
    return S.facets_matched(RQ.search_requests(spark, sf_dir), TB.products(spark, sf_dir))


@register("facets_corpus", f"""
WITH {PROD}, pr AS (SELECT brand, color, CAST(size AS VARCHAR) AS ageBucket, isOnSale, seasons FROM prod),
fv AS (SELECT 'brand' AS field, brand AS value FROM pr UNION ALL SELECT 'color', color FROM pr
       UNION ALL SELECT 'ageBucket', ageBucket FROM pr UNION ALL SELECT 'isOnSale', CAST(isOnSale AS VARCHAR) FROM pr
       UNION ALL SELECT 'seasons', unnest(seasons) FROM pr),
fc AS (SELECT field, value, COUNT(*) AS count FROM fv WHERE value IS NOT NULL GROUP BY ALL),
fr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY field ORDER BY count DESC, value) AS rank FROM fc)
SELECT field, value, count, CAST(rank AS INTEGER) AS rank FROM fr WHERE rank <= 10""")
def facets_corpus(spark, sf_dir):
    p = TB.products(spark, sf_dir).withColumn("ageBucket", F.col("size").cast("string"))
    return S.facets(p, [], ["brand", "color", "ageBucket", "isOnSale", "seasons"])


@register("any_term_search", f"""
WITH {PROD}, {REQ},
keys AS (SELECT DISTINCT lower(query) AS qn, filter_key, f_color, f_onsale, f_pmin, f_pmax FROM req),
terms AS (SELECT DISTINCT k.*, unnest(regexp_split_to_array(trim(k.qn), '\\s+')) AS term FROM keys k),
m AS (SELECT DISTINCT k.qn, k.filter_key, p.id FROM terms k JOIN prod p
      ON length(k.term) > 0 AND contains(lower(p.title || ' ' || p.description || ' ' || p.brand), k.term)
      AND (k.f_color IS NULL OR p.color = k.f_color)
      AND (k.f_onsale IS NULL OR CAST(coalesce(p.isOnSale, false) AS VARCHAR) = k.f_onsale)
      AND (k.f_pmin IS NULL OR coalesce(p.priceCurrent, 0) >= k.f_pmin)
      AND (k.f_pmax IS NULL OR coalesce(p.priceCurrent, 0) <= k.f_pmax)),
tot AS (SELECT qn, filter_key, COUNT(*) AS total FROM m GROUP BY ALL),
rk AS (SELECT qn, filter_key, id, ROW_NUMBER() OVER (PARTITION BY qn, filter_key ORDER BY id) AS r FROM m)
SELECT r.query_id, CAST(rk.r AS INTEGER) AS rank, rk.id, p.title, t.total
FROM req r JOIN rk ON lower(r.query) = rk.qn AND r.filter_key = rk.filter_key
JOIN tot t ON t.qn = rk.qn AND t.filter_key = rk.filter_key JOIN prod p ON p.id = rk.id
WHERE rk.r <= r.lim""")
def any_term_search(spark, sf_dir):
    return S.any_term_search(RQ.search_requests(spark, sf_dir), TB.products(spark, sf_dir))


@register("prefix_suggest", f"""
WITH {PROD}, {SUGGEST},
h AS (SELECT s.prefix, p.id, ROW_NUMBER() OVER (PARTITION BY s.prefix ORDER BY p.id) AS r
      FROM (SELECT DISTINCT prefix FROM sreq WHERE length(prefix) > 0) s
      JOIN prod p ON starts_with(lower(p.title), lower(s.prefix)))
SELECT q.query_id, CAST(h.r AS INTEGER) AS rank, h.id, p.title, p.brand
FROM sreq q JOIN h ON h.prefix = q.prefix JOIN prod p ON p.id = h.id WHERE h.r <= q.lim""")
def prefix_suggest(spark, sf_dir):
    return S.prefix_suggest(RQ.suggest_requests(spark, sf_dir), TB.products(spark, sf_dir))


@register("fuzzy_suggest", f"""
WITH {PROD}, {SUGGEST},
tok AS (SELECT id, unnest(regexp_split_to_array(lower(title), '\\s+')) AS t FROM prod),
g AS (SELECT DISTINCT id, substr(t, 1, L) AS gram FROM tok, range(2, 65536) r(L) WHERE length(t) >= 2 AND L <= length(t)),
q AS (SELECT DISTINCT prefix FROM sreq WHERE length(prefix) > 0),
h AS (SELECT q.prefix, g.id, MIN(levenshtein(lower(q.prefix), g.gram)) AS d FROM q JOIN g
      ON levenshtein(lower(q.prefix), g.gram) <= 1 GROUP BY ALL),
r AS (SELECT prefix, id, CASE WHEN d = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS score,
      ROW_NUMBER() OVER (PARTITION BY prefix ORDER BY d, id) AS rk FROM h)
SELECT s.query_id, CAST(r.rk AS INTEGER) AS rank, r.id, p.title, p.brand, r.score
FROM sreq s JOIN r ON r.prefix = s.prefix JOIN prod p ON p.id = r.id WHERE r.rk <= s.lim""")
def fuzzy_suggest(spark, sf_dir):
    return S.fuzzy_suggest(RQ.suggest_requests(spark, sf_dir), TB.products(spark, sf_dir))


_CAT = """dim AS (SELECT cat_id, cat_name, cat_slug, COUNT(*) AS n FROM prod GROUP BY ALL),
cq AS (SELECT DISTINCT query FROM req),
cm AS (SELECT q.query, d.cat_id, MIN(d.cat_name) AS name, MIN(d.cat_slug) AS slug, SUM(d.n) AS product_count
       FROM cq q JOIN dim d ON contains(lower(d.cat_name), lower(q.query)) OR contains(lower(d.cat_slug), lower(q.query))
       GROUP BY ALL),
cr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY product_count DESC, cat_id) AS rank FROM cm)"""
_BR = """bd AS (SELECT brand, COUNT(*) AS n FROM prod WHERE brand IS NOT NULL GROUP BY brand),
bq AS (SELECT DISTINCT query FROM req),
br AS (SELECT q.query, b.brand, b.n, ROW_NUMBER() OVER (PARTITION BY q.query ORDER BY b.n DESC, b.brand) AS rank
       FROM bq q JOIN bd b ON contains(lower(b.brand), lower(q.query)))"""
_CP = """pq AS (SELECT DISTINCT query FROM req),
cand AS (SELECT q.query, p.id,
         regexp_matches(p.title || chr(1) || p.description, '(?i)\\b' || regexp_escape(q.query) || '\\b') AS is_exact
         FROM pq q JOIN prod p ON contains(lower(p.title || chr(1) || p.description), lower(q.query))),
ex AS (SELECT * FROM (SELECT query, id, ROW_NUMBER() OVER (PARTITION BY query ORDER BY id) AS sr FROM cand WHERE is_exact) WHERE sr <= 10),
sb AS (SELECT * FROM (SELECT query, id, ROW_NUMBER() OVER (PARTITION BY query ORDER BY id) AS sr FROM cand WHERE length(query) >= 3) WHERE sr <= 20),
ng AS (SELECT s.* FROM sb s WHERE NOT EXISTS (SELECT 1 FROM ex e WHERE e.query = s.query AND e.id = s.id)),
mg AS (SELECT query, id, CAST(1.0 AS DOUBLE) AS score, 'exact' AS matchType, 0 AS src, sr FROM ex
       UNION ALL SELECT query, id, CAST(0.8 AS DOUBLE), 'ngram', 1, sr FROM ng),
pr AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, src, sr) AS rank FROM mg) WHERE rank <= 10)"""


@register("category_search", f"""
WITH {PROD}, {REQ}, {_CAT}
SELECT query, CAST(rank AS INTEGER) AS rank, cat_id AS id, name, slug, CAST(product_count AS BIGINT) AS product_count
FROM cr WHERE rank <= 5""")
def category_search(spark, sf_dir):
    q = RQ.consolidated_requests(spark, sf_dir)
    return S.category_search(q, TB.products(spark, sf_dir))


@register("brand_search", f"""
WITH {PROD}, {REQ}, {_BR}
SELECT query, CAST(rank AS INTEGER) AS rank, brand AS id, brand AS name, CAST(n AS BIGINT) AS product_count
FROM br WHERE rank <= 5""")
def brand_search(spark, sf_dir):
    return S.brand_search(RQ.consolidated_requests(spark, sf_dir), TB.products(spark, sf_dir))


@register("consolidated_products", f"""
WITH {PROD}, {REQ}, {_CP}
SELECT query, CAST(rank AS INTEGER) AS rank, pr.id, p.title, score, matchType FROM pr JOIN prod p ON p.id = pr.id""")
def consolidated_products(spark, sf_dir):
    return S.consolidated_products(RQ.consolidated_requests(spark, sf_dir), TB.products(spark, sf_dir))


_SUMMARY = f"""{PROD}, {REQ}, {_CAT}, {_BR}, {_CP},
nc AS (SELECT query, COUNT(*) AS c FROM cr WHERE rank <= 5 AND length(query) >= 3 GROUP BY query),
nb AS (SELECT query, COUNT(*) AS c FROM br WHERE rank <= 5 AND length(query) >= 3 GROUP BY query),
np AS (SELECT query, COUNT(*) AS c FROM pr WHERE length(query) >= 3 GROUP BY query),
summ AS (SELECT r.query_id, r.query, length(r.query) >= 3 AS admitted,
       CAST(coalesce(nc.c, 0) AS BIGINT) AS n_categories, CAST(coalesce(nb.c, 0) AS BIGINT) AS n_brands,
       CAST(coalesce(np.c, 0) AS BIGINT) AS n_products
FROM req r LEFT JOIN nc ON nc.query = r.query LEFT JOIN nb ON nb.query = r.query LEFT JOIN np ON np.query = r.query)"""


@register("consolidated_search", f"""
WITH {_SUMMARY}
SELECT *, n_categories + n_brands + n_products AS total_results FROM summ""")
def consolidated_search(spark, sf_dir):
    return S.consolidated_summary(RQ.consolidated_requests(spark, sf_dir), TB.products(spark, sf_dir))


@register("match_type_histogram", f"""
WITH {PROD}, {REQ}, {_CP}
SELECT query, matchType, COUNT(*) AS count FROM pr GROUP BY query, matchType""")
def match_type_histogram(spark, sf_dir):
    p = S.consolidated_products(RQ.consolidated_requests(spark, sf_dir), TB.products(spark, sf_dir))
    return p.groupBy("query", "matchType").agg(F.count(F.lit(1)).alias("count"))


@register("query_hit_rate", f"""
WITH {_SUMMARY}
SELECT COUNT(*) AS n_queries,
       ROUND(100.0 * AVG(CASE WHEN n_categories > 0 THEN 1.0 ELSE 0.0 END), 6) AS pct_with_categories,
       ROUND(100.0 * AVG(CASE WHEN n_brands > 0 THEN 1.0 ELSE 0.0 END), 6) AS pct_with_brands,
       ROUND(100.0 * AVG(CASE WHEN n_products > 0 THEN 1.0 ELSE 0.0 END), 6) AS pct_with_products FROM summ""")
def query_hit_rate(spark, sf_dir):
    s = S.consolidated_summary(RQ.consolidated_requests(spark, sf_dir), TB.products(spark, sf_dir))
    pct = lambda c: F.round(100.0 * F.avg(F.when(F.col(c) > 0, 1.0).otherwise(0.0)), 6)
    return s.agg(F.count(F.lit(1)).alias("n_queries"), pct("n_categories").alias("pct_with_categories"),
                 pct("n_brands").alias("pct_with_brands"), pct("n_products").alias("pct_with_products"))


@register("query_explain", f"""
WITH {PROD}, {REQ}
SELECT query_id, query AS query_text, regexp_split_to_array(trim(query), '\\s+') AS query_tokens,
       len(regexp_split_to_array(trim(query), '\\s+')) AS n_tokens, 64 AS embedding_dimensions,
       filter_key AS filters_applied,
       CASE WHEN contains(query, ' ') THEN 'keyword+vector' ELSE 'keyword' END AS search_strategy FROM req""")
def query_explain(spark, sf_dir):
    """How each request is interpreted (tokens, filters, whether the vector clause applies)."""
    r = RQ.search_requests(spark, sf_dir)
    toks = F.split(F.trim("query"), r"\s+")
    return r.select("query_id", F.col("query").alias("query_text"), toks.alias("query_tokens"),
                    F.size(toks).alias("n_tokens"), F.lit(64).alias("embedding_dimensions"),
                    F.col("filter_key").alias("filters_applied"),
                    F.when(F.col("query").contains(" "), "keyword+vector").otherwise("keyword").alias("search_strategy"))


_RECALL = f"""{PROD},
tw AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS target FROM part WHERE split_part(p_name, ' ', 2) <> ''),
pq AS (SELECT target, substr(target, 1, L) AS prefix FROM tw, range(3, 64) r(L) WHERE L <= length(target)),
tset AS (SELECT t.target, p.id FROM tw t JOIN prod p ON contains(lower(p.title), t.target)),
hits AS (SELECT q.target, q.prefix, p.id, ROW_NUMBER() OVER (PARTITION BY q.target, q.prefix ORDER BY p.id) AS r
         FROM pq q JOIN prod p ON contains(lower(p.title), q.prefix) OR contains(lower(p.description), q.prefix)
                                  OR contains(lower(p.brand), q.prefix))"""


@register("prefix_recall", f"""
WITH {_RECALL}
SELECT q.target, q.prefix, CAST(COUNT(h.id) AS BIGINT) AS n_results, CAST(COUNT(t.id) AS BIGINT) AS hits,
       COUNT(t.id) > 0 AS success
FROM pq q LEFT JOIN hits h ON h.target = q.target AND h.prefix = q.prefix AND h.r <= 20
LEFT JOIN tset t ON t.target = h.target AND t.id = h.id GROUP BY q.target, q.prefix""")
def prefix_recall(spark, sf_dir):
    """For every product-noun target, each prefix of 3+ characters runs the substring search
    (first 20 by id); hits = results inside the target set (titles containing the full word)."""
    from shopflow.operators import textmatch as TM
    from shopflow.operators.topk import top_k
    from shopflow.session import dealt
    products = TB.products(spark, sf_dir)
    targets = (TB.read(spark, sf_dir, "part")
               .select(F.lower(F.try_element_at(F.split("p_name", " "), F.lit(2))).alias("target"))
               .where(F.length("target") > 0).distinct())
    pq = targets.select("target", F.explode(F.transform(F.sequence(F.lit(3), F.greatest(F.length("target"), F.lit(3))),
                                                        lambda i: F.substring("target", 1, i))).alias("prefix")) \
        .where(F.length("prefix") >= 3).distinct()
    text = dealt(products.select("id", F.concat_ws(S.SEP, "title", "description", "brand").alias("text")))
    res = top_k(TM.substring_matches(pq.select(F.col("prefix").alias("q")), text), ["q"], [F.asc("id")], 20)
    tset = TM.substring_matches(targets.select(F.col("target").alias("q")), dealt(products.select("id", F.col("title").alias("text"))))
    j = (pq.join(res.withColumnRenamed("q", "prefix"), "prefix", "left")
         .join(tset.withColumnRenamed("q", "target").withColumn("_t", F.lit(1)).hint("merge"), ["target", "id"], "left"))
    return j.groupBy("target", "prefix").agg(F.count("id").alias("n_results"), F.count("_t").alias("hits")) \
        .withColumn("success", F.col("hits") > 0)


_FEEDBACK = f"""{PROD}, {REQ}, {MATCHED},
rk AS (SELECT qn, filter_key, id, ROW_NUMBER() OVER (PARTITION BY qn, filter_key ORDER BY id) AS r FROM m),
page AS (SELECT r.query_id, r.query, rk.id, rk.r FROM req r JOIN rk ON lower(r.query) = rk.qn AND r.filter_key = rk.filter_key
         WHERE rk.r > r.off AND rk.r <= r.off + r.lim),
fb AS (SELECT e.event_id AS query_id, q.query, CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS clicked,
              (SELECT list(id ORDER BY r) FROM page WHERE page.query_id = e.event_id) AS shown
       FROM events e JOIN req q ON q.query_id = e.event_id WHERE e.event_type = 'click')"""


@register("feedback_ctr", f"""
WITH {_FEEDBACK},
pos AS (SELECT query, coalesce(list_position(shown, clicked), 0) AS position FROM fb)
SELECT query, COUNT(*) AS impressions, COUNT(*) FILTER (WHERE position > 0) AS clicks_in_results,
       ROUND(COUNT(*) FILTER (WHERE position > 0) * 1.0 / COUNT(*), 6) AS ctr,
       ROUND(AVG(position) FILTER (WHERE position > 0), 6) AS mean_click_position FROM pos GROUP BY query""")
def feedback_ctr(spark, sf_dir):
    """Feedback rows (query, clicked id, shown ids) from click events and the page each request
    was shown; click position via ``array_position`` and click-through rate per query."""
    req = RQ.search_requests(spark, sf_dir)
    page = S.search_page(req, TB.products(spark, sf_dir))
    shown = page.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda e: e["id"]).alias("shown"))
    clicks = (TB.read(spark, sf_dir, "events").where(F.col("event_type") == "click")
              .select(F.col("event_id").alias("query_id"), F.get_json_object("props", "$.k").cast("bigint").alias("clicked")))
    fb = clicks.join(req.select("query_id", "query").hint("merge"), "query_id").join(shown.hint("merge"), "query_id", "left")
    pos = fb.select("query", F.coalesce(F.array_position("shown", F.col("clicked")), F.lit(0)).alias("position"))
    hit = F.col("position") > 0
    return pos.groupBy("query").agg(
        F.count(F.lit(1)).alias("impressions"), F.count_if(hit).alias("clicks_in_results"),
        F.round(F.count_if(hit) / F.count(F.lit(1)), 6).alias("ctr"),
        F.round(F.avg(F.when(hit, F.col("position"))), 6).alias("mean_click_position"))


def _grams_sql(t: str, lo: int = 3, hi: int = 4) -> str:
    parts = [f"list_transform(range(1, length({t}) - {n} + 2), lambda i: substr({t}, i, {n}))" for n in range(lo, hi + 1)]
    return f"list_distinct(flatten([{', '.join(parts)}]))"


@register("ngram_search", f"""
WITH {PROD}, {REQ},
qs AS (SELECT DISTINCT lower(query) AS qn FROM req),
qg AS (SELECT qn, len({_grams_sql('qn')}) AS nq, unnest({_grams_sql('qn')}) AS gram FROM qs),
pg AS (SELECT id, unnest({_grams_sql('lower(title)')}) AS gram FROM prod),
h AS (SELECT qn, id, ROUND(COUNT(*) / nq, 6) AS score FROM qg JOIN pg USING (gram) GROUP BY qn, nq, id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qn ORDER BY score DESC, id) AS rk FROM h)
SELECT q.query_id, CAST(r.rk AS INTEGER) AS rank, r.id, r.score FROM req q JOIN r ON r.qn = lower(q.query) WHERE r.rk <= q.lim""")
def ngram_search(spark, sf_dir):
    return S.ngram_search(RQ.search_requests(spark, sf_dir), TB.products(spark, sf_dir))


@register("result_analysis", f"""
WITH {PROD}, {REQ}, {MATCHED},
ev AS (SELECT event_id AS query_id, event_type AS suite FROM events),
per AS (SELECT r.query_id, ev.suite, coalesce(t.total, 0) AS total FROM req r JOIN ev USING (query_id)
        LEFT JOIN tot t ON t.qn = lower(r.query) AND t.filter_key = r.filter_key)
SELECT suite, COUNT(*) AS queries, COUNT(*) FILTER (WHERE total > 0) AS successful,
       COUNT(*) FILTER (WHERE total = 0) AS failed, ROUND(AVG(total), 6) AS avg_results FROM per GROUP BY suite""")
def result_analysis(spark, sf_dir):
    """Per request suite (event type) how many requests found products, and the mean total."""
    tot = S.search_totals(RQ.search_requests(spark, sf_dir), TB.products(spark, sf_dir))
    ev = TB.read(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), F.col("event_type").alias("suite"))
    return tot.join(ev.hint("merge"), "query_id").groupBy("suite").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("total") > 0).alias("successful"),
        F.count_if(F.col("total") == 0).alias("failed"), F.round(F.avg("total"), 6).alias("avg_results"))


@register("result_top3", f"""
WITH {PROD}, {REQ}, {MATCHED},
rk AS (SELECT qn, filter_key, id, ROW_NUMBER() OVER (PARTITION BY qn, filter_key ORDER BY id) AS r FROM m)
SELECT qn AS query, filter_key, CAST(r AS INTEGER) AS position, rk.id, p.title
FROM rk JOIN prod p ON p.id = rk.id WHERE r <= 3""")
def result_top3(spark, sf_dir):
    """The first three products (1-based position) of every distinct search key."""
    from shopflow.operators.topk import top_k
    m = S.matched_set(RQ.search_requests(spark, sf_dir), TB.products(spark, sf_dir))
    r = top_k(m, ["qn", "filter_key"], [F.asc("id")], 3, "position")
    return r.join(TB.products(spark, sf_dir).select("id", "title").hint("merge"), "id").select(
        F.col("qn").alias("query"), "filter_key", F.col("position").cast("int").alias("position"), "id", "title")


@register("request_fingerprints", f"""
WITH {PROD}, {REQ}
SELECT md5(lower(query) || chr(1) || filter_key || chr(1) || CAST(lim AS VARCHAR) || chr(1) || CAST(off AS VARCHAR)) AS fingerprint,
       lower(query) AS query, filter_key, COUNT(*) AS requests FROM req GROUP BY ALL""")
def request_fingerprints(spark, sf_dir):
    """stable fingerprint of each distinct request (text, canonical filters, limit, offset)
    and how many requests share it (the work the search plans save by matching once per key)."""
    r = RQ.search_requests(spark, sf_dir)
    fp = F.md5(F.concat_ws("\u0001", F.lower("query"), "filter_key", F.col("lim").cast("string"), F.col("off").cast("string")))
    return r.groupBy(fp.alias("fingerprint"), F.lower("query").alias("query"), "filter_key").agg(
        F.count(F.lit(1)).alias("requests"))
