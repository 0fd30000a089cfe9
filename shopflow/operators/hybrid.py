"""Weighted OR fusion of search clauses (R1-R3) over a request table.

Each clause scores (query, product) pairs on its own: BM25 text relevance on
title, description and brand (per-field statistics, summed), and cosine kNN
clauses on title / description embeddings that only score a product inside the
query's top ``k`` ((1 + cos) / 2, as a kNN search score). A product's fused score
is the boosted sum of the clauses that matched it; filters apply after fusion
(post-filter, D24), then the page is cut per request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.operators import search as S
from shopflow.operators import textsearch as TS
from shopflow.operators import vectors as V
from shopflow.operators.topk import top_k
from shopflow.session import lookup, written

TEXT_FIELDS = ("title", "description", "brand")


def clause_scores(queries: DataFrame, products: DataFrame, text_boost: float = 2.0,
                  title_knn=(100, 1.5), desc_knn=(100, 1.0)) -> DataFrame:
    """(qn, id, score): fused clause scores for distinct lower-cased query texts ``qn``."""
    q = queries.select(F.col("qn").alias("qid_text")).distinct().withColumn("qid", F.col("qid_text"))
    parts = []
    for f in TEXT_FIELDS:
        s = TS.bm25_scores(q, products.select("id", f), q_id="qid", q_text="qid_text", d_id="id", d_text=f)
        parts.append(s.select("qid", F.col("doc_id").alias("id"), (F.col("score") * text_boost).alias("s")))
    qv = V.with_hashed_embedding(q, "qid_text", "vec").select("qid", "vec")
    for field, (k, boost) in (("title", title_knn), ("description", desc_knn)):
        pv = V.with_hashed_embedding(products.select("id", field), field, "vec").select("id", "vec")
        nn = V.knn(qv, pv, k=k, q_id="qid", c_id="id")
        parts.append(nn.select("qid", F.col("cid").alias("id"), ((1 + F.col("sim")) / 2 * boost).alias("s")))
    fused = parts[0]
    for p in parts[1:]:
        fused = fused.unionByName(p)
    fused = fused.groupBy("qid", "id").agg(F.round(F.sum("s"), 9).alias("score"))
    return fused.join(q, "qid").select(F.col("qid_text").alias("qn"), "id", "score")


def hybrid_search(requests: DataFrame, products: DataFrame) -> DataFrame:
    """R2 + R3: fused score, post-filter, per-request page (score desc, id asc), total and match type."""
    # the distinct request keys feed five clauses and the filter join: materialise them once
    # (a small table in the shared folder)
    keys = written(S.search_keys(requests), "keys")
    m = S.filtered(clause_scores(keys, products), keys, products, carry=("score", "title"))
    totals = m.groupBy("qn", "filter_key").agg(F.count(F.lit(1)).alias("total"))
    ranked = top_k(m, ["qn", "filter_key"], [F.desc("score"), F.asc("id")],
                   S.max_of(keys, F.col("max_end")) or 0)
    shown = written(ranked.join(totals, ["qn", "filter_key"]), "shown")
    req = requests.select("query_id", F.lower("query").alias("qn"), "filter_key", "off", "lim")
    page = (req.join(lookup(shown), ["qn", "filter_key"])
            .where((F.col("rank") > F.col("off")) & (F.col("rank") <= F.col("off") + F.col("lim"))))
    match_type = (F.when(F.lower("title").contains(F.col("qn")), "exact")
                  .when(F.col("score") > 1.5, "ngram").otherwise("vector"))
    return page.select("query_id", F.col("rank").cast("int").alias("rank"), "id",
                       F.round("score", 6).alias("score"), match_type.alias("matchType"),
                       F.col("total").cast("bigint").alias("total"))
