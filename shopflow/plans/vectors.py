"""Vector search queries over ``embeddings`` (V1, V3, V4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopflow.operators import vectors as V
from shopflow.plans.registry import register
from shopflow.sources import tables as TB

_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)"
_CEN = """el AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings
       WHERE embedding IS NOT NULL),
cen AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, AVG(CAST(x AS DOUBLE)) AS x FROM el GROUP BY ALL)
        GROUP BY label)"""


def _emb(spark, sf_dir):
    return TB.read(spark, sf_dir, "embeddings")


@register("knn_items", f"""
WITH {_E},
s AS (SELECT a.vec_id AS qid, b.vec_id AS cid, ROUND(list_cosine_similarity(a.v, b.v), 9) AS sim FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY sim DESC, cid) AS rk FROM s)
SELECT qid AS vec_id, CAST(rk AS INTEGER) AS rank, cid AS neighbor_id, ROUND(sim, 6) AS sim FROM r WHERE rk <= 5""")
def knn_items(spark, sf_dir):
    e = _emb(spark, sf_dir)
    r = V.knn(e, e, k=5, q_id="vec_id", q_vec="embedding", c_id="vec_id", c_vec="embedding", exclude_self=True)
    return r.select(F.col("qid").alias("vec_id"), F.col("rank").cast("int").alias("rank"),
                    F.col("cid").alias("neighbor_id"), F.round("sim", 6).alias("sim"))


def _centroids(spark, sf_dir):
    return V.centroids(_emb(spark, sf_dir).where(F.col("embedding").isNotNull()), "label", "embedding", 64)


@register("knn_centroids", f"""
WITH {_E}, {_CEN},
s AS (SELECT c.label, e.vec_id, ROUND(list_cosine_similarity(c.v, e.v), 9) AS sim FROM cen c, e),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rk FROM s)
SELECT label, CAST(rk AS INTEGER) AS rank, vec_id, ROUND(sim, 6) AS sim FROM r WHERE rk <= 10""")
def knn_centroids(spark, sf_dir):
    r = V.knn(_centroids(spark, sf_dir), _emb(spark, sf_dir), k=10, q_id="label", q_vec="vec",
              c_id="vec_id", c_vec="embedding")
    return r.select(F.col("qid").cast("int").alias("label"), F.col("rank").cast("int").alias("rank"),
                    F.col("cid").alias("vec_id"), F.round("sim", 6).alias("sim"))


@register("knn_threshold", f"""
WITH {_E}, {_CEN}
SELECT c.label, e.vec_id, ROUND(ROUND(list_cosine_similarity(c.v, e.v), 9), 6) AS sim FROM cen c, e
WHERE ROUND(list_cosine_similarity(c.v, e.v), 9) > 0.25""")
def knn_threshold(spark, sf_dir):
    r = V.knn(_centroids(spark, sf_dir), _emb(spark, sf_dir), k=None, threshold=0.25, q_id="label", q_vec="vec",
              c_id="vec_id", c_vec="embedding")
    return r.select(F.col("qid").cast("int").alias("label"), F.col("cid").alias("vec_id"),
                    F.round("sim", 6).alias("sim"))


@register("knn_label_purity", f"""
WITH {_E},
s AS (SELECT a.vec_id AS qid, a.label AS ql, b.vec_id AS cid, b.label AS cl, ROUND(list_cosine_similarity(a.v, b.v), 9) AS sim
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY sim DESC, cid) AS rk FROM s)
SELECT ql AS label, COUNT(*) AS neighbours, ROUND(AVG(CASE WHEN ql = cl THEN 1.0 ELSE 0.0 END), 6) AS purity
FROM r WHERE rk <= 5 GROUP BY ql""")
def knn_label_purity(spark, sf_dir):
    e = _emb(spark, sf_dir)
    r = V.knn(e, e, k=5, q_id="vec_id", q_vec="embedding", c_id="vec_id", c_vec="embedding", exclude_self=True)
    lab = e.select("vec_id", "label")
    j = (r.join(lab.withColumnRenamed("vec_id", "qid").withColumnRenamed("label", "ql"), "qid")
         .join(lab.withColumnRenamed("vec_id", "cid").withColumnRenamed("label", "cl"), "cid"))
    return j.groupBy(F.col("ql").alias("label")).agg(
        F.count(F.lit(1)).alias("neighbours"),
        F.round(F.avg(F.when(F.col("ql") == F.col("cl"), 1.0).otherwise(0.0)), 6).alias("purity"))
