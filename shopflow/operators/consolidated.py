"""Consolidated search (R5) with its fused product clauses, over a table of queries.

A query's products are scored by a weighted OR of clauses, all but the last one features of one sparse
product (``impact.top_scores``): its words in title, description and brand (BM25, 5), words within one edit or
with a prefix within one edit in the title (T3, 3), title words that begin with its words (2). Where vectors
are asked for and the query has several words (P20), the 50 products with the closest titles also get
(1 + cos) / 2 (V2); no embedding is made for other queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.functions.text import tokens
from shopflow.operators import impact
from shopflow.operators import search as S
from shopflow.operators import textmatch as TM
from shopflow.operators import textsearch as TS
from shopflow.operators import vectors as V
from shopflow.operators.classes import spread
from shopflow.operators.topk import top_k
from shopflow.session import written

FIELDS = ["title", "description", "brand"]
EXACT, FUZZY, PREFIX, CLOSE = 5.0, 3.0, 2.0, 1.0
LEAST_PREFIX = 3   # characters of a word's prefix that may stand for it
KEY = ["query", "include_vector"]


def uses_vector(query: Column, include_vector: Column) -> Column:
    """P20: vectors are asked for and the query has several words."""
    return F.coalesce(include_vector, F.lit(False)) & query.contains(" ")


def query_terms(asked: DataFrame) -> DataFrame:
    """(qid, term, qtf) of ``asked(qid, query)``."""
    return asked.select("qid", F.explode(tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def close_terms(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """T3 expansion: (term, word, likeness) for distinct ``terms(term)`` and words of ``vocabulary(word)`` of which a
    prefix (three characters and more, or the word itself) is at most one edit away.

    Likeness is the prefix's share of the word, less one in the shorter length for an edit; the best prefix counts.
    Words meet through deletion neighbourhoods, so no term is compared with the whole vocabulary.
    """
    words = vocabulary.select("word").distinct()
    grams = words.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", 1, i))).alias("gram"))
    grams = grams.where((F.length("gram") >= LEAST_PREFIX) | (F.col("gram") == F.col("word")))
    near = TM.one_edit_matches(terms.select(F.col("term").alias("q")), grams)
    edit = F.when(F.col("dist") == 0, F.lit(1.0)).otherwise(1 - F.lit(1.0) / F.least(F.length("q"), F.length("gram")))
    return (near.join(grams, "gram").groupBy(F.col("q").alias("term"), "word")
            .agg(F.max(edit * F.length("gram") / F.length("word")).alias("likeness")).where("likeness > 0"))


def _fuzzy(terms: DataFrame, vocabulary: DataFrame, weight: float) -> DataFrame:
    titles = vocabulary.where("field = 'title'").select(F.col("term").alias("word"), "fid")
    close = close_terms(terms.select("term").distinct(), titles)
    return terms.join(close, "term").join(titles, "word").select("qid", "fid", (F.col("qtf") * F.col("likeness") * weight).alias("w"))


def _asked(features: DataFrame) -> DataFrame:
    total = features.groupBy("qid", "fid").agg(F.sum("w").alias("x"))
    return total.groupBy("qid").agg(F.collect_list(F.struct("fid", "x")).alias("e")).select("qid", F.col("e.fid").alias("feats"), F.col("e.x").alias("weights"))


def _docs(entries: DataFrame, classes: DataFrame) -> DataFrame:
    return (entries.groupBy(F.col("cid").alias("did")).agg(F.collect_list(F.struct("fid", "imp")).alias("e"))
            .select("did", F.col("e.fid").alias("feats"), F.col("e.imp").alias("imps"))
            .join(classes.select(F.col("cid").alias("did"), "lead").hint("merge"), "did"))


def fuzzy_relevance(queries: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """(query, rank, id, score): the ``k`` products whose titles hold words closest to the query's, by the
    sum of likeness times BM25 over the words; ties by id."""
    asked, members = TS.text_classes(queries.select("query").withColumn("id", F.col("query")).distinct(), "id", ["query"], 1)
    classes, _ = TS.text_classes(products, "id", ["title"], k)
    entries, vocabulary = TS.impact_vectors(classes, {"title": 1.0})
    terms = written(query_terms(asked.select(F.col("cid").alias("qid"), "query")), "terms")
    best = impact.top_scores(_asked(_fuzzy(terms, vocabulary, 1.0)), _docs(entries, classes), k)
    return spread(best, classes, members, k, False).select(F.col("id").alias("query"), "rank", F.col("other").alias("id"), "score")


def title_neighbours(queries: DataFrame, products: DataFrame, k: int = 50) -> DataFrame:
    """V2: (query, id, sim, rank): the ``k`` products with the closest titles, for queries that use vectors.
    ``queries(query, include_vector)``; only those get an embedding."""
    gated = queries.where(uses_vector(F.col("query"), F.col("include_vector"))).select("query").distinct()
    qv = V.with_hashed_embedding(gated, "query", "vec")
    pv = V.with_hashed_embedding(products.select("id", "title"), "title", "vec").select("id", "vec")
    return V.knn(qv, pv, k=k, q_id="query").select(F.col("qid").alias("query"), F.col("cid").alias("id"), "sim", "rank")


def fused_products(queries: DataFrame, products: DataFrame, k: int = 10, vector_k: int = 50) -> DataFrame:
    """(query, include_vector, rank, id, title, score, matchType): for distinct ``queries(query, include_vector)`` the ``k``
    products with the highest fused score above 0; ties by id. The match type is exact where the title holds the query,
    else ngram above a score of 1.5, else vector."""
    asked = queries.select("query", F.coalesce("include_vector", F.lit(False)).alias("include_vector")).distinct()
    asked = written(asked.withColumn("qid", F.monotonically_increasing_id()), "asked")
    classes, members = TS.text_classes(products, "id", FIELDS, k)
    entries, vocabulary = TS.impact_vectors(classes, dict.fromkeys(FIELDS, 1.0))
    terms = written(query_terms(asked), "terms")
    grams = written(TM.token_edge_grams(classes.select("cid", F.concat_ws(" ", tokens(F.col("title"))).alias("title")), 2, "cid", "title")
             .join(terms.select(F.col("term").alias("gram")).distinct(), "gram").select(F.col("id").alias("cid"), "gram"), "grams")
    begun = written(grams.select("gram").distinct().select("gram", (-1 - F.monotonically_increasing_id()).alias("fid")), "begun")
    entries = written(entries.select("cid", "fid", "imp").unionByName(grams.join(begun, "gram").select("cid", "fid", F.lit(1.0).alias("imp"))), "entries")
    features = (terms.join(vocabulary, "term").select("qid", "fid", (F.col("qtf") * EXACT).alias("w"))
                .unionByName(_fuzzy(terms, vocabulary, FUZZY))
                .unionByName(terms.join(begun, terms["term"] == begun["gram"]).select("qid", "fid", F.lit(PREFIX).alias("w"))))
    features = written(features.groupBy("qid", "fid").agg(F.sum("w").alias("w")), "features")
    best = impact.top_scores(_asked(features), _docs(entries, classes), k)
    text = best.join(classes.select(F.col("cid").alias("did"), F.explode("ids").alias("id")).hint("merge"), "did").select("qid", "id", "score")
    near = written(title_neighbours(asked, products, vector_k).join(asked.where(uses_vector(F.col("query"), F.col("include_vector"))), "query")
            .join(members.hint("merge"), "id").select("qid", "id", "cid", "sim"), "near")
    pairs = (near.select("qid", "cid").distinct().join(features, "qid").join(entries.hint("merge"), ["cid", "fid"])
             .groupBy("qid", "cid").agg(F.round(F.sum(F.col("w") * F.col("imp")), 9).alias("text")))
    close = near.join(pairs, ["qid", "cid"], "left").select(
        "qid", "id", F.round(F.coalesce("text", F.lit(0.0)) + (1 + F.col("sim")) / 2 * CLOSE, 9).alias("score"))
    every = text.join(close.select("qid", "id"), ["qid", "id"], "left_anti").unionByName(close)
    ranked = top_k(every, ["qid"], [F.desc("score"), F.asc("id")], k)
    kind = (F.when(F.contains(F.lower("title"), F.lower("query")), "exact").when(F.col("score") > 1.5, "ngram").otherwise("vector"))
    return (ranked.join(asked, "qid").join(products.select("id", "title").hint("merge"), "id")
            .select(*KEY, F.col("rank").cast("int").alias("rank"), "id", "title", "score", kind.alias("matchType")))


def consolidated_rows(requests: DataFrame, products: DataFrame, max_categories: int = 5, max_brands: int = 5, max_products: int = 10,
                      least: int = 3) -> DataFrame:
    """The rows of an answer for each distinct ``requests(query, include_vector)``: kind (category, brand or product), rank, id,
    name, product_count (categories and brands), score and matchType (products), and total_results.

    Queries under ``least`` characters are not admitted (P19): one row of kind rejected with the reason as its name.
    """
    asked = requests.select("query", F.coalesce("include_vector", F.lit(False)).alias("include_vector")).distinct()
    asked = written(asked, "asked")
    admitted = asked.where(F.length("query") >= least)
    texts = admitted.select("query", F.lit(max_categories).alias("max_categories"), F.lit(max_brands).alias("max_brands")).distinct()
    none = lambda t: F.lit(None).cast(t)
    found = (S.category_search(texts, products).select("query", F.lit("category").alias("kind"), "rank", "id", "name", "product_count")
             .unionByName(S.brand_search(texts, products).select("query", F.lit("brand").alias("kind"), "rank", "id", "name", "product_count")))
    rows = written(found.join(admitted, "query").withColumns({"score": none("double"), "matchType": none("string")})
            .unionByName(fused_products(admitted, products, max_products).select(
                *KEY, F.lit("product").alias("kind"), "rank", F.col("id").cast("string").alias("id"), F.col("title").alias("name"),
                none("bigint").alias("product_count"), "score", "matchType")), "rows")
    totals = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("total_results"))
    rejected = asked.where(~(F.length("query") >= least)).select(
        *KEY, F.lit("rejected").alias("kind"), F.lit(1).alias("rank"), none("string").alias("id"), F.lit(f"fewer than {least} characters").alias("name"),
        none("bigint").alias("product_count"), none("double").alias("score"), none("string").alias("matchType"), F.lit(0).cast("bigint").alias("total_results"))
    return rows.join(totals, KEY).select(rejected.columns).unionByName(rejected)


def vector_matches(queries: DataFrame, products: DataFrame, earlier: DataFrame, threshold: float = 0.5, report: dict | None = None) -> DataFrame:
    """V3: (query, id, score): every product whose title or description is closer than ``threshold`` to a query that
    uses vectors, by the closer of both, without the pairs of ``earlier(query, id)``."""
    gated = queries.where(uses_vector(F.col("query"), F.col("include_vector"))).select("query").distinct()
    qv = written(V.with_hashed_embedding(gated, "query", "vec"), "queries")
    found = None
    for field in ("title", "description"):
        pv = V.with_hashed_embedding(products.select("id", field), field, "vec").select("id", "vec")
        one: dict = {}
        hits = V.knn(qv, pv, k=None, threshold=threshold, q_id="query", report=one if report is not None else None)
        if report is not None:
            report[field] = one
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy(F.col("qid").alias("query"), F.col("cid").alias("id")).agg(F.max("sim").alias("score"))
    return best.join(earlier.select("query", "id").hint("merge"), ["query", "id"], "left_anti")


def three_strategies(queries: DataFrame, products: DataFrame, limit: int = 10) -> DataFrame:
    """R4 whole: (query, rank, id, title, score, matchType): whole-word matches (1.0), substring matches (0.8), then vector
    matches (their similarity), by score, then strategy and its order (vector matches by id), cut to ``limit``."""
    asked = queries.withColumn("max_products", F.lit(limit))
    first = written(S.consolidated_candidates(asked, products), "candidates")
    vector = vector_matches(asked, products, first)
    merged = first.select("query", "id", "score", "matchType", "src", F.col("srank").cast("bigint").alias("srank")).unionByName(
        vector.select("query", "id", "score", F.lit("vector").alias("matchType"), F.lit(2).alias("src"), F.lit(0).cast("bigint").alias("srank")))
    ranked = top_k(merged, ["query"], [F.desc("score"), F.asc("src"), F.asc("srank"), F.asc("id")], limit)
    return (ranked.join(products.select("id", "title").hint("merge"), "id")
            .select("query", F.col("rank").cast("int").alias("rank"), "id", "title", F.round("score", 6).alias("score"), "matchType"))
