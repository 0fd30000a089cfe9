from pyspark.sql import functions as F

from shopflow.operators import search as S
from shopflow.sources.requests import filter_key

PSCHEMA = ("id long, title string, description string, brand string, color string, isOnSale boolean, "
           "priceCurrent double, productType string, seasons array<string>, "
           "categories array<struct<id:string,name:string,slug:string>>")


def _products(spark):
    rows = [
        (1, "Metaldetector Pro", "Finn skatter", "Nokta", "Black", False, 1999.0, "main", None,
         [("c1", "Hobby", "hobby")]),
        (2, "Metall-spade", "Spade for metaldetektering", "Nokta", None, True, 299.0, "accessory", ["summer"],
         [("c1", "Hobby", "hobby")]),
        (3, "Baby vinterdress", "Varm dress, blue", "Kids Concept", "Blue", False, 499.0, "main", ["winter"],
         [("c2", "Baby og barn", "baby-og-barn")]),
        (4, "Baby body", "Myk bomull", "Kids Concept", "White", True, 99.0, "main", ["all"],
         [("c2", "Baby og barn", "baby-og-barn")]),
        (5, "Leke bil", "Rød bil", "Brio", "Red", False, 199.0, "main", None, [("c3", "Leker", "leker")]),
    ]
    return spark.createDataFrame(rows, PSCHEMA)


def _requests(spark, rows):
    df = spark.createDataFrame(rows, "query_id long, query string, filters map<string,string>")
    return df.select("query_id", "query", "filters", filter_key(F.col("filters")).alias("filter_key"),
                     F.lit(10).alias("lim"), F.lit(0).alias("off"))


def test_partial_word_recall(spark):
    # 'metall' is not a substring of 'metaldetector': literal substring search misses it
    reqs = _requests(spark, [(i, q, {}) for i, q in enumerate(["met", "meta", "metall", "metalde", "metaldetect"])])
    got = {}
    for r in S.search_page(reqs, _products(spark)).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert got[0] == {1, 2} and got[1] == {1, 2} and got[2] == {2} and got[3] == {1, 2} and got[4] == {1}


def test_filters_and_totals(spark):
    reqs = _requests(spark, [(1, "baby", {"color": "Blue"}), (2, "baby", {}), (3, "baby", {"isOnSale": "true"}),
                             (4, "baby", {"nosuchfield": "x"}), (5, "baby", {"priceRange.max": "200"})])
    tot = {r.query_id: r.total for r in S.search_totals(reqs, _products(spark)).collect()}
    assert tot == {1: 1, 2: 2, 3: 1, 4: 0, 5: 1}


def test_prefix_and_fuzzy_suggest(spark):
    reqs = spark.createDataFrame([(1, "ba", 5), (2, "bby", 5), (3, "lek", 5)], "query_id long, prefix string, lim int")
    pre = {}
    for r in S.prefix_suggest(reqs, _products(spark)).collect():
        pre.setdefault(r.query_id, []).append(r.id)
    assert pre == {1: [3, 4], 3: [5]}  # prefix rule: titles starting with the prefix only
    fz = {}
    for r in S.fuzzy_suggest(reqs, _products(spark)).collect():
        fz.setdefault(r.query_id, []).append((r.id, r.score))
    assert fz[2] == [(3, 1.0), (4, 1.0)]  # one edit away from 'baby'


def test_consolidated_rejects_short_and_finds_categories(spark):
    q = spark.createDataFrame([(1, "me"), (2, "baby"), (3, "nokta")], "query_id long, query string") \
        .select("*", F.lit(5).alias("max_categories"), F.lit(5).alias("max_brands"), F.lit(10).alias("max_products"))
    summ = {r.query_id: r for r in S.consolidated_summary(q, _products(spark)).collect()}
    assert not summ[1].admitted and summ[1].total_results == 0
    assert summ[2].n_categories == 1 and summ[2].n_products == 2
    assert summ[3].n_brands == 1
    cats = S.category_search(q, _products(spark)).where("query = 'baby'").collect()
    assert [(c.id, c.product_count) for c in cats] == [("c2", 2)]


def test_facets_sum_to_matches(spark):
    reqs = _requests(spark, [(1, "baby", {})])
    f = S.facets_matched(reqs, _products(spark)).where("field = 'brand'").collect()
    assert sum(r["count"] for r in f) == 2
