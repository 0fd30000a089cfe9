"""Request tables derived from the driver tables.

Search traffic is modelled on ``events``: every event is a request about the
product ``props.k`` (``part.p_partkey``), and its ``event_type`` fixes the
request shape. The same rules are written once more in SQL for the oracle
(``shopflow.plans.search``), so the two sides read identical request tables.

    event_type  search query                 filters                                 offset
    view        full product name            -                                       5
    click       second name word             isOnSale=false                          0
    purchase    first name word              color=<colour word of the name>         0
    signup      first 4 chars of word 2      brand=<brand>, priceRange.min/max = ±50 0
    error       brand                        -                                       0

    event_type  suggest prefix (lower-case)
    view        first 2 chars of the name
    click       first 3 chars of the name
    purchase    first 4 chars of the name
    signup      first 5 chars of word 2
    error       word 2 with its second character deleted (a typo)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.functions import text as T
from shopflow.sources.tables import read


def _events_with_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(
        "event_id", "event_type", "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
    # the catalogue grows, and its files are far smaller than its rows: never broadcast
    return e.join(p.hint("merge"), e.k == p.p_partkey, "inner")


def filter_key(filters: Column) -> Column:
    """Canonical text of a filter map: sorted ``key=value`` joined by ``&`` (F19 fingerprint input).

    ``%``, ``=`` and ``&`` inside keys and values are escaped, so different maps have different keys.
    """
    def safe(c):
        for plain, code in (("%", "%25"), ("=", "%3D"), ("&", "%26")):
            c = F.replace(c, F.lit(plain), F.lit(code))
        return c
    return F.array_join(F.array_sort(F.transform(
        F.map_entries(filters), lambda e: F.concat(safe(e["key"]), F.lit("="), safe(e["value"])))), "&")


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, filters map<string,string>, filter_key, lim, off)."""
    ev = _events_with_product(spark, sf_dir)
    w1 = F.try_element_at(F.split("p_name", " "), F.lit(1))
    w2 = F.try_element_at(F.split("p_name", " "), F.lit(2))
    et = F.col("event_type")
    query = (F.when(et == "view", F.col("p_name")).when(et == "click", w2)
             .when(et == "purchase", w1).when(et == "signup", F.substring(w2, 1, 4))
             .otherwise(F.col("p_brand")))
    color = T.color_from_name(F.col("p_name"))
    price = F.floor("p_retailprice").cast("bigint")
    empty = F.create_map().cast("map<string,string>")
    filters = (F.when(et == "click", F.create_map(F.lit("isOnSale"), F.lit("false")))
               .when((et == "purchase") & color.isNotNull(), F.create_map(F.lit("color"), color))
               .when(et == "signup", F.create_map(
                   F.lit("brand"), F.col("p_brand"),
                   F.lit("priceRange.min"), (price - 50).cast("string"),
                   F.lit("priceRange.max"), (price + 50).cast("string")))
               .otherwise(empty))
    return ev.select(
        F.col("event_id").alias("query_id"), query.alias("query"), filters.alias("filters"),
        filter_key(filters).alias("filter_key"), F.lit(10).alias("lim"),
        F.when(et == "view", 5).otherwise(0).alias("off"))


def suggest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, prefix, lim)."""
    ev = _events_with_product(spark, sf_dir)
    name = F.lower("p_name")
    w2 = F.try_element_at(F.split(name, " "), F.lit(2))
    et = F.col("event_type")
    prefix = (F.when(et == "view", F.substring(name, 1, 2)).when(et == "click", F.substring(name, 1, 3))
              .when(et == "purchase", F.substring(name, 1, 4)).when(et == "signup", F.substring(w2, 1, 5))
              .otherwise(F.concat(F.substring(w2, 1, 1), F.substr(w2, F.lit(3)))))
    return ev.select(F.col("event_id").alias("query_id"), prefix.alias("prefix"), F.lit(5).alias("lim"))


def consolidated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, max_categories, max_brands, max_products, include_vector)."""
    r = search_requests(spark, sf_dir)
    return r.select("query_id", "query", F.lit(5).alias("max_categories"), F.lit(5).alias("max_brands"),
                    F.lit(10).alias("max_products"), F.lit(False).alias("include_vector"))


def text_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, include_vector): a request about every product and every benchmark text.

    By ``p_partkey`` modulo 6 a product is asked for by its name (0), name and type (1), second word without its
    second character (2), brand (3), the first four characters of its name (4) or the first two (5); a
    benchmark item by its text, with query_id ``-1 - item_id``. Every other one of a kind asks for vectors.
    """
    p = read(spark, sf_dir, "part")
    w2 = F.try_element_at(F.split("p_name", " "), F.lit(2))
    kind = F.pmod("p_partkey", F.lit(6))
    query = (F.when(kind == 0, F.col("p_name")).when(kind == 1, F.concat_ws(" ", "p_name", "p_type"))
             .when(kind == 2, F.concat(F.substring(w2, 1, 1), F.substr(w2, F.lit(3)))).when(kind == 3, F.col("p_brand"))
             .when(kind == 4, F.substring("p_name", 1, 4)).otherwise(F.substring("p_name", 1, 2)))
    b = read(spark, sf_dir, "benchmark")
    return (p.select(F.col("p_partkey").alias("query_id"), query.alias("query"), (F.pmod(F.floor(F.col("p_partkey") / 6), F.lit(2)) == 0).alias("include_vector"))
            .unionByName(b.select((-1 - F.col("item_id")).alias("query_id"), F.col("text").alias("query"), (F.pmod("item_id", F.lit(2)) == 0).alias("include_vector")))
            .where("query is not null"))
