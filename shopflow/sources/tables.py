"""Driver tables and the canonical catalogue / order / log views built on them.

Every adapter is a lazy projection over a parquet scan, so Catalyst prunes the
columns a query does not use and pushes its filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.functions import text as T

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product table (model defaults applied) from ``part``.

    title=p_name, brand=p_brand, category=p_type, size=p_size, price=p_retailprice;
    colour and seasons are derived from the name the way the feed ETL derives them,
    and the description is generated from name, category and brand.
    """
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.concat_ws(". ", F.col("p_name"), F.concat(F.lit("Kategori: "), F.col("p_type")),
                    F.concat(F.lit("Leverandør: "), F.col("p_brand"))).alias("description"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.array(F.struct(T.slug(F.col("p_type")).alias("id"), T.capitalize(F.col("p_type")).alias("name"),
                         T.slug(F.col("p_type")).alias("slug"))).alias("categories"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("priceOriginal"),
        F.col("p_retailprice").alias("priceCurrent"),
        F.lit(False).alias("isOnSale"),
        T.color_from_name(F.col("p_name")).alias("color"),
        T.seasons_from_text(F.col("p_name"), F.col("p_type")).alias("seasons"),
        F.lit("main").alias("productType"),
        F.lit(0.5).alias("seasonRelevancyFactor"),
        F.col("p_size").alias("stockLevel"),
        F.lit("").alias("imageThumbnailUrl"),
    )


def basket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(orderNr, productNr) lines; no join with orders is needed for basket work."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderNr"), F.col("l_partkey").alias("productNr"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat order lines: lineitem joined with orders for customer and time."""
    li = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderNr"), F.col("l_partkey").alias("productNr"))
    o = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderNr"), F.col("o_custkey").alias("customerNr"),
        F.col("o_orderdate").alias("dateTime"))
    return (li.join(o, "orderNr", "inner")
            .withColumn("seasonName", T.season_of_month(F.col("dateTime"))))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search / endpoint / recommendation log from ``events``.

    endpoint and algorithm = event_type, duration_ms = value, status 500 for
    ``error`` rows else 200, query = props.k, result_count = props.k.
    """
    e = read(spark, sf_dir, "events")
    k = F.get_json_object(F.col("props"), "$.k")
    return e.select(
        F.col("event_id"), F.col("ts"), F.col("user_id"),
        F.col("event_type").alias("endpoint"),
        F.col("event_type").alias("algorithm"),
        F.col("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        k.alias("query"),
        k.cast("int").alias("result_count"),
    )
