"""Nested vendor-feed sources (S1-S3) with declared schemas.

A feed file is one JSON object ``{"totalHits": n, "result": [product, ...]}``.
``multiLine`` JSON cannot be split, so a whole file is read by one task; large
feeds should arrive as JSON Lines (one product per line), which ``read_feed_lines``
reads in parallel splits. Either way products carry a source position for
first-wins de-duplication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORY = ("struct<id:string,categoryId:string,name:string,parentId:string,language:string,"
            "isMainCategory:boolean,isHidden:boolean,sortIndex:int>")
PRICE = "struct<marketId:string,unitPrice:double,originalUnitPrice:double>"
PRODUCT_FIELDS = [
    ("id", "string"), ("skuId", "string"), ("ean", "string"), ("productId", "string"), ("name", "string"),
    ("supplierName", "string"), ("supplierItemId", "string"), ("alternativeProductName", "string"),
    ("imageUrl", "string"), ("language", "string"), ("availableInventory", "string"),
    ("categories", f"array<{CATEGORY}>"),
    ("price", "struct<marketId:string,unitPrice:double,originalUnitPrice:double,discountAmount:double,"
              "discountPercent:double,currencyCode:string>"),
    ("prices", f"array<{PRICE}>"),
    ("properties", "array<struct<key:string,value:string,keyGroup:string>>"),
    ("tags", "array<string>"), ("marketIds", "array<string>"), ("productAttributes", "map<string,string>"),
]
PRODUCT = "struct<" + ",".join(f"{n}:{t}" for n, t in PRODUCT_FIELDS) + ">"
PRODUCT_DDL = ", ".join(f"{n} {t}" for n, t in PRODUCT_FIELDS)
FEED = f"totalHits bigint, result array<{PRODUCT}>"
ORDERLINE = "orderNr string, productNr string, customerNr string, seasonName string, dateTime timestamp"


def read_feed(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Products of feed file(s) with (file, position); fails when no file has ``result``."""
    raw = (spark.read.schema(FEED).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
           .withColumn("_file", F.input_file_name()))
    if raw.where(F.col("result").isNotNull()).limit(1).count() == 0:
        raise ValueError("Input file does not contain 'result' field")
    out = raw.select("_file", F.posexplode("result").alias("_pos", "p")).select("_file", "_pos", "p.*")
    return out.orderBy("_file", "_pos").limit(limit) if limit else out


def read_feed_lines(spark: SparkSession, path: str) -> DataFrame:
    """S1 (scalable form): one product object per line, read in parallel splits."""
    return (spark.read.schema(PRODUCT_DDL).json(path)
            .withColumn("_file", F.input_file_name()).withColumn("_pos", F.monotonically_increasing_id()))


def read_products_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A flat JSON array of records under a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def feed_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested vendor feed derived from the driver tables, one product per ``part`` row.

    Brand, size and material arrive as properties (no supplierName), the type as the
    main category, one ``b2c_nor`` price whose unit price carries the part's largest
    order-line discount, and the ordered quantity as ``availableInventory`` text.
    """
    from shopflow.sources.tables import read
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum("l_quantity").alias("qty"), F.max("l_discount").alias("maxdisc"))
    p = read(spark, sf_dir, "part").join(li, "p_partkey", "left")
    prop = lambda k, v, g=None: F.struct(F.lit(k).alias("key"), v.alias("value"),
                                         F.lit(g).cast("string").alias("keyGroup"))
    cat = F.struct(F.lower("p_type").alias("id"), F.lit(None).cast("string").alias("categoryId"),
                   F.col("p_type").alias("name"), F.lit(None).cast("string").alias("parentId"),
                   F.lit("no").alias("language"), F.lit(True).alias("isMainCategory"),
                   F.lit(False).alias("isHidden"), F.lit(0).alias("sortIndex"))
    price = F.struct(F.lit("b2c_nor").alias("marketId"),
                     (F.col("p_retailprice") * (1 - F.col("maxdisc"))).alias("unitPrice"),
                     F.col("p_retailprice").alias("originalUnitPrice"))
    return p.select(
        F.lit("part").alias("_file"), F.col("p_partkey").alias("_pos"),
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"),
        F.lit(None).cast("string").alias("supplierName"), F.lit(None).cast("string").alias("alternativeProductName"),
        F.col("qty").cast("string").alias("availableInventory"),
        F.array(cat).alias("categories"),
        F.when(F.col("maxdisc").isNotNull(), F.array(price)).otherwise(F.array().cast(f"array<{PRICE}>")).alias("prices"),
        F.array(prop("Brand", F.col("p_brand")), prop("Size", F.col("p_size").cast("string")),
                prop("Material", F.col("p_type"), "specs")).alias("properties"))
