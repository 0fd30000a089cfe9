"""Store-mutation and catalogue-profile queries (S7-S23, A26-A28, A32) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopflow.functions import text as T
from shopflow.operators import pairs as PR
from shopflow.plans.registry import register
from shopflow.session import checkpoint_dir
from shopflow.sources import store as ST
from shopflow.sources import tables as TB


@register("upsert_counts", """
WITH cur AS (SELECT DISTINCT l_partkey AS id FROM lineitem), b AS (SELECT DISTINCT p_partkey AS id FROM part)
SELECT COUNT(*) AS processed, COUNT(*) FILTER (WHERE cur.id IS NULL) AS inserted,
       COUNT(*) FILTER (WHERE cur.id IS NOT NULL) AS updated FROM b LEFT JOIN cur USING (id)""")
def upsert_counts(spark, sf_dir):
    """A feed reload (all of ``part``) over the catalogue known from order history."""
    cur = TB.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"))
    return ST.upsert_counts(cur, TB.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


@register("upsert_last_wins", """
WITH obs AS (SELECT l_partkey AS id, l_extendedprice / l_quantity AS priceCurrent,
                    ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rk
             FROM lineitem WHERE l_quantity > 0),
b AS (SELECT id, priceCurrent FROM obs WHERE rk = 1),
cur AS (SELECT p_partkey AS id, p_retailprice AS priceCurrent FROM part)
SELECT b.id, b.priceCurrent, CASE WHEN cur.id IS NULL THEN 'inserted' ELSE 'updated' END AS _action
FROM b LEFT JOIN cur USING (id)
UNION ALL SELECT id, priceCurrent, 'kept' FROM cur WHERE id NOT IN (SELECT id FROM b)""")
def upsert_last_wins(spark, sf_dir):
    """Price observations from order lines upserted into the catalogue; the latest line per product wins."""
    obs = TB.read(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 0).select(
        F.col("l_partkey").alias("id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("priceCurrent"),
        "l_shipdate", "l_orderkey", "l_linenumber")
    batch = ST.last_wins(obs, "id", ["l_shipdate", "l_orderkey", "l_linenumber"]).select("id", "priceCurrent")
    cur = TB.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("priceCurrent"))
    return ST.upsert(cur, batch, "id")


@register("delete_customer_orders", """
WITH er AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0),
ol AS (SELECT l.l_orderkey, o.o_custkey FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)
SELECT COUNT(*) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM er)) AS deleted,
       COUNT(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM er) OR o_custkey IS NULL) AS remaining FROM ol""")
def delete_customer_orders(spark, sf_dir):
    """Erase the order lines of closed accounts (negative balance)."""
    er = TB.read(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("customerNr"))
    return ST.delete_counts(TB.order_lines(spark, sf_dir), er, "customerNr")


@register("delete_order", """
SELECT COUNT(*) FILTER (WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) AS deleted,
       COUNT(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) AS remaining
FROM lineitem""")
def delete_order(spark, sf_dir):
    """Delete every line of finished orders."""
    done = TB.read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("orderNr"))
    return ST.delete_counts(TB.basket_lines(spark, sf_dir), done, "orderNr")


@register("delete_product", """
SELECT COUNT(*) FILTER (WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)) AS deleted,
       COUNT(*) FILTER (WHERE p_partkey IN (SELECT l_partkey FROM lineitem)) AS remaining FROM part""")
def delete_product(spark, sf_dir):
    """Delete products never ordered (the delete list is an anti-join of the catalogue)."""
    products = TB.products(spark, sf_dir)
    never = products.select("id").join(TB.basket_lines(spark, sf_dir).select(F.col("productNr").alias("id")),
                                       "id", "left_anti")
    return ST.delete_counts(products, never, "id")


@register("load_reconcile", """
WITH e AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey IS NOT NULL),
m AS (SELECT id FROM e WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_partkey IS NOT NULL))
SELECT (SELECT COUNT(*) FROM e) AS expected, (SELECT COUNT(*) FROM e) - (SELECT COUNT(*) FROM m) AS found,
       (SELECT COUNT(*) FROM m) AS missing, (SELECT coalesce(list(id ORDER BY id), []) FROM (SELECT id FROM m ORDER BY id LIMIT 10)) AS missing_ids""")
def load_reconcile(spark, sf_dir):
    """Every product referenced by an order line must be in the catalogue."""
    exp = TB.basket_lines(spark, sf_dir).where(F.col("productNr").isNotNull()).select(F.col("productNr").alias("id"))
    return ST.reconcile(exp, TB.products(spark, sf_dir).select("id"))


@register("point_lookup", """
WITH ids AS (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS id FROM events)
SELECT ids.id, p.p_partkey IS NOT NULL AS found, p.p_name AS title FROM ids LEFT JOIN part p ON p.p_partkey = ids.id""")
def point_lookup(spark, sf_dir):
    """The products the request log asks for, with a not-found flag."""
    ids = TB.read(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("id"))
    return ST.lookup(ids, TB.products(spark, sf_dir), "id", ("title",))


_TABLES = TB.TABLES


@register("table_inventory", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in _TABLES)
    + " UNION ALL SELECT 'embeddings.with_vector', COUNT(embedding) FROM embeddings")
def table_inventory(spark, sf_dir):
    """Row count per table plus embedding coverage."""
    parts = [TB.read(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(t).alias("table_name"), "row_count") for t in _TABLES]
    parts.append(TB.read(spark, sf_dir, "embeddings").agg(F.count("embedding").alias("row_count"))
                 .select(F.lit("embeddings.with_vector").alias("table_name"), "row_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("pair_status", """
WITH lp AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL),
pairs AS (SELECT a.p, b.p FROM lp a JOIN lp b ON a.o = b.o AND a.p < b.p GROUP BY a.p, b.p)
SELECT COUNT(*) AS pair_count, CASE WHEN COUNT(*) > 0 THEN 'Ready' ELSE 'Not computed' END AS status FROM pairs""")
def pair_status(spark, sf_dir):
    return ST.pair_status(PR.pair_counts(TB.basket_lines(spark, sf_dir)))


@register("load_summary", """
SELECT (SELECT COUNT(*) FROM part) AS products, (SELECT COUNT(*) FROM lineitem) AS order_lines,
       (SELECT COUNT(DISTINCT o.o_custkey) FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey) AS customers""")
def load_summary(spark, sf_dir):
    """Products, order lines and distinct customers with lines."""
    p = TB.products(spark, sf_dir).agg(F.count(F.lit(1)).alias("products"))
    ol = TB.order_lines(spark, sf_dir).agg(F.count(F.lit(1)).alias("order_lines"),
                                           F.countDistinct("customerNr").alias("customers"))
    return ol.select(p.scalar().alias("products"), "order_lines", "customers")


@register("catalogue_profile", """
SELECT COUNT(DISTINCT p_brand) AS distinct_brands, COUNT(DISTINCT p_type) AS distinct_categories,
       COUNT(*) AS products FROM part""")
def catalogue_profile(spark, sf_dir):
    """Catalogue size with distinct brands and categories."""
    p = TB.products(spark, sf_dir)
    return p.agg(F.countDistinct("brand").alias("distinct_brands"),
                 F.countDistinct(F.col("categories")[0]["id"]).alias("distinct_categories"),
                 F.count(F.lit(1)).alias("products"))


@register("category_dimension", """
SELECT lower(p_type) AS id, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS name,
       replace(lower(p_type), ' ', '-') AS slug, COUNT(*) AS product_count FROM part GROUP BY ALL""")
def category_dimension(spark, sf_dir):
    """(id, name, slug, product count) from the product categories."""
    c = TB.products(spark, sf_dir).select(F.explode("categories").alias("c"))
    return c.groupBy(F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.col("c.slug").alias("slug")) \
        .agg(F.count(F.lit(1)).alias("product_count"))


@register("brand_dimension", """
SELECT 'brand_' || replace(lower(p_brand), ' ', '-') AS id, p_brand AS name, COUNT(*) AS product_count
FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand""")
def brand_dimension(spark, sf_dir):
    """(brand_<slug>, name, product count)."""
    p = TB.products(spark, sf_dir).where(F.col("brand").isNotNull())
    return p.groupBy("brand").agg(F.count(F.lit(1)).alias("product_count")).select(
        F.concat(F.lit("brand_"), T.slug(F.col("brand"))).alias("id"), F.col("brand").alias("name"), "product_count")


@register("batch_import", """
WITH cur AS (SELECT DISTINCT l_partkey AS id FROM lineitem), b AS (SELECT DISTINCT p_partkey AS id FROM part),
pc AS (SELECT COUNT(*) AS processed, COUNT(*) FILTER (WHERE cur.id IS NULL) AS inserted,
              COUNT(*) FILTER (WHERE cur.id IS NOT NULL) AS updated FROM b LEFT JOIN cur USING (id))
SELECT 'products' AS table_name, processed, inserted, updated FROM pc
UNION ALL SELECT 'orderlines', COUNT(*), COUNT(*), 0 FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""")
def batch_import(spark, sf_dir):
    """One job imports the product feed (upsert) and the order lines (append, products not
    checked); one summary row per table."""
    cur = TB.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"))
    prod = ST.upsert_counts(cur, TB.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))) \
        .select(F.lit("products").alias("table_name"), "processed", "inserted", "updated")
    lines = TB.order_lines(spark, sf_dir).agg(F.count(F.lit(1)).alias("processed")).select(
        F.lit("orderlines").alias("table_name"), "processed", F.col("processed").alias("inserted"),
        F.lit(0).cast("bigint").alias("updated"))
    return prod.unionByName(lines)


@register("delete_all_products", """
WITH lp AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL),
pairs AS (SELECT a.p, b.p FROM lp a JOIN lp b ON a.o = b.o AND a.p < b.p GROUP BY a.p, b.p)
SELECT 'products' AS table_name, COUNT(*) AS deleted, CAST(0 AS BIGINT) AS remaining FROM part
UNION ALL SELECT 'product_pairs', COUNT(*), CAST(0 AS BIGINT) FROM pairs""")
def delete_all_products(spark, sf_dir):
    """Every product goes, and with them the derived pairs."""
    return ST.delete_all({"products": TB.read(spark, sf_dir, "part"),
                          "product_pairs": PR.pair_counts(TB.basket_lines(spark, sf_dir))})[1]


@register("delete_all_orders", """
SELECT 'orderlines' AS table_name, COUNT(*) AS deleted, CAST(0 AS BIGINT) AS remaining FROM lineitem""")
def delete_all_orders(spark, sf_dir):
    """S15."""
    return ST.delete_all({"orderlines": TB.read(spark, sf_dir, "lineitem")})[1]


@register("remaining_after_delete", """
SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49)""")
def remaining_after_delete(spark, sf_dir):
    """The catalogue without the products returned in bulk (its rows, not a count)."""
    gone = TB.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 49").select(F.col("l_partkey").alias("id"))
    return ST.delete_keys(TB.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), gone, "id")


@register("regex_products", """
SELECT p_partkey AS id, p_type AS category, p_brand AS brand FROM part
WHERE regexp_matches(p_type, '(?i)^(promo|small).*(tin|steel)$') OR regexp_matches(p_brand, '(?i)#1[0-9]')""")
def regex_products(spark, sf_dir):
    """The opt-in raw pattern, case-insensitive, on category and brand."""
    p = TB.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"))
    return p.where(T.matches_pattern(F.col("category"), "^(promo|small).*(tin|steel)$") | T.matches_pattern(F.col("brand"), "#1[0-9]"))


@register("basket_lists", """
WITH l AS (SELECT l_orderkey AS orderNr, l_linenumber, l_partkey AS p, o_custkey AS c,
           ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS place
           FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT orderNr, CAST(place // 1024 AS INTEGER) AS part, any_value(c) AS first_user, list(p ORDER BY place) AS products
FROM l GROUP BY orderNr, place // 1024""")
def basket_lists(spark, sf_dir):
    """Every order's products in line order, with its first user."""
    li = TB.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderNr"), "l_linenumber", F.col("l_partkey").alias("productNr"))
    o = TB.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderNr"), F.col("o_custkey").alias("customerNr"))
    return PR.basket_lists(li.join(o, "orderNr"), ["l_linenumber"])


def _scratch(spark, name: str) -> str:
    import uuid
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("append_counts", """
SELECT 0 AS batch, COUNT(*) FILTER (WHERE l_orderkey % 3 = 0) AS appended, COUNT(*) FILTER (WHERE l_orderkey % 3 = 0) AS total FROM lineitem
UNION ALL SELECT 1, COUNT(*) FILTER (WHERE l_orderkey % 3 = 1), COUNT(*) FILTER (WHERE l_orderkey % 3 < 2) FROM lineitem
UNION ALL SELECT 2, COUNT(*) FILTER (WHERE l_orderkey % 3 = 2), COUNT(*) FROM lineitem""")
def append_counts(spark, sf_dir):
    """All order lines appended in three batches; rows each write reports, and the table's rows after it."""
    lines, path, total, out = TB.basket_lines(spark, sf_dir).where("orderNr is not null"), _scratch(spark, "appended"), 0, []
    for batch in range(3):
        n = ST.append_counted(lines.where(F.pmod("orderNr", F.lit(3)) == batch), path)
        out.append((batch, n, spark.read.parquet(path).count()))
    return spark.createDataFrame(out, "batch int, appended long, total long")


@register("rebuild_counts", """
WITH lp AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL),
half AS (SELECT COUNT(*) AS n FROM (SELECT a.p, b.p FROM lp a JOIN lp b ON a.o = b.o AND a.p < b.p WHERE a.o % 2 = 0 GROUP BY a.p, b.p)),
whole AS (SELECT COUNT(*) AS n FROM (SELECT a.p, b.p FROM lp a JOIN lp b ON a.o = b.o AND a.p < b.p GROUP BY a.p, b.p))
SELECT 0 AS version, CAST(0 AS BIGINT) AS old_pairs, half.n AS new_pairs FROM half
UNION ALL SELECT 1, half.n, whole.n FROM half, whole""")
def rebuild_counts(spark, sf_dir):
    """The pair table of the even orders, rebuilt from all of them; old and new rows of each write."""
    lines, root, out = TB.basket_lines(spark, sf_dir), _scratch(spark, "pairs"), []
    for version, part in enumerate((lines.where(F.pmod("orderNr", F.lit(2)) == 0), lines)):
        out.append((version, *ST.rebuild_counted(PR.pair_counts(part), root)))
    return spark.createDataFrame(out, "version int, old_pairs long, new_pairs long")


def table_sizes(spark, sf_dir):
    """Files and bytes of every table. No registered query: SQL over the tables can't see their files."""
    parts = [ST.file_sizes(TB.read(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "files", "bytes") for t in _TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
