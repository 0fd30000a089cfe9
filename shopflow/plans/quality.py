"""Catalogue quality queries (Q1-Q12, A22-A25) over the product table."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopflow.operators import quality as Q
from shopflow.plans.registry import register
from shopflow.plans.sqlparts import PROD
from shopflow.sources import tables as TB

MODEL = """model AS (SELECT id, title, description, brand, priceOriginal, priceCurrent, isOnSale, color, seasons,
       productType, seasonRelevancyFactor, stockLevel, '' AS imageThumbnailUrl FROM prod)"""

_V = """v AS (
  SELECT CAST(id AS VARCHAR) AS id, 'required_missing' AS rule_id, f AS field, 'Required field ''' || f || ''' is missing' AS message
  FROM (SELECT id, unnest(['id','title','description','brand','priceOriginal','priceCurrent','isOnSale','productType',
                           'seasonRelevancyFactor','stockLevel']) AS f,
               unnest([id IS NULL, title IS NULL, description IS NULL, brand IS NULL, priceOriginal IS NULL,
                       priceCurrent IS NULL, isOnSale IS NULL, productType IS NULL, seasonRelevancyFactor IS NULL,
                       stockLevel IS NULL]) AS missing FROM model) WHERE missing
  UNION ALL SELECT CAST(id AS VARCHAR), 'too_short', 'title', 'Field ''title'' is too short (' || length(title) || ' chars, min 2)' FROM model WHERE length(title) < 2
  UNION ALL SELECT CAST(id AS VARCHAR), 'too_long', 'title', 'Field ''title'' is too long (' || length(title) || ' chars, max 200)' FROM model WHERE length(title) > 200
  UNION ALL SELECT CAST(id AS VARCHAR), 'too_short', 'description', 'Field ''description'' is too short (' || length(description) || ' chars, min 5)' FROM model WHERE length(description) < 5
  UNION ALL SELECT CAST(id AS VARCHAR), 'too_long', 'description', 'Field ''description'' is too long (' || length(description) || ' chars, max 2000)' FROM model WHERE length(description) > 2000
  UNION ALL SELECT CAST(id AS VARCHAR), 'too_short', 'brand', 'Field ''brand'' is too short (' || length(brand) || ' chars, min 1)' FROM model WHERE length(brand) < 1
  UNION ALL SELECT CAST(id AS VARCHAR), 'too_long', 'brand', 'Field ''brand'' is too long (' || length(brand) || ' chars, max 100)' FROM model WHERE length(brand) > 100
  UNION ALL SELECT CAST(id AS VARCHAR), 'pattern', 'id', 'Field ''id'' does not match required pattern' FROM model WHERE NOT regexp_matches(CAST(id AS VARCHAR), '^[a-zA-Z0-9_-]+')
  UNION ALL SELECT CAST(id AS VARCHAR), 'too_small', 'priceOriginal', 'Field ''priceOriginal'' is too small (' || CAST(priceOriginal AS VARCHAR) || ', min 0)' FROM model WHERE priceOriginal < 0
  UNION ALL SELECT CAST(id AS VARCHAR), 'too_small', 'priceCurrent', 'Field ''priceCurrent'' is too small (' || CAST(priceCurrent AS VARCHAR) || ', min 0)' FROM model WHERE priceCurrent < 0
  UNION ALL SELECT CAST(id AS VARCHAR), 'too_small', 'seasonRelevancyFactor', 'Field ''seasonRelevancyFactor'' is too small (' || CAST(seasonRelevancyFactor AS VARCHAR) || ', min 0)' FROM model WHERE seasonRelevancyFactor < 0
  UNION ALL SELECT CAST(id AS VARCHAR), 'too_small', 'stockLevel', 'Field ''stockLevel'' is too small (' || CAST(stockLevel AS VARCHAR) || ', min 0)' FROM model WHERE stockLevel < 0
  UNION ALL SELECT CAST(id AS VARCHAR), 'too_large', 'seasonRelevancyFactor', 'Field ''seasonRelevancyFactor'' is too large (' || CAST(seasonRelevancyFactor AS VARCHAR) || ', max 1)' FROM model WHERE seasonRelevancyFactor > 1
  UNION ALL SELECT CAST(id AS VARCHAR), 'sale_flag', 'isOnSale', 'isOnSale is False but priceOriginal (' || CAST(priceOriginal AS VARCHAR) || ') > priceCurrent (' || CAST(priceCurrent AS VARCHAR) || ')' FROM model WHERE priceOriginal > priceCurrent AND NOT isOnSale
  UNION ALL SELECT CAST(id AS VARCHAR), 'sale_flag', 'isOnSale', 'isOnSale is True but priceOriginal (' || CAST(priceOriginal AS VARCHAR) || ') <= priceCurrent (' || CAST(priceCurrent AS VARCHAR) || ')' FROM model WHERE priceOriginal <= priceCurrent AND isOnSale)"""


def _model(spark, sf_dir):
    return TB.products(spark, sf_dir).drop("category", "categories", "size")


@register("rule_violations", f"WITH {PROD}, {MODEL}, {_V} SELECT * FROM v")
def rule_violations(spark, sf_dir):
    return Q.violations(_model(spark, sf_dir))


@register("validation_summary", f"""WITH {PROD}, {MODEL}, {_V}
SELECT (SELECT COUNT(*) FROM model) AS total_products,
       (SELECT COUNT(*) FROM model WHERE CAST(id AS VARCHAR) NOT IN (SELECT id FROM v)) AS valid_products,
       (SELECT COUNT(DISTINCT id) FROM v) AS invalid_products""")
def validation_summary(spark, sf_dir):
    return Q.summary(_model(spark, sf_dir))


@register("error_histogram", f"""WITH {PROD}, {MODEL}, {_V}
SELECT rule_id, field, COUNT(*) AS count FROM v GROUP BY ALL ORDER BY count DESC, rule_id, field LIMIT 5""")
def error_histogram(spark, sf_dir):
    return Q.error_histogram(_model(spark, sf_dir))


_COV_FIELDS = Q.REQUIRED_FIELDS + Q.OPTIONAL_FIELDS


@register("field_coverage", f"""WITH {PROD}, {MODEL},
c AS (SELECT COUNT(*) AS n, {', '.join(f'COUNT({f}) AS "{f}"' if f not in ('ageFrom', 'ageTo', 'ageBucket') else f'0 AS "{f}"' for f in _COV_FIELDS)} FROM model)
SELECT field, CAST(count AS BIGINT) AS count,
       CASE WHEN n > 0 THEN ROUND(count * 100.0 / n, 2) ELSE 0.0 END::DOUBLE AS percentage
FROM (UNPIVOT c ON {', '.join(f'"{f}"' for f in _COV_FIELDS)} INTO NAME field VALUE count)""")
def field_coverage(spark, sf_dir):
    return Q.field_coverage(_model(spark, sf_dir))


@register("duplicate_ids", """
WITH d AS (SELECT p_partkey AS id, COUNT(*) AS occurrences FROM part GROUP BY 1 HAVING COUNT(*) > 1)
SELECT d.*, (SELECT COUNT(*) FROM d) AS duplicate_count FROM d ORDER BY id LIMIT 10""")
def duplicate_ids(spark, sf_dir):
    return Q.duplicate_ids(_model(spark, sf_dir))


@register("duplicate_orderline_keys", """
WITH d AS (SELECT l_orderkey || '-' || l_partkey AS id, COUNT(*) AS occurrences FROM lineitem GROUP BY 1 HAVING COUNT(*) > 1)
SELECT d.*, (SELECT COUNT(*) FROM d) AS duplicate_count FROM d ORDER BY id LIMIT 10""")
def duplicate_orderline_keys(spark, sf_dir):
    li = TB.read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("id"))
    return Q.duplicate_ids(li)


# Raw texts read as if they were product records, so that every kind of rule finds failures.
_DOC_MODEL = """model AS (SELECT substr(text, 1, 9) AS id, string_split(text, chr(10))[1] AS title, text AS description, source AS brand,
       n_chars - 400 AS priceOriginal, length(text) % 1000 - 100 AS priceCurrent, lang = 'en' AS isOnSale, lang AS color,
       CAST(NULL AS VARCHAR[]) AS seasons, nullif(lang, 'de') AS productType, n_chars / 2000.0::DOUBLE AS seasonRelevancyFactor,
       n_chars - 300 AS stockLevel, '' AS imageThumbnailUrl FROM documents)"""


def _doc_model(spark, sf_dir):
    d = TB.read(spark, sf_dir, "documents")
    n = F.length("text").cast("bigint")
    return d.select(F.substring("text", 1, 9).alias("id"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("description"),
                    F.col("source").alias("brand"), (F.col("n_chars") - 400).alias("priceOriginal"), (n % 1000 - 100).alias("priceCurrent"),
                    (F.col("lang") == "en").alias("isOnSale"), F.col("lang").alias("color"), F.lit(None).cast("array<string>").alias("seasons"),
                    F.nullif(F.col("lang"), F.lit("de")).alias("productType"), (F.col("n_chars") / F.lit(2000.0)).alias("seasonRelevancyFactor"),
                    (F.col("n_chars") - 300).alias("stockLevel"), F.lit("").alias("imageThumbnailUrl"))


@register("document_rule_violations", f"WITH {_DOC_MODEL}, {_V} SELECT * FROM v")
def document_rule_violations(spark, sf_dir):
    """Q1-Q12 on records that break the rules."""
    return Q.violations(_doc_model(spark, sf_dir))


@register("document_validation_summary", f"""WITH {_DOC_MODEL}
SELECT COUNT(*) AS total_products, COUNT(*) FILTER (WHERE NOT b) AS valid_products, COUNT(*) FILTER (WHERE b) AS invalid_products
FROM (SELECT priceOriginal < 0 OR priceCurrent < 0 OR stockLevel < 0 OR seasonRelevancyFactor > 1 OR productType IS NULL
        OR length(title) NOT BETWEEN 2 AND 200 OR length(description) NOT BETWEEN 5 AND 2000
        OR NOT regexp_matches(id, '^[a-zA-Z0-9_-]+') OR (priceOriginal > priceCurrent) <> isOnSale AS b FROM model)""")
def document_validation_summary(spark, sf_dir):
    return Q.summary(_doc_model(spark, sf_dir))


@register("document_error_histogram", f"""WITH {_DOC_MODEL}, {_V}
SELECT rule_id, field, COUNT(*) AS count FROM v GROUP BY ALL ORDER BY count DESC, rule_id, field LIMIT 5""")
def document_error_histogram(spark, sf_dir):
    return Q.error_histogram(_doc_model(spark, sf_dir))


@register("document_duplicate_ids", f"""WITH {_DOC_MODEL},
d AS (SELECT id, COUNT(*) AS occurrences FROM model GROUP BY 1 HAVING COUNT(*) > 1)
SELECT d.*, (SELECT COUNT(*) FROM d) AS duplicate_count FROM d ORDER BY id LIMIT 10""")
def document_duplicate_ids(spark, sf_dir):
    return Q.duplicate_ids(_doc_model(spark, sf_dir))
