"""Feed ETL and text-attribute queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopflow.operators import etl as E
from shopflow.plans.registry import register
from shopflow.plans.sqlparts import color_sql, seasons_sql
from shopflow.sources import feed as FD
from shopflow.sources import tables as TB


def _age_sql(t: str) -> str:
    pats = [r"(\d+)-(\d+)\s+month", r"(\d+)-(\d+)\s+år", r"(\d+)-(\d+)\s+year"]
    parts = []
    for p in pats:
        rx = "(?i)" + p
        parts.append((f"regexp_extract({t}, '{rx}', 0)", f"TRY_CAST(regexp_extract({t}, '{rx}', 1) AS INTEGER)",
                      f"TRY_CAST(regexp_extract({t}, '{rx}', 2) AS INTEGER)"))
    def pick(i):
        whens = " ".join(f"WHEN {h} <> '' THEN {x[i]}" for h, *x in [(a, b, c) for a, b, c in parts])
        return f"(CASE {whens} END)"
    bucket_whens = " ".join(
        f"WHEN {h} <> '' THEN CAST({a} AS VARCHAR) || ' to ' || CAST({b} AS VARCHAR) || "
        f"CASE WHEN contains(lower({h}), 'month') THEN ' months' ELSE ' years' END" for h, a, b in parts)
    return pick(0), pick(1), f"(CASE {bucket_whens} END)"


_AF, _AT, _AB = _age_sql("p_name")


@register("feed_transform", f"""
WITH li AS (SELECT l_partkey AS p_partkey, SUM(l_quantity) AS qty, MAX(l_discount) AS maxdisc FROM lineitem GROUP BY 1),
p AS (SELECT * FROM part LEFT JOIN li USING (p_partkey))
SELECT CAST(p_partkey AS VARCHAR) || '_no' AS id, p_name AS title,
       p_name || '. Kategori: ' || p_type || '. Leverandør: ' || p_brand || '. Material: ' || p_type
              || '. Size: ' || CAST(p_size AS VARCHAR) AS description,
       p_brand AS brand, '' AS imageThumbnailUrl,
       CASE WHEN maxdisc IS NULL THEN 0.0 ELSE p_retailprice END AS priceOriginal,
       CASE WHEN maxdisc IS NULL THEN 0.0 ELSE p_retailprice * (1 - maxdisc) END AS priceCurrent,
       CASE WHEN maxdisc IS NULL THEN false ELSE p_retailprice > p_retailprice * (1 - maxdisc) END AS isOnSale,
       {_AF} AS ageFrom, {_AT} AS ageTo, {_AB} AS ageBucket,
       {color_sql('p_name')} AS color, {seasons_sql('p_name', 'p_type')} AS seasons,
       'main' AS productType, 0.5 AS seasonRelevancyFactor,
       coalesce(CAST(trunc(qty) AS INTEGER), 0) AS stockLevel
FROM p""")
def feed_transform(spark, sf_dir):
    """S1 -> E1..E9 over the nested feed derived from the tables."""
    return E.transform_products(FD.feed_from_tables(spark, sf_dir))


_DF, _DT, _DB = _age_sql("text")


@register("text_attributes", f"""
SELECT doc_id, {color_sql('text')} AS color, {seasons_sql('text')} AS seasons,
       {_DF} AS ageFrom, {_DT} AS ageTo, {_DB} AS ageBucket FROM documents""")
def text_attributes(spark, sf_dir):
    """E4/E5/E7 name rules applied to whole document texts."""
    from shopflow.functions.text import color_from_name, seasons_from_text
    d = TB.read(spark, sf_dir, "documents")
    age = E.age_from_text(F.col("text"))
    return d.select("doc_id", color_from_name(F.col("text")).alias("color"),
                    seasons_from_text(F.col("text")).alias("seasons"),
                    age["ageFrom"].alias("ageFrom"), age["ageTo"].alias("ageTo"), age["ageBucket"].alias("ageBucket"))


@register("html_clean", r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(t, '(?is)<style\b.*?</style\s*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(t, '<[^>]*>', ' ', 'g') AS t FROM b),
d AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM c)
SELECT page_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text, length(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS n_chars FROM d""")
def html_clean(spark, sf_dir):
    """Visible text of raw pages."""
    t = E.clean_html(F.col("html"))
    return TB.read(spark, sf_dir, "pages").select("page_id", t.alias("text"), F.length(t).alias("n_chars"))
