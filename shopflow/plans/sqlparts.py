"""SQL (DuckDB) renderings of the adapters and request tables, for the oracle side.

They restate the same fixed rules as ``shopflow.sources`` so both engines read
identical inputs; the colour and season lists come from the same constants.
"""

from __future__ import annotations

from shopflow.functions.text import COLOR_WORDS, SEASON_TERMS


def color_sql(name: str) -> str:
    whens = " ".join(f"WHEN contains(lower({name}), '{w}') THEN '{w.capitalize()}'" for w in COLOR_WORDS)
    return f"(CASE {whens} END)"


def seasons_sql(*texts: str) -> str:
    items = []
    for season, terms in SEASON_TERMS.items():
        cond = " OR ".join(f"contains(lower(coalesce({t}, '')), '{term}')" for t in texts for term in terms)
        items.append(f"CASE WHEN {cond} THEN '{season}' END")
    lst = f"list_sort(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL))"
    return f"(CASE WHEN len({lst}) > 0 THEN {lst} END)"


PROD = f"""prod AS (SELECT p_partkey AS id, p_name AS title,
    p_name || '. Kategori: ' || p_type || '. Leverandør: ' || p_brand AS description,
    p_brand AS brand, p_type AS category, lower(p_type) AS cat_id,
    upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS cat_name, lower(p_type) AS cat_slug,
    p_size AS size, p_retailprice AS priceOriginal, p_retailprice AS priceCurrent, false AS isOnSale,
    {color_sql('p_name')} AS color, {seasons_sql('p_name', 'p_type')} AS seasons, 'main' AS productType,
    0.5 AS seasonRelevancyFactor, p_size AS stockLevel FROM part)"""

EVP = """evp AS (SELECT e.event_id, e.event_type, e.user_id, p.p_name, p.p_brand, p.p_retailprice,
       lower(p.p_name) AS lname, split_part(p.p_name, ' ', 1) AS w1, split_part(p.p_name, ' ', 2) AS w2
    FROM events e JOIN part p ON p.p_partkey = CAST(json_extract_string(e.props, '$.k') AS BIGINT))"""

REQ = f"""{EVP},
req0 AS (SELECT event_id AS query_id, event_type,
    CASE event_type WHEN 'view' THEN p_name WHEN 'click' THEN w2 WHEN 'purchase' THEN w1
                    WHEN 'signup' THEN substr(w2, 1, 4) ELSE p_brand END AS query,
    {color_sql('p_name')} AS name_color, p_brand, CAST(floor(p_retailprice) AS BIGINT) AS fp
    FROM evp),
req AS (SELECT query_id, query,
    CASE WHEN event_type = 'purchase' THEN name_color END AS f_color,
    CASE WHEN event_type = 'click' THEN 'false' END AS f_onsale,
    CASE WHEN event_type = 'signup' THEN p_brand END AS f_brand,
    CASE WHEN event_type = 'signup' THEN fp - 50 END AS f_pmin,
    CASE WHEN event_type = 'signup' THEN fp + 50 END AS f_pmax,
    CASE event_type WHEN 'click' THEN 'isOnSale=false'
         WHEN 'purchase' THEN coalesce('color=' || name_color, '')
         WHEN 'signup' THEN 'brand=' || p_brand || '&priceRange.max=' || CAST(fp + 50 AS VARCHAR)
                            || '&priceRange.min=' || CAST(fp - 50 AS VARCHAR)
         ELSE '' END AS filter_key,
    10 AS lim, CASE WHEN event_type = 'view' THEN 5 ELSE 0 END AS off FROM req0)"""

SUGGEST = f"""{EVP},
sreq AS (SELECT event_id AS query_id,
    CASE event_type WHEN 'view' THEN substr(lname, 1, 2) WHEN 'click' THEN substr(lname, 1, 3)
                    WHEN 'purchase' THEN substr(lname, 1, 4) WHEN 'signup' THEN substr(lower(w2), 1, 5)
                    ELSE substr(lower(w2), 1, 1) || substr(lower(w2), 3) END AS prefix,
    5 AS lim FROM evp)"""

FILTER_OK = """(k.f_color IS NULL OR p.color = k.f_color)
      AND (k.f_onsale IS NULL OR CAST(coalesce(p.isOnSale, false) AS VARCHAR) = k.f_onsale)
      AND (k.f_pmin IS NULL OR coalesce(p.priceCurrent, 0) >= k.f_pmin)
      AND (k.f_pmax IS NULL OR coalesce(p.priceCurrent, 0) <= k.f_pmax)"""

MATCHED = f"""keys AS (SELECT DISTINCT lower(query) AS qn, filter_key, f_color, f_onsale, f_brand, f_pmin, f_pmax FROM req),
m AS (SELECT k.qn, k.filter_key, p.id FROM keys k JOIN prod p
      ON (contains(lower(p.title), k.qn) OR contains(lower(p.description), k.qn) OR contains(lower(p.brand), k.qn))
      AND {FILTER_OK} AND (k.f_brand IS NULL OR p.brand = k.f_brand)),
tot AS (SELECT qn, filter_key, COUNT(*) AS total FROM m GROUP BY qn, filter_key)"""
