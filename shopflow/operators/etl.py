"""Catalogue ETL (E1-E11): nested feed products -> flat product table, as column expressions.

Every per-product helper of the reference becomes a built-in expression over
the product's arrays (``filter``/``element_at``/``transform``), so the whole
transform is one narrow projection over the exploded feed plus a first-wins
de-duplication window (E9) keyed by product id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.functions.text import (AGE_PATTERNS, COLOR_PROPERTY_KEYS, DESCRIPTION_ATTRIBUTE_KEYS,
                                     color_from_name, seasons_from_text)
from shopflow.operators.topk import top_k

# Fixed values that must equal the reference's ETL.
PREFERRED_MARKETS = ["b2c_nor", "b2c_swe", "b2b_nor"]
DEFAULT_PRODUCT_TYPE = "main"
DEFAULT_SEASON_RELEVANCY = 0.5
ID_SUFFIX = "_no"


def _truthy(c: Column) -> Column:
    """Python truthiness of an optional string: null and empty are false."""
    return F.when(F.length(c) > 0, c)


def prop(key: str, group: str | None = None) -> Column:
    """F16: value of the first property with ``key`` (and ``keyGroup`` when given)."""
    def match(p):
        m = p["key"] == key
        return m & (p["keyGroup"] == group) if group is not None else m
    return F.try_element_at(F.filter(F.coalesce(F.col("properties"), F.array()), match), F.lit(1))["value"]


def first_prop(*keys: str) -> Column:
    """``prop(a) or prop(b) or ...``: the first truthy value."""
    return F.coalesce(*[_truthy(prop(k)) for k in keys])


def to_int(c: Column) -> Column:
    """``int(float(x))`` with null on failure (truncation toward zero like Python)."""
    d = F.trim(c).try_cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < 2.0 ** 63), d.cast("bigint"))


def brand() -> Column:
    """supplierName, else property Brand / brand, else 'Unknown Brand'."""
    return F.coalesce(_truthy(F.col("supplierName")), first_prop("Brand", "brand"), F.lit("Unknown Brand"))


def category_name() -> Column:
    """Main category's name, else the first category's name (empty when none)."""
    cats = F.coalesce(F.col("categories"), F.array())
    main = F.try_element_at(F.filter(cats, lambda c: F.coalesce(c["isMainCategory"], F.lit(False))
                                     & c["name"].isNotNull()), F.lit(1))
    return F.coalesce(_truthy(main["name"]), _truthy(F.try_element_at(cats, F.lit(1))["name"]))


def description(brand_col: Column) -> Column:
    """Property Description / description, else name, category, supplier and five attributes joined by '. '."""
    parts = [_truthy(F.col("name")),
             F.concat(F.lit("Kategori: "), category_name()),
             F.when(brand_col != "Unknown Brand", F.concat(F.lit("Leverandør: "), brand_col))]
    for k in DESCRIPTION_ATTRIBUTE_KEYS:
        parts.append(F.concat(F.lit(f"{k}: "), _truthy(prop(k))))
    return F.coalesce(first_prop("Description", "description"), F.concat_ws(". ", *parts))


def price_info() -> Column:
    """struct(priceOriginal, priceCurrent, isOnSale) by market preference, last entry per market wins."""
    prices = F.coalesce(F.col("prices"), F.array())
    usable = F.filter(prices, lambda p: p["marketId"].isNotNull() & p["unitPrice"].isNotNull())
    def market(m):
        return F.try_element_at(F.filter(usable, lambda p: p["marketId"] == F.lit(m)), F.lit(-1))  # last entry wins
    chosen = F.coalesce(*[market(m) for m in PREFERRED_MARKETS])
    first = F.try_element_at(F.filter(prices, lambda p: p["unitPrice"].isNotNull()), F.lit(1))

    def pick(p):
        cur = p["unitPrice"]
        orig = F.when(F.coalesce(p["originalUnitPrice"], F.lit(0.0)) != 0, p["originalUnitPrice"]).otherwise(cur)
        return cur, orig
    c_cur, c_orig = pick(chosen)
    f_cur, f_orig = pick(first)
    use_first = chosen.isNull() | ((c_orig == 0) & (c_cur == 0))
    cur = F.coalesce(F.when(use_first, f_cur).otherwise(c_cur), F.lit(0.0))
    orig = F.coalesce(F.when(use_first, f_orig).otherwise(c_orig), F.lit(0.0))
    return F.struct(orig.alias("priceOriginal"), cur.alias("priceCurrent"), (orig > cur).alias("isOnSale"))


def color() -> Column:
    """Colour property (five keys), else the first colour word contained in the name."""
    return F.coalesce(first_prop(*COLOR_PROPERTY_KEYS), color_from_name(F.col("name")))


def age_from_text(text: Column) -> Column:
    """E5 name rule: first matching pattern (month, år, year) -> struct(ageFrom, ageTo, ageBucket)."""
    out = F.lit(None).cast("struct<ageFrom:int,ageTo:int,ageBucket:string>")
    for pat in reversed(AGE_PATTERNS):
        rx = "(?iu)" + pat
        hit = F.regexp_extract(text, rx, 0)
        a, b = F.regexp_extract(text, rx, 1).try_cast("int"), F.regexp_extract(text, rx, 2).try_cast("int")
        unit = F.when(F.lower(hit).contains("month"), " months").otherwise(" years")
        st = F.struct(a.alias("ageFrom"), b.alias("ageTo"),
                      F.concat(a.cast("string"), F.lit(" to "), b.cast("string"), unit).alias("ageBucket"))
        out = F.when(hit != "", st).otherwise(out)
    return out


def age_range() -> Column:
    """E5: properties first (ints via F9, bucket generated from both ends), else the name rule."""
    a = to_int(first_prop("AgeFrom", "MinAge", "ageFrom"))
    b = to_int(first_prop("AgeTo", "MaxAge", "ageTo"))
    bucket = first_prop("AgeBucket", "AgeGroup", "ageBucket")
    gen = F.when(a.isNotNull() & b.isNotNull(), F.concat(a.cast("string"), F.lit(" to "), b.cast("string"), F.lit(" years")))
    from_props = F.struct(a.alias("ageFrom"), b.alias("ageTo"), F.coalesce(bucket, gen).alias("ageBucket"))
    return F.when(a.isNull() & b.isNull() & bucket.isNull() & F.col("name").isNotNull(),
                  F.coalesce(age_from_text(F.col("name")),
                             F.struct(a.alias("ageFrom"), b.alias("ageTo"), bucket.alias("ageBucket")))) \
        .otherwise(from_props)


def stock_level() -> Column:
    """availableInventory, else StockLevel / Stock / Inventory, else 0 (all via F9)."""
    return F.coalesce(to_int(F.col("availableInventory")), to_int(first_prop("StockLevel", "Stock", "Inventory")),
                      F.lit(0))


def seasons() -> Column:
    """Seasons / Season property split on ',' or ';', else keywords in name and category names."""
    v = first_prop("Seasons", "Season")
    split = (F.when(v.contains(","), F.transform(F.split(v, ","), lambda x: F.trim(x)))
             .when(v.contains(";"), F.transform(F.split(v, ";"), lambda x: F.trim(x)))
             .otherwise(F.array(F.trim(v))))
    cat_names = F.array_join(F.transform(F.coalesce(F.col("categories"), F.array()),
                                         lambda c: F.coalesce(c["name"], F.lit(""))), "\u0001")
    return F.when(v.isNotNull(), split).otherwise(seasons_from_text(F.col("name"), cat_names))


def transform_products(feed: DataFrame, skip_if_suffixed: bool = False) -> DataFrame:
    """Drop products without id, keep the first occurrence of each id, build target rows."""
    keep = feed.where(_truthy(F.col("id")).isNotNull())
    keep = top_k(keep, ["id"], [F.asc("_file"), F.asc("_pos")], 1, "_rk").drop("_rk")
    b = brand()
    pi = price_info()
    age = age_range()
    suffixed = F.col("id").endswith(ID_SUFFIX) if skip_if_suffixed else F.lit(False)
    rows = keep.select(
        F.when(suffixed, F.col("id")).otherwise(F.concat(F.col("id"), F.lit(ID_SUFFIX))).alias("id"),
        F.coalesce(_truthy(F.col("name")), F.lit("Unnamed Product")).alias("title"),
        description(b).alias("description"), b.alias("brand"), F.lit("").alias("imageThumbnailUrl"),
        pi.alias("_p"), age.alias("_a"), color().alias("color"), seasons().alias("seasons"),
        F.lit(DEFAULT_PRODUCT_TYPE).alias("productType"), F.lit(DEFAULT_SEASON_RELEVANCY).alias("seasonRelevancyFactor"),
        stock_level().alias("stockLevel"))
    return rows.select("id", "title", "description", "brand", "imageThumbnailUrl",
                       "_p.priceOriginal", "_p.priceCurrent", "_p.isOnSale",
                       "_a.ageFrom", "_a.ageTo", "_a.ageBucket", "color", "seasons", "productType",
                       "seasonRelevancyFactor", "stockLevel")


def rejected_products(feed: DataFrame) -> DataFrame:
    """E9 side output: rows skipped for a missing id or as later duplicates, with the reason."""
    no_id = feed.where(_truthy(F.col("id")).isNull()).select("_file", "_pos", F.col("id"),
                                                             F.lit("missing id").alias("reason"))
    # first occurrence per id by a partial+final aggregate (no per-id window, so a hot id is not one task)
    with_id = feed.where(_truthy(F.col("id")).isNotNull())
    first = with_id.groupBy("id").agg(F.min(F.struct("_file", "_pos")).alias("_first"))
    dups = (with_id.join(first, "id").where(F.struct("_file", "_pos") != F.col("_first"))
            .select("_file", "_pos", "id", F.lit("duplicate id").alias("reason")))
    return no_id.unionByName(dups)


def alternate_mapping(feed: DataFrame) -> DataFrame:
    """The plain mapping without feed rules. The alternative name serves as description (then the
    name), the brand defaults to ``Unknown``, missing prices are 0; supplierItemId, productAttributes
    and alternativeProductName are kept. A missing id is named by the row's position."""
    current = F.coalesce(F.col("price.unitPrice"), F.lit(0.0))
    original = F.coalesce(F.col("price.originalUnitPrice"), F.lit(0.0))
    farge = F.exists(F.coalesce(F.col("properties"), F.array()), lambda p: (p["key"] == "ProductSelector") & (p["value"] == "Farge"))
    return feed.select(
        F.coalesce(F.col("id"), F.concat(F.lit("product_"), F.col("_pos").cast("string"))).alias("id"),
        F.coalesce(F.col("name"), F.lit("Untitled Product")).alias("title"),
        F.coalesce(F.col("alternativeProductName"), F.col("name"), F.lit("No description")).alias("description"),
        F.coalesce(F.col("supplierName"), F.lit("Unknown")).alias("brand"), F.coalesce(F.col("imageUrl"), F.lit("")).alias("imageThumbnailUrl"),
        original.alias("priceOriginal"), current.alias("priceCurrent"), (current < original).alias("isOnSale"),
        F.lit(None).cast("int").alias("ageFrom"), F.lit(None).cast("int").alias("ageTo"), F.lit(None).cast("string").alias("ageBucket"),
        F.when(farge, F.lit("Farge")).alias("color"), F.array().cast("array<string>").alias("seasons"), F.lit("main").alias("productType"),
        F.lit(0.5).alias("seasonRelevancyFactor"), F.coalesce(to_int(F.col("availableInventory")), F.lit(0)).alias("stockLevel"),
        F.coalesce(F.col("supplierItemId"), F.lit("")).alias("supplierItemId"), "productAttributes",
        F.coalesce(F.col("alternativeProductName"), F.lit("")).alias("alternativeProductName"))


def clean_html(html: Column) -> Column:
    """Drop script/style blocks and tags, unescape the five basic entities, collapse whitespace."""
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>", " ")
    t = F.regexp_replace(t, r"(?is)<style\b.*?</style\s*>", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return F.trim(F.regexp_replace(t, r"\s+", " "))
