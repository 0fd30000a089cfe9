"""Catalogue search over a table of requests.

Every request table is first reduced to its distinct search keys (lower-cased
text + canonical filter text, the F19 fingerprint); matching runs once per key
and results are joined back to the requests. A query repeated by a third of all
requests therefore costs one match, and the join back is an equi-join that
adaptive execution can split when one key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.functions.text import quote_regex
from shopflow.operators import textmatch as TM
from shopflow.operators.topk import top_k
from shopflow.session import dealt, lookup, written

SEP = "\u0001"  # field separator that cannot occur in a query

# Product fields a filter map may name, by how the value text is compared.
STRING_FIELDS = ["title", "description", "brand", "color", "productType", "category", "imageThumbnailUrl",
                 "ageBucket"]
NUMBER_FIELDS = ["id", "priceOriginal", "priceCurrent", "stockLevel", "size", "seasonRelevancyFactor",
                 "ageFrom", "ageTo"]
BOOL_FIELDS = ["isOnSale"]
ARRAY_FIELDS = ["seasons"]
PRICE_MIN, PRICE_MAX = "priceRange.min", "priceRange.max"


def filter_predicate(products_cols: list[str], filters: Column, only: list[str] | None = None) -> Column:
    """Every filter entry holds for the product row.

    Scalars compare by equality (strings exactly, booleans as ``true``/``false``,
    numbers numerically), array fields mean "contains", ``priceRange.min/max`` is
    an inclusive range on ``priceCurrent`` (missing price = 0). A key naming a
    field the product does not have never matches. With ``only``, keys outside
    that list are ignored (the offline search reads only price, colour and sale).
    """
    def entry_ok(e):
        k, v = e["key"], e["value"]
        expr = F.lit(False)
        price = F.coalesce(F.col("priceCurrent"), F.lit(0.0)) if "priceCurrent" in products_cols else F.lit(0.0)
        rules = [(PRICE_MIN, price >= F.coalesce(v.try_cast("double"), F.lit(0.0))),
                 (PRICE_MAX, price <= F.coalesce(v.try_cast("double"), F.lit(float("inf"))))]
        for c in products_cols:
            if c in STRING_FIELDS:
                rules.append((c, F.col(c) == v))
            elif c in NUMBER_FIELDS:
                rules.append((c, F.col(c).cast("double") == v.try_cast("double")))
            elif c in BOOL_FIELDS:
                rules.append((c, F.coalesce(F.col(c), F.lit(False)).cast("string") == F.lower(v)))
            elif c in ARRAY_FIELDS:
                rules.append((c, F.array_contains(F.col(c), v)))
        for name, cond in reversed(rules):
            if only is not None and name not in only:
                continue
            expr = F.when(k == name, F.coalesce(cond, F.lit(False))).otherwise(expr)
        if only is not None:
            expr = F.when(~k.isin(*only), F.lit(True)).otherwise(expr)
        return expr
    return F.coalesce(F.forall(F.coalesce(F.map_entries(filters),
                                          F.array().cast("array<struct<key:string,value:string>>")),
                               entry_ok), F.lit(True))


def max_of(df: DataFrame, expr: Column) -> int | None:
    """A literal upper bound for per-request limits (one small aggregate read on the driver)."""
    v = df.agg(F.max(expr)).first()[0]
    return int(v) if v is not None else None


def search_keys(requests: DataFrame) -> DataFrame:
    """Distinct (qn, filter_key) with the filter map and the deepest page any request asks for."""
    return (requests.groupBy(F.lower(F.col("query")).alias("qn"), "filter_key")
            .agg(F.any_value("filters").alias("filters"),
                 F.max(F.col("off") + F.col("lim")).alias("max_end")))


def _product_text(products: DataFrame, fields: list[str]) -> DataFrame:
    return products.select("id", F.concat_ws(SEP, *[F.coalesce(F.col(f), F.lit("")) for f in fields]).alias("text"))


def filtered(pairs: DataFrame, keys: DataFrame, products: DataFrame, only: list[str] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(qn, filter_key, id, *carry): ``pairs(qn, id)`` for each filter of the query that the product passes.

    Products come in by id, with the fields that some filter names, before a query's filters multiply its rows."""
    known = {*STRING_FIELDS, *NUMBER_FIELDS, *BOOL_FIELDS, *ARRAY_FIELDS, PRICE_MIN, PRICE_MAX}
    named = keys.select(F.explode(F.map_keys("filters")).alias("k")).where(F.col("k").isin(*known)).distinct()
    used = {"priceCurrent" if r["k"] in (PRICE_MIN, PRICE_MAX) else r["k"] for r in named.collect()}
    cols = [c for c in products.columns if c == "id" or c in used or c in carry]
    pred = filter_predicate(cols, F.col("filters"), only)
    return (pairs.join(products.select(cols).hint("merge"), "id")
            .join(lookup(keys.select("qn", "filter_key", "filters")), "qn").where(pred)
            .select("qn", "filter_key", "id", *carry))


def matched_set(requests: DataFrame, products: DataFrame, fields: tuple[str, ...] = ("title", "description", "brand"),
                keys: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """T7 match: (qn, filter_key, id, *carry) for substring hits that pass the request's filters. ``carry`` names
    product columns that come along."""
    keys = keys if keys is not None else written(search_keys(requests), "keys")
    hits = TM.substring_matches(keys.select(F.col("qn").alias("q")), dealt(_product_text(products, list(fields))))
    return filtered(hits.withColumnRenamed("q", "qn"), keys, products, carry=carry)


def _titled(ranked: DataFrame, products: DataFrame, *cols: str) -> DataFrame:
    """``ranked`` with product columns, while it holds a few rows for each query and not yet for each request."""
    return ranked.join(products.select("id", *cols).hint("merge"), "id")


def search_page(requests: DataFrame, products: DataFrame) -> DataFrame:
    """T7 + W2 + D4: per request the page ``off+1..off+lim`` (id order) and the pre-pagination total."""
    all_keys = written(search_keys(requests), "keys")
    m = matched_set(requests, products, keys=all_keys)
    totals = m.groupBy("qn", "filter_key").agg(F.count(F.lit(1)).alias("total"))
    ranked = top_k(m, ["qn", "filter_key"], [F.asc("id")], max_of(all_keys, F.col("max_end")) or 0)
    shown = _titled(ranked.join(totals.hint("merge"), ["qn", "filter_key"]), products, "title")
    req = requests.select("query_id", F.lower("query").alias("qn"), "filter_key", "off", "lim")
    return (req.join(lookup(written(shown, "shown")), ["qn", "filter_key"])
            .where((F.col("rank") > F.col("off")) & (F.col("rank") <= F.col("off") + F.col("lim")))
            .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "title",
                    F.col("total").cast("bigint").alias("total")))


def search_totals(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Total matches per request (0 when nothing matches)."""
    totals = matched_set(requests, products).groupBy("qn", "filter_key").agg(F.count(F.lit(1)).alias("total"))
    req = requests.select("query_id", F.lower("query").alias("qn"), "filter_key")
    return (req.join(lookup(written(totals, "totals")), ["qn", "filter_key"], "left")
            .select("query_id", F.coalesce(F.col("total"), F.lit(0)).cast("bigint").alias("total")))


def _facet_values(df: DataFrame, fields: list[str]) -> DataFrame:
    """Stack facet fields into (field, value) rows in one pass: one ``explode`` of an array of
    (field, value) structs, arrays unwound into it; nulls dropped."""
    types = dict(df.dtypes)

    def tagged(name):  # binds the field name; a two-argument lambda would mean (element, index)
        return lambda x: F.struct(F.lit(name).alias("field"), x.cast("string").alias("value"))
    pairs = []
    for f in fields:
        if types[f].startswith("array"):
            pairs.append(F.transform(F.coalesce(F.col(f), F.array().cast(types[f])), tagged(f)))
        else:
            pairs.append(F.array(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))))
    keep = [c for c in df.columns if c not in fields]
    return (df.select(*keep, F.explode(F.concat(*pairs)).alias("_fv"))
            .select(*keep, "_fv.field", "_fv.value").where(F.col("value").isNotNull()))


def facets(df: DataFrame, group: list[str], fields: list[str], top: int = 10) -> DataFrame:
    """A1/A2: per group and field, the ``top`` most frequent values (ties by value)."""
    counts = _facet_values(df.select(*group, *fields), fields).groupBy(*group, "field", "value").agg(
        F.count(F.lit(1)).alias("count"))
    return top_k(counts, [*group, "field"], [F.desc("count"), F.asc("value")], top).select(
        *group, "field", "value", F.col("count").cast("bigint").alias("count"),
        F.col("rank").cast("int").alias("rank"))


def facets_matched(requests: DataFrame, products: DataFrame) -> DataFrame:
    """A2: facets over each search key's matched set, whatever its size."""
    m = matched_set(requests, products)
    fields = ["brand", "color", "productType", "isOnSale", "seasons"]
    rows = m.join(products.select("id", *fields).hint("merge"), "id")
    return facets(rows, ["qn", "filter_key"], fields).withColumnRenamed("qn", "query")


def any_term_search(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Any whitespace term of the query contained in title, description or brand;
    price range / colour / sale filters; first ``lim`` by id and the total."""
    keys = written(search_keys(requests), "keys")
    terms = (keys.select("qn", F.explode(F.split(F.trim("qn"), r"\s+")).alias("term"))
             .where(F.length("term") > 0).distinct())
    terms = written(terms, "terms")
    hits = TM.substring_matches(terms.select(F.col("term").alias("q")),
                                dealt(_product_text(products, ["title", "description", "brand"])))
    pairs = hits.join(lookup(terms), hits.q == F.col("term")).select("qn", "id").distinct()
    m = filtered(pairs, keys, products, only=[PRICE_MIN, PRICE_MAX, "color", "isOnSale"])
    totals = m.groupBy("qn", "filter_key").agg(F.count(F.lit(1)).alias("total"))
    ranked = top_k(m, ["qn", "filter_key"], [F.asc("id")], max_of(keys, F.col("max_end")) or 0)
    shown = _titled(ranked.join(totals.hint("merge"), ["qn", "filter_key"]), products, "title")
    req = requests.select("query_id", F.lower("query").alias("qn"), "filter_key", "lim")
    return (req.join(lookup(written(shown, "shown")), ["qn", "filter_key"]).where(F.col("rank") <= F.col("lim"))
            .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "title",
                    F.col("total").cast("bigint").alias("total")))


def prefix_suggest(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Titles starting with the prefix (case-insensitive), first ``lim`` by id."""
    keys = requests.groupBy("prefix").agg(F.max("lim").alias("max_lim"))
    hits = TM.prefix_matches(keys, dealt(products.select("id", "title")))
    ranked = top_k(hits, ["prefix"], [F.asc("id")], max_of(requests, F.col("lim")) or 0)
    shown = (_titled(ranked, products, "title", "brand").groupBy("prefix")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "id", "title", "brand"))).alias("l")))
    return (requests.join(lookup(written(shown, "shown")), "prefix").select("query_id", "lim", F.inline("l")).where(F.col("rank") <= F.col("lim"))
            .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "title", "brand"))


def fuzzy_suggest(requests: DataFrame, products: DataFrame, min_gram: int = 2) -> DataFrame:
    """Autocomplete on title tokens' edge grams with at most one edit.

    Score 2 for an exact gram, 1 for a one-edit gram; order score desc, id asc.
    """
    keys = requests.groupBy("prefix").agg(F.max("lim").alias("max_lim"))
    grams = TM.token_edge_grams(products, min_gram)
    close = TM.one_edit_matches(keys.select(F.col("prefix").alias("q")), grams)
    hits = (close.join(grams, "gram").groupBy(F.col("q").alias("prefix"), "id")
            .agg(F.min("dist").alias("dist"))
            .withColumn("score", F.when(F.col("dist") == 0, 2.0).otherwise(1.0)))
    ranked = top_k(hits, ["prefix"], [F.desc("score"), F.asc("id")], max_of(requests, F.col("lim")) or 0)
    return (requests.join(ranked, "prefix").where(F.col("rank") <= F.col("lim"))
            .join(products.select("id", "title", "brand"), "id")
            .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "title", "brand", "score"))


def _asked(queries: DataFrame, max_col: str) -> DataFrame:
    """(query, mx): each distinct query with the largest number of results that any request wants of it."""
    return queries.groupBy("query").agg(F.max(max_col).alias("mx"))


def _first(df: DataFrame, order: list, most: int | None, times: int = 1, rank_col: str = "rank",
           asked: DataFrame | None = None) -> DataFrame:
    """The first ``times * mx`` rows of each query: the largest limit of all as a literal, so that a
    popular query is cut before the shuffle, then each query's own (``mx`` of ``asked``, if ``df`` has none;
    its rows lie where the cut's do, and are never broadcast)."""
    cut = top_k(df, ["query"], order, (most or 0) * times, rank_col)
    if asked is not None:
        cut = cut.join(asked.hint("merge"), "query")
    return cut.where(F.col(rank_col) <= F.col("mx") * times)


def category_search(queries: DataFrame, products: DataFrame, max_col: str = "max_categories") -> DataFrame:
    """Categories whose name or slug contains the query; product count per category id."""
    cats = products.select("id", F.explode("categories").alias("c")).select(
        F.col("id").alias("pid"), F.col("c.id").alias("cid"), F.col("c.name").alias("name"),
        F.col("c.slug").alias("slug"))
    dim = cats.groupBy("cid", "name", "slug").agg(F.count(F.lit(1)).alias("n"))
    dim_text = dim.select(F.concat_ws(SEP, "cid", "name", "slug").alias("key"),
                          F.concat_ws(SEP, F.coalesce("name", F.lit("")), F.coalesce("slug", F.lit(""))).alias("text"),
                          "cid", "name", "slug", "n")
    qs = _asked(queries, max_col)
    hits = TM.substring_matches(qs.select(F.col("query").alias("q")), dim_text, "q", "key", "text")
    per_cat = (hits.join(dim_text.hint("merge"), "key").groupBy(F.col("q").alias("query"), "cid")
               .agg(F.min("name").alias("name"), F.min("slug").alias("slug"), F.sum("n").alias("product_count")))
    ranked = _first(per_cat, [F.desc("product_count"), F.asc("cid")], max_of(queries, F.col(max_col)), asked=qs)
    return ranked.select("query", F.col("rank").cast("int").alias("rank"), F.col("cid").alias("id"), "name", "slug",
                         F.col("product_count").cast("bigint").alias("product_count"))


def brand_search(queries: DataFrame, products: DataFrame, max_col: str = "max_brands") -> DataFrame:
    """A4: brands containing the query (case-insensitive) with product counts."""
    brands = products.where(F.col("brand").isNotNull()).groupBy("brand").agg(F.count(F.lit(1)).alias("n"))
    qs = _asked(queries, max_col)
    hits = TM.substring_matches(qs.select(F.col("query").alias("q")),
                                brands.select(F.col("brand").alias("key"), F.col("brand").alias("text")),
                                "q", "key", "text")
    per = hits.join(brands.hint("merge"), hits.key == F.col("brand")).select(F.col("q").alias("query"), "brand", "n")
    ranked = _first(per, [F.desc("n"), F.asc("brand")], max_of(queries, F.col(max_col)), asked=qs)
    return ranked.select("query", F.col("rank").cast("int").alias("rank"), F.col("brand").alias("id"),
                         F.col("brand").alias("name"), F.col("n").cast("bigint").alias("product_count"))


def consolidated_candidates(queries: DataFrame, products: DataFrame, max_col: str = "max_products") -> DataFrame:
    """R4's text strategies: exact whole-word (score 1.0, first max by id), then substring (0.8, first 2*max by id,
    queries of 3+ characters, exact ids removed)."""
    qs = written(_asked(queries, max_col), "queries")
    text = _product_text(products, ["title", "description"])
    hits = TM.substring_matches(qs.select(F.col("query").alias("q")), dealt(text))
    pat = F.concat(F.lit("(?iU)\\b"), quote_regex(F.col("q")), F.lit("\\b"))
    cand = hits.join(text.hint("merge"), "id").select("id", F.col("q").alias("query"), F.regexp(F.col("text"), pat).alias("is_exact"))
    cand = written(cand, "candidates").join(lookup(qs), "query")
    most = max_of(queries, F.col(max_col))
    exact = _first(cand.where("is_exact"), [F.asc("id")], most, rank_col="erank")
    sub = _first(cand.where(F.length("query") >= 3), [F.asc("id")], most, 2, "srank")
    ngram = sub.join(exact.select("query", "id").hint("merge"), ["query", "id"], "left_anti")
    return (exact.select("query", "id", "mx", F.lit(1.0).alias("score"), F.lit("exact").alias("matchType"),
                           F.lit(0).alias("src"), F.col("erank").alias("srank"))
              .unionByName(ngram.select("query", "id", "mx", F.lit(0.8).alias("score"), F.lit("ngram").alias("matchType"),
                                        F.lit(1).alias("src"), "srank")))


def consolidated_products(queries: DataFrame, products: DataFrame, max_col: str = "max_products") -> DataFrame:
    """R4 without vectors: the text strategies' products by score, cut to max."""
    merged, most = consolidated_candidates(queries, products, max_col), max_of(queries, F.col(max_col))
    ranked = _first(merged, [F.desc("score"), F.asc("src"), F.asc("srank")], most)
    return (_titled(ranked, products, "title")
            .select("query", F.col("rank").cast("int").alias("rank"), "id", "title", "score", "matchType"))


def consolidated_summary(requests: DataFrame, products: DataFrame, min_len: int = 3) -> DataFrame:
    """Per request the number of categories, brands and products; short queries rejected."""
    # each distinct query is searched once, with the most that any request wants of it; requests are read again at the end
    most = ["max_categories", "max_brands", "max_products"]
    adm = written(requests.where(F.length("query") >= min_len).groupBy("query").agg(*[F.max(c).alias(c) for c in most]), "admitted")
    names = ["n_categories", "n_brands", "n_products"]
    found = [search(adm, products) for search in (category_search, brand_search, consolidated_products)]
    kinds = [f.select("query", *[F.lit(int(c == name)).alias(c) for c in names]) for f, name in zip(found, names, strict=True)]
    counts = (kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
              .groupBy("query").agg(*[F.sum(c).alias(c) for c in names]))
    out = (requests.join(lookup(written(counts, "counts")), "query", "left")
           .select("query_id", "query", (F.length("query") >= min_len).alias("admitted"),
                   *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in names]))
    return out.withColumn("total_results", F.col("n_categories") + F.col("n_brands") + F.col("n_products"))


def ngram_search(requests: DataFrame, products: DataFrame, min_gram: int = 3, max_gram: int = 4) -> DataFrame:
    """T5: partial-word match on title n-grams (lengths ``min_gram..max_gram`` over the lower-cased
    text, token order irrelevant). Score = share of the query's distinct grams found in the title;
    order score desc, id asc; first ``lim`` per request."""
    def grams(c):
        arrs = [TM._grams(F.lower(c), n) for n in range(min_gram, max_gram + 1)]
        return F.array_distinct(F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrs])))
    qs = requests.groupBy(F.lower("query").alias("qn")).agg(F.max("lim").alias("max_lim"))
    qg = written(qs.select("qn", F.size(grams(F.col("qn"))).alias("nq"), F.explode(grams(F.col("qn"))).alias("gram")), "grams")
    pg = dealt(products.select("id", "title")).select("id", F.explode(grams(F.col("title"))).alias("gram"))
    hits = (pg.join(lookup(qg), "gram").groupBy("qn", "nq", "id").agg(F.count(F.lit(1)).alias("hit"))
            .select("qn", "id", F.round(F.col("hit") / F.col("nq"), 6).alias("score")))
    ranked = top_k(hits, ["qn"], [F.desc("score"), F.asc("id")], max_of(requests, F.col("lim")) or 0)
    req = requests.select("query_id", F.lower("query").alias("qn"), "lim")
    return (req.join(lookup(written(ranked, "shown")), "qn").where(F.col("rank") <= F.col("lim"))
            .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"))
