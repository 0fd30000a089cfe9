"""Catalogue validation (Q1-Q12) and its report (A22-A25) as column jobs over the whole table.

Each rule is a column predicate; a row's failures are collected into an array
with ``array_compact(array(when(...)))`` and exploded into one error row per
failure, so the whole check is a single narrow pass plus small aggregates.
Types come from the declared schema (D16); every failing rule yields a row and
the message is kept apart from a stable ``rule_id`` (D17).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's validation rules.
REQUIRED_FIELDS = ["id", "title", "description", "brand", "priceOriginal", "priceCurrent", "isOnSale",
                   "productType", "seasonRelevancyFactor", "stockLevel"]
OPTIONAL_FIELDS = ["imageThumbnailUrl", "ageFrom", "ageTo", "ageBucket", "color", "seasons"]
LENGTH_RULES = {"title": (2, 200), "description": (5, 2000), "brand": (1, 100)}
MIN_RULES = {"priceOriginal": 0, "priceCurrent": 0, "seasonRelevancyFactor": 0, "stockLevel": 0}
MAX_RULES = {"seasonRelevancyFactor": 1}
ID_PATTERN = r"^[a-zA-Z0-9_-]+"  # anchored at the start only
ERROR_STRUCT = "struct<rule_id:string,field:string,message:string>"


def _err(cond: Column, rule: str, field: str, message: Column) -> Column:
    return F.when(cond, F.struct(F.lit(rule).alias("rule_id"), F.lit(field).alias("field"),
                                 message.alias("message")))


def _num(c: str) -> Column:
    return F.col(c).cast("string")


def rule_checks(df: DataFrame, presence: bool = True, unexpected: bool = True) -> list[Column]:
    cols = set(df.columns)
    checks = []
    for f in REQUIRED_FIELDS if presence else []:
        if f not in cols:
            checks.append(_err(F.lit(True), "required_missing", f, F.lit(f"Required field '{f}' is missing")))
        else:
            checks.append(_err(F.col(f).isNull(), "required_missing", f, F.lit(f"Required field '{f}' is missing")))
    for f, (lo, hi) in LENGTH_RULES.items():
        if f in cols:
            n = F.length(F.col(f))
            checks.append(_err(n < lo, "too_short", f, F.format_string(
                f"Field '{f}' is too short (%d chars, min {lo})", n)))
            checks.append(_err(n > hi, "too_long", f, F.format_string(
                f"Field '{f}' is too long (%d chars, max {hi})", n)))
    if "id" in cols:
        idc = F.col("id").cast("string")
        checks.append(_err(~idc.rlike(ID_PATTERN), "pattern", "id",
                           F.lit("Field 'id' does not match required pattern")))
    for f, lo in MIN_RULES.items():
        if f in cols:
            checks.append(_err(F.col(f) < lo, "too_small", f,
                               F.concat(F.lit(f"Field '{f}' is too small ("), _num(f), F.lit(f", min {lo})"))))
    for f, hi in MAX_RULES.items():
        if f in cols:
            checks.append(_err(F.col(f) > hi, "too_large", f,
                               F.concat(F.lit(f"Field '{f}' is too large ("), _num(f), F.lit(f", max {hi})"))))
    for f in sorted(cols - set(REQUIRED_FIELDS) - set(OPTIONAL_FIELDS) - {"row_index"}) if unexpected else []:
        checks.append(_err(F.col(f).isNotNull(), "unexpected_field", f, F.lit(f"Unexpected field '{f}'")))
    if {"priceOriginal", "priceCurrent", "isOnSale"} <= cols:
        po, pc, s = F.col("priceOriginal"), F.col("priceCurrent"), F.col("isOnSale")
        checks.append(_err((po > pc) & ~s, "sale_flag", "isOnSale", F.concat(
            F.lit("isOnSale is False but priceOriginal ("), _num("priceOriginal"), F.lit(") > priceCurrent ("),
            _num("priceCurrent"), F.lit(")"))))
        checks.append(_err((po <= pc) & s, "sale_flag", "isOnSale", F.concat(
            F.lit("isOnSale is True but priceOriginal ("), _num("priceOriginal"), F.lit(") <= priceCurrent ("),
            _num("priceCurrent"), F.lit(")"))))
    if {"ageFrom", "ageTo"} <= cols:
        checks.append(_err(F.col("ageFrom") > F.col("ageTo"), "age_range", "ageFrom", F.concat(
            F.lit("ageFrom ("), _num("ageFrom"), F.lit(") is greater than ageTo ("), _num("ageTo"), F.lit(")"))))
    return checks


def with_errors(df: DataFrame) -> DataFrame:
    """Q11: the input plus ``errors array<struct<rule_id, field, message>>``."""
    return df.withColumn("errors", F.array_compact(F.array(*rule_checks(df))).cast(f"array<{ERROR_STRUCT}>"))


def violations(df: DataFrame) -> DataFrame:
    """One row per failing rule: (id, rule_id, field, message)."""
    idc = F.col("id").cast("string") if "id" in df.columns else F.lit(None).cast("string")
    return (with_errors(df).select(idc.alias("id"), F.explode("errors").alias("e"))
            .select("id", "e.rule_id", "e.field", "e.message"))


def summary(df: DataFrame) -> DataFrame:
    """Total, valid and invalid rows."""
    e = with_errors(df)
    return e.agg(F.count(F.lit(1)).alias("total_products"),
                 F.count_if(F.size("errors") == 0).alias("valid_products"),
                 F.count_if(F.size("errors") > 0).alias("invalid_products"))


def error_histogram(df: DataFrame, top: int = 5) -> DataFrame:
    """Most frequent (rule_id, field) failures."""
    c = violations(df).groupBy("rule_id", "field").agg(F.count(F.lit(1)).alias("count"))
    return c.orderBy(F.desc("count"), "rule_id", "field").limit(top)


def field_coverage(df: DataFrame) -> DataFrame:
    """Non-null count and percentage (2 decimals) of every expected field, in one aggregate."""
    fields = [f for f in REQUIRED_FIELDS + OPTIONAL_FIELDS]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for f in fields:
        aggs.append((F.count(F.col(f)) if f in df.columns else F.lit(0).cast("bigint")).alias(f))
    row = df.agg(*aggs)
    stacked = row.select("_n", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("bigint").alias("count")) for f in fields])).alias("s"))
    return stacked.select("s.field", "s.count", F.when(F.col("_n") > 0, F.round(
        F.col("s.count") * 100.0 / F.col("_n"), 2)).otherwise(0.0).alias("percentage"))


def duplicate_ids(df: DataFrame, show: int = 10) -> DataFrame:
    """The first ``show`` duplicated ids (by id) with the total number of duplicated ids."""
    d = (df.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("occurrences"))
         .where(F.col("occurrences") > 1))
    n = d.agg(F.count(F.lit(1)).alias("duplicate_count"))
    return d.orderBy("id").limit(show).withColumn("duplicate_count", n.scalar())


# Q2 on raw JSON records. The accepted JSON value types of each field, named the way the
# reference reports them (a boolean also passes an integer check).
EXPECTED_TYPES = {
    "id": ["str"], "title": ["str"], "description": ["str"], "brand": ["str"],
    "priceOriginal": ["int", "float"], "priceCurrent": ["int", "float"], "isOnSale": ["bool"],
    "productType": ["str"], "seasonRelevancyFactor": ["int", "float"], "stockLevel": ["int"],
    "imageThumbnailUrl": ["str"], "ageFrom": ["int", "NoneType"], "ageTo": ["int", "NoneType"],
    "ageBucket": ["str", "NoneType"], "color": ["str", "NoneType"], "seasons": ["list", "NoneType"],
}
SPARK_TYPES = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean", "list": "array<string>"}


def _json_type(v: Column) -> Column:
    """Python type name of a variant value; null when the key is absent."""
    t = F.schema_of_variant(v)
    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(t == "STRING", "str").when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
            .when(t.isin("DOUBLE", "FLOAT") | t.startswith("DECIMAL"), "float").when(t == "BOOLEAN", "bool")
            .when(t.startswith("ARRAY"), "list").when(t.startswith("OBJECT"), "dict").when(t == "VOID", "NoneType")
            .otherwise(F.lower(t)))


def raw_violations(raw: DataFrame, text_col: str = "value") -> DataFrame:
    """Q1/Q2/Q7/Q8 + constraints on raw JSON object text, one row per failure.

    Presence, JSON value type and unexpected keys come from the parsed VARIANT;
    the typed rules (lengths, ranges, pattern, sale flag, ages) then run on values
    whose JSON type fits the rule, as the reference's type-guarded constraint checks do.
    """
    v = raw.select(F.try_parse_json(F.col(text_col)).alias("_v"),
                   F.json_object_keys(F.col(text_col)).alias("_keys"))
    cols, typed = [], []
    for f, accepted in EXPECTED_TYPES.items():
        val = F.try_variant_get("_v", f"$.{f}", "variant")
        cols += [val.alias(f"_raw_{f}"), _json_type(val).alias(f"_t_{f}")]
    v = v.select("_v", "_keys", *cols)
    checks = []
    for f, accepted in EXPECTED_TYPES.items():
        t = F.col(f"_t_{f}")
        names = " or ".join(accepted)
        ok = t.isin(*accepted) | ((t == "bool") & F.lit("int" in accepted))
        msg = F.concat(F.lit(f"Field '{f}' has type "), t, F.lit(f", expected {names}"))
        if f in REQUIRED_FIELDS:
            checks.append(_err(t.isNull(), "required_missing", f, F.lit(f"Required field '{f}' is missing")))
            checks.append(_err(t.isNotNull() & ~ok, "type", f, msg))
        else:
            checks.append(_err(t.isNotNull() & (t != "NoneType") & ~ok, "type", f, msg))
        # typed value only when the JSON type fits the constraint class (str rules / numeric rules)
        sp = SPARK_TYPES[[a for a in accepted if a != "NoneType"][0]]
        fits = t.isin("str") if sp == "string" else (t.isin("int", "float", "bool") if sp in ("bigint", "double")
                                                     else t == accepted[0])
        typed.append(F.when(fits, F.try_variant_get(F.col(f"_raw_{f}"), "$", sp)).alias(f))
    known = list(EXPECTED_TYPES)
    checks.append(F.transform(F.filter("_keys", lambda k: ~k.isin(*known)),
                              lambda k: F.struct(F.lit("unexpected_field").alias("rule_id"), k.alias("field"),
                                                 F.concat(F.lit("Unexpected field '"), k, F.lit("'")).alias("message"))))
    base = v.select(F.try_variant_get("_v", "$.id", "string").alias("_id"),
                    F.array_compact(F.array(*checks[:-1])).alias("_e1"), checks[-1].alias("_e2"), *typed)
    typed_df = base.select("_id", "_e1", "_e2", *known)
    # presence and unexpected keys were judged on the raw record above
    keep = rule_checks(typed_df.select(*known), presence=False, unexpected=False)
    out = typed_df.select(F.col("_id").alias("id"), F.concat(
        F.col("_e1"), F.coalesce(F.col("_e2"), F.array().cast(f"array<{ERROR_STRUCT}>")),
        F.array_compact(F.array(*keep)).cast(f"array<{ERROR_STRUCT}>")).alias("errors"))
    return out.select("id", F.explode("errors").alias("e")).select("id", "e.rule_id", "e.field", "e.message")
