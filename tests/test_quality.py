from shopflow.operators import quality as Q

SCHEMA = ("id string, title string, description string, brand string, priceOriginal double, priceCurrent double, "
          "isOnSale boolean, productType string, seasonRelevancyFactor double, stockLevel int, "
          "ageFrom int, ageTo int, extra string")
GOOD = ("p1", "Good title", "Long enough", "B", 10.0, 10.0, False, "main", 0.5, 1, None, None, None)


def _row(**kw):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    r = dict(zip(names, GOOD))
    r.update(kw)
    return tuple(r[n] for n in names)


def test_one_failing_row_per_rule(spark):
    cases = {
        "t1": (_row(id="t1", title="x"), ("too_short", "title")),
        "t2": (_row(id="t2", title="x" * 201), ("too_long", "title")),
        "t3": (_row(id="t3", description="abcd"), ("too_short", "description")),
        "t4": (_row(id="t4", brand=""), ("too_short", "brand")),
        "t5": (_row(id="t5", priceCurrent=-1.0, priceOriginal=-1.0), ("too_small", "priceCurrent")),
        "t6": (_row(id="t6", seasonRelevancyFactor=1.1), ("too_large", "seasonRelevancyFactor")),
        "t7": (_row(id="t7", stockLevel=-1), ("too_small", "stockLevel")),
        "!x": (_row(id="!x"), ("pattern", "id")),
        "t9": (_row(id="t9", extra="y"), ("unexpected_field", "extra")),
        "t10": (_row(id="t10", priceOriginal=12.0), ("sale_flag", "isOnSale")),
        "t11": (_row(id="t11", isOnSale=True), ("sale_flag", "isOnSale")),
        "t12": (_row(id="t12", ageFrom=5, ageTo=3), ("age_range", "ageFrom")),
        "t13": (_row(id="t13", brand=None), ("required_missing", "brand")),
    }
    df = spark.createDataFrame([v[0] for v in cases.values()] + [_row(id="abc!!")], SCHEMA)
    got = {}
    for r in Q.violations(df).collect():
        got.setdefault(r.id, set()).add((r.rule_id, r.field))
    for k, (_, rule) in cases.items():
        assert rule in got[k], (k, got.get(k))
    assert "abc!!" not in got  # only the start of the id is anchored
    s = Q.summary(df).first()
    assert (s.total_products, s.valid_products, s.invalid_products) == (14, 1, 13)


def test_coverage_and_duplicates(spark):
    df = spark.createDataFrame([_row(id="a"), _row(id="a"), _row(id="b", ageFrom=1)], SCHEMA)
    cov = {r.field: (r["count"], r.percentage) for r in Q.field_coverage(df).collect()}
    assert cov["id"] == (3, 100.0) and cov["ageFrom"] == (1, 33.33) and cov["color"] == (0, 0.0)
    d = Q.duplicate_ids(df).collect()
    assert [(r.id, r.occurrences, r.duplicate_count) for r in d] == [("a", 2, 1)]


def test_raw_type_rules(spark):
    import json
    good = {"id": "p1", "title": "Good title", "description": "Long enough", "brand": "B", "priceOriginal": 10,
            "priceCurrent": 10.0, "isOnSale": False, "productType": "main", "seasonRelevancyFactor": 0.5, "stockLevel": 1}
    rows = [dict(good, id="ok"),
            dict(good, id="t1", priceCurrent="abc"),
            dict(good, id="t2", stockLevel=True),          # bool passes an int check
            dict(good, id="t3", isOnSale=1),
            dict(good, id="t4", extra=1),
            dict(good, id="t5", seasons="winter"),
            dict(good, id="t6", ageFrom=None),             # optional null: fine
            {k: v for k, v in dict(good, id="t7").items() if k != "brand"},
            dict(good, id="t8", title="x")]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    got = {}
    for r in Q.raw_violations(df).collect():
        got.setdefault(r.id, set()).add((r.rule_id, r.field, r.message))
    assert "ok" not in got and "t2" not in got and "t6" not in got
    assert ("type", "priceCurrent", "Field 'priceCurrent' has type str, expected int or float") in got["t1"]
    assert ("type", "isOnSale", "Field 'isOnSale' has type int, expected bool") in got["t3"]
    assert ("unexpected_field", "extra", "Unexpected field 'extra'") in got["t4"]
    assert ("type", "seasons", "Field 'seasons' has type str, expected list or NoneType") in got["t5"]
    assert ("required_missing", "brand", "Required field 'brand' is missing") in got["t7"]
    assert any(r[0] == "too_short" and r[1] == "title" for r in got["t8"])
