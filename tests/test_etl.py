import json
import tempfile

from pyspark.sql import functions as F

from shopflow.operators import etl as E
from shopflow.sources import feed as FD


def _feed(spark, products):
    d = tempfile.mkdtemp(prefix="feed-", dir="/tmp")
    with open(d + "/feed.json", "w", encoding="utf-8") as f:
        json.dump({"totalHits": len(products), "result": products}, f)
    return FD.read_feed(spark, d + "/feed.json")


def _base(**kw):
    p = {"id": "x", "name": "Plain thing", "categories": [], "prices": [], "properties": []}
    p.update(kw)
    return p


def test_feed_rules(spark):
    prods = [
        {"name": "no id"},
        _base(id="a", name="First"), _base(id="a", name="Second"),
        _base(id="b", name="", supplierName="", properties=[{"key": "Brand", "value": "Acme"}]),
        _base(id="c", name="A hundred things", prices=[
            {"marketId": "b2c_swe", "unitPrice": 10.0, "originalUnitPrice": 12.0},
            {"marketId": "b2c_nor", "unitPrice": 0.0, "originalUnitPrice": 0.0},
            {"marketId": "other", "unitPrice": 5.0}]),
        _base(id="d", name="Leke 1-3 år vinter", availableInventory="12.0",
              categories=[{"name": "Påske og sommer", "isMainCategory": False}]),
        _base(id="e", name="Baby 0-6 months", properties=[{"key": "Seasons", "value": "a;b"}]),
        _base(id="f", name="Kid 1-3 years", prices=[{"marketId": "b2c_nor", "unitPrice": 5.0},
                                                    {"marketId": "b2c_nor", "unitPrice": 7.0, "originalUnitPrice": 9.0}],
              properties=[{"key": "Seasons", "value": "x, y"}, {"key": "Color", "value": "Teal"}]),
    ]
    rows = {r.id: r for r in E.transform_products(_feed(spark, prods)).collect()}
    assert set(rows) == {"a_no", "b_no", "c_no", "d_no", "e_no", "f_no"}
    assert rows["a_no"].title == "First"  # first wins
    assert rows["b_no"].brand == "Acme" and rows["b_no"].title == "Unnamed Product"
    c = rows["c_no"]
    # preferred market b2c_nor priced 0/0 -> first usable price entry (b2c_swe)
    assert (c.priceOriginal, c.priceCurrent, c.isOnSale) == (12.0, 10.0, True)
    assert c.color == "Red"  # 'red' inside 'hundred'
    d = rows["d_no"]
    assert (d.ageFrom, d.ageTo, d.ageBucket) == (1, 3, "1 to 3 years") and d.stockLevel == 12
    assert d.seasons == ["spring", "summer", "winter"]
    e = rows["e_no"]
    assert e.ageBucket == "0 to 6 months" and e.seasons == ["a", "b"]
    f = rows["f_no"]
    assert (f.priceOriginal, f.priceCurrent) == (9.0, 7.0) and f.seasons == ["x", "y"] and f.color == "Teal"
    rej = {(r.id, r.reason) for r in E.rejected_products(_feed(spark, prods)).collect()}
    assert rej == {(None, "missing id"), ("a", "duplicate id")}


def test_clean_html(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("<html><script>var t='</p>';</script><p>Hi &amp; bye</p>\n <b>x</b></html>",)], "h string")
    assert df.select(E.clean_html(F.col("h")).alias("t")).first().t == "Hi & bye x"


def test_alternate_mapping(spark):
    prods = [_base(id="z", name="Name", alternativeProductName="Alt name", supplierName="Acme", supplierItemId="i9",
                   price={"marketId": "b2c_nor", "unitPrice": 50.0}, availableInventory="7"),
             _base(id="y", name="Other", alternativeProductName=None, supplierName=None, price={"unitPrice": 5.0, "originalUnitPrice": 9.0})]
    r, o = E.alternate_mapping(_feed(spark, prods)).orderBy(F.desc("id")).collect()
    assert (r.title, r.description, r.brand, r.priceCurrent, r.priceOriginal, r.isOnSale) == ("Name", "Alt name", "Acme", 50.0, 0.0, False)
    assert (r.supplierItemId, r.alternativeProductName, r.stockLevel) == ("i9", "Alt name", 7)
    assert (o.description, o.brand, o.priceOriginal, o.isOnSale, o.alternativeProductName) == ("Other", "Unknown", 9.0, True, "")


def test_load_statistics(spark):
    import datetime as dt
    from shopflow.sources import store as ST
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(0, 80, 20, 1, t, t + dt.timedelta(seconds=2)),
                                 (1, 50, 50, 0, t + dt.timedelta(seconds=2), t + dt.timedelta(seconds=4))],
                                "batch int, inserted long, updated long, errors long, started timestamp_ntz, finished timestamp_ntz")
    r = ST.load_statistics(log).first()
    assert (r.batches, r.inserted, r.updated, r.errors, r.duration_s, r.rows_per_s) == (2, 130, 70, 1, 4.0, 50.0)
