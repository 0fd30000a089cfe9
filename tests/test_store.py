from shopflow.sources import store as ST
from shopflow.session import checkpoint_dir


def test_upsert_last_wins_and_counts(spark):
    cur = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, price double")
    batch = spark.createDataFrame([("b", 5.0, 1), ("b", 6.0, 2), ("c", 7.0, 1)], "id string, price double, pos int")
    last = ST.last_wins(batch, "id", ["pos"]).drop("pos")
    snap = {r.id: (r.price, r._action) for r in ST.upsert(cur, last).collect()}
    assert snap == {"a": (1.0, "kept"), "b": (6.0, "updated"), "c": (7.0, "inserted")}
    c = ST.upsert_counts(cur, last).first()
    assert (c.processed, c.inserted, c.updated) == (2, 1, 1)
    # idempotent: applying the same batch twice gives the same table
    once = ST.upsert(cur, last).drop("_action")
    twice = {tuple(r) for r in ST.upsert(once, last).drop("_action").collect()}
    assert twice == {tuple(r) for r in once.collect()}


def test_delete_counts_and_lookup(spark):
    cur = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    keys = spark.createDataFrame([("b",), ("x",)], "id string")
    d = ST.delete_counts(cur, keys, "id").first()
    assert (d.deleted, d.remaining) == (1, 2)
    assert ST.delete_keys(cur, keys, "id").count() + d.deleted == cur.count()
    t = spark.createDataFrame([("a", "A")], "id string, title string")
    got = {r.id: r.found for r in ST.lookup(keys.union(cur.limit(0)).union(spark.createDataFrame([("a",)], "id string")), t).collect()}
    assert got == {"a": True, "b": False, "x": False}


def test_snapshot_versions(spark):
    root = checkpoint_dir(spark) + "/store-test"
    df = spark.createDataFrame([(1,)], "x int")
    ST.write_version(df, root, 1)
    ST.write_version(df.union(df), root, 2)
    assert ST.latest_version(spark, root) == 2
    assert ST.read_latest(spark, root).count() == 2


def test_json_array_sources_and_report_sink(spark):
    import json
    import os
    import tempfile

    from shopflow.operators import quality as Q
    from shopflow.sources.feed import ORDERLINE, read_products_json
    d = tempfile.mkdtemp(prefix="json-", dir="/tmp")
    lines = [{"orderNr": "O1", "productNr": "p1", "customerNr": "c1", "seasonName": "winter",
              "dateTime": "2023-12-15T14:30:00"},
             {"orderNr": "O1", "productNr": "p2", "customerNr": "c1", "seasonName": "winter",
              "dateTime": "2023-12-15T14:30:00"}]
    with open(os.path.join(d, "lines.json"), "w") as f:
        json.dump(lines, f)
    df = read_products_json(spark, os.path.join(d, "lines.json"), ORDERLINE)
    assert df.count() == 2 and dict(df.dtypes)["dateTime"] == "timestamp"
    prods = spark.createDataFrame([("p1", "Title", "Description", "B", 1.0, 1.0, False, "main", 0.5, 1)],
                                  "id string, title string, description string, brand string, priceOriginal double, "
                                  "priceCurrent double, isOnSale boolean, productType string, "
                                  "seasonRelevancyFactor double, stockLevel int")
    paths = ST.write_report({"summary": Q.summary(prods), "coverage": Q.field_coverage(prods)},
                            checkpoint_dir(spark) + "/report-test")
    assert spark.read.json(paths["summary"]).first().valid_products == 1
    assert spark.read.json(paths["coverage"]).count() == 16
