"""Results that must not depend on reused exchanges, id types or special characters."""

import pytest
from pyspark.sql import functions as F

from shopflow.functions.text import quote_regex
from shopflow.operators import search as S
from shopflow.operators import textmatch as TM
from shopflow.operators import vectors as V
from shopflow.operators.etl import to_int
from shopflow.plans import registry
from shopflow.session import checkpoint_dir
from shopflow.sources.requests import filter_key

SF01 = "/root/testdata/sf0.01"
SETTINGS = {"spark.sql.exchange.reuse": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "32"}


@pytest.mark.parametrize("name", ["latency_percentiles", "sessions_feedback"])
def test_same_without_exchange_reuse(spark, name):
    registry.load_all()
    rows = lambda: sorted(map(str, registry.QUERIES[name](spark, SF01).collect()))
    want = rows()
    old = {k: spark.conf.get(k) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        assert rows() == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_sessions_over_small_batches(spark):
    """The open session is carried from one Arrow batch to the next."""
    registry.load_all()
    rows = lambda: sorted(map(str, registry.QUERIES["sessions_feedback"](spark, SF01).collect()))
    want = rows()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_filter_key_is_injective(spark):
    df = spark.sql("select map('a', '1&b=2') m union all select map('a', '1', 'b', '2') union all select map('a', '1%26b%3D2')")
    assert df.select(filter_key(F.col("m"))).distinct().count() == 3


def test_quote_regex(spark):
    for q in ("a\\Eb", "\\E", "x.y", "\\Q"):
        df = spark.createDataFrame([(q, f"-{q}-")], "q string, t string")
        assert df.where(F.regexp(F.col("t"), F.concat(F.lit("^-"), quote_regex(F.col("q")), F.lit("-$")))).count() == 1


def test_whole_numbers(spark):
    df = spark.createDataFrame([("3000000000.7",), ("-5.9",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(to_int(F.col("v"))).collect()] == [3000000000, -5, None, None]


def test_long_tokens_are_indexed_whole(spark):
    docs = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz b")], "id int, title string")
    grams = {r.gram for r in TM.token_edge_grams(docs).collect()}
    assert "abcdefghijklmnopqrst" in grams and "abcdefghijklmnopqrstuvwxyz" in grams and "b" not in grams


def test_facets_of_large_match_sets(spark):
    products = spark.range(1200).select(F.col("id"), F.lit("same title").alias("title"), F.lit("").alias("description"), F.lit("B").alias("brand"), F.lit("red").alias("color"),
                                        F.lit("main").alias("productType"), F.lit(False).alias("isOnSale"), F.array().cast("array<string>").alias("seasons"))
    req = spark.sql("select 1L query_id, 'same' query, cast(map() as map<string,string>) filters, '' filter_key, 5 lim, 0 off")
    out = {(r.field, r.value): r["count"] for r in S.facets_matched(req, products).collect()}
    assert out["brand", "B"] == 1200


def test_knn_keeps_string_ids(spark):
    df = spark.createDataFrame([("p1", [1.0, 0.0]), ("p2", [0.9, 0.1]), ("q", [0.0, 1.0])], "id string, vec array<double>")
    out = V.knn(df, df, k=1, exclude_self=True)
    assert {(r.qid, r.cid) for r in out.collect()} == {("p1", "p2"), ("p2", "p1"), ("q", "p2")}


def test_checkpoint_folder_must_be_shared(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        checkpoint_dir(Session())
