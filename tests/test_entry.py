import importlib.util
import os
import re


def _entry():
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_contract(spark):
    e = _entry()
    df = e.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields] == ["product_id", "rank", "rec_id", "score", "title", "brand"]
    q, o = e.queries(), e.oracle_sql()
    own = {n for n in q if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert own <= set(o) <= set(q) and len(own) >= 70


def test_every_query_has_unique_column_names(spark):
    e = _entry()
    for name in ["fbt_topk", "search_stats_p95", "substring_search_page", "feed_transform", "knn_items"]:
        cols = e.queries()[name](spark, "/root/testdata/sf0.001").columns
        assert len(cols) == len(set(cols)), name
