"""Tables that grow with the catalogue, the orders, the events or the vectors are no broadcast side of a join."""
import re

import pytest

from shopflow.operators import pairs as PR
from shopflow.operators import textsearch as TS
from shopflow.operators import vectors as V


def broadcasts(df):
    """The text of the plan below each broadcast exchange."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: re.search(r"[A-Za-z*]", x).start()
    found = []
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            below = []
            for y in lines[i + 1:]:
                if not re.search(r"[A-Za-z*]", y) or depth(y) <= depth(x):
                    break
                below.append(y)
            found.append("\n".join(below))
    return found


@pytest.fixture
def no_estimates(spark):
    """Only what the code itself asks for is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def catalogue(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("joins") / "p")
    rows = [(i, f"{c} {n}", f"{n} desc {c}", f"Brand#{i % 3}") for i, (c, n) in enumerate((c, n) for c in ("red", "blue", "red") for n in ("ring", "bolt"))]
    spark.createDataFrame([*rows, (None, "red ring", "x", "y"), (3, "red ring twice", None, "z")], "id long, title string, description string, brand string").write.parquet(at)
    return spark.read.parquet(at)


def test_document_lengths_and_postings_are_not_broadcast(spark, catalogue):
    post = TS.postings(catalogue, "id", "title")
    assert not broadcasts(post)
    assert sorted(tuple(r) for r in post.where("doc_id = 3").collect()) == [
        (3, t, tf, dl) for t, tf in (("blue", 1), ("bolt", 1), ("red", 1), ("ring", 1), ("twice", 1)) for dl in (2, 3)]
    asked = spark.createDataFrame([("a", "ring ring"), ("b", "none"), ("c", None)], "item_id string, text string")
    scores = TS.bm25_scores(asked, catalogue, d_id="id", d_text="title")
    assert all("ExistingRDD" not in b for b in broadcasts(scores))
    assert {(r.qid, r.doc_id) for r in scores.collect()} == {("a", 0), ("a", 2), ("a", 3), ("a", 4)}


def test_rows_of_text_classes_are_not_broadcast(catalogue, monkeypatch, no_estimates):
    sent, plain = {}, TS.written
    monkeypatch.setattr(TS, "written", lambda df, name: (sent.setdefault(name, []).append(df), plain(df, name))[1])
    classes, members = TS.text_classes(catalogue, "id", ["title"], 3)
    shipped = broadcasts(sent["members"][0])
    assert shipped and not any("sha2(" in b for b in shipped)
    lists = {r.title: (r.n, r.ids) for r in classes.collect()}
    assert lists["red ring"] == (3, [0, 4]) and members.count() == 8


def test_routes_are_not_broadcast(spark, tmp_path, no_estimates):
    spark.createDataFrame([(i, [1.0, float(i)], -2.0, i % 2) for i in range(6)], "qid long, vec array<double>, floor double, cluster int").write.parquet(str(tmp_path / "q"))
    spark.createDataFrame([(i, i, [1.0, float(i)], i % 2) for i in range(6)], "cid long, lead long, vec array<double>, cluster int").write.parquet(str(tmp_path / "c"))
    found = V._visit(spark.read.parquet(str(tmp_path / "q")), spark.read.parquet(str(tmp_path / "c")), 1, None, 2)
    assert broadcasts(found) and all("HashAggregate" in b for b in broadcasts(found))
    assert {(r.qid, r.did) for r in found.collect() if r.qid == r.did} == {(i, i) for i in range(6)}


def test_orders_are_not_broadcast(spark, catalogue):
    lines = catalogue.selectExpr("id % 2 AS orderNr", "id AS productNr")
    rows = PR.basket_pair_rows(lines)
    assert not any("Aggregate" in b for b in broadcasts(rows) if "lb" not in b)
    assert sorted((r.order, r.p1, r.p2, r.m1, r.m2) for r in rows.collect()) == [
        (0, 0, 2, 1, 1), (0, 0, 4, 1, 1), (0, 2, 4, 1, 1), (1, 1, 3, 1, 2), (1, 1, 5, 1, 1), (1, 3, 5, 2, 1)]


def test_events_are_not_broadcast_for_result_analysis(spark, tmp_path):
    from shopflow.plans import search
    spark.createDataFrame([(i, 5, "click", f'{{"k": {i % 3}}}') for i in range(8)], "event_id long, user_id long, event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(0, "red ring", "Brand#1", "SMALL", 1, 9.0), (1, "blue bolt", "Brand#2", "LARGE", 2, 8.0)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    out = search.result_analysis(spark, str(tmp_path))
    assert not any("event_type" in b for b in broadcasts(out))
    assert [tuple(r) for r in out.collect()] == [("click", 6, 6, 0, 1.0)]


@pytest.fixture
def small_shop(spark, tmp_path):
    """Clicks at position 1, 2 and beyond the page; a query that names a category, one a brand, one too short."""
    parts = [(0, "red ring", "Brand#1", "MEDIUM"), (1, "blue bolt", "Brand#2", "LARGE"), (2, "red bolt", "Brand#3", "LARGE"), (3, "old ring", None, "LARGE"),
             *((i, f"p{i} nut", "Brand#4", "LARGE") for i in range(4, 16)), (16, "small nut", "Brand#4", "SMALL"), (17, "ab nut", "Brand#4", "LARGE")]
    asked = [("click", 0), ("click", 3), ("click", 1), ("click", 2), ("click", 15), ("view", 0), ("purchase", 16), ("error", 0), ("purchase", 17), ("signup", 1)]
    spark.createDataFrame([(i, 5, t, f'{{"k": {k}}}') for i, (t, k) in enumerate(asked)], "event_id long, user_id long, event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(*p, 1, 9.0) for p in parts],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name, want", [
    ("feedback_ctr", [("bolt", 2, 2, 1.0, 1.5), ("nut", 1, 0, 0.0, None), ("ring", 2, 2, 1.0, 1.5)]),
    ("query_hit_rate", [(10, 10.0, 10.0, 90.0)])])
@pytest.mark.parametrize("few", [True, False])
def test_search_steps_broadcast_only_what_was_measured(spark, small_shop, monkeypatch, name, want, few):
    """However high Spark's threshold is, joins that are not measured first meet by sorting."""
    from shopflow import session
    from shopflow.operators import search as S
    from shopflow.plans import search
    sent, plain = [], session.written
    for module in (S, S.TM):
        monkeypatch.setattr(module, "written", lambda df, label: (sent.append(broadcasts(df)), plain(df, label))[1])
    if not few:
        monkeypatch.setattr(session, "LOOKUP_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(2**62))
    try:
        out = getattr(search, name)(spark, small_shop)
        sent.append(broadcasts(out))
        assert sorted(tuple(r) for r in out.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # what is broadcast was written and measured before: a scan of its file and nothing else that makes rows
    for below in (b for plan in sent for b in plan):
        assert few and "Scan parquet" in below and not re.search(r"Join|Aggregate|Exchange|Generate", below), below
