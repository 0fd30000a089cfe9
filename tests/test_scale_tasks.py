"""Steps whose tasks must not grow with the input: the catalogue's grams are made in tasks of a bounded number of rows."""
import pytest

from shopflow import session
from shopflow.operators import impact
from shopflow.operators import search as S

ROWS = [(1, "red ring", "Brand#1"), (2, "red bolt", "Brand#1"), (3, "blue ring", None), (3, "red ring twice", "Brand#2"), (None, "red ring", "x"), (5, None, None), (6, "", "y")]


@pytest.fixture
def catalogue(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 2)
    rows = [(i, t, t and f"{t} desc", b, "c", [("c", "C", "c")]) for i, t, b in ROWS]
    return spark.createDataFrame(rows, "id long, title string, description string, brand string, category string, categories array<struct<id:string,name:string,slug:string>>").coalesce(1)


def test_dealt_keeps_rows_and_bounds_tasks(spark, monkeypatch):
    df = spark.range(0, 50, 1, 1)
    assert session.dealt(df).rdd.getNumPartitions() == 1
    monkeypatch.setattr(session, "TASK_ROWS", 8)
    out = session.dealt(df)
    assert out.rdd.getNumPartitions() == 7 and sorted(r.id for r in out.collect()) == list(range(50))
    assert max(len(p) for p in out.rdd.glom().collect()) <= 9
    assert session.dealt(df.where("id < 0")).count() == 0


def test_grams_are_made_in_dealt_out_tasks(spark, catalogue, monkeypatch):
    plans, plain = [], session.written
    for module in (S, S.TM):
        monkeypatch.setattr(module, "written", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), plain(df, name))[1])
    req = spark.createDataFrame([(1, "ring", {}, "", 10, 0), (2, "RED", {"brand": "Brand#1"}, "brand=Brand#1", 10, 0)],
                                "query_id long, query string, filters map<string,string>, filter_key string, lim int, off int")
    dealt_out = lambda: any("Repartition 4" in p for p in plans)
    out = S.search_totals(req, catalogue)
    assert dealt_out() and {(r.query_id, r.total) for r in out.collect()} == {(1, 5), (2, 2)}
    for run, want in ((lambda: S.ngram_search(req, catalogue), {(1, 1), (1, 3), (2, 1), (2, 2), (2, 3), (1, None), (2, None)}),
                      (lambda: S.prefix_suggest(req.selectExpr("query_id", "query prefix", "lim"), catalogue), {(2, 1), (2, 2), (2, 3)}),
                      (lambda: S.any_term_search(req.selectExpr("*"), catalogue), {(1, 1), (1, 3), (2, 1), (2, 2), (2, 3)})):
        plans.clear()
        out = run()
        assert dealt_out() and {(r.query_id, r.id) for r in out.collect()} == want
    plans.clear()
    S.consolidated_candidates(req.selectExpr("query", "10 AS max_products"), catalogue)
    assert dealt_out()


def test_shards_of_a_task_do_not_grow_with_the_index(spark):
    n = 40
    docs = spark.createDataFrame([(i, i, [i, 100], [1.0 + i, 0.5], i, i) for i in range(n)], "did long, lead long, feats array<long>, imps array<double>, shard int, place long")
    asked = spark.createDataFrame([(i, 1000 + j, [i, 100], [1.0, 2.0], 0.0) for i in range(n) for j in range(3)], "shard int, qid long, feats array<long>, weights array<double>, floor double")
    found = impact._visit(asked, docs, 5, 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # 3 queries a shard, 2 a task: two groups for each shard
    assert plan.count(f"], {impact.GROUP_PARTITIONS * 2 * n}\n") == 2, plan
    assert {(r.qid, r.did, r.score) for r in found.collect()} == {(1000 + j, i, 2.0 + i) for i in range(n) for j in range(3)} and found.count() == 3 * n
    assert impact._visit(asked.where("qid < 0"), docs, 5, 2).count() == 0
