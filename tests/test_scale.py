"""What grows with the catalogue is never sent to every task, and blocks don't change results."""
import re

import pytest

from shopflow import session
from shopflow.operators import recommend as RC
from shopflow.operators import search as S
from shopflow.operators import textmatch as TM


def broadcast_generates(df):
    """Broadcast exchanges that hold rows made by an explode."""
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
            found += [y for y in below if "Generate" in y]
    return found


@pytest.fixture(scope="module")
def catalogue(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("catalogue") / "p")
    rows = [(i, f"{c} {n} {i}", f"desc {n}", f"Brand#{i % 3}") for i, (c, n) in enumerate(
        (c, n) for c in ("red", "blue", "Grøn") for n in ("ring", "bolt", "Spring", "a"))]
    spark.createDataFrame([*rows, (None, "red ring", "x", "y"), (3, "red ring twice", None, "z")],
                          "id long, title string, description string, brand string").write.parquet(at)
    return spark.read.parquet(at)


def hits(df):
    return sorted(((r.q, r.id) for r in df.collect()), key=str)


def test_postings_are_not_broadcast(spark, catalogue, monkeypatch):
    queries = spark.createDataFrame([("ring",), ("RED ring",), ("g",), ("rø",), ("none such",), ("",), (None,)], "q string")
    docs = S._product_text(catalogue, ["title", "description", "brand"])
    found = TM.substring_matches(queries, docs)
    assert not broadcast_generates(found)
    want = sorted({(q.q, d.id) for q in queries.collect() for d in docs.collect() if q.q and d.id is not None and q.q.lower() in d.text.lower()}, key=str)
    assert [x for x in hits(found) if x[1] is not None] == want
    monkeypatch.setattr(session, "LOOKUP_BYTES", -1)  # as if there were very many queries
    many = TM.substring_matches(queries, docs)
    assert "BroadcastExchange" not in many._jdf.queryExecution().executedPlan().toString()
    assert hits(many) == hits(found)


def test_prefixes_and_ngrams_are_not_broadcast(spark, catalogue):
    asked = spark.createDataFrame([(1, "re", "red ring", 5), (2, "GR", "spring", 2)], "query_id long, prefix string, query string, lim int")
    p = S.prefix_suggest(asked.drop("query"), catalogue)
    assert not broadcast_generates(TM.prefix_matches(asked, catalogue)) and not broadcast_generates(p)
    assert [r.id for r in p.where("query_id = 2").orderBy("rank").collect()] == [8, 9]
    n = S.ngram_search(asked.drop("prefix"), catalogue)
    assert not broadcast_generates(n) and n.where("query_id = 2 and rank = 1").first().id == 2


def test_collaborative_blocks(spark):
    lines = spark.createDataFrame([(u, (u * 7 + j * 3) % 23) for u in range(30) for j in range(1 + u % 5)], "customerNr long, productNr long")
    pairs = spark.createDataFrame([(a, b, (a * b) % 5 + 1) for a in range(23) for b in range(a + 1, 23) if (a + b) % 3], "product1 long, product2 long, cnt long")
    products = spark.createDataFrame([(i, f"p{i}") for i in range(23)], "id long, title string")
    for symmetric in (True, False):
        whole = RC.collaborative(lines, pairs, products, 5, symmetric).collect()
        blocks = RC.collaborative(lines, pairs, products, 5, symmetric, block_weight=40, edge_rows=10).collect()
        assert whole and sorted(whole) == sorted(blocks)


def test_collaborative_ships_lists_to_their_owners_only(spark, monkeypatch):
    """30 blocks of users with products of their own: each list is shipped once, not to every block."""
    sent = {}
    plain = RC.written
    monkeypatch.setattr(RC, "written", lambda df, name: sent.setdefault(name, plain(df, name)))
    lines = spark.createDataFrame([(u, 10 * u + j) for u in range(30) for j in range(10)], "customerNr long, productNr long")
    pairs = spark.createDataFrame([(10 * u + a, 10 * u + b, 1) for u in range(30) for a in range(10) for b in range(a + 1, 10)], "product1 long, product2 long, cnt long")
    RC.collaborative(lines, pairs, spark.createDataFrame([(0, "p")], "id long, title string"), 5, block_weight=90)
    assert sent["mine"].select("ub").distinct().count() == 30 and sent["need"].count() == sent["lists"].count() == 300


def test_routes_leave_in_bounded_frames():
    import numpy as np
    import pandas as pd

    from shopflow.operators import vectors as V
    rng = np.random.default_rng(1)
    pivots = V._matrix(rng.normal(size=(300, 16)))
    asked = pd.DataFrame({"qid": range(2000), "vec": [*rng.normal(size=(2000, 16))], "floor": -2.0, "home": -2})
    frames = [*V._routes(pivots, [(i, 0.0, 3.0) for i in range(300)], False)([asked, asked.iloc[:0]])]
    assert max(map(len, frames)) <= V.ROUTE_ROWS
    assert len(pd.concat(frames)[["qid", "cluster"]].drop_duplicates()) == sum(map(len, frames)) == 600_000


def test_field_lengths_are_no_key_of_a_shuffle(spark, catalogue):
    from shopflow.operators import textsearch as TS
    rows = catalogue.selectExpr("id AS cid", "1 AS n", "title")
    entries, _ = TS.impact_vectors(rows, {"title": 1.0})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entries._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(field#\d+, \d+\), ENSURE_REQUIREMENTS, \[plan_id=\d+\]\s*\n[^\n]*Project", plan)
    assert "BroadcastHashJoin [field" in plan


def test_copurchase_joins_baskets_once(spark):
    from shopflow.operators import pairs as PR
    lines = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 2), (2, 1), (2, 3)], "orderNr long, productNr long")
    counts = PR.copurchase_counts(lines)
    assert sorted(map(tuple, counts.collect())) == [(1, 2, 3), (1, 3, 1), (2, 1, 2), (2, 3, 1), (3, 1, 1), (3, 2, 1)]
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") <= 6  # twice that when each direction joined the baskets anew
