"""Consolidated search on a small catalogue: fuzzy words, gated vectors, rejected queries, whole answers."""

import pytest

from shopflow.operators import consolidated as C
from shopflow.operators import vectors as V

ROWS = [("p1", "Metaldetector for kids", "Finds coins", "Garrett"), ("p2", "Metal box", "A box of metal", "Boxy"), ("p3", "Wooden train", "For kids", "Brio"),
        ("p4", "Trains and rails", "Wooden rails", "Brio"), ("p5", None, "no title here", None), ("p6", "wooden train", "For kids", "BRIO")]


@pytest.fixture(scope="module")
def products(spark):
    cat = "array<struct<id:string,name:string,slug:string>>"
    df = spark.createDataFrame([(*r, [("toys", "Toys", "toys")]) for r in ROWS], f"id string, title string, description string, brand string, categories {cat}")
    return df


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "query string, include_vector boolean")


def test_words_one_edit_away(spark, products):
    rows = C.fuzzy_relevance(asked(spark, ("metall", False), ("trian", False), ("wodden train", False), ("xyz", False), ("", None)), products).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.query, []).append(r.id)
    assert got["metall"] == ["p2", "p1"]                   # metal by one edit, metaldetector by one edit and a prefix
    assert got["wodden train"][:2] == ["p3", "p6"] and "p4" in got["wodden train"]
    assert "xyz" not in got and "" not in got
    words = spark.createDataFrame([("metal",), ("metaldetector",), ("mat",)], "word string")
    close = {r.word: r.likeness for r in C.close_terms(spark.createDataFrame([("metall",)], "term string"), words).collect()}
    assert close == {"metal": pytest.approx(1 - 1 / 5), "metaldetector": pytest.approx(6 / 13 * 0 + max((1 - 1 / 5) * 5 / 13, (1 - 1 / 6) * 6 / 13))}


def test_no_embedding_where_none_is_asked(spark, products, monkeypatch):
    seen = []
    real = V.with_hashed_embedding

    def spy(df, text, *a, **k):
        if text == "query":
            seen.append(sorted(r.query for r in df.collect()))
        return real(df, text, *a, **k)
    monkeypatch.setattr(V, "with_hashed_embedding", spy)
    rows = C.title_neighbours(asked(spark, ("wooden train", True), ("metal box", False), ("metal", True), ("a b", None)), products, k=2).collect()
    assert seen == [["wooden train"]]
    assert [(r.query, r.id) for r in sorted(rows, key=lambda r: r["rank"])] == [("wooden train", "p3"), ("wooden train", "p6")]


def test_whole_answers(spark, products):
    rows = C.consolidated_rows(asked(spark, ("wooden train", True), ("wooden train", False), ("brio", False), ("to", True), ("toy", None), ("nothing", False)), products).collect()
    by = {}
    for r in rows:
        by.setdefault((r.query, r.include_vector), []).append(r)
    assert [(r.kind, r.name, r.total_results) for r in by["to", True]] == [("rejected", "fewer than 3 characters", 0)]
    assert [(r.kind, r.id, r.product_count) for r in by["toy", False] if r.kind == "category"] == [("category", "toys", 6)]
    assert {r.id for r in by["brio", False] if r.kind == "brand"} == {"Brio", "BRIO"}
    plain, vector = by["wooden train", False], by["wooden train", True]
    score = {r.id: r.score for r in plain if r.kind == "product"}
    with_vector = {r.id: r.score for r in vector if r.kind == "product"}
    sims = {r.id: r.sim for r in C.title_neighbours(asked(spark, ("wooden train", True)), products).collect()}
    for i, s in with_vector.items():
        assert s == pytest.approx(score.get(i, 0) + (1 + sims[i]) / 2)
    assert {r.matchType for r in plain if r.id in ("p3", "p6")} == {"exact"}
    assert all(r.total_results == len(rs) for rs in by.values() for r in rs if r.kind != "rejected")
    assert ("nothing", False) not in by


def test_vector_matches_leave_out_earlier_ones(spark, products):
    report: dict = {}
    earlier = spark.createDataFrame([("wooden train", "p3")], "query string, id string")
    rows = C.vector_matches(asked(spark, ("wooden train", True), ("metal", True), ("metal box", False)), products, earlier, report=report).collect()
    assert {(r.query, r.id) for r in rows} >= {("wooden train", "p6")} and ("wooden train", "p3") not in {(r.query, r.id) for r in rows}
    assert all(r.score > 0.5 and r.query == "wooden train" for r in rows)
    assert set(report) == {"title", "description"} and report["title"]["visited"] <= report["title"]["pairs"]
    best = C.three_strategies(asked(spark, ("wooden train", True)), products).collect()
    assert [(r.id, r.matchType) for r in sorted(best, key=lambda r: r["rank"])][:2] == [("p3", "exact"), ("p6", "exact")]
