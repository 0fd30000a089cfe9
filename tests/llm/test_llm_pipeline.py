"""The pipeline's stages on the smallest tables against what their operators decide."""

import importlib.util

from shopflow.llm import queries
from shopflow.llm.decontam import contaminated
from shopflow.llm.ngram_join import ngram_jaccard_join

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as c
    docs = c.table(spark, SF, "documents")
    names = docs.columns
    seen = {}
    for name, stage in c.STAGES:
        before = docs
        docs = c.materialise(stage(spark, docs, SF), name)
        seen[name] = (before, docs)
        assert docs.columns == names or name == "mix"
    left = lambda n: {r.doc_id for r in seen[n][1].select("doc_id").collect()}
    found = ngram_jaccard_join(seen["near"][0]).collect()
    assert left("near") == {r.component_id for r in found}
    bad = {r.doc_id for r in contaminated(seen["benchmark"][0], c.table(spark, SF, "benchmark")).collect()}
    assert left("benchmark") == left("near") - bad
    assert {r.doc_id for r in docs.collect()} == left("benchmark")


def test_near_and_benchmark_go_by_row(spark, tmp_path):
    import corpus_pipeline as c
    text = lambda s, n=60: " ".join(f"{s}{i}" for i in range(n))
    a, b, leak = text("a"), text("b"), text("leak")
    rows = [(None, a), (None, a + " x"), (None, a + " y"),          # near copies without an id
            (7, b), (7, b + " x"), (9, b + " y"),                    # near copies that share an id
            (9, text("c")), (None, text("d")),                       # unrelated, but with the id of a near copy
            (None, leak + " x"), (None, text("e")), (5, leak), (5, text("f")), (5, text("f")),
            (None, None), (None, ""), (5, " "), (5, " ")]
    docs = spark.createDataFrame([(i, t, f"s{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string")
    near = c.near(spark, docs, "")
    assert near.columns == docs.columns
    left = [(r.doc_id, r.text) for r in near.collect()]
    count = lambda *texts: sum(t in texts for _, t in left)
    assert count(a, a + " x", a + " y") == 1
    assert [i for i, t in left if t in (b, b + " x", b + " y")] == [7]
    assert [i for i, t in left if t in (leak, leak + " x")] == [5]
    assert count(text("c")) == count(text("d")) == count(text("e")) == count(text("f")) == 1
    assert count(None) == count("") == 1 and count(" ") == 2 and len(left) == 11
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(r.doc_id, r.text) for r in c.benchmark(spark, docs, str(tmp_path)).collect()]
    key = lambda x: (x[0] or 0, x[1] or "", x[1] is None)
    assert sorted(clean, key=key) == sorted([r for r in rows if "leak" not in (r[1] or "")], key=key)


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES if n.startswith("op")] and {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in queries.QUERIES}
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert importlib.util.find_spec("corpus_pipeline")
