"""Regular words, null ids, many ranges, leaks without ids and long link chains."""

import time

import numpy as np
import pytest

from shopflow.llm import common, ngram_join, shingles, substring_dedup


def thue_morse(n, a, b):
    return "".join(a if bin(k).count("1") % 2 == 0 else b for k in range(n))


def test_regular_words_are_told_apart(spark):
    x, y = thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")
    sets = shingles.shingle_sets([x.encode(), y.encode(), b"a" * 300, b"a" * 301, b"AB", b"ab"])
    assert len({s[0] for s in sets}) == 5
    rows = ngram_join.ngram_jaccard_join(spark.createDataFrame([(1, x), (2, y), (3, x.upper())], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 2, 3: 1}


def test_null_and_equal_ids_cost_what_others_cost(spark):
    texts = [" ".join(f"{k // 2}x{j}" + ("y" if k % 2 and j == 30 else "") for j in range(60)) for k in range(1200)]
    took = {}
    for name, ids in (("own", range(1200)), ("null", [None] * 1200), ("equal", [7] * 1200)) * 2:
        df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        at = time.time()
        rows = ngram_join.ngram_jaccard_join(df).collect()
        took[name] = time.time() - at
        assert len(rows) == 1200 and {r.n_links for r in rows} == {1}
    assert took["null"] < 2 * took["own"] + 3 and took["equal"] < 2 * took["own"] + 3


@pytest.mark.parametrize("bits", [6, 20])
def test_any_number_of_ranges(spark, monkeypatch, bits):
    for module in (ngram_join, substring_dedup):
        monkeypatch.setattr(module, "ranges_for", lambda n: bits)
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(i, f"{base} tail{i}") for i in range(6)] + [(10, "nothing like it " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(df).collect()} == {**dict.fromkeys(range(6), 0), 10: 10}
    removed = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df).collect()}
    assert removed[0] == removed[10] == 0 and all(removed[i] == len(base) + 5 for i in range(1, 6))


def test_ranges_hold_a_bounded_share():
    for size in (0, 1 << 30, 1 << 47, 1 << 57):
        assert size / 2 ** common.ranges_for(size) <= 32 << 20
    assert np.array_equal(list(ngram_join._split(np.array([1, 5, (3 << 32) + 1, (3 << 32) + 2, 9 << 32], np.uint64))), [(0, 0, 2), (3, 2, 4), (9, 4, 5)])


def test_trust_travels_along_any_chain(spark):
    from shopflow.llm import urlrank
    n = 60
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1.0) for i in range(n)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("h0", 1.0)], "host string, seed double")
    score = {r.host: r.score for r in urlrank.personalised_rank(edges, seeds, None, 0.85).collect()}
    assert all(abs(score[f"h{i}"] - 0.15 * 0.85 ** i) < 1e-6 and score[f"h{i}"] > 0 for i in range(n + 1))
    assert urlrank.personalised_rank(edges, seeds.limit(0), None, 0.85).count() == 0


def test_leaks_without_ids_and_short_ones(spark):
    from shopflow.llm import decontam
    base = " ".join(f"w{i}" for i in range(30))
    items = [(None, base), (1, "Tiny leak here"), (1, "other words that are not in any document at all"), (2, None), (3, "  "), (4, "one")]
    docs = [(1, f"before {base} after"), (None, base.upper()), (1, f"a tiny LEAK here and there {base[:60]}"), (2, "tiny leak"), (5, None), (6, "one"), (7, "none of it")]
    d = spark.createDataFrame([(*r, "x", 1, [1]) for r in docs], "doc_id long, text string, item_id string, key long, sha array<long>")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item_shingles) for r in decontam.contaminated(d, i).collect()}
    assert got == {(1, None, 26, 26), (None, None, 26, 26), (1, 1, 1, 1), (6, 4, 1, 1)}
    assert [r.text for r in decontam.drop_contaminated(d, i).orderBy("doc_id").collect()] == ["tiny leak", None, "none of it"]
    assert decontam.contaminated(d, i.limit(0)).count() == 0 and decontam.drop_contaminated(d, i.limit(0)).count() == len(docs)
    assert decontam.contaminated(d.limit(0), i).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    from shopflow.llm import decontam, exact_dedup
    base = " ".join(f"w{i}" for i in range(40))
    names = ["keep_doc", "keep_sha", "bad_text", "x_doc", "x_key", "sha", "_sha", "_key", "row", "id", "key", "rows", "rep", "hi", "lo"]
    rows = [(1, base), (2, base), (2, base), (3, base + " x"), (None, base + " y"), (4, None), (4, None), (5, "")]
    df = spark.createDataFrame([(*r, *(f"{n}{k}" for n in names)) for k, r in enumerate(rows)], ", ".join(["doc_id long, text string", *(f"`{n}` string" for n in names)]))
    items = spark.createDataFrame([(1, base)], "item_id long, text string")
    for stage, want in ((exact_dedup.drop_exact_duplicates, 4), (ngram_join.drop_near_copies, 4), (lambda x: decontam.drop_contaminated(x, items), 3)):
        out = stage(df)
        assert out.columns == df.columns and out.count() == want
        assert stage(df.limit(0)).count() == 0
        assert all(r[n].startswith(n) for r in out.collect() for n in names)
