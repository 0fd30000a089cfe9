"""Token counts against the library's own on whole texts; ranked search against scoring every document."""

import collections
import math
import random
import re

import public_tokenizers
import pytest
import sentencepiece

from shopflow.llm import queries, ranked_search, token_counts

SF = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path(queries.TOKEN_MODEL)
DOCS = "doc_id long, text string, n long, tids array<int>, tfs array<int>, norm double, q long, score long"
ITEMS = "item_id long, text string, q long, terms string, rank int, doc_id long"
HARD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\n", " \n x", "x \n y", "a\nb\n\nc", "\nstart", "tab\tand\r\nmore", "▁", "a▁b ▁▁c", "<s> </s> <unk> <0x0A>",
        "\x00 nul\x00", "ﬁ ½ é é 日本語 🎉🎉", "x" * 30000, "ab " * 20000, " " * 5000, "\n" * 5000, "1234567890 12", "it's  a   test    of     runs"]


def library(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return [len(x) for x in sp.encode([t or "" for t in texts])]


def counted(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect())


def expected(rows):
    n = library([t for _, t in rows])
    return sorted((-1 if i is None else i, len((t or "").encode()), k, k > 4096) for (i, t), k in zip(rows, n))


def test_tokens_equal_the_library(spark):
    rows = [*enumerate(HARD), (3, "a"), (None, "again and again"), (None, "again and again")]
    df = spark.createDataFrame([(*r, 1, [], [], 0.0, 2, 3) for r in rows], DOCS)
    for frequent in (2, 1 << 16):
        assert counted(token_counts.count_tokens(df, MODEL, frequent=frequent)) == expected(rows)
    assert token_counts.count_tokens(df.limit(0), MODEL).collect() == []


def test_tokens_random_texts(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["a", "the", " ", "  ", "\n", " \n", "\n ", "▁", "é", ".", "\t", "ing", "Ω"]) for _ in range(rng.randrange(60)))) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert counted(token_counts.count_tokens(df, MODEL)) == expected(rows)


def test_token_query_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert counted(queries.QUERIES["op12_token_counts"](spark, SF)) == expected(rows)


def test_frequent_ones_are_found(spark):
    texts = [(" ".join(["hot"] * 50 + [f"rare{i}x{k}" for k in range(40)]),) for i in range(300)]
    found = token_counts.frequent_pre_tokens(spark.createDataFrame(texts, "text string").repartition(70), 16)
    assert b"hot" in found and len(found) <= 16


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))


def ranked(docs, items, k=10):
    words = [terms(t) for _, t in docs]
    n_docs, length = sum(map(bool, words)), sum(map(len, words))
    df = collections.Counter(t for w in words for t in set(w))
    tf = [collections.Counter(w) for w in words]
    out = []
    for item, text in items:
        scores = []
        for (doc, _), w, f in zip(docs, words, tf):
            m = 100 - 90 + (90 * len(w) * n_docs) // length if w else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * f[t]) // (1000 * f[t] + 8 * m)) for t in set(terms(text)) if f[t])
            if s > 0:
                scores.append((-s, doc is not None, doc or 0))
        out += [(item, r + 1, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def searched(df):
    return sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()], key=str)


def corpus(rng, n):
    words = [f"w{i}" for i in range(300)]
    pick = lambda m: " ".join(words[min(int(rng.expovariate(0.02)), 299)] for _ in range(m))
    docs = [(rng.choice([i, i, 7, None]), pick(rng.choice([1, 5, 40, 400]))) for i in range(n)]
    docs += [(50_000 + i, docs[0][1]) for i in range(30)]  # copies, hence ties
    docs += [(1, None), (2, ""), (3, " ,;!"), (4, "É Éa 日本 W1\x00w2\x7fw3"), (5, "W1" * 4000), (6, "w1 " * 20000)]
    items = [(i, pick(rng.choice([1, 3, 30]))) for i in range(25)] + [(None, "w1 w2"), (None, "w299"), (3, None), (3, ""), (4, "nowhere"), (5, docs[0][1]), (5, "W1 w1 w2 É")]
    return docs, items


@pytest.mark.parametrize("bucket, block_terms", [(4096, 1 << 19), (16, 60)])
def test_ranked_search_equals_scoring_all(spark, monkeypatch, bucket, block_terms):
    docs, items = corpus(random.Random(2), 400)
    monkeypatch.setattr(ranked_search, "BUCKET_ROWS", bucket)
    d = spark.createDataFrame([(*r, 1, [], [], 0.0, 2, 3) for r in docs], DOCS)
    q = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in items], ITEMS)
    assert searched(ranked_search.ranked_search(d, q, block_terms=block_terms)) == ranked(docs, items)
    assert searched(ranked_search.ranked_search(d, q, k=3)) == ranked(docs, items, 3)
    for a, b in ((d.limit(0), q), (d, q.limit(0)), (d.limit(0), q.limit(0))):
        assert ranked_search.ranked_search(a, b).collect() == []


def test_buckets_and_candidates_are_pruned(spark):
    """A document with a whole rare item makes most of the others superfluous."""
    import numpy as np
    import pyarrow as pa
    n = 1000
    part = pa.table({"doc_id": pa.array(range(n)), "n": pa.array([50] * n), "norm": pa.array([1.0] * n),
                     "tids": pa.array([[0] if i else [0, 1, 2] for i in range(n)], pa.list_(pa.int32())),
                     "tfs": pa.array([[1] if i else [1, 1, 1] for i in range(n)], pa.list_(pa.int32()))})
    w = np.array([10, 5000, 5000])
    b = ranked_search._Bucket(part, w, n, 50 * n)
    b.norm = np.sqrt(np.bincount(b.row, weights=b.value ** 2))
    best = int(b.scores(np.array([0, 1, 2]), np.array([0]))[0])
    assert b.candidates(np.array([0, 1, 2]), np.sqrt(w), best).tolist() == [0]
    assert len(b.candidates(np.array([0, 1, 2]), np.sqrt(w), 0)) == n
