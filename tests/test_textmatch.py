import random

from shopflow.operators import textmatch as TM


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def _words(rng, n, alphabet="abcdeé ", lo=1, hi=9):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(lo, hi))) for _ in range(n)]


def test_matchers_equal_brute_force(spark):
    rng = random.Random(7)
    docs = [(i, t) for i, t in enumerate(_words(rng, 120, hi=14))]
    queries = sorted(set(_words(rng, 60, alphabet="abcdeé", hi=5)))
    ddf = spark.createDataFrame(docs, "id long, text string")
    qdf = spark.createDataFrame([(q,) for q in queries], "q string")
    got = {(r.q, r.id) for r in TM.substring_matches(qdf, ddf).collect()}
    want = {(q, i) for q in queries for i, t in docs if q.lower() in t.lower()}
    assert got == want and want
    pre = {(r.prefix, r.id) for r in TM.prefix_matches(qdf.withColumnRenamed("q", "prefix"),
                                                        ddf.withColumnRenamed("text", "title")).collect()}
    assert pre == {(q, i) for q in queries for i, t in docs if t.lower().startswith(q.lower())}
    vocab = sorted({t for _, t in docs})
    gdf = spark.createDataFrame([(g,) for g in vocab], "gram string")
    close = {(r.q, r.gram, r.dist) for r in TM.one_edit_matches(qdf, gdf).collect()}
    assert close == {(q, g, _lev(q, g)) for q in queries for g in vocab if _lev(q, g) <= 1}
