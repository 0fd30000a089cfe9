"""Vector search ships a vector to a shard of clusters once, and scores the same pairs."""
import collections

import numpy as np
import pandas as pd
import pytest

from shopflow.operators import vectors as V


@pytest.fixture
def noise(spark):
    """Isotropic vectors, where no bound prunes; some equal, one zero, one null."""
    rng = np.random.default_rng(5)
    m = np.round(rng.normal(size=(400, 12)), 3)
    m[50:60], m[77] = m[50], 0
    return m, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(900, None)], "id long, vec array<double>")


def sims(m):
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    return np.round(unit @ unit.T, 9)


def test_vectors_are_shipped_by_shard(noise, monkeypatch):
    m, df = noise
    seen, plain = [], V._visit
    monkeypatch.setattr(V, "_visit", lambda routed, *a: (seen.append((routed, a[0], a[3])), plain(routed, *a))[1])
    report: dict = {}
    got = collections.defaultdict(list)
    for r in V.knn(df, df, k=5, exclude_self=True, block_rows=100, cluster_rows=20, report=report).orderBy("rank").collect():
        got[r.qid].append((r.cid, r.sim))
    s = sims(m)
    want = {q: [(int(c), s[q, c]) for c in sorted((c for c in range(len(m)) if c != q), key=lambda c: (-s[q, c], c))[:5]] for q in range(len(m))}
    assert got == want
    routed, corpus, block_rows = seen[-1]
    classes, shards = 391, corpus.select("cluster").distinct().count()
    assert report["clusters"] >= 15 and report["visited"] > 10 * classes  # nearly every query visits nearly every cluster
    assert 4 <= shards <= 8 and routed.count() <= classes * shards
    assert corpus.count() == classes and max(r["count"] for r in corpus.groupBy("cluster").count().collect()) <= block_rows


@pytest.mark.parametrize("threshold", [0.3, -0.1])
def test_thresholds_over_shards(noise, threshold):
    m, df = noise
    s = sims(m)
    got = {(r.qid, r.cid): r.sim for r in V.knn(df, df, k=None, threshold=threshold, block_rows=100, cluster_rows=20).collect()}
    assert got == {(a, b): s[a, b] for a, b in zip(*map(np.ndarray.tolist, np.nonzero(s > threshold)))}


def test_scores_of_a_task_are_exact():
    """Close neighbours that single precision can't tell apart, more of them than a slice holds."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=32)
    c = base + rng.normal(size=(5000, 32)) * 1e-4
    c[4000:4040] = c[17]
    q = pd.DataFrame({"qid": range(600), "vec": [*(base + rng.normal(size=(600, 32)) * 1e-4)], "floor": -2.0})
    q.at[5, "vec"] = np.zeros(32)
    got = V._scorer(6, None)(q, pd.DataFrame({"cid": range(5000), "lead": range(5000), "vec": [*c]}))
    s = np.round(V._matrix(q["vec"]) @ V._matrix(c).T, 9)
    for i in range(0, 600, 5):
        assert got[got.qid == i].did.tolist() == np.lexsort((np.arange(5000), -s[i]))[:6].tolist()
    assert len(got) == 3600 and (got.score.to_numpy() == s[got.qid, got.did]).all()
    assert V._scorer(6, None)(q.iloc[:0], q).empty
