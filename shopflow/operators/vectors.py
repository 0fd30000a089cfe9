"""Exact vector similarity search (V1, V3, V4) and text embeddings.

Corpus vectors are clustered around pivots (a bounded sample of the corpus); each cluster notes the
least and largest angle to its pivot. The triangle inequality bounds a query's similarity with
all of a cluster by its angle to the pivot. A query first visits the cluster of its nearest
pivot, which gives a floor for its k-th similarity, then only clusters whose bound reaches the
floor (with a threshold, those whose bound reaches that). Equal vectors are one class, searched
once. Clusters are packed into shards, and a vector is shipped to a shard once, however many of its clusters it
visits: what is shipped grows with vectors times shards, not with vectors times clusters. In a task single-precision
products pick what can reach a query's floor, double precision scores it, and what leaves the task is each query's
best ``k`` (or the rows above the threshold).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.operators.classes import spread
from shopflow.operators.topk import top_k
from shopflow.session import lookup, released, written

MOST_PIVOTS = 1024
CLUSTER_ROWS = 2048      # vectors of a cluster on the average, as far as the pivots go
PIVOT_FLOATS = 1 << 21   # of all pivots together (16 MB), sent to every task
SLACK = 2e-9             # similarities are rounded to 9 places
ROUTE_QUERIES = 512      # queries compared with all pivots at once
ROUTE_ROWS = 4096        # routes that leave a worker at once, each with its vector
BLOCK_FLOATS = 1 << 22   # of one side of a task
LEAST_BLOCK = 2048       # rows; a side is dealt into 8 blocks at least as long as they are not smaller
EXACT_ROWS = 1 << 15     # pairs scored in double precision at once


def _matrix(vs) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in vs])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(norms > 0, m / norms, 0.0)
    return out


def _leading(at, to, score, k: int):
    """The ``k`` best of each ``at`` by score, then ``to``, in that order."""
    order = np.lexsort((to, -score, at))
    at, to, score = at[order], to[order], score[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], to[keep], score[keep]


def _scorer(k: int | None, threshold: float | None, pivots: np.ndarray | None = None, bounds: dict | None = None):
    """Scores a block of queries against a block of vectors, some of each at a time. With ``bounds`` ``{cluster: (least, most angle)}``
    the vectors say their cluster (``own``) and the queries the one they have seen (``home``): pairs of a query and a cluster that
    can't reach the query's floor are left out."""
    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"qid": [], "did": [], "lead": [], "score": []})
        # cosine; a zero vector scores 0 (F12). Rounded to 9 places so that equal vectors tie
        # exactly whatever the summation order, and ties resolve by id.
        c = c.sort_values("lead", kind="stable")
        qs, cs = _matrix(q["vec"]), _matrix(c["vec"])
        small = cs.astype(np.float32)
        off = 2.5e-7 * (cs.shape[1] + 8)  # more than single precision can be wrong by
        own = c["own"].to_numpy() if bounds is not None else np.zeros(len(c), np.int64)
        groups = [int(g) for g in np.unique(own)]
        slices = [(g, at[i:i + LEAST_BLOCK]) for g in groups for at in [np.flatnonzero(own == g)] for i in range(0, len(at), LEAST_BLOCK)]
        out = []
        for i in range(0, len(q), ROUTE_QUERIES):
            part = q.iloc[i:i + ROUTE_QUERIES]
            m = qs[i:i + ROUTE_QUERIES]
            m32 = m.astype(np.float32)
            floor = np.full(len(part), threshold) if threshold is not None else part["floor"].to_numpy(dtype=np.float64, copy=True)
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if bounds is not None:
                reach = dict(zip(groups, _reach(m, [(g, *bounds[g]) for g in groups], pivots).T))
            for g, at_c in slices:
                rows = np.arange(len(part))
                if bounds is not None:
                    rows = np.flatnonzero((reach[g] >= floor - 2 * SLACK) & (part["home"].to_numpy() != g))
                    if not len(rows):
                        continue
                sims = m32[rows] @ small[at_c].T
                least = floor[rows] - off
                hit = sims >= least[:, None]
                if k is not None and np.count_nonzero(hit) > 4 * k * len(rows) and sims.shape[1] > k:
                    least = np.maximum(least, np.partition(sims, -k, axis=1)[:, -k] - 2 * off)
                    hit = sims >= least[:, None]
                at, to = np.nonzero(hit)
                at, to = rows[at], at_c[to]
                exact = np.empty(len(at))
                for j in range(0, len(at), EXACT_ROWS):
                    exact[j:j + EXACT_ROWS] = np.einsum("ij,ij->i", m[at[j:j + EXACT_ROWS]], cs[to[j:j + EXACT_ROWS]])
                exact = np.round(exact, 9)
                keep = exact > threshold if threshold is not None else exact >= floor[at]
                found.append((at[keep], to[keep], exact[keep]))
                if k is not None and len(found[-1][0]):
                    found = [_leading(*map(np.concatenate, zip(*found)), k)]
                    at, _, exact = found[0]
                    last = np.flatnonzero(np.arange(len(at)) - np.searchsorted(at, at) == k - 1)
                    if threshold is None:
                        floor[at[last]] = np.maximum(floor[at[last]], exact[last])
            at, to, exact = map(np.concatenate, zip(*found))
            out.append((at + i, to, exact))
        at, to, exact = map(np.concatenate, zip(*out))
        return pd.DataFrame({"qid": q["qid"].to_numpy()[at], "did": c["cid"].to_numpy()[to], "lead": c["lead"].to_numpy()[to], "score": exact})
    return score


def _reach(m: np.ndarray, clusters: list, pivots: np.ndarray) -> np.ndarray:
    """The largest similarity that each query (unit vectors ``m``) can have with a vector of each of ``clusters``
    ``(cluster, least, most angle, ...)``; zero vectors are cluster -1."""
    ids, least, most = (np.array([c[i] for c in clusters]) for i in range(3))
    angle = np.arccos(np.clip(m @ pivots[np.maximum(ids, 0)].T, -1.0, 1.0))
    apart = np.maximum(0.0, np.maximum(angle - most, least - angle) - 1e-9)
    return np.where((np.linalg.norm(m, axis=1) > 0)[:, None] & (ids >= 0), np.cos(apart), 0.0)


def _id(df: DataFrame, name: str) -> Column:
    """An id column: whole numbers as bigint, any other type as it is."""
    return F.col(name).cast("bigint") if dict(df.dtypes)[name] in ("tinyint", "smallint", "int", "bigint") else F.col(name)


def _vector_classes(df: DataFrame, id_col: str, vec_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(classes ``(cid, vec, ids, lead)`` with their ``k`` smallest ids, members ``(cid, id)``) of rows with equal
    vectors; null vectors are left out."""
    rows = written(df.select(_id(df, id_col).alias("id"), F.col(vec_col).alias("vec")), "rows").where("vec is not null")  # a filter before would make vectors twice
    classes = top_k(rows, ["vec"], [F.asc("id")], k).groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = written(classes.select("vec", "ids", F.col("ids")[0].alias("lead"), F.monotonically_increasing_id().alias("cid")), "classes")
    return classes, rows.join(lookup(classes.select("vec", "cid")), "vec").select("cid", "id")


def _pivots(classes: DataFrame, n: int, cluster_rows: int) -> np.ndarray:
    """One vector in ``cluster_rows``, ``MOST_PIVOTS`` at most, by hash; no zero vectors."""
    some = classes.orderBy(F.xxhash64("vec"), "cid").limit(min(MOST_PIVOTS, max(1, n // cluster_rows))).select("vec").collect()
    m = _matrix([r["vec"] for r in some])
    m = m[np.linalg.norm(m, axis=1) > 0]
    return m[:max(1, PIVOT_FLOATS // max(1, m.shape[1]))] if len(m) else m


def _angles(vs, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors' angles to the pivots, and which vectors are zero."""
    m = _matrix(vs)
    return np.arccos(np.clip(m @ pivots.T, -1.0, 1.0)), ~(np.linalg.norm(m, axis=1) > 0)


def _clustered(pivots: np.ndarray):
    """Adds the nearest pivot (-1 for zero vectors or where there is no pivot) and the angle to it."""
    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            if len(pivots):
                angle, zero = _angles(pdf["vec"], pivots)
                near = angle.argmin(axis=1)
                pdf["cluster"], pdf["angle"] = np.where(zero, -1, near), np.where(zero, 0.0, angle[np.arange(len(near)), near])
            else:
                pdf["cluster"], pdf["angle"] = -1, 0.0
            yield pdf
    return run


def _routes(pivots: np.ndarray, clusters: list, home: bool):
    """(qid, vec, floor) -> a row for the query's first cluster (``home``), or for all others it must visit."""
    ids = np.array([c[0] for c in clusters])
    least, most = (np.array([c[i] for c in clusters]) for i in (1, 2))

    def run(batches):
        for pdf in (b.iloc[i:i + ROUTE_QUERIES] for b in batches for i in range(0, len(b), ROUTE_QUERIES)):
            sim = np.zeros((len(pdf), len(ids)))
            if len(pivots):
                angle, zero = _angles(pdf["vec"], pivots)
                real = ids >= 0
                a = angle[:, ids[real]]
                apart = np.maximum(0.0, np.maximum(a - most[real], least[real] - a) - 1e-9)
                sim[:, real] = np.where(zero[:, None], 0.0, np.cos(apart))
                sim[:, real] += np.where(zero[:, None], 0.0, 1e-6 * (np.pi - a)) if home else SLACK  # equal bounds: the nearer pivot first
            first = sim.argmax(axis=1)
            if home:
                at, to = np.arange(len(pdf)), first
            else:
                at, to = np.nonzero((sim >= pdf["floor"].to_numpy()[:, None] - SLACK) & (ids[None, :] != pdf["home"].to_numpy()[:, None]))
            for i in range(0, len(at), ROUTE_ROWS):  # a query may visit every cluster
                q, c = at[i:i + ROUTE_ROWS], to[i:i + ROUTE_ROWS]
                yield pd.DataFrame({"qid": pdf["qid"].to_numpy()[q], "vec": pdf["vec"].to_numpy()[q], "floor": pdf["floor"].to_numpy()[q],
                                    "cluster": ids[c].astype("int32")})
    return run


def _shards(pivots: np.ndarray, clusters: list, block_rows: int) -> dict:
    """{cluster: shard}: neighbouring clusters packed into shards of about ``block_rows`` vectors. ``clusters``: (cluster, least, most, vectors)."""
    few = pivots[:max(1, math.isqrt(len(pivots)))]
    near = {c[0]: int((few @ pivots[c[0]]).argmax()) if c[0] >= 0 else -1 for c in clusters}
    shards, shard, held = {}, 0, 0
    for c in sorted(clusters, key=lambda c: (near[c[0]], c[0])):
        if held and held + c[3] > block_rows:
            shard, held = shard + 1, 0
        shards[c[0]], held = shard, held + c[3]
    return shards


def _shard_routes(pivots: np.ndarray, clusters: list, shards: dict):
    """(qid, vec, floor, home) -> a row for each shard with a cluster that the query must visit."""
    clusters = sorted(clusters, key=lambda c: shards[c[0]])
    names, starts = np.unique([shards[c[0]] for c in clusters], return_index=True)
    ids = np.array([c[0] for c in clusters])

    def run(batches):
        for pdf in (b.iloc[i:i + ROUTE_QUERIES] for b in batches for i in range(0, len(b), ROUTE_QUERIES)):
            reach = _reach(_matrix(pdf["vec"]), clusters, pivots)
            visit = (reach >= pdf["floor"].to_numpy()[:, None] - 2 * SLACK) & (ids[None, :] != pdf["home"].to_numpy()[:, None])
            at, to = np.nonzero(np.logical_or.reduceat(visit, starts, axis=1))
            for i in range(0, len(at), ROUTE_ROWS):
                rows = pdf.iloc[at[i:i + ROUTE_ROWS]]
                yield rows[["qid", "vec", "floor", "home"]].assign(cluster=names[to[i:i + ROUTE_ROWS]].astype("int32"))
    return run


def _visit(routed: DataFrame, corpus: DataFrame, k: int | None, threshold: float | None, block_rows: int,
           pivots: np.ndarray | None = None, bounds: dict | None = None) -> DataFrame:
    """Score routed queries in their clusters (or shards, see ``_scorer``), at most about ``block_rows`` of each side in a task."""
    types = dict(corpus.dtypes)
    parts = lambda df, name: df.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))
    n = F.broadcast(parts(routed, "qs").join(parts(corpus, "cs"), "cluster"))  # a row a cluster; routes and vectors stay where they are
    deal = lambda df, key, own, other: df.join(n, "cluster").select(
        *[F.col(c).alias(c) for c in df.columns], F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(own[0]),
        F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[0]))
    q, c = deal(routed, "qid", "qs", "cs"), deal(corpus, "cid", "cs", "qs")
    return (q.groupBy("cluster", "q", "c").cogroup(c.groupBy("cluster", "q", "c"))
            .applyInPandas(_scorer(k, threshold, pivots, bounds), f"qid long, did long, lead {types['lead']}, score double"))


def knn(queries: DataFrame, corpus: DataFrame, k: int | None = 10, threshold: float | None = None,
        q_id: str = "id", q_vec: str = "vec", c_id: str = "id", c_vec: str = "vec",
        exclude_self: bool = False, block_rows: int | None = None, cluster_rows: int = CLUSTER_ROWS, report: dict | None = None) -> DataFrame:
    """(qid, cid, sim, rank): per query the ``k`` most similar corpus rows (ties by corpus id),
    or with ``threshold`` every corpus row with similarity above it.

    Classes and clusters are written in the shared folder. ``report`` receives how many
    (query, cluster) pairs there are and how many were visited. ``block_rows`` of each side meet in a task.
    """
    most = None if threshold is not None else k + 1 if exclude_self else k
    same = queries is corpus and (q_id, q_vec) == (c_id, c_vec)
    c_classes, c_members = _vector_classes(corpus, c_id, c_vec, most or 1)
    q_classes, q_members = (c_classes, c_members) if same else _vector_classes(queries, q_id, q_vec, 1)
    ids, n = c_classes.select("cid", "ids"), c_classes.count()
    types = dict(c_classes.dtypes) | {"vec": dict(c_classes.dtypes)["vec"], "q_vec": dict(q_classes.dtypes)["vec"]}
    if block_rows is None:
        wide = c_classes.select(F.max(F.size("vec"))).first()[0] or 1
        block_rows = max(1, min(BLOCK_FLOATS // max(1, wide), max(LEAST_BLOCK, -(-n // 8))))
    asked = q_classes.select(F.col("cid").alias("qid"), "vec")
    placed = c_classes.select("cid", "lead", "vec")
    if n <= max(cluster_rows, 1):  # too few to tell clusters apart: all in one
        pivots, clusters = np.zeros((0, 0)), [(-1, 0.0, 0.0, n)] * min(n, 1)
        placed = placed.withColumns({"cluster": F.lit(-1), "angle": F.lit(0.0)})
    else:
        pivots = _pivots(c_classes, n, cluster_rows)
        placed = written(placed.mapInPandas(_clustered(pivots), f"cid long, lead {types['lead']}, vec {types['vec']}, cluster int, angle double"), "clusters")
        clusters = [tuple(r) for r in placed.groupBy("cluster").agg(F.min("angle"), F.max("angle"), F.count(F.lit(1))).orderBy("cluster").collect()]  # a row a pivot
    route = f"qid long, vec {types['q_vec']}, floor double, cluster int"
    placed = placed.drop("angle")
    if not clusters:
        best = asked.limit(0).select("qid", F.lit(0).cast("long").alias("did"), F.lit(0.0).alias("score"))
        visited = 0
    elif len(clusters) == 1 and len(pivots) == 0:
        visited = asked.count() if report is not None else 0
        all_of_them = asked.select("qid", "vec", F.lit(-2.0 if threshold is None else float(threshold)).alias("floor"), F.lit(-1).alias("cluster"))
        best = _visit(all_of_them, placed, most, threshold, block_rows)
        if threshold is None:
            best = top_k(best, ["qid"], [F.desc("score"), F.asc("lead")], most)
    else:
        shards, bounds = _shards(pivots, clusters, block_rows), {c[0]: (c[1], c[2]) for c in clusters}
        of = F.expr(f"element_at(array({', '.join(str(shards.get(c, 0)) for c in range(-1, len(pivots)))}), own + 2)")
        sharded = placed.withColumnRenamed("cluster", "own").withColumn("cluster", of)
        visits = lambda df: (df.mapInPandas(_routes(pivots, clusters, False), route).count() if report is not None else 0)
        in_shards = lambda df: _visit(df.mapInPandas(_shard_routes(pivots, clusters, shards), f"qid long, vec {types['q_vec']}, floor double, home int, cluster int"),
                                      sharded, most, threshold, block_rows, pivots, bounds)
        if threshold is not None:
            waiting = asked.withColumns({"floor": F.lit(float(threshold)), "home": F.lit(-2)})
            visited, best = visits(waiting), in_shards(waiting)
        else:
            order = [F.desc("score"), F.asc("lead")]
            home = written(asked.withColumns({"floor": F.lit(-2.0), "home": F.lit(-2)}).mapInPandas(_routes(pivots, clusters, True), route), "homes")
            first = released(written(_visit(home, placed, most, None, block_rows), "first"))
            kth = top_k(first, ["qid"], order, most).where(F.col("rank") == most).select("qid", F.col("score").alias("kth"))
            visited, best = home.count() if report is not None else 0, first
            if len(clusters) > 1:
                waiting = released(written(home.select("qid", "vec", F.col("cluster").alias("home")).join(kth, "qid", "left")
                                           .select("qid", "vec", F.coalesce("kth", F.lit(-2.0)).alias("floor"), "home"), "waiting"))
                visited += visits(waiting)
                best = first.unionByName(in_shards(waiting))
            best = top_k(best, ["qid"], order, most)
    if report is not None:
        report.update(clusters=len(clusters), pairs=asked.count() * len(clusters), visited=visited)
    if threshold is not None:
        out = (best.join(c_members.select(F.col("cid").alias("did"), F.col("id").alias("other")).hint("merge"), "did")
               .join(q_members.select(F.col("cid").alias("qid"), "id"), "qid"))
        if exclude_self:
            out = out.where(F.col("id") != F.col("other"))
        return out.select(F.col("id").alias("qid"), F.col("other").alias("cid"), F.col("score").alias("sim"))
    return spread(best, ids, q_members, k, exclude_self).select(F.col("id").alias("qid"), F.col("other").alias("cid"), F.col("score").alias("sim"), "rank")


def cosine(a: Column, b: Column) -> Column:
    """F12 as a column expression (double precision; 0 when a norm is 0)."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when((na * nb) > 0, dot / (na * nb)).otherwise(F.lit(0.0))


def centroids(df: DataFrame, group: str, vec: str, dims: int) -> DataFrame:
    """Mean vector per group (element-wise average), as a derived query table."""
    el = df.select(group, F.posexplode(vec).alias("i", "x"))
    m = el.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return (m.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
            .select(group, F.transform("s", lambda e: e["x"]).alias("vec")))


def with_hashed_embedding(df: DataFrame, text_col: str, out_col: str = "vec", dims: int = 64) -> DataFrame:
    """E12 offline encoder: signed hashed bag of lower-cased letter/digit tokens, L2-normalised.

    A token's bucket and sign come from its md5 (bucket = last two hex digits mod
    ``dims``, sign from the first hex digit's parity); empty text gives the zero
    vector (D21). Built in separate projections so every intermediate array is
    computed once per row; all steps are built-in expressions (no Python).
    """
    toks = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"),
                    lambda t: F.length(t) > 0)
    steps = df.withColumn("_h", F.transform(toks, lambda t: F.struct(
        F.pmod(F.conv(F.substring(F.md5(t), 31, 2), 16, 10).cast("int"), F.lit(dims)).alias("b"),
        F.when(F.conv(F.substring(F.md5(t), 1, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0).alias("s"))))
    steps = steps.withColumn("_c", F.aggregate(
        "_h", F.array_repeat(F.lit(0.0), dims),
        lambda acc, h: F.transform(acc, lambda x, i: x + F.when(i == h["b"], h["s"]).otherwise(0.0))))
    steps = steps.withColumn("_n", F.sqrt(F.aggregate("_c", F.lit(0.0), lambda acc, x: acc + x * x)))
    return steps.withColumn(out_col, F.transform(
        "_c", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0).cast("float"))).drop("_h", "_c", "_n")


def embed_with(encoder, dims: int):
    """E12 pluggable path: wrap a batch encoder ``list[str] -> np.ndarray[n, dims]`` as an
    iterator pandas UDF (Arrow batches; the model loads once per task). Empty text
    maps to the zero vector so output stays aligned with input (D21)."""
    from collections.abc import Iterator

    from pyspark.sql.functions import pandas_udf

    def _embed(batches):
        for s in batches:
            texts = s.fillna("").tolist()
            out = np.zeros((len(texts), dims), dtype=np.float32)
            idx = [i for i, t in enumerate(texts) if t.strip()]
            if idx:
                out[idx] = np.asarray(encoder([texts[i] for i in idx]), dtype=np.float32)
            yield pd.Series(list(out))
    # real (not string) hints: this module uses postponed annotations
    _embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(_embed, "array<float>")
