"""Operator 13: ranked lexical search over impact vectors in norm buckets.

A document is a vector of impacts, a query one of term weights, and a score their product. Both
are scaled by the square root of the weights, and documents are cut down to the terms that some
query has, which changes no product. Documents are range-partitioned by descending length and cut into
buckets. A bucket whose longest vector times the query's length stays below the query's k-th
best score so far holds no answer (Cauchy-Schwarz). Inside a bucket, coordinates are taken by the
most they can add there until the others together can't reach that score: only documents on
those coordinates can, and of these only the ones whose sum so far, with the most the rest of
the vector can add, reaches it. They are scored again in 64-bit integers. The longest
vectors go first, so that the others begin with a k-th best score for each query.

Floating-point bounds are widened by ``SLACK``; they decide work, never results. Queries go in
blocks of about ``BLOCK_TERMS`` terms, each with one pass over the documents.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopflow.llm.common import materialise, text_chunks

BLOCK_TERMS = 1 << 19
BUCKET_ROWS, BUCKET_ENTRIES = 4096, 1 << 20
SLACK = 1e-9
# What is no letter, digit or byte of a non-ASCII character separates; A-Z are lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def _query_terms(batches):
    for rows, texts in text_chunks(batches, "text"):
        found = [sorted(set(terms(t))) for t in texts]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(found, pa.list_(pa.binary()))], names=["q", "item_id", "terms"])


def _vectors(vocabulary):
    def run(batches):
        known = vocabulary.value
        for rows, texts in text_chunks(batches, "text"):
            ids, n, ends, tids, tfs = [], [], [0], [], []
            for i, t in enumerate(texts):
                words = terms(t)
                if not words:
                    continue
                got = Counter(filter(known.__contains__, words))
                ids.append(i)
                n.append(len(words))
                tids.extend(map(known.__getitem__, got))
                tfs.extend(got.values())
                ends.append(len(tids))
            lists = lambda v: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(ids, pa.int64())), pa.array(n, pa.int64()), lists(tids), lists(tfs)],
                                             names=["doc_id", "n", "tids", "tfs"])
    return run


def _impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """Impacts in 64-bit integers; ``docs`` have at least one term, ``length`` terms in all."""
    m = 100 - 90 + (90 * n * docs) // length
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _flat(batch, name):
    col = batch.column(batch.schema.get_field_index(name))
    return np.diff(np.asarray(col.offsets)), np.asarray(col.flatten()).astype(np.int64)


def _norms(weights, docs: int, length: int):
    def run(batches):
        w = weights.value
        for b in batches:
            if not b.num_rows:
                continue
            sizes, tids = _flat(b, "tids")
            _, tfs = _flat(b, "tfs")
            row = np.repeat(np.arange(b.num_rows), sizes)
            n = np.asarray(b.column(b.schema.get_field_index("n")))
            imp = _impacts(tfs, n[row], docs, length)
            norm = np.sqrt(np.bincount(row, weights=w[tids] * imp.astype(float) ** 2, minlength=b.num_rows))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(norm)], names=[*b.schema.names, "norm"])
    return run


class _Bucket:
    """Some documents' vectors by coordinate, each coordinate's entries by document."""

    def __init__(self, part: pa.Table, w: np.ndarray, docs: int, length: int):
        part = part.combine_chunks()
        batch = part.to_batches()[0]
        sizes, tids = _flat(batch, "tids")
        _, tfs = _flat(batch, "tfs")
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        self.known = np.asarray(ids.is_valid())
        self.ids = np.asarray(ids.fill_null(0))
        self.norm = np.asarray(batch.column(batch.schema.get_field_index("norm")))
        row = np.repeat(np.arange(batch.num_rows), sizes)
        imp = _impacts(tfs, np.asarray(batch.column(batch.schema.get_field_index("n")))[row], docs, length)
        order = np.argsort(tids, kind="stable")
        tids = tids[order]
        self.row, self.exact = row[order], (w[tids] * imp[order])
        self.value = np.sqrt(w[tids]) * imp[order]
        self.tid, at = np.unique(tids, return_index=True)
        self.start, self.end = at, np.append(at[1:], len(tids))
        self.most = np.maximum.reduceat(self.value, at) if len(at) else np.zeros(0)
        self.longest = self.norm.max()

    def candidates(self, at: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
        """Rows that may score ``least``; ``at`` are the query's coordinates in the bucket, ``q`` their values."""
        gain = q * self.most[at]
        order = np.argsort(-gain, kind="stable")
        rest = np.append(np.cumsum(gain[order][::-1])[::-1], 0.0)  # what the coordinates from j on can add
        focus = int(np.argmax(rest * (1 + SLACK) < least)) if least > 0 else len(order)
        if least > 0 and rest[focus] * (1 + SLACK) >= least:
            return np.zeros(0, np.int64)
        got, used = np.zeros(len(self.norm)), np.zeros(len(self.norm))
        for j in order[:focus]:
            s = slice(self.start[at[j]], self.end[at[j]])
            got[self.row[s]] += q[j] * self.value[s]
            used[self.row[s]] += self.value[s] ** 2
        left = np.sqrt(np.maximum(self.norm ** 2 * (1 + SLACK) - used, 0)) * math.sqrt(float((q[order[focus:]] ** 2).sum()))
        return np.flatnonzero((got > 0) & ((got + np.minimum(left, rest[focus])) * (1 + SLACK) >= least))

    def scores(self, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.norm), np.int64)
        for j in at:
            s = slice(self.start[j], self.end[j])
            total[self.row[s]] += self.exact[s]
        return total[rows]


def _best(score, known, ids, k):
    """The ``k`` best: highest score, then null ids, then ascending ids."""
    keep = np.lexsort((ids, known, -score))[:k]
    return score[keep], known[keep], ids[keep]


def _search(shared, docs: int, length: int, k: int):
    def run(batches):
        held = shared.value
        w, queries, floors = held["weights"], held["queries"], held["floors"]
        root = np.sqrt(w)
        tops = {}

        def look(part: pa.Table):
            bucket = _Bucket(part, w, docs, length)
            for q, tids in queries.items():
                values = root[tids]
                top = tops.get(q)
                least = max(floors.get(q, 0), int(top[0][-1]) if top and len(top[0]) == k else 0)
                if least and bucket.longest * math.sqrt(float((values ** 2).sum())) * (1 + SLACK) < least:
                    continue
                at = np.searchsorted(bucket.tid, tids)
                here = at < len(bucket.tid)
                here[here] = bucket.tid[at[here]] == tids[here]
                at, values = at[here], values[here]
                if not len(at):
                    continue
                rows = bucket.candidates(at, values, least)
                if not len(rows):
                    continue
                score = bucket.scores(at, rows)
                good = score >= max(least, 1)
                rows, score = rows[good], score[good]
                if len(rows):
                    new = (score, bucket.known[rows], bucket.ids[rows])
                    tops[q] = _best(*(np.concatenate(x) for x in zip(top, new)) if top else new, k)

        parts, rows, entries = [], 0, 0
        for b in batches:
            for piece in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                parts.append(piece)
                rows += piece.num_rows
                entries += len(piece.column(piece.schema.get_field_index("tids")).flatten())
                if rows >= BUCKET_ROWS or entries >= BUCKET_ENTRIES:
                    look(pa.Table.from_batches(parts))
                    parts, rows, entries = [], 0, 0
        if parts:
            look(pa.Table.from_batches(parts))
        for q, (score, known, ids) in tops.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q)), pa.array(ids, mask=~known), pa.array(score)], names=["q", "doc_id", "score"])
    return run


def _weights(docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


FOUND = "q long, doc_id long, score long"


def _search_block(docs: DataFrame, queries: dict, k: int) -> DataFrame:
    """(q, doc_id, score): a superset of the ``k`` best documents of each query of one block."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*queries.values())))}
    vectors = materialise(docs.mapInArrow(_vectors(spark.sparkContext.broadcast(vocabulary)),
                                          "doc_id long, n long, tids array<int>, tfs array<int>"), "vectors")
    n_docs, length = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("tids").alias("tid")).groupBy("tid").count().collect():  # a row a term of the block
        df[r["tid"]] = r["count"]
    w = _weights(n_docs, df)
    shared = {"weights": w, "queries": {q: np.array(sorted(vocabulary[t] for t in ts), np.int64) for q, ts in queries.items()}, "floors": {}}
    ordered = (vectors.where(F.size("tids") > 0).mapInArrow(_norms(spark.sparkContext.broadcast(w), n_docs, length),
                                                            "doc_id long, n long, tids array<int>, tfs array<int>, norm double")
               .repartitionByRange(F.desc("norm"), "doc_id").sortWithinPartitions(F.desc("norm")))
    ordered = materialise(ordered, "by_norm")
    cut = ordered.agg(F.percentile_approx("norm", 0.9, 1000)).first()[0] or 0.0
    first = materialise(ordered.where(F.col("norm") >= cut).mapInArrow(_search(spark.sparkContext.broadcast(shared), n_docs, length, k), FOUND), "longest")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
    floors = {r["q"]: r["score"] for r in first.withColumn("place", place).where(F.col("place") == k).collect()}  # a row a query of the block
    rest = ordered.where(F.col("norm") < cut).mapInArrow(
        _search(spark.sparkContext.broadcast(shared | {"floors": floors}), n_docs, length, k), FOUND)
    return first.unionByName(rest)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """For each row of ``items(item_id, text, ...)`` its ``k`` best rows of ``docs(doc_id, text, ...)`` with a
    score above 0: ``item_id``, ``rank``, ``doc_id``, ``score``.

    Equal scores rank by ascending doc_id, null first. Null and empty texts have no terms: such an
    item has no rows, such a document is in none and isn't counted. Repeated and null ids are rows of their own.
    Terms of any length count. Other columns are ignored. If either table is empty, there are no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.monotonically_increasing_id().alias("q"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = materialise(items.mapInArrow(_query_terms, "q long, item_id long, terms array<binary>"), "queries")
    n_terms = items.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-n_terms // block_terms))
    found = None
    for b in range(blocks):
        block = items.where((F.size("terms") > 0) & (F.pmod(F.xxhash64("q"), F.lit(blocks)) == b))
        queries = {r["q"]: [bytes(t) for t in r["terms"]] for r in block.select("q", "terms").toLocalIterator()}  # about block_terms terms
        if queries:
            part = _search_block(docs, queries, k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = items.sparkSession.createDataFrame([], FOUND)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(items.select("q", "item_id"), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
