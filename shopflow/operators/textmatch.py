"""Set-at-a-time string matching: substring, prefix and one-typo matches as equi-joins.

Queries and documents are both tables. Instead of comparing every query with
every document (a nested loop), each operator builds a small key table on both
sides and joins on it, then verifies the candidates exactly:

* substring: character-trigram postings; each query probes only with its rarest
  trigram (by document frequency), so a common trigram never drives the join.
  Queries shorter than three characters probe the 1- or 2-gram postings directly.
* prefix: edge-gram table ``(gram, id)`` of the lower-cased title.

The queries' keys are written once and measured: few of them are broadcast, and the documents
stream past without a shuffle; many meet the postings by sorting. Postings are never broadcast.
* one edit: deletion neighbourhoods of both sides, verified with ``levenshtein``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.operators.topk import top_k
from shopflow.session import lookup, lookup_fits, written


def _grams(t: Column, n: int) -> Column:
    return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1),
                                                lambda i: F.substring(t, i, n)))


def gram_postings(docs: DataFrame, n: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(gram, id) over the lower-cased text, once per document."""
    t = F.lower(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(_grams(t, n))).alias("gram"))


def substring_matches(queries: DataFrame, docs: DataFrame, q_col: str = "q",
                      id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(q, id) for every distinct query text contained, case-insensitively, in a document text.

    ``queries`` holds query texts (already lower-cased or not; matching lower-cases
    both sides). Empty queries match nothing here; callers decide what an empty
    query means.
    """
    qs = queries.select(F.col(q_col).alias("q")).where(F.length("q") > 0).distinct()
    ql = F.lower(F.col("q"))
    d = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("_t"))
    dfreq = gram_postings(d, 3, "id", "_t").groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    qgrams = (qs.where(F.length("q") >= 3)
              .select("q", F.explode(_grams(ql, 3)).alias("gram")).distinct())
    rarest = top_k(qgrams.join(dfreq.hint("merge"), "gram"), ["q"], [F.asc("df"), F.asc("gram")], 1)
    short = qs.where(F.length("q") < 3).select("q", ql.alias("gram"), F.length("q").alias("n"))
    probes = written(rarest.select("q", "gram", F.lit(3).alias("n")).unionByName(short), "probes")
    out = None
    for n in sorted(r["n"] for r in probes.select("n").distinct().collect()):
        probe = probes.where(F.col("n") == n).select("q", "gram")
        if n < 3:
            hits = gram_postings(d, n, "id", "_t").join(lookup(probe), "gram").select("q", "id").distinct()
        elif lookup_fits(probe):
            # the text travels with its grams inside a task, so a match is verified on the spot
            grams = d.where("id is not null").select("id", "_t", F.explode(F.array_distinct(_grams(F.col("_t"), 3))).alias("gram"))
            hits = grams.join(F.broadcast(probe), "gram").where(F.col("_t").contains(ql)).select("q", "id")
        else:
            cand = gram_postings(d, 3, "id", "_t").join(probe.hint("merge"), "gram").select("q", "id").distinct()
            hits = cand.join(d.hint("merge"), "id").where(F.col("_t").contains(ql)).select("q", "id")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = d.select(F.lit("").alias("q"), "id").where(F.lit(False))
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def edge_grams(docs: DataFrame, id_col: str = "id", text_col: str = "title") -> DataFrame:
    """(gram, id): every leading substring of the lower-cased text, once per document."""
    t = F.lower(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), F.explode(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))),
                    lambda i: F.substring(t, 1, i))).alias("gram")).where(F.length("gram") > 0)


def prefix_matches(prefixes: DataFrame, docs: DataFrame, p_col: str = "prefix",
                   id_col: str = "id", text_col: str = "title") -> DataFrame:
    """(prefix, id) where the text starts with the prefix, case-insensitively."""
    ps = prefixes.select(F.col(p_col).alias("prefix")).where(F.length("prefix") > 0).distinct()
    ps = written(ps.withColumn("gram", F.lower("prefix")), "prefixes")
    return edge_grams(docs, id_col, text_col).join(lookup(ps), "gram").select("prefix", "id").distinct()


def token_edge_grams(docs: DataFrame, min_gram: int = 2,
                     id_col: str = "id", text_col: str = "title") -> DataFrame:
    """(gram, id): leading substrings (``min_gram`` characters and more) of every whitespace token of the text."""
    toks = docs.select(F.col(id_col).alias("id"),
                       F.explode(F.split(F.lower(F.col(text_col)), r"\s+")).alias("tok"))
    toks = toks.where(F.length("tok") >= min_gram)
    return (toks.select("id", F.explode(F.transform(
        F.sequence(F.lit(min_gram), F.length("tok")),
        lambda i: F.substring("tok", 1, i))).alias("gram")).distinct())


def _deletions(s: Column) -> Column:
    """The string itself and every single-character deletion of it."""
    return F.array_union(F.array(s), F.transform(
        F.sequence(F.lit(1), F.length(s)),
        lambda i: F.concat(F.substring(s, 1, i - 1), F.substr(s, i + 1))))


def one_edit_matches(queries: DataFrame, grams: DataFrame, q_col: str = "q") -> DataFrame:
    """(q, gram, dist) for vocabulary grams within Levenshtein distance 1 of the lower-cased query."""
    qs = (queries.select(F.col(q_col).alias("q")).where(F.length("q") > 0).distinct()
          .withColumn("ql", F.lower("q")))
    qv = qs.select("q", "ql", F.explode(_deletions(F.col("ql"))).alias("v"))
    vocab = grams.select("gram").distinct()
    gv = vocab.select("gram", F.explode(_deletions(F.col("gram"))).alias("v"))
    pairs = qv.join(gv, "v").select("q", "ql", "gram").distinct()
    return (pairs.withColumn("dist", F.levenshtein("ql", "gram", 1))
            .where(F.col("dist") >= 0).select("q", "gram", "dist"))
