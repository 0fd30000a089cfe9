"""Operator 5: exact duplicates with a heavy-hitter split.

Digests of the normalised texts are written once. Each task keeps a Misra-Gries summary of
``COUNTERS`` digests; the summed summaries name at most ``COUNTERS`` frequent ones, whose exact
sizes and winners are then counted (aggregated in the task, so a frequent digest ships one row a
task) and broadcast: their rows are settled without a shuffle. All other digests have small
groups and go through an ordinary shuffle. The summaries decide the route, never the result.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.llm.common import ascii_lower, materialise

COUNTERS = 1024


def summarise(counts: dict, k: int) -> dict:
    """Cut a digest -> count summary back to ``k`` counters, each lowered by the largest cut."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return {d: c - cut for d, c in counts.items() if c > cut}


def _misra_gries(k: int):
    def run(batches):
        held: dict = {}
        for batch in batches:
            for x in pc.value_counts(batch.column(0)).to_pylist():
                held[x["values"]] = held.get(x["values"], 0) + x["counts"]
            held = summarise(held, k)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["sha", "n"])
    return run


def text_digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, sha): SHA-256 of the A-Z-lower-cased text (null: empty) of every row."""
    return materialise(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), 256)).alias("sha")), "digests")


def _groups(d: DataFrame) -> DataFrame:
    return d.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))


def duplicate_groups(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``text_digests`` rows -> the same rows with the winner (``keep_id``), ``group_size``, ``kept``."""
    frequent = (digests.select("sha").mapInArrow(_misra_gries(counters), "sha binary, n long")
                .groupBy("sha").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sha").limit(counters).select("sha"))
    hot = materialise(_groups(digests.join(F.broadcast(frequent), "sha")), "winners")  # at most COUNTERS rows
    settled = digests.join(F.broadcast(hot), "sha")
    rest = digests.join(F.broadcast(hot.select("sha")), "sha", "left_anti")
    return settled.unionByName(rest.join(_groups(rest), "sha")).select(
        "row", "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size",
        (F.col("top.row") == F.col("row")).alias("kept"), "sha")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row for each row: ``doc_id``, ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty, and empty
    texts are equal. Of a group the largest doc_id stays; of rows that repeat it, one does; a null
    doc_id is the smallest. Other columns are ignored. An empty table gives no rows.
    """
    return duplicate_groups(text_digests(docs)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts (null as empty) the row with the
    largest doc_id; of rows that repeat both, one of them. An empty table stays empty."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.sha2(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), 256).alias("sha"))
    found = materialise(exact_duplicates(docs), "exact")
    keep = found.where("kept").select(F.col("doc_id").alias("keep_doc"), F.col("text_sha256").alias("keep_sha"))
    repeated = found.groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count()
    if repeated:  # rows that repeat both id and text: one of each stays
        rows = rows.dropDuplicates(["id", "sha"])
    return rows.join(keep, F.col("id").eqNullSafe(F.col("keep_doc")) & (F.col("sha") == F.col("keep_sha")), "left_semi").select("row.*")
