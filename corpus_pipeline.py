"""A corpus pipeline: quality, exact copies, near copies, benchmark leaks, source mix.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each stage's
rows as Parquet in the shared folder and gives the reread table to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopflow.llm.common import materialise, table
from shopflow.llm.decontam import drop_contaminated
from shopflow.llm.exact_dedup import drop_exact_duplicates
from shopflow.llm.mixing import mix_sources
from shopflow.llm.ngram_join import drop_near_copies
from shopflow.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, scored by their whole texts (null as empty); equal texts fare alike. An empty table stays empty."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts (null as empty) the row with the largest doc_id, nulls smallest; of rows that repeat both, one."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the group's smallest id, nulls last, ties by text digest; texts without words all stay."""
    return drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each judged by its own text; null and empty texts stay, and all do if there are no items."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document; a null source is one of its own, null and empty texts have size 0."""
    return mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("benchmark", benchmark), ("mix", mix)]
# A trained classifier decides the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
