"""Table mutation on plain parquet snapshots.

Plain parquet tables do not support ``MERGE``/``DELETE``, so every mutation
computes the next snapshot as a DataFrame (anti-join for deletes, full-outer
merge for upserts) and writes it as a new version folder; readers take the
latest committed version. The mutation functions themselves are pure
DataFrame -> DataFrame, so they also run inside ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shopflow.operators.topk import top_k


def last_wins(batch: DataFrame, key: str, order: list) -> DataFrame:
    """Keep the last row per key under ``order`` (the batch position)."""
    return top_k(batch, [key], [F.desc(c) if isinstance(c, str) else c for c in order], 1, "_rk").drop("_rk")


def first_wins(batch: DataFrame, key: str, order: list) -> DataFrame:
    """Keep the first row per key under ``order``; null keys dropped."""
    return top_k(batch.where(F.col(key).isNotNull()), [key], [F.asc(c) if isinstance(c, str) else c for c in order],
                 1, "_rk").drop("_rk")


def upsert(current: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Batch rows replace current rows with the same key; others are kept.

    ``batch`` must already hold one row per key (see ``last_wins``). Adds
    ``_action`` = inserted / updated / kept.
    """
    cols = [c for c in current.columns]
    b = batch.select(*[F.col(c) for c in cols]).withColumn("_in_batch", F.lit(True))
    c = current.select(F.col(key)).withColumn("_in_current", F.lit(True))
    tagged = b.join(c, key, "left").withColumn(
        "_action", F.when(F.col("_in_current"), "updated").otherwise("inserted")).drop("_in_batch", "_in_current")
    kept = current.join(batch.select(key), key, "left_anti").withColumn("_action", F.lit("kept"))
    return tagged.select(*cols, "_action").unionByName(kept.select(*cols, "_action"))


def upsert_counts(current: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Processed / inserted / updated counts of an upsert."""
    keys = batch.select(key).distinct()
    j = keys.join(current.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return j.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("_hit").isNull()).alias("inserted"),
                 F.count_if(F.col("_hit").isNotNull()).alias("updated"))


def delete_keys(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without rows whose key is listed."""
    return current.join(keys.select(key).distinct(), key, "left_anti")


def delete_counts(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Deleted and remaining row counts of a delete, in one pass."""
    k = keys.select(key).distinct().withColumn("_del", F.lit(True))
    j = current.join(k, key, "left")
    return j.agg(F.count_if(F.col("_del").isNotNull()).alias("deleted"),
                 F.count_if(F.col("_del").isNull()).alias("remaining"))


def delete_all(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The emptied tables and (table_name, deleted, remaining); a table derived from another
    (the product pairs) is listed with it and goes too."""
    counts = None
    for name, t in tables.items():
        c = t.agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table_name"), "deleted", F.lit(0).cast("bigint").alias("remaining"))
        counts = c if counts is None else counts.unionByName(c)
    return {name: t.limit(0) for name, t in tables.items()}, counts


def lookup(ids: DataFrame, table: DataFrame, key: str = "id", cols: tuple[str, ...] = ("title",)) -> DataFrame:
    """Every requested id with ``found`` and the row's columns (nulls when missing)."""
    t = table.select(key, *cols).withColumn("found", F.lit(True))
    return (ids.select(key).distinct().join(t, key, "left")
            .select(key, F.coalesce(F.col("found"), F.lit(False)).alias("found"), *cols))


def reconcile(expected: DataFrame, loaded: DataFrame, key: str = "id", show: int = 10) -> DataFrame:
    """Found / missing counts over all expected ids, with the first ``show`` missing ids."""
    e = expected.select(key).distinct()
    missing = e.join(loaded.select(key).distinct(), key, "left_anti")
    counts = e.join(loaded.select(key).distinct().withColumn("_f", F.lit(1)), key, "left").agg(
        F.count(F.lit(1)).alias("expected"), F.count("_f").alias("found"))
    first = missing.orderBy(key).limit(show).agg(F.sort_array(F.collect_list(key)).alias("missing_ids"))
    return counts.withColumn("missing_ids", first.scalar()).select(
        "expected", "found", (F.col("expected") - F.col("found")).alias("missing"), "missing_ids")


def pair_status(pairs: DataFrame) -> DataFrame:
    """``Ready`` with the pair count, or ``Not computed``."""
    return pairs.agg(F.count(F.lit(1)).alias("pair_count")).withColumn(
        "status", F.when(F.col("pair_count") > 0, "Ready").otherwise("Not computed"))


# ---- snapshot storage --------------------------------------------------------------------------

def write_version(df: DataFrame, root: str, version: int, max_records_per_file: int | None = None) -> str:
    """Write ``df`` as version ``version`` of the table at ``root`` and commit it."""
    w = df.write.mode("overwrite")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    path = f"{root}/v{version:08d}"
    w.parquet(path)
    df.sparkSession.createDataFrame([(version,)], "version bigint").write.mode("append").parquet(f"{root}/_commits")
    return path


def append_counted(df: DataFrame, path: str) -> int:
    """Append ``df`` to the table at ``path``; returns the rows appended, counted by the write itself."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
    return seen.get["rows"]


def rebuild_counted(df: DataFrame, root: str) -> tuple[int, int]:
    """Write ``df`` as the next version of the table at ``root``; returns (old rows, new rows), the new ones
    counted by the write itself."""
    spark = df.sparkSession
    version = latest_version(spark, root)
    old = 0 if version is None else read_latest(spark, root).count()
    seen = Observation()
    write_version(df.observe(seen, F.count(F.lit(1)).alias("rows")), root, 0 if version is None else version + 1)
    return old, seen.get["rows"]


def file_sizes(df: DataFrame) -> DataFrame:
    """(files, bytes) behind a file-based table, from each file's metadata; no data column is read."""
    files = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).groupBy("path").agg(F.max("size").alias("size"))
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def latest_version(spark: SparkSession, root: str) -> int | None:
    try:
        r = spark.read.parquet(f"{root}/_commits").agg(F.max("version")).first()[0]
    except AnalysisException:
        return None
    return r


def read_latest(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    v = latest_version(spark, root)
    if v is None:
        if schema is None:
            raise FileNotFoundError(root)
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{root}/v{v:08d}")


def load_statistics(load_log: DataFrame) -> DataFrame:
    """Totals over a load log (batch, inserted, updated, errors, started, finished):
    rows, batches, wall-clock span in seconds and rows per second."""
    span = F.timestamp_diff("MILLISECOND", F.min("started"), F.max("finished")) / 1000.0
    rows = F.sum(F.col("inserted") + F.col("updated"))
    return load_log.agg(
        F.count(F.lit(1)).alias("batches"), F.sum("inserted").alias("inserted"), F.sum("updated").alias("updated"),
        F.sum("errors").alias("errors"), span.alias("duration_s"),
        F.when(span > 0, F.round(rows / span, 3)).otherwise(F.lit(0.0)).alias("rows_per_s"))


def write_report(parts: dict[str, DataFrame], root: str, mode: str = "overwrite") -> dict[str, str]:
    """Write each report DataFrame (errors, coverage, summary, ...) as JSON under ``root/<name>``."""
    out = {}
    for name, df in parts.items():
        path = f"{root}/{name}"
        df.write.mode(mode).json(path)
        out[name] = path
    return out
