"""Structured Streaming forms of the arriving-data paths.

All state, checkpoints and sinks live under the shared folder the session names
in ``spark.checkpoint.dir`` (see ``shopflow.session.checkpoint_dir``), so a job
restarted on another executor/driver resumes from its checkpoint.

Event time: ``withWatermark`` needs ``TIMESTAMP`` (not ``TIMESTAMP_NTZ``), so log
time is cast to ``timestamp`` before the watermark and cast back to NTZ in the
outputs.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from shopflow.functions.numbers import exact_avg
from shopflow.operators import pairs as PR
from shopflow.session import checkpoint_dir

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
LINES_SCHEMA = "orderNr bigint, productNr bigint, customerNr bigint, dateTime timestamp_ntz"


def job_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run of a job under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def read_log_stream(spark: SparkSession, path: str, glob: str | None = None,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Events-shaped parquet files arriving in ``path`` as a request-log stream."""
    r = spark.readStream.schema(EVENTS_SCHEMA).format("parquet")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    e = r.load(path)
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
                    F.col("event_type").alias("endpoint"), F.col("value").alias("duration_ms"),
                    F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"))


def windowed_stats(log: DataFrame, every: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Per event-time window and endpoint count, mean, max and success rate; rows later
    than the watermark are dropped by the engine."""
    ok = F.col("status_code").between(200, 299).cast("double")
    return (log.withWatermark("ts", delay)
            .groupBy(F.window("ts", every).alias("w"), "endpoint")
            .agg(F.count(F.lit(1)).alias("count"), F.round(exact_avg("duration_ms"), 6).alias("avg_duration_ms"),
                 F.max("duration_ms").alias("max_duration_ms"), F.round(F.avg(ok), 6).alias("success_rate"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "endpoint", "count",
                    "avg_duration_ms", "max_duration_ms", "success_rate"))


def session_stats(log: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Per user session (gap-based) events, clicks and purchases."""
    return (log.withWatermark("ts", delay)
            .groupBy("user_id", F.session_window("ts", gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("events"),
                 F.count_if(F.col("endpoint") == "click").alias("clicks"),
                 F.count_if(F.col("endpoint") == "purchase").alias("purchases"))
            .select("user_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("s.end").cast("timestamp_ntz").alias("session_end"), "events", "clicks", "purchases"))


def run_to_table(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append",
                 with_dropped: bool = False):
    """Run a streaming result with ``availableNow`` into a parquet sink and read it back.

    With ``with_dropped`` also return how many rows the stateful operators dropped as later
    than the watermark (the engine's own count, after partial aggregation). Spark judges
    lateness against the previous micro-batch's watermark, so rows are dropped from the
    batch after the one that advanced the watermark past them.
    """
    base = job_dir(spark, name)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1000000")  # drops are summed over all batches
    q = (stream.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", os.path.join(base, "checkpoint"))
         .option("path", os.path.join(base, "out")).trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(os.path.join(base, "out"))
    if not with_dropped:
        return out
    dropped = sum(int(s.get("numRowsDroppedByWatermark") or 0)
                  for p in q.recentProgress for s in p.get("stateOperators", []))
    return out, dropped


class PairTable:
    """A pair table that follows a stream exactly once.

    Each micro-batch writes its changes as an append-only delta folder, then a commit row; a
    redelivered batch id finds its commit and is skipped. The table is the base snapshot plus the
    committed deltas summed per pair; every ``compact_every`` batches the deltas are folded into a
    new base, so reads stay bounded. Called with a batch of deltas ``(product1, product2, d)``.
    """

    SCHEMA = "product1 bigint, product2 bigint, cnt bigint"

    def __init__(self, spark: SparkSession, base: str, compact_every: int = 20):
        self.spark, self.base, self.compact_every = spark, base, compact_every
        self.delta_path = f"{base}/pair_deltas"
        self.base_path = f"{base}/pair_base"
        self.commits_path = f"{base}/commits"

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], schema)

    def _commits(self) -> DataFrame:
        # one small row per finished batch; read through Spark so any shared filesystem works
        return self._read(self.commits_path, "batch_id bigint, base_version bigint")

    def _committed(self) -> tuple[int, list[int]]:
        """The batch up to which the base snapshot holds everything (-1: none), and the committed
        batches after it, at most as many as lie between two compactions."""
        c = self._commits()
        v = c.agg(F.max("base_version")).first()[0]
        v = -1 if v is None else v
        return v, sorted({r.batch_id for r in c.where(F.col("batch_id") > v).select("batch_id").collect()})

    def _commit(self, batch_id: int, base_version: int) -> None:
        (self.spark.createDataFrame([(batch_id, base_version)], "batch_id bigint, base_version bigint")
         .write.mode("append").parquet(self.commits_path))

    def current_pairs(self) -> DataFrame:
        """Base snapshot + committed deltas after it, summed per pair (positive counts only)."""
        v, done = self._committed()
        if v < 0 and not done:
            return self.spark.createDataFrame([], self.SCHEMA)
        base = (self._read(f"{self.base_path}/v{v}", self.SCHEMA) if v >= 0
                else self.spark.createDataFrame([], self.SCHEMA))
        deltas = (self._read(self.delta_path, "product1 bigint, product2 bigint, d bigint, batch_id bigint")
                  .where(F.col("batch_id").isin(done)).select("product1", "product2", F.col("d").alias("cnt")))
        return (base.unionByName(deltas).groupBy("product1", "product2")
                .agg(F.sum("cnt").cast("bigint").alias("cnt")).where(F.col("cnt") > 0))

    def deltas(self, batch: DataFrame, batch_id: int, v: int, done: list[int]) -> DataFrame:
        return batch

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        v, done = self._committed()
        if batch_id <= v or batch_id in done:
            return  # already applied
        delta = (self.deltas(batch, batch_id, v, done).groupBy("product1", "product2")
                 .agg(F.sum("d").cast("bigint").alias("d")).where(F.col("d") != 0))
        delta.write.mode("overwrite").parquet(f"{self.delta_path}/batch_id={batch_id}")
        self._commit(batch_id, v)
        if len(done) + 1 >= self.compact_every:  # fold base and deltas, this batch's too, into a new base
            self.current_pairs().write.mode("overwrite").parquet(f"{self.base_path}/v{batch_id}")
            self._commit(batch_id, batch_id)


class PairTableUpdater(PairTable):
    """The pair table from batches of order lines ``(orderNr, productNr)``, without streaming state.

    Recomputes the pair rows of the orders a batch touches from all of their lines and subtracts what they
    contributed before. Lines are kept in folders by a hash of their order, and only the folders of touched orders are read.
    """

    def __init__(self, spark: SparkSession, base: str, block_size: int = PR.DEFAULT_BLOCK, compact_every: int = 20, buckets: int = 256):
        super().__init__(spark, base, compact_every)
        self.block_size, self.buckets = block_size, buckets
        self.lines_path = f"{base}/lines"

    def current_lines(self) -> DataFrame:
        return self._read(self.lines_path, "orderNr bigint, productNr bigint, bucket int, batch_id bigint")

    def deltas(self, batch: DataFrame, batch_id: int, v: int, done: list[int]) -> DataFrame:
        new = batch.select("orderNr", "productNr").withColumn("bucket", F.pmod(F.xxhash64("orderNr"), F.lit(self.buckets)).cast("int"))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        lines = (self.current_lines().where(F.col("bucket").isin(touched) & ((F.col("batch_id") <= v) | F.col("batch_id").isin(done)))
                 .select("orderNr", "productNr"))
        before = lines.join(new.select("orderNr").distinct(), "orderNr", "left_semi")
        old_rows = PR.basket_pair_rows(before, block_size=self.block_size).select("p1", "p2", F.lit(-1).alias("d"))
        new_rows = PR.basket_pair_rows(before.unionByName(new.drop("bucket")), block_size=self.block_size).select("p1", "p2", F.lit(1).alias("d"))
        new.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "bucket", "batch_id").parquet(self.lines_path)
        return old_rows.unionByName(new_rows).select(F.col("p1").alias("product1"), F.col("p2").alias("product2"), "d")


PAIR_ROWS = 1 << 18  # of one output frame


def _new_pairs(key, frames, state):
    """An order's new lines -> the pairs its new products make with each other and with those seen before (the state)."""
    import numpy as np
    import pandas as pd
    have = np.array(state.get[0] if state.exists else [], np.int64)
    for frame in frames:
        for p in np.setdiff1d(frame["productNr"].dropna().to_numpy(np.int64), have):
            for k in range(0, len(have), PAIR_ROWS):
                other = have[k:k + PAIR_ROWS]
                yield pd.DataFrame({"product1": np.minimum(other, p), "product2": np.maximum(other, p), "d": np.ones(len(other), np.int64)})
            have = np.append(have, p)
    state.update(([int(x) for x in have],))


def new_pairs(source: DataFrame) -> DataFrame:
    """(product1, product2, d): the pairs that each micro-batch of order lines adds. An order's products are the state of
    its key, so a batch reads and writes the state of the orders it touches and nothing else; a product that an order
    already has adds nothing. Rows without order or product are left out."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    return (source.where("orderNr is not null and productNr is not null").select("orderNr", "productNr").groupBy("orderNr")
            .applyInPandasWithState(_new_pairs, "product1 bigint, product2 bigint, d bigint", "items array<bigint>", "append",
                                    GroupStateTimeout.NoTimeout))


def ingest_order_lines(spark: SparkSession, source: DataFrame, base: str | None = None,
                       delay: str | None = None, compact_every: int = 20) -> tuple[PairTable, str]:
    """Run the order-line stream with ``availableNow`` into the pair table; returns the table and its folder.

    Products are kept per order in the streaming state for good, so late and repeated lines are right whenever they come;
    ``delay`` is accepted for callers that still name a watermark. On a cluster set the RocksDB state store.
    """
    base = base or job_dir(spark, "orderlines")
    table = PairTable(spark, base, compact_every)
    q = (new_pairs(source).writeStream.outputMode("append").foreachBatch(table).option("checkpointLocation", os.path.join(base, "checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return table, base


class CatalogueUpserter:
    """Product upserts arrive as a stream; each micro-batch is applied exactly once.

    Within a batch the last record per key wins (``order`` columns); the merge with the
    latest snapshot is written as version ``batch_id`` and committed, so a redelivered
    batch finds its version already committed and changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "id", order: tuple[str, ...] = ("seq",)):
        self.spark, self.root, self.key, self.order = spark, root, key, list(order)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        from shopflow.sources import store as ST
        done = ST.latest_version(self.spark, self.root)
        if done is not None and done >= batch_id:
            return
        last = ST.last_wins(batch, self.key, self.order)
        cur = (ST.read_latest(self.spark, self.root) if done is not None
               else self.spark.createDataFrame([], last.schema))
        ST.write_version(ST.upsert(cur.select(*last.columns), last).drop("_action"), self.root, batch_id)


def upsert_products_stream(spark: SparkSession, source: DataFrame, root: str | None = None,
                           key: str = "id", order: tuple[str, ...] = ("seq",)) -> str:
    """Run a product-upsert stream with ``availableNow`` into versioned snapshots under ``root``."""
    root = root or job_dir(spark, "catalogue")
    q = (source.writeStream.foreachBatch(CatalogueUpserter(spark, root, key, order))
         .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return root
