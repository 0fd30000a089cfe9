"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on. Adaptive execution re-plans joins at runtime
# (broadcast conversion by measured size, skew splitting, partition coalescing).
SESSION_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "shopflow", cpus: str | int = "*",
                  shuffle_partitions: int | None = None,
                  driver_memory: str = "16g",
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own settings."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.driver.memory", driver_memory))
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when a session with a local master leaves it unset (tests) is a fresh scratch
    folder created and registered; on a cluster executors would not share it.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="shopflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:  # noqa: BLE001 - some sessions reject core settings at runtime
            pass
    # Spark keeps checkpoints in a folder of its own below the one that is set
    if not sc.getCheckpointDir() or not sc.getCheckpointDir().removeprefix("file:").startswith(path.removeprefix("file:").removeprefix("//")):
        sc.setCheckpointDir(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session is gone; the folder's owner clears it
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: cuts the lineage like ``checkpoint()``,
    and the reader has sizes, statistics and single columns. The table goes when the driver's process ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> DataFrame:
    """A table just ``written``. Spark removes the shuffle files of the steps before it when the driver collects its garbage,
    which by itself may come only after the job: large steps ask for it, so that their files don't add up."""
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


LOOKUP_BYTES = 8 << 20   # of a table that is sent to every task


def lookup_fits(df: DataFrame) -> bool:
    """Whether the rows of ``df``, measured as text, are few enough to be sent to every task."""
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))) + 32)).first()[0] or 0) <= LOOKUP_BYTES


def lookup(df: DataFrame) -> DataFrame:
    """A table read often (see ``written``) as one side of a join: broadcast if its rows are few, else met by sorting
    both sides.

    Spark's own estimate comes from the size of files and does not see rows that ``explode`` or generated columns add,
    so it would broadcast a whole catalogue's grams; for tables that grow with the catalogue callers say ``hint("merge")``.
    """
    return F.broadcast(df) if lookup_fits(df) else df.hint("merge")


TASK_ROWS = 1 << 13   # of a table whose rows each make many more in the task that reads them


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly, ``TASK_ROWS`` rows a task: a small file may hold many rows, and Spark cuts tasks by bytes,
    so the grams of a whole catalogue would be made and summed in one or two tasks."""
    parts = -(-df.count() // TASK_ROWS)
    return df.repartition(parts) if parts > 1 else df
