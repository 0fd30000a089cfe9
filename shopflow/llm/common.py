"""Helpers shared by the operators: table reading, shared scratch tables, task-side batching."""

from __future__ import annotations

import atexit
import math
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
# Words are maximal runs of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(col):
    """Lower-case A-Z only; every other character is kept."""
    return F.translate(col, UPPER, LOWER)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session is gone; the folder's owner clears it
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage without depending on any executor's disk: a lost executor rereads
    the files. The table goes when the driver's process ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of a text column (one scan, one number to the driver)."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(col))), F.lit(0))).first()[0])


def ranges_for(total_bytes: int, bytes_per_range: int = 16 << 20, least: int = 64) -> int:
    """Bits of a hash-range split: about ``bytes_per_range`` of text for each range, whatever the
    size (hashes have 32 bits to spare for it, enough for 64 PB)."""
    return min(32, math.ceil(math.log2(max(least, total_bytes // bytes_per_range))))


def gathered(least: int, bits: int) -> int:
    """Entries a task collects before it ships them by range: some for each range, within bounded memory."""
    return max(least, min(8 << bits, 1 << 23))


def text_chunks(batches, text: str, limit: int = 2 << 20):
    """From Arrow batches, yield (row slice as RecordBatch, texts as list of bytes or None)
    of about ``limit`` bytes of text, so that a task's memory does not follow the batch."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        start, size, held = 0, 0, []
        for i, v in enumerate(col):
            b = v.as_py()
            held.append(b)
            size += len(b) if b is not None else 0
            if size >= limit:
                yield batch.slice(start, i + 1 - start), held
                start, size, held = i + 1, 0, []
        if held:
            yield batch.slice(start, len(held)), held
