"""Exact rank-picked percentiles without putting a whole group in one task.

The reference picks ``sorted(values)[int(n * p)]`` (0-based), i.e. the row at
1-based rank ``floor(n*p) + 1`` (D15). A window ``row_number`` per group would
sort each group inside a single task; a hot group (a third of the log) would then
sit in one task. Instead the values are range-partitioned on ``(group, value)``
so a hot group spans many partitions, each partition is sorted locally, and only
a tiny ``(partition, group) -> count`` table is used to turn a global rank into a
(partition, position) address. The sorted table is written once (reliable checkpoint):
range bounds are sampled, so a second evaluation could number the rows otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopflow.session import checkpoint_dir


def rank_pick(df: DataFrame, group: Sequence[str], value: str,
              fractions: dict[str, float]) -> DataFrame:
    """Per group: ``n`` and, for each ``name -> p``, the value at rank ``floor(n*p)+1``."""
    group = list(group)
    base = df.select(*group, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    s = (base.repartitionByRange(*group, "_v")
         .sortWithinPartitions(*group, "_v")
         .withColumn("_pid", F.spark_partition_id())
         # position inside the partition: the id is (partition << 33) + row index
         .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33)))
    checkpoint_dir(df.sparkSession)
    s = s.checkpoint()
    seg = s.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_c"), F.min("_pos").alias("_first"))
    gw = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    seg = (seg.withColumn("_n", F.sum("_c").over(gw))
           .withColumn("_before", F.sum("_c").over(gw.orderBy("_pid")) - F.col("_c")))
    targets = None
    for name, p in fractions.items():
        r = F.floor(F.col("_n") * F.lit(float(p))) + 1
        t = (seg.where((r > F.col("_before")) & (r <= F.col("_before") + F.col("_c")))
             .select("_pid", *group, "_n", (F.col("_first") + r - F.col("_before") - 1).alias("_pos"),
                     F.lit(name).alias("_name")))
        targets = t if targets is None else targets.unionByName(t)
    hits = s.join(targets, ["_pid", *group, "_pos"])
    aggs = [F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in fractions]
    picked = hits.groupBy(*group).agg(F.max("_n").alias("n"), *aggs)
    return picked
