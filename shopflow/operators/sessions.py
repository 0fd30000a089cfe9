"""Gap-based sessions (N5) without putting one user's events in one task.

Events are range-partitioned on ``(user, ts)``, so a user with a huge share of the
log spans many partitions. Each partition, already sorted, is cut into local
sessions in one pass (``mapInPandas``, numpy). A local session that is neither the
first nor the last of its user in its partition is final: its neighbours are in the
same partition and at least ``gap`` away. Only first/last local sessions (at most two
per user and partition) are stitched across partitions with a small window.
Semantics match ``session_window``: a new session starts when the gap to the previous
event is at least ``gap``; the session ends ``gap`` after its last event.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopflow.session import checkpoint_dir

LOCAL_SCHEMA = ("user_id bigint, s_start timestamp_ntz, s_last timestamp_ntz, events bigint, clicks bigint, "
                "purchases bigint, is_first boolean, is_last boolean")


def _local_sessions(gap_us: int):
    cols = ["user_id", "s_start", "s_last", "events", "clicks", "purchases"]

    def frame(agg, first, last):
        return pd.DataFrame({
            "user_id": agg["user_id"].astype("int64"),
            "s_start": pd.to_datetime(agg["s_start"].to_numpy(), unit="us"),
            "s_last": pd.to_datetime(agg["s_last"].to_numpy(), unit="us"),
            "events": agg["events"].astype("int64"), "clicks": agg["clicks"].astype("int64"),
            "purchases": agg["purchases"].astype("int64"), "is_first": first, "is_last": last})

    def run(batches):
        # one range partition, sorted by (user, ts); the last session stays open from batch to batch
        opened, before = None, None
        for df in batches:
            if not len(df):
                continue
            users = df["user_id"].to_numpy()
            ts = df["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            new = np.r_[True, (users[1:] != users[:-1]) | (ts[1:] - ts[:-1] >= gap_us)]
            g = pd.DataFrame({"sid": np.cumsum(new), "user_id": users, "ts": ts,
                              "c": df["click"].to_numpy(), "p": df["purchase"].to_numpy()})
            agg = g.groupby("sid", sort=True).agg(user_id=("user_id", "first"), s_start=("ts", "min"),
                                                  s_last=("ts", "max"), events=("ts", "size"),
                                                  clicks=("c", "sum"), purchases=("p", "sum")).reset_index(drop=True)
            if opened is not None:
                head = agg.iloc[0]
                if head["user_id"] == opened["user_id"] and head["s_start"] - opened["s_last"] < gap_us:
                    agg.loc[0, "s_start"] = opened["s_start"]
                    for c in ("events", "clicks", "purchases"):
                        agg.loc[0, c] += opened[c]
                else:
                    agg = pd.concat([pd.DataFrame([opened])[cols], agg[cols]], ignore_index=True)
            u = agg["user_id"].to_numpy()
            first = np.r_[before is None or u[0] != before, u[1:] != u[:-1]]
            last = np.r_[u[1:] != u[:-1], True]
            opened = agg.iloc[-1].to_dict()
            if len(agg) > 1:
                before = u[-2]
                yield frame(agg.iloc[:-1], first[:-1], last[:-1])
        if opened is not None:
            yield frame(pd.DataFrame([opened]), [before is None or opened["user_id"] != before], [True])
    return run


def sessions(log: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """(user_id, session_start, session_end, events, clicks, purchases) per gap-based session."""
    gap_us = gap_minutes * 60 * 1_000_000
    ev = (log.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
          .select("user_id", "ts", (F.col("endpoint") == "click").cast("long").alias("click"),
                  (F.col("endpoint") == "purchase").cast("long").alias("purchase"))
          .repartitionByRange("user_id", "ts").sortWithinPartitions("user_id", "ts"))
    # written once: range bounds are sampled, a second evaluation could cut the partitions otherwise
    checkpoint_dir(log.sparkSession)
    local = ev.mapInPandas(_local_sessions(gap_us), LOCAL_SCHEMA).checkpoint()
    interior = local.where(~F.col("is_first") & ~F.col("is_last"))
    edge = local.where(F.col("is_first") | F.col("is_last"))
    w = Window.partitionBy("user_id").orderBy("s_start", "s_last")
    gap = F.make_dt_interval(mins=F.lit(gap_minutes))
    edge = (edge.withColumn("_new", F.when(F.lag("s_last").over(w).isNull()
                                           | (F.col("s_start") >= F.lag("s_last").over(w) + gap), 1).otherwise(0))
            .withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    merged = edge.groupBy("user_id", "_g").agg(
        F.min("s_start").alias("s_start"), F.max("s_last").alias("s_last"), F.sum("events").alias("events"),
        F.sum("clicks").alias("clicks"), F.sum("purchases").alias("purchases"))
    cols = ["user_id", "s_start", "s_last", "events", "clicks", "purchases"]
    out = interior.select(*cols).unionByName(merged.select(*cols))
    return out.select("user_id", F.col("s_start").alias("session_start"), (F.col("s_last") + gap).alias("session_end"),
                      F.col("events").cast("bigint").alias("events"), F.col("clicks").cast("bigint").alias("clicks"),
                      F.col("purchases").cast("bigint").alias("purchases"))
