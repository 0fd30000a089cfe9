"""Operator 7: mix sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key -ln(u) / w, u from a hash of its id and the seed, w its
quality weight. A source gives complete epochs first; what its target leaves is taken in order
of the keys up to the word budget, the last document cut where the budget ends.

The order within a source is never made in one task: keys fall into buckets that are equal
slices of 1 - exp(-key), as many as the rows ask for; bucket totals are summed along each source, and only
rows of one bucket are sorted together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopflow.llm.common import WORD, materialise

BUCKET_ROWS = 2000


def quality_weight() -> Column:
    """Share of a text's characters that are letters or white space, 0.05 at least."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    noise = F.length(F.regexp_replace(text, r"[\p{L}\s]+", ""))
    return F.when(F.length(text) > 0, F.greatest(F.lit(0.05), 1 - noise / F.length(text))).otherwise(F.lit(0.05))


def water_fill(sources: DataFrame, share: float, most: float) -> DataFrame:
    """``sources(src, source_size, weight)`` -> with ``target``: weight times one level, held at
    ``most`` times the source's size, so that all targets come to ``share`` of all sizes.

    What sources at their limit can't take goes to the others by weight until none is above: the
    level is the one for which the sum holds, found among the ordered limits in one pass. This is
    one row for each source.
    """
    limit = F.col("source_size") * most
    order = Window.orderBy(limit / F.col("weight"), "src")
    everything = Window.partitionBy()
    s = sources.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("total_weight", F.sum("weight").over(everything))
    s = s.withColumns({"full": F.sum(limit).over(order.rowsBetween(Window.unboundedPreceding, -1)),
                       "full_weight": F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    # the level if exactly the sources before this one are at their limit
    level = ((share * F.col("all_size") - F.coalesce("full", F.lit(0.0)))
             / (F.col("total_weight") - F.coalesce("full_weight", F.lit(0))))
    s = s.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= limit)
    s = s.withColumn("level", F.min(F.when(F.col("fits"), F.struct((limit / F.col("weight")).alias("o"), F.col("src").alias("s"), F.col("level").alias("l"))))
                     .over(everything)["l"])
    return s.select("src", "source_size", F.coalesce(F.least(limit, F.col("level") * F.col("weight")), limit).cast("double").alias("target"))


def mix_sources(docs: DataFrame, weight: Column | None = None, shares: tuple = (3.0, 1.0, 2.0),
                share: float = 1.5, most: float = 2.0, seed: int = 20) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` -> one row for each row: ``doc_id``, ``source``, ``size``
    (words), ``source_size``, ``target`` of its source, ``taken`` (words the mix takes, repeats
    counted), ``epochs`` (complete ones) and ``key``.

    Null or empty texts have size 0 and are taken 0 times; a null source is a source of its own,
    the last in order. Rows that repeat a doc_id share their draw and are ordered by size. Taken
    words of a source equal its target rounded down. The same input and seed give the same
    mix. Other columns are ignored. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), 11).cast("double") + 0.5) / float(1 << 53)
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        (-F.log(unit) / (quality_weight() if weight is None else weight)).alias("key"))
    # a struct stands for the source: a null one equals itself and comes last
    src = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    sized = materialise(sized.withColumn("src", src), "sized")
    buckets = max(1, math.ceil(sized.count() / BUCKET_ROWS))
    bucket = F.least(F.lit(buckets - 1), F.floor((1 - F.exp(-F.col("key"))) * buckets)).cast("int")
    rows = sized.withColumn("bucket", bucket)
    totals = materialise(rows.groupBy("src", "bucket").agg(F.sum("size").alias("n")), "buckets")
    sources = totals.groupBy("src").agg(F.sum("n").alias("source_size"))
    place = (F.row_number().over(Window.orderBy("src")) - 1) % len(shares)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, shares)), place + 1))
    targets = water_fill(sources, share, most)
    along = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0))).join(targets, "src")
               .select(F.col("src").alias("o_src"), F.col("bucket").alias("o_bucket"), "before", "source_size", "target",
                       F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)).alias("epochs")))
    within = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
            .join(offsets, (F.col("src") == F.col("o_src")) & (F.col("bucket") == F.col("o_bucket"))))
    left = F.floor(F.col("target")) - F.col("epochs") * F.col("source_size") - F.col("before") - F.col("own")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    return rows.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), F.col("epochs").cast("int").alias("epochs"), "key")
