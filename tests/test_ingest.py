"""Order lines as a stream with keyed state; counted writes; file sizes; basket lists of a large order."""

import glob
import os
import random
import tempfile

from pyspark.sql import functions as F

from shopflow.operators import pairs as PR
from shopflow.plans.store import table_sizes
from shopflow.sources import store as ST
from shopflow.sources import tables as TB
from shopflow.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def _counts(df):
    return {(r.product1, r.product2): r.cnt for r in df.collect()}


def test_state_stream_equals_batch_with_late_and_repeated_lines(spark):
    rng = random.Random(1)
    lines = [(rng.randrange(40), rng.randrange(30)) for _ in range(900)] + [(1000, i) for i in range(200)] + [(None, 1), (3, None)]
    rng.shuffle(lines)
    d = tempfile.mkdtemp(prefix="lines-", dir="/tmp")
    schema = "orderNr long, productNr long"
    for k in range(5):
        spark.createDataFrame(lines[k::5] + lines[:20], schema).coalesce(1).write.parquet(f"{d}/p{k}")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d + "/*")
    table, base = J.ingest_order_lines(spark, src, compact_every=2)
    want = _counts(PR.pair_counts(spark.createDataFrame(lines, schema)))
    assert _counts(table.current_pairs()) == want
    table(spark.createDataFrame([(1, 2, 5)], "product1 long, product2 long, d long"), 3)  # redelivered
    assert _counts(table.current_pairs()) == want
    # what each batch wrote is its own change, however many came before
    sizes = [sum(os.path.getsize(f) for f in glob.glob(f"{base.removeprefix('file:')}/pair_deltas/batch_id={k}/*.parquet")) for k in range(5)]
    assert len(sizes) == 5 and all(sizes)


def test_updater_reads_only_touched_buckets(spark):
    base = J.job_dir(spark, "buckets")
    upd = J.PairTableUpdater(spark, base, buckets=16)
    schema = "orderNr long, productNr long"
    for k in range(6):
        upd(spark.createDataFrame([(k, 1), (k, 2), (k, 3 + k)], schema), k)
    upd(spark.createDataFrame([(2, 50)], schema), 6)
    rows = [(k, p) for k in range(6) for p in (1, 2, 3 + k)] + [(2, 50)]
    assert _counts(upd.current_pairs()) == _counts(PR.pair_counts(spark.createDataFrame(rows, schema)))
    plan = upd.current_lines().where(F.col("bucket").isin([3]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:120]


def test_counted_writes(spark):
    d = tempfile.mkdtemp(prefix="counted-", dir="/tmp")
    df = spark.range(1000).repartition(7)
    assert [ST.append_counted(df.where(f"id % 4 = {k}"), d + "/t") for k in range(3)] == [250] * 3
    assert ST.append_counted(df.limit(0), d + "/t") == 0 and spark.read.parquet(d + "/t").count() == 750
    assert ST.rebuild_counted(df, d + "/v") == (0, 1000) and ST.rebuild_counted(df.where("id < 10"), d + "/v") == (1000, 10)
    files = glob.glob(d + "/t/*.parquet")
    r = ST.file_sizes(spark.read.parquet(d + "/t")).first()
    assert (r.files, r.bytes) == (len([f for f in files if spark.read.parquet(f).count()]), sum(os.path.getsize(f) for f in files if spark.read.parquet(f).count()))


def test_table_sizes_are_the_files(spark):
    rows = {r.table_name: r.bytes for r in table_sizes(spark, SF).collect()}
    assert rows == {t: os.path.getsize(f"{SF}/{t}.parquet") for t in TB.TABLES}


def test_basket_lists_of_a_large_order(spark):
    rng = random.Random(2)
    lines = [(1, i, rng.randrange(50), 5 if i else 9) for i in range(3000)] + [(k, i, k * i, k) for k in range(2, 60) for i in range(k % 5 + 1)] + [(None, 0, 1, 1), (80, None, None, None)]
    rng.shuffle(lines)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(lines, "orderNr long, line long, productNr long, customerNr long")
        rows = PR.basket_lists(df, ["line"], 100).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    got = {(r.orderNr, r.part): (r.first_user, r.products) for r in rows}
    for order in {x[0] for x in lines if x[0] is not None}:
        own = sorted((x for x in lines if x[0] == order), key=lambda x: (x[1] is not None, x[1]))
        for part in range(0, len(own), 100):
            assert got.pop((order, part // 100)) == (own[0][3], [x[2] for x in own[part:part + 100]])
    assert not got
