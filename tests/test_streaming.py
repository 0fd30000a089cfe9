import os
import tempfile

from pyspark.sql import functions as F

from shopflow.operators import metrics as M
from shopflow.operators import pairs as PR
from shopflow.sources import tables as TB
from shopflow.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def _land(spark, df, parts, order_col):
    """Write ``df`` in ``parts`` files ordered by ``order_col`` (a replay fixture)."""
    d = tempfile.mkdtemp(prefix="land-", dir="/tmp")
    ranked = df.withColumn("_part", F.ntile(parts).over(__import__("pyspark.sql").sql.Window.orderBy(order_col)))
    for i in range(1, parts + 1):
        ranked.where(F.col("_part") == i).drop("_part").coalesce(1).write.parquet(os.path.join(d, f"p{i:03d}"))
    return d


def test_windowed_stream_equals_batch_for_closed_windows(spark):
    events = TB.read(spark, SF, "events")
    land = _land(spark, events, 4, "ts")
    stream = J.read_log_stream(spark, land + "/*", max_files_per_trigger=1)
    got = J.run_to_table(J.windowed_stats(stream), spark, "test-win")
    batch = M.tumbling_stats(TB.request_log(spark, SF), "1 hour")
    max_ts = events.agg(F.max("ts")).first()[0]
    import datetime as dt
    closed = batch.where(F.col("window_end") <= F.lit(max_ts - dt.timedelta(minutes=10)))
    key = ["window_start", "endpoint", "count", "avg_duration_ms", "max_duration_ms"]
    a = sorted(tuple(r) for r in got.select(*key).collect())
    b = sorted(tuple(r) for r in closed.select(*key).collect())
    assert a == b and len(a) > 0


def test_late_rows_are_dropped_and_counted(spark):
    events = TB.read(spark, SF, "events")
    d = tempfile.mkdtemp(prefix="late-", dir="/tmp")
    events.where("ts >= '2024-01-15' and ts < '2024-01-20'").coalesce(1).write.parquet(d + "/a")
    events.where("ts >= '2024-01-20'").coalesce(1).write.parquet(d + "/b")
    events.where("ts < '2024-01-02'").coalesce(1).write.parquet(d + "/c")  # far behind the watermark
    stream = J.read_log_stream(spark, d + "/*", max_files_per_trigger=1)
    got, dropped = J.run_to_table(J.windowed_stats(stream), spark, "test-late", with_dropped=True)
    assert got.where("window_start < '2024-01-02'").count() == 0
    assert dropped > 0 and got.count() > 0


def test_session_stream(spark):
    events = TB.read(spark, SF, "events")
    land = _land(spark, events, 2, "ts")
    got = J.run_to_table(J.session_stats(J.read_log_stream(spark, land + "/*")), spark, "test-sess")
    assert got.count() > 0 and got.where("events < 1").count() == 0


def test_pair_stream_replay_equals_batch(spark):
    lines = TB.order_lines(spark, SF).select("orderNr", "productNr", "customerNr", "dateTime")
    land = _land(spark, lines, 3, "dateTime")
    src = spark.readStream.schema(J.LINES_SCHEMA).option("maxFilesPerTrigger", 1).parquet(land + "/*")
    upd, _ = J.ingest_order_lines(spark, src, delay="36500 days")
    got = {(r.product1, r.product2): r.cnt for r in upd.current_pairs().collect()}
    want = {(r.product1, r.product2): r.cnt for r in PR.pair_counts(TB.basket_lines(spark, SF)).collect()}
    assert got == want
    # same replay with compaction after every second batch
    src2 = spark.readStream.schema(J.LINES_SCHEMA).option("maxFilesPerTrigger", 1).parquet(land + "/*")
    base = J.job_dir(spark, "orderlines-compact")
    upd2 = J.PairTableUpdater(spark, base, compact_every=2)
    q = (src2.writeStream.foreachBatch(upd2).option("checkpointLocation", base + "/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert {(r.product1, r.product2): r.cnt for r in upd2.current_pairs().collect()} == want
    # re-delivering an applied batch changes nothing
    before = upd.current_pairs().count()
    upd(spark.createDataFrame([(1, 2)], "orderNr bigint, productNr bigint"), 0)
    assert upd.current_pairs().count() == before


def test_product_upsert_stream(spark):
    from shopflow.sources import store as ST
    d = tempfile.mkdtemp(prefix="ups-", dir="/tmp")
    schema = "id string, price double, seq int"
    spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1), ("b", 2.5, 2)], schema).coalesce(1).write.parquet(d + "/f1")
    spark.createDataFrame([("b", 3.0, 1), ("c", 4.0, 1)], schema).coalesce(1).write.parquet(d + "/f2")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d + "/*")
    root = J.upsert_products_stream(spark, src)
    got = {r.id: r.price for r in ST.read_latest(spark, root).collect()}
    assert got == {"a": 1.0, "b": 3.0, "c": 4.0}


def test_catalogue_upserter_redelivery_is_noop(spark):
    from shopflow.sources import store as ST
    root = J.job_dir(spark, "ups-redeliver")
    up = J.CatalogueUpserter(spark, root)
    schema = "id string, price double, seq int"
    up(spark.createDataFrame([("a", 1.0, 1)], schema), 0)
    up(spark.createDataFrame([("a", 2.0, 1), ("b", 3.0, 1)], schema), 1)
    up(spark.createDataFrame([("a", 9.0, 1)], schema), 1)  # redelivered batch id 1
    assert {r.id: r.price for r in ST.read_latest(spark, root).collect()} == {"a": 2.0, "b": 3.0}
