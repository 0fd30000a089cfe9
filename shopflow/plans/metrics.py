"""Log analytics queries (A12-A21, N3/N5 batch forms) over ``events`` as the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopflow.functions.numbers import exact_avg
from shopflow.operators import metrics as M
from shopflow.plans.registry import register
from shopflow.sources import tables as TB

LOG = """log AS (SELECT event_id, ts, user_id, event_type AS endpoint, event_type AS algorithm,
       value AS duration_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
       json_extract_string(props, '$.k') AS query,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS result_count FROM events)"""


def _pick(src: str, group: str, name: str, p: float) -> str:
    """Rank-picked percentile in SQL: 1-based row floor(n*p)+1 of the ascending durations."""
    part = f"PARTITION BY {group}" if group else ""
    sel = f"{group}, " if group else ""
    return f"""(SELECT {sel}duration_ms AS {name} FROM (
      SELECT {sel}duration_ms, ROW_NUMBER() OVER ({part} ORDER BY duration_ms) AS rn,
             COUNT(*) OVER ({part}) AS n FROM {src} WHERE duration_ms IS NOT NULL) z
      WHERE rn = FLOOR(n * CAST({p} AS DOUBLE)) + 1)"""


@register("search_stats_p95", f"""
WITH {LOG}
SELECT g.endpoint, g.count, g.min_duration_ms, g.max_duration_ms, g.avg_duration_ms,
       COALESCE(p.p95_duration_ms, 0.0) AS p95_duration_ms, g.avg_results
FROM (SELECT endpoint, COUNT(*) AS count, MIN(duration_ms) AS min_duration_ms, MAX(duration_ms) AS max_duration_ms,
             ROUND(CAST(SUM(CAST(duration_ms AS DECIMAL(28,12))) AS DOUBLE) / COUNT(duration_ms), 6) AS avg_duration_ms, ROUND(AVG(result_count), 6) AS avg_results
      FROM log GROUP BY endpoint) g
LEFT JOIN {_pick('log', 'endpoint', 'p95_duration_ms', 0.95)} p USING (endpoint)""")
def search_stats_p95(spark, sf_dir):
    return M.duration_stats(TB.request_log(spark, sf_dir), ["endpoint"])


@register("search_stats_window", f"""
WITH {LOG}, w AS (SELECT * FROM log WHERE ts >= (SELECT MAX(ts) FROM log) - INTERVAL 1440 MINUTE)
SELECT g.count, COALESCE(g.min_duration_ms, 0.0) AS min_duration_ms, COALESCE(g.max_duration_ms, 0.0) AS max_duration_ms,
       COALESCE(g.avg_duration_ms, 0.0) AS avg_duration_ms, COALESCE(p.p95_duration_ms, 0.0) AS p95_duration_ms,
       COALESCE(g.avg_results, 0.0) AS avg_results
FROM (SELECT COUNT(*) AS count, MIN(duration_ms) AS min_duration_ms, MAX(duration_ms) AS max_duration_ms,
             ROUND(CAST(SUM(CAST(duration_ms AS DECIMAL(28,12))) AS DOUBLE) / COUNT(duration_ms), 6) AS avg_duration_ms, ROUND(AVG(result_count), 6) AS avg_results FROM w) g
LEFT JOIN {_pick('w', '', 'p95_duration_ms', 0.95)} p ON TRUE""")
def search_stats_window(spark, sf_dir):
    return M.duration_stats(M.in_window(TB.request_log(spark, sf_dir), 1440))


@register("recommendation_stats", f"""
WITH {LOG}
SELECT CASE WHEN GROUPING(algorithm) = 1 THEN 'ALL' ELSE algorithm END AS algorithm,
       COUNT(*) AS count, MIN(duration_ms) AS min_duration_ms, MAX(duration_ms) AS max_duration_ms,
       ROUND(CAST(SUM(CAST(duration_ms AS DECIMAL(28,12))) AS DOUBLE) / COUNT(duration_ms), 6) AS avg_duration_ms
FROM log GROUP BY ROLLUP (algorithm)""")
def recommendation_stats(spark, sf_dir):
    log = TB.request_log(spark, sf_dir)
    return (log.rollup("algorithm").agg(
        F.grouping("algorithm").alias("_g"), F.count(F.lit(1)).alias("count"),
        F.min("duration_ms").alias("min_duration_ms"), F.max("duration_ms").alias("max_duration_ms"),
        F.round(exact_avg("duration_ms"), 6).alias("avg_duration_ms"))
        .select(F.when(F.col("_g") == 1, F.lit("ALL")).otherwise(F.col("algorithm")).alias("algorithm"),
                "count", "min_duration_ms", "max_duration_ms", "avg_duration_ms"))


@register("endpoint_stats", f"""
WITH {LOG}
SELECT endpoint, COUNT(*) AS count, ROUND(CAST(SUM(CAST(duration_ms AS DECIMAL(28,12))) AS DOUBLE) / COUNT(duration_ms), 6) AS avg_duration_ms, MAX(duration_ms) AS max_duration_ms,
       ROUND(AVG(CASE WHEN status_code BETWEEN 200 AND 299 THEN 1.0 ELSE 0.0 END), 6) AS success_rate
FROM log GROUP BY endpoint""")
def endpoint_stats(spark, sf_dir):
    return M.endpoint_stats(TB.request_log(spark, sf_dir))


@register("last_n_mean", f"""
WITH {LOG}
SELECT COUNT(*) AS n, COALESCE(ROUND(CAST(SUM(CAST(duration_ms AS DECIMAL(28,12))) AS DOUBLE) / COUNT(duration_ms), 6), 0.0) AS avg_processing_ms
FROM (SELECT * FROM log ORDER BY ts DESC, event_id DESC LIMIT 100)""")
def last_n_mean(spark, sf_dir):
    return M.recent_mean(TB.request_log(spark, sf_dir), 100)


@register("popular_queries", f"""
WITH {LOG},
c AS (SELECT query, COUNT(*) AS count, MIN(ts) AS first_seen FROM log WHERE query IS NOT NULL GROUP BY query)
SELECT query, count, first_seen, CAST(ROW_NUMBER() OVER (ORDER BY count DESC, first_seen, query) AS INTEGER) AS rank
FROM c ORDER BY count DESC, first_seen, query LIMIT 10""")
def popular_queries(spark, sf_dir):
    return M.popular_queries(TB.request_log(spark, sf_dir), 10)


_WIN = f"""{LOG}, mx AS (SELECT MAX(ts) AS as_of FROM log),
ww AS (SELECT 'last_hour' AS period, log.* FROM log, mx WHERE ts >= as_of - INTERVAL 60 MINUTE
       UNION ALL SELECT 'last_day', log.* FROM log, mx WHERE ts >= as_of - INTERVAL 1440 MINUTE)"""


@register("hour_vs_day_summary", f"""
WITH {_WIN}
SELECT g.period, g.count, g.min_duration_ms, g.max_duration_ms, g.avg_duration_ms,
       COALESCE(p.p95_duration_ms, 0.0) AS p95_duration_ms
FROM (SELECT period, COUNT(*) AS count, MIN(duration_ms) AS min_duration_ms, MAX(duration_ms) AS max_duration_ms,
             ROUND(CAST(SUM(CAST(duration_ms AS DECIMAL(28,12))) AS DOUBLE) / COUNT(duration_ms), 6) AS avg_duration_ms FROM ww GROUP BY period) g
LEFT JOIN {_pick('ww', 'period', 'p95_duration_ms', 0.95)} p USING (period)""")
def hour_vs_day_summary(spark, sf_dir):
    return M.window_summary(TB.request_log(spark, sf_dir), {"last_hour": 60, "last_day": 1440})


@register("health_score", f"""
WITH {LOG}, w AS (SELECT * FROM log WHERE ts >= (SELECT MAX(ts) FROM log) - INTERVAL 60 MINUTE),
h AS (SELECT COALESCE((SELECT p95_duration_ms FROM {_pick('w', '', 'p95_duration_ms', 0.95)}), 0.0) AS p95,
             (SELECT COUNT(*) FROM w) AS hour_count),
r AS (SELECT endpoint, AVG(CASE WHEN status_code BETWEEN 200 AND 299 THEN 1.0 ELSE 0.0 END) AS rate FROM log GROUP BY endpoint),
pen AS (SELECT COALESCE(SUM(CASE WHEN ROUND(rate, 6) < 0.99 THEN LEAST(20.0, (0.99 - ROUND(rate, 6)) * 100) END), 0.0) AS sp FROM r),
s AS (SELECT h.*, pen.sp, GREATEST(0.0, LEAST(100.0, ROUND(100.0 - CASE WHEN p95 > 500 THEN LEAST(30.0, (p95 - 500) / 20) ELSE 0.0 END - sp, 1))) AS hs FROM h, pen)
SELECT ROUND(p95, 6) AS p95_last_hour, hour_count, ROUND(sp, 6) AS success_penalty, hs AS health_score,
       CASE WHEN hs >= 90 THEN 'excellent' WHEN hs >= 75 THEN 'good' WHEN hs >= 50 THEN 'fair' ELSE 'poor' END AS status
FROM s""")
def health_score(spark, sf_dir):
    return M.health_score(TB.request_log(spark, sf_dir), 60)


_LAT = f"""{LOG},
b AS (SELECT endpoint, COUNT(*) AS total_requests, COUNT(*) FILTER (WHERE status_code BETWEEN 200 AND 299) AS successful_requests,
             MIN(epoch_us(ts)) AS st, MAX(epoch_us(ts) + duration_ms * 1000) AS en,
             ROUND(CAST(SUM(CAST(duration_ms AS DECIMAL(28,12))) AS DOUBLE) / COUNT(duration_ms), 6) AS avg_request_ms, MIN(duration_ms) AS min_request_ms, MAX(duration_ms) AS max_request_ms
      FROM log GROUP BY endpoint),
rep AS (SELECT b.endpoint, total_requests, successful_requests, total_requests - successful_requests AS failed_requests,
       ROUND(successful_requests / total_requests, 6) AS success_rate,
       ROUND((en - st) / 1000.0, 6) AS total_duration_ms,
       ROUND(CASE WHEN (en - st) / 1000.0 > 0 THEN total_requests / ((en - st) / 1000.0 / 1000.0) ELSE 0.0 END, 6) AS throughput_rps,
       avg_request_ms, min_request_ms, max_request_ms, p50.p50_request_ms, p95.p95_request_ms, p99.p99_request_ms
FROM b LEFT JOIN {_pick('log', 'endpoint', 'p50_request_ms', 0.5)} p50 USING (endpoint)
       LEFT JOIN {_pick('log', 'endpoint', 'p95_request_ms', 0.95)} p95 USING (endpoint)
       LEFT JOIN {_pick('log', 'endpoint', 'p99_request_ms', 0.99)} p99 USING (endpoint))"""


@register("latency_percentiles", f"WITH {_LAT} SELECT * FROM rep")
def latency_percentiles(spark, sf_dir):
    return M.latency_report(TB.request_log(spark, sf_dir))


@register("latency_overall", f"""WITH {_LAT}
SELECT ROUND(SUM(throughput_rps), 6) AS overall_throughput, MAX(p95_request_ms) AS overall_p95_ms,
       CAST(SUM(total_requests) AS BIGINT) AS total_requests FROM rep""")
def latency_overall(spark, sf_dir):
    return M.overall_report(M.latency_report(TB.request_log(spark, sf_dir)))


@register("windowed_search_stats", f"""
WITH {LOG}
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       endpoint, COUNT(*) AS count, ROUND(CAST(SUM(CAST(duration_ms AS DECIMAL(28,12))) AS DOUBLE) / COUNT(duration_ms), 6) AS avg_duration_ms, MAX(duration_ms) AS max_duration_ms
FROM log GROUP BY 1, 2, endpoint""")
def windowed_search_stats(spark, sf_dir):
    return M.tumbling_stats(TB.request_log(spark, sf_dir), "1 hour")


@register("sessions_feedback", f"""
WITH {LOG},
g AS (SELECT *, CASE WHEN LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                       OR ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE
                     THEN 1 ELSE 0 END AS brk FROM log),
s AS (SELECT *, SUM(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 30 MINUTE AS session_end, COUNT(*) AS events,
       COUNT(*) FILTER (WHERE endpoint = 'click') AS clicks, COUNT(*) FILTER (WHERE endpoint = 'purchase') AS purchases
FROM s GROUP BY user_id, sid""")
def sessions_feedback(spark, sf_dir):
    return M.feedback_sessions(TB.request_log(spark, sf_dir), 30)


def _stream_log(spark, sf_dir):
    from shopflow.streaming import jobs as J
    return J.read_log_stream(spark, sf_dir, glob="events.parquet")


@register("windowed_stats_stream", f"""
WITH {LOG}, mx AS (SELECT MAX(ts) - INTERVAL 10 MINUTE AS wm FROM log)
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       endpoint, COUNT(*) AS count, ROUND(CAST(SUM(CAST(duration_ms AS DECIMAL(28,12))) AS DOUBLE) / COUNT(duration_ms), 6) AS avg_duration_ms, MAX(duration_ms) AS max_duration_ms,
       ROUND(AVG(CASE WHEN status_code BETWEEN 200 AND 299 THEN 1.0 ELSE 0.0 END), 6) AS success_rate
FROM log GROUP BY 1, 2, endpoint HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT wm FROM mx)""")
def windowed_stats_stream(spark, sf_dir):
    """N3/N4 as a Structured Streaming job (watermark 10 minutes, append mode, availableNow)."""
    from shopflow.streaming import jobs as J
    return J.run_to_table(J.windowed_stats(_stream_log(spark, sf_dir)), spark, "windowed-stats")


@register("sessions_stream", f"""
WITH {LOG},
g AS (SELECT *, CASE WHEN LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                       OR ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE
                     THEN 1 ELSE 0 END AS brk FROM log),
s AS (SELECT *, SUM(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g),
ss AS (SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 30 MINUTE AS session_end, COUNT(*) AS events,
       COUNT(*) FILTER (WHERE endpoint = 'click') AS clicks, COUNT(*) FILTER (WHERE endpoint = 'purchase') AS purchases
       FROM s GROUP BY user_id, sid)
SELECT * FROM ss WHERE session_end <= (SELECT MAX(ts) - INTERVAL 10 MINUTE FROM log)""")
def sessions_stream(spark, sf_dir):
    """N5 as a Structured Streaming job (session windows, watermark 10 minutes)."""
    from shopflow.streaming import jobs as J
    return J.run_to_table(J.session_stats(_stream_log(spark, sf_dir)), spark, "sessions")


@register("metrics_bundle", f"""
WITH {LOG}, w AS (SELECT * FROM log WHERE ts >= (SELECT MAX(ts) FROM log) - INTERVAL 60 MINUTE),
s AS (SELECT COUNT(*) AS count, COALESCE(MIN(duration_ms), 0.0) AS mn, COALESCE(MAX(duration_ms), 0.0) AS mx,
             COALESCE(ROUND(CAST(SUM(CAST(duration_ms AS DECIMAL(28,12))) AS DOUBLE) / COUNT(duration_ms), 6), 0.0) AS av, COALESCE(ROUND(AVG(result_count), 6), 0.0) AS ar FROM w),
p AS (SELECT COALESCE((SELECT p95_duration_ms FROM {_pick('w', '', 'p95_duration_ms', 0.95)}), 0.0) AS p95),
e AS (SELECT endpoint, COUNT(*) AS count, ROUND(CAST(SUM(CAST(duration_ms AS DECIMAL(28,12))) AS DOUBLE) / COUNT(duration_ms), 6) AS av, MAX(duration_ms) AS mx,
             ROUND(AVG(CASE WHEN status_code BETWEEN 200 AND 299 THEN 1.0 ELSE 0.0 END), 6) AS sr FROM log GROUP BY endpoint),
pq AS (SELECT query, COUNT(*) AS count, MIN(ts) AS fs FROM log WHERE query IS NOT NULL GROUP BY query
       ORDER BY count DESC, fs, query LIMIT 10),
rn AS (SELECT COALESCE(ROUND(CAST(SUM(CAST(duration_ms AS DECIMAL(28,12))) AS DOUBLE) / COUNT(duration_ms), 6), 0.0) AS av FROM (SELECT * FROM log ORDER BY ts DESC, event_id DESC LIMIT 100))
SELECT 'search_performance' AS section, 'count' AS metric, CAST(count AS DOUBLE) AS value FROM s
UNION ALL SELECT 'search_performance', 'min_duration_ms', mn FROM s
UNION ALL SELECT 'search_performance', 'max_duration_ms', mx FROM s
UNION ALL SELECT 'search_performance', 'avg_duration_ms', av FROM s
UNION ALL SELECT 'search_performance', 'p95_duration_ms', p95 FROM p
UNION ALL SELECT 'search_performance', 'avg_results', ar FROM s
UNION ALL SELECT 'endpoint_performance', endpoint || '.count', CAST(count AS DOUBLE) FROM e
UNION ALL SELECT 'endpoint_performance', endpoint || '.avg_duration_ms', av FROM e
UNION ALL SELECT 'endpoint_performance', endpoint || '.max_duration_ms', mx FROM e
UNION ALL SELECT 'endpoint_performance', endpoint || '.success_rate', sr FROM e
UNION ALL SELECT 'popular_queries', query, CAST(count AS DOUBLE) FROM pq
UNION ALL SELECT 'search_metrics', 'avg_processing_time', av FROM rn""")
def metrics_bundle(spark, sf_dir):
    """One long table (section, metric, value) for a 60-minute window: search stats, endpoint
    stats, the ten most popular queries and the mean of the last 100 requests."""
    log = TB.request_log(spark, sf_dir)
    s = M.duration_stats(M.in_window(log, 60))
    search = s.select(F.lit("search_performance").alias("section"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in ["count", "min_duration_ms", "max_duration_ms", "avg_duration_ms", "p95_duration_ms", "avg_results"]
    ])).alias("m")).select("section", "m.metric", "m.value")
    e = M.endpoint_stats(log)
    ep = e.select(F.lit("endpoint_performance").alias("section"), F.explode(F.array(*[
        F.struct(F.concat(F.col("endpoint"), F.lit("." + c)).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in ["count", "avg_duration_ms", "max_duration_ms", "success_rate"]])).alias("m")).select(
        "section", "m.metric", "m.value")
    pq = M.popular_queries(log, 10).select(F.lit("popular_queries").alias("section"), F.col("query").alias("metric"),
                                           F.col("count").cast("double").alias("value"))
    rn = M.recent_mean(log, 100).select(F.lit("search_metrics").alias("section"),
                                        F.lit("avg_processing_time").alias("metric"),
                                        F.col("avg_processing_ms").alias("value"))
    return search.unionByName(ep).unionByName(pq).unionByName(rn)


@register("recent_history", f"""
WITH {LOG}
SELECT event_id, ts, endpoint, duration_ms FROM log ORDER BY ts DESC, event_id DESC LIMIT 1000""")
def recent_history(spark, sf_dir):
    """The latest 1000 log rows (the rolling history), a top-k over the whole log."""
    log = TB.request_log(spark, sf_dir)
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id", "ts", "endpoint", "duration_ms")
