"""Request-log analytics: search / recommendation / endpoint statistics, health score.

Logs are tables (or streams, see ``shopflow.streaming``) with columns
``ts, endpoint, algorithm, duration_ms, status_code, query, result_count``.
Time windows are relative to an explicit ``as_of`` (default: the log's latest ts).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopflow.functions.numbers import exact_avg
from shopflow.operators.stats import rank_pick

R = 6  # decimals kept on every derived double


def _r(c: Column) -> Column:
    return F.round(c, R)


def epoch_us(ts: Column) -> Column:
    """Microseconds since epoch of a TIMESTAMP_NTZ (no time-zone shift)."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def in_window(log: DataFrame, minutes: int | None, as_of: Column | None = None) -> DataFrame:
    """Rows with ``ts >= as_of - minutes`` (inclusive)."""
    if minutes is None:
        return log
    if as_of is None:
        as_of = log.agg(F.max("ts")).scalar()  # scalar subquery, evaluated once
    return log.where(F.col("ts") >= as_of - F.make_dt_interval(mins=F.lit(minutes)))


def duration_stats(log: DataFrame, group: Sequence[str] = (), with_results: bool = True,
                   pcts: dict[str, float] | None = None) -> DataFrame:
    """Count, min, max, mean and rank-picked percentiles; a zero row when empty and ungrouped."""
    group = list(group)
    pcts = pcts if pcts is not None else {"p95_duration_ms": 0.95}
    aggs = [F.count(F.lit(1)).alias("count"),
            F.min("duration_ms").alias("min_duration_ms"),
            F.max("duration_ms").alias("max_duration_ms"),
            _r(exact_avg("duration_ms")).alias("avg_duration_ms")]
    if with_results:
        aggs.append(_r(F.avg("result_count")).alias("avg_results"))
    base = log.groupBy(*group).agg(*aggs) if group else log.agg(*aggs)
    picks = rank_pick(log, group, "duration_ms", pcts).drop("n")
    if group:
        out = base.join(picks, group, "left")
    else:  # single-row global aggregate; each percentile is a scalar subquery
        out = base.select("*", *[picks.agg(F.max(c)).scalar().alias(c) for c in pcts])
    zero = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in
            ["min_duration_ms", "max_duration_ms", "avg_duration_ms", *pcts]
            + (["avg_results"] if with_results else [])]
    return out.select(*group, F.col("count").cast("bigint").alias("count"), *zero)


def endpoint_stats(log: DataFrame) -> DataFrame:
    """Per endpoint count, mean, max and the 2xx success rate."""
    ok = F.col("status_code").between(200, 299).cast("double")
    return log.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("count"),
        _r(exact_avg("duration_ms")).alias("avg_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"),
        _r(F.avg(ok)).alias("success_rate"))


def recent_mean(log: DataFrame, last_n: int = 100) -> DataFrame:
    """Mean duration of the latest ``last_n`` rows (ts desc, event_id desc)."""
    recent = log.orderBy(F.desc("ts"), F.desc("event_id")).limit(last_n)
    return recent.agg(F.count(F.lit(1)).alias("n"),
                      F.coalesce(_r(exact_avg("duration_ms")), F.lit(0.0)).alias("avg_processing_ms"))


def popular_queries(log: DataFrame, n: int = 10) -> DataFrame:
    """Top-n queries by count; ties by first appearance, then text."""
    c = log.where(F.col("query").isNotNull()).groupBy("query").agg(
        F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_seen"))
    top = c.orderBy(F.desc("count"), F.asc("first_seen"), F.asc("query")).limit(n)
    w = Window.orderBy(F.desc("count"), F.asc("first_seen"), F.asc("query"))
    return top.withColumn("rank", F.row_number().over(w).cast("int"))


def window_summary(log: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Count / mean / p95 for several look-back windows, one output row per window."""
    tagged = log.withColumn("_as_of", log.agg(F.max("ts")).scalar())
    parts = []
    for name, minutes in windows.items():
        w = tagged.where(F.col("ts") >= F.col("_as_of") - F.make_dt_interval(mins=F.lit(minutes))) \
            .drop("_as_of").withColumn("period", F.lit(name))
        parts.append(w)
    allw = parts[0]
    for p in parts[1:]:
        allw = allw.unionByName(p)
    return duration_stats(allw, ["period"], with_results=False)


def health_score(log: DataFrame, p95_window_minutes: int = 60) -> DataFrame:
    """100 - slow-p95 penalty - low-success penalties, clamped and labelled."""
    hour = duration_stats(in_window(log, p95_window_minutes), with_results=False)
    p95 = hour.select(F.col("p95_duration_ms").alias("p95"), F.col("count").alias("hour_count"))
    rates = endpoint_stats(log).agg(
        F.coalesce(F.sum(F.when(F.col("success_rate") < 0.99,
                                F.least(F.lit(20.0), (F.lit(0.99) - F.col("success_rate")) * 100))), F.lit(0.0))
        .alias("success_penalty"))
    slow = F.when(F.col("p95") > 500, F.least(F.lit(30.0), (F.col("p95") - 500) / 20)).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(F.lit(100.0) - slow - F.col("success_penalty"), 1)))
    out = p95.withColumn("success_penalty", rates.scalar()).select(
        _r(F.col("p95")).alias("p95_last_hour"), "hour_count", _r(F.col("success_penalty")).alias("success_penalty"),
        score.alias("health_score"))
    return out.withColumn("status", F.when(F.col("health_score") >= 90, "excellent")
                          .when(F.col("health_score") >= 75, "good")
                          .when(F.col("health_score") >= 50, "fair").otherwise("poor"))


def latency_report(log: DataFrame, group: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Totals, success rate, span, throughput and p50/p95/p99 per group."""
    group = list(group)
    us = epoch_us(F.col("ts"))
    ok = F.col("status_code").between(200, 299)
    base = log.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(ok).alias("successful_requests"),
        F.min(us).alias("_start"),
        F.max(us + F.col("duration_ms") * 1000).alias("_end"),
        _r(exact_avg("duration_ms")).alias("avg_request_ms"),
        F.min("duration_ms").alias("min_request_ms"),
        F.max("duration_ms").alias("max_request_ms"))
    picks = rank_pick(log, group, "duration_ms",
                      {"p50_request_ms": 0.5, "p95_request_ms": 0.95, "p99_request_ms": 0.99}).drop("n")
    span_ms = (F.col("_end") - F.col("_start")) / 1000.0
    return (base.join(picks, group, "left").select(
        *group, "total_requests", "successful_requests",
        (F.col("total_requests") - F.col("successful_requests")).alias("failed_requests"),
        _r(F.col("successful_requests") / F.col("total_requests")).alias("success_rate"),
        _r(span_ms).alias("total_duration_ms"),
        _r(F.when(span_ms > 0, F.col("total_requests") / (span_ms / 1000.0)).otherwise(0.0)).alias("throughput_rps"),
        "avg_request_ms", "min_request_ms", "max_request_ms",
        "p50_request_ms", "p95_request_ms", "p99_request_ms"))


def overall_report(report: DataFrame) -> DataFrame:
    """Summed throughput and worst p95 across endpoints."""
    return report.agg(_r(F.sum("throughput_rps")).alias("overall_throughput"),
                      F.max("p95_request_ms").alias("overall_p95_ms"),
                      F.sum("total_requests").cast("bigint").alias("total_requests"))


def tumbling_stats(log: DataFrame, every: str = "1 hour", group: Sequence[str] = ("endpoint",)) -> DataFrame:
    """N3 batch form: per window and group count, mean and max duration."""
    return (log.groupBy(F.window("ts", every).alias("w"), *group)
            .agg(F.count(F.lit(1)).alias("count"), _r(exact_avg("duration_ms")).alias("avg_duration_ms"),
                 F.max("duration_ms").alias("max_duration_ms"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *group,
                    "count", "avg_duration_ms", "max_duration_ms"))


def feedback_sessions(log: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """N5 batch form: per user session (gap-based) events, clicks and purchases (skew-safe)."""
    from shopflow.operators.sessions import sessions
    return sessions(log, gap_minutes)


def feedback_sessions_builtin(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """N5 with Spark's ``session_window`` (one user's events are sorted in one task)."""
    return (log.groupBy("user_id", F.session_window("ts", gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("events"),
                 F.count_if(F.col("endpoint") == "click").alias("clicks"),
                 F.count_if(F.col("endpoint") == "purchase").alias("purchases"))
            .select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "events", "clicks", "purchases"))
