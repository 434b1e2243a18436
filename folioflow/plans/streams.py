"""Queries whose streaming form is in ``folioflow.streaming``; here over the whole events table."""

from __future__ import annotations

from folioflow.plans.registry import query
from folioflow.session import table
from folioflow.streaming import progress


@query(
    "progress_sessions",
    """WITH a AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 10 SECOND THEN 0 ELSE 1 END AS new FROM events),
    b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM a)
    SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 10 SECOND AS ended, count(*) AS n_events, round(sum(value), 4) AS total FROM b GROUP BY user_id, s""",
)
def progress_sessions(spark, sf_dir):
    from pyspark.sql import functions as F

    return progress.sessions(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("progress_windows", "SELECT date_trunc('minute', ts) AS began, event_type, count(*) AS n_events, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def progress_windows(spark, sf_dir):
    return progress.windowed(table(spark, sf_dir, "events"))


@query("dedupe_events", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def dedupe_events(spark, sf_dir):
    from pyspark.sql import functions as F

    return progress.deduped(table(spark, sf_dir, "events"), ("user_id", "event_type")).agg(F.count("*").alias("n"))


@query("provider_breaker")
def provider_breaker(spark, sf_dir):
    return progress.breaker(table(spark, sf_dir, "events"))
