"""Registered queries that run the stateless and stateful operators as Structured Streaming
jobs over the events table (a file stream, run to completion with ``availableNow``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import detect as D
from ..operators.filters import ColumnFilter, DateRange, FilterCriteria
from ..streaming import stream as S
from .catalog import register
from .transformations import ColumnOps, Filter, KeyStyle
from ..operators.columns import ColumnOperation


@register("st_filter_keystyle", """
SELECT event_id AS "eventId", ts, user_id AS "userId", event_type AS "eventType", value, props, 'stream' AS origin
FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-03 00:00:00'
  AND ts <= TIMESTAMP '2024-01-20 00:00:00'
""")
def st_filter_keystyle(spark, sf_dir):
    """Key style, an added column and filters on a file stream (§2.9)."""
    ev = S.read_table_stream(spark, sf_dir, "events.parquet")
    steps = [KeyStyle("camelCase"),
             ColumnOps((ColumnOperation("add", "origin", default="stream"),)),
             Filter(FilterCriteria((ColumnFilter("eventType", "equals", "purchase"),),
                                   DateRange("ts", "2024-01-03", "2024-01-20")))]
    return S.run_to_table(S.stream_transform(ev, steps), spark, "filter")


@register("st_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def st_dedupe(spark, sf_dir):
    """Distinct (user, event type) pairs with a 40-day watermark (covers the whole table)."""
    ev = S.read_table_stream(spark, sf_dir, "events.parquet")
    d = S.dedupe_stream(ev, ["user_id", "event_type"], "ts", "40 days")
    return S.run_to_table(d, spark, "dedupe").select("user_id", "event_type")


@register("st_window_stats", """
SELECT date_trunc('day', ts) AS period_start, event_type AS operation, avg(value * 1000) AS avg_duration,
       count(*) AS count, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS success_rate,
       avg(value * 1e7) AS avg_heap_used, avg(value) AS avg_throughput
FROM events GROUP BY ALL
""")
def st_window_stats(spark, sf_dir):
    """Per-day performance statistics on a stream with a watermark (§2.9)."""
    ev = S.read_table_stream(spark, sf_dir, "events.parquet")
    return S.run_to_table(S.windowed_performance_stats(ev, "1 day", "2 days"), spark, "window", output_mode="complete")


@register("st_alerts_classify", """
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS operation, 'Memory usage (' ||
       CAST(CAST(floor(value * 1e7 / 1024 / 1024 + 0.5) AS BIGINT) AS VARCHAR) || 'MB) exceeded threshold (500MB)'
       AS warning
FROM events WHERE value * 1e7 / 1024 / 1024 > 500
""")
def st_alerts_classify(spark, sf_dir):
    """Threshold alerts computed on the stream (memory alerts only)."""
    ev = S.read_table_stream(spark, sf_dir, "events.parquet")
    alerts = A.threshold_alerts(A.metrics_from(ev)).where(F.col("warning").startswith("Memory"))
    return S.run_to_table(alerts, spark, "alerts")


@register("st_detect_content", """
SELECT event_id, 'json' AS format FROM events
""")
def st_detect_content(spark, sf_dir):
    """Content-based format detection on a stream (§2.9)."""
    ev = S.read_table_stream(spark, sf_dir, "events.parquet")
    det = D.with_content_format(ev, "props", "d", sample_chars=None).select("event_id", "d.format")
    return S.run_to_table(det, spark, "detect")
