"""Registered queries for audit and operations analytics (L1-L7, A11), over log tables
derived from ``events`` as FIXTURES.md maps them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from .catalog import register, table

_AUDIT_SQL = """(SELECT CAST(event_id AS VARCHAR) AS id, ts AS "timestamp", event_type AS type,
  CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS resource,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS result, value * 1000 AS duration,
  CASE WHEN event_type = 'error' THEN 'medium' ELSE 'low' END AS severity, event_id FROM events)"""


@register("l1_audit_trail", f"""
SELECT id, "timestamp", type, user_id, result, severity FROM {_AUDIT_SQL}
WHERE user_id = '8' AND "timestamp" >= TIMESTAMP '2024-01-05 00:00:00' AND "timestamp" <= TIMESTAMP '2024-01-25 00:00:00'
ORDER BY "timestamp" DESC, id DESC LIMIT 20
""")
def l1_audit_trail(spark, sf_dir):
    """The newest 20 audit records of one user in a time range (L1)."""
    audit = A.audit_events_from(table(spark, sf_dir, "events"))
    trail = A.audit_trail(audit, user_id=8, start="2024-01-05 00:00:00", end="2024-01-25 00:00:00", limit=20)
    return trail.select("id", "timestamp", "type", "user_id", "result", "severity")


@register("l2_performance_stats", """
SELECT event_type AS operation, date_trunc('day', ts) AS period_start, avg(value * 1000) AS avg_duration,
       count(*) AS count, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS success_rate,
       avg(value * 1e7) AS avg_heap_used, avg(value) AS avg_throughput
FROM events GROUP BY ALL
""")
def l2_performance_stats(spark, sf_dir):
    """Per operation and day: mean duration, count, success rate, mean heap, mean throughput (L2)."""
    m = A.metrics_from(table(spark, sf_dir, "events"))
    return A.performance_stats(m, period="1 day")


@register("l2_performance_stats_filtered", """
SELECT event_type AS operation, avg(value * 1000) AS avg_duration, count(*) AS count,
       avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS success_rate,
       avg(value * 1e7) AS avg_heap_used, avg(value) AS avg_throughput
FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-10 00:00:00'
  AND ts <= TIMESTAMP '2024-01-20 00:00:00'
GROUP BY ALL
""")
def l2_performance_stats_filtered(spark, sf_dir):
    """Statistics of one operation in a time range (L2)."""
    m = A.metrics_from(table(spark, sf_dir, "events"))
    return A.performance_stats(m, operation="purchase", start="2024-01-10 00:00:00", end="2024-01-20 00:00:00")


_JS_NUM = r"regexp_replace(CAST({x} AS VARCHAR), '\.0$', '')"


@register("l3_threshold_alerts", f"""
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS operation, w AS warning FROM (
  SELECT event_id, event_type, unnest(list_filter([
    CASE WHEN value * 1000 > {A.MAX_DURATION_MS} THEN 'Operation duration (' || {_JS_NUM.format(x='value * 1000')}
         || 'ms) exceeded threshold ({A.MAX_DURATION_MS}ms)' END,
    CASE WHEN value * 1e7 / 1024 / 1024 > {A.MAX_MEMORY_MB} THEN 'Memory usage ('
         || CAST(CAST(floor(value * 1e7 / 1024 / 1024 + 0.5) AS BIGINT) AS VARCHAR)
         || 'MB) exceeded threshold ({A.MAX_MEMORY_MB}MB)' END,
    CASE WHEN value <> 0 AND value < {A.MIN_THROUGHPUT} THEN 'Throughput (' || {_JS_NUM.format(x='value')}
         || ' rec/s) below threshold ({A.MIN_THROUGHPUT} rec/s)' END], lambda x: x IS NOT NULL)) AS w
  FROM events)
""")
def l3_threshold_alerts(spark, sf_dir):
    """Duration, memory and throughput alerts over the metrics derived from events (L3)."""
    return A.threshold_alerts(A.metrics_from(table(spark, sf_dir, "events")))


@register("l4_audit_records", """
SELECT 'FILE_CONVERSION' AS type, 'convert_file' AS action, 'file_' || event_id || '.csv' AS resource,
       CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS result, value * 1000 AS duration,
       CAST(user_id AS VARCHAR) AS user_id, '{"targetFormat":"json"}' AS details,
       CASE WHEN event_type = 'error' THEN 'medium' ELSE 'low' END AS severity
FROM events
""")
def l4_audit_records(spark, sf_dir):
    """Conversion results as audit events with their severity (L4)."""
    ev = table(spark, sf_dir, "events")
    conv = ev.select(F.concat(F.lit("file_"), F.col("event_id").cast("string"), F.lit(".csv")).alias("source_path"),
                     F.lit("json").alias("target_format"),
                     F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("result"),
                     (F.col("value") * 1000).alias("duration"), F.col("user_id").cast("string").alias("user_id"))
    return A.conversion_audit_records(conv)


@register("l4_error_records", """
SELECT 'ERROR_OCCURRED' AS type, 'error' AS action, 'failure' AS result, CAST(user_id AS VARCHAR) AS user_id,
       '{"errorCode":"' || CASE WHEN event_id % 2 = 0 THEN 'NOT_A_KNOWN_CODE' ELSE 'OTHER' END || '","errorMessage":"event '
       || event_id || '","errorCategory":"system","errorSeverity":"medium","recoverable":false}' AS details,
       'medium' AS severity
FROM events WHERE event_type = 'error'
UNION ALL SELECT 'SECURITY_VIOLATION', event_type, 'failure', CAST(user_id AS VARCHAR), props, 'high'
FROM events WHERE event_type <> 'error'
""")
def l4_error_records(spark, sf_dir):
    """Error events (unknown codes) and all others as security events, as audit records (L4)."""
    ev = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string").alias("user_id")
    err = A.error_audit_records(ev.where("event_type = 'error'").select(
        F.when(F.col("event_id") % 2 == 0, "NOT_A_KNOWN_CODE").otherwise("OTHER").alias("code"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"), user))
    sec = A.security_audit_records(ev.where("event_type <> 'error'").select(
        F.col("event_type").alias("action"), F.lit("failure").alias("result"), user,
        F.lit(None).cast("string").alias("ip_address"), F.col("props").alias("details")))
    return err.unionByName(sec.drop("ip_address"))


@register("l5_retention", f"""
SELECT count(*) FILTER (WHERE "timestamp" < TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 30 DAYS) AS removed_records,
       count(*) FILTER (WHERE "timestamp" >= TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 30 DAYS) AS kept_records
FROM {_AUDIT_SQL}
""")
def l5_retention(spark, sf_dir):
    """Records removed and kept by a 30-day retention cut."""
    audit = A.audit_events_from(table(spark, sf_dir, "events"))
    _, report = A.retention(audit, now="2024-02-15 00:00:00", days=30)
    return report.select("removed_records", "kept_records")


@register("l5_retention_log", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT CAST(count(*) FILTER (WHERE day < DATE '2024-01-16') AS INTEGER) AS removed_days,
       CAST(coalesce(sum(n) FILTER (WHERE day < DATE '2024-01-16'), 0) AS BIGINT) AS removed_records,
       CAST(coalesce(sum(n) FILTER (WHERE day >= DATE '2024-01-16'), 0) AS BIGINT) AS kept_records,
       CAST(0 AS BIGINT) AS bytes_unaccounted
FROM d
""")
def l5_retention_log(spark, sf_dir):
    """A log by days, cut at 30 days: days and records dropped, records kept, and whether freed bytes equal the files' (L5)."""
    from ..session import scratch_dir
    from ..sources.files import every_file
    log = scratch_dir(spark, "auditlog")
    A.append_audit_log(A.audit_events_from(table(spark, sf_dir, "events")), log)

    def size():
        return every_file(spark, log).agg(F.sum("length")).first()[0] or 0
    before = size()
    report = A.drop_expired(spark, log, now="2024-02-15 09:30:00", days=30)
    kept = A.read_audit_log(spark, log).agg(F.count(F.lit(1)).alias("kept_records")) if size() else report.select(
        F.lit(0).cast("long").alias("kept_records"))
    left = F.lit(before - size()).cast("long") - F.col("freed_bytes")
    return report.join(kept).select("removed_days", "removed_records", "kept_records", left.alias("bytes_unaccounted"))


# One message per classification rule (and one matching none), used to
# label events in the error-classification query.
ERROR_MESSAGES = ["ENOENT: no such file", "EACCES: permission denied", "file exists already", "is a directory",
                  "Unexpected token < in JSON", "malformed xml tag", "invalid csv delimiter", "parse failure",
                  "schema validation failed", "access denied for user", "out of memory", "no space left on device",
                  "quota limit reached", "connection timeout", "socket closed", "all good"]


def _messages_col():
    arr = F.array(*[F.lit(m) for m in ERROR_MESSAGES])
    return F.concat(F.col("event_type"), F.lit(": "),
                    F.element_at(arr, (F.col("event_id") % len(ERROR_MESSAGES) + 1).cast("int")))


def _sql_classify(t: str) -> str:
    def any_of(words):
        return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"

    def cls(cat, sev, strat, retry, msg):
        return (f"{{'category': '{cat}', 'severity': '{sev}', 'strategy': '{strat}', "
                f"'retryable': {str(retry).lower()}, 'user_message': '{msg}'}}")

    parts = []
    for keywords, subs, default in A.ERROR_RULES:
        inner = " ".join(f"WHEN {any_of(w)} THEN {cls(*c)}" for w, *c in subs)
        value = f"CASE {inner} ELSE {cls(*default)} END" if subs else cls(*default)
        parts.append(f"WHEN {any_of(keywords)} THEN {value}")
    return "CASE " + " ".join(parts) + f" ELSE {cls(*A.UNKNOWN_CLASS)} END"


_MSG_SQL = ("event_type || ': ' || ([" + ", ".join(f"'{m}'" for m in ERROR_MESSAGES) + "])[event_id % "
            + str(len(ERROR_MESSAGES)) + " + 1]")


@register("l6_error_classify", f"""
SELECT event_id, message, c.category AS category, c.severity AS severity, c.strategy AS strategy,
       c.retryable AS retryable, c.user_message AS user_message
FROM (SELECT event_id, message, {_sql_classify('lower(message)')} AS c
      FROM (SELECT event_id, {_MSG_SQL} AS message FROM events))
""")
def l6_error_classify(spark, sf_dir):
    """Ordered keyword classification of error messages."""
    ev = table(spark, sf_dir, "events").select("event_id", _messages_col().alias("message"))
    return ev.select("event_id", "message", A.error_classify(F.col("message")).alias("c")).select(
        "event_id", "message", "c.category", "c.severity", "c.strategy", "c.retryable", "c.user_message")


_CODES = list(A.ERROR_CODES)


def _sql_code_attr(i: int, code: str) -> str:
    def lit(v):
        return str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return "CASE " + " ".join(f"WHEN {code} = '{k}' THEN {lit(v[i])}" for k, v in A.ERROR_CODES.items()) + " END"


@register("l7_error_attributes", f"""
SELECT event_id, code, {_sql_code_attr(0, 'code')} AS severity, {_sql_code_attr(1, 'code')} AS category,
       {_sql_code_attr(2, 'code')} AS recoverable, {_sql_code_attr(3, 'code')} AS user_message
FROM (SELECT event_id, ([{", ".join(f"'{c}'" for c in _CODES)}])[event_id % {len(_CODES)} + 1] AS code FROM events)
""")
def l7_error_attributes(spark, sf_dir):
    """Severity, category, recoverability and message of error codes."""
    codes = F.array(*[F.lit(c) for c in _CODES])
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.element_at(codes, (F.col("event_id") % len(_CODES) + 1).cast("int")).alias("code"))
    return ev.select("event_id", "code", A.error_attributes(F.col("code")).alias("a")).select(
        "event_id", "code", "a.severity", "a.category", "a.recoverable", "a.user_message")


@register("a11_conversion_statistics", """
SELECT event_type AS format, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS successful,
       count(*) FILTER (WHERE event_type = 'error') AS failed, avg(value * 1000) AS avg_duration
FROM events GROUP BY event_type
""")
def a11_conversion_statistics(spark, sf_dir):
    """Totals, successes, failures and mean duration per format."""
    audit = A.audit_events_from(table(spark, sf_dir, "events")).withColumnRenamed("type", "format")
    return A.conversion_statistics(audit)


@register("a11_conversion_totals", """
SELECT event_type AS format, false AS overall, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS successful,
       count(*) FILTER (WHERE event_type = 'error') AS failed, avg(value * 1000) AS avg_duration
FROM events GROUP BY event_type
UNION ALL
SELECT NULL, true, count(*), count(*) FILTER (WHERE event_type <> 'error'), count(*) FILTER (WHERE event_type = 'error'),
       avg(value * 1000) FROM events
""")
def a11_conversion_totals(spark, sf_dir):
    """The same figures per format and over all formats."""
    audit = A.audit_events_from(table(spark, sf_dir, "events")).withColumnRenamed("type", "format")
    return A.conversion_statistics(audit, overall=True)


# The expected texts are written out here once more, apart from the operator's own table.
@register("l7_recovery_suggestions", """
WITH c(i, code, advice) AS (VALUES
  (0, 'FILE_NOT_FOUND', 'Verify the file path is correct|Check if the file exists in the specified location|Ensure you have read permissions for the file'),
  (1, 'PERMISSION_DENIED', 'Check file and directory permissions|Run with appropriate user privileges|Contact your system administrator'),
  (2, 'UNSUPPORTED_FORMAT', 'Use a supported format: CSV, Excel, JSON, XML, or Markdown|Convert your file to a supported format first|Check the file extension matches the content'),
  (3, 'CONVERSION_FAILED', 'Verify the input file is not corrupted|Check if the file format is valid|Try with a smaller file to test|Review any transformation parameters'),
  (4, 'VALIDATION_FAILED', 'Review the validation errors in the details|Fix the data issues and try again|Check the data format requirements'),
  (5, 'NETWORK_ERROR', 'Check your internet connection|Verify network settings and firewall rules|Try again in a few moments'),
  (6, 'TIMEOUT_ERROR', 'Try with a smaller file|Increase the timeout setting if possible|Check system resources and performance'),
  (7, 'MEMORY_ERROR', 'Try with a smaller file|Close other applications to free memory|Process the file in smaller chunks'),
  (8, 'DISK_SPACE_ERROR', 'Free up disk space|Choose a different output location|Clean up temporary files'),
  (9, 'RATE_LIMIT_ERROR', 'Wait before trying again|Reduce the frequency of requests'),
  (10, 'CONFIGURATION_ERROR', 'Check the configuration settings|Verify all required parameters are provided|Contact your administrator for configuration help'),
  (11, 'DEPENDENCY_ERROR', 'Install the required dependencies|Check the system requirements|Contact support for installation help'),
  (12, 'NO_SUCH_CODE', 'Try the operation again|Check the system logs for more details|Contact support if the problem persists'))
SELECT event_id, code, advice || CASE WHEN code = 'RATE_LIMIT_ERROR' AND event_id % 5 <> 0
                                      THEN '|Retry after ' || (event_id % 5) || ' seconds' ELSE '' END AS suggestions
FROM events JOIN c ON event_id % 13 = i
""")
def l7_recovery_suggestions(spark, sf_dir):
    """Suggestions for each event's error code, with the wait of rate limits."""
    codes = F.array(*[F.lit(c) for c in (*A.RECOVERY_SUGGESTIONS, "NO_SUCH_CODE")])
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.element_at(codes, (F.col("event_id") % 13 + 1).cast("int")).alias("code"))
    got = A.recovery_suggestions(F.col("code"), F.col("event_id") % 5)
    return ev.select("event_id", "code", F.array_join(got, "|").alias("suggestions"))


def _rules_sql(t: str) -> str:
    """The ordered rules written out from the design's table (SURVEY, L6), apart from the operator's own."""
    def has(words: str) -> str:
        return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words.split("; ")) + ")"
    return f"""CASE
  WHEN {has("enoent; eacces; eexist; eisdir; enotdir; file not found; directory not found; permission denied; file exists; not a directory; is a directory")} THEN CASE
    WHEN {has("enoent; file not found")} THEN 'file_system/high/user_input/no'
    WHEN {has("eacces; permission denied")} THEN 'permission/high/user_input/no'
    WHEN {has("eexist; file exists")} THEN 'file_system/medium/fallback/yes' ELSE 'file_system/medium/retry/yes' END
  WHEN {has("parse; parsing; invalid format; malformed; syntax error; unexpected token; invalid json; invalid xml; invalid csv; corrupt")} THEN CASE
    WHEN {has("json; unexpected token")} THEN 'format/high/fallback/no' WHEN {has("xml; malformed")} THEN 'format/high/fallback/no'
    WHEN {has("csv; delimiter")} THEN 'format/medium/fallback/yes' ELSE 'format/high/fallback/no' END
  WHEN {has("validation; invalid; required; missing; constraint; schema; type mismatch")} THEN 'validation/medium/user_input/no'
  WHEN {has("permission; access denied; unauthorized; forbidden; not allowed")} THEN 'permission/high/user_input/no'
  WHEN {has("memory; disk space; quota; limit; too large; insufficient; out of; no space; space left")} THEN CASE
    WHEN {has("memory")} THEN 'resource/critical/fallback/yes'
    WHEN {has("disk space; no space")} THEN 'resource/critical/user_input/no' ELSE 'resource/high/fallback/yes' END
  WHEN {has("network; connection; timeout; unreachable; dns; socket; http; https")} THEN 'network/medium/retry/yes'
  ELSE 'unknown/medium/none/no' END"""


@register("l6_error_rules", f"""
SELECT 'doc ' || doc_id AS id, {_rules_sql("lower(text)")} AS found FROM documents
UNION ALL SELECT 'page ' || page_id, {_rules_sql("lower(html)")} FROM pages
UNION ALL SELECT 'event ' || event_id, {_rules_sql("lower(event_type || ' ' || props)")} FROM events
""")
def l6_error_rules(spark, sf_dir):
    """Documents, pages and events read as error messages, by the ordered rules."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("id"), "text")
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("page "), F.col("page_id").cast("string")), "html")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("event "), F.col("event_id").cast("string")),
                                              F.concat_ws(" ", "event_type", "props"))
    c = d.union(p).union(e).select("id", A.error_classify(F.col("text")).alias("c"))
    return c.select("id", F.concat_ws("/", "c.category", "c.severity", "c.strategy",
                                      F.when(F.col("c.retryable"), "yes").otherwise("no")).alias("found"))


@register("l4_audit_log_partitioned", """
SELECT CAST(event_id AS VARCHAR) AS id, ts AS "timestamp", event_type AS type,
       CASE WHEN event_type = 'error' THEN 'medium' ELSE 'low' END AS severity
FROM events WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts <= TIMESTAMP '2024-01-12 18:00:00'
""")
def l4_audit_log_partitioned(spark, sf_dir):
    """Audit records appended to a day-partitioned log, read back for a time range (pruned)."""
    from ..session import scratch_dir
    path = scratch_dir(spark, "auditlog")
    A.append_audit_log(A.audit_events_from(table(spark, sf_dir, "events")), path)
    log = A.read_audit_log(spark, path, "2024-01-10 06:00:00", "2024-01-12 18:00:00")
    return log.select("id", "timestamp", "type", "severity")
