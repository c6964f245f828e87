"""Audit and operations analytics as queries over log tables.

The tool writes audit events and performance metrics as JSON lines and leaves the query
side as placeholders; here the log tables are DataFrames (date-partitioned when written,
so time filters prune partitions) and every report is a filter / aggregate / projection.
Classification rules and code attributes are literal expressions: no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jscompat import js_string
from ..sources.files import every_file

# Performance alert thresholds.
MAX_DURATION_MS = 30000
MAX_MEMORY_MB = 500
MIN_THROUGHPUT = 100
RETENTION_DAYS = 90

# Error classification rules, first match wins. Each rule: (keywords, sub-rules,
# default); a sub-rule is (keywords, category, severity, strategy, retryable, user message).
ERROR_RULES = [
    (["enoent", "eacces", "eexist", "eisdir", "enotdir", "file not found", "directory not found",
      "permission denied", "file exists", "not a directory", "is a directory"],
     [(["enoent", "file not found"], "file_system", "high", "user_input", False,
       "The specified file could not be found"),
      (["eacces", "permission denied"], "permission", "high", "user_input", False,
       "Permission denied accessing the file"),
      (["eexist", "file exists"], "file_system", "medium", "fallback", True, "File already exists at the destination")],
     ("file_system", "medium", "retry", True, "File system operation failed")),
    (["parse", "parsing", "invalid format", "malformed", "syntax error", "unexpected token", "invalid json",
      "invalid xml", "invalid csv", "corrupt"],
     [(["json", "unexpected token"], "format", "high", "fallback", False, "Invalid JSON format detected"),
      (["xml", "malformed"], "format", "high", "fallback", False, "Invalid XML format detected"),
      (["csv", "delimiter"], "format", "medium", "fallback", True, "CSV format issue detected")],
     ("format", "high", "fallback", False, "File format is invalid or corrupted")),
    (["validation", "invalid", "required", "missing", "constraint", "schema", "type mismatch"], [],
     ("validation", "medium", "user_input", False, "Data validation failed")),
    (["permission", "access denied", "unauthorized", "forbidden", "not allowed"], [],
     ("permission", "high", "user_input", False, "Access permission denied")),
    (["memory", "disk space", "quota", "limit", "too large", "insufficient", "out of", "no space", "space left"],
     [(["memory", "out of memory"], "resource", "critical", "fallback", True,
       "Insufficient memory to complete operation"),
      (["disk space", "no space"], "resource", "critical", "user_input", False, "Insufficient disk space")],
     ("resource", "high", "fallback", True, "Resource limit exceeded")),
    (["network", "connection", "timeout", "unreachable", "dns", "socket", "http", "https"], [],
     ("network", "medium", "retry", True, "Network operation failed")),
]
UNKNOWN_CLASS = ("unknown", "medium", "none", False, "An unexpected error occurred")

# Error code -> (severity, category, recoverable, user message).
ERROR_CODES = {
    "FILE_NOT_FOUND": ("medium", "system", False,
                       "The specified file could not be found. Please check the file path and try again."),
    "PERMISSION_DENIED": ("high", "security", False,
                          "Access denied. Please check file permissions or contact your administrator."),
    "UNSUPPORTED_FORMAT": ("medium", "user", False, "The file format is not supported. Please use a supported "
                           "format (CSV, Excel, JSON, XML, or Markdown)."),
    "CONVERSION_FAILED": ("medium", "data", True, "The file conversion failed. Please check your file and try again."),
    "VALIDATION_FAILED": ("low", "user", True, "The data validation failed. Please check your input and try again."),
    "NETWORK_ERROR": ("medium", "network", True, "A network error occurred. Please check your connection and try again."),
    "TIMEOUT_ERROR": ("medium", "network", True,
                      "The operation timed out. Please try again or contact support if the problem persists."),
    "MEMORY_ERROR": ("critical", "system", False,
                     "Insufficient memory to complete the operation. Please try with a smaller file."),
    "DISK_SPACE_ERROR": ("high", "system", False, "Insufficient disk space. Please free up space and try again."),
    "CORRUPTED_DATA": ("medium", "data", False,
                       "The file appears to be corrupted or damaged. Please try with a different file."),
    "AUTHENTICATION_ERROR": ("high", "security", False, "Authentication failed. Please check your credentials."),
    "RATE_LIMIT_ERROR": ("low", "network", True, "Too many requests. Please wait a moment and try again."),
    "CONFIGURATION_ERROR": ("high", "configuration", True, "Configuration error. Please contact your administrator."),
    "DEPENDENCY_ERROR": ("high", "system", False, "A required dependency is missing or unavailable."),
    "UNKNOWN_ERROR": ("medium", "system", False, "An unexpected error occurred. Please try again or contact support."),
}

AUDIT_EVENT_TYPES = ("FILE_ACCESS", "FILE_CONVERSION", "AUTHENTICATION", "AUTHORIZATION", "CONFIGURATION_CHANGE",
                     "ERROR_OCCURRED", "PERFORMANCE_METRIC", "SECURITY_VIOLATION", "DATA_EXPORT", "SYSTEM_START",
                     "SYSTEM_STOP")


# ---------------------------------------------------------------------------------------
# Log tables derived from an event table (FIXTURES mapping)
# ---------------------------------------------------------------------------------------

def audit_events_from(events: DataFrame) -> DataFrame:
    """Audit records from an event stream: failure when the event is an error."""
    failed = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").cast("string").alias("id"), F.col("ts").alias("timestamp"),
        F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("session-"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("event_type").alias("action"), F.get_json_object("props", "$.k").alias("resource"),
        F.when(failed, F.lit("failure")).otherwise(F.lit("success")).alias("result"),
        (F.col("value") * 1000).alias("duration"),
        conversion_severity(F.when(failed, F.lit("failure")).otherwise(F.lit("success"))).alias("severity"))


def metrics_from(events: DataFrame) -> DataFrame:
    """Performance metrics from an event stream."""
    return events.select(
        F.col("event_id").cast("string").alias("id"), F.col("ts").alias("timestamp"),
        F.col("event_type").alias("operation"), (F.col("value") * 1000).alias("duration"),
        F.struct((F.col("value") * 1e7).alias("heap_used")).alias("memory_usage"),
        F.col("value").alias("throughput"), (F.col("event_type") != "error").alias("success"))


# ---------------------------------------------------------------------------------------
# Reports
# ---------------------------------------------------------------------------------------

def _ts_lit(v, like: DataFrame, col: str) -> Column:
    return F.lit(v).cast(like.schema[col].dataType)


def audit_trail(audit: DataFrame, user_id=None, resource=None, event_type=None, start=None, end=None,
                limit: int | None = None) -> DataFrame:
    """L1: filter by user, resource, type and time range; newest first; optional top-n."""
    preds = []
    if user_id is not None:
        preds.append(F.col("user_id") == str(user_id))
    if resource is not None:
        preds.append(F.col("resource") == str(resource))
    if event_type is not None:
        preds.append(F.col("type") == event_type)
    if start is not None:
        preds.append(F.col("timestamp") >= _ts_lit(start, audit, "timestamp"))
    if end is not None:
        preds.append(F.col("timestamp") <= _ts_lit(end, audit, "timestamp"))
    out = audit
    for p in preds:
        out = out.filter(p)
    out = out.orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return out.limit(limit) if limit else out


def performance_stats(metrics: DataFrame, operation: str | None = None, start=None, end=None,
                      period: str | None = None) -> DataFrame:
    """L2: mean duration, count, success rate, mean heap and throughput per operation
    (and per time bucket with ``period``, e.g. ``"1 day"``)."""
    m = metrics
    if operation is not None:
        m = m.filter(F.col("operation") == operation)
    if start is not None:
        m = m.filter(F.col("timestamp") >= _ts_lit(start, m, "timestamp"))
    if end is not None:
        m = m.filter(F.col("timestamp") <= _ts_lit(end, m, "timestamp"))
    keys = [F.col("operation")]
    if period:
        keys.append(F.window("timestamp", period).start.alias("period_start"))
    return m.groupBy(*keys).agg(
        F.avg("duration").alias("avg_duration"), F.count(F.lit(1)).alias("count"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg("memory_usage.heap_used").alias("avg_heap_used"), F.avg("throughput").alias("avg_throughput"))


def threshold_alerts(metrics: DataFrame) -> DataFrame:
    """L3: one row per exceeded threshold (duration, heap in MB, throughput)."""
    mb = F.col("memory_usage.heap_used") / 1024 / 1024
    d = F.col("duration")
    warnings = F.array_compact(F.array(
        F.when(d > MAX_DURATION_MS, F.concat(F.lit("Operation duration ("), js_string(d, _double()),
                                             F.lit(f"ms) exceeded threshold ({MAX_DURATION_MS}ms)"))),
        F.when(mb > MAX_MEMORY_MB, F.concat(F.lit("Memory usage ("), F.floor(mb + 0.5).cast("string"),
                                            F.lit(f"MB) exceeded threshold ({MAX_MEMORY_MB}MB)"))),
        F.when(F.coalesce(F.col("throughput") != 0, F.lit(False)) & (F.col("throughput") < MIN_THROUGHPUT),
               F.concat(F.lit("Throughput ("), js_string(F.col("throughput"), _double()),
                        F.lit(f" rec/s) below threshold ({MIN_THROUGHPUT} rec/s)")))))
    return metrics.select("id", "operation", F.explode(warnings).alias("warning"))


def _double():
    from pyspark.sql import types as T
    return T.DoubleType()


def conversion_severity(result: Column) -> Column:
    """L4: failed conversions are medium, successful ones low."""
    return F.when(result == "failure", F.lit("medium")).otherwise(F.lit("low"))


def conversion_audit_records(conversions: DataFrame) -> DataFrame:
    """L4: conversion results (source_path, target_format, result, duration, user_id)
    -> audit events of type FILE_CONVERSION with their severity."""
    return conversions.select(
        F.lit("FILE_CONVERSION").alias("type"), F.lit("convert_file").alias("action"),
        F.col("source_path").alias("resource"), "result", "duration", "user_id",
        F.to_json(F.struct(F.col("target_format").alias("targetFormat"))).alias("details"),
        conversion_severity(F.col("result")).alias("severity"))


def error_audit_records(errors: DataFrame) -> DataFrame:
    """L4: errors (code, message, user_id) -> audit events of type ERROR_OCCURRED; category, severity
    and whether it can be mended come from the code (L7). Null and unknown codes are medium."""
    a = error_attributes(F.col("code"))
    e = errors.select("code", "message", "user_id", a.alias("_a"))
    details = F.to_json(F.struct(
        F.col("code").alias("errorCode"), F.col("message").alias("errorMessage"), F.col("_a.category").alias("errorCategory"),
        F.col("_a.severity").alias("errorSeverity"), F.col("_a.recoverable").alias("recoverable")))
    return e.select(F.lit("ERROR_OCCURRED").alias("type"), F.lit("error").alias("action"), F.lit("failure").alias("result"),
                    "user_id", details.alias("details"), F.col("_a.severity").alias("severity"))


def security_audit_records(events: DataFrame) -> DataFrame:
    """L4: security events (action, result, user_id, ip_address, details) as audit events, always high."""
    return events.select(F.lit("SECURITY_VIOLATION").alias("type"), "action", "result", "user_id", "ip_address", "details",
                         F.lit("high").alias("severity"))


def retention(audit: DataFrame, now, days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """(records kept, one-row report of removed/kept counts) for a cutoff of ``days``."""
    cutoff = F.lit(now).cast(audit.schema["timestamp"].dataType) - F.expr(f"INTERVAL {int(days)} DAYS")
    keep = F.col("timestamp") >= cutoff
    kept = audit.filter(keep)
    report = audit.agg(F.count_if(~keep).alias("removed_records"), F.count_if(keep).alias("kept_records"),
                       F.sum(F.when(~keep, F.octet_length(F.to_json(F.struct("*"))))).alias("freed_bytes"))
    return kept, report


def error_classify(message: Column) -> Column:
    """struct(category, severity, strategy, retryable, user_message) by the ordered keyword rules."""
    t = F.lower(message)

    def any_of(words):
        return F.greatest(*[t.contains(w) for w in words]) if len(words) > 1 else t.contains(words[0])

    def cls(cat, sev, strat, retry, msg):
        return F.struct(F.lit(cat).alias("category"), F.lit(sev).alias("severity"),
                        F.lit(strat).alias("strategy"), F.lit(retry).alias("retryable"),
                        F.lit(msg).alias("user_message"))

    out = None
    for keywords, subs, default in ERROR_RULES:
        inner = None
        for words, *c in subs:
            inner = F.when(any_of(words), cls(*c)) if inner is None else inner.when(any_of(words), cls(*c))
        value = cls(*default) if inner is None else inner.otherwise(cls(*default))
        out = F.when(any_of(keywords), value) if out is None else out.when(any_of(keywords), value)
    return out.otherwise(cls(*UNKNOWN_CLASS))


def error_attributes(code: Column) -> Column:
    """struct(severity, category, recoverable, user_message) of an error code."""
    def lookup(i):
        pairs = []
        for k, v in ERROR_CODES.items():
            pairs += [F.lit(k), F.lit(v[i])]
        return F.create_map(*pairs)[code]
    return F.struct(F.coalesce(lookup(0), F.lit("medium")).alias("severity"),
                    F.coalesce(lookup(1), F.lit("system")).alias("category"),
                    F.coalesce(lookup(2), F.lit(False)).alias("recoverable"),
                    F.coalesce(lookup(3), F.lit("An error occurred during the operation.")).alias("user_message"))


# What a user can do about each error code, in the order shown.
RECOVERY_SUGGESTIONS = {
    "FILE_NOT_FOUND": ("Verify the file path is correct",
                       "Check if the file exists in the specified location",
                       "Ensure you have read permissions for the file"),
    "PERMISSION_DENIED": ("Check file and directory permissions",
                          "Run with appropriate user privileges",
                          "Contact your system administrator"),
    "UNSUPPORTED_FORMAT": ("Use a supported format: CSV, Excel, JSON, XML, or Markdown",
                           "Convert your file to a supported format first",
                           "Check the file extension matches the content"),
    "CONVERSION_FAILED": ("Verify the input file is not corrupted",
                          "Check if the file format is valid",
                          "Try with a smaller file to test",
                          "Review any transformation parameters"),
    "VALIDATION_FAILED": ("Review the validation errors in the details",
                          "Fix the data issues and try again",
                          "Check the data format requirements"),
    "NETWORK_ERROR": ("Check your internet connection",
                      "Verify network settings and firewall rules",
                      "Try again in a few moments"),
    "TIMEOUT_ERROR": ("Try with a smaller file",
                      "Increase the timeout setting if possible",
                      "Check system resources and performance"),
    "MEMORY_ERROR": ("Try with a smaller file",
                     "Close other applications to free memory",
                     "Process the file in smaller chunks"),
    "DISK_SPACE_ERROR": ("Free up disk space",
                         "Choose a different output location",
                         "Clean up temporary files"),
    "RATE_LIMIT_ERROR": ("Wait before trying again",
                         "Reduce the frequency of requests"),
    "CONFIGURATION_ERROR": ("Check the configuration settings",
                            "Verify all required parameters are provided",
                            "Contact your administrator for configuration help"),
    "DEPENDENCY_ERROR": ("Install the required dependencies",
                         "Check the system requirements",
                         "Contact support for installation help"),
}
OTHER_SUGGESTIONS = ("Try the operation again",
                     "Check the system logs for more details",
                     "Contact support if the problem persists")


def recovery_suggestions(code: Column, retry_after: Column | None = None) -> Column:
    """Array of suggestions for an error code. ``retry_after``: seconds after which a rate limit
    ends; null or 0 adds nothing. Unknown and null codes get the general suggestions."""
    def texts(values):
        return F.array(*[F.lit(v) for v in values])

    pairs = [x for k, v in RECOVERY_SUGGESTIONS.items() for x in (F.lit(k), texts(v))]
    out = F.coalesce(F.create_map(*pairs)[code], texts(OTHER_SUGGESTIONS))
    if retry_after is None:
        return out
    wait = F.concat(F.lit("Retry after "), retry_after.cast("string"), F.lit(" seconds"))
    return F.when((code == "RATE_LIMIT_ERROR") & (retry_after != 0), F.array_append(out, wait)).otherwise(out)


def retry_delay_ms(attempt: Column, base_ms: int = 1000) -> Column:
    """Retry delay for attempt n (0-based): base * 2^n."""
    return F.lit(base_ms) * F.pow(F.lit(2), attempt).cast("long")


def conversion_statistics(audit: DataFrame, format_col: str = "format", overall: bool = False) -> DataFrame:
    """Totals, successes, failures and mean duration per format; with ``overall``, also one row
    over all formats (``overall`` true, null format), from the same aggregation."""
    ok = F.col("result") == "success"
    sums = [F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
            F.avg("duration").alias("avg_duration")]
    df = audit.withColumn("format", F.col(format_col))
    if not overall:
        return df.groupBy("format").agg(*sums)
    return df.rollup("format").agg((F.grouping("format") == 1).alias("overall"), *sums)


def drop_expired(spark, path: str, now, days: int = RETENTION_DAYS) -> DataFrame:
    """L5 on a log table that ``append_audit_log`` wrote: delete its days that ended before ``now`` less ``days``, whole
    partitions, and report them: one row of removed_days, removed_files, removed_records, freed_bytes.

    Sizes come from the listing, records from the footers of the files that go; those that stay are not
    read. The day in which the cutoff lies stays whole.
    """
    folder = F.to_date(F.regexp_extract("path", r"/date=([^/]+)/[^/]+$", 1))
    cutoff = F.to_date(F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))
    files = every_file(spark, path).select("length", folder.alias("date")).where(F.col("date") < cutoff)
    by_day = files.groupBy("date").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).collect()    # a row a day
    gone = sorted(r["date"] for r in by_day)
    records = spark.read.parquet(path).where(F.col("date").isin(gone)).count() if gone else 0
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for day in gone:
        fs.delete(hadoop.Path(root, f"date={day}"), True)
    return spark.createDataFrame([(len(gone), sum(r["files"] for r in by_day), records, sum(r["bytes"] for r in by_day))],
                                 "removed_days int, removed_files long, removed_records long, freed_bytes long")


def append_audit_log(records: DataFrame, path: str, ts_col: str = "timestamp") -> None:
    """L4 sink: append records to a log table partitioned by day, so time-range reads
    (L1, L2, L5) prune whole partitions instead of scanning the log."""
    (records.withColumn("date", F.to_date(F.col(ts_col)))
     .write.mode("append").partitionBy("date").parquet(path))


def read_audit_log(spark, path: str, start=None, end=None, ts_col: str = "timestamp") -> DataFrame:
    """A log table written by ``append_audit_log``, restricted to [start, end]: the day
    bounds prune partitions, the timestamp bounds keep the range exact."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter((F.col("date") >= F.to_date(F.lit(start))) & (F.col(ts_col) >= _ts_lit(start, df, ts_col)))
    if end is not None:
        df = df.filter((F.col("date") <= F.to_date(F.lit(end))) & (F.col(ts_col) <= _ts_lit(end, df, ts_col)))
    return df
