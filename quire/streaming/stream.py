"""Structured Streaming versions of the stateless operators, plus the two stateful analogues
(additions, not behaviour of the source tool):

* filters, key styles, column operations, content detection, alert and audit projections
  work unchanged on a streaming DataFrame (they are projections and filters);
* de-duplication maps to ``dropDuplicatesWithinWatermark`` (bounded state);
* performance statistics map to an event-time window with a watermark.

Order-dependent operators (positional sampling, first-of-group by row order, ordinal
transforms) have no meaning on an unbounded stream and are rejected.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.audit import metrics_from
from ..plans.transformations import ColumnOps, Filter, KeyStyle, apply_transformations
from ..session import scratch_dir

STATELESS_STEPS = (KeyStyle, ColumnOps, Filter)


def read_table_stream(spark: SparkSession, folder: str, file_name: str, max_files_per_trigger: int | None = None
                      ) -> DataFrame:
    """A file stream over the files named ``file_name`` in ``folder`` (schema from a batch read)."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{file_name}").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", file_name)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def stream_transform(stream: DataFrame, steps: Sequence) -> DataFrame:
    """Apply key styles, column operations and filters to a streaming DataFrame."""
    from ..plans.transformations import from_spec
    built = [from_spec(s) if isinstance(s, dict) else s for s in steps]
    for s in built:
        if not isinstance(s, STATELESS_STEPS):
            raise ValueError(f"{type(s).__name__} is not a stateless step")
    return apply_transformations(stream, built)


def dedupe_stream(stream: DataFrame, keys: Sequence[str] | None, event_time: str, delay: str) -> DataFrame:
    """F11/F12 on a stream: keep the first row per key (all columns when ``keys`` is None)
    among rows whose event times lie within ``delay`` of each other; state is bounded by
    the watermark."""
    cols = stream.columns
    w = _event_time(stream, event_time, "_q_evt").withWatermark("_q_evt", delay)
    subset = list(keys) if keys else cols
    return w.dropDuplicatesWithinWatermark(subset).select(*cols)


def _event_time(df: DataFrame, col: str, name: str) -> DataFrame:
    """Watermarks need TIMESTAMP; local (NTZ) times are read as UTC instants."""
    from pyspark.sql import types as T
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        return df.withColumn(name, F.col(col).cast("timestamp"))
    return df.withColumn(name, F.col(col))


def windowed_performance_stats(events_stream: DataFrame, window: str, delay: str) -> DataFrame:
    """L2 on a stream: per event-time window and operation, mean duration, count, success
    rate, mean heap and mean throughput."""
    metrics = metrics_from(events_stream)
    m = _event_time(metrics, "timestamp", "_q_evt").withWatermark("_q_evt", delay)
    start = F.window("_q_evt", window).start
    if metrics.schema["timestamp"].dataType.typeName() == "timestamp_ntz":
        start = start.cast("timestamp_ntz")
    return m.groupBy(start.alias("period_start"), "operation").agg(
        F.avg("duration").alias("avg_duration"), F.count(F.lit(1)).alias("count"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg("memory_usage.heap_used").alias("avg_heap_used"), F.avg("throughput").alias("avg_throughput"))


def run_to_table(stream: DataFrame, spark: SparkSession, name: str, output_mode: str = "append",
                 timeout_s: int = 600) -> DataFrame:
    """Run a streaming query to completion over the available input (``availableNow``) into a
    parquet table in the shared checkpoint folder, and return that table.

    Append mode uses the exactly-once file sink; update/complete modes write each batch's
    result through ``foreachBatch`` (complete mode overwrites with the full result).
    """
    base = scratch_dir(spark, f"stream-{name}")
    out, ckpt = f"{base}/data", f"{base}/_checkpoint"
    writer = stream.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True).outputMode(output_mode)
    if output_mode == "append":
        q: StreamingQuery = writer.format("parquet").start(out)
    else:
        def sink(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite" if output_mode == "complete" else "append").parquet(out)
        q = writer.foreachBatch(sink).start()
    finished = q.awaitTermination(timeout_s)
    if q.exception() is not None:
        raise q.exception()
    if not finished:
        q.stop()
        raise TimeoutError(f"stream {name} was still running after {timeout_s} s; its table is not complete")
    return spark.read.parquet(out)
