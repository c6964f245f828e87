"""Stateless operators on Structured Streaming sources, run with availableNow."""
import pytest
from pyspark.sql import functions as F

from quire.operators import audit as A
from quire.operators import detect as D
from quire.operators import filters as FL
from quire.streaming import stream as S

SF = "/root/testdata/sf0.001"


def test_stateless_operators_on_a_stream(spark):
    ev = S.read_table_stream(spark, SF, "events.parquet")
    labeled = ev.withColumn("label", F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("event_type")))
    kept = FL.filter_null_values(labeled, ["label"], remove_nulls=False)  # F10 on a stream
    out = kept.select("event_id", A.error_classify(F.concat(F.lit("connection timeout "), "event_type")).alias("c"),
                      D.detect_by_content(F.col("props")).alias("d"))
    res = S.run_to_table(out, spark, "test-stateless")
    batch = spark.read.parquet(f"{SF}/events.parquet")
    assert res.count() == batch.where("event_type = 'error'").count()
    assert {r.c.category for r in res.select("c").collect()} == {"network"}
    assert {r.d.format for r in res.select("d").collect()} == {"json"}


def test_order_dependent_steps_are_rejected(spark):
    ev = S.read_table_stream(spark, SF, "events.parquet")
    with pytest.raises(ValueError):
        S.stream_transform(ev, [object()])
