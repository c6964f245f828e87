"""Plan shape checks: what must hold for the operators to survive skew and scale."""
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
Q = E.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_grouping_operators_aggregate_map_side(spark):
    # a value holding a third of the rows reaches the shuffle as one row per map task
    assert "partial_min" in plan(Q["f11_unique"](spark, SF))
    assert plan(Q["f12_duplicates"](spark, SF)).count("HashAggregate") >= 2
    k3 = plan(Q["k3_json_object"](spark, SF))
    assert "partial_max_by" in k3 or "partial_max" in k3


def test_filters_reach_the_scan_through_renames(spark):
    p = plan(Q["f1_filter_data"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,200000.0)" in p
    p9 = plan(Q["f9_custom"](spark, SF))
    assert "EqualTo(c_mkts" in p9  # the plan string truncates long filter lists


def test_projection_is_pruned(spark):
    p = plan(Q["p6_select_columns"](spark, SF))
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in p


def test_samples_are_top_n_not_full_sorts(spark):
    for name in ("f14_random", "f15_first", "f16_last"):
        assert "TakeOrderedAndProject" in plan(Q[name](spark, SF)), name


def test_no_cross_joins(spark):
    for name in ("a5_json_schema", "a3_conversion_delta", "k9_md_table_lines"):
        p = plan(Q[name](spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_ordinals_store_keys_and_join_rows_once(spark):
    from quire.functions.ordinal import with_ordinal
    df = spark.read.parquet(f"{SF}/orders.parquet")
    p = plan(with_ordinal(df, ["o_orderkey"]))
    # the only un-partitioned window is over the counts by range (one row a range)
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p
    assert "RDD" not in p                                   # no row is checkpointed
    assert "ReadSchema: struct<_q_k0:bigint,_q_part:int,_q_row:bigint" in p     # but keys are stored, with their places
    assert p.count("o_totalprice:double") == 1              # and the rows read once


def test_audit_log_reads_prune_day_partitions(spark, tmpdir_path):
    from quire.operators import audit as A
    path = f"{tmpdir_path}/log"
    A.append_audit_log(A.audit_events_from(spark.read.parquet(f"{SF}/events.parquet")), path)
    p = plan(A.read_audit_log(spark, path, "2024-01-10 06:00:00", "2024-01-12 18:00:00"))
    assert "PartitionFilters: [isnotnull(date" in p and "PartitionFilters: []" not in p
