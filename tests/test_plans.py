"""Shapes of plans: pushdown, no Python in core operators, no pair joins."""

import contextlib
import io

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["gps_observation_report", "gps_kpis", "process_code_table", "asof_nearest", "join_assign_interval", "join_pair_first",
                                  "win_merge_intervals", "win_gap_sessions", "log_extract_hits", "join_compare_config", "gra_coverage_gaps"])
def test_core_has_no_python_and_no_pair_join(spark, name):
    text = plan(entry.queries()[name](spark, D))
    for bad in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text, f"{name}: {bad}"


def test_filters_and_columns_reach_the_scan(spark):
    from tripline.plans import events as E

    raw = spark.read.parquet(f"{D}/events.parquet").selectExpr("ts", "cast(user_id as string) device_id", "user_id", "event_type process_name")
    text = plan(raw.filter("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-06'").groupBy("process_name").count())
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text
    assert "value" not in text.split("ReadSchema")[1].splitlines()[0]
    full = spark.read.parquet(f"{D}/events.parquet").selectExpr(
        "ts", "cast(user_id as string) device_id", "event_type process_name", "cast(event_id as double) code", "'v' version", "props")
    scanned = plan(E.scan_events(full, "2024-01-05", "2024-01-06", [1.0]).select("device_id"))
    assert "GreaterThanOrEqual(ts" in scanned and "props" not in scanned.split("ReadSchema")[1].splitlines()[0]


def test_samples_are_reduced_before_the_join(spark):
    text = plan(entry.queries()["gps_kpis"](spark, D))
    tree = text.split("\n\n")[0]
    assert "Join" in tree and tree.count("HashAggregate") >= 4


def test_entry_and_oracles_line_up(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 250 and len(o) >= 240
    out = entry.entry(spark)
    assert out.count() > 0 and "condition" in out.columns


def test_sample_window_reaches_both_scans(spark, tmp_path):
    from pyspark.sql import functions as F

    from tripline.plans import observations as O

    spark.range(8).selectExpr("cast(id % 2 as string) device_id", "'f' file_name", "id start_time", "cast(id % 2 as string) ota").where("start_time < 2").write.parquet(f"{tmp_path}/obs")
    spark.range(8).selectExpr("cast(id % 2 as string) device_id", "'f' file_name", "id start_time", "1.0 accuracy").write.parquet(f"{tmp_path}/smp")
    obs, smp = spark.read.parquet(f"{tmp_path}/obs"), spark.read.parquet(f"{tmp_path}/smp")
    window = (F.col("start_time") >= 0) & (F.col("start_time") < 6)
    for df in (O.gps_kpis(obs, smp, window, samples_where=window), O.files_with_counts(obs, smp, window, samples_where=window),
               O.obs_with_samples(obs, smp, window, samples_where=window)):
        assert plan(df).count("LessThan(start_time") == 2
    # one file name on two devices: each sample meets its own device's recording
    rows = O.obs_with_samples(obs, smp, window, samples_where=window).groupBy("device_id").count().collect()
    assert sorted(map(tuple, rows)) == [("0", 3), ("1", 3)]
