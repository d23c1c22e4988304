"""Finality of device days: state and timers over restarts."""

import datetime as dt

from tripline.streaming.incremental import run_readings


def write(spark, folder, rows):
    schema = "device string, day date, uploaded_at timestamp"
    spark.createDataFrame([(d, dt.date.fromisoformat(day), dt.datetime.fromisoformat(at)) for d, day, at in rows], schema).coalesce(1).write.mode("append").parquet(folder)


def read(spark, folder):
    return sorted((r["device"], str(r["day"]), r["reason"], str(r["at"]), r["uploads"]) for r in spark.read.parquet(folder).collect())


def test_a_day_is_read_until_it_is_final_also_after_a_restart(spark, tmp_path):
    src, dst, state = (str(tmp_path / n) for n in ("src", "dst", "state"))
    write(spark, src, [("a", "2026-01-01", "2026-01-01 20:00:00"), ("a", "2026-01-01", "2026-01-01 21:00:00"), ("b", "2026-01-01", "2026-01-01 22:00:00")])
    run_readings(spark, src, dst, state)
    first = [("a", "2026-01-01", "upload", "2026-01-01 21:00:00", 2), ("b", "2026-01-01", "upload", "2026-01-01 22:00:00", 1)]
    assert read(spark, dst) == first
    # another query of the same checkpoint: the day of a is not final yet, its earlier uploads still count
    write(spark, src, [("a", "2026-01-01", "2026-01-02 09:00:00")])
    run_readings(spark, src, dst, state)
    second = [("a", "2026-01-01", "upload", "2026-01-02 09:00:00", 3)]
    assert read(spark, dst) == sorted(first + second)
    # time passes the end of the day by more than 24 hours: both days are read for the last time
    write(spark, src, [("c", "2026-01-04", "2026-01-04 12:00:00")])
    run_readings(spark, src, dst, state)
    third = [("c", "2026-01-04", "upload", "2026-01-04 12:00:00", 1), ("a", "2026-01-01", "final", "2026-01-03 00:00:00", 3), ("b", "2026-01-01", "final", "2026-01-03 00:00:00", 1)]
    assert read(spark, dst) == sorted(first + second + third)
    # an upload after that is read again, but nothing is kept for it
    write(spark, src, [("b", "2026-01-01", "2026-01-04 13:00:00")])
    run_readings(spark, src, dst, state)
    late = [("b", "2026-01-01", "upload", "2026-01-04 13:00:00", 1)]
    assert read(spark, dst) == sorted(first + second + third + late)
    write(spark, src, [("c", "2026-01-04", "2026-01-09 12:00:00")])
    run_readings(spark, src, dst, state)
    assert [r for r in read(spark, dst) if r[2] == "final"] == [("a", "2026-01-01", "final", "2026-01-03 00:00:00", 3), ("b", "2026-01-01", "final", "2026-01-03 00:00:00", 1),
                                                               ("c", "2026-01-04", "final", "2026-01-06 00:00:00", 2)]
