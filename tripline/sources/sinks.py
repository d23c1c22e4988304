"""Writers and the run registry (SNK-01 .. SNK-10)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tripline.operators.lists import SEGMENT, segmented_lists
from tripline.operators.sequences import global_rank
from tripline.session import settle


def replace_window(df: DataFrame, path: str, start: str, end: str, ts: str = "ts") -> None:
    """SNK-01: the rows of [start, end) replace what the table holds of it.

    The table is partitioned by day.  Rows that the two edge days hold outside the window are read
    back, settled and written with the new ones, so dynamic overwrite swaps whole days and loses none;
    days left without rows are emptied.  Running it again gives the same table.
    """
    spark = df.sparkSession
    kind = df.schema[ts].dataType
    rows = df.filter((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.lit(end).cast(kind))).withColumn("day", F.to_date(ts))
    hadoop = spark._jvm.org.apache.hadoop.fs
    if hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop.Path(path)):
        lo, hi = F.lit(start).cast(kind), F.lit(end).cast(kind)
        edge = spark.read.schema(rows.schema).parquet(path).filter(F.col("day").isin(F.to_date(lo), F.to_date(hi)) & ((F.col(ts) < lo) | (F.col(ts) >= hi)))
        rows = rows.unionByName(settle(edge))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    # One row per day of the window: days to empty
    days = spark.sql(f"select explode(sequence(to_date('{start}'), to_date(timestamp'{end}' - interval 1 microsecond))) as day")
    empty = days.join(rows.select("day").distinct(), "day", "left_anti")
    for r in empty.collect():
        p = hadoop.Path(f"{path}/day={r['day']}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dedup_latest(df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str] = ()) -> DataFrame:
    """SNK-02: the last row per key.  An aggregate, so copies shrink before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    pick = F.max_by(row, F.struct(F.col(order), *[F.col(c) for c in tie]))
    return df.groupBy(*keys).agg(pick.alias("__r")).select("__r.*")


def with_month(df: DataFrame, ts: str = "start_time") -> DataFrame:
    return df.withColumn("month", F.date_format(ts, "yyyy-MM"))


#: Rows of one file a writer aims at.
FILE_ROWS = 1_000_000


def planned(df: DataFrame, folder: Sequence[str], key: str | None, order: Sequence[str], ts: str | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """``df`` dealt to tasks by weight, for a write that is partitioned by ``folder``: files of about ``file_rows`` rows, sorted by ``order``.

    Rows are counted first, per folder, key and hour of ``ts`` (without it, per hash of the row).  A key above the target is cut into ranges of
    hours by a running count over one row per hour, and an hour above it by hash; so a hot key is many tasks and many files, each of a
    range of time.  The other keys of a folder are packed together, as many files as their rows fill, each key whole in one.  A task writes files of many
    folders, one of each at most, so tasks grow with the rows and the files of the largest folder, not with the folders.  Null keys and times count as values.
    """
    folder, keys = list(folder), [*folder, *([key] if key else [])]
    if ts:
        span = F.coalesce(F.unix_seconds(F.date_trunc("hour", F.col(ts).cast("timestamp"))), F.lit(-(1 << 40)))
    else:
        span = F.pmod(F.xxhash64(*df.columns), F.lit(1024))
    rows = df.withColumn("__span", span.cast("bigint"))
    counts = settle(rows.groupBy(*keys, "__span").agg(F.count(F.lit(1)).alias("__n")))
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__n"))
    null_safe = lambda left, right, names: reduce(and_, [left[c].eqNullSafe(right[c]) for c in names])
    large = totals.filter(F.col("__n") > file_rows).drop("__n")
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = counts.join(large, null_safe(counts, large, keys), "left_semi").select(
        *[F.col(c).alias(f"__p_{c}") for c in [*keys, "__span"]], F.floor(before / file_rows).alias("__range"), F.ceil(F.col("__n") / file_rows).alias("__pieces"))
    packed = totals.filter(F.col("__n") <= file_rows).groupBy(*[F.col(c).alias(f"__f_{c}") for c in folder]).agg(F.ceil(F.sum("__n") / file_rows).alias("__files"))
    placed = rows.join(cut, reduce(and_, [rows[c].eqNullSafe(cut[f"__p_{c}"]) for c in [*keys, "__span"]]), "left")
    placed = placed.join(packed, reduce(and_, [placed[c].eqNullSafe(packed[f"__f_{c}"]) for c in folder]), "left")
    piece = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    label = lambda p, i: F.concat_ws("-", F.lit("l"), F.xxhash64(*[F.col(f"{p}{c}") for c in keys]), F.lpad(F.col("__range").cast("string"), 12, "0"), i)
    small = lambda i: F.concat_ws("-", F.lit("s"), i)
    named = placed.withColumn("__file", F.when(F.col("__range").isNotNull(), label("", F.pmod(F.xxhash64(*df.columns), F.col("__pieces")))).otherwise(small(F.pmod(F.xxhash64(*keys), F.col("__files")))))
    # one row per file; its number tells the task that writes it
    files = (cut.withColumn("__i", piece("__pieces")).select(*[F.col(f"__p_{c}").alias(f"__g_{c}") for c in folder], label("__p_", F.col("__i")).alias("__name")).distinct()
             .unionByName(packed.withColumn("__i", piece("__files")).select(*[F.col(f"__f_{c}").alias(f"__g_{c}") for c in folder], small(F.col("__i")).alias("__name"))))
    files = settle(files.withColumn("__id", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*[f"__g_{c}" for c in folder], "__name")) - 1).cast("int")))
    # files of one folder are numbered in a row, so they go to different tasks
    most = files.groupBy(*[f"__g_{c}" for c in folder]).count().agg(F.max("count"), F.sum("count")).first()
    total = totals.agg(F.sum("__n")).first()[0] or 0
    tasks = max(1, most[0] or 0, min(most[1] or 0, max(-(-total // FILE_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    files = files.withColumn("__id", F.col("__id") % tasks)
    same = reduce(and_, [named[c].eqNullSafe(files[f"__g_{c}"]) for c in folder]) & (named["__file"] == files["__name"])
    return named.join(files, same).repartitionById(tasks, "__id").sortWithinPartitions(*folder, *order).select(*df.columns)


def write_observations(obs: DataFrame, samples: DataFrame, root: str, file_rows: int = FILE_ROWS) -> None:
    """SNK-03: recordings and samples of one extract, both by month and sorted by device and file; a device's month of any size is cut into files."""
    for df, name in ((obs, "observations"), (samples, "samples")):
        planned(with_month(df), ["month"], "device_id", ["device_id", "file_name"], "start_time", file_rows).write.mode("append").partitionBy("month").parquet(f"{root}/{name}")


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """SNK-04: CSV report with a header (also when empty) and fixed time format."""
    out = df.select(*columns) if columns else df
    out.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def write_csv_by(df: DataFrame, path: str, key: str = "device_id", order: Sequence[str] = (), file_rows: int = FILE_ROWS) -> None:
    """SNK-05: one CSV folder per key, with one file unless the key has more than ``file_rows`` rows."""
    planned(df, [key], None, order, None, file_rows).write.mode("overwrite").option("header", True).partitionBy(key).csv(path)


def side_by_side(blocks: Mapping[str, tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """SNK-06: unrelated blocks next to each other by row number, padded to the deepest.

    ``blocks``: prefix -> (frame, time column, tie columns) that order its rows.
    """
    out = None
    for prefix, (df, ts, tie) in blocks.items():
        n = global_rank(df, ts, tie, "row_no")
        n = n.select(F.col("row_no"), *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])
        out = n if out is None else out.join(n, "row_no", "full_outer")
    return out


def config_wide(rows: DataFrame, sections: Sequence[str], key: str = "device") -> DataFrame:
    """SNK-07: one column per config section holding its values as JSON."""
    cells = rows.groupBy(key, "section").agg(F.to_json(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct("key", "value"))))).alias("json"))
    return cells.groupBy(key).pivot("section", list(sections)).agg(F.first("json"))


def code_order(rows: DataFrame, code: str = "code") -> list[str]:
    """Event codes by frequency: the header of the wide CSV (as short as the code list)."""
    counts = rows.groupBy(code).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), code)
    return [r[code] for r in counts.collect()]


def alert_sessions_wide(rows: DataFrame, codes: Sequence[str], keys: Sequence[str] = ("device", "session")) -> DataFrame:
    """SNK-08: a row per session with one count column per event code, most frequent first."""
    return rows.groupBy(*keys).pivot("code", list(codes)).count().na.fill(0)


def drop_empty_columns(df: DataFrame, optional: Sequence[str]) -> DataFrame:
    """SNK-08: optional columns without any value are left out."""
    seen = df.agg(*[F.count(c).alias(c) for c in optional]).first()
    return df.drop(*[c for c in optional if not seen[c]])


def devices_by_state_json(df: DataFrame) -> DataFrame:
    """SNK-09: per version a JSON object of states and their devices."""
    per = df.groupBy("version", "state").agg(F.array_sort(F.collect_set("device_id")).alias("ids"))
    return per.groupBy("version").agg(F.to_json(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct("state", "ids"))))).alias("states"))


def devices_by_state(df: DataFrame, size: int = SEGMENT) -> DataFrame:
    """SNK-09: the same lists as rows (version, state, segment, devices) of at most ``size`` devices, for versions with very many."""
    return segmented_lists(df, ["version", "state"], "device_id", size, name="devices")


# ── run registry ─────────────────────────────────────────────────────────────

REGISTRY_SCHEMA = "window_start string, window_end string, signature string, status string, started_at timestamp, note string"


def registry_append(spark: SparkSession, path: str, start: str, end: str, signature: str, status: str, note: str = "",
                    at: str | None = None) -> None:
    """SNK-10: add one status row of a window."""
    stamp: Column = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    row = spark.range(1).select(F.lit(start).alias("window_start"), F.lit(end).alias("window_end"), F.lit(signature).alias("signature"),
                                F.lit(status).alias("status"), stamp.alias("started_at"), F.lit(note).alias("note"))
    row.coalesce(1).write.mode("append").parquet(path)


def latest_status(registry: DataFrame) -> DataFrame:
    """SNK-10: last status of every window and signature."""
    return registry.groupBy("window_start", "window_end", "signature").agg(
        F.max_by("status", F.struct("started_at", "status")).alias("status"))


def registry_should_run(registry: DataFrame, start: str, end: str, signature: str, force: bool = False) -> bool:
    """SNK-10: whether a window still has to run: not when its last status is ``completed``."""
    if force:
        return True
    row = latest_status(registry).filter((F.col("window_start") == start) & (F.col("window_end") == end)
                                         & (F.col("signature") == signature)).first()
    return row is None or row["status"] != "completed"


def step_summary(steps: DataFrame) -> DataFrame:
    """AGG-31: timings per step with its slowest device."""
    return steps.groupBy("step").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("duration_s").alias("total_s"), F.avg("duration_s").alias("avg_s"),
        F.max("duration_s").alias("max_s"), F.max_by("device", F.struct("duration_s", "device")).alias("slowest_device"),
        F.min("started_at").alias("first_start"), F.bool_or(F.col("status") == "failed").alias("any_failed"))


def device_timings(steps: DataFrame) -> DataFrame:
    """AGG-32: timings per device."""
    return steps.groupBy("device").agg(
        F.sum("duration_s").alias("total_s"), F.sum(F.when(F.col("step") == "download", F.col("duration_s"))).alias("download_s"),
        F.sum(F.when(F.col("step") != "download", F.col("duration_s"))).alias("analysis_s"),
        F.count_if(F.col("status") == "failed").alias("failed_steps"))


def size_summary(files: DataFrame) -> DataFrame:
    """AGG-30: files and sizes per device and day."""
    kb = F.col("bytes") / 1024
    return files.groupBy("device", "day").agg(
        F.count(F.lit(1)).alias("files"), F.min(kb).alias("min_kb"), F.max(kb).alias("max_kb"), F.avg(kb).alias("avg_kb"),
        F.sum(kb).alias("sum_kb"), (F.sum("bytes") / 1024 / 1024).alias("mb"))


def list_runs(runs: DataFrame, n: int | None = None, status: str | None = None, environment: str | None = None) -> DataFrame:
    """TOP-06: runs by falling number, all or the last n."""
    if status:
        runs = runs.filter(F.col("status") == status)
    if environment:
        runs = runs.filter(F.col("environment") == environment)
    rows = runs.orderBy(F.desc("run_id"))
    return rows if n is None else rows.limit(n)


def latest_report(reports: DataFrame, by: Sequence[str] = ("device",)) -> DataFrame:
    """TOP-05: the report with the last boot start per device."""
    return reports.groupBy(*by).agg(F.max_by("report", F.struct("last_boot_start", "report")).alias("report"),
                                    F.max("last_boot_start").alias("last_boot_start"))


def slice_rows(df: DataFrame, order: Sequence[str], start: int, limit: int) -> DataFrame:
    """TOP-07: rows of an order from a start position."""
    return df.orderBy(*order).offset(max(0, start)).limit(max(0, limit))


# ── sets ─────────────────────────────────────────────────────────────────────


def union_days(*dfs: DataFrame) -> DataFrame:
    """SET-01: results of days that may overlap, every row once."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out.dropDuplicates()
