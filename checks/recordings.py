"""Recordings and samples: accuracy report, fleet KPIs, health (JOI-01 .. JOI-03, AGG-01 .. AGG-14, FLT, TOP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, view
from checks.views import ev, obs, samples, table
from tripline.plans import observations as O
from tripline.session import scratch
from tripline.sources import readers as R
from tripline.sources import sinks as K

KEY = ("file_name",)
START, END = "1996-01-01", "1999-12-31"

view("sagg", """
SELECT file_name, count(*) FILTER (WHERE coalesce(valid, 0) = 1) acc_count, count(*) FILTER (WHERE coalesce(valid, 0) <> 1) invalid_acc_count,
  count(*) FILTER (WHERE valid = 1 AND accuracy <= 2) acc_le_2, count(*) FILTER (WHERE valid = 1 AND accuracy <= 3.5) acc_le_3_5,
  count(*) FILTER (WHERE valid = 1 AND accuracy <= 6) acc_le_6, count(*) FILTER (WHERE valid = 1 AND accuracy <= 10) acc_le_10,
  count(*) FILTER (WHERE valid = 1 AND accuracy > 10) acc_gt_10, avg(accuracy) FILTER (WHERE valid = 1) avg_accuracy,
  max(accuracy) FILTER (WHERE valid = 1) max_accuracy, min(accuracy) FILTER (WHERE valid = 1 AND accuracy > 0) min_accuracy,
  coalesce(string_agg(cast(accuracy AS varchar), ' - ' ORDER BY seq_no) FILTER (WHERE valid = 1), '') acc_list,
  coalesce(string_agg(cast(accuracy AS varchar), ' - ' ORDER BY seq_no) FILTER (WHERE coalesce(valid, 0) <> 1), '') inv_acc_list,
  arg_min(lat, seq_no) FILTER (WHERE valid = 1) first_lat, arg_min(lon, seq_no) FILTER (WHERE valid = 1) first_lon,
  arg_min(sample_ts, seq_no) FILTER (WHERE valid = 1) first_sample_ts
FROM smp GROUP BY 1""")
view("pfile", f"""
SELECT o.*, greatest(epoch_us(end_time) // 1000000 - epoch_us(start_time) // 1000000, 0) duration_sec,
  greatest(epoch_us(end_time) // 1000 - epoch_us(start_time) // 1000, 0) duration_ms, sagg.* EXCLUDE (file_name)
FROM obs o LEFT JOIN sagg USING (file_name)
WHERE start_time >= TIMESTAMP '{START}' AND start_time < TIMESTAMP '{END}' + INTERVAL 1 DAY""")


@check("agg_sample_agg", """
SELECT * REPLACE (round(avg_accuracy, 6) AS avg_accuracy, round(first_lat, 6) AS first_lat, round(first_lon, 6) AS first_lon) FROM sagg""")
def _(spark, d):
    out = O.sample_agg(samples(spark, d), KEY)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_accuracy", "first_lat", "first_lon")})


def _files(spark, d):
    return O.per_file(obs(spark, d), samples(spark, d), START, END, keys=KEY)


@check("join_per_file", """
SELECT device_id, file_name, start_time, duration_sec, duration_ms, acc_count, invalid_acc_count, acc_le_6, acc_list, first_sample_ts FROM pfile""")
def _(spark, d):
    return _files(spark, d).select("device_id", "file_name", "start_time", "duration_sec", "duration_ms", "acc_count",
                                   "invalid_acc_count", "acc_le_6", "acc_list", "first_sample_ts")


COND = """SELECT * FROM (SELECT 'cond1' condition, * FROM {0} WHERE ignition_status = 1 AND uptime > 300 UNION ALL
  SELECT 'cond2', * FROM {0} WHERE ignition_status = 1 AND max_speed > 5 UNION ALL SELECT 'cond3', * FROM {0} WHERE ignition_status = 1)"""
view("conds", COND.format("pfile"))


@check("gps_observation_report", """
SELECT c.condition, c.device_id, '1996-1999' AS date_range, '' AS tenant,
  CASE WHEN min(ota) = max(ota) THEN min(ota) ELSE 'OTA Updated' END ota, count(*) obs_count,
  coalesce(round(sum(acc_le_2) * 100.0 / nullif(sum(acc_count), 0), 2), 0) pct_le_2,
  coalesce(round(sum(acc_le_3_5) * 100.0 / nullif(sum(acc_count), 0), 2), 0) pct_le_3_5,
  coalesce(round(sum(acc_le_6) * 100.0 / nullif(sum(acc_count), 0), 2), 0) pct_le_6,
  coalesce(round(sum(acc_le_10) * 100.0 / nullif(sum(acc_count), 0), 2), 0) pct_le_10,
  coalesce(round(sum(acc_gt_10) * 100.0 / nullif(sum(acc_count), 0), 2), 0) pct_gt_10,
  coalesce(round(sum(invalid_acc_count) * 100.0 / nullif(sum(duration_sec), 0), 2), 0) gps_loss_pct, 0.0 AS no_gps_pct,
  cast(coalesce(sum(duration_sec), 0) AS bigint) expected_count, cast(coalesce(sum(acc_count), 0) AS bigint) actual_count,
  cast(coalesce(sum(invalid_acc_count), 0) AS bigint) invalid_count, min(ign.ign_high) ign_high, min(ign.ign_low) ign_low
FROM conds c JOIN (SELECT device_id, count(*) FILTER (WHERE ignition_status > 0) ign_high,
  count(*) FILTER (WHERE ignition_status = 0) ign_low FROM pfile GROUP BY 1) ign USING (device_id) GROUP BY 1, 2""")
def _(spark, d):
    out = O.gps_observation_report(_files(spark, d), "1996-1999")
    return out.drop("avg_accuracy", "max_accuracy", "min_accuracy")


@check("gps_observation_extremes", """
SELECT condition, device_id, round(sum(avg_accuracy * acc_count) FILTER (WHERE acc_count > 0) / sum(acc_count) FILTER (WHERE acc_count > 0), 4) avg_accuracy,
  max(max_accuracy) max_accuracy, min(min_accuracy) min_accuracy FROM conds GROUP BY 1, 2""")
def _(spark, d):
    from tripline.functions.scalars import weighted_mean

    return O.apply_conditions(_files(spark, d)).groupBy("condition", "device_id").agg(
        F.round(weighted_mean("avg_accuracy", "acc_count"), 4).alias("avg_accuracy"), F.max("max_accuracy").alias("max_accuracy"),
        F.min("min_accuracy").alias("min_accuracy"))


@check("gps_summary", """
SELECT device_id, file_name, coalesce(acc_count, 0) accuracy_count, coalesce(invalid_acc_count, 0) invalid_accuracy_count, start_time,
  duration_ms AS duration, uptime, ignition_status, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS recorded_time,
  epoch_us(start_time) // 1000 AS recorded_epoch, metadatastatus, coalesce(acc_list, '') accuracy, coalesce(inv_acc_list, '') invalid_accuracy,
  ota AS app_ver, max_speed, round(avg_accuracy, 6) avg_accuracy, round(first_lat, 6) latitude, round(first_lon, 6) longitude,
  first_sample_ts AS timestamp FROM pfile""")
def _(spark, d):
    from checks.views import ms

    out = O.gps_summary(_files(spark, d).withColumn("nw_recorded_time", ms("start_time")))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_accuracy", "latitude", "longitude")})


@check("flt_conditions", f"SELECT condition, count(*) AS n, sum(uptime)::bigint AS uptime FROM ({COND.format('obs')}) GROUP BY 1")
def _(spark, d):
    return O.apply_conditions(obs(spark, d)).groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.sum("uptime").alias("uptime"))


@check("flt_window_explicit", f"""
SELECT file_name FROM obs WHERE start_time >= TIMESTAMP '{START}' AND start_time <= TIMESTAMP '{END} 23:59:59' AND ota = '3.6.1' AND device_id = '7'""")
def _(spark, d):
    return O.window_filter(obs(spark, d), start=START, end=END, version="3.6.1", device="7").select("file_name")


@check("flt_window_hours", """
SELECT file_name FROM obs WHERE start_time >= TIMESTAMP '1999-06-01' - INTERVAL 2160 HOUR""")
def _(spark, d):
    return O.window_filter(obs(spark, d), hours=2160, now=F.lit("1999-06-01").cast("timestamp")).select("file_name")


@check("flt_inclusive_end", """
SELECT file_name, start_time < TIMESTAMP '1998-03-05' + INTERVAL 1 DAY AS by_day, start_time < TIMESTAMP '1998-03-05 10:00:00' + INTERVAL 1 MILLISECOND AS by_instant
FROM obs WHERE start_time < TIMESTAMP '1998-03-06'""")
def _(spark, d):
    o = obs(spark, d)
    day = O.before_inclusive_end(o, "1998-03-05").withColumn("by_day", F.lit(True))
    instant = O.before_inclusive_end(o, "1998-03-05 10:00:00").select("file_name", F.lit(True).alias("by_instant"))
    return day.join(instant, "file_name", "left").select("file_name", "by_day", F.coalesce("by_instant", F.lit(False)).alias("by_instant"))


@check("flt_table_health", """
SELECT count(*) total_rows, count(*) FILTER (WHERE start_time IS NULL) null_start_time, count(*) FILTER (WHERE device_id = '') empty_device_id,
  count(*) FILTER (WHERE num_frames_out IS NULL) null_frames FROM obs""")
def _(spark, d):
    return O.table_health(obs(spark, d))


@check("join_files_with_counts", """
SELECT device_id, o.file_name, min(ota) ota, min(start_time) min_start, max(start_time) max_start, coalesce(min(n), 0) pts FROM obs o
LEFT JOIN (SELECT file_name, count(*) n FROM smp GROUP BY 1) s USING (file_name) GROUP BY 1, 2""")
def _(spark, d):
    return O.files_with_counts(obs(spark, d), samples(spark, d), keys=KEY)


@check("join_obs_with_samples", """
SELECT device_id, count(*) n, round(sum(accuracy), 2) acc FROM obs JOIN smp USING (file_name) WHERE ota = '2.6.0' GROUP BY 1""")
def _(spark, d):
    out = O.obs_with_samples(obs(spark, d), samples(spark, d), F.col("ota") == "2.6.0", keys=KEY)
    return out.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("accuracy"), 2).alias("acc"))


_KPI = """count(*) file_count, count(*) FILTER (WHERE pts > 0) files_with_samples, min(start_time) min_start_time, max(start_time) max_start_time,
  cast(coalesce(sum(pts), 0) AS bigint) pts, cast(coalesce(sum(va), 0) AS bigint) valid_acc, cast(coalesce(sum(ia), 0) AS bigint) invalid_acc,
  cast(coalesce(sum(b1), 0) AS bigint) le_2, cast(coalesce(sum(b2), 0) AS bigint) le_3_5, cast(coalesce(sum(b3), 0) AS bigint) le_6,
  cast(coalesce(sum(b4), 0) AS bigint) le_10, cast(coalesce(sum(b5), 0) AS bigint) gt_10, round(sum(s) / nullif(sum(va), 0), 6) avg_accuracy,
  count(*) * 4 expected_count, cast(greatest(count(*) * 4 - coalesce(sum(va), 0), 0) AS bigint) missing_count,
  round(greatest(count(*) * 4 - coalesce(sum(va), 0), 0) * 100.0 / (count(*) * 4), 6) gps_loss_pct"""
view("fpts", """
SELECT o.*, v.* EXCLUDE (file_name) FROM obs o LEFT JOIN (SELECT file_name, count(*) pts, count(*) FILTER (WHERE accuracy > 0) va,
  count(*) FILTER (WHERE accuracy IS NULL OR accuracy <= 0) ia, count(*) FILTER (WHERE accuracy > 0 AND accuracy <= 2) b1,
  count(*) FILTER (WHERE accuracy > 0 AND accuracy <= 3.5) b2, count(*) FILTER (WHERE accuracy > 0 AND accuracy <= 6) b3,
  count(*) FILTER (WHERE accuracy > 0 AND accuracy <= 10) b4, count(*) FILTER (WHERE accuracy > 10) b5, sum(accuracy) FILTER (WHERE accuracy > 0) s
  FROM smp GROUP BY 1) v USING (file_name)""")


@check("gps_kpis", f"""
SELECT 'fleet' AS level, NULL AS group_key, {_KPI} FROM fpts UNION ALL SELECT 'device', device_id, {_KPI} FROM fpts WHERE device_id <> '' GROUP BY 2
UNION ALL SELECT 'version', ota, {_KPI} FROM fpts GROUP BY 2""")
def _(spark, d):
    out = O.gps_kpis(obs(spark, d), samples(spark, d), expected=4, keys=KEY)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_accuracy", "gps_loss_pct")})


view("frames", """
SELECT device_id, file_name, start_time, coalesce(CASE WHEN regexp_matches(num_frames_out, '^[0-9]+$') THEN cast(num_frames_out AS bigint) END,
  nullif(coalesce(pts, 0), 0), 0) observed, CASE WHEN coalesce(NOT regexp_matches(num_frames_out, '^[0-9]+$'), TRUE) AND coalesce(pts, 0) = 0 THEN 1 ELSE 0 END missing
FROM fpts""")


@check("video_loss", """
SELECT count(*) file_count, min(start_time) min_start_time, max(start_time) max_start_time, cast(sum(observed) AS bigint) observed_total,
  count(*) * 60 expected_total, cast(greatest(count(*) * 60 - sum(observed), 0) AS bigint) missing_total, cast(sum(missing) AS bigint) rows_missing_signal,
  round(greatest(count(*) * 60 - sum(observed), 0) * 100.0 / (count(*) * 60), 6) video_loss_pct FROM frames""")
def _(spark, d):
    return O.video_loss(obs(spark, d), samples(spark, d), keys=KEY).withColumn("video_loss_pct", F.round("video_loss_pct", 6))


@check("top_loss_hotspots", """
SELECT device_id, file_name, start_time, observed AS observed_frames, greatest(60 - observed, 0) missing_frames, round(greatest(60 - observed, 0) * 100.0 / 60, 6) missing_pct
FROM frames ORDER BY missing_frames DESC, start_time DESC, device_id, file_name LIMIT 10""")
def _(spark, d):
    return O.loss_hotspots(obs(spark, d), samples(spark, d), keys=KEY).withColumn("missing_pct", F.round("missing_pct", 6))


_NUM = "CASE WHEN regexp_matches(num_frames_out, '^[0-9]+$') THEN cast(num_frames_out AS bigint) END"


@check("session_health", f"""
SELECT count(*) total_files, count(DISTINCT device_id) devices, count(DISTINCT ota) versions, min(start_time) earliest_start, max(start_time) latest_start,
  count(*) FILTER (WHERE ignition_status = 1) ignition_on, count(*) FILTER (WHERE ignition_status IS NULL) ignition_null,
  count(*) FILTER (WHERE pts > 0) with_samples, count({_NUM}) with_frames, round(avg(coalesce({_NUM}, 0)), 1) avg_frames,
  count(*) FILTER (WHERE metadatastatus = 'full') full_metadata, count(*) FILTER (WHERE metadatastatus = '') empty_metadata FROM fpts""")
def _(spark, d):
    return O.session_health(obs(spark, d), samples(spark, d), keys=KEY)


@check("session_health_by_device", f"""
SELECT device_id, ota, count(*) file_count, min(start_time) first_session, max(start_time) last_session,
  count(*) FILTER (WHERE ignition_status = 1) ignition_on, count(*) FILTER (WHERE pts > 0) with_samples, count({_NUM}) with_frames,
  round(avg(coalesce({_NUM}, 0)), 1) avg_frames, count(*) FILTER (WHERE metadatastatus = 'full') full_metadata
FROM fpts GROUP BY 1, 2 ORDER BY file_count DESC, device_id, ota LIMIT 20""")
def _(spark, d):
    return O.session_health_by_device(obs(spark, d), samples(spark, d), keys=KEY)


@check("sample_overview", """
SELECT count(*) files, count(*) FILTER (WHERE n > 0) files_with_samples, cast(sum(n) AS bigint) samples, cast(sum(v) AS bigint) valid_samples, min(lo) min_speed, max(hi) max_speed
FROM (SELECT DISTINCT device_id, file_name FROM obs) LEFT JOIN (SELECT file_name, count(*) n, count(*) FILTER (WHERE valid = 1) v, min(speed) lo, max(speed) hi
FROM smp GROUP BY 1) USING (file_name)""")
def _(spark, d):
    return O.sample_overview(obs(spark, d), samples(spark, d), keys=KEY)


@check("observation_overview", """
SELECT count(*) total_rows, min(start_time) min_start_time, max(start_time) max_start_time, count(num_frames_out) rows_with_frames,
  count(DISTINCT device_id) devices, count(DISTINCT ota) versions FROM obs""")
def _(spark, d):
    return O.observation_overview(obs(spark, d))


@check("top_devices", "SELECT device_id, count(*) rows_count FROM obs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, d):
    return O.top_devices(obs(spark, d), 20)


@check("files_per_day", "SELECT cast(cast(start_time AS date) AS varchar) AS day, count(*) files FROM obs GROUP BY 1")
def _(spark, d):
    return O.files_per_day(obs(spark, d)).withColumn("day", F.col("day").cast("string"))


@check("top_capped_groups", """
SELECT device_id, n, (SELECT count(DISTINCT device_id) FROM obs) total_groups, TRUE AS truncated FROM (SELECT device_id, count(*) n FROM obs GROUP BY 1)
ORDER BY n DESC, device_id LIMIT 7""")
def _(spark, d):
    groups = obs(spark, d).groupBy("device_id").agg(F.count(F.lit(1)).alias("n"))
    return O.capped_groups(groups, 7, "n", "device_id")


@check("prj_observation", """
SELECT cast(o_custkey AS varchar) device_id, 'v' || o_orderkey file_name, '4.6.1' ota, date_trunc('second', o_orderdate) start_time,
  cast(o_orderkey % 2 AS bigint) ignition_status, 2 AS sample_count, cast(o_orderkey % 300 AS double) max_speed, 'full' AS metadatastatus,
  'objects' AS inference_keys, TRUE AS has_alerts FROM orders""")
def _(spark, d):
    from checks.views import ms, table
    from tripline.sources.readers import OBSERVATION_SCHEMA

    key = F.col("o_orderkey").cast("string")
    doc = F.concat(
        F.lit('{"deviceId":"'), F.col("o_custkey").cast("string"), F.lit('","app_ver":"4.6.1","videoName":"v'), key, F.lit('.mp4","startTime":'),
        ms("o_orderdate").cast("string"), F.lit(',"endTime":'), ms("o_orderdate").cast("string"), F.lit(',"deviceModes":{"ignition_status":"'),
        (F.col("o_orderkey") % 2).cast("string"), F.lit('"},"systemUpTime":7,"networkInfo":{"rssi":"-70","rat":"LTE"},"videoMetaData":[{"speed":'),
        (F.col("o_orderkey") % 300).cast("string"), F.lit('},{"speed":500}],"inference_data":"{\\"alerts_data\\":null,\\"objects\\":1}"}'))
    docs = table(spark, d, "orders").select(F.from_json(doc, OBSERVATION_SCHEMA).alias("j")).select("j.*")
    out = O.project_observation(docs)
    return out.select("device_id", "file_name", "ota", F.col("start_time").cast("timestamp_ntz").alias("start_time"), "ignition_status", "sample_count",
                      "max_speed", "metadatastatus", F.array_join("inference_keys", ",").alias("inference_keys"), "has_alerts")


# ── round trips of readers and writers ──


@check("snk_write_observations", """
SELECT part, device_id, file_name, start_time, strftime(start_time, '%Y-%m') AS month FROM obs, (VALUES ('observations'), ('samples')) v(part)""")
def _(spark, d):
    folder = scratch(spark)
    rows = obs(spark, d).select("device_id", "file_name", "start_time")
    K.write_observations(rows, rows, folder, file_rows=500)
    both = [spark.read.parquet(f"{folder}/{n}").withColumn("part", F.lit(n)) for n in ("observations", "samples")]
    return both[0].unionByName(both[1]).select("part", "device_id", "file_name", "start_time", F.col("month").cast("string").alias("month"))


@check("snk_csv_by", "SELECT device_id, event_id, process_name FROM ev")
def _(spark, d):
    folder = scratch(spark)
    K.write_csv_by(ev(spark, d).select("device_id", "event_id", "process_name"), folder, "device_id", ["event_id"], file_rows=100)
    return spark.read.schema("event_id bigint, process_name string, device_id string").option("header", True).csv(folder).select("device_id", "event_id", "process_name")


@check("snk_write_csv", "SELECT event_id::VARCHAR AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM ev")
def _(spark, d):
    folder = scratch(spark)
    K.write_csv(ev(spark, d), folder, ["event_id", "ts"])
    return spark.read.option("header", True).csv(folder)


@check("src_observations", """
SELECT 'S' || s_suppkey AS "deviceId", s_name AS "videoName", 1700000000000 + s_suppkey AS "startTime", CASE WHEN s_suppkey % 2 = 0 THEN 'lte' END AS rat, s_acctbal AS accuracy FROM supplier WHERE s_suppkey % 5 <> 0""")
def _(spark, d):
    # a file per supplier, its first document counts; every fifth has no device
    s = table(spark, d, "supplier")
    docs = s.select(F.col("s_suppkey").cast("int").alias("n"), F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).alias("deviceId"), F.col("s_name").alias("videoName"),
                    (F.lit(1_700_000_000_000) + F.col("s_suppkey")).alias("startTime"), F.struct(F.when(F.col("s_suppkey") % 2 == 0, "lte").alias("rat")).alias("networkInfo"),
                    F.array(F.struct(F.lit(True).alias("valid"), F.col("s_acctbal").alias("accuracy"))).alias("videoMetaData"))
    folder = scratch(spark)
    docs.repartition(spark.sparkContext.defaultParallelism, "n").write.partitionBy("n").json(folder)
    return R.read_observations(spark, folder).select("deviceId", "videoName", "startTime", F.col("networkInfo.rat").alias("rat"), F.col("videoMetaData")[0]["accuracy"].alias("accuracy"))


@check("src_known_patterns", "SELECT DISTINCT p_name AS pattern, p_type AS explanation FROM part")
def _(spark, d):
    folder = scratch(spark)
    rows = table(spark, d, "part").select(F.col("p_name").alias("pattern"), F.col("p_type").alias("explanation")).distinct()
    none = R.read_known_patterns(spark, f"{folder}/none")
    rows.write.json(f"{folder}/known")
    return R.read_known_patterns(spark, f"{folder}/known").unionByName(none)


@check("src_pattern_csv", "SELECT p_partkey || ' ' || p_name || ', <N>' AS description_pattern, CASE WHEN p_size % 2 = 0 THEN 'ERROR' ELSE 'INFO' END AS type FROM part WHERE p_size % 7 <> 0")
def _(spark, d):
    folder = scratch(spark)
    rows = table(spark, d, "part").select(F.concat(F.lit("  "), F.col("p_partkey").cast("string"), F.lit(" "), "p_name", F.lit(", <N> ")).alias("description_pattern"),
                                          F.when(F.col("p_size") % 7 == 0, "").when(F.col("p_size") % 2 == 0, "ERROR ").otherwise("INFO").alias("TYPE"))
    rows.write.option("header", True).csv(folder)
    return R.read_pattern_csv(spark, folder).select("description_pattern", "type")


@check("src_copy_range", f"SELECT event_id, ts, cast(ts AS date)::VARCHAR AS day FROM ev WHERE ts >= TIMESTAMP '2024-01-05 10:00:00' AND ts < TIMESTAMP '2024-01-09'")
def _(spark, d):
    folder = scratch(spark)
    R.copy_range(ev(spark, d).select("event_id", "ts"), folder, "2024-01-05 10:00:00", "2024-01-07")
    R.copy_range(ev(spark, d).select("event_id", "ts"), folder, "2024-01-07", "2024-01-09")
    return spark.read.parquet(folder).select("event_id", "ts", F.col("day").cast("string").alias("day"))
