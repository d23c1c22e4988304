"""Log lines, hits and metrics.  Lines are rendered from events; the SQL side reads the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, view
from checks.views import ev, lines, ms
from tripline.operators.timeline import scan
from tripline.plans import metrics as M
from tripline.plans import patterns as P
from tripline.plans import registry as R
from tripline.session import settle

T0 = 1_704_067_200_000

# One line kind per event type and last digit of k: (type, digits, service, text, key)
_SK = "concat('trip', k % 7, '_part1_33.5_-117.5_0.0_', 1700000000000 + k % 7, '_y')"
_UP = "concat('UPL: I: 1: ', k % 3, ': {}')"
_HC = "concat('{}: I: 5: ', k % 3, ': {}')"
TEMPLATES = (
    ("signup", (0, 1, 2), "ndcentral", "concat('NDC: I: 1: 1: System Uptime: ', k % 60, ' seconds')", "ndc_system_uptime"),
    ("signup", (3,), "svc", "'SVC: I: 1: 1: ######Starting SVC######'", "svc_start"),
    ("signup", (4,), "power_mon", "concat('PWR: I: 1: 1: POWER_MONITOR_ctx->previous_shutdown_reason ', "
     "case when k % 3 = 0 then 'A_LOWPOWER' when k % 3 = 1 then 'A_CYCLIC' else 'A_WATCHDOG' end)", "prev_shutdown"),
    ("signup", (5,), "ndcentral", "concat('NDC: I: 1: 1: first frame for cam num 0 registered@ ', t + k * 100)", "first_frame"),
    ("signup", (6,), "gps", "concat('GPSD: I: 1: 1: GPS First Fix time: ', k, ' sec')", "gps_ttff"),
    ("signup", (7,), "btfv", "'BTMAN: I: 1: 1: IGNITION ON received'", "bt_ignition_on"),
    ("signup", (8,), "btfv", "'BTMAN: I: 1: 1: Starting Driver Login Advertisement'", "driver_adv_start"),
    ("signup", (9,), "power_mon", "'PWR: E: 1: 1: #####STARTING POWER MONITOR#####'", "pm_start"),
    ("error", (0, 1, 2), "ndcentral", "concat('NDC: E: 1: 1: cam_num ', k % 9, ' is crashed')", "cam_crash"),
    ("error", (3,), "unifieduploader", "concat('UPL: I: 1: 1: PS Details: type - msg type: ', case when k % 2 = 0 then 100 else 110 end, ' msg level: 0')",
     "retry_details"),
    ("error", (4,), "unifieduploader", "concat('UPL: E: 1: 1: VOD upload attempt failed: vod-', k % 4, ', vod_id')", "vod_attempt_failed"),
    ("error", (5,), "unifieduploader", "concat('UPL: C: 1: 1: Exhausted all upload retries for vod-', k % 4, ' : 6')", "vod_exhausted"),
    ("error", (6,), "circ_buff", "'CB: I: 1: 1: collect_notify_videolist is FAILED'", "videolist_failed"),
    ("error", (7,), "health", "'curl_with_health: curl exited 6: x'", "health_post_failed"),
    ("error", (8,), "unifieduploader", f"concat('UPL: I: 1: 1: Upload failed for 0_', {_SK}, '.mp4')", "eventdata_fail"),
    ("error", (9,), "conn_mgr", "'CONN: E: 1: 1: Device disconnected : Exiting App'", "conn_exit"),
    ("view", (0, 1, 2), "ndcentral",
     "concat('NDC: I: 1: 1: RECORD_START for cam num ', k % 9, ' with session_cnt 0 received @ epoch_time_ms: ', t, ', x')", "record_start"),
    ("view", (3,), "health", "'x Upload of Health Stats successful'", "health_ok"),
    ("view", (4,), "circ_buff", f"concat('CB: I: 1: 1: Pushed file ', k % 3, '_', {_SK}, '.mp4 with size ', 7000 + k * 1000, ' to file_size_check_queue')",
     "pushed_file"),
    ("view", (5,), "ndcentral", "concat('CAM', k % 2, ': I: 1: 1: Frame count received: ', 100 + k)", "frame_count"),
    ("view", (6,), "deviceHealthClient", "concat('Received message: {\"storage_info\": {\"timestamp\": 1, \"no_of_hq\": {\"0\": \"', k, '/', k * 10, "
     "'.5\"}, \"no_of_lq\": {\"0\": \"', k + 1, '/100.0\"}, \"no_of_obs\": \"', k, '/1.0\"}}')", "storage_info"),
    ("view", (7,), "svc", "concat('DISK: I: 1: 1: Free space : ', k * 1000000)", "disk_free"),
    ("view", (8,), "diagnostic", "concat('DIAG: I: 1: 1: used memory of /dev/mmcblk0 is ', k)", "disk_used"),
    ("view", (9,), "diagnostic", "concat('WAF_U: I: 1: 1: Waf is 1.', k)", "waf"),
    ("click", (0,), "health_central", _HC.format("HCTR", "attempt_upload: starting, udid=1 payloadId=1 attempt=1, x"), "hc_attempt"),
    ("click", (1,), "health_central", _HC.format("UPLDCLIENT", "Uploading component health to https://x/upload/component-health"), "hc_call"),
    ("click", (2,), "health_central", _HC.format("HCTR", "Upload succeeded for 1 session(s) (udid=1 payloadId=1 x"), "hc_ok"),
    ("click", (3,), "health_central",
     "concat('HCTR: I: 1: 1: Config (re)loaded: enabled=', k % 2, ' a=1 upload_max_pending_interval_secs=3600 (server) x')", "hc_config"),
    ("click", (4,), "unifieduploader", "concat('UPL: I: 1: ', k % 3, ': Upload Observations Request Received ', (t - k * 10) * 1000)", "obs_req"),
    ("click", (5,), "unifieduploader", _UP.format("Creating observations zip file at once!"), "obs_zip_start"),
    ("click", (6,), "unifieduploader", _UP.format("Obs zip file created!"), "obs_zip_done"),
    ("click", (7,), "unifieduploader", _UP.format("Calling service: https://x/upload/observations"), "obs_call"),
    ("click", (8,), "unifieduploader", _UP.format("File uploaded. Deleting 1"), "obs_uploaded"),
    ("click", (9,), "unifieduploader", _UP.format("ERROR: Failed to fetch url (https://x/upload/observations)"), "obs_fail"),
    ("purchase", (0,), "inference", "case when k % 20 = 0 then 'x commn_set set() event_codes []' else concat('x commn_set set() event_codes [''a.', k % 3, ''', ''b'']') end",
     "commn_set"),
    ("purchase", (1,), "inference", f"concat('Moving /a/0_', {_SK}, '.STATE to UPLOAD_STATE   alerts found, exit')", "upload_state"),
    ("purchase", (2,), "inference", f"concat('Moving /a/0_', {_SK}, '.STATE to DELETE_STATE no alerts')", "delete_state"),
    ("purchase", (3,), "unifieduploader", f"concat('UPL: I: 1: ', k % 3, ': Summary file size: 1 name: /d/0_', {_SK}, '_summary.json.7z')", "eventdata_summary"),
    ("purchase", (4,), "unifieduploader", _UP.format("Calling service: https://x/upload/eventdata"), "eventdata_call"),
    ("purchase", (5,), "unifieduploader", f"concat('UPL: I: 1: 1: Upload successful for 0_', {_SK}, '.mp4')", "eventdata_ok"),
    ("purchase", (6,), "unifieduploader", f"concat('UPL: I: 1: 1: VOD req received. Id: 1, vod_id: v1 , video: /m/', k % 9, '_', {_SK}, '.mp4 , x')", "vod_req"),
    ("purchase", (7,), "unifieduploader", f"concat('UPL: I: 1: 1: Upload successful for video: /m/', k % 9, '_', {_SK}, '.mp4')", "video_ok"),
    ("purchase", (8,), "conn_mgr", "'CONN: I: 1: 1: Success : Data session connected'", "data_connected"),
    ("purchase", (9,), "circ_buff", "'CB: I: 1: 1: collect_notify_videolist is succeded'", "videolist_ok"),
)


def _case(pick: int) -> str:
    parts = [f"when process_name = '{t[0]}' and k % 10 in ({', '.join(map(str, t[1]))}) then {t[pick] if pick == 3 else repr(t[pick])}" for t in TEMPLATES]
    return "case " + " ".join(parts) + " end"


def registry_lines(spark, d):
    """Events as lines of the metric registry, on a timeline 600 times faster."""
    e = ev(spark, d, spread=True).withColumn("t", F.lit(T0) + F.floor((ms("ts") - T0) / 600))
    return e.select(F.col("device_id").alias("device"), F.expr(_case(2)).alias("service"), F.concat("device_id", F.lit("/"), F.expr(_case(2))).alias("file"),
                    F.col("event_id").alias("line_no"), F.col("t").alias("ts"),
                    F.concat(F.col("t").cast("string"), F.lit(": "), F.col("event_id").cast("string"), F.lit(": "), F.expr(_case(3))).alias("line"))


def hits(spark, d):
    return settle(P.extract_hits(registry_lines(spark, d), R.LINES))


view("hit", f"""
SELECT device_id device, {_case(4)} AS hkey, {T0} + (epoch_us(ts) // 1000 - {T0}) // 600 AS t, k, event_id, cast(k % 3 AS varchar) tid, k % 7 sess,
  cast(k % 9 AS varchar) cam FROM ev""")


def boots(spark, d, h):
    """One boot per power monitor start."""
    rows = h.filter("key = 'pm_start'").select("device", F.col("ts").alias("start"), F.lit(1).alias("one"))
    out = scan(rows, ["device"], "start", lead={"end": "start"}, total={"boot_index": "one"})
    out = settle(out)
    return out.select("device", "boot_index", "start", F.col("start").alias("eff_start"), "end", F.lit(None).cast("bigint").alias("anchor"),
                      (F.col("start") + 1000).alias("svc_start"), F.lit("4.6.1").alias("version"), F.lit(5).alias("drive_minutes"))


view("hboot", """
SELECT device, t AS s, lead(t) OVER (PARTITION BY device ORDER BY t) AS e, row_number() OVER (PARTITION BY device ORDER BY t) AS n FROM hit WHERE hkey = 'pm_start'""")


@check("log_extract_hits", "SELECT device, hkey AS key, t AS ts FROM hit")
def _(spark, d):
    return hits(spark, d).select("device", "key", "ts")


@check("log_match_lines", """
SELECT line_no, CASE WHEN k % 2 = 0 THEN 'retry,even' ELSE 'retry' END AS keys FROM (SELECT *, k % 10 % 2 AS z FROM lines) WHERE service IN ('error', 'click')""")
def _(spark, d):
    pats = [P.Pattern("retry", ("error", "click"), ("RETRY X",), r"retry x\d+ end"), P.Pattern("even", ("error", "click"), ("end",), r"x\d*[02468] END")]
    return P.match_lines(lines(spark, d), pats).select("line_no", F.array_join("keys", ",").alias("keys"))


@check("log_error_lines", """
SELECT line_no, 'native' AS format, 'ERROR: ' || description AS message, cast(ts AS varchar) AS time_text FROM (SELECT l.*, e.description FROM lines l JOIN ev e ON l.line_no = e.event_id)
WHERE service = 'error'""")
def _(spark, d):
    return P.error_lines(lines(spark, d)).select("line_no", "format", "message", "time_text")


@check("log_drop_noise", "SELECT line_no FROM lines WHERE k <> 7 AND NOT contains(file, 'view')")
def _(spark, d):
    return P.drop_noise(lines(spark, d), [r"retry x7 end$"], ["VIEW"]).select("line_no")


ERR = r"""
SELECT regexp_replace('ERROR: ' || description, '\S*[0-9]\S*', '<N>', 'g') || (CASE WHEN e.k % 2 = 0 THEN ' even' ELSE '' END) AS pattern, count(*) occurrences,
  count(DISTINCT description) variants, array_to_string(list_sort(list(DISTINCT file)), ',') files, max(cast(l.ts AS varchar)) last_seen
FROM lines l JOIN ev e ON l.line_no = e.event_id WHERE service = 'error' GROUP BY 1"""
view("erep", ERR)


def _errors(spark, d):
    rows = P.error_lines(lines(spark, d))
    return rows.withColumn("message", F.when(F.col("k") % 2 == 0, F.concat("message", F.lit(" even"))).otherwise(F.col("message")))


@check("agg_error_report", "SELECT * FROM erep")
def _(spark, d):
    return P.error_report(_errors(spark, d)).withColumn("files", F.array_join("files", ",")).drop("example")


@check("join_drop_known", "SELECT pattern, occurrences FROM erep WHERE pattern NOT LIKE '%even'")
def _(spark, d):
    rep = P.error_report(_errors(spark, d))
    return P.drop_known(rep, rep.filter("pattern like '%even'")).select("pattern", "occurrences")


@check("join_skipped_known", "SELECT count(*) AS patterns, cast(sum(occurrences) AS bigint) AS lines FROM erep WHERE pattern LIKE '%even'")
def _(spark, d):
    rep = P.error_report(_errors(spark, d))
    return P.skipped_known(rep, rep.filter("pattern like '%even'"))


view("cont", """
SELECT file, line_no, last_value(CASE WHEN k % 3 = 0 THEN ts END IGNORE NULLS) OVER w AS ts, last_value(CASE WHEN k % 3 = 0 THEN line_no END IGNORE NULLS) OVER w AS entry, device
FROM lines WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING)""")


def _untimed(spark, d):
    return lines(spark, d).withColumn("ts", F.when(F.col("k") % 3 == 0, F.col("ts")))


@check("win_fill_ts", "SELECT line_no, ts, entry FROM cont")
def _(spark, d):
    return P.fill_ts(_untimed(spark, d), chunk=1000).select("line_no", "ts", "entry")


@check("win_merge_timeline", """
SELECT c.device, c.file, entry, c.ts, cast(sum(length(l.line)) + count(*) - 1 AS bigint) AS n FROM cont c JOIN lines l USING (file, line_no) WHERE c.ts IS NOT NULL GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    return P.merge_timeline(_untimed(spark, d)).select("device", "file", "entry", "ts", F.length("text").cast("bigint").alias("n"))


@check("top_grep_context", """
SELECT l.line_no, m.match_no, (SELECT count(*) FROM lines WHERE k = 42) AS total_matches FROM (SELECT file, line_no AS match_no FROM lines WHERE k = 42
ORDER BY file, line_no LIMIT 20) m JOIN lines l ON l.file = m.file AND l.line_no BETWEEN match_no - 3 AND match_no + 3""")
def _(spark, d):
    return P.grep_context(lines(spark, d), "retry x42 END").select("line_no", "match_no", "total_matches")


@check("log_version_events", "SELECT device_id AS device, epoch_us(ts) // 1000 AS ts, version FROM ev")
def _(spark, d):
    rows = ev(spark, d).select(F.col("device_id").alias("device"), ms("ts").alias("ts"), F.concat(F.lit("current Version: "), "version").alias("line"))
    return P.version_events(rows)


@check("log_evidence_lines", """
SELECT event_id, CASE WHEN k % 2 = 0 THEN 'cam.rate,mode' ELSE 'cam.rate' END AS keys FROM ev WHERE k % 3 = 0""")
def _(spark, d):
    rows = ev(spark, d).withColumn("line", F.when(F.col("k") % 3 == 0, F.when(F.col("k") % 2 == 0, "cam.rate = 5, mode: x").otherwise("cam.rate=5")).otherwise(
        F.when(F.col("k") % 2 == 0, "mode = 3").otherwise("no xcam.rate here")))
    return P.evidence_lines(rows, ["cam.rate", "mode"], ["mode"]).select("event_id", F.array_join("keys", ",").alias("keys"))


@check("log_span", """
SELECT device, cast(day AS varchar) AS day, min(ts) first_ts, arg_min(service, ts) first_service, max(ts) last_ts, arg_max(service, ts) last_service FROM lines GROUP BY 1, 2""")
def _(spark, d):
    from tripline.plans.boots import log_span

    return log_span(lines(spark, d)).withColumn("day", F.col("day").cast("string"))


@check("log_has_detailed", """
SELECT device, cast(day AS varchar) AS day, bool_or(NOT critical AND service NOT IN ('view', 'click')) detailed FROM lines GROUP BY 1, 2""")
def _(spark, d):
    from tripline.plans.boots import has_detailed

    return has_detailed(lines(spark, d), ("view", "click")).withColumn("day", F.col("day").cast("string"))


# ── metric families ──


@check("kpi_power_ons", """
SELECT device, anchor AS ts FROM (WITH RECURSIVE c AS (SELECT DISTINCT device, t - (k % 60) * 1000 AS x FROM hit WHERE hkey = 'ndc_system_uptime'),
  seq AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY x) r FROM c), f AS (SELECT device, r, x, x AS anchor, TRUE AS fresh FROM seq WHERE r = 1
  UNION ALL SELECT s.device, s.r, s.x, CASE WHEN s.x - f.anchor > 5000 THEN s.x ELSE f.anchor END, s.x - f.anchor > 5000 FROM f JOIN seq s ON s.device = f.device AND s.r = f.r + 1)
  SELECT * FROM f) WHERE fresh""")
def _(spark, d):
    return M.power_ons(hits(spark, d)).select("device", "ts")


view("pwr", """
SELECT device, anchor AS p, row_number() OVER (PARTITION BY device ORDER BY anchor) seg FROM (WITH RECURSIVE c AS (SELECT DISTINCT device, t - (k % 60) * 1000 AS x FROM hit
  WHERE hkey = 'ndc_system_uptime'), seq AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY x) r FROM c), f AS (SELECT device, r, x, x AS anchor, TRUE AS fresh FROM seq WHERE r = 1
  UNION ALL SELECT s.device, s.r, s.x, CASE WHEN s.x - f.anchor > 5000 THEN s.x ELSE f.anchor END, s.x - f.anchor > 5000 FROM f JOIN seq s ON s.device = f.device AND s.r = f.r + 1)
  SELECT * FROM f) WHERE fresh""")
view("hunit", """
SELECT h.*, p, CASE WHEN EXISTS (SELECT 1 FROM pwr x WHERE x.device = h.device) THEN 'p' || seg ELSE 'b' || n END AS unit FROM (
  SELECT h.*, p, seg FROM hit h ASOF LEFT JOIN pwr ON h.device = pwr.device AND h.t >= pwr.p) h
  LEFT JOIN hboot b ON h.device = b.device AND h.t >= b.s AND (b.e IS NULL OR h.t < b.e)""")
view("hreason", """
SELECT device, unit, arg_min(CASE k % 3 WHEN 0 THEN 'A_LOWPOWER' WHEN 1 THEN 'A_CYCLIC' ELSE 'A_WATCHDOG' END, t) AS why FROM hunit WHERE hkey = 'prev_shutdown' AND unit IS NOT NULL GROUP BY 1, 2""")


def _units(spark, d):
    h = hits(spark, d)
    b = boots(spark, d, h)
    p = settle(M.power_ons(h))
    u = settle(M.with_units(h, p, b))
    return h, b, p, u


@check("kpi_units", "SELECT device, hkey AS key, t AS ts, unit FROM hunit")
def _(spark, d):
    return _units(spark, d)[3].select("device", "key", "ts", "unit")


@check("kpi_unit_reasons", "SELECT device, unit, why AS reasons FROM hreason")
def _(spark, d):
    return M.unit_reasons(_units(spark, d)[3])


def _shape(df):
    return df.select("device", "metric", "ts", F.round("value", 6).alias("value"))


@check("kpi_counts", """
SELECT device, m AS metric, min(t) AS ts, 1.0 AS value FROM (
  SELECT device, 'alerts_unique' m, t, cast(sess AS varchar) i FROM hit WHERE hkey = 'upload_state' UNION ALL SELECT device, 'alerts_cards', t, cast(sess AS varchar) FROM hit WHERE hkey = 'eventdata_ok'
  UNION ALL SELECT device, 'crash_cam' || cam, t, cast(t // 1000 AS varchar) FROM hit WHERE hkey = 'cam_crash') GROUP BY device, m, i
UNION ALL SELECT device, CASE hkey WHEN 'eventdata_call' THEN 'alerts_ed_calls' WHEN 'videolist_failed' THEN 'rt_videolist_n' WHEN 'health_post_failed' THEN 'rt_status_n'
  WHEN 'hc_call' THEN 'hc_attempted' WHEN 'hc_ok' THEN 'hc_success' WHEN 'retry_details' THEN CASE WHEN k % 2 = 0 THEN 'rt_eventdata_n' ELSE 'rt_obs_n' END ELSE 'rt_video_n' END, t,
  CASE WHEN hkey = 'vod_exhausted' THEN -1 ELSE 1 END FROM hit WHERE hkey IN ('eventdata_call', 'videolist_failed', 'health_post_failed', 'hc_call', 'hc_ok', 'retry_details', 'vod_attempt_failed', 'vod_exhausted')""")
def _(spark, d):
    return _shape(M.counts(hits(spark, d)))


def _pair(metric: str, start: str, end: str, pair: str, agg: str) -> str:
    return f"""SELECT device, '{metric}' AS metric, e AS ts, (e - {agg}(s)) / 1000 AS value, {agg}(s) AS s FROM (SELECT a.device, a.t s, b.t e, {pair} p FROM (SELECT * FROM hit WHERE hkey = '{start}') a
  ASOF JOIN (SELECT * FROM hit WHERE hkey = '{end}') b ON a.device = b.device AND {pair} = {pair.replace('a.', 'b.')} AND a.t <= b.t) GROUP BY device, e, p"""


view("pairsall", " UNION ALL ".join([
    _pair("down_cam_crash", "cam_crash", "record_start", "a.cam", "min"), _pair("down_lte_disconnect", "conn_exit", "data_connected", "a.hkey || 'x'", "min").replace("b.hkey || 'x'", "a.hkey || 'x'"),
    _pair("rt_eventdata_s", "eventdata_fail", "eventdata_ok", "a.sess", "min"), _pair("rt_obs_s", "obs_fail", "obs_uploaded", "a.tid", "min"),
    _pair("rt_videolist_s", "videolist_failed", "videolist_ok", "(a.k * 0)", "min"), _pair("rt_status_s", "health_post_failed", "health_ok", "(a.k * 0)", "min"),
    _pair("hc_upload_s", "hc_attempt", "hc_ok", "a.tid", "max")]))


@check("kpi_pairs", """
SELECT device, metric, ts, round(value, 6) AS value FROM (SELECT z.*, y.seg seg_e FROM (SELECT w.*, x.seg seg_s FROM pairsall w ASOF LEFT JOIN pwr x ON w.device = x.device AND w.s >= x.p) z
ASOF LEFT JOIN pwr y ON z.device = y.device AND z.ts >= y.p) WHERE metric <> 'down_lte_disconnect' OR seg_s IS NOT DISTINCT FROM seg_e""")
def _(spark, d):
    h = hits(spark, d)
    return _shape(M.pairs(h, settle(M.power_ons(h))))


@check("kpi_since_power_on", """
SELECT device, CASE hkey WHEN 'pm_start' THEN 'wdt_pm_start' WHEN 'bt_ignition_on' THEN 'dl_ign' ELSE hkey END AS metric, ts, round((x - p) / 1000, 6) AS value FROM (
  SELECT h.device, h.unit, hkey, p, min(t) ts, arg_min(CASE WHEN hkey = 'first_frame' THEN t + k * 100 ELSE t END, t) x, min(why) why FROM hunit h LEFT JOIN hreason r ON h.device = r.device AND h.unit = r.unit
  WHERE h.unit LIKE 'p%' AND hkey IN ('svc_start', 'first_frame', 'bt_ignition_on', 'pm_start') GROUP BY 1, 2, 3, 4) WHERE x - p BETWEEN 0 AND 900000 AND (hkey <> 'pm_start' OR why LIKE '%WATCHDOG%')""")
def _(spark, d):
    _, _, _, u = _units(spark, d)
    return _shape(M.since_power_on(u, M.unit_reasons(u)))


@check("kpi_first_values", """
SELECT device, m AS metric, min(t) AS ts, arg_min(v, t) AS value FROM (SELECT h.device, h.unit, t, cast(CASE WHEN hkey = 'gps_ttff' THEN k ELSE k % 60 END AS double) v,
  CASE WHEN hkey = 'ndc_system_uptime' THEN 'system_uptime' WHEN why LIKE '%LOWPOWER%' THEN 'gps_ttff_lpw' WHEN why LIKE '%CYCLIC%' THEN 'gps_ttff_cyclic' END m
  FROM hunit h LEFT JOIN hreason r ON h.device = r.device AND h.unit = r.unit WHERE hkey IN ('ndc_system_uptime', 'gps_ttff') AND h.unit IS NOT NULL) WHERE m IS NOT NULL GROUP BY device, unit, m""")
def _(spark, d):
    _, _, _, u = _units(spark, d)
    return _shape(M.first_values(u, M.unit_reasons(u)))


@check("kpi_after_ignition", """
SELECT device, 'dl_adv' AS metric, min(t) AS ts, round((min(t) - o) / 1000, 6) AS value FROM hunit h JOIN (SELECT device, unit, min(t) o FROM hunit WHERE hkey = 'bt_ignition_on' AND unit IS NOT NULL
GROUP BY 1, 2) i USING (device, unit) WHERE hkey = 'driver_adv_start' AND t >= o GROUP BY device, unit, o HAVING min(t) - o <= 300000""")
def _(spark, d):
    return _shape(M.after_ignition(_units(spark, d)[3]))


@check("kpi_simple_values", """
SELECT device, m AS metric, t AS ts, round(v, 6) AS value FROM (SELECT device, t, unnest([{'m': 'obs_hd_max', 'v': cast(k AS double)}, {'m': 'emmc_obs', 'v': k}, {'m': 'emmc_hours', 'v': (k + 1) / 60},
  {'m': 'emmc_cam0', 'v': k + k + 1}, {'m': 'pv_ld_cam0', 'v': 100.0 * 1.048576 / (k + 1)}, {'m': 'pv_hd_cam0', 'v': CASE WHEN k > 0 THEN (k * 10 + 0.5) * 1.048576 / k END}], recursive := TRUE)
  FROM hit WHERE hkey = 'storage_info') WHERE v IS NOT NULL""")
def _(spark, d):
    return _shape(M.simple_values(hits(spark, d)))


@check("kpi_files", """
SELECT device, 'hd_size_cam' || c AS metric, max(t) AS ts, arg_max(7000 + k * 1000, t) / 1e6 AS value FROM (SELECT *, k % 3 c FROM hit WHERE hkey = 'pushed_file') GROUP BY device, c, sess
HAVING arg_max(7000 + k * 1000, t) >= 10000""")
def _(spark, d):
    return _shape(M.files(hits(spark, d)))


@check("kpi_frame_rates", """
SELECT device, p || c AS metric, min(t) AS ts, round(sum(100 + k) / (count(*) * 5), 6) AS value FROM (SELECT *, k % 2 c FROM hit WHERE hkey = 'frame_count'), (VALUES ('hd_fps_cam'), ('ld_fps_cam')) v(p)
GROUP BY device, p, c, t // 600000""")
def _(spark, d):
    return _shape(M.frame_rates(hits(spark, d)))


@check("agg_bucket_sum", """
SELECT device, cast(k % 2 AS varchar) AS cam, t // 600000 AS bucket, min(t) AS ts, cast(sum(100 + k) AS double) AS total, count(*) AS n FROM hit WHERE hkey = 'frame_count' GROUP BY 1, 2, 3""")
def _(spark, d):
    return M.bucket_sum(hits(spark, d))


@check("kpi_storage_root", """
SELECT a.device, 'root_size' AS metric, a.t AS ts, round((a.k * 1000000.0 + b.k * 1048576.0) / 1e9, 6) AS value FROM (SELECT * FROM hit WHERE hkey = 'disk_free') a
ASOF JOIN (SELECT * FROM hit WHERE hkey = 'disk_used') b ON a.device = b.device AND a.t >= b.t WHERE a.t - b.t <= 900000""")
def _(spark, d):
    return _shape(M.storage_root(hits(spark, d)))


@check("kpi_write_amplification", """
SELECT device, CASE r WHEN 1 THEN 'waf_int' ELSE 'waf_ext' END AS metric, t AS ts, round(v, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY device, s ORDER BY t) r FROM (
  SELECT *, cast('1.' || k AS double) v, sum(f) OVER (PARTITION BY device ORDER BY t) s FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY device ORDER BY t) <= 5000 THEN 0 ELSE 1 END f
  FROM hit WHERE hkey = 'waf'))) WHERE r <= 2""")
def _(spark, d):
    return _shape(M.write_amplification(hits(spark, d)))


@check("kpi_crash_share", """
SELECT device, 'crash_cam' || c || '_pct' AS metric, s AS ts, CASE WHEN EXISTS (SELECT 1 FROM hit h WHERE h.hkey = 'cam_crash' AND h.device = b.device AND h.k % 9 = c AND h.t >= b.s AND (b.e IS NULL OR h.t < b.e))
THEN 1.0 ELSE 0.0 END AS value FROM hboot b, range(9) r(c)""")
def _(spark, d):
    h = hits(spark, d)
    return _shape(M.crash_share(h, boots(spark, d, h)))


view("alist", """
SELECT a.device, a.t, a.k, CASE WHEN b.t - a.t <= 2000 THEN b.sess END AS session, CASE WHEN b.t - a.t <= 2000 THEN CASE b.hkey WHEN 'upload_state' THEN 'UPLOAD' ELSE 'DELETE' END END AS state
FROM (SELECT * FROM hit WHERE hkey = 'commn_set') a ASOF LEFT JOIN (SELECT * FROM hit WHERE hkey IN ('upload_state', 'delete_state')) b ON a.device = b.device AND a.t <= b.t""")


@check("kpi_alert_counts", """
SELECT device, m AS metric, t AS ts, 2.0 AS value FROM (SELECT *, unnest(['alerts_detected', CASE state WHEN 'UPLOAD' THEN 'alerts_uploaded' WHEN 'DELETE' THEN 'alerts_not_uploaded' END]) m FROM alist
WHERE k % 20 <> 0) WHERE m IS NOT NULL""")
def _(spark, d):
    return _shape(M.alert_counts(M.alert_lists(hits(spark, d))))


view("akeys", "SELECT DISTINCT device, session FROM alist WHERE k % 20 <> 0 AND session IS NOT NULL UNION SELECT DISTINCT device, sess FROM hit WHERE hkey = 'eventdata_ok'")


@check("kpi_alert_videos", """
SELECT device, 'alerts_video_cam' || cam AS metric, min(t) AS ts, 1.0 AS value FROM hit WHERE hkey = 'video_ok' AND (device, sess) IN (SELECT (device, session) FROM akeys) GROUP BY device, cam, sess""")
def _(spark, d):
    h = hits(spark, d)
    return _shape(M.alert_videos(h, M.alert_keys(h, M.alert_lists(h))))


@check("kpi_code_counts", "SELECT device, c AS code, count(*) AS n FROM (SELECT device, unnest(['a.' || (k % 3), 'b']) c FROM alist WHERE k % 20 <> 0) GROUP BY 1, 2")
def _(spark, d):
    return M.code_counts(M.alert_lists(hits(spark, d)))


@check("kpi_event_codes", """
SELECT code, cast(sum(n) AS bigint) alerts, count(*) devices, round(quantile_cont(n, 0.9), 6) p90 FROM (SELECT device, c AS code, count(*) AS n FROM (
  SELECT device, unnest(['a.' || (k % 3), 'b']) c FROM alist WHERE k % 20 <> 0) GROUP BY 1, 2) GROUP BY 1""")
def _(spark, d):
    return M.event_codes(M.code_counts(M.alert_lists(hits(spark, d)))).withColumn("p90", F.round("p90", 6))


view("scall", """
SELECT device, t, s AS session FROM (SELECT *, last_value(CASE WHEN hkey = 'eventdata_summary' THEN sess END IGNORE NULLS) OVER (PARTITION BY device, tid ORDER BY t ROWS UNBOUNDED PRECEDING) s
FROM hit WHERE hkey IN ('eventdata_summary', 'eventdata_call')) WHERE hkey = 'eventdata_call' AND s IS NOT NULL""")


@check("kpi_session_calls", "SELECT device, t AS ts, session FROM scall")
def _(spark, d):
    return M.session_calls(hits(spark, d)).withColumn("session", F.regexp_extract("session", r"^trip(\d)", 1).cast("bigint"))


@check("kpi_alert_steps", """
SELECT device, m AS metric, ts, round(v, 6) AS value FROM (WITH det AS (SELECT device, session, min(t) d FROM (SELECT device, sess session, t FROM hit WHERE hkey = 'upload_state'
  UNION ALL SELECT device, session, t FROM alist WHERE k % 20 <> 0 AND session IS NOT NULL) WHERE (device, session) IN (SELECT (device, session) FROM akeys) GROUP BY 1, 2)
SELECT device, 'au_rec_start' m, d AS ts, (d - 1700000000000 - session) / 1000 v FROM det UNION ALL SELECT device, 'au_vision', d, (d - 1700000000000 - session) / 1000 FROM det
UNION ALL SELECT device, m, x, (x - d) / 1000 FROM (SELECT h.device, d, CASE hkey WHEN 'eventdata_ok' THEN 'au_api_ok' WHEN 'vod_req' THEN 'au_vod_req_cam' || cam ELSE 'au_video_ok_cam' || cam END m, min(t) x
  FROM hit h JOIN det ON h.device = det.device AND h.sess = det.session WHERE hkey IN ('eventdata_ok', 'vod_req', 'video_ok') GROUP BY h.device, session, d, 3) WHERE x >= d
UNION ALL SELECT device, 'au_api_trigger', x, (x - d) / 1000 FROM (SELECT c.device, d, min(t) x FROM scall c JOIN det ON c.device = det.device AND c.session = det.session GROUP BY c.device, c.session, d) WHERE x >= d
UNION ALL SELECT device, 'au_total', max(x), (max(x) - d) / 1000 FROM (SELECT h.device, session, d, cam, min(t) x FROM hit h JOIN det ON h.device = det.device AND h.sess = det.session
  WHERE hkey = 'video_ok' GROUP BY 1, 2, 3, 4) GROUP BY device, session, d HAVING max(x) >= d)""")
def _(spark, d):
    h = hits(spark, d)
    lists = M.alert_lists(h)
    return _shape(M.alert_steps(M.alert_sessions(h, lists, M.alert_keys(h, lists))))


@check("kpi_alert_session_rows", "SELECT device, session FROM akeys")
def _(spark, d):
    h = hits(spark, d)
    lists = M.alert_lists(h)
    keys = M.alert_keys(h, lists)
    rows = M.alert_session_rows(h, lists, keys, M.alert_sessions(h, lists, keys))
    return rows.select("device", F.regexp_extract("session", r"^trip(\d)", 1).cast("bigint").alias("session"))


@check("kpi_batch_steps", """
SELECT device, m AS metric, ts, round(v, 6) AS value FROM (WITH b AS (SELECT device, tid, bn, min(t) FILTER (WHERE hkey = 'obs_req') r, min(t) FILTER (WHERE hkey = 'obs_zip_start') zs, min(t) FILTER (WHERE hkey = 'obs_zip_done') zd,
  min(t) FILTER (WHERE hkey = 'obs_call') c, min(t) FILTER (WHERE hkey = 'obs_uploaded') u FROM (SELECT *, sum(CASE WHEN hkey = 'obs_req' THEN 1 ELSE 0 END) OVER (PARTITION BY device, tid ORDER BY t) bn FROM hit
  WHERE hkey IN ('obs_req', 'obs_zip_start', 'obs_zip_done', 'obs_call', 'obs_uploaded')) WHERE bn > 0 GROUP BY 1, 2, 3)
SELECT device, 'ou_files_added' m, zs AS ts, (zs - r) / 1000 v FROM b WHERE zs IS NOT NULL UNION ALL SELECT device, 'ou_zip', zd, (zd - zs) / 1000 FROM b WHERE zs IS NOT NULL AND zd IS NOT NULL
UNION ALL SELECT device, 'ou_upload_start', c, (c - r) / 1000 FROM b WHERE c IS NOT NULL UNION ALL SELECT device, 'ou_upload_ok', u, (u - r) / 1000 FROM b WHERE u IS NOT NULL
UNION ALL SELECT device, 'ou_received', t, k * 10 / 1000 FROM hit WHERE hkey = 'obs_req')""")
def _(spark, d):
    return _shape(M.batch_steps(hits(spark, d)))


@check("kpi_failed_uploads", """
SELECT device, 'hc_failed' AS metric, t AS ts, 1.0 AS value FROM (SELECT *, lead(hkey) OVER (PARTITION BY device, tid ORDER BY t) nx FROM hit WHERE hkey IN ('hc_call', 'hc_ok'))
WHERE hkey = 'hc_call' AND coalesce(nx, 'hc_call') = 'hc_call'""")
def _(spark, d):
    return _shape(M.failed_uploads(hits(spark, d)))


@check("kpi_cameras", "SELECT DISTINCT device, cast(CASE hkey WHEN 'pushed_file' THEN k % 3 WHEN 'frame_count' THEN k % 2 ELSE k % 9 END AS bigint) AS cam FROM hit WHERE hkey IN ('record_start', 'pushed_file', 'frame_count', 'cam_crash', 'vod_req', 'video_ok')")
def _(spark, d):
    return M.cameras(hits(spark, d)).withColumn("cam", F.col("cam").cast("bigint"))


@check("kpi_alive_points", """
SELECT device, ts FROM (SELECT device, t AS ts, lead(t) OVER (PARTITION BY device, svc ORDER BY t) - t g, svc FROM (SELECT *, CASE WHEN hkey IN ('ndc_system_uptime', 'first_frame', 'cam_crash', 'record_start', 'frame_count') THEN 'ndcentral'
  WHEN hkey IN ('prev_shutdown', 'pm_start') THEN 'power_mon' WHEN hkey IN ('svc_start', 'disk_free') THEN 'svc' WHEN hkey IN ('conn_exit', 'data_connected') THEN 'conn_mgr' END svc FROM hit) WHERE svc IS NOT NULL) WHERE g IS NULL OR g > 20000""")
def _(spark, d):
    return M.alive_points(registry_lines(spark, d)).select("device", "ts")


@check("kpi_outage_and_power")
def _(spark, d):
    h, b, p, u = _units(spark, d)
    h = settle(h.unionByName(M.alive_points(registry_lines(spark, d))))
    r = M.unit_reasons(u)
    parts = [M.cyclic_uptime(h), M.abrupt_power(u, h), M.update_outage(h), M.watchdog(u, p, r, h), M.low_latency(h), M.package_sizes(h, b), M.boot_start(b), M.bands(h, b)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@check("kpi_all_samples")
def _(spark, d):
    h = settle(hits(spark, d).unionByName(M.alive_points(registry_lines(spark, d))))
    b = boots(spark, d, h)
    return M.boot_samples(M.all_samples(h, b), h, b)


@check("kpi_boot_codes", """
SELECT device, boot_index, c AS code, count(*) AS n FROM (SELECT a.device, b.n AS boot_index, unnest(['a.' || (k % 3), 'b']) c FROM alist a JOIN hboot b ON a.device = b.device AND a.t >= b.s AND (b.e IS NULL OR a.t < b.e)
  WHERE k % 20 <> 0) GROUP BY 1, 2, 3""")
def _(spark, d):
    h = hits(spark, d)
    return M.boot_codes(M.alert_lists(h), boots(spark, d, h))


@check("kpi_fallback_boots", """
SELECT * FROM (WITH s AS (SELECT device_id AS device, epoch_us(ts) // 1000 AS t, CASE process_name WHEN 'error' THEN 'system_uptime' WHEN 'click' THEN 'boot_power_on' ELSE 'obs_hd_max' END AS metric FROM ev),
  lim AS (SELECT device, max(t) AS hi FROM s GROUP BY 1),
  b AS (SELECT device, n, s, e, false AS fallback FROM hboot WHERE device::INT % 3 <> 0 UNION ALL
        SELECT device, 0, -1, hi, true FROM lim WHERE device NOT IN (SELECT device FROM hboot WHERE device::INT % 3 <> 0))
SELECT s.device, b.n AS boot_index, metric, count(*) AS samples FROM s JOIN b ON s.device = b.device AND s.t >= b.s AND (b.e IS NULL OR s.t < b.e)
WHERE NOT (fallback AND metric IN ('system_uptime', 'boot_power_on')) GROUP BY 1, 2, 3)""")
def _(spark, d):
    # devices of every third id have no logged start: one boot up to their last event, without start-up times
    h = settle(hits(spark, d))
    kind = F.when(F.col("process_name") == "error", "system_uptime").when(F.col("process_name") == "click", "boot_power_on").otherwise("obs_hd_max")
    rows = ev(spark, d).select(F.col("device_id").alias("device"), kind.alias("metric"), ms("ts").alias("ts"), (F.col("event_id") + 1.0).alias("value"), F.lit(None).cast("string").alias("text"))
    ranges = rows.groupBy("device").agg(F.lit(None).cast("bigint").alias("lo"), F.max("ts").alias("hi"))
    b = M.fallback_boots(boots(spark, d, h).filter(F.col("device").cast("int") % 3 != 0), ranges)
    out = M.boot_samples(rows, h, b).filter("value <> 0")
    return out.groupBy("device", "boot_index", "metric").agg(F.count(F.lit(1)).alias("samples"))


view("samp", "SELECT device_id device, process_name AS metric, epoch_us(ts) // 1000 AS ts, value, event_id FROM ev")


def _registry(spark, d):
    rows = ev(spark, d).select(F.col("process_name").alias("metric")).distinct()
    agg = F.when(F.col("metric") == "click", "sum").when(F.col("metric") == "view", "mean").when(F.col("metric") == "error", "max").when(
        F.col("metric") == "signup", "last").otherwise("pct")
    return rows.select("metric", F.lit("s").alias("unit"), agg.alias("agg"))


view("dval", """
SELECT device, metric, CASE metric WHEN 'click' THEN 'sum' WHEN 'view' THEN 'mean' WHEN 'error' THEN 'max' WHEN 'signup' THEN 'last' ELSE 'pct' END agg,
  CASE metric WHEN 'click' THEN greatest(round(sum(value), 3), 0) WHEN 'view' THEN round(avg(value), 3) WHEN 'error' THEN max(value) WHEN 'signup' THEN arg_max(value, ts) ELSE round(100 * avg(value), 3) END AS value,
  count(*) samples FROM samp GROUP BY 1, 2""")


def _device_values(spark, d):
    s = ev(spark, d).select(F.col("device_id").alias("device"), F.col("process_name").alias("metric"), ms("ts").alias("ts"), "value", F.lit(None).cast("string").alias("text"))
    return M.metric_agg(s, _registry(spark, d), ["device"])


@check("agg_metric_agg", "SELECT device, metric, agg, cast(floor(value * 10 + 0.01) AS bigint) AS tenths, samples FROM dval")
def _(spark, d):
    return _device_values(spark, d).select("device", "metric", "agg", F.floor(F.col("value") * 10 + 0.01).alias("tenths"), "samples")


@check("agg_fleet_kpis", """
SELECT metric, agg, count(*) devices, round(quantile_cont(value, 0.9), 2) p90, round(CASE WHEN agg = 'sum' THEN sum(value) WHEN agg IN ('mean', 'pct') THEN sum(value * samples) / sum(samples) END, 1) total FROM dval GROUP BY 1, 2""")
def _(spark, d):
    out = M.fleet_kpis(_device_values(spark, d))
    return out.select("metric", "agg", "devices", F.round("p90", 2).alias("p90"), F.round("total", 1).alias("total"))


def _baselines(spark, d):
    rows = _registry(spark, d)
    m = F.col("metric")
    none = F.lit(None).cast("double")
    return rows.select("metric", F.when(m == "view", 200.0).alias("lo"), F.when(m.isin("view", "error"), 300.0).alias("hi"),
                       F.when(m == "signup", 250.0).alias("expect"), F.when(m == "signup", 0.5).otherwise(none).alias("low_factor"),
                       F.when(m == "signup", 1.5).otherwise(none).alias("high_factor"))


view("chk", """
SELECT device, metric, value, CASE metric WHEN 'view' THEN value < 200 OR value > 300 WHEN 'error' THEN value > 300 WHEN 'signup' THEN value < 125 OR value > 375 ELSE FALSE END outside,
  CASE metric WHEN 'view' THEN CASE WHEN value > 300 THEN (value - 300) / 300 WHEN value < 200 THEN (200 - value) / 200 ELSE 0 END WHEN 'error' THEN greatest((value - 300) / 300, 0)
  WHEN 'signup' THEN CASE WHEN value < 125 OR value > 375 THEN abs(value - 250) / 250 ELSE 0 END ELSE 0 END off_by FROM dval""")


@check("kpi_check_baselines", "SELECT device, metric, outside, round(off_by, 3) AS off_by FROM chk")
def _(spark, d):
    out = M.check_baselines(_device_values(spark, d), _baselines(spark, d))
    return out.select("device", "metric", "outside", F.round("off_by", 3).alias("off_by"))


@check("agg_kpi_outliers", "SELECT metric, count(*) AS outside_count, arg_max(device, off_by * 1e6 + value / 1e3) AS worst FROM chk WHERE outside GROUP BY 1")
def _(spark, d):
    from tripline.plans.findings import kpi_outliers

    dev = M.check_baselines(_device_values(spark, d), _baselines(spark, d))
    fleet = M.check_baselines(M.fleet_kpis(_device_values(spark, d)).withColumn("value", F.col("p90")), _baselines(spark, d))
    return kpi_outliers(dev, fleet).select("metric", "outside_count", F.get("devices", F.lit(0)).alias("worst"))


@check("agg_missed_per_device", "SELECT device, count(*) AS missed FROM chk WHERE outside GROUP BY 1")
def _(spark, d):
    from tripline.plans.findings import missed_per_device

    return missed_per_device(M.check_baselines(_device_values(spark, d), _baselines(spark, d)))


@check("txt_drive_events", """
SELECT DISTINCT device, kind, ts, k::BIGINT AS uptime, a, b, text FROM (
  SELECT device_id AS device, epoch_us(ts) // 1000 AS ts, k, event_id, unnest(CASE process_name WHEN 'error' THEN [{'kind': 'pm_start', 'a': NULL::BIGINT, 'b': NULL::BIGINT, 'text': NULL::VARCHAR}]
    WHEN 'click' THEN [{'kind': 'crank', 'a': k % 2, 'b': NULL, 'text': NULL}] WHEN 'view' THEN [{'kind': 'wakeup', 'a': k, 'b': k + 3, 'text': NULL}]
    WHEN 'purchase' THEN [{'kind': 'shutdown', 'a': NULL, 'b': NULL, 'text': CASE WHEN k % 3 = 0 THEN 'NA' ELSE 'low' || (k % 3) END}] ELSE [{'kind': 'record', 'a': NULL, 'b': NULL, 'text': NULL}] END, recursive := true) FROM ev)""")
def _(spark, d):
    """Power and drive lines rendered from events, one kind per process."""
    from tripline.plans.patterns import drive_events

    p, k = F.col("process_name"), F.col("k").cast("string")
    body = (F.when(p == "error", "STARTING POWER MONITOR").when(p == "click", F.concat(F.lit("crank voltage state changed "), (F.col("k") % 2).cast("string")))
            .when(p == "view", F.concat(F.lit("lowpower_wakeups "), k, F.lit(" < cfg.max_lowpower_wakeups "), (F.col("k") + 3).cast("string")))
            .when(p == "purchase", F.concat(F.lit("previous_shutdown_reason: "), F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit("low"), (F.col("k") % 3).cast("string")))))
            .otherwise(F.concat(F.lit('udid_node.index 1 udid_node.udid 12 "drive_start": 5, "drive_end": 9, '), k)))
    line = F.concat(ms("ts").cast("string"), F.lit(": "), k, F.lit(": TAG: I: 1: 1: "), body)
    service = F.when(p.isin("error", "click", "view", "purchase"), "power_mon").otherwise("time_sync")
    return drive_events(ev(spark, d).select(F.col("device_id").alias("device"), service.alias("service"), line.alias("line"))).select("device", "kind", "ts", "uptime", "a", "b", "text")


# ── metrics of rare lines, over hits made of events ──

view("ch", f"SELECT device_id AS device, {T0} + (epoch_us(ts) // 1000 - {T0}) // 600 AS t, process_name AS p, k, event_id FROM ev")


def _made_hits(spark, d, kinds):
    """Hits of the key and groups that ``kinds`` gives for a process."""
    e = ev(spark, d).withColumn("t", (F.lit(T0) + F.floor((ms("ts") - T0) / 600)).cast("bigint"))
    parts = [e.filter(F.col("process_name") == p).select(F.col("device_id").alias("device"), F.lit(key).alias("key"), F.col("t").alias("ts"),
                                                         F.create_map(*[x for n, v in groups.items() for x in (F.lit(n), v.cast("string"))]).alias("groups")) for p, (key, groups) in kinds.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _starts(spark, d, process):
    return _made_hits(spark, d, {process: ("start", {"k": F.col("k")})}).select("device", F.col("ts").alias("eff_start"), F.col("groups")["k"].cast("bigint").alias("k"))


@check("kpi_boot_start", "SELECT device, 'boot_power_on' AS metric, t AS ts, (k * 100 + 7) / 1000.0 AS value FROM ch WHERE p = 'view' AND k % 3 <> 0")
def _(spark, d):
    b = _starts(spark, d, "view").withColumns({"anchor": F.when(F.col("k") % 3 != 0, F.col("eff_start") - F.col("k") * 100), "svc_start": F.col("eff_start") + 7})
    return M.boot_start(b).select("device", "metric", "ts", "value")


@check("kpi_package_sizes", """
SELECT z.device, 'ota_size' AS metric, b.t AS ts, z.k * 1000 / 1e6 AS value
FROM (SELECT s.device, s.t, s.k, g.v FROM (SELECT * FROM ch WHERE p = 'error') s ASOF JOIN (SELECT device, t, max('v' || (k % 3)) AS v FROM ch WHERE p = 'click' GROUP BY 1, 2) g ON s.device = g.device AND s.t >= g.t
  WHERE s.t - g.t <= 300000) z
ASOF JOIN (SELECT DISTINCT device, t, 'v' || (k % 3) AS v FROM ch WHERE p = 'view') b ON z.device = b.device AND z.v = b.v AND z.t < b.t""")
def _(spark, d):
    h = _made_hits(spark, d, {"click": ("ota_target_check", {"version": F.concat(F.lit("v"), (F.col("k") % 3).cast("string"))}), "error": ("ota_size", {"bytes": F.col("k") * 1000})})
    b = _starts(spark, d, "view").withColumn("version", F.concat(F.lit("v"), (F.col("k") % 3).cast("string")))
    return M.package_sizes(h, b).select("device", "metric", "ts", "value")


@check("kpi_cyclic_uptime", """
SELECT s.device, 'cyclic_reboot_uptime' AS metric, s.t AS ts, u.s / 3600.0 AS value FROM (
  SELECT a.device, a.t FROM (SELECT * FROM ch WHERE p = 'error') a ASOF JOIN (SELECT DISTINCT device, t FROM ch WHERE p = 'click' AND k % 2 = 0) r ON a.device = r.device AND a.t <= r.t WHERE r.t - a.t <= 120000) s
ASOF JOIN (SELECT device, t, max(k * 100) AS s FROM ch WHERE p = 'view' GROUP BY 1, 2) u ON s.device = u.device AND s.t >= u.t WHERE s.t - u.t <= 60000""")
def _(spark, d):
    mode = F.when(F.col("k") % 2 == 0, "restarting").otherwise("shutdown")
    h = _made_hits(spark, d, {"error": ("soak_done", {"x": F.lit("")}), "click": ("shutdown_reason", {"reason": F.lit("A_CYCLIC_B"), "mode": mode}), "view": ("uptime_long", {"s": F.col("k") * 100})})
    return M.cyclic_uptime(h).select("device", "metric", "ts", "value")


@check("kpi_update_outage", """
SELECT device, 'down_lte_ota' AS metric, up AS ts, (up - greatest(CASE WHEN lost >= t THEN lost END, CASE WHEN quiet >= t THEN quiet END)) / 1000.0 AS value FROM (
  SELECT x.*, q.t AS quiet FROM (SELECT g.*, l.t AS lost FROM (
      SELECT s.device, s.t, u.t AS up FROM (SELECT device, t, lead(t) OVER (PARTITION BY device ORDER BY t) AS nxt FROM ch WHERE p = 'error') s
      ASOF JOIN (SELECT DISTINCT device, t FROM ch WHERE p = 'click') u ON s.device = u.device AND s.t < u.t WHERE u.t - s.t <= 1800000 AND (s.nxt IS NULL OR u.t <= s.nxt)) g
    ASOF LEFT JOIN (SELECT DISTINCT device, t FROM ch WHERE p = 'view') l ON g.device = l.device AND g.up > l.t) x
  ASOF LEFT JOIN (SELECT DISTINCT device, t FROM ch WHERE p = 'purchase') q ON x.device = q.device AND x.up > q.t) WHERE lost >= t OR quiet >= t""")
def _(spark, d):
    blank = {"x": F.lit("")}
    h = _made_hits(spark, d, {"error": ("updater_start", blank), "click": ("data_connected", blank), "view": ("conn_session_lost", blank), "purchase": ("alive", {"svc": F.lit("conn_mgr")})})
    return M.update_outage(h).select("device", "metric", "ts", "value")


@check("kpi_bands", """
SELECT device, 'bands' AS metric, max(t) AS ts, string_agg('B' || n, ',' ORDER BY n) AS text FROM (
  SELECT device, s, max(t) AS t, n FROM (SELECT e.device, b.s, max(e.t) OVER (PARTITION BY e.device, b.s) AS t, unnest(list_filter(range(64), lambda i: (e.k >> i::INT) % 2 = 1 AND i < 32)) + 1 + CASE WHEN e.k % 2 = 0 THEN 64 ELSE 0 END AS n
    FROM (SELECT * FROM ch WHERE p = 'error') e JOIN (SELECT device, t AS s, lead(t) OVER (PARTITION BY device ORDER BY t) AS e FROM (SELECT DISTINCT device, t FROM ch WHERE p = 'signup')) b
      ON e.device = b.device AND e.t >= b.s AND (b.e IS NULL OR e.t < b.e)) GROUP BY device, s, n) GROUP BY device, s""")
def _(spark, d):
    h = _made_hits(spark, d, {"error": ("band_mask", {"mask": F.lower(F.hex("k")), "range": F.when(F.col("k") % 2 == 0, "65_128").otherwise("1_64")})})
    starts = _starts(spark, d, "signup").select("device", "eff_start").distinct().withColumn("one", F.lit(1))
    b = settle(scan(starts, ["device"], "eff_start", lead={"end": "eff_start"}, total={"boot_index": "one"}))
    return M.bands(h, b).select("device", "metric", "ts", "text")


#: Units of the made hits: 100 s of compressed time, powered on at their beginning.
_UNIT = 100_000


def _in_units(h):
    n = F.floor(F.col("ts") / _UNIT).cast("bigint")
    return h.withColumns({"unit": F.concat(F.lit("p"), n.cast("string")), "anchor": n * _UNIT})


@check("kpi_abrupt_power", f"""
SELECT * FROM (WITH first AS (SELECT device, t // {_UNIT} AS u, min(t) % 4 AS r FROM ch WHERE p = 'error' GROUP BY 1, 2),
  at AS (SELECT f.device, f.u, f.r = 0 AS cap, f.u * {_UNIT} AS anchor, c.frame FROM first f JOIN (SELECT device, t // {_UNIT} AS u, min(t) AS frame FROM ch WHERE p = 'click' GROUP BY 1, 2) c ON c.device = f.device AND c.u = f.u WHERE f.r < 2)
SELECT a.device, CASE WHEN cap THEN 'down_abrupt_supercap' ELSE 'down_abrupt' END AS metric, frame AS ts, (frame - v.t) / 1000.0 AS value FROM at a ASOF JOIN (SELECT DISTINCT device, t FROM ch WHERE p = 'view') v ON a.device = v.device AND a.anchor > v.t
UNION ALL SELECT device, 'down_abrupt_reboot', frame, (frame - anchor) / 1000.0 FROM at)""".replace("at AS (", "cut AS (").replace("FROM at a ", "FROM cut a ").replace("FROM at)", "FROM cut)"))
def _(spark, d):
    t = F.floor((ms("ts") - T0) / 600) + T0
    reason = F.when(t % 4 == 0, "X_SUPERCAP_DISCHARGE").when(t % 4 == 1, "POWER_DOWN now").when(t % 4 == 2, "SOFT_REBOOT POWER_DOWN").otherwise("OTHER")
    u = _in_units(_made_hits(spark, d, {"error": ("sm_prev_shutdown", {"reason": reason}), "click": ("first_frame", {"x": F.lit("")})}))
    return M.abrupt_power(u, _made_hits(spark, d, {"view": ("alive", {"svc": F.lit("x")})})).select("device", "metric", "ts", "value")


@check("kpi_watchdog", f"""
SELECT * FROM (WITH pw AS (SELECT device, t // {_UNIT} AS u, min(t) AS t FROM ch WHERE p = 'signup' GROUP BY 1, 2 HAVING u % 2 = 0),
  pm AS (SELECT device, t // {_UNIT} AS u, min(t) AS started FROM ch WHERE p = 'error' GROUP BY 1, 2)
SELECT device, 'wdt_resets' AS metric, t AS ts, 1.0 AS value FROM pw
UNION ALL SELECT x.device, 'wdt_reboot_time', started, (started - v.t) / 1000.0 FROM (SELECT pw.device, pw.t, pm.started FROM pw JOIN pm ON pw.device = pm.device AND pw.u = pm.u) x
  ASOF JOIN (SELECT DISTINCT device, t FROM ch WHERE p = 'view') v ON x.device = v.device AND x.t > v.t)""")
def _(spark, d):
    on = _in_units(_made_hits(spark, d, {"signup": ("on", {"x": F.lit("")})}))
    powers = settle(on.groupBy("device", F.floor(F.col("ts") / _UNIT).cast("bigint").alias("segment")).agg(F.min("ts").alias("ts")))
    reasons = powers.select("device", F.concat(F.lit("p"), F.col("segment").cast("string")).alias("unit"), F.when(F.col("segment") % 2 == 0, "A_WATCHDOG").otherwise("NONE").alias("reasons"))
    units = _in_units(_made_hits(spark, d, {"error": ("pm_start", {"x": F.lit("")})}))
    return M.watchdog(units, powers, reasons, _made_hits(spark, d, {"view": ("alive", {"svc": F.lit("x")})})).select("device", "metric", "ts", "value")
