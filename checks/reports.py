"""Boots, states, drives, API calls, configuration, verdicts, findings, comparison, graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, view
from checks.timelines import H, boots as signup_boots, evm
from checks.views import ev, table
from tripline.operators.asof import assign_interval
from tripline.plans import boots as B
from tripline.plans import config as C
from tripline.plans import patterns as P
from tripline.session import settle

def fast(spark, d):
    """Events 600 times faster, as (device, kind, ts, k)."""
    from checks.devicelogs import T0

    e = evm(spark, d)
    return e.select(F.col("device_id").alias("device"), F.col("process_name").alias("kind"), (F.lit(T0) + F.floor((F.col("t") - T0) / 600)).alias("ts"),
                    "k", "event_id", "code_aux", "version")


view("fast", "SELECT device, t AS ts, h.k, h.event_id, process_name AS kind, code_aux, version FROM hit h JOIN ev USING (event_id)")

# ── boots ──


def records(spark, d):
    r = fast(spark, d).filter("kind = 'signup'")
    ds, de = F.col("ts") - F.col("k") * 2000, F.col("ts") - F.col("k") * 1000
    return r.select("device", (F.col("event_id") % 900).alias("udid"), F.col("ts").alias("ts_start"), ds.alias("drive_start"), de.alias("drive_end"),
                    F.least(ds + 20_000, de).alias("rtc_jump_from"), F.greatest(de - 20_000, ds).alias("rtc_jump_to"))


view("recs", """
SELECT device, event_id % 900 AS udid, ts AS t, ts - k * 2000 AS ds, ts - k * 1000 AS de, least(ts - k * 2000 + 20000, ts - k * 1000) jf, greatest(ts - k * 1000 - 20000, ts - k * 2000) jt
FROM fast WHERE kind = 'signup'""")
view("rbm", """
SELECT *, lag(t) OVER w AS pt, CASE WHEN lead(ds) OVER w <= t THEN lead(ds) OVER w END AS ds2, CASE WHEN lead(ds) OVER w <= t THEN lead(udid) OVER w END AS u2
FROM recs WINDOW w AS (PARTITION BY device ORDER BY t, udid, ds)""")
view("rb0", """
SELECT device, CASE WHEN ds2 > coalesce(pt, ds) THEN ds2 ELSE t END AS s, CASE WHEN ds2 > coalesce(pt, ds) THEN 'drive_start' ELSE 'time_sync' END AS source, u2 AS udid, t AS seq FROM rbm
UNION ALL SELECT device, ds, 'drive_start', udid, 0 FROM rbm WHERE pt IS NULL AND ds < t""")
view("rb", """
SELECT *, lag(s) OVER (PARTITION BY device ORDER BY s) AS b, lead(s) OVER (PARTITION BY device ORDER BY s) AS e FROM (
  SELECT device, s, arg_max({'source': source, 'udid': udid}, seq) AS r FROM rb0 GROUP BY 1, 2)""")
view("rbs", """
SELECT device, s, e, r.source AS source, r.udid AS udid, CASE WHEN v < least(coalesce(e, 9e17), s + 180000) THEN v END AS svc FROM (
  SELECT x.*, f.ts AS v FROM (SELECT *, CASE WHEN r.source = 'drive_start' THEN s ELSE greatest(s - 60000, coalesce(b, 0) + 1) END AS lo FROM rb) x
  ASOF LEFT JOIN (SELECT DISTINCT device, ts FROM fast WHERE kind = 'error') f ON x.device = f.device AND x.lo <= f.ts)""")


def _boots(spark, d):
    return settle(B.boots_from_records(records(spark, d), fast(spark, d).filter("kind = 'error'").select("device", "ts")))


@check("win_boots_from_records", 'SELECT device, s AS start, e AS "end", source, udid, svc AS svc_start FROM rbs')
def _(spark, d):
    return _boots(spark, d).select("device", "start", "end", "source", "udid", "svc_start")


view("bt", """
SELECT device, row_number() OVER (PARTITION BY device ORDER BY s) AS n, s, e, svc FROM rbs UNION ALL SELECT device, 0, NULL, min(s), NULL FROM rbs GROUP BY 1""")
VERS = "SELECT device, ts, min(version || '-' || (k // 50)) AS v FROM fast WHERE kind = 'view' GROUP BY 1, 2"
view("vers", VERS)
view("btv", """
SELECT x.*, coalesce(CASE WHEN e IS NULL OR a.ts < e THEN a.v END, b.v) AS ver FROM (SELECT *, coalesce(s, -1) AS at_ FROM bt) x
ASOF LEFT JOIN vers a ON x.device = a.device AND x.at_ <= a.ts ASOF LEFT JOIN vers b ON x.device = b.device AND x.at_ > b.ts""")


def _table(spark, d):
    f = fast(spark, d)
    vers = f.filter("kind = 'view'").select("device", "ts", F.concat("version", F.lit("-"), F.floor(F.col("k") / 50).cast("string")).alias("version"))
    first = f.groupBy("device").agg((F.min("ts") + 600_000).alias("first_ts"))
    return B.boot_table(_boots(spark, d), vers, first)


@check("win_boot_table", """
SELECT device, n AS boot_index, s AS start, e AS "end", ver AS version, s IS NULL OR (svc IS NULL AND s < f) AS partial FROM btv JOIN (SELECT device, min(ts) + 600000 f FROM fast GROUP BY 1) USING (device)""")
def _(spark, d):
    return _table(spark, d).select("device", "boot_index", "start", "end", "version", "partial")


@check("win_boot_window", """
SELECT device, n AS boot_index, CASE WHEN s IS NOT NULL THEN s WHEN e IS NULL OR f < e THEN f END AS shown_start, coalesce(e, CASE WHEN s IS NULL OR l >= s THEN l END) AS shown_end
FROM btv JOIN (SELECT device, min(ts) f, max(ts) l FROM fast GROUP BY 1) USING (device)""")
def _(spark, d):
    span = fast(spark, d).groupBy("device").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return B.boot_window(_table(spark, d), span).select("device", "boot_index", "shown_start", "shown_end")


@check("win_boots_in_range", """
SELECT device, n AS boot_index FROM btv WHERE (s >= 1704069000000 OR e >= 1704069000000) AND (s IS NULL OR s < 1704070800000) AND ver IS NOT NULL AND ver LIKE '%-1'""")
def _(spark, d):
    t = _table(spark, d)
    vs = [r["version"] for r in t.select("version").distinct().collect() if r["version"] and r["version"].endswith("-1")]
    ends = t.select("device", "boot_index", F.col("end").alias("drive_ended"))
    return B.boots_in_range(t, 1_704_069_000_000, 1_704_070_800_000, ends, vs).select("device", "boot_index")


@check("win_effective_starts", """
SELECT device, s AS start, max(x - n) OVER (PARTITION BY device ORDER BY s ROWS UNBOUNDED PRECEDING) + n AS eff_start FROM (
  SELECT b.*, CASE WHEN ref - p.ts <= 120000 THEN p.ts ELSE s END AS x FROM (SELECT *, coalesce(svc, s + 1000) AS ref FROM bt WHERE s IS NOT NULL) b
  ASOF LEFT JOIN (SELECT DISTINCT device, ts FROM fast WHERE kind = 'click') p ON b.device = p.device AND b.ref >= p.ts)""")
def _(spark, d):
    power = fast(spark, d).filter("kind = 'click'").select("device", "ts").distinct()
    return B.effective_starts(_table(spark, d), power).select("device", "start", "eff_start")


@check("win_process_starts", """
SELECT device, service, no AS start_no, arg_min(ts, line_no) AS first_ts, arg_min(pid, line_no) AS pid, count(*) AS lines FROM (SELECT *, sum(new) OVER (PARTITION BY device, service ORDER BY line_no) no FROM (
  SELECT *, CASE WHEN lag(pid) OVER w IS NULL OR lag(pid) OVER w <> pid OR up < lag(up) OVER (PARTITION BY device, service, pid ORDER BY line_no) THEN 1 ELSE 0 END new FROM (
    SELECT device, service, ts, line_no, line_no // 500 AS pid, line_no % 700 AS up FROM lines) WINDOW w AS (PARTITION BY device, service ORDER BY line_no))) GROUP BY 1, 2, 3""")
def _(spark, d):
    from checks.views import lines

    # The message repeats the line number, so distinct messages are lines
    rows = lines(spark, d, spread=True).withColumn("line", F.concat(F.regexp_replace("line", r"^(\d{13}): (\d+): ", ""), F.lit(" "), F.col("line_no").cast("string")))
    rows = rows.withColumn("line", F.concat(F.col("ts").cast("string"), F.lit(": "), (F.col("line_no") % 700).cast("string"), F.lit(": "),
                                            F.regexp_replace("line", r"^[A-Z]+: ", "TAG: ")))
    out = B.process_starts(rows, "TAG")
    return out.select("device", "service", "start_no", "first_ts", "pid", F.col("messages").alias("lines"))


@check("win_fresh_starts", """
SELECT device, kind AS service, ts - k AS ts FROM fast JOIN (SELECT device, kind FROM (SELECT device, kind, count(*) c FROM fast WHERE k <= 60 GROUP BY 1, 2) JOIN (
  SELECT device, list_sort(list(c))[len(list(c)) // 2 + 1] m FROM (SELECT device, kind, count(*) c FROM fast WHERE k <= 60 GROUP BY 1, 2) GROUP BY 1) USING (device) WHERE c <= 3 * m) USING (device, kind) WHERE k <= 60""")
def _(spark, d):
    f = fast(spark, d)
    starts = f.select("device", F.col("kind").alias("service"), F.col("ts").alias("first_ts"), F.col("k").alias("uptime")).withColumn(
        "uptime", F.when(F.col("uptime") <= 60, F.col("uptime")))
    return B.fresh_starts(starts)


# ── states ──

view("shit", """
SELECT a.device_id device, b.n, 'd' || (k % 2) AS dim, process_name AS v, t FROM evm a JOIN boots b ON a.device_id = b.device_id AND a.t >= b.s AND (b.e IS NULL OR a.t < b.e)
WHERE process_name <> 'signup'""")
view("stl", """
SELECT device, n, dim, t AS s, coalesce(lead(t) OVER (PARTITION BY device, n, dim ORDER BY t, v), be) AS e, v FROM (SELECT *, lag(v) OVER (PARTITION BY device, n, dim ORDER BY t, v) p FROM (
  SELECT device, n, dim, v, t, be FROM (SELECT x.*, b.e AS be FROM (SELECT device, n, dim, v, t FROM shit WHERE NOT (dim = 'd1' AND v = 'click') UNION ALL
    SELECT device, n, dim, v, min(t) FROM shit WHERE dim = 'd1' AND v = 'click' GROUP BY 1, 2, 3, 4 UNION ALL SELECT device_id, n, 'd0', 'off', s FROM boots) x
    JOIN boots b ON x.device = b.device_id AND x.n = b.n))) WHERE p IS NULL OR p <> v""")


def _boot_frame(spark, d):
    return signup_boots(spark, d).select(F.col("device_id").alias("device"), F.col("n").alias("boot_index"), "start", "end")


def _timeline(spark, d):
    b = settle(_boot_frame(spark, d))
    rows = evm(spark, d).filter("process_name <> 'signup'").select(
        F.col("device_id").alias("device"), F.concat(F.lit("d"), (F.col("k") % 2).cast("string")).alias("dimension"), F.col("process_name").alias("value"), F.col("t").alias("ts"))
    hits = assign_interval(rows, b, ["device"], "ts", how="inner").select("device", "boot_index", "dimension", "value", "ts")
    return B.state_timeline(hits, b, {"d0": "off"}, {"d1": ["click"]})


@check("win_state_timeline", 'SELECT device, n AS boot_index, dim AS dimension, s AS start, e AS "end", v AS value FROM stl')
def _(spark, d):
    return _timeline(spark, d)


@check("win_state_summary", """
SELECT device, n AS boot_index, dim AS dimension, v AS value, round(ms / 60000, 1) AS minutes, round(ms * 100.0 / sum(ms) OVER (PARTITION BY device, n, dim), 1) AS pct FROM (
  SELECT device, n, dim, v, sum(e - s) AS ms FROM stl WHERE e IS NOT NULL GROUP BY 1, 2, 3, 4)""")
def _(spark, d):
    return B.state_summary(_timeline(spark, d))


@check("win_state_windows", """
SELECT a.device, a.n AS boot_index, greatest(a.s, b.s) AS start, least(a.e, b.e) AS "end" FROM (SELECT * FROM stl WHERE dim = 'd0' AND v = 'off' AND e IS NOT NULL) a
JOIN (SELECT * FROM stl WHERE dim = 'd1' AND v = 'view' AND e IS NOT NULL) b ON a.device = b.device AND a.n = b.n AND a.s < b.e AND b.s < a.e""")
def _(spark, d):
    return B.state_windows(settle(_timeline(spark, d)), {"d0": ["off"], "d1": ["view"]})


view("lw", """
SELECT device, n, CASE dim WHEN 'd0' THEN 'lte' ELSE 'wifi' END AS dim, s, e, CASE WHEN v IN ('off', 'click') THEN 'down' ELSE 'up' END AS v FROM stl WHERE e IS NOT NULL""")
view("lwc", "SELECT device, n, t, lead(t) OVER (PARTITION BY device, n ORDER BY t) AS nt FROM (SELECT device, n, s AS t FROM lw UNION SELECT device, n, e FROM lw)")
view("lwv", """
SELECT c.*, CASE WHEN l.v IS NULL THEN NULL WHEN l.v = 'up' AND coalesce(w.v, 'down') = 'up' THEN 'lte_wifi' WHEN l.v = 'up' THEN 'lte' WHEN coalesce(w.v, 'down') = 'up' THEN 'wifi' ELSE 'none' END AS v
FROM lwc c LEFT JOIN lw l ON l.dim = 'lte' AND l.device = c.device AND l.n = c.n AND c.t >= l.s AND c.t < l.e
LEFT JOIN lw w ON w.dim = 'wifi' AND w.device = c.device AND w.n = c.n AND c.t >= w.s AND c.t < w.e WHERE nt IS NOT NULL""")


@check("win_overlay", """
SELECT device, n AS boot_index, min(t) AS start, max(nt) AS "end", v AS value, 'link' AS dimension FROM (SELECT *, sum(f) OVER (PARTITION BY device, n ORDER BY t) g FROM (
  SELECT *, CASE WHEN lag(v) OVER w = v AND lag(nt) OVER w = t THEN 0 ELSE 1 END f FROM lwv WHERE v IS NOT NULL WINDOW w AS (PARTITION BY device, n ORDER BY t))) GROUP BY device, n, g, v""")
def _(spark, d):
    t = _timeline(spark, d).filter(F.col("end").isNotNull())
    t = t.withColumns({"dimension": F.when(F.col("dimension") == "d0", "lte").otherwise("wifi"),
                       "value": F.when(F.col("value").isin("off", "click"), "down").otherwise("up")})
    return B.derived_timeline(settle(t), "link")


# ── drives ──


def events(spark, d):
    f = fast(spark, d)
    none = F.lit(None).cast("bigint")
    kind = (F.when(F.col("kind") == "view", "session_created").when(F.col("kind") == "purchase", "session_available")
            .when(F.col("kind") == "click", F.when(F.col("k") % 2 == 0, "pm_start").otherwise("wakeup"))
            .when(F.col("kind") == "error", F.when(F.col("k") % 2 == 0, "pm_stop").otherwise("shutdown")).otherwise("crank"))
    return f.select("device", kind.alias("kind"), "ts", F.col("k").alias("uptime"), (F.col("k") % 3).alias("a"), none.alias("b"),
                    F.concat(F.lit("R"), (F.col("k") % 4).cast("string")).alias("text"))


view("dev", """
SELECT device, ts, k, k % 3 AS a, CASE kind WHEN 'view' THEN 'session_created' WHEN 'purchase' THEN 'session_available' WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'pm_start' ELSE 'wakeup' END
  WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'pm_stop' ELSE 'shutdown' END ELSE 'crank' END AS kind FROM fast""")


def _drives(spark, d):
    return B.drive_metrics(records(spark, d), events(spark, d))


def _nearest(kind: str, at: str, alias: str) -> str:
    return f"""(SELECT r.device, r.udid, r.ds, arg_min(e.ts, abs(e.ts - {at}) * 10 + CASE WHEN e.ts > {at} THEN 1 ELSE 0 END) AS {alias} FROM recs r
  JOIN dev e ON e.device = r.device AND e.kind = '{kind}' AND abs(e.ts - {at}) <= 30000 GROUP BY 1, 2, 3)"""


@check("win_drive_metrics", f"""
SELECT r.device, r.udid, r.ds AS drive_start, (r.de - r.ds) // 60000 AS duration_min,
  (SELECT count(*) FROM dev e WHERE e.device = r.device AND e.kind = 'session_created' AND e.ts BETWEEN r.ds AND r.jf) + (SELECT count(*) FROM dev e WHERE e.device = r.device AND e.kind = 'session_created' AND e.ts BETWEEN r.jt AND r.de) AS sessions_created,
  (SELECT count(*) FROM dev e WHERE e.device = r.device AND e.kind = 'session_available' AND e.ts BETWEEN r.ds AND r.jf) + (SELECT count(*) FROM dev e WHERE e.device = r.device AND e.kind = 'session_available' AND e.ts BETWEEN r.jt AND r.de) AS sessions_available,
  coalesce((SELECT arg_min(a, ts) FROM dev e WHERE e.device = r.device AND e.kind = 'wakeup' AND e.ts BETWEEN r.ds AND r.jf), 0) AS low_power_wakeup,
  p.pm_start, q.pm_stop, (SELECT max(ts) FROM dev e WHERE e.device = r.device AND e.kind = 'crank' AND e.a = 0 AND e.ts BETWEEN r.de - 950000 AND r.de) AS crank_low_at,
  count(*) OVER (PARTITION BY r.device, r.udid) > 1 AS repeated_udid
FROM recs r LEFT JOIN {_nearest('pm_start', 'r.ds', 'pm_start')} p USING (device, udid, ds) LEFT JOIN {_nearest('pm_stop', 'r.de', 'pm_stop')} q USING (device, udid, ds)""")
def _(spark, d):
    return _drives(spark, d).select("device", "udid", "drive_start", "duration_min", "sessions_created", "sessions_available", "low_power_wakeup",
                                    "pm_start", "pm_stop", "crank_low_at", "repeated_udid")


@check("win_run_durations", """
SELECT device, ts, least(u, x - ts + 60000) AS duration FROM (SELECT s.device, s.ts, max(l.ts) AS x, arg_max(l.k * 1000, l.ts) AS u FROM (
  SELECT device, ts, lead(ts) OVER (PARTITION BY device ORDER BY ts) AS nx FROM (SELECT DISTINCT device, ts FROM dev WHERE kind = 'pm_start')) s
  JOIN fast l ON l.device = s.device AND l.kind IN ('view', 'error') AND l.ts >= s.ts AND (nx IS NULL OR l.ts < nx) GROUP BY 1, 2)""")
def _(spark, d):
    f = fast(spark, d)
    ends = f.filter("kind in ('view', 'error')").select("device", "ts", (F.col("k") * 1000).alias("uptime"))
    return B.run_durations(events(spark, d).filter("kind = 'pm_start'"), ends)


def _boot_drive(spark, d):
    f = fast(spark, d)
    ends = f.filter("kind in ('view', 'error')").select("device", "ts", (F.col("k") * 10_000).alias("uptime"))
    b = settle(_table(spark, d))
    e = events(spark, d)
    drives = settle(B.drive_metrics(b.filter("udid is not null").select("device", *B._REC), e))
    return B.boot_drive(b, e, ends, drives)


@check("win_boot_drive", """
SELECT n.device, n AS boot_index, count(d.ts) FILTER (WHERE kind = 'pm_start') AS service_starts, count(d.ts) FILTER (WHERE kind = 'crank' AND a = 1) AS crank_ons,
  count(d.ts) FILTER (WHERE kind = 'wakeup') AS wakeup_lines, max(a) FILTER (WHERE kind = 'wakeup') AS max_wakeups FROM bt n
LEFT JOIN dev d ON d.device = n.device AND d.ts >= coalesce(n.s, 0) AND (n.e IS NULL OR d.ts < n.e) GROUP BY 1, 2""")
def _(spark, d):
    return _boot_drive(spark, d).select("device", "boot_index", "service_starts", "crank_ons", "wakeup_lines", "max_wakeups")


@check("agg_drive_rollup")
def _(spark, d):
    return B.drive_rollup(_boot_drive(spark, d))


@check("agg_shutdown_reasons", "SELECT device, 'R' || (k % 4) AS reason, count(*) AS times FROM dev WHERE kind = 'shutdown' GROUP BY 1, 2")
def _(spark, d):
    return B.shutdown_reasons(events(spark, d))


@check("win_boot_evidence", """
SELECT device, boot_index, n, line FROM (SELECT *, row_number() OVER w AS n, coalesce(sum(length(line)) OVER (PARTITION BY device, boot_index ORDER BY t, line_no, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM (
  SELECT b.device_id AS device, b.n AS boot_index, line, min(l.ts) AS t, min(line_no) AS line_no FROM lines l JOIN boots b ON l.device = b.device_id AND l.ts >= b.s AND (b.e IS NULL OR l.ts < b.e) AND l.ts < b.s + 36000000
  GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY device, boot_index ORDER BY t, line_no, line)) WHERE n <= 4 AND c < 150""")
def _(spark, d):
    from checks.views import lines

    return B.boot_evidence(lines(spark, d), settle(_boot_frame(spark, d)), 10 * H, 4, 150).select("device", "boot_index", F.col("n").cast("bigint").alias("n"), "line")


# ── API calls ──


@check("log_api_events", """
SELECT user_id, api, kind, source, outcome, reason FROM (SELECT user_id, event_id, CASE process_name WHEN 'click' THEN 7 WHEN 'view' THEN 19 WHEN 'signup' THEN 8 ELSE 1 END AS api,
  CASE WHEN process_name IN ('click', 'error') THEN 'call' ELSE 'result' END AS kind, CASE process_name WHEN 'click' THEN 'unifieduploader' WHEN 'error' THEN 'power_mon' WHEN 'view' THEN 'hc' WHEN 'signup' THEN 'hs' ELSE 'pm' END AS source,
  CASE process_name WHEN 'view' THEN CASE WHEN k % 3 = 0 THEN 'fail' WHEN k % 2 = 0 THEN 'ok' ELSE 'fail' END WHEN 'signup' THEN 'fail' WHEN 'purchase' THEN CASE WHEN k % 2 = 1 THEN 'ok' ELSE 'fail' END END AS outcome,
  CASE process_name WHEN 'view' THEN CASE WHEN k % 3 = 0 THEN 'curl 28 (timeout)' WHEN k % 2 = 1 THEN 'HTTP 500' END WHEN 'signup' THEN 'HTTP 404' WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'not reached (power_mon reached_cloud 0)' END END AS reason FROM ev)""")
def _(spark, d):
    e = evm(spark, d)
    k = F.col("k").cast("string")
    service = F.when(F.col("process_name").isin("click", "view"), "unifieduploader").when(F.col("process_name") == "signup", "health").otherwise("power_mon")
    line = (F.when(F.col("process_name") == "click", "Calling service: https://x/upload/logs")
            .when(F.col("process_name") == "view", F.concat(F.lit("curl_health: svc=u endpoint=https://x/upload/lla curl="), F.when(F.col("k") % 3 == 0, "28").otherwise("0"),
                                                            F.lit(" http="), F.when(F.col("k") % 2 == 0, "200").otherwise("500")))
            .when(F.col("process_name") == "error", "keepalive command :: x")
            .when(F.col("process_name") == "purchase", F.concat(F.lit("response_string :"), k, F.lit(": reached_cloud "), (F.col("k") % 2).cast("string")))
            .otherwise("newMessage: {'endpoint': 'https://x/upload/videolist', 'curl_code': 0, 'http_code': 404}"))
    rows = e.select(F.col("device_id").alias("device"), service.alias("service"), F.col("t").alias("ts"), line.alias("line"))
    return P.api_events(rows).select(F.col("device").cast("bigint").alias("user_id"), F.col("api").cast("bigint").alias("api"), "kind", "source", "outcome", "reason")


@check("win_unconfirmed_calls", """
SELECT device, ts FROM (SELECT *, lead(kind) OVER (PARTITION BY device ORDER BY ts) AS nk, (SELECT min(ts) FROM fast r WHERE r.kind = 'purchase' AND r.device = c.device AND r.ts >= c.ts) AS answer
FROM (SELECT * FROM (SELECT *, lag(kind) OVER w AS pk, lag(ts) OVER w AS pts FROM fast WHERE kind IN ('error', 'purchase') WINDOW w AS (PARTITION BY device ORDER BY ts))
WHERE kind = 'purchase' OR NOT coalesce(pk = 'error' AND ts - pts <= 1000, FALSE)) c) WHERE kind = 'error' AND coalesce(nk, 'error') = 'error' AND (answer IS NULL OR answer - ts > 120000)""")
def _(spark, d):
    f = fast(spark, d).filter("kind in ('error', 'purchase')")
    call = F.col("kind") == "error"
    rows = f.select("device", F.lit(1).alias("api"), "ts", F.when(call, "call").otherwise("result").alias("kind"), F.when(call, "power_mon").otherwise("pm").alias("source"))
    return P.unconfirmed_calls(settle(rows))


view("calls", "SELECT device_id device, code_aux boot_index, k % 3 AS api, epoch_us(ts) // 1000 AS t FROM ev WHERE type = 'INFO'")
view("gapst", """
SELECT device, boot_index, api, count(*) calls, count(g) gaps, cast(coalesce(sum(g), 0) AS bigint) gap_sum, min(g) gap_min, max(g) gap_max FROM (
  SELECT *, t - lag(t) OVER (PARTITION BY device, boot_index, api ORDER BY t) g FROM calls) GROUP BY 1, 2, 3""")


def _calls(spark, d):
    return evm(spark, d).filter("type = 'INFO'").select(F.col("device_id").alias("device"), F.col("code_aux").alias("boot_index"), (F.col("k") % 3).alias("api"), F.col("t").alias("ts"))


@check("agg_call_gaps", "SELECT * FROM gapst")
def _(spark, d):
    return B.call_gaps(_calls(spark, d))


@check("agg_merge_gaps", """
SELECT api, cast(sum(calls) AS bigint) calls, cast(sum(gaps) AS bigint) gaps, cast(sum(gap_sum) AS bigint) gap_sum, min(gap_min) gap_min, max(gap_max) gap_max, count(*) boots, count(DISTINCT device) devices FROM gapst GROUP BY 1""")
def _(spark, d):
    return B.merge_gaps(B.call_gaps(_calls(spark, d)))


view("ress", """
SELECT device_id device, code_aux boot_index, k % 3 AS api, CASE WHEN k % 5 < 2 THEN 'ok' WHEN k % 5 < 4 THEN 'fail' ELSE 'sent' END AS o, CASE WHEN k % 5 IN (2, 3) THEN 'why' || (k % 4) END AS why FROM ev""")


def _results(spark, d):
    m = F.col("k") % 5
    return ev(spark, d).select(F.col("device_id").alias("device"), F.col("code_aux").alias("boot_index"), (F.col("k") % 3).alias("api"),
                               F.when(m < 2, "ok").when(m < 4, "fail").otherwise("sent").alias("outcome"),
                               F.when(m.isin(2, 3), F.concat(F.lit("why"), (F.col("k") % 4).cast("string"))).alias("reason"))


@check("agg_result_counts", """
SELECT device, boot_index, api, count(*) FILTER (WHERE o = 'ok') ok, count(*) FILTER (WHERE o = 'fail') failed, count(*) FILTER (WHERE o = 'sent') unconfirmed, count(DISTINCT why) AS reasons FROM ress GROUP BY 1, 2, 3""")
def _(spark, d):
    return B.result_counts(_results(spark, d)).withColumn("reasons", F.size("reasons").cast("bigint"))


@check("agg_fleet_results", """
SELECT api, cast(sum(ok + failed) AS bigint) attempted, cast(sum(ok) AS bigint) successful, cast(sum(failed) AS bigint) failed, cast(sum(u) AS bigint) unconfirmed, count(*) devices_with_results,
  count(*) FILTER (WHERE failed >= 3 AND failed >= 0.1 * (ok + failed)) devices_failing, round(100.0 * sum(failed) / sum(ok + failed), 1) failed_pct, (SELECT string_agg(c || ' ' || why, ', ' ORDER BY c DESC, why) FROM (
  SELECT why, count(*) c FROM ress r WHERE r.api = x.api AND why IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)) AS top_reasons
FROM (SELECT device, api, count(*) FILTER (WHERE o = 'ok') ok, count(*) FILTER (WHERE o = 'fail') failed, count(*) FILTER (WHERE o = 'sent') u FROM ress GROUP BY 1, 2) x GROUP BY 1""")
def _(spark, d):
    per = B.result_counts(_results(spark, d), ["device", "api"]).withColumn("calls", F.col("ok") + F.col("failed"))
    return B.fleet_results(per)


@check("win_worst_gap", """
SELECT device, boot_index, arg_max(t, r * 1e15 - t) AS from_ts, arg_max(round(g, 1), r * 1e15 - t) AS gap_s FROM (SELECT c.*, g / iv AS r FROM (SELECT c.*, coalesce(s.iv, 3600) AS iv FROM (
  SELECT *, (lead(t) OVER (PARTITION BY device, boot_index ORDER BY t) - t) / 1000 AS g FROM calls) c ASOF LEFT JOIN (SELECT device_id AS device, t, 600 + k * 60 AS iv FROM evm WHERE type = 'ERROR') s
  ON c.device = s.device AND c.t >= s.t) c WHERE g IS NOT NULL) GROUP BY 1, 2""")
def _(spark, d):
    sets = evm(spark, d).filter("type = 'ERROR'").select(F.col("device_id").alias("device"), F.col("t").alias("ts"), (600 + F.col("k") * 60).alias("interval_s"))
    return B.worst_gap(_calls(spark, d).drop("api"), sets).select("device", "boot_index", "from_ts", "gap_s")


@check("win_enabled_from", """
SELECT device_id AS device, min(t) FILTER (WHERE k % 4 <> 0 AND (lo IS NULL OR t > lo)) AS enabled_from, arg_max(k % 4 <> 0, t) AS enabled FROM (
  SELECT *, max(CASE WHEN k % 4 = 0 THEN t END) OVER (PARTITION BY device_id) lo FROM evm WHERE process_name = 'click') GROUP BY 1""")
def _(spark, d):
    rows = evm(spark, d).filter("process_name = 'click'").select(F.col("device_id").alias("device"), F.col("t").alias("ts"), (F.col("k") % 4 != 0).alias("enabled"))
    return B.enabled_from(rows, ["device"])


# ── configuration ──


def conf(spark, d, pick, where=None):
    p = table(spark, d, "part")
    p = p if where is None else p.filter(where)
    return p.groupBy((F.col("p_partkey") % 40).alias("device"), F.col("p_type").alias("section"), F.col("p_brand").alias("key")).agg(
        pick("p_size").cast("string").alias("value"))


for _n, _a, _w in (("cloud", "max", "TRUE"), ("cdef", "min", "p_partkey % 5 <> 0"), ("clog", "max", "p_partkey % 7 = 0")):
    view(_n, f"SELECT p_partkey % 40 AS device, p_type AS section, p_brand AS key, cast({_a}(p_size) AS varchar) AS v FROM part WHERE {_w} GROUP BY 1, 2, 3")
view("covr", "SELECT DISTINCT p_partkey % 40 AS device, p_brand AS key FROM part WHERE p_partkey % 11 = 0")
view("cpln", "SELECT DISTINCT p_partkey % 40 AS device, p_brand AS key FROM part WHERE p_partkey % 3 = 0")
view("ccmp", """
SELECT device, section, key, c.v AS cloud, coalesce(l.v, CASE WHEN NOT ovr THEN f.v END) AS device_value, CASE WHEN l.v IS NOT NULL THEN 'log' WHEN ovr THEN 'overridden'
  WHEN f.v IS NOT NULL THEN CASE WHEN one AND (device, key) IN (SELECT (device, key) FROM cpln) THEN 'default_confirmed' ELSE 'default' END ELSE 'missing' END AS source FROM (
  SELECT c.*, one, one AND (device, key) IN (SELECT (device, key) FROM covr) AS ovr FROM cloud c JOIN (SELECT device, key, count(*) = 1 AS one FROM (SELECT device, section, key FROM cloud UNION SELECT device, section, key FROM cdef) GROUP BY 1, 2) USING (device, key)) c
LEFT JOIN cdef f USING (device, section, key) LEFT JOIN clog l USING (device, section, key)""")


def _compared(spark, d):
    p = table(spark, d, "part")
    keys = lambda m: p.filter(f"p_partkey % {m} = 0").select((F.col("p_partkey") % 40).alias("device"), F.col("p_brand").alias("key")).distinct()
    return C.compare_config(conf(spark, d, F.max), conf(spark, d, F.min, "p_partkey % 5 <> 0"), conf(spark, d, F.max, "p_partkey % 7 = 0"), keys(3), keys(11))


STATUS = "CASE WHEN device_value IS NULL THEN 'unknown' WHEN device_value = cloud THEN 'match' ELSE 'diff' END"


@check("join_compare_config", f"SELECT *, {STATUS} AS status FROM ccmp")
def _(spark, d):
    return _compared(spark, d)


@check("cfg_verdict", f"""
SELECT device, count(*) FILTER (WHERE s = 'match') matches, count(*) FILTER (WHERE s = 'diff') diffs, count(*) FILTER (WHERE s = 'unknown') unknowns,
  CASE WHEN count(*) FILTER (WHERE s = 'diff') > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE s = 'match') > 0 THEN 'PASS' ELSE 'UNVERIFIED' END AS verdict FROM (SELECT *, {STATUS} AS s FROM ccmp) GROUP BY 1""")
def _(spark, d):
    return C.config_verdict(_compared(spark, d))


@check("agg_config_summary", f"""
SELECT v AS verdict, count(*) AS devices FROM (SELECT device, CASE WHEN count(*) FILTER (WHERE s = 'diff') > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE s = 'match') > 0 THEN 'PASS' ELSE 'UNVERIFIED' END AS v
FROM (SELECT *, {STATUS} AS s FROM ccmp) WHERE device % 2 = 1 GROUP BY 1) GROUP BY 1""")
def _(spark, d):
    minutes = table(spark, d, "part").select((F.col("p_partkey") % 40).alias("device")).distinct().withColumn("minutes", F.col("device") % 2)
    return C.config_summary(C.config_verdict(_compared(spark, d)), minutes)


@check("agg_differing_keys", f"SELECT section, key, count(DISTINCT device) AS devices FROM (SELECT *, {STATUS} AS s FROM ccmp) WHERE s = 'diff' GROUP BY 1, 2")
def _(spark, d):
    return C.differing_keys(_compared(spark, d))


@check("src_config_json", "SELECT device, section, key, v AS value FROM cloud")
def _(spark, d):
    from tripline.sources.readers import config_json_rows

    rows = conf(spark, d, F.max).groupBy("device", "section").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("values"))
    docs = rows.groupBy("device").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("section").alias("sectionName"), "values")).alias("sections"))).alias("config"))
    bad = docs.withColumn("config", F.lit("{broken"))
    return config_json_rows(docs.unionByName(bad))


def _ini(spark, d, files=40):
    """Parts as INI text: ``files`` files, sections in key order; repeated keys keep their first value."""
    p = table(spark, d, "part").select(F.concat(F.lit("f"), (F.col("p_partkey") % files).cast("string")).alias("file"), "p_partkey", "p_type", "p_brand", "p_size")
    return p.select("file", F.explode(F.array(
        F.struct((F.col("p_partkey") * 4).alias("line_no"), F.concat(F.lit(" ["), "p_type", F.lit("]")).alias("line")),
        F.struct((F.col("p_partkey") * 4 + 1).alias("line_no"), F.lit("; note = 1").alias("line")),
        F.struct((F.col("p_partkey") * 4 + 2).alias("line_no"), F.concat("p_brand", F.lit(' = "'), F.col("p_size").cast("string"), F.lit('" ; old = 3')).alias("line")),
        F.struct((F.col("p_partkey") * 4 + 3).alias("line_no"), F.lit("no pair here").alias("line")))).alias("l")).select("file", "l.*")


INI = "SELECT 'f' || (p_partkey % 40) AS file, p_type AS section, p_brand AS key, cast(arg_min(p_size, p_partkey) AS varchar) AS value FROM part GROUP BY 1, 2, 3"


@check("src_ini", INI)
def _(spark, d):
    from tripline.sources.readers import ini_rows

    # The quotes around a value with a trailing comment go after the comment is cut
    return ini_rows(_ini(spark, d)).drop("raw")


@check("src_merge_ini", f"""
SELECT section, key, coalesce(max(CASE WHEN file = 'f1' THEN value END), max(CASE WHEN file = 'f0' THEN value END)) AS value FROM ({INI.replace('% 40', '% 2')}) GROUP BY 1, 2""")
def _(spark, d):
    from tripline.sources.readers import ini_rows, merge_ini

    rows = ini_rows(_ini(spark, d, 2))
    return merge_ini(rows.filter("file = 'f1'"), rows.filter("file = 'f0'"))


@check("src_features", """
SELECT p_type AS feature, p_brand AS section, 'size' AS key, cast(arg_min(p_size, p_partkey) AS varchar) AS expected FROM part GROUP BY 1, 2""")
def _(spark, d):
    from tripline.sources.readers import features_of, ini_rows

    rows = _ini(spark, d, 1).withColumn("line", F.regexp_replace("line", r'^(\S+) = "(\d+)".*$', '$1 = {"size": $2}'))
    return features_of(ini_rows(rows))


@check("src_state_rules", """
SELECT p_type AS dimension, p_brand AS value, 'svc' || p_size AS service, 'a | b ' || p_partkey AS pattern FROM part""")
def _(spark, d):
    from tripline.sources.readers import state_rules_of

    p = table(spark, d, "part")
    rows = p.select(F.lit("f").alias("file"), F.explode(F.array(
        F.struct((F.col("p_partkey") * 4).alias("line_no"), F.concat(F.lit("["), "p_type", F.lit("]")).alias("line")),
        F.struct((F.col("p_partkey") * 4 + 1).alias("line_no"), F.lit("default = idle").alias("line")),
        F.struct((F.col("p_partkey") * 4 + 2).alias("line_no"), F.concat("p_brand", F.lit(" = svc"), F.col("p_size").cast("string"), F.lit(" | a | b "),
                                                                        F.col("p_partkey").cast("string")).alias("line")))).alias("l")).select("file", "l.*")
    return state_rules_of(rows)[0]


# profiles: keys a service logged as not overridden, per boot
view("prof", "SELECT DISTINCT device_id device, code_aux boot_index, process_name service, 'k' || (k // 10) AS key FROM ev")
view("rcnt", """
SELECT service, key, n, starts FROM (SELECT service, key, count(*) n FROM prof GROUP BY 1, 2) JOIN (SELECT service, count(*) starts FROM (SELECT DISTINCT device, boot_index, service FROM prof) GROUP BY 1) USING (service)""")


def _profiles(spark, d):
    rows = ev(spark, d).select(F.col("device_id").alias("device"), F.col("code_aux").alias("boot_index"), F.col("process_name").alias("service"),
                               F.concat(F.lit("No value present for key k"), F.floor(F.col("k") / 10).cast("string"), F.lit(" in override dictionary")).alias("line"))
    return C.not_overridden(rows)


@check("cfg_not_overridden", "SELECT * FROM prof")
def _(spark, d):
    return _profiles(spark, d)


@check("cfg_reference_counts", "SELECT service, key, n, starts FROM rcnt")
def _(spark, d):
    return C.reference_counts(_profiles(spark, d))


@check("set_merge_counts", "SELECT service, key, cast(n * 2 AS bigint) AS n, cast(starts * 2 AS bigint) AS starts FROM rcnt")
def _(spark, d):
    c = C.reference_counts(_profiles(spark, d))
    return C.merge_counts(c, c)


view("kref", "SELECT service, key FROM rcnt WHERE n >= 0.3 * starts")


def _reference(spark, d):
    return C.reference_counts(_profiles(spark, d)).filter("n >= 0.3 * starts").select("service", "key")


@check("cfg_key_reference", "SELECT service, key FROM rcnt WHERE n >= 0.5 * starts")
def _(spark, d):
    return C.key_reference(C.reference_counts(_profiles(spark, d)))


@check("cfg_boot_overrides", """
SELECT DISTINCT device, boot_index, r.key FROM (SELECT device, boot_index, service FROM (SELECT DISTINCT device, boot_index, service FROM prof) p WHERE
  (SELECT count(*) FROM prof q JOIN kref r USING (service, key) WHERE q.device = p.device AND q.boot_index = p.boot_index AND q.service = p.service) >= 0.8 * (SELECT count(*) FROM kref r WHERE r.service = p.service)
  AND EXISTS (SELECT 1 FROM kref r WHERE r.service = p.service)) f JOIN kref r USING (service) WHERE NOT EXISTS (SELECT 1 FROM prof q WHERE q.device = f.device AND q.boot_index = f.boot_index AND q.key = r.key)""")
def _(spark, d):
    return C.boot_overrides(_profiles(spark, d), _reference(spark, d))


view("cov", """
SELECT DISTINCT device_id device, code_aux boot_index, process_name service, k // 10 AS g FROM ev""")


def _cover(spark, d):
    rows = ev(spark, d).select(F.col("device_id").alias("device"), F.col("code_aux").alias("boot_index"), F.col("process_name").alias("service"),
                               F.concat(F.lit("Reading CAM.k"), F.floor(F.col("k") / 10).cast("string"), F.lit(" = 1; cam.k99x")).alias("line"))
    keys = ev(spark, d).select(F.concat(F.lit("cam.K"), F.floor(F.col("k") / 10).cast("string")).alias("key"), F.lit("s").alias("section")).distinct()
    return rows, keys, C.key_coverage(rows, keys)


@check("cfg_key_coverage", "SELECT device, boot_index, 'cam.K' || g AS key, array_to_string(list_sort(list(service)), ',') AS services FROM cov GROUP BY 1, 2, 3")
def _(spark, d):
    return _cover(spark, d)[2].withColumn("services", F.array_join("services", ","))


@check("cfg_failed_keys", """
SELECT b.device, b.boot_index, 'cam.K' || g AS key FROM (SELECT DISTINCT device, boot_index FROM cov) b, (SELECT DISTINCT g FROM cov) k WHERE NOT EXISTS (
  SELECT 1 FROM cov c WHERE c.device = b.device AND c.boot_index = b.boot_index AND c.g = k.g)""")
def _(spark, d):
    rows, keys, covered = _cover(spark, d)
    return C.failed_keys(rows, keys, covered)


@check("flt_exclude_overridden", """
SELECT device, boot_index, key FROM prof WHERE service = 'view' AND (device, boot_index, key) NOT IN (SELECT (device, boot_index, key) FROM prof WHERE service IN ('click', 'error'))""")
def _(spark, d):
    p = _profiles(spark, d)
    return C.exclude_overridden(p.filter("service = 'view'").drop("service"), p.filter("service = 'click'"), p.filter("service = 'error'"))


view("feat", "SELECT p_type AS feature, p_type AS section, p_brand AS key, cast(min(p_size) AS varchar) AS want FROM part GROUP BY 1, 2, 3")
view("fstate", """
SELECT u.device, f.feature, f.section, f.key, CASE WHEN l.v IS NOT NULL THEN CASE WHEN nv(l.v) = nv(f.want) THEN 'log_ok' ELSE 'log_off' END WHEN (u.device, f.key) IN (SELECT (device, key) FROM covr) THEN 'ovr'
  WHEN c.v IS NULL THEN 'na' WHEN nv(c.v) = nv(f.want) THEN 'ok' ELSE 'off' END AS state FROM (SELECT DISTINCT p_partkey % 40 AS device FROM part) u, feat f
LEFT JOIN clog l ON l.device = u.device AND l.section = f.section AND l.key = f.key LEFT JOIN cdef c ON c.device = u.device AND c.section = f.section AND c.key = f.key""".replace("nv(", "("))


def _states(spark, d):
    p = table(spark, d, "part")
    units = p.select((F.col("p_partkey") % 40).alias("device"), (F.col("p_partkey") % 40).alias("version")).distinct()
    feats = p.groupBy(F.col("p_type").alias("feature"), F.col("p_type").alias("section"), F.col("p_brand").alias("key")).agg(F.min("p_size").cast("string").alias("expected"))
    defaults = conf(spark, d, F.min, "p_partkey % 5 <> 0").withColumnRenamed("device", "version")
    ovr = p.filter("p_partkey % 11 = 0").select((F.col("p_partkey") % 40).alias("device"), F.col("p_brand").alias("key")).distinct()
    return C.condition_states(units, feats, defaults, ovr, conf(spark, d, F.max, "p_partkey % 7 = 0"))


@check("cfg_condition_states", "SELECT * FROM fstate")
def _(spark, d):
    return _states(spark, d)


view("fstat", """
SELECT device, feature, CASE WHEN bool_or(state IN ('off', 'log_off')) THEN 'OFF' WHEN bool_or(state = 'ovr') THEN 'OVERRIDDEN' WHEN bool_or(state = 'na') THEN 'NA' ELSE 'ON' END AS status FROM fstate GROUP BY 1, 2""")


@check("cfg_feature_status", "SELECT * FROM fstat")
def _(spark, d):
    return C.feature_status(_states(spark, d))


# device feature states straight from events, so that every status occurs
view("estat", "SELECT device_id device, 'f' || (k % 6) AS feature, CASE min(k // 25) WHEN 0 THEN 'ON' WHEN 1 THEN 'OFF' WHEN 2 THEN 'NA' ELSE 'OVERRIDDEN' END AS status FROM ev GROUP BY 1, 2")


def _estat(spark, d):
    m = F.min(F.floor(F.col("k") / 25))
    return ev(spark, d).groupBy(F.col("device_id").alias("device"), F.concat(F.lit("f"), (F.col("k") % 6).cast("string")).alias("feature")).agg(
        F.when(m == 0, "ON").when(m == 1, "OFF").when(m == 2, "NA").otherwise("OVERRIDDEN").alias("status"))


@check("cfg_filter_by_features", """
SELECT device, bool_and(status = 'ON') AS kept, CASE WHEN NOT bool_and(status = 'ON') THEN 'Not enabled: ' || string_agg(CASE WHEN status <> 'ON' THEN feature || CASE status WHEN 'OFF' THEN ' (off)' ELSE ' (a key is not in the config)' END END, ', ' ORDER BY feature) END AS reason
FROM estat WHERE feature IN ('f1', 'f4') GROUP BY 1""")
def _(spark, d):
    return C.filter_by_features(_estat(spark, d), ["f1", "f4"])


@check("agg_feature_coverage", "SELECT feature, count(*) FILTER (WHERE status = 'ON') AS devices_on FROM estat GROUP BY 1 HAVING bool_or(status <> 'NA')")
def _(spark, d):
    return C.feature_coverage(_estat(spark, d))


@check("agg_feature_sets", """
SELECT fs AS features, count(*) AS devices, cast(6 - CASE WHEN fs = '' THEN 0 ELSE len(string_split(fs, ',')) END AS bigint) AS missing FROM (SELECT device, coalesce(string_agg(CASE WHEN status = 'ON' THEN feature END, ',' ORDER BY feature), '') fs FROM estat GROUP BY 1) GROUP BY 1""")
def _(spark, d):
    return C.feature_sets(_estat(spark, d)).select(F.array_join("features", ",").alias("features"), "devices", F.size("missing").cast("bigint").alias("missing"))


@check("cfg_remaining_conditions", """
SELECT b.device, k.section, k.key, c.v AS "default" FROM (SELECT DISTINCT device FROM cpln) b, (SELECT DISTINCT section, key FROM feat) k LEFT JOIN (SELECT p_type AS section, p_brand AS key, cast(min(p_size) AS varchar) AS v FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1, 2) c ON c.section = k.section AND c.key = k.key
WHERE (b.device, k.key) NOT IN (SELECT (device, key) FROM cpln)""")
def _(spark, d):
    p = table(spark, d, "part")
    feats = p.select(F.col("p_type").alias("section"), F.col("p_brand").alias("key")).distinct()
    plain = p.filter("p_partkey % 3 = 0").select((F.col("p_partkey") % 40).alias("device"), F.col("p_brand").alias("key")).distinct()
    defaults = p.filter("p_partkey % 5 <> 0").groupBy(F.col("p_type").alias("section"), F.col("p_brand").alias("key")).agg(F.min("p_size").cast("string").alias("value"))
    return C.remaining_conditions(feats, plain, defaults)
