"""Verdicts, findings, comparisons and graph questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, view
from checks.reports import evm
from checks.views import ev, table
from tripline.plans import compare as X
from tripline.plans import findings as N
from tripline.plans import graph as G
from tripline.plans import verdicts as V
from tripline.session import settle

# ── verdicts: three tests over a device's events of one day ──


def _steps(spark, d):
    """step 1 click, step 2 view (any), step 3 error must be absent; second test needs view and purchase in any order."""
    one = ev(spark, d).agg(F.max("event_id"))
    rows = [("t1", 1, "any", "present", 1), ("t1", 2, "any", "present", 1), ("t2", 1, "all", "present", 2), ("t3", 1, "any", "present", 1),
            ("t3", 2, "any", "absent", 1)]
    return one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("test"), F.lit(n).alias("step_no"), F.lit(m).alias("mode"), F.lit(e).alias("expect"),
                                                   F.lit(a).alias("alts")) for t, n, m, e, a in rows])).alias("s")).select("s.*")


def _hits(spark, d):
    e = evm(spark, d).withColumn("boot_index", F.dayofmonth("ts"))
    p = F.col("process_name")

    def hit(test, step, alt, kind):
        return F.when(p == kind, F.struct(F.lit(test).alias("test"), F.lit(step).alias("step_no"), F.lit(alt).alias("alt")))

    hs = F.array(hit("t1", 1, 0, "click"), hit("t1", 2, 0, "view"), hit("t2", 1, 0, "view"), hit("t2", 1, 1, "purchase"), hit("t3", 1, 0, "click"), hit("t3", 2, 0, "error"))
    rows = e.select(F.col("device_id").alias("device"), "boot_index", F.explode(F.filter(hs, lambda x: x.isNotNull())).alias("h"), F.col("t").alias("ts"))
    boots = e.select(F.col("device_id").alias("device"), "boot_index").distinct().withColumn("start", F.lit(None).cast("bigint"))
    return rows.select("device", "boot_index", "h.*", "ts"), boots


view("vday", "SELECT device_id device, day(ts) AS b, process_name p, t FROM evm")
view("vd", """
SELECT device, b, min(t) FILTER (WHERE p = 'click') c, max(t) FILTER (WHERE p = 'view') lv, count(*) FILTER (WHERE p = 'view') nv, count(*) FILTER (WHERE p = 'purchase') np,
  max(t) FILTER (WHERE p = 'error') le FROM vday GROUP BY 1, 2""")
view("verd", """
SELECT device, b, 't1' AS test, CASE WHEN c IS NULL AND nv = 0 THEN 'NOT_TRIGGERED' WHEN c IS NULL THEN 'FAIL' WHEN lv >= c THEN 'PASS' ELSE 'FAIL' END AS verdict FROM vd
UNION ALL SELECT device, b, 't2', CASE WHEN nv > 0 AND np > 0 THEN 'PASS' WHEN nv = 0 THEN 'NOT_TRIGGERED' WHEN np = 0 THEN 'NOT_TRIGGERED' END FROM vd
UNION ALL SELECT device, b, 't3', CASE WHEN c IS NULL THEN 'NOT_TRIGGERED' WHEN le >= c THEN 'FAIL' ELSE 'PASS' END FROM vd""")


def _verdicts(spark, d):
    hits, boots = _hits(spark, d)
    return V.evaluate_steps(hits, _steps(spark, d), boots)


@check("win_evaluate_steps", "SELECT device, b AS boot_index, test, verdict FROM verd")
def _(spark, d):
    return _verdicts(spark, d).select("device", F.col("boot_index").cast("bigint").alias("boot_index"), "test", "verdict")


@check("win_evaluate_in_windows", """
SELECT v.device, v.b AS boot_index, v.test, CASE WHEN w.lo IS NULL THEN 'CONDITION_NOT_MET' WHEN v.test = 't1' AND c.c IS NOT NULL AND c.c < hi THEN CASE WHEN c.lv >= c.c THEN 'PASS' ELSE 'FAIL' END
  WHEN v.test = 't3' AND c.c IS NOT NULL AND c.c < hi THEN CASE WHEN c.le >= c.c THEN 'FAIL' ELSE 'PASS' END
  WHEN v.test = 't2' AND t2.f < hi AND t2v > 0 AND t2p > 0 THEN 'PASS' WHEN v.test = 't2' AND t2.f < hi AND ((t2v = 0 AND nv > 0) OR (t2v > 0 AND np > 0)) THEN 'FAIL' WHEN v.verdict = 'NOT_TRIGGERED' THEN 'NOT_TRIGGERED' ELSE 'CONDITION_NOT_MET' END AS verdict
FROM verd v JOIN vd USING (device, b) LEFT JOIN (SELECT device, b, min(t) FILTER (WHERE p = 'signup') AS s, min(t) lo0, CASE WHEN count(*) FILTER (WHERE p = 'signup') > 0 THEN min(t) FILTER (WHERE p = 'signup') END AS lo,
  min(t) FILTER (WHERE p = 'signup') + 43200000 AS hi FROM vday GROUP BY 1, 2) w USING (device, b)
LEFT JOIN (SELECT x.device, x.b, min(t) FILTER (WHERE p = 'click' AND t >= lo) c, max(t) FILTER (WHERE p = 'view') lv, max(t) FILTER (WHERE p = 'error') le FROM vday x JOIN (
  SELECT device, b, min(t) FILTER (WHERE p = 'signup') lo FROM vday GROUP BY 1, 2) y ON x.device = y.device AND x.b = y.b GROUP BY 1, 2) c ON c.device = v.device AND c.b = v.b
LEFT JOIN (SELECT x.device, x.b, min(t) FILTER (WHERE p IN ('view', 'purchase') AND t >= lo) f, count(*) FILTER (WHERE p = 'view' AND t >= lo) t2v, count(*) FILTER (WHERE p = 'purchase' AND t >= lo) t2p FROM vday x JOIN (
  SELECT device, b, min(t) FILTER (WHERE p = 'signup') lo FROM vday GROUP BY 1, 2) y ON x.device = y.device AND x.b = y.b GROUP BY 1, 2) t2 ON t2.device = v.device AND t2.b = v.b""")
def _(spark, d):
    hits, boots = _hits(spark, d)
    wins = evm(spark, d).filter("process_name = 'signup'").groupBy(F.col("device_id").alias("device"), F.dayofmonth("ts").alias("boot_index")).agg(
        F.min("t").alias("start"), (F.min("t") + 43_200_000).alias("end"))
    out = V.evaluate_in_windows(hits, _steps(spark, d), boots, wins)
    return out.select("device", F.col("boot_index").cast("bigint").alias("boot_index"), "test", "verdict")


def _tf(spark, d):
    return _steps(spark, d).select("test", F.explode(F.when(F.col("test") == "t1", F.array(F.lit("fa"))).when(F.col("test") == "t2", F.array(F.lit("fa"), F.lit("fb"))).otherwise(
        F.array(F.lit("fb")))).alias("feature")).distinct()


@check("win_gate_by_features", """
SELECT device, b AS boot_index, test, CASE WHEN (test = 't1' AND b % 2 = 0) OR (test = 't3' AND b % 3 = 0) OR (test = 't2' AND b % 6 = 0) THEN 'CONDITION_NOT_MET' ELSE verdict END AS verdict FROM verd""")
def _(spark, d):
    v = settle(_verdicts(spark, d))
    st = v.select("device", "boot_index", F.explode(F.array(
        F.struct(F.lit("fa").alias("feature"), F.when(F.col("boot_index") % 2 == 0, "OFF").otherwise("ON").alias("status")),
        F.struct(F.lit("fb").alias("feature"), F.when(F.col("boot_index") % 3 == 0, "OFF").otherwise("NA").alias("status")))).alias("s")).select("device", "boot_index", "s.*").distinct()
    return V.gate_by_features(v, _tf(spark, d), st).select("device", F.col("boot_index").cast("bigint").alias("boot_index"), "test", "verdict")


@check("win_not_applicable", "SELECT device, b AS boot_index, test, CASE WHEN test = 't2' AND b % 2 = 1 THEN 'NOT_APPLICABLE' ELSE verdict END AS verdict FROM verd")
def _(spark, d):
    v = settle(_verdicts(spark, d))
    tests = _steps(spark, d).select("test", F.when(F.col("test") == "t2", F.array(F.lit("even"))).alias("device_types")).distinct()
    boots = v.select("device", "boot_index").distinct().withColumn("device_type", F.when(F.col("boot_index") % 2 == 1, "odd").otherwise("even"))
    return V.applicable(v, tests, boots).select("device", F.col("boot_index").cast("bigint").alias("boot_index"), "test", "verdict")


@check("win_step_device_types", """
SELECT device, b AS boot_index, test, CASE
  WHEN test = 't2' AND b % 3 = 0 THEN 'NOT_APPLICABLE'
  WHEN test = 't1' AND b % 3 = 0 THEN CASE WHEN c IS NULL THEN 'NOT_TRIGGERED' ELSE 'PASS' END
  WHEN test = 't3' AND b % 3 = 1 THEN CASE WHEN c IS NULL THEN 'NOT_TRIGGERED' ELSE 'PASS' END ELSE verdict END AS verdict FROM verd JOIN vd USING (device, b)""")
def _(spark, d):
    # days are devices of type a (no second step of t1, no t2), b (no absent step of t3) or unknown
    hits, boots = _hits(spark, d)
    types = F.when((F.col("test") == "t1") & (F.col("step_no") == 2), F.array(F.lit("b"), F.lit("c"))).when(F.col("test") == "t2", F.array(F.lit("b"))).when(
        (F.col("test") == "t3") & (F.col("step_no") == 2), F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    typed = boots.withColumn("device_type", F.when(F.col("boot_index") % 3 == 0, "a").when(F.col("boot_index") % 3 == 1, "b"))
    out = V.evaluate_steps(hits, _steps(spark, d).withColumn("device_types", types), typed)
    return out.select("device", F.col("boot_index").cast("bigint").alias("boot_index"), "test", "verdict")


@check("win_usable_requirements", """
SELECT test, 'dim' AS dimension, string_agg(v, ',' ORDER BY v) AS "values" FROM (SELECT DISTINCT 't' || (k % 7) AS test, process_name v FROM ev) GROUP BY 1 HAVING bool_and(v IN (SELECT process_name FROM ev WHERE k % 7 <> 9))""")
def _(spark, d):
    req = ev(spark, d).select(F.concat(F.lit("t"), (F.col("k") % 7).cast("string")).alias("test"), F.lit("dim").alias("dimension"), F.col("process_name").alias("value"))
    rules = ev(spark, d).select(F.lit("dim").alias("dimension"), F.col("process_name").alias("value"))
    return V.usable_requirements(req, rules).withColumn("values", F.array_join("values", ","))


@check("agg_verdict_rollup", """
SELECT f AS feature, test, count(*) FILTER (WHERE verdict = 'PASS') AS pass, count(*) FILTER (WHERE verdict = 'FAIL') AS fail, count(*) FILTER (WHERE verdict = 'NOT_TRIGGERED') AS not_triggered, 0::bigint AS condition_not_met
FROM verd JOIN (VALUES ('t1', 'fa'), ('t2', 'fa'), ('t2', 'fb'), ('t3', 'fb')) x(test, f) USING (test) GROUP BY 1, 2""")
def _(spark, d):
    return V.verdict_rollup(_verdicts(spark, d), _tf(spark, d))


@check("agg_feature_level", """
SELECT f AS feature, count(*) AS tests, count(*) FILTER (WHERE p + q > 0) AS triggered, count(*) FILTER (WHERE p > 0 AND q = 0) AS passed, count(*) FILTER (WHERE q > 0) AS failed, count(*) FILTER (WHERE p + q = 0) AS not_triggered,
  0::bigint AS condition_not_met, round(100.0 * count(*) FILTER (WHERE q > 0) / count(*), 6) AS fail_pct FROM (SELECT f, test, count(*) FILTER (WHERE verdict = 'PASS') p, count(*) FILTER (WHERE verdict = 'FAIL') q
  FROM verd JOIN (VALUES ('t1', 'fa'), ('t2', 'fa'), ('t2', 'fb'), ('t3', 'fb')) x(test, f) USING (test) GROUP BY 1, 2) GROUP BY 1""")
def _(spark, d):
    return V.feature_level(V.verdict_rollup(_verdicts(spark, d), _tf(spark, d))).withColumn("fail_pct", F.round("fail_pct", 6))


@check("agg_failing_boots", "SELECT test, device, b AS boot_index FROM verd WHERE verdict = 'FAIL'")
def _(spark, d):
    return V.failing_boots(_verdicts(spark, d)).withColumn("boot_index", F.col("boot_index").cast("bigint"))


@check("agg_failing_keys", """
SELECT service || key AS key, count(*) AS failed_boots, (SELECT count(*) FROM (SELECT DISTINCT device, boot_index FROM prof)) AS boots_checked FROM prof GROUP BY 1""")
def _(spark, d):
    from checks.reports import _profiles

    p = _profiles(spark, d)
    return V.failing_keys(p.select(F.concat("service", "key").alias("key")), p)


def _summary(spark, d):
    c = table(spark, d, "customer")
    given = c.select(F.col("c_custkey").cast("string").alias("device"))
    info = c.select(F.col("c_custkey").cast("string").alias("device"), (F.col("c_custkey") % 4).alias("days"), (F.col("c_custkey") % 3).alias("detailed_days"))
    boots = ev(spark, d).select(F.col("device_id").alias("device"), F.col("k").alias("drive_minutes"), (F.col("k") == 7).alias("low_power"))
    return V.report_summary(given, info, boots)


view("rsum", """
SELECT cast(c_custkey AS varchar) AS device, CASE WHEN c_custkey % 4 = 0 THEN 'no_logs' WHEN n IS NOT NULL THEN CASE WHEN c_custkey % 3 > 0 THEN 'detailed' ELSE 'on_version' END WHEN c_custkey % 3 = 0 THEN 'critical_only' ELSE 'other_version' END AS part,
  coalesce(n, 0) AS boots, cast(coalesce(m, 0) AS bigint) AS mins, CASE WHEN n IS NOT NULL THEN CASE WHEN m <= 360 THEN 'up_to_6h' WHEN m <= 1440 THEN 'over_6h' ELSE 'over_24h' END END AS drive_class, coalesce(lp, FALSE) AS low_power
FROM customer LEFT JOIN (SELECT user_id, count(*) n, sum(k) m, bool_or(k = 7) lp FROM ev GROUP BY 1) ON user_id = c_custkey""")


@check("agg_report_summary", 'SELECT device, part, boots, mins AS "minutes", drive_class, low_power FROM rsum')
def _(spark, d):
    return _summary(spark, d)


@check("agg_summary_counts", """
SELECT count(*) given, count(*) FILTER (WHERE part = 'no_logs') no_logs, count(*) FILTER (WHERE part = 'other_version') other_version, count(*) FILTER (WHERE part = 'critical_only') critical_only,
  count(*) FILTER (WHERE part = 'detailed') detailed, cast(sum(boots) AS bigint) boots, cast(sum(mins) AS bigint) AS "minutes", count(*) FILTER (WHERE drive_class = 'up_to_6h') up_to_6h,
  count(*) FILTER (WHERE drive_class IN ('over_6h', 'over_24h')) over_6h, count(*) FILTER (WHERE drive_class = 'over_24h') over_24h, count(*) FILTER (WHERE low_power) low_power FROM rsum""")
def _(spark, d):
    return V.summary_counts(_summary(spark, d))


# ── findings ──

view("fdev", "SELECT device_id device, cast(sum(k) / 20 AS double) AS mins, bool_or(k = 3) AS other FROM ev GROUP BY 1")
view("fapi", """
SELECT device_id device, CASE k % 9 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 8 WHEN 3 THEN 7 WHEN 4 THEN 3 WHEN 5 THEN 9 WHEN 6 THEN 6 ELSE 10 END AS api, count(*) calls, count(*) FILTER (WHERE k % 2 = 0) ok, count(*) FILTER (WHERE k % 2 = 1) failed,
  max(k) * 60000 AS gap FROM ev WHERE k % 9 <> 4 OR user_id % 2 = 0 GROUP BY 1, 2""")
view("rates", "SELECT * FROM (VALUES (1, 10), (2, 10), (8, 5), (7, 10), (10, 10)) r(api, per)")
view("finds", """
SELECT device, api, CASE WHEN n = 0 THEN 'zero' WHEN n < 0.5 * x THEN 'far_below' WHEN n < x THEN 'below' WHEN n > 3.0 * x THEN 'far_above' END AS kind, n, x AS expected FROM (
  SELECT d.device, r.api, coalesce(a.calls, 0) n, cast(floor(mins / per) AS bigint) x FROM fdev d CROSS JOIN rates r LEFT JOIN fapi a ON a.device = d.device AND a.api = r.api) WHERE x > 0 AND (n < x OR n > 3.0 * x)
UNION ALL SELECT d.device, 6, 'no_status_after_ota_change', coalesce((SELECT calls FROM fapi a WHERE a.device = d.device AND a.api = 5), 0), NULL FROM fdev d WHERE other AND d.device NOT IN (SELECT device FROM fapi WHERE api = 6)
UNION ALL SELECT d.device, 3, 'no_event', 0, NULL FROM fdev d WHERE mins > 30 AND d.device NOT IN (SELECT device FROM fapi WHERE api = 3)
UNION ALL SELECT d.device, 9, 'no_video_with_events', 0, NULL FROM fdev d WHERE d.device IN (SELECT device FROM fapi WHERE api = 3) AND d.device NOT IN (SELECT device FROM fapi WHERE api = 9)
UNION ALL SELECT device, api, CASE WHEN failed >= 0.5 * (ok + failed) THEN 'most_calls_failed' ELSE 'calls_failing' END, failed, ok + failed FROM fapi WHERE failed >= 3 AND failed >= 0.1 * (ok + failed)
UNION ALL SELECT d.device, 8, CASE WHEN coalesce(calls, 0) = 0 AND mins > 30 THEN 'zero_with_drive' ELSE 'gap_over_limit' END, coalesce(calls, 0), NULL FROM fdev d LEFT JOIN fapi a ON a.device = d.device AND a.api = 8
  WHERE (coalesce(calls, 0) = 0 AND mins > 30) OR gap > 30 * 60000""")


def _find(spark, d):
    e = ev(spark, d)
    m = F.col("k") % 9
    devices = e.groupBy(F.col("device_id").alias("device")).agg((F.sum("k") / 20).cast("double").alias("minutes"), F.bool_or(F.col("k") == 3).alias("other_versions"))
    api = F.when(m == 0, 1).when(m == 1, 2).when(m == 2, 8).when(m == 3, 7).when(m == 4, 3).when(m == 5, 9).when(m == 6, 6).otherwise(10)
    apis = e.filter("k % 9 <> 4 or user_id % 2 = 0").groupBy(F.col("device_id").alias("device"), api.alias("api")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("k") % 2 == 0).alias("ok"), F.count_if(F.col("k") % 2 == 1).alias("failed"), (F.max("k") * 60_000).alias("gap_max"))
    gated = devices.select("device", F.lit(8).alias("api"))
    return N.api_findings(devices, apis, gated=gated)


@check("cfg_api_findings", "SELECT device, cast(api AS bigint) AS api, kind, cast(n AS bigint) AS n, cast(expected AS bigint) AS expected FROM finds")
def _(spark, d):
    return _find(spark, d).select("device", F.col("api").cast("bigint").alias("api"), "kind", "n", "expected")


LEVEL = "CASE WHEN kind IN ('below', 'far_above', 'gap_over_limit', 'calls_failing') THEN 2 ELSE 3 END"
view("profs", f"""
SELECT device, coalesce(i, 0) AS api_issues, t, q, c, coalesce(p, 0) + least(t, 5) + least(q, 5) + CASE WHEN c > 0 THEN 2 ELSE 0 END AS score FROM (SELECT device_id device, count(*) FILTER (WHERE k < 10) t, count(*) FILTER (WHERE k > 90) q,
  count(*) FILTER (WHERE k = 50) c FROM ev GROUP BY 1) LEFT JOIN (SELECT device, count(*) i, sum({LEVEL}) p FROM finds GROUP BY 1) USING (device)""")
view("profx", "SELECT *, (api_issues > 0)::int + (t > 0)::int + (q > 0)::int + (c > 0)::int AS areas FROM profs WHERE api_issues + t + q + c > 0")


def _profiles(spark, d):
    areas = ev(spark, d).groupBy(F.col("device_id").alias("device")).agg(
        F.count_if(F.col("k") < 10).alias("failing_tests"), F.count_if(F.col("k") > 90).alias("missed_kpis"), F.count_if(F.col("k") == 50).alias("failing_keys"), F.lit(False).alias("cloud_fail"))
    found = settle(_find(spark, d))
    return found, N.device_profiles(found, areas)


@check("agg_device_profiles", "SELECT device, cast(score AS bigint) AS score, cast(areas AS bigint) AS areas, areas >= 2 OR api_issues >= 3 AS multi_issue, row_number() OVER (ORDER BY score DESC, device) AS rank FROM profx")
def _(spark, d):
    out = N.rank_profiles(_profiles(spark, d)[1])
    return out.select("device", F.col("score").cast("bigint").alias("score"), F.size("areas").cast("bigint").alias("areas"), "multi_issue", F.col("rank").cast("bigint").alias("rank"))


view("labs", """
SELECT DISTINCT device, api || ': ' || kind AS label FROM finds UNION SELECT device, unnest([CASE WHEN t > 0 THEN 'tests' END, CASE WHEN c > 0 THEN 'config' END, CASE WHEN q > 0 THEN 'kpi' END]) FROM profx""")


@check("agg_issue_pairs", """
SELECT a.label AS a, b.label AS b, count(*) AS devices FROM labs a JOIN labs b ON a.device = b.device AND a.label < b.label GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY 3 DESC, 1, 2 LIMIT 10""")
def _(spark, d):
    found, prof = _profiles(spark, d)
    return N.issue_pairs(N.issue_labels(found, prof)).select("a", "b", "devices")


@check("agg_concentration", """
SELECT count(*) devices_with_issues, count(*) FILTER (WHERE areas >= 2 OR api_issues >= 3) multi_issue_devices, greatest(count(*) // 5, 1) AS top_devices, round(100 * sum(CASE WHEN r <= greatest(n // 5, 1) THEN score ELSE 0 END) / sum(score)) AS top_share_pct
FROM (SELECT *, row_number() OVER (ORDER BY score DESC, device) r, count(*) OVER () n FROM profx)""")
def _(spark, d):
    return N.concentration(settle(N.rank_profiles(_profiles(spark, d)[1])))


# ── comparison: even against odd users ──

view("side", "SELECT user_id % 2 AS s, process_name AS key, cast(sum(k) AS double) AS v, count(*) AS n FROM ev GROUP BY 1, 2")


def _side(spark, d, odd):
    return ev(spark, d).filter(F.col("user_id") % 2 == odd).groupBy(F.col("process_name").alias("key")).agg(F.sum("k").cast("double").alias("value"), F.count(F.lit(1)).alias("n"))


@check("join_compare_reports", """
SELECT key, a.v AS a, b.v AS b, round((b.v - a.v) * 100 / abs(a.v), 6) AS change_pct FROM (SELECT * FROM side WHERE s = 0 AND key <> 'view') a FULL JOIN (SELECT * FROM side WHERE s = 1 AND key <> 'click') b USING (key)""")
def _(spark, d):
    out = X.compare_reports(_side(spark, d, 0).filter("key <> 'view'"), _side(spark, d, 1).filter("key <> 'click'"), ["key"])
    return out.withColumn("change_pct", F.round("change_pct", 6))


@check("set_diff", "SELECT event_id // 2 AS key, CASE WHEN bool_or(user_id % 2 = 0) AND bool_or(user_id % 2 = 1) THEN 'both' WHEN bool_or(user_id % 2 = 0) THEN 'a' ELSE 'b' END AS side FROM ev GROUP BY 1")
def _(spark, d):
    e = ev(spark, d).select(F.expr("event_id div 2").alias("key"), "user_id")
    return X.set_diff(e.filter("user_id % 2 = 0"), e.filter("user_id % 2 = 1"), "key")


def _totals(spark, d, odd):
    e = ev(spark, d).filter(F.col("user_id") % 2 == odd)
    n = F.count(F.lit(1))
    return e.agg(F.countDistinct("device_id").alias("devices"), n.alias("boots"), (F.sum("k") / 60).alias("hours"), F.count_if(F.col("k") > 5).alias("drives"),
                 F.count_if(F.col("k").between(6, 15)).alias("drives_short"), F.count_if(F.col("k") == 1).alias("low_power_boots"),
                 F.countDistinct(F.when(F.col("k") == 1, F.col("device_id"))).alias("low_power_devices"), F.countDistinct(F.when(F.col("k") > 50, F.col("device_id"))).alias("over_6h_devices"),
                 F.sum("cnt").alias("sessions_created"), F.count_if(F.col("cnt") > 1).alias("sessions_available"), F.count_if(F.col("k") == 9).alias("session_issues"), F.count_if(F.col("k") == 2).alias("runs_improper"))


_OV = (("devices", "count(DISTINCT device_id)", "NULL"), ("boots", "count(*)", "NULL"), ("drive_hours", "sum(k) / 60", "NULL"), ("short_drives_pct", "100.0 * count(*) FILTER (WHERE k BETWEEN 6 AND 15) / count(*) FILTER (WHERE k > 5)", "TRUE"),
       ("low_power_boots_pct", "100.0 * count(*) FILTER (WHERE k = 1) / count(*)", "TRUE"), ("sessions_stored_pct", "100.0 * count(*) FILTER (WHERE cnt > 1) / sum(cnt)", "FALSE"),
       ("improper_runs_per_hour", "count(*) FILTER (WHERE k = 2) / (sum(k) / 60)", "TRUE"), ("boots_per_device", "count(*) / count(DISTINCT device_id)", "NULL"),
       ("hours_per_device", "sum(k) / 60 / count(DISTINCT device_id)", "NULL"), ("drives_per_hour", "count(*) FILTER (WHERE k > 5) / (sum(k) / 60)", "NULL"),
       ("low_power_devices_pct", "100.0 * count(DISTINCT CASE WHEN k = 1 THEN device_id END) / count(DISTINCT device_id)", "TRUE"),
       ("over_6h_devices_pct", "100.0 * count(DISTINCT CASE WHEN k > 50 THEN device_id END) / count(DISTINCT device_id)", "NULL"),
       ("sessions_per_hour", "sum(cnt) / (sum(k) / 60)", "NULL"), ("session_issues_pct", "100.0 * count(*) FILTER (WHERE k = 9) / count(*) FILTER (WHERE k > 5)", "TRUE"))


@check("agg_compare_overview", "SELECT metric, round(a, 5) AS a, round(b, 5) AS b, CASE WHEN w IS NULL OR coalesce(abs((b - a) * 100 / abs(a)) < 10, TRUE) THEN 'same' WHEN (b > a) = w THEN 'worse' ELSE 'better' END AS verdict FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, max(CASE WHEN s = 0 THEN v END) a, max(CASE WHEN s = 1 THEN v END) b, cast({w} AS boolean) AS w FROM (SELECT user_id % 2 AS s, cast({x} AS double) AS v FROM ev GROUP BY 1)" for m, x, w in _OV) + ")")
def _(spark, d):
    out = X.compare_overview(_totals(spark, d, 0), _totals(spark, d, 1))
    return out.select("metric", F.round("a", 5).alias("a"), F.round("b", 5).alias("b"), "verdict")


@check("agg_compare_kpis", """
SELECT key AS metric, 'per boot' AS basis, round(a.v / 10, 6) AS a, round(b.v / 20, 6) AS b FROM (SELECT * FROM side WHERE s = 0) a JOIN (SELECT * FROM side WHERE s = 1) b USING (key)""")
def _(spark, d):
    def side(odd, boots):
        rows = _side(spark, d, odd).select(F.col("key").alias("metric"), F.lit("kpi-crash").alias("tab"), F.lit("count").alias("unit"), F.lit("sum").alias("agg"),
                                           F.lit(1.0).alias("p90"), F.col("value").alias("total"), F.lit(None).cast("string").alias("common"))
        return X.kpi_values(rows, F.lit(boots), F.lit(5.0))

    out = X.compare_kpis(side(0, 10), side(1, 20))
    return out.select("metric", "basis", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@check("agg_compare_codes", """
SELECT code, a_alerts, b_alerts, round(a_alerts / 10, 6) AS a, round(b_alerts / 20, 6) AS b, round((b_alerts / 20 - a_alerts / 10) * 100 / nullif(a_alerts / 10, 0), 6) AS change_pct FROM (SELECT '1.' || k AS code, count(*) FILTER (WHERE user_id % 2 = 0) a_alerts, count(*) FILTER (WHERE user_id % 2 = 1) b_alerts, k FROM ev GROUP BY k)
WHERE a_alerts = 0 OR abs(b_alerts / 20 - a_alerts / 10) * 100 / (a_alerts / 10) >= 10 ORDER BY abs(b_alerts / 20 - a_alerts / 10) DESC, k LIMIT 25""")
def _(spark, d):
    def codes(odd):
        return ev(spark, d).filter(F.col("user_id") % 2 == odd).groupBy(F.concat(F.lit("1."), F.col("k").cast("string")).alias("code")).agg(F.count(F.lit(1)).alias("alerts"))

    return X.compare_codes(codes(0), codes(1), 10, 20).select("code", "a_alerts", "b_alerts", *[F.round(c, 6).alias(c) for c in ("a", "b", "change_pct")])


# ── graph: regions > nations > suppliers > parts as product lines > services > features > flows ──


def graph(spark, d):
    t = lambda n: table(spark, d, n)
    none = F.lit(None).cast("string")

    def node(df, idc, label, **props):
        entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in props.items() if k != "skus"])
        lists = F.create_map(F.lit("valid_device_skus"), props["skus"]) if "skus" in props else F.expr("cast(map() as map<string,array<string>>)")
        return df.select(F.concat(F.lit(label[:3]), idc.cast("string")).alias("id"), F.lit(label).alias("label"),
                         F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("props"), lists.alias("lists"))

    s, p = t("supplier"), t("part")
    # Every nation is a service of its region; suppliers of nations 0 and 1 are no features
    nodes = node(t("region"), F.col("r_regionkey"), "ProductLine", name=F.col("r_name"), sku=F.concat(F.lit("R"), F.col("r_regionkey").cast("string")))
    nodes = nodes.union(node(t("nation"), F.col("n_nationkey"), "Service", name=F.col("n_name")))
    nodes = nodes.union(node(s, F.col("s_suppkey"), "Feature", name=F.col("s_name"), skus=F.array(F.concat(F.lit("r"), (F.col("s_suppkey") % 3).cast("string")))))
    nodes = nodes.union(node(p, F.col("p_partkey"), "Flow", name=F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")), flow_number=F.col("p_partkey") % 50,
                             flow_type=F.when(F.col("p_size") > 10, F.col("p_type")), automated=F.col("p_size") % 2, description=F.col("p_brand")))
    cond = p.select("p_brand").distinct()
    nodes = nodes.union(node(cond, F.col("p_brand"), "DeviceCondition", name=F.col("p_brand"), category=F.lit("brand")))

    def edge(df, a, b, la, lb, kind, evidence=none):
        return df.select(F.concat(F.lit(la), F.col(a).cast("string")).alias("src"), F.concat(F.lit(lb), F.col(b).cast("string")).alias("dst"), F.lit(kind).alias("type"),
                         evidence.alias("evidence"))

    edges = edge(t("nation"), "n_regionkey", "n_nationkey", "Pro", "Ser", "CONTAINS")
    edges = edges.union(edge(s.filter("s_nationkey > 1"), "s_nationkey", "s_suppkey", "Ser", "Fea", "HAS_FEATURE"))
    sp = p.select((F.col("p_partkey") % 90).alias("s"), "p_partkey", "p_brand", "p_size", (F.col("p_partkey") - F.col("p_partkey") % 2 * 2 + 1).alias("mate"), (F.col("p_partkey") + 7).alias("next"))
    edges = edges.union(edge(sp, "s", "p_partkey", "Fea", "Flo", "HAS_FLOW"))
    edges = edges.union(edge(sp.filter("p_size < 5"), "p_partkey", "p_brand", "Flo", "Dev", "REQUIRES_CONDITION", F.col("p_size").cast("string")))
    edges = edges.union(edge(sp.filter("p_size = 7"), "p_partkey", "p_brand", "Flo", "Dev", "EXCLUDES_CONDITION", F.lit("x")))
    edges = edges.union(edge(sp, "p_partkey", "mate", "Flo", "Flo", "IS_DEPENDENT_ON")).union(edge(sp, "p_partkey", "next", "Flo", "Flo", "IS_DEPENDENT_ON"))
    return G.Graph(nodes, edges)


view("flow", "SELECT p_partkey AS id, p_name || ' ' || p_partkey AS name, p_partkey % 90 AS f, p_partkey % 50 AS num, CASE WHEN p_size > 10 THEN p_type END AS type, p_size % 2 AS auto, p_brand AS brand, p_size AS size FROM part")
view("gfeat", "SELECT s_suppkey f, s_name, n_nationkey, n_name, r_name, r_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_nationkey > 1")


@check("gra_schema", """
SELECT label, n, kind FROM (SELECT 'ProductLine' label, count(*) n, 'node' kind FROM region UNION ALL SELECT 'Service', count(*), 'node' FROM nation UNION ALL SELECT 'Feature', count(*), 'node' FROM supplier UNION ALL SELECT 'Flow', count(*), 'node' FROM part
UNION ALL SELECT 'DeviceCondition', count(DISTINCT p_brand), 'node' FROM part UNION ALL SELECT 'CONTAINS', count(*), 'edge' FROM nation UNION ALL SELECT 'HAS_FEATURE', count(*), 'edge' FROM gfeat UNION ALL SELECT 'HAS_FLOW', count(*), 'edge' FROM part
UNION ALL SELECT 'REQUIRES_CONDITION', count(*), 'edge' FROM part WHERE p_size < 5 UNION ALL SELECT 'EXCLUDES_CONDITION', count(*), 'edge' FROM part WHERE p_size = 7 UNION ALL SELECT 'IS_DEPENDENT_ON', 2 * count(*), 'edge' FROM part) WHERE n > 0""")
def _(spark, d):
    g = graph(spark, d)
    return G.graph_schema(g).select("label", "n", "kind")


@check("gra_services_per_line", "SELECT r_name AS line_name, count(n_nationkey) AS services FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, d):
    return G.services_per_line(graph(spark, d))


@check("gra_features_per_service", "SELECT n.n_name AS svc_name, count(DISTINCT g.f) AS features, count(DISTINCT flow.id) AS flows FROM nation n LEFT JOIN gfeat g ON g.n_nationkey = n.n_nationkey LEFT JOIN flow ON flow.f = g.f GROUP BY 1")
def _(spark, d):
    return G.features_per_service(graph(spark, d))


@check("gra_flows_per_feature", "SELECT s_name AS feat_name, n_name AS svc_name, count(flow.id) AS flows FROM gfeat g LEFT JOIN flow ON flow.f = g.f GROUP BY 1, 2")
def _(spark, d):
    return G.flows_per_feature(graph(spark, d))


view("dep", "SELECT p_partkey a, p_partkey - p_partkey % 2 * 2 + 1 AS b FROM part UNION ALL SELECT p_partkey, p_partkey + 7 FROM part")


@check("gra_symmetric_edges", "SELECT (SELECT count(*) FROM dep) AS edges, (SELECT count(*) FROM (SELECT DISTINCT x.a, x.b FROM dep x JOIN dep y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b)) AS symmetric_pairs")
def _(spark, d):
    return G.symmetric_edges(graph(spark, d), "IS_DEPENDENT_ON")


@check("gra_search", """
SELECT label, name, snippet FROM (SELECT 'Flow' AS label, name, brand AS snippet FROM flow WHERE contains(lower(name), 'ring 1') OR contains(lower(brand), 'ring 1')) ORDER BY label, name LIMIT 25""")
def _(spark, d):
    return G.graph_search(graph(spark, d).nodes, "RING 1", 25)


@check("gra_feature_detail", "SELECT s_name AS feat_name, n_name AS svc_name, (SELECT count(*) FROM flow WHERE flow.f = g.f) AS flows, r_name || ' (R' || r_regionkey || ')' AS product_lines FROM gfeat g WHERE contains(lower(s_name), '00000001')")
def _(spark, d):
    return G.feature_detail(graph(spark, d), "00000001").withColumn("product_lines", F.array_join("product_lines", ","))


@check("gra_list_flows", """
SELECT s_name AS feat_name, num AS flow_number, name AS flow_name, type AS flow_type, cast(auto AS varchar) AS flow_automated FROM flow JOIN supplier ON f = s_suppkey WHERE contains(lower(s_name), '0000001') AND lower(type) = 'economy' AND auto = 1
ORDER BY 1, 2, 3 LIMIT 100""")
def _(spark, d):
    return G.list_flows(graph(spark, d), "0000001", "Economy", 1, 100)


view("oneflow", "SELECT * FROM flow WHERE num = 3 ORDER BY num, name LIMIT 1")


@check("gra_flow_detail", """
SELECT oneflow.name AS flow_name, 'IS_DEPENDENT_ON' AS relation, o.name AS other FROM oneflow JOIN (SELECT a, b FROM dep UNION SELECT b, a FROM dep) x ON x.a = oneflow.id JOIN flow o ON o.id = x.b
UNION SELECT oneflow.name, CASE WHEN size < 5 THEN 'REQUIRES_CONDITION' ELSE 'EXCLUDES_CONDITION' END, brand FROM oneflow WHERE size < 5 OR size = 7""")
def _(spark, d):
    return G.flow_detail(graph(spark, d), number=3)


@check("gra_applicable_flows", "SELECT n_name AS svc_name, s_name AS feat_name, name AS flow_name FROM gfeat g JOIN flow ON flow.f = g.f WHERE r_regionkey = 1 AND g.f % 3 = 1 ORDER BY 1, 2, 3 LIMIT 200")
def _(spark, d):
    return G.applicable_flows(graph(spark, d), "R1", 200)


@check("gra_features_not_applicable", "SELECT n_name AS svc_name, s_name AS feat_name FROM gfeat WHERE r_regionkey = 1 AND f % 3 <> 1")
def _(spark, d):
    return G.features_not_applicable(graph(spark, d), "R1")


@check("gra_list_conditions", "SELECT brand AS cond_name, 'brand' AS cond_category, count(*) FILTER (WHERE size < 5) AS required_by, count(*) FILTER (WHERE size = 7) AS excluded_by FROM flow GROUP BY 1")
def _(spark, d):
    return G.list_conditions(graph(spark, d), "BRAND")


@check("gra_flows_for_condition", """
SELECT brand AS cond_name, CASE WHEN size < 5 THEN 'REQUIRES_CONDITION' ELSE 'EXCLUDES_CONDITION' END AS relation, CASE WHEN size < 5 THEN cast(size AS varchar) ELSE 'x' END AS evidence, s_name AS feat_name, name AS flow_name
FROM flow JOIN supplier ON f = s_suppkey WHERE contains(lower(brand), 'brand#1') AND (size < 5 OR size = 7)""")
def _(spark, d):
    return G.flows_for_condition(graph(spark, d), "brand#1")


@check("gra_coverage_gaps", """
SELECT 'feature_without_flows' AS gap, s_name AS name, '' AS detail FROM gfeat g WHERE g.f NOT IN (SELECT f FROM flow) UNION ALL SELECT 'flow_not_automated', name, '' FROM flow WHERE auto = 0
UNION ALL SELECT 'flow_missing_properties', name, CASE WHEN type IS NULL THEN 'flow_type,flow_skill_path' ELSE 'flow_skill_path' END FROM flow UNION ALL SELECT 'flow_without_conditions', name, '' FROM flow WHERE NOT (size < 5 OR size = 7)
UNION ALL SELECT 'unused_condition', brand, '' FROM flow GROUP BY brand HAVING count(*) FILTER (WHERE size < 5 OR size = 7) = 0 UNION ALL SELECT 'service_without_features', n_name, '' FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM gfeat)""")
def _(spark, d):
    return G.coverage_gaps(graph(spark, d))


@check("gra_skill_paths", "SELECT DISTINCT 'Flow' AS kind, name, cast(NULL AS varchar) AS path, s_name AS parent FROM flow JOIN supplier ON f = s_suppkey")
def _(spark, d):
    return G.skill_paths(graph(spark, d))
