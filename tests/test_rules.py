"""Patterns, verdicts, metrics and drives on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tripline.plans import boots as B
from tripline.plans import metrics as M
from tripline.plans import patterns as P
from tripline.plans import registry as R
from tripline.plans import verdicts as V

T = "1793148914428: 2061: "
SAMPLES = [
    ("syslog_uptime", "syslogs", T + "SYSLOG_MON: I: 6030: 6030: uptime 26.4 s < 60 s: starting", {"s": "26.4"}),
    ("pwr_uptime", "power_mon", T + "PWR: I: 1: 2: check_uptime max_uptime 172800 uptime_secs 45", {"s": "45"}),
    ("uptime_long", "power_mon", T + "PWR: I: 1: 2: check_uptime max_uptime 172800 uptime_secs 174609", {"max": "172800", "s": "174609"}),
    ("wakeup_reason", "apm", T + "DEVB3: I: 1: 2: WAKEUP_REASON::POWER_UP -- RESET_REASON::POWER_DOWN:X", {"wakeup": ":POWER_UP", "reset": ":POWER_DOWN:X"}),
    ("shutdown_reason", "power_mon", T + "PWR: C: 1: 2: shutdown reason ::@ time 1793144189001\tShuttingdown because of SHUTDOWN_FOR_IGNITION_OFF \t::",
     {"start": "1793144189001", "mode": "Shuttingdown", "reason": "SHUTDOWN_FOR_IGNITION_OFF"}),
    ("sm_update_time", "service_mon", T + "SM: E: 1: 2: Service error: updateEngine : 1793107036849 : 210003 : -1 : 4.6.17.rc.1 | updateTime: 71.914 : 38", {"version": "4.6.17.rc.1", "s": "71.914"}),
    ("band_ext", "conn_mgr", T + "X: I: 1: 2: LTE band pref ext from device bits_65_128 is 42", {"range": "65_128", "mask": "42"}),
    ("pushed_file", "circ_buff", T + "CB: I: 1: 2: Pushed file 0_trip1_part2_33.8_-117.9_0.0_1793144282968_y.mp4 with size 38537408 to file_size_check_queue",
     {"cam": "0", "name": "trip1_part2_33.8_-117.9_0.0_1793144282968_y", "ext": ".mp4", "size": "38537408"}),
    ("frame_count", "cam_rec", T + "CAM3: I: 1: 2: Frame count received: 150", {"cam": "3", "frames": "150"}),
    ("storage_info", "deviceHealthClient", 'x - Received message: {"storage_info": {"t": 1, "no_of_hq": {"0": "216/7694.6"}, "no_of_obs": "7594/1"}}', {"hq": '"0": "216/7694.6"', "obs": "7594/1"}),
    ("lla_hs_result", "unifieduploader", T + 'UPL: I: 1: 2: x "lla_2580cfa0a3204cefbac94ea93ae879a0_0": {"uploadstart": 1793149278811, "uploadend": 1793149279280, "status": "pass"',
     {"uuid": "2580cfa0a3204cefbac94ea93ae879a0", "n": "0", "start": "1793149278811", "end": "1793149279280", "status": "pass"}),
    ("hc_response", "health_central", T + 'UPLDCLIENT: I: 1: 2: Upload response (HTTP 200): {"response":true,"missingPayloads":[{"a"', {"thr": "1: 2", "http": "200", "missing": "{"}),
]


def test_registry_samples(spark):
    lines = spark.createDataFrame([("d", s, i, l) for i, (_, s, l, _) in enumerate(SAMPLES)], "device string, service string, ts bigint, line string")
    twice = lines.unionByName(lines)  # plain and critical copies of a line
    got = {(r["ts"], r["key"]): r["groups"] for r in P.extract_hits(twice, R.LINES).collect()}
    for i, (key, _, _, groups) in enumerate(SAMPLES):
        assert got[(i, key)] == groups, key
    assert len(got) == len(SAMPLES)


def test_registry_is_whole():
    assert len(R.LINES) == len({p.key for p in R.LINES}) >= 85
    assert len(R.metrics()) == len({m for _, m, _, _ in R.metrics()}) >= 170
    known = {m for _, m, _, _ in R.metrics()}
    assert {b[0] for b in R.baselines()} <= known


STEPS = [("t", 1, "any", "present", 1), ("t", 2, "all", "present", 2), ("t", 3, "any", "absent", 1)]


def judge(spark, hits, steps=STEPS):
    h = spark.createDataFrame([("d", 1, "t", s, a, ts) for s, a, ts in hits] or [("x", 1, "t", 1, 0, 1)],
                              "device string, boot_index int, test string, step_no int, alt int, ts bigint")
    s = spark.createDataFrame(steps, "test string, step_no int, mode string, expect string, alts int")
    b = spark.createDataFrame([("d", 1, 0)], "device string, boot_index int, start bigint")
    return V.evaluate_steps(h, s, b).first()


@pytest.mark.parametrize("hits, want, reason", [
    ([(1, 0, 5), (2, 0, 6), (2, 1, 7)], "PASS", "in order"),
    ([(1, 0, 5), (2, 0, 4), (2, 1, 7)], "FAIL", "before the previous step"),
    ([(1, 0, 5), (2, 0, 6)], "FAIL", "not found"),
    ([(1, 0, 5), (2, 0, 6), (2, 1, 7), (3, 0, 7)], "FAIL", "expected absent"),
    ([(1, 0, 5), (2, 0, 6), (2, 1, 7), (3, 0, 6)], "PASS", "in order"),
    ([(3, 0, 6)], "NOT_TRIGGERED", "None"),
    ([], "NOT_TRIGGERED", "None"),
])
def test_step_verdicts(spark, hits, want, reason):
    r = judge(spark, hits)
    assert r["verdict"] == want and reason in r["reason"]


def test_informational_steps(spark):
    assert judge(spark, [(1, 0, 3)], [("t", 1, "any", "info", 1)])["verdict"] == "PASS"  # the only step, so required
    both = [("t", 1, "any", "info", 1), ("t", 2, "any", "present", 1)]
    assert judge(spark, [(2, 0, 3)], both)["verdict"] == "PASS"


def test_bands(spark):
    hits = spark.createDataFrame([("d", "band_mask", 5, {"mask": "300080a"}), ("d", "band_ext", 6, {"range": "65_128", "mask": "8000000000000002"})],
                                 "device string, key string, ts bigint, groups map<string,string>")
    boots = spark.createDataFrame([("d", 1, 0, None)], "device string, boot_index int, eff_start bigint, end bigint")
    assert M.bands(hits, boots).first()["text"] == "B2,B4,B12,B25,B26,B66,B128"


def test_medium_drives_exclude_the_edges(spark):
    cols = ("boots", "drive_minutes", "minutes_source", "low_power", "udid", "duration_min", "low_power_wakeup", "session_issue", "repeated_udid",
            "service_starts", "crank_ons", "max_wakeups", "runs_short", "runs_improper")
    rows = [("d", 1, m, "udid", False, 1, m, 0, False, False, 1, 1, None, 0, 0) for m in (5, 6, 7, 14, 15, 16)]
    df = spark.createDataFrame(rows, "device string, boots int, drive_minutes int, minutes_source string, low_power boolean, udid int, duration_min int, "
                               "low_power_wakeup int, session_issue boolean, repeated_udid boolean, service_starts int, crank_ons int, max_wakeups int, "
                               "runs_short int, runs_improper int")
    r = B.drive_rollup(df).first()
    assert len(cols) == 14 and (r["drives_short"], r["drives_medium"], r["drives"]) == (1, 2, 6)


def test_sums_never_go_below_zero(spark):
    s = spark.createDataFrame([("d", "m", 1, -1.0, None), ("d", "m", 2, -2.0, None)], "device string, metric string, ts bigint, value double, text string")
    reg = spark.createDataFrame([("m", "count", "sum")], "metric string, unit string, agg string")
    assert M.metric_agg(s, reg, ["device"]).first()["value"] == 0.0


def test_baseline_override(spark):
    v = spark.createDataFrame([("down_cam_crash", "a", 50.0), ("down_cam_crash", "b", 50.0), ("hd_fps_cam0", "a", 20.0)], "metric string, family string, value double")
    o = spark.createDataFrame([("down_cam_crash", "b", None, 82.0)], "metric string, family string, lo double, hi double")
    got = {(r["metric"], r["family"]): r["outside"] for r in M.check_baselines(v, M.baseline_table(v), o).collect()}
    assert got == {("down_cam_crash", "a"): True, ("down_cam_crash", "b"): False, ("hd_fps_cam0", "a"): True}


def test_predictor_loads_per_task_and_keeps_nulls(spark):
    from tripline.plans.classify import predict_with

    df = spark.createDataFrame([("a",), ("bb",), (None,), ("a",)], "description string")
    got = sorted((r["description"] or "", r["predicted_type"]) for r in predict_with(df, lambda: (lambda ts: [str(len(t)) for t in ts])).collect())
    assert got == [("", None), ("a", "1"), ("a", "1"), ("bb", "2")]


def test_safe_select(spark):
    from tripline.plans.adhoc import safe_select

    spark.range(5000).createOrReplaceTempView("numbers")
    assert safe_select(spark, "select id from numbers", 1000).count() == 1000
    assert safe_select(spark, " SELECT id, 'failed to load; update' as t FROM numbers", 1).count() == 1
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            safe_select(spark, "select id from numbers", limit)
    for bad in ("drop table numbers", "select 1; select 2", "insert into numbers values (1)", "with a as (select 1) select * from a", "select delete from x"):
        with pytest.raises(ValueError):
            safe_select(spark, bad, 10)
    assert F.lit(1) is not None


def hits_of(spark, rows):
    return spark.createDataFrame([("d", k, t, g) for k, t, g in rows], "device string, key string, ts bigint, groups map<string,string>")


def values(df):
    return sorted((r["metric"], r["ts"], r["value"]) for r in df.collect())


BOOTS = "device string, boot_index int, eff_start bigint, end bigint, version string, svc_start bigint, anchor bigint"


def test_low_latency_alert(spark):
    key = "trip1_part2_1.0_2.0_0.0_1700000000000_y"
    h = hits_of(spark, [
        ("lla_msg_send", 1700000010000, {"key": key, "uuid": "u", "end": "1700000009000"}), ("ndc_lla_message", 1700000010100, {}),
        ("lla_hs_add", 1700000010200, {"uuid": "u", "n": "0", "add": "1700000010150"}),
        ("lla_hs_result", 1700000012000, {"uuid": "u", "n": "0", "start": "1700000010300", "end": "1700000011000", "status": "fail"}),
        ("lla_hs_result", 1700000016000, {"uuid": "u", "n": "1", "start": "1700000015000", "end": "1700000016000", "status": "pass"})])
    got = {m: v for m, _, v in values(M.low_latency(h))}
    assert got == {"lla_rec_start": 10.0, "lla_ndc_create": 0.1, "lla_ndc_notify": 0.15, "lla_api_trigger": 0.3, "lla_api_ok": 6.0,
                   "lla_total": 7.0, "lla_retry_n": 1.0, "lla_retry_s": 5.0}


def test_cyclic_restart(spark):
    h = hits_of(spark, [("uptime_long", 900_000, {"s": "180000"}), ("soak_done", 910_000, {}), ("soak_done", 2_000_000, {}),
                        ("shutdown_reason", 950_000, {"reason": "SHUTDOWN_FOR_CYCLIC_REBOOT", "mode": "restarting"})])
    assert values(M.cyclic_uptime(h)) == [("cyclic_reboot_uptime", 910_000, 50.0)]


def test_power_cut_and_watchdog(spark):
    h = hits_of(spark, [("alive", 50_000, {"svc": "svc"}), ("ndc_system_uptime", 120_000, {"s": "20"}),
                        ("sm_prev_shutdown", 121_000, {"reason": ":SHUTDOWN_STATE:POWER_DOWN"}), ("first_frame", 130_000, {"epoch": "130000"}),
                        ("alive", 400_000, {"svc": "svc"}), ("ndc_system_uptime", 520_000, {"s": "20"}), ("pm_start", 525_000, {}),
                        ("wakeup_reason", 526_000, {"wakeup": "X", "reset": "TEGRA_WATCHDOG"})])
    boots = spark.createDataFrame([], BOOTS)
    powers = M.power_ons(h)
    units = M.with_units(h, powers, boots)
    assert values(M.abrupt_power(units, h)) == [("down_abrupt", 130_000, 80.0), ("down_abrupt_reboot", 130_000, 30.0)]
    assert values(M.watchdog(units, powers, M.unit_reasons(units), h)) == [("wdt_reboot_time", 525_000, 125.0), ("wdt_resets", 500_000, 1.0)]


def test_update_outage_and_package(spark):
    h = hits_of(spark, [("updater_start", 1_000, {}), ("conn_exit", 5_000, {}), ("alive", 7_000, {"svc": "conn_mgr"}), ("data_connected", 60_000, {}),
                        ("ota_target_check", 100_000, {"version": "v2"}), ("ota_size", 150_000, {"bytes": "5000000"}), ("ota_size", 900_000, {"bytes": "1"})])
    assert values(M.update_outage(h)) == [("down_lte_ota", 60_000, 53.0)]
    boots = spark.createDataFrame([("d", 1, 0, 200_000, "v1", 5, None), ("d", 2, 200_000, None, "v2", 230_000, 201_000)], BOOTS)
    assert values(M.package_sizes(h, boots)) == [("ota_size", 200_000, 5.0)]
    assert values(M.boot_start(boots)) == [("boot_power_on", 200_000, 29.0)]


def walk(hits, steps, cursor):
    """Verdict of one test by the plain rule over all hits."""
    required, results = any(e == "present" for *_, e, _ in steps), []
    for _, no, mode, expect, alts in steps:
        nexts = [min([t for s, a, t in hits if (s, a) == (no, alt) and t >= cursor], default=None) for alt in range(alts)]
        ever = [any((s, a) == (no, alt) for s, a, _ in hits) for alt in range(alts)]
        found = [t for t in nexts if t is not None]
        if expect == "absent":
            results.append((expect, "FAIL" if found else "PASS"))
        elif found and (mode != "all" or len(found) == alts):
            cursor = max(found) if mode == "all" else min(found)
            results.append((expect, "PASS"))
        else:
            first = next(i for i, t in enumerate(nexts) if t is None)
            results.append((expect, "OUT_OF_ORDER" if ever[first] else "NOT_FOUND"))
    need = [(e, s) for e, s in results if e != "info" or not required]
    positive = [s for e, s in need if e != "absent"]
    if positive and all(s == "NOT_FOUND" for s in positive):
        return "NOT_TRIGGERED"
    return "PASS" if all(s == "PASS" for _, s in need) else "FAIL"


def test_thinned_hits_give_the_same_verdicts(spark):
    import random

    r = random.Random(5)
    steps = [("t", 1, "any", "present", 2), ("t", 2, "all", "present", 2), ("t", 3, "any", "absent", 1), ("t", 4, "any", "present", 1)]
    rows, want = [], {}
    for boot in range(150):
        # long runs of one pattern, equal times and gaps
        hits, t = [], 10
        for _ in range(r.randrange(12)):
            s, a = r.choice([(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (4, 0)])
            for _ in range(r.choice((1, 1, 6))):
                hits.append((s, a, t))
                t += r.choice((0, 1, 5))
        rows += [("d", boot, "t", s, a, x) for s, a, x in hits]
        want[boot] = walk(hits, steps, 0)
    h = spark.createDataFrame(rows, "device string, boot_index int, test string, step_no int, alt int, ts bigint")
    s = spark.createDataFrame(steps, "test string, step_no int, mode string, expect string, alts int")
    b = spark.createDataFrame([("d", i, 0) for i in want], "device string, boot_index int, start bigint")
    assert V.thin_hits(h).count() < h.distinct().count()
    assert {x["boot_index"]: x["verdict"] for x in V.evaluate_steps(h, s, b).collect()} == want
    assert len(set(want.values())) == 3


@pytest.mark.parametrize("device_type", ["a", "b", None])
def test_steps_for_other_devices_are_left_out(spark, device_type):
    import random

    r = random.Random(3)
    steps = [("t", 1, "any", "present", 1, ["a"]), ("t", 2, "any", "info", 1, []), ("t", 3, "any", "present", 1, ["b"]), ("t", 4, "any", "absent", 1, ["b"]), ("t", 5, "any", "present", 1, None),
             ("info", 1, "any", "info", 1, None), ("info", 2, "any", "present", 1, ["b"]), ("only a", 1, "any", "present", 1, ["a"])]
    rows, want = [], {}
    for boot in range(60):
        for test in ("t", "info", "only a"):
            mine = [s for s in steps if s[0] == test]
            hits = sorted((r.randrange(30), r.choice(mine)[1]) for _ in range(r.randrange(7)))
            rows += [("d", boot, test, s, 0, ts) for ts, s in hits]
            left = [s for s in mine if not s[5] or device_type is None or device_type in s[5]]
            want[boot, test] = walk([(s, 0, ts) for ts, s in hits], [s[:5] for s in left], 0) if left else "NOT_APPLICABLE"
    h = spark.createDataFrame(rows, "device string, boot_index int, test string, step_no int, alt int, ts bigint")
    s = spark.createDataFrame(steps, "test string, step_no int, mode string, expect string, alts int, device_types array<string>")
    b = spark.createDataFrame([("d", i, 0, device_type) for i in range(60)], "device string, boot_index int, start bigint, device_type string")
    got = V.evaluate_steps(h, s, b).collect()
    assert {(x["boot_index"], x["test"]): x["verdict"] for x in got} == want
    assert all(x["reason"] == "Not run on b" for x in got if x["verdict"] == "NOT_APPLICABLE")
    # one window over everything judges as no window does, but for tests that never started
    wins = spark.createDataFrame([("d", i, 0, None) for i in range(60)], "device string, boot_index int, start bigint, end bigint")
    inside = {(x["boot_index"], x["test"]): x["verdict"] for x in V.evaluate_in_windows(h, s, b, wins).collect()}
    for key, verdict in want.items():
        assert inside[key] == verdict or (inside[key] == "CONDITION_NOT_MET" and verdict in ("PASS", "FAIL"))


def test_hours_beyond_the_limit_raise(spark):
    from tripline.plans.observations import window_filter

    df = spark.createDataFrame([(1,)], "id int").withColumn("start_time", F.current_timestamp())
    for hours in (0, 2161, 9999):
        with pytest.raises(ValueError):
            window_filter(df, hours=hours)
    assert window_filter(df, hours=2160).count() == 1
