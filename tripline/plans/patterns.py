"""Log lines against pattern registries (TXT-09 .. TXT-16).

A registry is a short fixed list.  Lines are matched where they are read and nothing is
shuffled before the hits exist.  Tests are ordered cheap first: service, literal text,
regular expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.functions import text as X
from tripline.operators.asof import asof_join
from tripline.operators.lists import SEGMENT, segmented_lists
from tripline.operators.timeline import scan


@dataclass(frozen=True)
class Pattern:
    """A kind of line: services, literals (any of them), regex and the names of its groups."""

    key: str
    services: tuple[str, ...]
    literals: tuple[str, ...]
    regex: str
    groups: tuple[str, ...] = ()
    critical: bool = False


def _any(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _by_service(patterns: Sequence[Pattern], cell: Callable[[Pattern], Column]) -> Column:
    """One array of cells per line: only the patterns of the line's service are tried."""
    services: dict[str, list[Pattern]] = {}
    for p in patterns:
        for s in p.services:
            services.setdefault(s, []).append(p)
    out = None
    for s, ps in services.items():
        cells = F.array(*[cell(p) for p in ps])
        test = F.col("service") == s
        out = F.when(test, cells) if out is None else out.when(test, cells)
    return out


def match_lines(lines: DataFrame, patterns: Sequence[Pattern], line: str = "line") -> DataFrame:
    """TXT-10: lines with the keys of all patterns they match, ignoring case."""
    low = F.lower(F.col(line))

    def cell(p: Pattern) -> Column:
        return F.when(_any(F.contains(low, F.lit(x.lower())) for x in p.literals) & F.col(line).rlike("(?i)" + p.regex), F.lit(p.key))

    known = sorted({s for p in patterns for s in p.services})
    found = lines.filter(F.col("service").isin(*known)).withColumn("keys", F.array_compact(_by_service(patterns, cell)))
    return found.filter(F.size("keys") > 0)


def pattern_table(spark: SparkSession, patterns: Sequence[Pattern]) -> DataFrame:
    """The registry as rows, one per service and literal text."""
    rows = [(s, p.key, x, p.regex, list(p.groups)) for p in patterns for s in p.services for x in p.literals]
    return spark.createDataFrame(rows, "service string, key string, literal string, regex string, names array<string>")


def extract_hits(lines: DataFrame, patterns: Sequence[Pattern], line: str = "line") -> DataFrame:
    """TXT-11: (device, key, ts, groups) of every registry match; lines logged twice count once.

    The registry is a fixed list of about a hundred rows, so it is broadcast: every line meets
    the patterns of its service inside the join, which tests the literal text before a row
    exists; only then the regular expression runs.  (As one expression the registry outgrows a
    generated method.)  Groups that took no part are left out of the map.
    """
    table = pattern_table(lines.sparkSession, patterns)
    rows = lines.select("service", "device", "ts", F.col(line).alias("__line"))
    met = rows.join(F.broadcast(table), (rows["service"] == table["service"]) & F.contains("__line", "literal"))
    met = met.filter(F.expr("__line rlike regex"))
    values = F.when(F.size("names") > 0, F.expr(
        "transform(sequence(1, size(names)), i -> regexp_extract(__line, regex, i))")).otherwise(F.array().cast("array<string>"))
    # Repeats are dropped while the groups are plain arrays, which can be compared
    hits = met.select("device", "ts", "key", "names", values.alias("values")).dropDuplicates(["device", "ts", "key", "values"])
    pairs = F.filter(F.arrays_zip("names", "values"), lambda e: e["values"] != "")
    return hits.select("device", "key", "ts", F.map_from_entries(pairs).alias("groups"))


# The two error line formats
SERVICE_ERROR = r"^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3}) - (.+?) - ERROR\s* - (.*)$"
NATIVE_ERROR = r"^([0-9]{13}):\s*[0-9]+:\s*([^:]+): E: [0-9]+: [0-9]+: (.*)$"


def error_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """TXT-09: error lines of both formats with message and time text; native messages name their tag."""
    t = F.col(line)
    py, native = t.rlike(SERVICE_ERROR), t.rlike(NATIVE_ERROR)
    return lines.filter(py | native).withColumns({
        "format": F.when(py, "service").otherwise("native"),
        "message": F.when(py, F.regexp_extract(t, SERVICE_ERROR, 3)).otherwise(
            F.concat(F.regexp_extract(t, NATIVE_ERROR, 2), F.lit(": "), F.regexp_extract(t, NATIVE_ERROR, 3))),
        "time_text": F.when(py, F.regexp_extract(t, SERVICE_ERROR, 1)).otherwise(F.regexp_extract(t, NATIVE_ERROR, 1)),
    })


def drop_noise(df: DataFrame, patterns: Sequence[str] = (), exclude: Sequence[str] = (), line: str = "line",
               file: str = "file") -> DataFrame:
    """FLT-06: lines without ignored patterns, from files without excluded texts in their name."""
    for p in patterns:
        df = df.filter(~F.coalesce(F.col(line).rlike(p), F.lit(False)))
    for x in exclude:
        df = df.filter(~F.contains(F.lower(file), F.lit(x.lower())))
    return df


def error_report(errors: DataFrame) -> DataFrame:
    """AGG-25: per masked message: count, raw variants, files, first example, last time."""
    return errors.groupBy(X.mask_tokens("message").alias("pattern")).agg(
        F.count(F.lit(1)).alias("occurrences"), F.countDistinct("message").alias("variants"),
        F.array_sort(F.collect_set("file")).alias("files"),
        F.min_by("message", F.struct("file", "line_no")).alias("example"), F.max("time_text").alias("last_seen"),
    ).orderBy(F.desc("occurrences"), "pattern")


def error_files(errors: DataFrame, size: int = SEGMENT) -> DataFrame:
    """AGG-25: the files of every pattern of the report, in parts of ``size``."""
    return segmented_lists(errors.select(X.mask_tokens("message").alias("pattern"), "file"), ["pattern"], "file", size, name="files")


def drop_known(report: DataFrame, known: DataFrame) -> DataFrame:
    """JOI-11: patterns not explained yet."""
    return report.join(known.select("pattern").distinct(), "pattern", "left_anti")


def skipped_known(report: DataFrame, known: DataFrame) -> DataFrame:
    """JOI-11: how many patterns and lines were left out as explained."""
    return report.join(known.select("pattern").distinct(), "pattern", "left_semi").agg(
        F.count(F.lit(1)).alias("patterns"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("lines"))


# ── line order ───────────────────────────────────────────────────────────────


def fill_ts(lines: DataFrame, by: Sequence[str] = ("file",), order: str = "line_no", ts: str = "ts",
            chunk: int = 100_000) -> DataFrame:
    """WIN-06: untimed continuation lines get the time of the line above, and its number as entry id.

    The line number is the timeline, so files are scanned in chunks of ``chunk`` lines.
    """
    stamp = F.when(F.col(ts).isNotNull(), F.struct(F.col(ts).alias("ts"), F.col(order).alias("entry")))
    out = scan(lines, by, order, last={"__s": stamp}, width_s=chunk // 1000)
    return out.withColumns({ts: F.col("__s.ts"), "entry": F.col("__s.entry")}).drop("__s")


def merge_timeline(lines: DataFrame, device: str = "device") -> DataFrame:
    """WIN-07: entries of all files of a device in time order; continuation lines join their entry."""
    filled = fill_ts(lines, [device, "file"]).filter(F.col("ts").isNotNull())
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    entries = filled.groupBy(device, "file", "entry", "ts").agg(
        F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))
    return entries.orderBy(device, "ts", "file", "entry")


def grep_context(lines: DataFrame, pattern: str, n: int = 3, m: int = 20, by: Sequence[str] = ("file",),
                 line: str = "line") -> DataFrame:
    """TOP-08: the first m (1 .. 50) matching lines in file order with n lines around each, and the total."""
    if not 1 <= m <= 50:
        raise ValueError("m must be 1 .. 50")
    hit = F.col(line).rlike("(?i)" + pattern)
    total = lines.filter(hit).agg(F.count(F.lit(1)))
    first = lines.filter(hit).orderBy(*by, "line_no").limit(m).select(*by, F.col("line_no").alias("match_no"))
    around = first.withColumn("line_no", F.explode(F.sequence(F.col("match_no") - n, F.col("match_no") + n)))
    return lines.join(F.broadcast(around), [*by, "line_no"]).withColumn("total_matches", total.scalar())


# ── typed lines ──────────────────────────────────────────────────────────────


def drive_events(lines: DataFrame) -> DataFrame:
    """TXT-13: typed drive and power events (device, kind, ts, uptime, a, b, text).

    ``record`` rows keep their six numbers in ``nums`` (udid, start, drive start / end and both
    clock jumps, a missing jump being the drive end).
    """
    t = F.col("line")
    f = X.native_fields("line")

    def num(p: str) -> Column:
        return F.regexp_extract(t, p, 1).try_cast("bigint")

    start, end = num(r'"drive_start": ([0-9]{1,13})'), num(r'"drive_end": ([0-9]{1,13})')

    def jump(name: str) -> Column:
        return F.coalesce(F.nullif(num(f'"{name}": ([0-9]{{1,13}})'), F.lit(0)), end)

    session = F.get(F.split(F.regexp_extract(t, r"creating folder for session (\S+)", 1), "_"), F.lit(6)).try_cast("bigint")
    stored = F.get(F.split(F.regexp_extract(t, r"Found no entry with NAME (0_trip\S*_y\.mp4)\.", 1), "_"),
                   F.lit(6)).try_cast("bigint")
    reason = F.btrim(F.regexp_extract(t, r"previous_shutdown_reason\s*:?\s*(\S+)", 1), F.lit(":"))
    udid = num(r"udid_node\.udid ([0-9]{1,6})")
    none, blank = F.lit(None).cast("bigint"), F.lit(None).cast("string")

    def row(kind: str, service: str, test: Column, ts: Column = f["ts"], a: Column = none, b: Column = none,
            text: Column = blank, nums: Column | None = None) -> Column:
        empty = F.lit(None).cast("array<bigint>")
        return F.when((F.col("service") == service) & test & ts.isNotNull(), F.struct(
            F.lit(kind).alias("kind"), ts.alias("ts"), f["uptime"].alias("uptime"), a.alias("a"), b.alias("b"),
            text.alias("text"), (empty if nums is None else nums).alias("nums")))

    low = r"lowpower_wakeups\s+([0-9]+)\s*<\s*\S*max_lowpower_wakeups\s+([0-9]+)"
    rows = F.array(
        row("record", "time_sync", F.contains(t, F.lit("udid_node.index")) & udid.isNotNull() & start.isNotNull()
            & end.isNotNull(), nums=F.array(udid, f["ts"] - f["uptime"], start, end, jump("rtc_jump_from"),
                                            jump("rtc_jump_to"))),
        row("pm_start", "power_mon", F.contains(t, F.lit("STARTING POWER MONITOR"))),
        row("pm_stop", "power_mon", F.contains(t, F.lit("Inside sync_all"))),
        row("crank", "power_mon", t.rlike("crank voltage state changed [01]"),
            a=num("crank voltage state changed ([01])")),
        row("wakeup", "power_mon", t.rlike(low), a=F.regexp_extract(t, low, 1).try_cast("bigint"),
            b=F.regexp_extract(t, low, 2).try_cast("bigint")),
        row("shutdown", "power_mon", F.contains(t, F.lit("previous_shutdown_reason")),
            text=F.when(reason == "", "NA").otherwise(reason)),
        row("session_created", "ndcentral", session.isNotNull(), ts=session),
        row("session_available", "circ_buff", stored.isNotNull(), ts=stored),
    )
    hits = lines.withColumn("e", F.explode(F.filter(rows, lambda r: r.isNotNull())))
    return hits.select("device", "e.*").dropDuplicates()


def run_ends(lines: DataFrame) -> DataFrame:
    """Last timed line of every power monitor run: before the next start line, or the file's last."""
    f = X.native_fields("line")
    timed = lines.filter(F.col("service") == "power_mon").select(
        "device", "file", "line_no", f["ts"].alias("ts"), f["uptime"].alias("uptime"),
        F.contains("line", F.lit("STARTING POWER MONITOR")).alias("starts")).filter(F.col("ts").isNotNull())
    nxt = scan(timed, ["device", "file"], "line_no", lead={"next_starts": "starts"}, width_s=100)
    return (nxt.filter(F.coalesce("next_starts", F.lit(True))).select("device", "ts", "uptime").dropDuplicates())


def version_events(lines: DataFrame, pattern: str = r"(?i)\bversion[ :=]+([0-9]+(?:\.[0-9A-Za-z_]+)+)") -> DataFrame:
    """TXT-15: firmware versions over time (device, ts, version)."""
    v = F.regexp_extract("line", pattern, 1)
    return (lines.filter(F.col("line").rlike(pattern)).select("device", "ts", v.alias("version"))
            .filter(F.col("ts").isNotNull()).dropDuplicates())


def evidence_lines(lines: DataFrame, keys: Sequence[str], generic: Sequence[str] = ()) -> DataFrame:
    """TXT-16: lines with ``key =`` or ``key :``; a generic one-word key counts only beside another key."""
    tests = [F.when(F.col("line").rlike(r"(?i)(?<![\w.])" + _quote(k) + r"\s*[=:]"), F.lit(k)) for k in keys]
    found = lines.withColumn("keys", F.filter(F.array(*tests), lambda k: k.isNotNull()))
    specific = F.exists("keys", lambda k: ~k.isin(*generic)) if generic else F.lit(True)
    return found.filter((F.size("keys") >= 2) | ((F.size("keys") == 1) & specific))


def _quote(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in text)


# ── API calls ────────────────────────────────────────────────────────────────

# Names of the calls by message number
API_NAMES = {
    1: "KEEP_ALIVE", 2: "VERSION_CHECK", 3: "UPLOAD_EVENTDATA", 4: "UPLOAD_ALLDATA", 5: "DOWNLOAD_OTA",
    6: "DOWNLOAD_STATUS", 7: "UPLOAD_LOGS", 8: "UPLOAD_VIDEOLIST", 9: "UPLOAD_VIDEO", 10: "UPLOAD_DEVICE_STATUS",
    11: "UPLOAD_PING_DATA", 12: "UPLOAD_FV_VIDEO", 13: "DRIVER_LOGIN", 14: "UPLOAD_VEHICLEDATA",
    15: "DEVICE_REGISTER", 16: "UPLOAD_OBSERVATIONS", 19: "UPLOAD_LLA", 20: "SECRET_REGISTER",
    21: "UPLOAD_CAN_DIAGNOSTICS", 22: "UPLOAD_DTC_REPORT", 23: "UPLOAD_DEVICE_ROOT_PASSWORD_CHANGE_API_EVENT_INFO",
    24: "HERE_OAUTH_TOKEN", 25: "PID_DOWNLOAD_STATUS", 26: "UPLOAD_CALIBRATION_VIDEO",
    27: "READ_DRIVER_LOGIN_STATUS", 28: "HEALTH_CENTRAL",
}
# Fixed values: (message, service, literal, pattern) of a call line
CALL_LINES = (
    (1, "keep_alive_manager", "keepaliveresponse", r"INFO - wget\s+-O \S*/keepaliveresponse\.txt"),
    (1, "power_mon", "keepalive command ::", r"^keepalive command ::"),
    (1, "power_mon", "/keep-alive/", r"^--\d{4}-\d\d-\d\d \d\d:\d\d:\d\d--\s+https?://\S+/keep-alive/"),
    (2, "otacheck", "Executing command: wget", r"Executing command: wget .*versioncheckresponse"),
    (5, "otacheck", "INFO - wget -O ", r"INFO - wget -O \S*/\.nddevice/\d[^/\s]*/[^/\s]+\.txt "),
    (6, "otacheck", "INFO - wget -O ", r"INFO - wget -O \S*/downloadresponse\.txt"),
    (6, "otacheck", "INFO - curl ", r"INFO - curl .*/download/version/"),
    (3, "unifieduploader", "Calling service: ", r"Calling service: \S+/upload/eventdata\b"),
    (7, "unifieduploader", "Calling service: ", r"Calling service: \S+/upload/logs\b"),
    (9, "unifieduploader", "Calling service: ", r"Calling service: \S+/upload/video/"),
    (16, "unifieduploader", "Calling service: ", r"Calling service: \S+/upload/observations\b"),
    (19, "unifieduploader", "Calling service: ", r"Calling service: \S+/upload/lla\b"),
    (8, "circ_buff", "URL @@ ", r"URL @@ \S+/upload/videolist"),
    (10, "health", "curl -X POST", r"curl -X POST .*/devices/\d+/\w+/status"),
    (11, "awsiot", "send_keepalive: POST", r"send_keepalive: POST \S+/upload/pingdata"),
    (13, "btfv", "Final Curl URL", r"Final Curl URL : \S+/upload/driverLogin\b"),
    (27, "btfv", "Final Curl URL", r"Final Curl URL : \S+/devices/driverLoginStatus/"),
    (28, "health_central", "Uploading component health to", r"Uploading component health to \S+/upload/component-health"),
)
# Endpoint pattern of a result line and its message, first match counts
ENDPOINTS = (
    (r"/keep-alive/", 1), (r"versioncheck", 2), (r"upload/eventdata\b", 3), (r"download/module/", 5),
    (r"download/version/", 6), (r"upload/logs\b", 7), (r"upload/videolist", 8), (r"upload/video/", 9),
    (r"devices/\d+/\w+/status", 10), (r"upload/pingdata", 11), (r"devices/driverLoginStatus", 27),
    (r"upload/driverLogin\b", 13), (r"upload/observations", 16), (r"upload/lla\b", 19), (r"upload/component-health", 28),
)
# Texts of transfer errors
CURL_ERRORS = {
    6: "no network: could not resolve host", 7: "could not connect", 28: "timeout", 35: "TLS error",
    52: "empty reply", 55: "send error", 56: "connection reset", 143: "killed",
}
NOT_REACHED = "not reached (power_mon reached_cloud 0)"


def endpoint_api(endpoint: Column) -> Column:
    """Message number of an endpoint: the first pattern it matches."""
    out = F.lit(None).cast("int")
    for rx, api in reversed(ENDPOINTS):
        out = F.when(endpoint.rlike(rx), F.lit(api)).otherwise(out)
    return out


def failure_reason(curl: Column, http: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in CURL_ERRORS.items() for x in (k, v)])
    named = F.try_element_at(names, curl)
    return F.when(curl != 0, F.concat(F.lit("curl "), curl.cast("string"), F.when(named.isNull(), "").otherwise(
        F.concat(F.lit(" ("), named, F.lit(")"))))).otherwise(
        F.concat(F.lit("HTTP "), F.coalesce(http.cast("string"), F.lit("None"))))


def api_events(lines: DataFrame) -> DataFrame:
    """TXT-14: call and result lines: (device, api, ts, kind, source, outcome, reason).

    A result is ok with transfer code 0 and an HTTP status in the 200s or none; a result line
    may carry its own time.
    """
    t, svc = F.col("line"), F.col("service")
    calls = [F.when((svc == s) & F.contains(t, F.lit(lit)) & t.rlike(rx), F.struct(
        F.lit(api).alias("api"), F.col("ts").alias("ts"), F.lit("call").alias("kind"),
        F.lit(s).alias("source"), F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("reason")))
        for api, s, lit, rx in CALL_LINES]

    def result(source: str, test: Column, api: Column, ts: Column, curl: Column, http: Column) -> Column:
        ok = (curl == 0) & (http.isNull() | http.between(200, 299))
        return F.when(test & api.isNotNull() & curl.isNotNull(), F.struct(
            api.alias("api"), ts.alias("ts"), F.lit("result").alias("kind"), F.lit(source).alias("source"),
            F.when(ok, "ok").otherwise("fail").alias("outcome"),
            F.when(~ok, failure_reason(curl, http)).alias("reason")))

    def field(name: str) -> Column:
        return F.regexp_extract(t, f"'{name}': '?([^',}}]*)", 1)

    own = field("ts").try_cast("double").cast("bigint")
    stats = result("hs", (svc == "health") & t.rlike(r"newMessage: \{.*'curl_code'"), endpoint_api(field("endpoint")),
                   F.coalesce(own, F.col("ts")), field("curl_code").try_cast("int"), field("http_code").try_cast("int"))
    hc = r"curl_health: svc=\S+ endpoint=(\S+) curl=([0-9]+) http=([0-9]+)"
    health = result("hc", svc.isin("unifieduploader", "circ_buff") & t.rlike(hc),
                    endpoint_api(F.regexp_extract(t, hc, 1)), F.col("ts"),
                    F.regexp_extract(t, hc, 2).try_cast("int"), F.regexp_extract(t, hc, 3).try_cast("int"))
    reached = r"response_string :.*: reached_cloud ([01])"
    got = F.regexp_extract(t, reached, 1) == "1"
    power = F.when((svc == "power_mon") & t.rlike(reached), F.struct(
        F.lit(1).alias("api"), F.col("ts").alias("ts"), F.lit("result").alias("kind"), F.lit("pm").alias("source"),
        F.when(got, "ok").otherwise("fail").alias("outcome"), F.when(~got, NOT_REACHED).alias("reason")))
    found = lines.withColumn("e", F.explode(F.filter(F.array(*calls, stats, health, power), lambda e: e.isNotNull())))
    return found.select("device", "e.*").filter(F.col("ts").isNotNull()).dropDuplicates()


def unconfirmed_calls(events: DataFrame, dup_ms: int = 1_000, late_ms: int = 120_000) -> DataFrame:
    """WIN-31: keep-alives left without a result.

    A call more than ``dup_ms`` after the pending one makes that one "sent", as does the end of
    the events; an answer at most ``late_ms`` later cancels it.
    """
    from tripline.operators.sequences import thin_events

    pm = events.filter((F.col("api") == 1) & F.col("source").isin("power_mon", "pm"))
    results = pm.filter("kind = 'result'").select("device", "ts").distinct()
    # Calls between two results compete; only those beyond the duplicate distance stand alone
    rows = pm.select("device", "ts", "kind").distinct().withColumn(
        "__res", F.when(F.col("kind") == "result", 1).otherwise(0))
    numbered = scan(rows, ["device"], "ts", ["__res"], total={"stretch": "__res"})
    calls = thin_events(numbered.filter("kind = 'call'").select("device", "stretch", "ts"), ["device", "stretch"], "ts", dup_ms)
    # The last pending call of a stretch is answered by the result that closes the stretch
    last = calls.groupBy("device", "stretch").agg(F.max("ts").alias("last_ts"))
    closed = numbered.filter("kind = 'result'").select("device", (F.col("stretch") - 1).alias("stretch")).withColumn("closed", F.lit(True))
    sent = (calls.join(last, ["device", "stretch"]).join(closed, ["device", "stretch"], "left")
            .filter((F.col("ts") < F.col("last_ts")) | F.col("closed").isNull()).select("device", "ts"))
    late = asof_join(sent, results.select("device", F.col("ts").alias("answer")), ["device"], "ts", "answer",
                     direction="forward", tolerance_ms=late_ms)
    return late.filter(F.col("answer").isNull()).drop("answer")
