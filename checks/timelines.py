"""As-of joins, pairing, sessions, interval algebra along device timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, view
from checks.views import ev, ms
from tripline.operators import asof as A
from tripline.operators import intervals as I
from tripline.operators import sequences as Q
from tripline.session import scratch

H = 3_600_000


def evm(spark, d):
    """events with ts in epoch ms"""
    e = ev(spark, d)
    return e.withColumn("t", ms("ts"))


view("evm", "SELECT *, epoch_us(ts) // 1000 AS t FROM ev")


def _sides(spark, d):
    e = evm(spark, d)
    left = e.filter("process_name = 'click'").select("device_id", "event_id", "t")
    right = e.filter("process_name = 'purchase'").select("device_id", F.col("t").alias("rt"), F.col("event_id").alias("rid"))
    return left, right


view("lft", "SELECT device_id, event_id, t FROM evm WHERE process_name = 'click'")
view("rgt", "SELECT device_id, t rt, event_id rid FROM evm WHERE process_name = 'purchase'")


@check("asof_backward", f"""
SELECT l.*, CASE WHEN t - rt <= {6 * H} THEN rid END AS rid FROM lft l ASOF LEFT JOIN rgt r ON l.device_id = r.device_id AND l.t >= r.rt""")
def _(spark, d):
    left, right = _sides(spark, d)
    return A.asof_join(left, right, ["device_id"], "t", "rt", tolerance_ms=6 * H).drop("rt")


@check("asof_forward", "SELECT l.*, rt, rid FROM lft l ASOF LEFT JOIN rgt r ON l.device_id = r.device_id AND l.t <= r.rt")
def _(spark, d):
    left, right = _sides(spark, d)
    return A.asof_join(left, right, ["device_id"], "t", "rt", direction="forward")


@check("asof_nearest", f"""
SELECT device_id, event_id, t, CASE WHEN least(abs(t - b), abs(f - t)) <= {12 * H} THEN CASE WHEN f IS NULL OR t - b <= f - t THEN bid ELSE fid END END AS rid
FROM (SELECT l.*, r.rt b, r.rid bid FROM lft l ASOF LEFT JOIN rgt r ON l.device_id = r.device_id AND l.t >= r.rt) x
JOIN (SELECT l.event_id, r.rt f, r.rid fid FROM lft l ASOF LEFT JOIN rgt r ON l.device_id = r.device_id AND l.t <= r.rt) y USING (event_id)""")
def _(spark, d):
    left, right = _sides(spark, d)
    return A.asof_join(left, right, ["device_id"], "t", "rt", direction="nearest", tolerance_ms=12 * H).drop("rt")


@check("asof_strict", "SELECT a.event_id, b.event_id AS rid FROM evm a ASOF LEFT JOIN evm b ON a.device_id = b.device_id AND a.t > b.t")
def _(spark, d):
    e = evm(spark, d)
    right = e.select("device_id", F.col("t").alias("rt"), F.col("event_id").alias("rid"))
    return A.asof_join(e.select("device_id", "event_id", "t"), right, ["device_id"], "t", "rt", allow_exact=False).select("event_id", "rid")


view("boots", """
SELECT device_id, t AS s, lead(t) OVER (PARTITION BY device_id ORDER BY t) AS e, row_number() OVER (PARTITION BY device_id ORDER BY t) AS n
FROM evm WHERE process_name = 'signup'""")


def boots(spark, d):
    from tripline.operators.timeline import scan

    s = evm(spark, d).filter("process_name = 'signup'").select("device_id", F.col("t").alias("start"), F.lit(1).alias("one"))
    return scan(s, ["device_id"], "start", lead={"end": "start"}, total={"n": "one"}).drop("one")


@check("join_assign_interval", "SELECT a.event_id, b.n FROM evm a LEFT JOIN boots b ON a.device_id = b.device_id AND a.t >= b.s AND (b.e IS NULL OR a.t < b.e)")
def _(spark, d):
    return A.assign_interval(evm(spark, d).select("device_id", "event_id", "t"), boots(spark, d), ["device_id"], "t").select("event_id", "n")


def _pairs_sql(agg: str) -> str:
    return f"""
SELECT device_id, pair, {agg}(s) AS start_ts, e AS end_ts FROM (SELECT l.device_id, l.pair, l.t s, r.t e FROM
  (SELECT device_id, k % 5 pair, t FROM evm WHERE process_name = 'click') l ASOF JOIN (SELECT device_id, k % 5 pair, t FROM evm WHERE process_name = 'purchase') r
  ON l.device_id = r.device_id AND l.pair = r.pair AND l.t <= r.t) GROUP BY 1, 2, 4"""


def _pairs(spark, d, keep):
    e = evm(spark, d).select("device_id", (F.col("k") % 5).alias("pair"), "t", "process_name")
    return A.pair_events(e.filter("process_name = 'click'"), e.filter("process_name = 'purchase'"), ["device_id"], "t", ["pair"], keep=keep)


@check("join_pair_first", _pairs_sql("min"))
def _(spark, d):
    return _pairs(spark, d, "first")


@check("join_pair_last", _pairs_sql("max"))
def _(spark, d):
    return _pairs(spark, d, "last")


@check("join_count_in_ranges", f"""
SELECT b.device_id, b.s AS start, b.n, count(*) FILTER (WHERE a.t BETWEEN b.s AND b.s + {6 * H}) + count(*) FILTER (WHERE a.t BETWEEN b.s + {12 * H} AND b.s + {24 * H}) AS hits
FROM boots b LEFT JOIN evm a ON a.device_id = b.device_id AND a.process_name = 'view' GROUP BY 1, 2, 3""")
def _(spark, d):
    b = boots(spark, d).drop("end").withColumns({"a1": F.col("start") + 6 * H, "b0": F.col("start") + 12 * H, "b1": F.col("start") + 24 * H})
    pts = evm(spark, d).filter("process_name = 'view'").select("device_id", "t")
    return A.count_in_ranges(pts, b, ["device_id"], "t", [("start", "a1"), ("b0", "b1")], "hits").drop("a1", "b0", "b1")


view("sess", f"""
SELECT *, sum(f) OVER (PARTITION BY device_id ORDER BY t, event_id) AS s FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY device_id ORDER BY t, event_id) <= {4 * H}
  THEN 0 ELSE 1 END AS f FROM evm)""")


@check("win_gap_sessions", """
SELECT event_id, batch_size, batch_start, batch_end, batch FROM sess JOIN (SELECT device_id, s, count(*) batch_size, min(t) batch_start, max(t) batch_end,
  row_number() OVER (ORDER BY min(t), device_id) AS batch FROM sess GROUP BY 1, 2) USING (device_id, s)""")
def _(spark, d):
    out = Q.gap_sessions(evm(spark, d).select("device_id", "event_id", "t"), ["device_id"], "t", 4 * H, ["event_id"])
    return out.drop("device_id", "t")


@check("win_nth_in_session", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY device_id, s ORDER BY t, event_id) r FROM sess) WHERE r = 2")
def _(spark, d):
    return Q.nth_in_session(evm(spark, d).select("device_id", "event_id", "t"), ["device_id"], "t", 4 * H, 2, ["event_id"]).select("event_id")


FOLD = f"""
SELECT device_id, t AS kept FROM (WITH RECURSIVE seq AS (SELECT device_id, t, row_number() OVER (PARTITION BY device_id ORDER BY t, event_id) r FROM evm),
  f AS (SELECT device_id, r, t, t AS anchor, TRUE AS fresh FROM seq WHERE r = 1 UNION ALL SELECT s.device_id, s.r, s.t,
    CASE WHEN s.t - f.anchor > {12 * H} THEN s.t ELSE f.anchor END, s.t - f.anchor > {12 * H} FROM f JOIN seq s ON s.device_id = f.device_id AND s.r = f.r + 1)
  SELECT * FROM f) WHERE fresh"""


@check("win_thin_events", FOLD)
def _(spark, d):
    return Q.thin_events(evm(spark, d).select("device_id", "event_id", "t"), ["device_id"], "t", 12 * H, ["event_id"]).select(
        "device_id", F.col("t").alias("kept"))


@check("win_anchor_clusters", f"""
SELECT device_id, anchor * 1000 AS cluster_start, count(*) cluster_size, arg_min(event_id, k * 10000000000000 + t) AS event_id FROM (
  WITH RECURSIVE seq AS (SELECT device_id, t, k, event_id, row_number() OVER (PARTITION BY device_id ORDER BY t, event_id) r FROM evm),
  f AS (SELECT device_id, r, t, k, event_id, t AS anchor FROM seq WHERE r = 1 UNION ALL SELECT s.device_id, s.r, s.t, s.k, s.event_id,
    CASE WHEN s.t - f.anchor > {12 * H} THEN s.t ELSE f.anchor END FROM f JOIN seq s ON s.device_id = f.device_id AND s.r = f.r + 1) SELECT * FROM f) GROUP BY 1, 2""")
def _(spark, d):
    rows = evm(spark, d).select("device_id", "event_id", "t", "k")
    return Q.anchor_clusters(rows, ["device_id"], "t", 12 * H, ["k"]).select("device_id", "cluster_start", "cluster_size", "event_id")


@check("win_silence_points", f"""
SELECT event_id FROM (SELECT event_id, lead(t) OVER (PARTITION BY device_id ORDER BY t, event_id) - t AS g FROM evm) WHERE g IS NULL OR g > {10 * H}""")
def _(spark, d):
    return Q.silence_points(evm(spark, d).select("device_id", "event_id", "t"), ["device_id"], "t", 10 * H, ["event_id"]).select("event_id")


@check("win_latest_n", """
SELECT * FROM (SELECT device_id, process_name, event_id, row_number() OVER w AS rank, count(*) OVER (PARTITION BY device_id, process_name) AS total FROM evm
WINDOW w AS (PARTITION BY device_id, process_name ORDER BY t DESC, event_id DESC)) WHERE rank <= 5""")
def _(spark, d):
    out = Q.latest_n(evm(spark, d).select("device_id", "process_name", "event_id", "t"), ["device_id", "process_name"], "t", 5, ["event_id"])
    return out.select("device_id", "process_name", "event_id", F.col("rank").cast("bigint").alias("rank"), "total")


view("unit", "SELECT a.*, b.n, b.s FROM evm a JOIN boots b ON a.device_id = b.device_id AND a.t >= b.s AND (b.e IS NULL OR a.t < b.e)")


def _units(spark, d):
    return A.assign_interval(evm(spark, d), boots(spark, d), ["device_id"], "t", how="inner")


@check("win_first_since", f"""
SELECT device_id, n, min(t) AS ts, (min(t) - s) / 1000 AS value FROM unit WHERE process_name = 'error' GROUP BY device_id, n, s HAVING min(t) - s BETWEEN 0 AND {12 * H}""")
def _(spark, d):
    hits = _units(spark, d).filter("process_name = 'error'").select("device_id", "n", F.col("t").alias("ts"))
    units = boots(spark, d).select("device_id", "n", F.col("start").alias("anchor"))
    return Q.first_since(hits, units, ["device_id", "n"], limit_ms=12 * H)


@check("win_first_by_source", """
SELECT device_id, n, event_id FROM (SELECT *, row_number() OVER (PARTITION BY device_id, n ORDER BY CASE WHEN process_name = 'view' THEN 1 ELSE 2 END, t, event_id) r FROM unit
WHERE process_name IN ('view', 'error')) WHERE r = 1""")
def _(spark, d):
    hits = _units(spark, d).filter("process_name in ('view', 'error')").withColumn("source_rank", F.when(F.col("process_name") == "view", 1).otherwise(2))
    return Q.first_value_by_source(hits, ["device_id", "n"], "t", tie=["event_id"]).select("device_id", "n", "event_id")


@check("win_count_unique", "SELECT device_id, k, t // 1000 AS sec, min(t) AS t FROM evm WHERE process_name = 'error' GROUP BY 1, 2, 3")
def _(spark, d):
    out = Q.count_unique(evm(spark, d).filter("process_name = 'error'"), ["device_id"], ["k"], "t", per_second=True)
    return out.withColumn("sec", F.floor(F.col("t") / 1000))


@check("win_carry_key", """
SELECT event_id, last_value(CASE WHEN process_name = 'view' THEN k END IGNORE NULLS) OVER (PARTITION BY device_id, code_aux ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS key FROM evm""")
def _(spark, d):
    rows = evm(spark, d).select("device_id", "code_aux", "event_id", "t", F.when(F.col("process_name") == "view", F.col("k")).alias("key"))
    return Q.carry_key(rows, ["device_id", "code_aux"], "t", "key", ["event_id"]).select("event_id", "key")


@check("win_request_batches", """
SELECT device_id, batch, min(t) FILTER (WHERE process_name = 'signup') AS request, min(t) FILTER (WHERE process_name = 'click') AS click,
  min(t) FILTER (WHERE process_name = 'view') AS view FROM (SELECT *, sum(CASE WHEN process_name = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY t, event_id) batch FROM evm)
WHERE batch > 0 GROUP BY 1, 2""")
def _(spark, d):
    rows = evm(spark, d).select("device_id", "t", "process_name")
    return Q.request_batches(rows, ["device_id"], "t", "process_name", "signup", ["click", "view"])


@check("win_unanswered", """
SELECT event_id FROM (SELECT *, lead(process_name) OVER (PARTITION BY device_id ORDER BY t, event_id) nx FROM evm WHERE process_name IN ('click', 'purchase'))
WHERE process_name = 'click' AND coalesce(nx, 'click') = 'click'""")
def _(spark, d):
    e = evm(spark, d).select("device_id", "event_id", "t", "process_name")
    return Q.unanswered(e.filter("process_name = 'click'"), e.filter("process_name = 'purchase'"), ["device_id"], "t", ["event_id"]).select("event_id")


@check("win_prefer_source", f"""
SELECT event_id FROM lft l WHERE NOT EXISTS (SELECT 1 FROM rgt r WHERE r.device_id = l.device_id AND abs(r.rt - l.t) <= {3 * H})""")
def _(spark, d):
    left, right = _sides(spark, d)
    return Q.prefer_source(right.select("device_id", F.col("rt").alias("t")), left, ["device_id"], "t", 3 * H).select("event_id")


# ── intervals ──

view("ia", f"SELECT device_id, t AS s, t + {8 * H} AS e FROM evm WHERE process_name = 'view'")
view("ib", f"SELECT device_id, t AS s, t + {5 * H} AS e FROM evm WHERE process_name = 'error'")


def _sets(spark, d):
    e = evm(spark, d)
    a = e.filter("process_name = 'view'").select("device_id", F.col("t").alias("start"), (F.col("t") + 8 * H).alias("end"))
    b = e.filter("process_name = 'error'").select("device_id", F.col("t").alias("start"), (F.col("t") + 5 * H).alias("end"))
    return a, b


def _merged(name: str) -> str:
    return f"""SELECT device_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY device_id ORDER BY s, e) g FROM (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY device_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END f FROM {name})) GROUP BY device_id, g"""


view("ma", _merged("ia"))
view("mb", _merged("ib"))


@check("win_merge_intervals", 'SELECT device_id, s AS start, e AS "end" FROM ma')
def _(spark, d):
    return I.merge_intervals(_sets(spark, d)[0], ["device_id"])


@check("win_intersect_intervals", 'SELECT a.device_id, greatest(a.s, b.s) AS start, least(a.e, b.e) AS "end" FROM ma a JOIN mb b ON a.device_id = b.device_id AND a.s < b.e AND b.s < a.e')
def _(spark, d):
    return I.intersect_intervals(*_sets(spark, d), ["device_id"])


view("gaps", "SELECT device_id, e AS s, lead(s) OVER (PARTITION BY device_id ORDER BY s) AS e FROM mb UNION ALL SELECT device_id, -1, min(s) FROM mb GROUP BY 1")


@check("win_subtract_intervals", """
SELECT a.device_id, greatest(a.s, g.s) AS start, least(a.e, coalesce(g.e, a.e)) AS "end" FROM ma a JOIN gaps g ON a.device_id = g.device_id AND a.s < coalesce(g.e, a.e + 1) AND g.s < a.e""")
def _(spark, d):
    return I.subtract_intervals(*_sets(spark, d), ["device_id"])


@check("win_change_points", """
SELECT device_id, t AS start, lead(t) OVER (PARTITION BY device_id ORDER BY t, process_name) AS "end", process_name FROM (
  SELECT *, lag(process_name) OVER (PARTITION BY device_id ORDER BY t, process_name) p FROM evm) WHERE p IS NULL OR p <> process_name""")
def _(spark, d):
    return I.change_points(evm(spark, d), ["device_id"], "t", "process_name")


@check("win_pending_paths", """
SELECT DISTINCT i.device_id AS device, 's3://b/' || i.code_aux || '/' || i.k AS path FROM evm i JOIN ma p ON i.device_id = p.device_id AND i.t >= p.s AND i.t + 600000 <= p.e WHERE i.k % 2 = 0""")
def _(spark, d):
    from tripline.plans.boots import pending_paths

    e = evm(spark, d)
    scheme = F.when(F.col("k") % 2 == 0, "s3://b/").otherwise("file://b/")
    index = e.select(F.col("device_id").alias("device"), F.concat(scheme, F.col("code_aux").cast("string"), F.lit("/"), F.col("k").cast("string")).alias("path"),
                     F.col("t").alias("start"), (F.col("t") + 600000).alias("end"))
    pend = I.merge_intervals(_sets(spark, d)[0], ["device_id"]).withColumnRenamed("device_id", "device")
    return pending_paths(index, pend)


@check("str_late_days", """
SELECT device, cast(day AS varchar) AS day FROM (SELECT device_id device, cast(ts AS date) AS day, max(ts) AS up, max(CASE WHEN k % 3 = 0 THEN ts + INTERVAL 30 HOUR END) AS rd FROM ev GROUP BY 1, 2)
WHERE (rd IS NULL OR up > rd OR rd < day + INTERVAL 2 DAY) AND day + INTERVAL 1 DAY <= TIMESTAMP '2024-01-25'""")
def _(spark, d):
    from tripline.streaming.incremental import late_days

    index = ev(spark, d).select(F.col("device_id").alias("device"), F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("uploaded_at"),
                                F.when(F.col("k") % 3 == 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 30 HOURS")).alias("read_at"))
    return late_days(index, F.lit("2024-01-25").cast("timestamp")).withColumn("day", F.col("day").cast("string"))


@check("str_reading_events", """
WITH_U SELECT device, day, 'upload' AS reason, max(up)::VARCHAR AS "at", count(*) AS uploads FROM u GROUP BY 1, 2
UNION ALL SELECT device, day, 'final', (day::DATE + INTERVAL 2 DAY)::VARCHAR, count(*) FROM u GROUP BY 1, 2 HAVING day::DATE + INTERVAL 2 DAY < (SELECT max(up) FROM u)""".replace(
    "WITH_U ", "SELECT * FROM (WITH u AS (SELECT device_id[1:1] AS device, cast(ts AS date)::VARCHAR AS day, date_trunc('second', ts) + to_hours(k % 30) AS up FROM ev) ") + ")")
def _(spark, d):
    from tripline.session import scratch
    from tripline.streaming.incremental import run_readings

    folder = scratch(spark)
    e = ev(spark, d)
    rows = e.select(F.substring("device_id", 1, 1).alias("device"), F.to_date("ts").alias("day"), (F.date_trunc("second", "ts") + F.make_dt_interval(hours=F.col("k") % 30)).cast("timestamp").alias("uploaded_at"))
    rows.write.parquet(f"{folder}/in")
    run_readings(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state")
    out = spark.read.parquet(f"{folder}/out")
    return out.select("device", F.col("day").cast("string").alias("day"), "reason", F.col("at").cast("string").alias("at"), "uploads")


@check("str_stream_classify", """
SELECT event_id, n.pattern, coalesce(p.type, 'INFO') AS type, CASE WHEN p.type IS NULL THEN 'model' ELSE 'map' END matched_via FROM norm n LEFT JOIN pmap p ON n.pattern = p.description_pattern""")
def _(spark, d):
    from checks.views import pattern_map
    from tripline.plans.classify import classify
    from tripline.streaming.incremental import stream_classify

    root = scratch(spark)
    e = ev(spark, d).select("event_id", "device_id", "ts", "code", "description", "type", "priority", "process_name")
    pm = pattern_map(e)
    run = lambda b: classify(b, pm, F.lit("INFO"))
    # Two runs over a growing folder: the second takes only what is new
    for part in (0, 1):
        e.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{root}/in")
        stream_classify(spark, f"{root}/in", f"{root}/out", f"{root}/cp", e.schema, run)
    return spark.read.parquet(f"{root}/out").select("event_id", "pattern", "type", "matched_via")
