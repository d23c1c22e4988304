"""Critical events: scans, dashboards, staging, pattern map upkeep, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, view
from checks.views import ev, ms, pattern_map, table
from tripline.functions import text as X
from tripline.plans import classify as C
from tripline.plans import events as E
from tripline.session import scratch
from tripline.sources import sinks as K

A, B = "2024-01-05", "2024-01-20"
V = "3.6.1.rc.1"
WIN = f"ts >= TIMESTAMP '{A}' AND ts < TIMESTAMP '{B}'"


@check("src_scan_events", f"""
SELECT device_id, ts, process_name, code, code_aux, cnt, description, version, type, priority, tenant_id, cast(NULL AS varchar) s3_path,
  cast(NULL AS double) sys_uptime FROM ev WHERE {WIN} AND code NOT IN (3, 7, 50) AND (contains(version, '3.6') OR contains(version, '.rc.2'))""")
def _(spark, d):
    return E.scan_events(ev(spark, d), A, B, [3.0, 7.0, 50.0], ["3.6", ".rc.2"])


@check("src_scan_exact", f"SELECT event_id, process_name, code FROM ev WHERE version = '{V}' AND {WIN}")
def _(spark, d):
    return E.scan_events_exact(ev(spark, d), V, (), A, B).select("event_id", "process_name", "code")


@check("src_scan_devices", f"""
SELECT event_id FROM ev WHERE ts BETWEEN TIMESTAMP '{A}' AND TIMESTAMP '{B}' AND device_id IN (SELECT cast(s_suppkey AS varchar) FROM supplier)""")
def _(spark, d):
    devices = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("device_id"))
    return E.scan_device_events(ev(spark, d), devices, A, B).select("event_id")


@check("flt_ota_filter", f"SELECT event_id FROM ev WHERE version = '{V}' AND device_id IN ('1', '69', '137') AND {WIN}")
def _(spark, d):
    return E.ota_filter(ev(spark, d), V, ["1", "69", "137"], A, B).select("event_id")


@check("flt_detail", """
SELECT event_id FROM ev WHERE type = 'ERROR' AND code IN (1, 2, 3, 4, 5, 6) AND contains(lower(description), 'retry x')""")
def _(spark, d):
    return E.detail_filter(ev(spark, d), ["ERROR"], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "RETRY X").select("event_id")


@check("event_overview", "SELECT count(*) total_rows, min(ts) min_ts, max(ts) max_ts FROM ev")
def _(spark, d):
    return E.event_overview(ev(spark, d))


@check("rows_per_type", "SELECT type, count(*) rows_count FROM ev GROUP BY 1")
def _(spark, d):
    return E.rows_per_type(ev(spark, d))


@check("top_codes", "SELECT code, count(*) rows_count FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return E.top_codes(ev(spark, d))


@check("version_summary", "SELECT version, type, cast(sum(cnt) AS bigint) events FROM ev GROUP BY 1, 2")
def _(spark, d):
    return E.version_summary(ev(spark, d))


@check("version_tiles", """
SELECT version, total, errors, infos, line, count(*) OVER (PARTITION BY line) line_tiles, cast(sum(total) OVER (PARTITION BY line) AS bigint) line_events
FROM (SELECT version, cast(sum(cnt) AS bigint) total, cast(coalesce(sum(cnt) FILTER (WHERE type = 'ERROR'), 0) AS bigint) errors,
  cast(coalesce(sum(cnt) FILTER (WHERE type = 'INFO'), 0) AS bigint) infos, 'family' || split_part(version, '.', 1) AS line FROM ev GROUP BY 1)""")
def _(spark, d):
    return E.version_tiles(E.version_summary(ev(spark, d)))


@check("version_bounds", f"SELECT min(ts) first_ts, max(ts) last_ts FROM ev WHERE version = '{V}'")
def _(spark, d):
    return E.version_bounds(ev(spark, d), V)


@check("version_devices", f"SELECT DISTINCT device_id FROM ev WHERE version = '{V}' AND {WIN}")
def _(spark, d):
    return E.version_devices(ev(spark, d), V, A, B)


PCT = r"""
SELECT process_name, code, code_aux, type, priority, regexp_replace(description, '\S*[0-9]\S*', '<N>', 'g') AS pattern, min(description) AS sample,
  cast(sum(cnt) AS bigint) occurrences, list_sort(list(DISTINCT device_id)) devices FROM ev GROUP BY 1, 2, 3, 4, 5, 6"""
view("pct", PCT)


@check("process_code_table", "SELECT * REPLACE (array_to_string(devices, ',') AS devices) FROM pct")
def _(spark, d):
    return E.process_code_table(ev(spark, d)).withColumn("devices", F.array_join("devices", ","))


@check("merge_ignoring_aux", """
SELECT process_name, code, type, priority, pattern, arg_max(sample, occurrences * 10 - code_aux) AS sample, cast(sum(occurrences) AS bigint) occurrences,
  array_to_string(list_sort(list_distinct(flatten(list(devices)))), ',') devices FROM pct GROUP BY 1, 2, 3, 4, 5""")
def _(spark, d):
    return E.merge_ignoring_aux(E.process_code_table(ev(spark, d))).withColumn("devices", F.array_join("devices", ","))


view("stg", r"""
SELECT *, process_name AS process, cast(code AS varchar) code_text, cast(code_aux AS varchar) aux_text, greatest(cnt, 1) times,
  regexp_replace(regexp_replace(regexp_replace(upper(trim(description)), '\b[0-9]+(?:\.[0-9]+)?\b', '%', 'g'), ' *[^A-Z ].*$', '%', 'g'), '%+', '%', 'g') AS spat,
  CASE WHEN type = 'ERROR' THEN 'error' ELSE 'info' END severity FROM ev""")
view("sdet", """
SELECT process, code_text, aux_text, spat AS pattern, arg_max(severity, epoch_us(ts)) severity, arg_max(priority, epoch_us(ts)) priority,
  arg_max(description, epoch_us(ts)) AS sample, cast(sum(times) AS bigint) occurrences, count(DISTINCT device_id) devices FROM stg GROUP BY 1, 2, 3, 4""")


@check("staging_detail", "SELECT * FROM sdet")
def _(spark, d):
    return E.staging_detail(ev(spark, d))


@check("staging_processes", """
SELECT process, count(*) patterns, count(*) FILTER (WHERE severity = 'error') errors, count(*) FILTER (WHERE severity = 'info') info,
  cast(sum(occurrences) AS bigint) occurrences FROM sdet GROUP BY 1""")
def _(spark, d):
    return E.staging_processes(E.staging_detail(ev(spark, d)))


@check("staging_totals", """
SELECT count(*) FILTER (WHERE type = 'ERROR') error_rows, count(*) FILTER (WHERE type = 'INFO') info_rows, count(DISTINCT device_id) devices FROM ev""")
def _(spark, d):
    return E.staging_totals(ev(spark, d))


@check("staging_devices", "SELECT device_id, min(version) AS version FROM ev GROUP BY 1")
def _(spark, d):
    return E.staging_devices(ev(spark, d))


@check("unique_combinations", """
SELECT code, code_aux, description, count(*) rows_count FROM ev WHERE contains(version, '.rc.1') AND process_name IN ('error', 'click') AND tenant_id IN (1, 4)
GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3""")
def _(spark, d):
    return E.unique_combinations(ev(spark, d), ".rc.1", ["error", "click"], [1, 4])


@check("distinct_codes", f"SELECT DISTINCT code, code_aux FROM ev WHERE contains(version, '3.6') AND {WIN}")
def _(spark, d):
    return E.distinct_codes(ev(spark, d), "3.6", A, B)


@check("priority_summary", "SELECT count(*) total_rows, count(*) FILTER (WHERE k % 4 <> 0) with_priority, count(*) FILTER (WHERE k % 4 = 0) without_priority FROM ev")
def _(spark, d):
    return E.priority_summary(ev(spark, d).withColumn("priority", F.when(F.col("k") % 8 == 0, " ").when(F.col("k") % 4 != 0, F.col("priority"))))


@check("priority_breakdown", "SELECT type, priority, count(*) rows_count FROM ev GROUP BY 1, 2")
def _(spark, d):
    return E.priority_breakdown(ev(spark, d))


@check("top_rank_issues", r"""
SELECT code, priority, regexp_replace(description, '\S*[0-9]\S*', '<N>', 'g') AS pattern, count(*) rows_count FROM ev GROUP BY 1, 2, 3""")
def _(spark, d):
    return E.rank_issues(ev(spark, d))


# ── pattern map ──


@check("src_pattern_map", "SELECT description_pattern, type, priority FROM pmap")
def _(spark, d):
    from tripline.sources.readers import check_pattern_map

    pm = pattern_map(ev(spark, d))
    twice = pm.withColumn("i", F.lit(1)).unionByName(pm.withColumns({"type": F.lit("other"), "i": F.lit(2)}))
    messy = twice.withColumns({"type": F.concat(F.lit(" "), F.lower("type")), "description_pattern": F.concat("description_pattern", F.lit(" "))})
    return check_pattern_map(messy, "i")


@check("join_apply_pattern_map", """
SELECT event_id, coalesce(p.type, n.type) AS type, coalesce(p.priority, n.priority) AS priority FROM norm n LEFT JOIN pmap p ON n.pattern = p.description_pattern""")
def _(spark, d):
    e = ev(spark, d)
    return E.apply_pattern_map(e, pattern_map(e)).select("event_id", "type", "priority")


@check("join_verify_pattern_map", """
SELECT description_pattern, n.type stored_type, n.priority stored_priority, count(*) rows_count, p.type, p.priority FROM norm n
JOIN pmap p ON n.pattern = p.description_pattern WHERE n.type <> p.type OR n.priority <> p.priority GROUP BY 1, 2, 3, 5, 6""")
def _(spark, d):
    e = ev(spark, d)
    return E.verify_pattern_map(e, pattern_map(e))


view("rebuilt", """
SELECT code, type, pattern AS description_pattern, min(description) AS sample_description, min(priority) AS priority FROM norm GROUP BY 1, 2, 3""")


@check("join_rebuild_patterns", "SELECT * FROM rebuilt")
def _(spark, d):
    return E.rebuild_patterns(ev(spark, d))


@check("join_sync_patterns", """
SELECT r.* FROM rebuilt r WHERE NOT EXISTS (SELECT 1 FROM norm n WHERE n.event_id % 7 = 0 AND n.code = r.code AND n.type = r.type AND n.pattern = r.description_pattern)""")
def _(spark, d):
    e = ev(spark, d)
    return E.sync_patterns(e, E.rebuild_patterns(e.filter("event_id % 7 = 0")).select("code", "type", "description_pattern"))


@check("join_append_patterns", """
SELECT * FROM pmap UNION ALL SELECT DISTINCT pattern, 'INFO', 'NEW' FROM norm WHERE pattern NOT IN (SELECT description_pattern FROM pmap)""")
def _(spark, d):
    e = ev(spark, d)
    new = e.select(X.normalize_description("description").alias("description_pattern"), F.lit("INFO").alias("type"), F.lit("NEW").alias("priority"))
    return E.append_patterns(pattern_map(e), new)


@check("join_priority_like", """
SELECT event_id, m.mt AS map_type, m.mp AS map_priority FROM ev LEFT JOIN (SELECT p_size AS c, '%' || (p_size % 7) || ' retry%' AS pat,
  min(p_type) mt, 'P' || count(*) AS mp FROM part GROUP BY 1, 2) m ON ev.code = m.c AND ev.description LIKE m.pat""")
def _(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_size").cast("double").alias("code"),
                                        F.concat(F.lit("%"), (F.col("p_size") % 7).cast("string"), F.lit(" retry%")).alias("like_pattern")).agg(
        F.min("p_type").alias("map_type"), F.concat(F.lit("P"), F.count(F.lit(1)).cast("string")).alias("map_priority"))
    return E.join_priority(ev(spark, d), p).select("event_id", "map_type", "map_priority")


@check("join_neighbours", """
SELECT r.event_id ref_id, e.event_id FROM ev r JOIN ev e ON r.device_id = e.device_id AND abs(epoch_us(r.ts) - epoch_us(e.ts)) <= 300 * 1000000
WHERE r.type = 'ERROR'""")
def _(spark, d):
    e = ev(spark, d)
    rows = e.filter("type = 'ERROR'").withColumn("ref_id", F.col("event_id"))
    return E.neighbours(e, rows, ["device_id"]).select("ref_id", "event_id")


@check("join_drive_minutes", f"""
SELECT device_id, coalesce(m, 0) AS "minutes" FROM (SELECT DISTINCT device_id FROM ev) LEFT JOIN (SELECT device_id, round(sum(value), 4) m FROM ev
WHERE cast(ts AS date) BETWEEN DATE '{A}' AND DATE '2024-01-06' AND type = 'ERROR' GROUP BY 1) USING (device_id)""")
def _(spark, d):
    e = ev(spark, d)
    metrics = e.filter("type = 'ERROR'").select("device_id", F.to_date("ts").alias("record_date"), F.col("value").alias("valid_drive_time_in_minutes"))
    out = E.join_minutes(e.select("device_id").distinct(), E.drive_minutes(metrics, A, "2024-01-06"))
    return out.withColumn("minutes", F.round("minutes", 4))


@check("join_enrich_tenant", """
SELECT c_custkey device_id, n_nationkey tenant_id, n_name tenant_name FROM customer LEFT JOIN (SELECT o_custkey, max(s_suppkey) s FROM orders
JOIN supplier ON o_orderkey % 100 = s_suppkey GROUP BY 1) m ON c_custkey = o_custkey LEFT JOIN supplier ON s = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey""")
def _(spark, d):
    t = lambda n: table(spark, d, n)
    master = t("orders").select(F.col("o_custkey").alias("device_id"), (F.col("o_orderkey") % 100).alias("vehicle_id"))
    vehicle = t("supplier").select(F.col("s_suppkey").alias("vehicle_id"), F.col("s_nationkey").alias("tenant_id"))
    tenant = t("nation").select(F.col("n_nationkey").alias("tenant_id"), F.col("n_name").alias("tenant_name"))
    return E.enrich_tenant(t("customer").select(F.col("c_custkey").alias("device_id")), master, vehicle, tenant)


@check("join_device_configs", """
SELECT o_orderkey device_id, p_name AS config, coalesce(s_name, 'UNKNOWN') vehicle_name, coalesce(n_name, 'UNKNOWN') tenant_name FROM orders
JOIN part ON o_custkey = p_partkey LEFT JOIN supplier ON o_custkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey""")
def _(spark, d):
    t = lambda n: table(spark, d, n)
    master = t("orders").select(F.col("o_orderkey").alias("device_id"), F.col("o_custkey").alias("config_id"), F.col("o_custkey").alias("vehicle_id"))
    configs = t("part").select(F.col("p_partkey").alias("config_id"), F.col("p_name").alias("config"))
    vehicle = t("supplier").select(F.col("s_suppkey").alias("vehicle_id"), F.col("s_name").alias("vehicle_name"), F.col("s_nationkey").alias("tenant_id"))
    tenant = t("nation").select(F.col("n_nationkey").alias("tenant_id"), F.col("n_name").alias("tenant_name"))
    return E.device_configs(master, configs, vehicle, tenant).select("device_id", "config", "vehicle_name", "tenant_name")


@check("join_related_issues", """
SELECT phrase, issue_id, rank FROM (SELECT phrase, doc_id issue_id, row_number() OVER (PARTITION BY phrase ORDER BY n_chars DESC, doc_id DESC) AS rank
FROM (SELECT DISTINCT lower(trim(regexp_replace(regexp_replace(regexp_extract(trim(regexp_replace(regexp_replace(text, '(^|\\s)\\S*[0-9](.|\\n)*$', ''), '\\s+', ' ', 'g')), '^\\S+ \\S+'), '[^\\p{L}\\p{N}_\\s.'']', ' ', 'g'), '\\s+', ' ', 'g'))) phrase FROM benchmark)
JOIN documents ON contains(lower(text), phrase) WHERE phrase <> '') WHERE rank <= 10""".replace("\\\\", "\\"))
def _(spark, d):
    plain = F.regexp_extract(F.trim(F.regexp_replace(F.regexp_replace("text", r"(?s)(^|\s)\S*[0-9].*$", ""), r"\s+", " ")), r"^\S+ \S+", 0)
    rows = table(spark, d, "benchmark").select(F.lit("ERROR").alias("type"), plain.alias("description"))
    issues = table(spark, d, "documents").select(F.col("doc_id").alias("issue_id"), F.col("n_chars").alias("created"), "text")
    return E.related_issues(rows, issues).select("phrase", "issue_id", F.col("rank").cast("bigint").alias("rank"))


@check("win_download_targets", """
SELECT DISTINCT device_id, cast(cast(t AS date) + x AS varchar) AS day FROM (SELECT device_id, max(ts) t, row_number() OVER (PARTITION BY process, code_text, spat
ORDER BY max(ts) DESC, device_id) r FROM stg WHERE severity = 'error' GROUP BY process, code_text, spat, device_id), (VALUES (0), (1)) v(x) WHERE r <= 2""")
def _(spark, d):
    rows = E.staging_rows(ev(spark, d)).filter("severity = 'error'")
    return E.download_targets(rows).withColumn("day", F.col("day").cast("string"))


# ── device lists ──


def _list(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("device_id"), F.concat((F.col("c_custkey") % 4 + 2).cast("string"), F.lit(".6.1")).alias("version"),
        F.col("c_mktsegment").alias("state"), F.col("c_nationkey").alias("state_id"))


view("devs", "SELECT cast(c_custkey AS varchar) device_id, (c_custkey % 4 + 2) || '.6.1' AS version, c_mktsegment AS state, c_nationkey state_id FROM customer")


@check("src_device_list", """
SELECT device_id, CASE state_id WHEN 1 THEN 'NEW' WHEN 2 THEN 'INSTALLED' ELSE cast(state_id AS varchar) END AS state FROM devs WHERE version = '3.6.1'""")
def _(spark, d):
    return E.device_list(_list(spark, d), "3.6.1", {1: "NEW", 2: "INSTALLED"}).select("device_id", "state")


@check("src_load_devices", """
SELECT cast(c_custkey AS varchar) device_id, min(c_mktsegment) AS tenant FROM customer WHERE c_nationkey < 12 GROUP BY 1""")
def _(spark, d):
    c = table(spark, d, "customer")
    out = scratch(spark)
    rows = c.select(F.col("c_custkey").alias("Device_ID"), F.when(F.col("c_nationkey") < 12, "installed ").otherwise("NEW").alias("Device_State"),
                    F.col("c_mktsegment").alias("Tenant_Display_Name"))
    for i, part in enumerate((rows.withColumn("Tenant_Display_Name", F.lit("old")), rows)):
        part.coalesce(1).write.option("header", True).csv(f"{out}/{i}")
    from tripline.sources.readers import load_devices

    return load_devices(spark, f"{out}/*/*.csv")


@check("agg_state_counts", "SELECT state, count(*) devices FROM devs GROUP BY 1")
def _(spark, d):
    return E.state_counts(_list(spark, d))


@check("agg_devices_capped", """
SELECT * FROM (SELECT version, device_id, state, row_number() OVER (PARTITION BY version ORDER BY CASE WHEN state = 'HOUSEHOLD' THEN 0 ELSE 1 END, state, device_id) AS rank
FROM devs) WHERE rank <= 200""")
def _(spark, d):
    out = E.devices_capped(_list(spark, d), 200, ["HOUSEHOLD"])
    return out.select("version", "device_id", "state", F.col("rank").cast("bigint").alias("rank"))


@check("snk_devices_by_state", """
SELECT version, count(DISTINCT state) AS states, count(*) AS devices FROM devs GROUP BY 1""")
def _(spark, d):
    out = K.devices_by_state_json(_list(spark, d)).withColumn("m", F.from_json("states", "map<string,array<string>>"))
    return out.select("version", F.size("m").cast("bigint").alias("states"), F.size(F.flatten(F.map_values("m"))).cast("bigint").alias("devices"))


@check("flt_select_versions", "SELECT DISTINCT version FROM ev WHERE version LIKE '3.%' OR version LIKE '5.%'")
def _(spark, d):
    return E.select_versions(ev(spark, d), ["family3", "family5"], []).select("version")


@check("join_order_versions", """
SELECT version, row_number() OVER (ORDER BY CASE WHEN a = 4 THEN c * 100 + b ELSE 100000 END, a DESC, b DESC, c DESC) AS position FROM (
  SELECT DISTINCT version, cast(split_part(version, '.', 1) AS int) a, cast(split_part(version, '.', 3) AS int) b, cast(split_part(version, '.', 5) AS int) c FROM ev)""")
def _(spark, d):
    vs = ev(spark, d).select("version").distinct()
    part = F.split("version", r"\.")
    conf = vs.filter("version like '4.%'").select("version", (part[4].cast("int") * 100 + part[2].cast("int")).alias("rank"))
    from pyspark.sql.window import Window as W

    ordered = E.order_versions(vs, conf)
    return ordered.select("version", F.row_number().over(W.orderBy(F.asc_nulls_last("rank"), X.version_key("version").desc())).cast("bigint").alias("position"))


@check("join_known_versions", """
SELECT version, max(t) AS newest FROM (SELECT ota AS version, max(start_time) AS t FROM obs GROUP BY 1 UNION ALL SELECT version, max(ts) FROM ev GROUP BY 1)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""")
def _(spark, d):
    from checks.views import obs

    rep = obs(spark, d).select(F.lit("prod").alias("environment"), F.col("ota").alias("version"), F.col("start_time").alias("at"))
    runs = ev(spark, d).select(F.lit("prod").alias("environment"), "version", F.col("ts").alias("at"))
    return E.known_versions(rep, runs, "prod", 100)


# ── classification ──


@check("txt_match_patterns", """
SELECT event_id, CASE WHEN process_name IN ('error', 'click') THEN upper(process_name) WHEN k = 7 THEN 'SEVEN' WHEN code_aux >= 0 THEN 'ANY' END AS matched_type FROM ev""")
def _(spark, d):
    e = ev(spark, d)
    pats = e.select("process_name").distinct().filter("process_name in ('error', 'click')").select(
        F.lit(1).alias("rank"), F.upper("process_name").alias("type"), F.concat("process_name", F.lit(" failed <N> retry <N> end")).alias("description_pattern"))
    more = e.agg(F.max("event_id")).select(F.explode(F.array(
        F.struct(F.lit(2).alias("rank"), F.lit("SEVEN").alias("type"), F.lit("<N> retry x7 end").alias("description_pattern")),
        F.struct(F.lit(3).alias("rank"), F.lit("ANY").alias("type"), F.lit("<N> failed <N>").alias("description_pattern")))).alias("p")).select("p.*")
    return C.match_patterns(e, pats.unionByName(more)).select("event_id", "matched_type")


CLS = """
SELECT event_id, n.pattern, coalesce(p.type, CASE WHEN n.k % 2 = 0 THEN 'ERROR' ELSE 'INFO' END) AS type, CASE WHEN p.type IS NULL THEN 'model' ELSE 'map' END matched_via,
  coalesce(p.priority, CASE WHEN n.k % 2 = 0 THEN 'P1' ELSE 'P9' END) AS priority, code, ts, device_id, description FROM norm n LEFT JOIN pmap p ON n.pattern = p.description_pattern"""
view("cls", CLS)


def _classified(spark, d):
    e = ev(spark, d)
    model = F.when(F.regexp_extract("description", r"x(\d+)", 1).cast("int") % 2 == 0, "ERROR").otherwise("INFO")

    def prio(misses):
        return misses.withColumn("priority", F.when(F.col("type") == "ERROR", "P1").otherwise("P9"))

    return C.classify(e, pattern_map(e), model, prio), pattern_map(e)


@check("ml_classify_cascade", "SELECT event_id, pattern, type, matched_via, priority FROM cls")
def _(spark, d):
    return _classified(spark, d)[0].select("event_id", "pattern", "type", "matched_via", "priority")


@check("ml_classify_counts", "SELECT matched_via, count(*) rows_count FROM cls GROUP BY 1")
def _(spark, d):
    return C.classify_counts(_classified(spark, d)[0])


@check("ml_new_patterns", """
SELECT pattern AS description_pattern, type, priority, arg_min(code, epoch_us(ts)) AS code, arg_min(description, epoch_us(ts)) AS sample_description FROM cls
WHERE matched_via = 'model' GROUP BY 1, 2, 3""")
def _(spark, d):
    return C.new_patterns(*_classified(spark, d))


@check("ml_predict_with", """
SELECT doc_id, CASE WHEN length(text) % 2 = 0 THEN 'ERROR' ELSE 'INFO' END AS predicted_type FROM documents""")
def _(spark, d):
    def load():
        return lambda texts: ["ERROR" if len(t) % 2 == 0 else "INFO" for t in texts]

    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("description"))
    return C.predict_with(docs, load).select("doc_id", "predicted_type")


@check("ml_nearest_prototype", """
SELECT vec_id, max(CASE WHEN r = 1 THEN label END) best_label, max(CASE WHEN r = 1 THEN s END) best_score, max(CASE WHEN r = 2 THEN label END) second_label,
  max(CASE WHEN r = 2 THEN s END) second_score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) r FROM (
  SELECT e.vec_id, p.label, round(list_cosine_similarity(cast(e.embedding AS double[]), cast(p.embedding AS double[])), 6) s FROM embeddings e,
  (SELECT label, arg_min(embedding, vec_id) embedding FROM embeddings GROUP BY 1) p)) GROUP BY 1""")
def _(spark, d):
    v = table(spark, d, "embeddings")
    protos = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return C.nearest_prototype(v, protos, "vec_id")


def _labelled(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        "doc_id", F.col("text").alias("description"), F.when(F.col("quality") == 1, "INFO").otherwise("ERROR").alias("type"))


@check("ml_train_predict")
def _(spark, d):
    model, held_out = C.train_type_model(_labelled(spark, d), min_rows=20)
    return C.predict_type(model, held_out, margin=True).select("doc_id", "type", "predicted_type", "margin")


@check("ml_training_counts", """
SELECT CASE WHEN type = 'OTHER' THEN 'dropped' WHEN ('0x' || substr(md5('42|' || (type = 'ERROR')::INT || '|' || text), 1, 8))::BIGINT % 100 < 20 THEN 'test' ELSE 'train' END AS part,
  nullif(type, 'OTHER') AS type, count(*) AS rows_count
FROM (SELECT coalesce(text, '') AS text, CASE WHEN doc_id % 11 = 0 THEN 'OTHER' WHEN quality = 1 THEN 'INFO' ELSE 'ERROR' END AS type FROM documents JOIN labels USING (doc_id)) GROUP BY 1, 2""")
def _(spark, d):
    return C.training_counts(_labelled(spark, d).withColumn("type", F.when(F.col("doc_id") % 11 == 0, "OTHER").otherwise(F.col("type"))))


@check("ml_confusion", """
SELECT CASE WHEN quality = 1 THEN 'INFO' ELSE 'ERROR' END AS type, CASE WHEN n_chars % 3 = 0 THEN 'ERROR' ELSE 'INFO' END AS predicted_type, count(*) rows_count
FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""")
def _(spark, d):
    rows = _labelled(spark, d).withColumn("predicted_type", F.when(F.length("description") % 3 == 0, "ERROR").otherwise("INFO"))
    return C.confusion(rows)


@check("ml_class_report", """
SELECT cls, cast(count(*) FILTER (WHERE t = cls) AS bigint) support, round(count(*) FILTER (WHERE t = cls AND p = cls) / count(*) FILTER (WHERE p = cls), 6) AS precision,
  round(count(*) FILTER (WHERE t = cls AND p = cls) / count(*) FILTER (WHERE t = cls), 6) AS recall,
  round(2 * count(*) FILTER (WHERE t = cls AND p = cls) / (count(*) FILTER (WHERE p = cls) + count(*) FILTER (WHERE t = cls)), 6) AS f1
FROM (SELECT CASE WHEN quality = 1 THEN 'INFO' ELSE 'ERROR' END t, CASE WHEN n_chars % 3 = 0 THEN 'ERROR' ELSE 'INFO' END p FROM documents JOIN labels USING (doc_id)),
(VALUES ('ERROR'), ('INFO')) v(cls) GROUP BY 1""")
def _(spark, d):
    rows = _labelled(spark, d).withColumn("predicted_type", F.when(F.length("description") % 3 == 0, "ERROR").otherwise("INFO"))
    out = C.class_report(rows)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@check("src_labelled", """
SELECT doc_id, text AS description, CASE WHEN quality = 1 THEN 'INFO' ELSE 'ERROR' END AS type FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND trim(text) <> ''""")
def _(spark, d):
    from tripline.sources.readers import labelled_of

    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        "doc_id", F.col("text").alias("description"), F.when(F.col("quality") == 1, "info").otherwise("Error").alias("type"),
        F.when(F.col("toxic") == 1, "none").otherwise("P1").alias("priority"))
    return labelled_of(rows, True).select("doc_id", F.col("description"), "type")


# ── sinks ──


@check("snk_dedup_latest", """
SELECT device_id, process_name, code, arg_max(event_id, epoch_us(ts)) AS event_id FROM ev GROUP BY 1, 2, 3""")
def _(spark, d):
    out = K.dedup_latest(ev(spark, d), ["device_id", "process_name", "code"], "ts", ["event_id"])
    return out.select("device_id", "process_name", "code", "event_id")


@check("snk_registry", """
SELECT device_id AS window_start, process_name AS signature, arg_max(CASE WHEN k % 2 = 0 THEN 'completed' ELSE 'failed' END, epoch_us(ts)) AS status FROM ev GROUP BY 1, 2""")
def _(spark, d):
    reg = ev(spark, d).select(F.col("device_id").alias("window_start"), F.lit("x").alias("window_end"), F.col("process_name").alias("signature"),
                              F.when(F.col("k") % 2 == 0, "completed").otherwise("failed").alias("status"), F.col("ts").alias("started_at"))
    return K.latest_status(reg).drop("window_end")


@check("agg_step_summary", """
SELECT process_name AS step, count(*) runs, round(sum(value), 4) total_s, round(avg(value), 6) avg_s, max(value) max_s,
  max(device_id) FILTER (WHERE value = mx) AS slowest_device, min(ts) first_start, TRUE AS any_failed
FROM (SELECT *, max(value) OVER (PARTITION BY process_name) mx FROM ev) GROUP BY 1""")
def _(spark, d):
    steps = ev(spark, d).select(F.col("process_name").alias("step"), F.col("device_id").alias("device"), F.col("value").alias("duration_s"),
                                F.col("ts").alias("started_at"), F.when(F.col("k") == 3, "failed").otherwise("done").alias("status"))
    out = K.step_summary(steps)
    return out.withColumns({"total_s": F.round("total_s", 4), "avg_s": F.round("avg_s", 6)})


@check("agg_device_timings", """
SELECT device_id AS device, round(sum(value), 4) total_s, round(sum(value) FILTER (WHERE process_name = 'click'), 4) download_s,
  round(sum(value) FILTER (WHERE process_name <> 'click'), 4) analysis_s, count(*) FILTER (WHERE k = 3) failed_steps FROM ev GROUP BY 1""")
def _(spark, d):
    steps = ev(spark, d).select(F.when(F.col("process_name") == "click", "download").otherwise("x").alias("step"), F.col("device_id").alias("device"),
                                F.col("value").alias("duration_s"), F.when(F.col("k") == 3, "failed").otherwise("done").alias("status"))
    return K.device_timings(steps).withColumns({c: F.round(c, 4) for c in ("total_s", "download_s", "analysis_s")})


@check("agg_size_summary", """
SELECT device, cast(day AS varchar) AS day, count(*) files, min(line_no) min_kb, max(line_no) max_kb, round(avg(line_no), 6) avg_kb, cast(sum(line_no) AS double) sum_kb,
  round(sum(line_no) / 1024, 6) mb FROM lines GROUP BY 1, 2""")
def _(spark, d):
    from checks.views import lines

    files = lines(spark, d).select("device", "day", (F.col("line_no") * 1024).alias("bytes"))
    return K.size_summary(files).withColumns({"day": F.col("day").cast("string"), "avg_kb": F.round("avg_kb", 6), "mb": F.round("mb", 6)})


@check("top_list_runs", "SELECT o_orderkey AS run_id FROM orders WHERE o_orderstatus = 'F' ORDER BY 1 DESC LIMIT 50")
def _(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.lit("prod").alias("environment"))
    return K.list_runs(runs, 50, "F", "prod").select("run_id")


@check("top_latest_report", "SELECT o_custkey AS device, max(o_orderdate) AS last_boot_start FROM orders GROUP BY 1")
def _(spark, d):
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("device"), F.col("o_orderkey").alias("report"), F.col("o_orderdate").alias("last_boot_start"))
    return K.latest_report(r).drop("report")


@check("top_slice_rows", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 100")
def _(spark, d):
    return K.slice_rows(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 100, 25).select("o_orderkey")


@check("snk_side_by_side", """
SELECT row_no, a.event_id AS a_event_id, b.event_id AS b_event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts) row_no FROM ev WHERE type = 'ERROR') a
FULL JOIN (SELECT event_id, row_number() OVER (ORDER BY ts) row_no FROM ev WHERE process_name = 'click') b USING (row_no)""")
def _(spark, d):
    e = ev(spark, d)
    out = K.side_by_side({"a": (e.filter("type = 'ERROR'"), "ts", ["event_id"]), "b": (e.filter("process_name = 'click'"), "ts", ["event_id"])})
    return out.select("row_no", "a_event_id", "b_event_id")


@check("snk_alert_sessions_wide", """
SELECT device_id AS device, cast(count(*) FILTER (WHERE process_name = 'click') AS bigint) AS click, count(*) FILTER (WHERE process_name = 'error') AS error,
  count(*) FILTER (WHERE process_name = 'purchase') AS purchase, count(*) FILTER (WHERE process_name = 'signup') AS signup, count(*) FILTER (WHERE process_name = 'view') AS view
FROM ev GROUP BY 1""")
def _(spark, d):
    rows = ev(spark, d).select(F.col("device_id").alias("device"), F.col("process_name").alias("code"))
    return K.alert_sessions_wide(rows, K.code_order(rows), ["device"])


@check("snk_config_wide", """
SELECT device_id AS device, max(CASE WHEN process_name = 'click' THEN n END) AS click, max(CASE WHEN process_name = 'error' THEN n END) AS error FROM (
  SELECT device_id, process_name, count(DISTINCT k) n FROM ev GROUP BY 1, 2) GROUP BY 1""")
def _(spark, d):
    rows = ev(spark, d).select(F.col("device_id").alias("device"), F.col("process_name").alias("section"), F.col("k").cast("string").alias("key"),
                               F.lit("v").alias("value")).distinct()
    wide = K.config_wide(rows, ["click", "error"])
    return wide.select("device", *[F.size(F.map_keys(F.from_json(c, "map<string,string>"))).cast("bigint").alias(c) for c in ("click", "error")])


@check("snk_replace_window", f"""
SELECT event_id, CASE WHEN {WIN} THEN 'new' ELSE 'old' END AS gen FROM ev WHERE NOT ({WIN}) OR type = 'ERROR'""")
def _(spark, d):
    path = scratch(spark)
    e = ev(spark, d).select("event_id", "ts", "type")
    e.withColumns({"gen": F.lit("old"), "day": F.to_date("ts")}).write.partitionBy("day").parquet(path)
    K.replace_window(e.filter("type = 'ERROR'").withColumn("gen", F.lit("new")), path, A, B)
    return spark.read.parquet(path).select("event_id", "gen")


@check("set_union_days", "SELECT event_id FROM ev")
def _(spark, d):
    e = ev(spark, d).select("event_id")
    return K.union_days(e.filter("event_id % 3 <> 0"), e.filter("event_id % 2 = 0"), e.filter("event_id % 6 in (1, 3, 5)"))


@check("flt_safe_select", "SELECT version, count(*) AS n FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1000")
def _(spark, d):
    from tripline.plans.adhoc import safe_select

    ev(spark, d).createOrReplaceTempView("critical_events")
    return safe_select(spark, "select version, count(*) as n from critical_events group by version order by n desc, version", 1000)


# ── one-to-one matching ──


@check("join_greedy_matching", """
SELECT version, section, issue, score FROM (
  WITH RECURSIVE c AS (SELECT event_id // 40 AS version, k % 7 AS section, user_id % 9 AS issue, value AS score, row_number() OVER (PARTITION BY event_id // 40 ORDER BY value DESC, k % 7, user_id % 9, event_id) AS r FROM ev),
  walk AS (SELECT DISTINCT version, 0::BIGINT AS r, NULL::BIGINT AS section, NULL::BIGINT AS issue, NULL::DOUBLE AS score, false AS took, []::BIGINT[] AS ss, []::BIGINT[] AS ii FROM c
    UNION ALL SELECT version, r, section, issue, score, free, CASE WHEN free THEN list_append(ss, section) ELSE ss END, CASE WHEN free THEN list_append(ii, issue) ELSE ii END
    FROM (SELECT c.version, c.r, c.section::BIGINT AS section, c.issue::BIGINT AS issue, c.score, w.ss, w.ii, NOT list_contains(w.ss, c.section) AND NOT list_contains(w.ii, c.issue) AS free FROM walk w JOIN c ON c.version = w.version AND c.r = w.r + 1))
  SELECT * FROM walk WHERE took)""")
def _(spark, d):
    from tripline.operators.matching import greedy_matching

    pairs = ev(spark, d).select(F.floor(F.col("event_id") / 40).alias("version"), (F.col("k") % 7).cast("bigint").alias("section"), (F.col("user_id") % 9).cast("bigint").alias("issue"), F.col("value").alias("score"))
    return greedy_matching(pairs, ["version", "section"], ["version", "issue"], tie=["section", "issue"])


@check("join_assign_issues")
def _(spark, d):
    """Parts of a brand as issues of a version, their kinds as sections; the sequence ratio has no SQL (tests/test_issues.py)."""
    from tripline.plans.issues import assign_issues

    part = table(spark, d, "part")
    kinds = part.groupBy("p_brand", "p_name", "p_type").agg(F.min("p_partkey").alias("section_no"))
    sections = kinds.select(F.col("p_brand").alias("version"), "section_no", F.concat(F.lit("## ["), F.lower("p_type"), F.lit("] "), "p_name", F.lit("\n"), "p_brand").alias("text"))
    issues = part.select(F.col("p_brand").alias("version"), F.col("p_partkey").alias("issue_no"), F.concat(F.lit("K-"), F.col("p_partkey").cast("string")).alias("issue_key"),
                         F.concat("p_name", F.lit(" "), "p_type").alias("summary"), F.col("p_size").cast("string").alias("description"))
    return assign_issues(sections, issues)


@check("agg_p90", "SELECT process_name, tenant_id, quantile_cont(value, 0.9) AS p90 FROM ev GROUP BY 1, 2")
def _(spark, d):
    from tripline.plans.metrics import p90

    return p90(ev(spark, d), ["process_name", "tenant_id"], "value")


@check("src_read_logs", """
SELECT 'd' || (user_id % 8) AS device, cast(date_trunc('month', ts) AS date)::VARCHAR AS day, process_name AS service, row_number() OVER (PARTITION BY user_id % 8, date_trunc('month', ts), process_name ORDER BY event_id) - 1 AS line_no,
  (epoch_us(ts) // 1000) || ': ' || event_id || ': ' || description AS line, (epoch_us(ts) // 1000) AS ts FROM ev""")
def _(spark, d):
    from tripline.session import scratch
    from tripline.sources.readers import read_logs

    rows = ev(spark, d).select(F.concat(F.lit("d"), (F.col("user_id") % 8).cast("string")).alias("device"), F.trunc("ts", "month").cast("string").alias("day"), F.col("process_name").alias("service"), "event_id",
                               F.concat(ms("ts").cast("string"), F.lit(": "), F.col("event_id").cast("string"), F.lit(": "), "description").alias("line"))
    folder = scratch(spark)
    spread = rows.repartition("device", "day", "service").sortWithinPartitions("device", "day", "service", "event_id")
    spread.drop("event_id").write.partitionBy("device", "day", "service").text(f"{folder}/raw")
    # one file per device, month and service gets the name a device gives it
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(hadoop.Path(f"{folder}/raw/device=*/day=*/service=*/part-*")):
        device, day, service = (x.partition("=")[2] for x in found.getPath().toString().split("/")[-4:-1])
        fs.mkdirs(hadoop.Path(f"{folder}/logs/{device}/{day}/logs"))
        fs.rename(found.getPath(), hadoop.Path(f"{folder}/logs/{device}/{day}/logs/{service}.log"))
    return read_logs(spark, f"{folder}/logs").select("device", F.col("day").cast("string").alias("day"), "service", "line_no", "line", "ts")


# ── lists in parts ──

_PARTS = """
SELECT process_name, code, {aux} upper(type) AS type, priority, pattern, n // 3 AS segment, min(n // 3 * 3) AS first_no, string_agg(device_id, ',' ORDER BY device_id) AS devices
FROM (SELECT *, row_number() OVER (PARTITION BY process_name, code, {aux} type, priority, pattern ORDER BY device_id) - 1 AS n
  FROM (SELECT DISTINCT process_name, code, {aux} type, priority, regexp_replace(description, '\\S*[0-9]\\S*', '<N>', 'g') AS pattern, device_id FROM ev)) GROUP BY ALL"""


@check("agg_process_code_devices", _PARTS.format(aux="code_aux,"))
def _(spark, d):
    return E.process_code_devices(ev(spark, d), 3).withColumn("devices", F.array_join("devices", ","))


@check("agg_merged_code_devices", _PARTS.format(aux=""))
def _(spark, d):
    return E.process_code_devices(ev(spark, d), 3, aux=False).withColumn("devices", F.array_join("devices", ","))


@check("agg_process_code_counts", """
SELECT process_name, code, code_aux, upper(type) AS type, priority, regexp_replace(description, '\\S*[0-9]\\S*', '<N>', 'g') AS pattern, min(description) AS sample, cast(sum(cnt) AS bigint) AS occurrences,
  count(DISTINCT device_id) AS n_devices FROM ev GROUP BY ALL""".replace("\\\\", "\\"))
def _(spark, d):
    return E.process_code_table(ev(spark, d), lists=False)


@check("snk_devices_by_state_rows", """
SELECT version, state, n // 50 AS segment, min(n) AS first_no, string_agg(device_id, ',' ORDER BY device_id) AS devices
FROM (SELECT *, row_number() OVER (PARTITION BY version, state ORDER BY device_id) - 1 AS n FROM devs) GROUP BY version, state, n // 50""")
def _(spark, d):
    return K.devices_by_state(_list(spark, d), 50).withColumn("devices", F.array_join("devices", ","))


@check("agg_error_files", """
SELECT pattern, n // 2 AS segment, min(n) AS first_no, string_agg(file, ',' ORDER BY file) AS files FROM (SELECT pattern, file, row_number() OVER (PARTITION BY pattern ORDER BY file) - 1 AS n
  FROM (SELECT DISTINCT regexp_replace(description, '\\S*[0-9]\\S*', '<N>', 'g') AS pattern, device_id AS file FROM ev)) GROUP BY pattern, n // 2""")
def _(spark, d):
    from tripline.plans.patterns import error_files

    return error_files(ev(spark, d).select(F.col("description").alias("message"), F.col("device_id").alias("file")), 2).withColumn("files", F.array_join("files", ","))


@check("agg_outlier_devices", """
SELECT metric, n // 4 AS segment, min(n) AS first_no, string_agg(device, ',' ORDER BY o DESC, device) AS devices FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY o DESC, device) - 1 AS n
  FROM (SELECT process_name AS metric, device_id AS device, max(k) AS o FROM ev WHERE k > 50 GROUP BY 1, 2)) GROUP BY metric, n // 4""")
def _(spark, d):
    from tripline.plans.findings import outlier_devices

    rows = ev(spark, d).select(F.col("process_name").alias("metric"), F.col("device_id").alias("device"), F.col("k").alias("off_by"), (F.col("k") > 50).alias("outside"))
    return outlier_devices(rows, 4).withColumn("devices", F.array_join("devices", ","))
