"""Column builders over events, documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks.views import ev, lines, obs, table
from tripline.functions import scalars as S
from tripline.functions import text as X
from tripline.plans import events as E
from tripline.plans import observations as O


def _docs(expr, spark, d):
    return table(spark, d, "documents").select("doc_id", expr.alias("out"))


@check("txt_normalize_description", r"""
SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\S*[0-9]\S*', '<N>', 'g'), E'\t\n\f\r ') AS out FROM documents""")
def _(spark, d):
    return _docs(X.normalize_description("text"), spark, d)


@check("txt_mask_tokens", r"SELECT doc_id, regexp_replace(text, '\S*[0-9]\S*', '<N>', 'g') AS out FROM documents")
def _(spark, d):
    return _docs(X.mask_tokens("text"), spark, d)


@check("txt_normalize_regex_trim", r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\S*[0-9]\S*', '<N>', 'g'), '^\s+', ''), '\s+$', '') AS out
FROM documents""")
def _(spark, d):
    return _docs(X.normalize_description("text", "regex"), spark, d)


@check("txt_normalize_prefix", r"""
SELECT event_id, regexp_replace(regexp_replace(regexp_replace(upper(trim(description)), '\b[0-9]+(?:\.[0-9]+)?\b', '%', 'g'),
  ' *[^A-Z ].*$', '%', 'g'), '%+', '%', 'g') AS out FROM ev""")
def _(spark, d):
    return ev(spark, d).select("event_id", X.normalize_prefix("description").alias("out"))


@check("txt_search_phrase", r"""
SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(description), '(^|\s)\S*[0-9](.|\n)*$', ''),
  '[^\w\s.'']', ' ', 'g'), '\s+', ' ', 'g')) AS out FROM ev""")
def _(spark, d):
    return ev(spark, d).select("event_id", X.search_phrase("description").alias("out"))


@check("txt_line_ts", "SELECT line_no, ts AS out FROM lines")
def _(spark, d):
    return lines(spark, d).select("line_no", X.line_ts("line").alias("out"))


@check("txt_line_ts_dated", "SELECT event_id, epoch_us(ts) // 1000 AS out FROM ev")
def _(spark, d):
    dated = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" - svc - INFO - x"))
    return ev(spark, d).select("event_id", X.line_ts(dated).alias("out"))


@check("txt_parse_native", """
SELECT line_no AS uptime, ts, upper(service) AS tag, CASE WHEN service = 'error' THEN 'E' ELSE 'I' END AS level,
  line_no // 500 AS pid, cast(k % 5 AS bigint) AS tid, length(line) AS n FROM lines""")
def _(spark, d):
    f = X.native_fields("line")
    return lines(spark, d).select(*[f[n].alias(n) for n in ("uptime", "ts", "tag", "level", "pid", "tid")],
                                  F.length("line").cast("bigint").alias("n"))


@check("txt_front_matter", r"""
SELECT doc_id, nullif(substr(regexp_replace(trim(regexp_extract(regexp_extract('---' || chr(10) || 'title: t' || chr(10) ||
  'description: ' || text || chr(10) || '---' || chr(10) || 'body', '(?s)^---\s*\n(.*?)\n---', 1), '(?m)^description:[ \t]*(.*)$', 1)),
  '^["'']|["'']$', '', 'g'), 1, 150), '') AS out FROM documents""")
def _(spark, d):
    doc = F.concat(F.lit("---\ntitle: t\ndescription: "), F.col("text"), F.lit("\n---\nbody"))
    return table(spark, d, "documents").select("doc_id", X.front_matter_description(doc).alias("out"))


@check("txt_media_name", """
SELECT event_id, 1500000000000 + event_id AS rec_epoch, cast(k AS double) + 0.25 AS lat, cast(-(k + 1) AS double) - 0.5 AS lon,
  FALSE AS no_fix, 1500000000000 + event_id AS field7 FROM ev""")
def _(spark, d):
    n = F.col("k").cast("string")
    name = F.concat(F.lit("0_trip1_part2_"), n, F.lit(".25_-"), (F.col("k") + 1).cast("string"), F.lit(".5_0.0_"),
                    (F.lit(1500000000000) + F.col("event_id")).cast("string"), F.lit("_y.mp4"))
    f = X.media_name_fields(F.replace(name, F.lit("_y.mp4"), F.lit("_y")))
    return ev(spark, d).select("event_id", *[f[c].alias(c) for c in ("rec_epoch", "lat", "lon", "no_fix")],
                               f["field7"].alias("field7"))


FAMILY = "CASE {m} WHEN '2' THEN 'family2' WHEN '3' THEN 'family3' WHEN '4' THEN 'family4' WHEN '5' THEN 'family5' WHEN '7' THEN 'family7' END"


@check("txt_family", f"""
SELECT event_id, coalesce({FAMILY.format(m="split_part(version, '.', 1)")}, 'other') AS scanned,
  {FAMILY.format(m="split_part(version, '.', 1)")} AS by_sp, {FAMILY.format(m="split_part(version, '.', 1)")} AS by_prefix FROM ev""")
def _(spark, d):
    special = F.concat(F.lit("63.1.1.sp."), "version")
    return ev(spark, d).select("event_id", X.family_scan(special).alias("scanned"), X.family_sp(special).alias("by_sp"),
                               X.family_prefix("version").alias("by_prefix"))


@check("txt_version_order", """
SELECT version, row_number() OVER (ORDER BY a, b, c) AS position FROM (
  SELECT DISTINCT version, cast(split_part(version, '.', 1) AS int) a, cast(split_part(version, '.', 3) AS int) b,
  cast(split_part(version, '.', 5) AS int) c FROM ev)""")
def _(spark, d):
    from pyspark.sql.window import Window as W

    vs = ev(spark, d).select("version").distinct()
    both = W.orderBy(X.version_key("version"))
    return vs.select("version", F.row_number().over(both).cast("bigint").alias("position"))


@check("txt_merge_versions", """
SELECT version, row_number() OVER (ORDER BY cast(split_part(version, '.', 1) AS int) DESC, cast(split_part(version, '.', 3) AS int) DESC,
  cast(split_part(version, '.', 5) AS int) DESC) AS position, CASE WHEN first_even THEN 0 ELSE 1 END AS list
FROM (SELECT version, bool_or(event_id % 2 = 0) first_even FROM ev GROUP BY 1)""")
def _(spark, d):
    from pyspark.sql.window import Window as W

    e = ev(spark, d)
    merged = E.merge_versions(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"))
    return merged.select("version", F.row_number().over(W.orderBy(X.version_key("version").desc())).cast("bigint").alias("position"),
                         "list")


@check("txt_latest_versions", """
SELECT line, arg_max(version, b * 1000 + c) AS version FROM (SELECT version, 'line' || split_part(version, '.', 1) AS line,
  cast(split_part(version, '.', 3) AS int) b, cast(split_part(version, '.', 5) AS int) c FROM ev) GROUP BY 1""")
def _(spark, d):
    return E.latest_versions(ev(spark, d).select("version").distinct(), {f"line{n}": f"{n}." for n in (2, 3, 4, 5)})


@check("txt_same_value", """
SELECT event_id, (k % 2 = 1 AND code_aux = 1) OR (k % 2 = 0 AND code_aux = 0) OR (k % 2 = code_aux) AS same FROM ev""")
def _(spark, d):
    a = F.when(F.col("k") % 2 == 1, "ON").otherwise('"Off"')
    b = F.col("code_aux").cast("double").cast("string")
    return ev(spark, d).select("event_id", X.same_value(a, b).alias("same"))


@check("txt_slug", r"""
SELECT page_id, coalesce(nullif(trim(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'report') AS out,
  coalesce(nullif(substr(trim(regexp_replace(trim(url), '[\[\]:*?/\\]', '_', 'g'), ''''), 1, 64), ''), 'part') AS safe FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", X.slug("url").alias("out"), X.safe_name("url").alias("safe"))


@check("txt_match_tokens", r"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '),
  lambda w: length(w) > 2))), ' ') AS out FROM documents""")
def _(spark, d):
    return _docs(F.array_join(F.array_sort(X.match_tokens("text")), " "), spark, d)


@check("prj_coercions", """
SELECT event_id, CASE WHEN k * 3 <= 127 THEN cast(k * 3 AS bigint) END AS tiny, CASE WHEN k * 3 <= 255 THEN cast(k * 3 AS bigint) END AS utiny,
  cast(trunc(value) AS bigint) AS whole, cast(NULL AS bigint) AS bad, value AS real, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS flag FROM ev""")
def _(spark, d):
    three = (F.col("k") * 3).cast("string")
    return ev(spark, d).select("event_id", S.to_int(three, 8).alias("tiny"), S.to_int(three, 8, False).alias("utiny"),
                               S.to_int(F.col("value").cast("string")).alias("whole"), S.to_int("description").alias("bad"),
                               S.to_float(F.col("value").cast("string")).alias("real"), S.flag(F.col("k") % 2 == 0).alias("flag"))


@check("prj_arrays", """
SELECT vec_id, round(list_min(list_filter(list_transform(embedding, lambda x: cast(x AS double) * 100), lambda x: x BETWEEN 0 AND 300)), 4) AS lo,
  round(list_max(list_filter(list_transform(embedding, lambda x: cast(x AS double) * 100), lambda x: x BETWEEN 0 AND 300)), 4) AS hi FROM embeddings""")
def _(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double") * 100)
    return table(spark, d, "embeddings").select("vec_id", F.round(S.array_low(v), 4).alias("lo"), F.round(S.array_high(v), 4).alias("hi"))


@check("prj_json_keys", """
SELECT event_id, 'a,k2' AS names, TRUE AS has_k, FALSE AS has_z, '{"a":' || k || '}' AS compact, cast(k AS varchar) AS nested FROM ev""")
def _(spark, d):
    n = F.col("k").cast("string")
    doc = F.concat(F.lit('{"k": '), n, F.lit(', "a": {"b": '), n, F.lit('}, "k2": null}'))
    return ev(spark, d).select(
        "event_id", F.array_join(S.keys_except(doc, ("k",)), ",").alias("names"), S.has_key(doc, "k2").alias("has_k"),
        S.has_key(doc, "z").alias("has_z"), S.json_text(F.struct(F.col("k").alias("a"))).alias("compact"),
        S.json_get(doc, "a", "b", default="none").alias("nested"))


@check("prj_struct_arrays", """
SELECT event_id, device_id || ',' || k AS joined, contains(lower(description), 'error') AS has_error, cast(k AS varchar) AS driver,
  1 AS fields FROM ev""")
def _(spark, d):
    arr = F.array(F.struct(F.col("device_id").alias("v"), F.lit(1).alias("w")), F.struct(F.lit(None).cast("string").alias("v"), F.lit(2).alias("w")),
                  F.struct(F.col("k").cast("string").alias("v"), F.lit(3).alias("w")))
    who = F.array(F.concat(F.lit("driver: id: "), F.col("k").cast("string")))
    return ev(spark, d).select(
        "event_id", S.join_field(arr, "v").alias("joined"), S.any_contains(F.array("process_name", "description"), "ERROR").alias("has_error"),
        S.driver_id(who).alias("driver"), F.size(F.map_keys(F.from_json(F.to_json(F.get(S.project_array(arr, ["w"]), F.lit(0))), "map<string,int>"))).alias("fields"))


@check("prj_labels", """
SELECT event_id, substr(replace(replace(cast(date_trunc('second', ts) AS varchar), 'T', ' '), '  ', ' '), 1, 19) AS t19,
  CASE WHEN type = 'ERROR' THEN 'error' ELSE 'info' END AS severity, CASE WHEN k % 3 = 0 THEN 'UNKNOWN' ELSE upper(process_name) END AS label,
  cast(k AS bigint) AS whole FROM ev""")
def _(spark, d):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    raw = F.when(F.col("k") % 3 == 0, " nan ").otherwise(F.concat(F.lit(" "), "process_name"))
    return ev(spark, d).select("event_id", S.ts19(iso).alias("t19"), S.severity("type").alias("severity"),
                               S.clean_label(raw).alias("label"), S.integral("code", "code").alias("whole"))


@check("prj_explode_samples", """
SELECT conv_id, cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS int) AS seq_no, turn, role FROM conversations""")
def _(spark, d):
    c = table(spark, d, "conversations")
    docs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("samples"))
    return O.explode_samples(docs, "samples", {"conv_id": "conv_id"})


@check("fn_epochs", """
SELECT event_id, date_trunc('second', ts) AS whole_second, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, epoch_us(ts) // 1000000 AS ten,
  epoch_ms(date_trunc('second', ts)) AS back, printf('%02d:%02d:%02d', k // 3600, k // 60, k % 60) AS uptime FROM ev""")
def _(spark, d):
    from checks.views import ms

    t = ms("ts")
    return ev(spark, d).select(
        "event_id", S.epoch_to_timestamp(t).cast("timestamp_ntz").alias("whole_second"), S.epoch_text(t).alias("shown"),
        S.ten_digits(t).alias("ten"), S.text_to_ms(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("back"),
        S.uptime_text(F.col("k") * 1000).alias("uptime"))


@check("fn_days_weeks", """
SELECT cast(cast(x AS date) AS varchar) AS day, cast(count(*) AS bigint) AS n, min(isoyear(x) * 100 + week(x)) AS yearweek FROM (
  SELECT unnest(generate_series(cast(o_orderdate AS date), cast(o_orderdate AS date) + cast(o_orderkey % 5 AS int), INTERVAL 1 DAY)) AS x
  FROM orders) GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "orders")
    end = F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 5).cast("int"))
    x = o.select(F.explode(S.days_between("o_orderdate", end)).alias("x"))
    return x.groupBy(F.col("x").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min(
        F.get(S.week_buckets("x", "x"), F.lit(0))).cast("bigint").alias("yearweek"))


@check("fn_day_windows", """
SELECT file_name, count(*) AS parts, min(a) AS first_start, max(b) AS last_end FROM (
  SELECT file_name, greatest(cast(x AS timestamp), start_time) a, least(cast(x AS timestamp) + INTERVAL 1 DAY - INTERVAL 1 SECOND,
  start_time + INTERVAL 30 HOUR) b FROM (SELECT *, unnest(generate_series(cast(start_time AS date),
  cast(start_time + INTERVAL 30 HOUR AS date), INTERVAL 1 DAY)) x FROM obs)) WHERE a < b GROUP BY 1""")
def _(spark, d):
    w = S.day_windows("start_time", F.col("start_time") + F.expr("INTERVAL 30 HOURS"))
    rows = obs(spark, d).select("file_name", F.explode(w).alias("p"))
    return rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("parts"), F.min("p.start").cast("timestamp_ntz").alias("first_start"),
                                         F.max("p.end").cast("timestamp_ntz").alias("last_end"))


@check("fn_zone_parts", """
SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, strftime(ts + INTERVAL 330 MINUTE, '%H:%M:%S') AS clock,
  dayname(ts + INTERVAL 330 MINUTE) AS weekday FROM ev""")
def _(spark, d):
    p = S.zone_parts(F.col("ts").cast("timestamp"), "Asia/Kolkata")
    return ev(spark, d).select("event_id", p["current_date"].alias("day"), p["current_time"].alias("clock"), p["weekday"].alias("weekday"))


@check("fn_numbers", """
SELECT device_id, count(*) AS n, round(sum(code) / nullif(sum(cnt), 0), 6) AS ratio, round(100.0 * sum(cnt) / nullif(count(*), 0), 6) AS pct,
  round(CASE WHEN min(code) = 0 THEN CASE WHEN max(code) = 0 THEN 0 ELSE 9e9 END ELSE (max(code) - min(code)) * 100 / abs(min(code)) END, 6) AS change,
  round(sum(CASE WHEN cnt > 0 THEN code * cnt END) / sum(CASE WHEN cnt > 0 THEN cnt END), 6) AS wmean, min(version) AS only_version,
  CASE WHEN min(process_name) = max(process_name) THEN min(process_name) ELSE 'several' END AS only_process FROM ev GROUP BY 1""")
def _(spark, d):
    change = S.change_pct(F.min("code"), F.max("code"))
    return ev(spark, d).groupBy("device_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(S.ratio(F.sum("code"), F.sum("cnt")), 6).alias("ratio"),
        F.round(S.percentage(F.sum("cnt"), F.count(F.lit(1))), 6).alias("pct"),
        F.round(F.when(change == float("inf"), 9e9).otherwise(change), 6).alias("change"),
        F.round(S.weighted_mean("code", "cnt"), 6).alias("wmean"), S.single_or("version", "several").alias("only_version"),
        S.single_or("process_name", "several").alias("only_process"))


@check("fn_deviation", """
SELECT event_id, round(CASE WHEN value > 400 THEN (value - 400) / 400 WHEN value < 50 THEN (50 - value) / 50 ELSE 0 END, 6) AS by_range,
  round(abs(value - 100) / 100, 6) AS by_expect FROM ev""")
def _(spark, d):
    none = F.lit(None).cast("double")
    return ev(spark, d).select("event_id", F.round(S.deviation("value", F.lit(50.0), F.lit(400.0), none), 6).alias("by_range"),
                               F.round(S.deviation("value", none, none, F.lit(100.0)), 6).alias("by_expect"))


@check("fn_cosine", """
SELECT a.vec_id, round(list_cosine_similarity(cast(a.embedding AS double[]), list_reverse(cast(a.embedding AS double[]))), 6) AS cos,
  round(list_dot_product(cast(a.embedding AS double[]), cast(a.embedding AS double[])), 6) AS dot FROM embeddings a""")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(S.cosine("embedding", F.reverse("embedding")), 6).alias("cos"),
                                                F.round(S.dot("embedding", "embedding"), 6).alias("dot"))


@check("fn_range_label", """
SELECT file_name, CASE WHEN strftime(start_time, '%Y-%m-%d') = strftime(start_time + INTERVAL 20 HOUR - INTERVAL 1 SECOND, '%Y-%m-%d')
  THEN strftime(start_time, '%Y-%m-%d') ELSE strftime(start_time, '%Y-%m-%d') || '_to_' ||
  strftime(start_time + INTERVAL 20 HOUR - INTERVAL 1 SECOND, '%Y-%m-%d') END AS label FROM obs""")
def _(spark, d):
    return obs(spark, d).select("file_name", S.range_label("start_time", F.col("start_time") + F.expr("INTERVAL 20 HOURS")).alias("label"))


@check("top_priority_order", """
SELECT priority, row_number() OVER (ORDER BY CASE WHEN cast(substr(priority, 2) AS int) < 100 THEN 0 ELSE 1 END, cast(substr(priority, 2) AS int)) AS position
FROM (SELECT DISTINCT priority FROM ev)""")
def _(spark, d):
    from pyspark.sql.window import Window as W

    return ev(spark, d).select("priority").distinct().select(
        "priority", F.row_number().over(W.orderBy(X.priority_key("priority"))).cast("bigint").alias("position"))
