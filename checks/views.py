"""The driver's tables as the inputs of the library (and the same views as SQL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from checks import view
from tripline.session import settle


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ms(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_millis(c.cast("timestamp"))


def k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def ev(spark: SparkSession, d: str, spread: bool = False) -> DataFrame:
    """critical_events from events.

    ``spread``: dealt to all tasks and settled first, for work that costs far more than reading; few row groups are few tasks, and what is
    filtered later would be worked out by them, before the shuffle.
    """
    e = table(spark, d, "events")
    e = settle(e.repartition("event_id").withColumn("k", k()).drop("props")) if spread else e.withColumn("k", k())
    error = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").cast("string").alias("device_id"), "ts", "event_id", F.col("event_type").alias("process_name"),
        F.col("k").cast("double").alias("code"), (F.col("event_id") % 3).alias("code_aux"), (F.col("event_id") % 4).alias("cnt"),
        F.concat("event_type", F.lit(" failed "), (F.col("event_id") % 7).cast("string"), F.lit(" retry x"),
                 F.col("k").cast("string"), F.lit(" end")).alias("description"),
        F.concat((2 + F.col("user_id") % 4).cast("string"), F.lit(".6."), (F.col("user_id") % 17).cast("string"), F.lit(".rc."),
                 (F.col("user_id") % 3).cast("string")).alias("version"),
        F.when(error, "ERROR").otherwise("INFO").alias("type"),
        F.concat(F.lit("P"), F.when(error, F.col("k") % 5).otherwise(100 + F.col("k") % 5).cast("string")).alias("priority"),
        (F.col("user_id") % 9).alias("tenant_id"), "k", "user_id", "value")


view("ev", """
SELECT cast(user_id AS varchar) device_id, ts, event_id, event_type process_name, cast(k AS double) code, event_id % 3 code_aux,
  event_id % 4 cnt, event_type || ' failed ' || (event_id % 7) || ' retry x' || k || ' end' description,
  (2 + user_id % 4) || '.6.' || (user_id % 17) || '.rc.' || (user_id % 3) AS version,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS type,
  'P' || (CASE WHEN event_type = 'error' THEN k % 5 ELSE 100 + k % 5 END) priority, user_id % 9 tenant_id, k, user_id, value
FROM (SELECT *, cast(json_extract_string(props, '$.k') AS int) k FROM events)""")


def pattern_map(events: DataFrame) -> DataFrame:
    """Every second distinct (type, template) pair of the events as a map row; the rest stays unknown."""
    from tripline.functions.text import normalize_description

    rows = events.filter("event_id % 2 = 0").select(normalize_description("description").alias("description_pattern"), "process_name")
    per = rows.groupBy("description_pattern").agg(F.min("process_name").alias("p"))
    return per.filter("p in ('error', 'click', 'view')").select(
        "description_pattern", F.when(F.col("p") == "error", "ERROR").otherwise("INFO").alias("type"),
        F.concat(F.lit("P"), F.length("p").cast("string")).alias("priority"))


view("norm", r"""
SELECT *, trim(regexp_replace(description, '\S*[0-9]\S*', '<N>', 'g'), E'\t\n\f\r ') AS pattern FROM ev""")
view("pmap", """
SELECT pattern AS description_pattern, CASE WHEN p = 'error' THEN 'ERROR' ELSE 'INFO' END AS type, 'P' || length(p) AS priority
FROM (SELECT pattern, min(process_name) p FROM norm WHERE event_id % 2 = 0 GROUP BY 1) WHERE p IN ('error', 'click', 'view')""")


def obs(spark: SparkSession, d: str) -> DataFrame:
    """recordings from orders."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    start = F.expr("timestampadd(SECOND, o_orderkey % 86400, o_orderdate)")
    return o.select(
        (F.col("o_custkey") % 50).cast("string").alias("device_id"), key.cast("string").alias("file_name"), start.alias("start_time"),
        F.expr("timestampadd(SECOND, o_orderkey % 86400 + o_orderkey % 90, o_orderdate)").alias("end_time"),
        F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 0).alias("ignition_status"),
        (key % 900).alias("uptime"), (key % 80).cast("double").alias("max_speed"),
        F.concat((2 + F.col("o_custkey") % 4).cast("string"), F.lit(".6."), (key % 2).cast("string")).alias("ota"),
        F.when(key % 3 == 0, (key % 70).cast("string")).when(key % 3 == 1, "n/a").alias("num_frames_out"),
        F.when(key % 2 == 0, "").otherwise("full").alias("metadatastatus"))


view("obs", """
SELECT cast(o_custkey % 50 AS varchar) device_id, cast(o_orderkey AS varchar) file_name,
  o_orderdate + to_seconds(o_orderkey % 86400) start_time, o_orderdate + to_seconds(o_orderkey % 86400 + o_orderkey % 90) end_time,
  CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 0 END ignition_status, o_orderkey % 900 uptime,
  cast(o_orderkey % 80 AS double) max_speed, (2 + o_custkey % 4) || '.6.' || (o_orderkey % 2) ota,
  CASE WHEN o_orderkey % 3 = 0 THEN cast(o_orderkey % 70 AS varchar) WHEN o_orderkey % 3 = 1 THEN 'n/a' END num_frames_out,
  CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'full' END metadatastatus
FROM orders""")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """samples from lineitem."""
    li = table(spark, d, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return li.select(
        F.col("l_orderkey").cast("string").alias("file_name"), (F.row_number().over(w) - 1).alias("seq_no"),
        (F.col("l_quantity") / 4).alias("accuracy"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 0).alias("valid"),
        (F.col("l_discount") * 100).alias("lat"), (F.col("l_tax") * 100).alias("lon"),
        (F.col("l_extendedprice") / 1000).alias("speed"), F.col("l_shipdate").alias("sample_ts"))


view("smp", """
SELECT cast(l_orderkey AS varchar) file_name,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 seq_no,
  l_quantity / 4 accuracy, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 END valid, l_discount * 100 lat, l_tax * 100 lon,
  l_extendedprice / 1000 speed, l_shipdate sample_ts
FROM lineitem""")


def lines(spark: SparkSession, d: str, spread: bool = False) -> DataFrame:
    """Device log lines rendered from events: one file per device and service, numbered in time order."""
    e = ev(spark, d, spread)
    level = F.when(F.col("type") == "ERROR", "E").otherwise("I")
    line = F.concat(ms("ts").cast("string"), F.lit(": "), F.col("event_id").cast("string"), F.lit(": "), F.upper("process_name"),
                    F.lit(": "), level, F.lit(": "), F.floor(F.col("event_id") / 500).cast("string"), F.lit(": "),
                    (F.col("k") % 5).cast("string"), F.lit(": "), F.col("description"))
    return e.select(F.col("device_id").alias("device"), F.to_date("ts").alias("day"), F.col("process_name").alias("service"),
                    F.concat("device_id", F.lit("/"), "process_name").alias("file"), F.col("event_id").alias("line_no"),
                    line.alias("line"), ms("ts").alias("ts"), "k", (F.col("k") % 2 == 0).alias("critical"))


view("lines", """
SELECT device_id device, cast(ts AS date) AS day, process_name service, device_id || '/' || process_name AS file, event_id line_no,
  (epoch_us(ts) // 1000) || ': ' || event_id || ': ' || upper(process_name) || ': ' || (CASE WHEN type = 'ERROR' THEN 'E' ELSE 'I' END) || ': '
  || cast(event_id // 500 AS varchar) || ': ' || (k % 5) || ': ' || description AS line, (epoch_us(ts) // 1000) AS ts, k, k % 2 = 0 critical
FROM ev""")
