"""Readers (SRC-04 .. SRC-17)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tripline.functions import text as X
from tripline.operators.timeline import scan

_TEXT_FIELDS = ("deviceId", "app_ver", "videoName", "metadataStatus", "udid", "systemUpTime", "serviceUpTime", "Voltage in Volts", "NRT_STATUS", "tripNo",
                "driverInvariantSession", "vehClass", "vehicleId", "cameras", "prevVideoName", "nextVideoName", "startTimeLd", "inwardStartTime",
                "inwardStartTimeLd", "vin", "can_firmware_ver", "offset", "can_src", "can_sn", "engine_status", "irled_status", "audioEnable", "rtcValid",
                "rtc_jump_from", "rtc_jump_to", "sessionCount", "validGPSEntries", "gpsStartTime", "gpsEndTime", "obdFormat")
#: Objects and arrays kept as JSON text.
_JSON_FIELDS = ("deviceModes", "inference_data", "sensorMetaData", "driverId", "session_embedding", "burst_mode", "fuel_report", "irled_states",
                "user_generated_alert")
OBSERVATION_SCHEMA = T.StructType([
    *[T.StructField(n, T.StringType()) for n in (*_TEXT_FIELDS, *_JSON_FIELDS)],
    T.StructField("startTime", T.LongType()), T.StructField("endTime", T.LongType()),
    T.StructField("networkInfo", T.StructType([T.StructField(n, T.StringType()) for n in ("rssi", "sinr", "rat", "recordedTime")])),
    T.StructField("videoMetaData", T.ArrayType(T.StructType([
        T.StructField("valid", T.BooleanType()), T.StructField("accuracy", T.DoubleType()), T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()), T.StructField("speed", T.DoubleType()), T.StructField("timestamp", T.LongType())]))),
])


def read_observations(spark: SparkSession, path: str, schema: T.StructType = OBSERVATION_SCHEMA) -> DataFrame:
    """SRC-04: one JSON document per file; broken files are skipped, documents without a device dropped."""
    docs = (spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED")
            .option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(path))
    return docs.withColumn("path", F.input_file_name()).filter(F.coalesce("deviceId", F.lit("")) != "")


# Fixed value: <device>/<day>/logs/<service>[_c].log[.N], or .../syslogs/<file>
_LOG_PATH = r"([^/]+)/(\d{4}-\d{2}-\d{2})/(?:logs/)?(?:(syslogs)/)?([^/]+?)(_c)?\.log(?:\.\d+)?$"


def path_fields(path) -> dict:
    """Device, day, service and kind of a log file from its path."""
    part = {n: F.regexp_extract(path, _LOG_PATH, i) for n, i in (("device", 1), ("day", 2), ("sys", 3), ("name", 4), ("c", 5))}
    return {"device": part["device"], "day": F.to_date(F.nullif(part["day"], F.lit(""))),
            "service": F.when(part["sys"] != "", "syslogs").otherwise(part["name"]), "critical": part["c"] != ""}


def read_logs(spark: SparkSession, root: str) -> DataFrame:
    """SRC-05: log lines with device, day, service, file and line number (from 0, empty lines counted but left out), in file order.

    Files are read in splits, so a file of any size is read by many tasks.
    """
    lines = numbered_lines(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.log*").text(root, lineSep="\n")).filter("line != ''")
    out = lines.select(*[c.alias(n) for n, c in path_fields(F.col("file")).items()], "file", "line_no", "line")
    return out.withColumn("ts", X.line_ts("line"))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """(file, line_no, line) of a text scan: numbers count from 0 per file, over all its splits.

    Rows of one split follow each other in one partition, so a row's place in its split is the difference of two
    increasing ids.  What the splits before it hold is a running sum over one row per split.  A carriage return before the line feed
    belongs to the line's end.
    """
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value")
    splits = rows.groupBy("file", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "split", "first", before.alias("before"))
    return rows.join(starts, ["file", "split"]).select("file", (F.col("id") - F.col("first") + F.col("before")).alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))


def load_devices(spark: SparkSession, glob: str, state: str = "INSTALLED") -> DataFrame:
    """SRC-06: devices of a state with their tenant; the later file (by path) wins."""
    rows = spark.read.option("header", True).csv(glob).withColumn("path", F.input_file_name())
    ok = (F.upper(F.trim("Device_State")) == state) & (F.trim("Device_ID") != "")
    return rows.filter(ok).groupBy(F.trim("Device_ID").alias("device_id")).agg(
        F.max_by(F.trim(F.coalesce("Tenant_Display_Name", F.lit(""))), "path").alias("tenant"))


def load_pattern_map(spark: SparkSession, path: str) -> DataFrame:
    """SRC-08: pattern map: trimmed, upper-case type and priority, both required, first pattern wins."""
    rows = spark.read.option("multiLine", True).schema("description_pattern string, type string, priority string").json(path)
    return check_pattern_map(rows.withColumn("__i", F.monotonically_increasing_id()), "__i")


def check_pattern_map(rows: DataFrame, order: str) -> DataFrame:
    """The rules of SRC-08 on a frame; an empty type or priority stops the job."""
    def need(c: str):
        v = F.upper(F.trim(F.coalesce(c, F.lit(""))))
        return F.when(v == "", F.raise_error(F.concat(F.lit(f"pattern without {c}: "), "description_pattern")).cast("string")).otherwise(v)

    clean = rows.select(F.trim("description_pattern").alias("description_pattern"), need("type").alias("type"),
                        need("priority").alias("priority"), order)
    return clean.groupBy("description_pattern").agg(F.min_by(F.struct("type", "priority"), order).alias("r")).select(
        "description_pattern", "r.*")


def ini_rows(lines: DataFrame, file: str = "file", value: str = "line", order: str = "line_no") -> DataFrame:
    """SRC-09: (file, section, key, value) of INI lines; the first of a repeated key wins."""
    text = F.trim(value)
    head = F.regexp_extract(text, r"^\[([^\]]*)\]", 1)
    rows = lines.filter((text != "") & ~F.substring(text, 1, 1).isin(";", "#")).withColumns(
        {"__t": text, "__head": F.when(text.rlike(r"^\[[^\]]*\]"), F.trim(head))})
    rows = scan(rows, [file], order, last={"section": "__head"}, width_s=100)
    pairs = rows.filter(F.col("__head").isNull() & F.col("section").isNotNull() & F.contains("__t", F.lit("=")))
    key = F.trim(F.substring_index("__t", "=", 1))
    raw = F.expr("substring(__t, instr(__t, '=') + 1)")
    return pairs.withColumns({"key": key, "raw": raw, "value": F.btrim(F.trim(F.substring_index(raw, ";", 1)), F.lit('"'))}).groupBy(
        file, "section", "key").agg(F.min_by(F.struct("value", "raw"), order).alias("r")).select(file, "section", "key", "r.*")


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return raw.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def read_ini(spark: SparkSession, path: str) -> DataFrame:
    """SRC-09: (file, section, key, value) of INI files."""
    return ini_rows(_file_lines(spark, path)).drop("raw")


def merge_ini(*dfs: DataFrame) -> DataFrame:
    """SRC-10: several configurations as one; the earlier one wins per section and key."""
    parts = [df.select("section", "key", "value").withColumn("__rank", F.lit(i)) for i, df in enumerate(dfs)]
    return reduce(DataFrame.unionByName, parts).groupBy("section", "key").agg(F.min_by("value", "__rank").alias("value"))


def config_json_rows(df: DataFrame, col: str = "config", keep: tuple[str, ...] = ("device",)) -> DataFrame:
    """SRC-11: (device, section, key, value) of a configuration JSON; empty names and broken JSON give nothing."""
    doc = F.from_json(col, "sections array<struct<sectionName string, values map<string,string>>>")
    rows = df.select(*keep, F.explode(doc["sections"]).alias("s")).select(
        *keep, F.trim("s.sectionName").alias("section"), F.explode("s.values").alias("key", "value"))
    return rows.filter((F.coalesce("section", F.lit("")) != "") & (F.col("key") != ""))


def features_of(ini: DataFrame) -> DataFrame:
    """SRC-12: (feature, section, key, expected) of INI rows whose values are JSON objects."""
    doc = F.from_json(F.trim("raw"), "map<string,string>")
    return ini.select(F.col("section").alias("feature"), F.col("key").alias("section"), F.explode(doc).alias("key", "expected"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return features_of(ini_rows(_file_lines(spark, path)))


def state_rules_of(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-13: rules (dimension, value, service, pattern) and settings (dimension, name, value).

    Rule lines may repeat a value, so every line counts.
    """
    text = F.trim("line")
    head = F.when(text.rlike(r"^\[.*\]$"), F.trim(F.regexp_extract(text, r"^\[(.*)\]$", 1)))
    rows = lines.filter((text != "") & ~F.substring(text, 1, 1).isin(";", "#")).withColumn("__head", head)
    rows = scan(rows, ["file"], "line_no", last={"dimension": "__head"}, width_s=100).filter("__head is null")
    rows = rows.select("dimension", "line_no", F.trim(F.substring_index(text, "=", 1)).alias("name"),
                       F.trim(F.expr("substring(trim(line), instr(trim(line), '=') + 1)")).alias("rest"))
    setting = F.col("name").isin("default", "once")
    rules = rows.filter(~setting).select("dimension", F.col("name").alias("value"), F.trim(F.substring_index("rest", "|", 1)).alias("service"),
                                         F.trim(F.expr("substring(rest, instr(rest, '|') + 1)")).alias("pattern"))
    settings = rows.filter(setting).select("dimension", "name", F.explode(F.split("rest", r"\s*,\s*")).alias("value"))
    return rules, settings


def read_state_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return state_rules_of(_file_lines(spark, path))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_known_patterns(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: explained patterns, one JSON object per line; no file means none."""
    schema = "pattern string, explanation string"
    return spark.read.schema(schema).json(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def read_pattern_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15: (rank, description_pattern, type) rows of a CSV, rows with an empty field dropped."""
    rows = spark.read.option("header", True).csv(path).withColumn("rank", F.monotonically_increasing_id())
    p, t = F.trim("description_pattern"), F.trim("TYPE")
    return rows.select("rank", p.alias("description_pattern"), t.alias("type")).filter("description_pattern != '' and type != ''")


def labelled_of(rows: DataFrame, only_unassigned: bool = False) -> DataFrame:
    """SRC-16: rows labelled ERROR or INFO, texts that mean nothing as NULL."""
    def clean(c: str):
        return F.when(F.upper(F.trim(c)).isin("", "NULL", "NONE", "NAN", "N/A"), None).otherwise(F.trim(c))

    out = rows.withColumns({"description": clean("description"), "type": F.upper(clean("type")), "priority": clean("priority")})
    out = out.filter(F.col("type").isin("ERROR", "INFO") & F.col("description").isNotNull())
    return out.filter(F.col("priority").isNull()) if only_unassigned else out


def read_labelled(spark: SparkSession, path: str, only_unassigned: bool = False) -> DataFrame:
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = {"description", "type", "priority"} - set(rows.columns)
    if missing:
        raise ValueError(f"{path}: missing columns {sorted(missing)}")
    return labelled_of(rows, only_unassigned)


def copy_range(src: DataFrame, dst: str, start: str, end: str, ts: str = "ts", partition: str = "day") -> None:
    """SRC-17: copy [start, end) of a table to another; half-open, so rows of one time stay together."""
    kind = src.schema[ts].dataType
    rows = src.filter((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.lit(end).cast(kind)))
    rows.withColumn(partition, F.to_date(ts)).write.mode("append").partitionBy(partition).parquet(dst)


def read_jdbc_range(spark: SparkSession, url: str, table: str, ts: str, start: str, end: str, parts: int = 64,
                    **options: str) -> DataFrame:
    """SRC-17: the same range of a database table, fetched by ``parts`` tasks at once."""
    return (spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", ts)
            .option("lowerBound", start).option("upperBound", end).option("numPartitions", parts).options(**options).load()
            .filter((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end))))
