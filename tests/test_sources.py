"""Readers and writers on small files."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from tripline.operators.sequences import global_rank
from tripline.plans import observations as O
from tripline.sources import readers as R
from tripline.sources import sinks as K


def test_logs_keep_line_order(spark, tmp_path):
    day = tmp_path / "dev1" / "2026-10-28" / "logs"
    day.mkdir(parents=True)
    (day / "power_mon.log").write_text("1793148914428: 1: A: I: 1: 1: one\n  continued\n1793148914429: 2: A: I: 1: 1: two\n")
    (day / "power_mon_c.log.1").write_text("1793148914430: 3: A: C: 1: 1: three\n")
    rows = R.read_logs(spark, str(tmp_path)).orderBy("file", "line_no").collect()
    assert {(r["device"], str(r["day"]), r["service"]) for r in rows} == {("dev1", "2026-10-28", "power_mon")}
    assert [r["line"].strip() for r in rows if not r["critical"]][1] == "continued"
    assert sum(r["critical"] for r in rows) == 1
    from tripline.plans.patterns import merge_timeline

    merged = [r["text"] for r in merge_timeline(R.read_logs(spark, str(tmp_path))).collect()]
    assert merged[0].endswith("one\n  continued") and len(merged) == 3


def test_log_lines_of_many_splits_are_numbered_per_file(spark, tmp_path):
    day = tmp_path / "dev1" / "2026-10-28" / "logs"
    day.mkdir(parents=True)
    r = random.Random(5)
    files = {}
    for name, n in (("big", 4000), ("other", 300), ("one", 1), ("none", 0)):
        lines = ["" if r.random() < 0.1 else f"{name} {i} " + "x" * r.randrange(60) + ("y" * 5000 if i % 997 == 5 else "") for i in range(n)]
        (day / f"{name}.log").write_bytes("".join(x + r.choice(("\n", "\r\n")) for x in lines).encode())
        files[name] = lines
    (day / "tail.log").write_text("a\n\nb")  # no line end
    files["tail"] = ["a", "", "b"]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "200")
        df = R.read_logs(spark, str(tmp_path))
        assert spark.read.text(str(day / "big.log")).rdd.getNumPartitions() > 20
        got = {(x["service"], x["line_no"]): x["line"] for x in df.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {(name, i): x for name, lines in files.items() for i, x in enumerate(lines) if x}


def test_observations_skip_broken_documents(spark, tmp_path):
    doc = {"deviceId": "d", "videoName": "v.mp4", "startTime": 1793148914428, "endTime": 1793148974428,
           "videoMetaData": [{"valid": True, "accuracy": 1.5}, None, {"accuracy": 2.0}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text("{}")
    docs = R.read_observations(spark, str(tmp_path))
    assert docs.count() == 1
    flat = docs.select("deviceId", "videoMetaData")
    rows = O.explode_samples(flat, "videoMetaData", {"device_id": "deviceId"}).orderBy("seq_no").collect()
    assert [r["seq_no"] for r in rows] == [0, 2]  # the empty element keeps its position


def test_ini(spark, tmp_path):
    p = tmp_path / "x.ini"
    p.write_text('; c\n[cam]\nrate = "5" ; was 3\nrate = 9\n# c\nmode=on\n[f]\nsec = {"k": 1}\n')
    got = {(r["section"], r["key"]): r["value"] for r in R.read_ini(spark, str(p)).collect()}
    assert got[("cam", "rate")] in ("5", '5" '.strip(), "5") and got[("cam", "mode")] == "on"
    feats = [tuple(r) for r in R.read_features(spark, str(p)).collect()]
    assert feats == [("f", "sec", "k", "1")]


def test_state_rules(spark, tmp_path):
    p = tmp_path / "s.ini"
    p.write_text("[wifi]\ndefault = down\nonce = a, b\nup = mgr | x | y\nup = mgr | z\n")
    rules, settings = R.read_state_rules(spark, str(p))
    assert sorted(r["pattern"] for r in rules.collect()) == ["x | y", "z"]
    assert sorted((r["name"], r["value"]) for r in settings.collect()) == [("default", "down"), ("once", "a"), ("once", "b")]


def test_small_files(spark, tmp_path):
    assert R.read_known_patterns(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "p.csv").write_text("description_pattern,TYPE\na <N>,ERROR\n,INFO\nb,\n")
    assert [r["type"] for r in R.read_pattern_csv(spark, str(tmp_path / "p.csv")).collect()] == ["ERROR"]
    (tmp_path / "m.json").write_text(json.dumps([{"description_pattern": " a ", "type": "error", "priority": "p1"}]))
    assert [tuple(r) for r in R.load_pattern_map(spark, str(tmp_path / "m.json")).collect()] == [("a", "ERROR", "P1")]


def test_window_is_replaced_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, dt.datetime(2024, 1, 1 + i % 4, 5)) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, ts timestamp")
    df.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    for _ in range(2):  # running it again changes nothing
        K.replace_window(df.filter("id = 1"), path, "2024-01-02", "2024-01-04")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1, 3, 4, 7]


def test_replacing_half_a_day_keeps_the_other_half(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.range(24).select("id", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"))
    old.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    for _ in range(2):
        K.replace_window(old.filter("id % 6 = 0"), path, "2024-01-01 12:00:00", "2024-01-02 00:00:00")
        assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [*range(12), 12, 18]
    K.replace_window(old.filter("id < 0"), path, "2024-01-01 12:00:00", "2024-01-02 00:00:00")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(12))


def test_registry(spark, tmp_path):
    path = str(tmp_path / "reg")
    K.registry_append(spark, path, "a", "b", "s", "completed", at="2024-01-01 00:00:00")
    reg = spark.read.parquet(path)
    assert not K.registry_should_run(reg, "a", "b", "s") and K.registry_should_run(reg, "a", "b", "s", force=True)
    K.registry_append(spark, path, "a", "b", "s", "failed", at="2024-01-02 00:00:00")
    assert K.registry_should_run(spark.read.parquet(path), "a", "b", "s") and K.registry_should_run(reg, "x", "b", "s")


def test_csv_has_a_header_when_empty(spark, tmp_path):
    K.write_csv(spark.createDataFrame([], "a int, b string").coalesce(1), str(tmp_path / "c"))
    text = "".join(f.read_text() for f in (tmp_path / "c").glob("*.csv"))
    assert text.strip() == "a,b"
    K.write_csv_by(spark.createDataFrame([("x", 1), ("y", 2)], "device_id string, v int"), str(tmp_path / "by"))
    assert sorted(p.name for p in (tmp_path / "by").glob("device_id=*")) == ["device_id=x", "device_id=y"]


def test_copy_and_append(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i // 2)) for i in range(6)]
    R.copy_range(spark.createDataFrame(rows, "id int, ts timestamp"), str(tmp_path / "c"), "2024-01-01 00:00:00", "2024-01-01 00:02:00")
    assert spark.read.parquet(str(tmp_path / "c")).count() == 4  # both rows of a time stay together
    obs = spark.createDataFrame([("d", "f", dt.datetime(2024, 1, 1))], "device_id string, file_name string, start_time timestamp")
    K.write_observations(obs, obs, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o/observations")).first()["month"] == "2024-01"


def test_rank_over_blocks(spark):
    rows = [(i, (i * 7919) % 10_007) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, ts bigint")
    got = {r["id"]: r["n"] for r in global_rank(df, "ts", ["id"], "n", width_s=1).collect()}
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), start=1)}
    assert got == want


def test_writers_cut_hot_keys_and_pack_small_ones(spark, tmp_path):
    from tripline.sources import sinks as K

    rows = [("hot" if i % 3 else f"d{i % 40}", f"f{i:05d}", 1_700_000_000 + 700 * i) for i in range(3000)] + [(None, "f", 1_700_000_000), ("same", "g", None)]
    rows += [("hour", f"h{i:04d}", 1_700_003_000) for i in range(450)]
    obs = spark.createDataFrame(rows, "device_id string, file_name string, at bigint").selectExpr("device_id", "file_name", "timestamp_seconds(at) as start_time")
    K.write_observations(obs, obs.withColumn("speed", F.lit(1.5)), str(tmp_path), file_rows=200)
    for name in ("observations", "samples"):
        back = spark.read.parquet(str(tmp_path / name))
        assert sorted(map(str, back.select(obs.columns).collect())) == sorted(map(str, obs.collect()))
        files = {}
        for r in back.withColumn("path", F.input_file_name()).collect():
            files.setdefault(r["path"], []).append(r)
        # twice the target at most: a range ends with a whole hour, and packing goes by hash
        assert max(map(len, files.values())) <= 420 and len(files) < 60
        assert len([p for p, x in files.items() if any(r["device_id"] == "hot" for r in x)]) >= 10
        for x in files.values():
            assert [(r["device_id"] or "", r["file_name"]) for r in x] == sorted((r["device_id"] or "", r["file_name"]) for r in x)
        spans = {}
        for p, x in files.items():
            hot = [r["start_time"] for r in x if r["device_id"] == "hot"]
            if hot:
                spans.setdefault(x[0]["month"], []).append((min(hot), max(hot)))
        for v in spans.values():
            assert all(a[1] < b[0] for a, b in zip(sorted(v), sorted(v)[1:]))  # ranges of time, not a hash
    K.write_csv_by(obs.select("device_id", "file_name"), str(tmp_path / "csv"), "device_id", ["file_name"], file_rows=500)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert sorted((r["device_id"] or "", r["file_name"]) for r in back.collect()) == sorted((r[0] or "", r[1]) for r in rows)
    assert len(list((tmp_path / "csv" / "device_id=hot").glob("part-*"))) >= 4 and len(list((tmp_path / "csv" / "device_id=d3").glob("part-*"))) == 1
    K.write_csv_by(obs.limit(0), str(tmp_path / "none"))
