"""Work that must not grow with folders, files or scans: tasks of writes, tries of pairs, reads of lines."""

import datetime as dt

from pyspark.sql import functions as F

from tripline.plans import boots as B
from tripline.plans import issues as I
from tripline.sources import sinks as K


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_worse_pairs_are_scored_for_the_rest_only(spark, monkeypatch):
    """F1: once a band of scores is matched, only sections and issues left over meet again."""
    calls, scored = [], I.score_pairs

    def spy(sections, issues, by, threshold, tile):
        calls.append((threshold, sections.count(), issues.count()))
        return scored(sections, issues, by, threshold, tile)

    monkeypatch.setattr(I, "score_pairs", spy)
    words = "camera modem audio".split()
    sections = spark.createDataFrame([("v", i, f"## {w} broken") for i, w in enumerate(words)] + [("v", 9, "## camera brown")], "version string, section_no int, text string")
    issues = spark.createDataFrame([("v", i, f"K-{i}", f"{w} broken", "") for i, w in enumerate(words)] + [("v", 9, "K-9", "camera crown", "")],
                                   "version string, issue_no int, issue_key string, summary string, description string")
    got = {x["section_no"]: x["issue_key"] for x in I.assign_issues(sections, issues).collect()}
    assert got == {0: "K-0", 1: "K-1", 2: "K-2", 9: "K-9"}
    assert calls[0] == (1.0, 4, 4) and all(c[1:] == (1, 1) for c in calls[1:])


def test_tasks_of_a_write_do_not_grow_with_folders(spark, tmp_path):
    """many folders share the tasks; a large folder still has all its files."""
    rows = spark.range(300).select(F.when(F.col("id") < 60, "hot").otherwise((F.col("id") % 80).cast("string")).alias("device_id"), "id")
    out = K.planned(rows, ["device_id"], None, ["id"], None, 10)
    assert out.rdd.getNumPartitions() < 40
    K.write_csv_by(rows, str(tmp_path / "csv"), "device_id", ["id"], 10)
    assert len(list((tmp_path / "csv" / "device_id=hot").glob("*.csv"))) >= 6
    assert all(len(list(p.glob("*.csv"))) == 1 for p in (tmp_path / "csv").glob("device_id=[0-9]*"))
    back = spark.read.option("header", True).schema("id long, device_id string").csv(str(tmp_path / "csv")).select("device_id", "id")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_one_document_a_file_takes_few_tasks(spark, tmp_path):
    """documents are written to files of their own by few tasks."""
    import checks
    import checks.recordings  # noqa: F401

    rows = [(i, f"s{i}", float(i)) for i in range(150)] + [(None, "none", 1.0)]
    spark.createDataFrame([*rows, (7, "s7", 7.0)], "s_suppkey long, s_name string, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    out = checks.QUERIES["src_observations"](spark, str(tmp_path))
    files = out.inputFiles()
    assert len(files) == 151 and len({f.rsplit("/", 1)[1][:10] for f in files}) <= spark.sparkContext.defaultParallelism
    assert sorted(x["videoName"] for x in out.collect()) == sorted(n for i, n, _ in rows if i is not None and i % 5)


def _events(spark, path):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, t + dt.timedelta(seconds=i), ("signup", "error", "view")[i % 3], float(i), f'{{"k": {i % 50}}}') for i in range(60)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")


def test_lines_are_dealt_to_tasks_before_they_are_matched(spark, tmp_path):
    """F7, F8, F10, F11, F12: a table of one row group must not make the extraction one task."""
    from checks.devicelogs import registry_lines

    _events(spark, tmp_path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = registry_lines(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert "FileScan" not in plan(lines) and lines.rdd.getNumPartitions() == 4 and lines.count() == 60


def test_process_starts_parse_their_lines_once(spark, tmp_path):
    """chained scans read settled rows, not the lines again."""
    rows = [("d", "s", "f", i, f"{1_700_000_000_000 + i}: {up}: TAG: I: {pid}: 1: m{i}") for i, (up, pid) in enumerate([(5, 1), (9, 1), (3, 1), (4, 2), (None, 2)])]
    spark.createDataFrame(rows, "device string, service string, file string, line_no long, line string").write.parquet(str(tmp_path / "lines"))
    out = B.process_starts(spark.read.parquet(str(tmp_path / "lines")), "TAG")
    assert "FileScan" not in plan(out)
    assert sorted((x["start_no"], x["pid"], x["uptime"], x["messages"]) for x in out.collect()) == [(1, 1, 5, 2), (2, 1, 3, 1), (3, 2, 4, 1)]


def test_python_workers_get_batches_of_bounded_size(spark):
    """what a worker holds at a time does not grow with the partition, nor with the length of texts and vectors."""
    from tripline.session import configure

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    configure(spark)
    rows = spark.range(0, 9_000, 1, 1).select(F.repeat(F.lit("x"), 2_000).alias("t"))

    @F.pandas_udf("long")
    def size(texts):
        return texts * 0 + len(texts) if texts.dtype != object else texts.str.len() * 0 + len(texts)

    assert rows.select(F.max(size("t"))).first()[0] <= 2_000


def test_issue_grams_are_numbers_made_once_a_text(spark):
    """grams of a text are distinct numbers, not one string a character; every phrase still finds all its texts."""
    from tripline.plans import events as E

    texts = ["Camera modem fault", "camera\0modem", "", None, "a", "ab", "x😀y camera m", "a b a b", "modem b", "\n", "Ünder der Über", "camera modem fault"]
    issues = spark.createDataFrame([(i, i % 5, t) for i, t in enumerate(texts)], "issue_id long, created int, text string")
    asked = ["camera modem", "a", "b", "ab", "modem", "der über", "y camera", "not there", "modem b 7", "A"]
    rows = spark.createDataFrame([("ERROR", p) for p in asked] + [("INFO", "fault"), ("ERROR", None)], "type string, description string")
    plain = [(i, i % 5, t.lower()) for i, t in enumerate(texts) if t is not None]
    want = set()
    for p in {"modem b" if p == "modem b 7" else p.lower() for p in asked}:
        newest = sorted(((c, i) for i, c, t in plain if p in t), reverse=True)[:3]
        want |= {(p, i, r + 1) for r, (_, i) in enumerate(newest)}
    out = E.related_issues(rows, issues, 3)
    assert {(x["phrase"], x["issue_id"], x["rank"]) for x in out.collect()} == want
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for x in E.gram_codes(issues, "issue_id", "text", True).collect():
        got.setdefault(x["issue_id"], []).append(x["gram"])
    number = lambda g: sum(ord(c) << s for c, s in zip(g, (42, 21, 0)))
    for i, t in enumerate(texts):
        grams = {number(t[k : k + n]) for n in (1, 2, 3) for k in range(len(t) - n + 1)} if t else set()
        assert set(got.get(i, [])) - {0} == grams - {0} and len(got.get(i, [])) == len(set(got.get(i, [])))
