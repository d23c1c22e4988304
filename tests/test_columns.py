"""Column builders on hand-made values."""

from pyspark.sql import functions as F

from tripline.functions import scalars as S
from tripline.functions import text as X


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("o")).first()["o"]


def test_masks(spark):
    assert one(spark, X.normalize_description("v"), "\t camera 3 lost at x9y end \r\n") == "camera <N> lost at <N> end"
    assert one(spark, X.normalize_description("v"), None) == ""
    assert one(spark, X.mask_tokens("v"), " a1 ") == " <N> "
    assert one(spark, X.mask_tokens("v", True), "٣") == "<N>"
    assert one(spark, X.normalize_prefix("v"), "battery low 12.5 volts: x") == "BATTERY LOW%"
    assert one(spark, X.search_phrase("v"), "disk (sda) isn't full at 90% now") == "disk sda isn't full at"


def test_lines(spark):
    assert one(spark, X.line_ts("v"), "1793148914428: 2061: TAG: I: 1: 2: x") == 1793148914428
    assert one(spark, X.line_ts("v"), "2026-10-28 00:55:02,578 - reboot - INFO - x") == 1793148902578
    assert one(spark, X.line_ts("v"), "no time") is None
    f = X.native_fields("v")
    assert one(spark, F.struct(*[c.alias(n) for n, c in f.items()]), "1793148914428: 2061: TAG: E: 1: 2: a: b").asDict() == {
        "ts": 1793148914428, "uptime": 2061, "tag": "TAG", "level": "E", "pid": 1, "tid": 2, "message": "a: b"}


def test_versions(spark):
    vs = ["4.6.9", "4.6.16.rc.5", "4.6.16", "10.1.1", "4.6.x", "63.1.1.sp.4.6.15"]
    df = spark.createDataFrame([(v,) for v in vs], "v string")
    assert [r["v"] for r in df.orderBy(X.version_key("v")).collect()] == ["4.6.9", "4.6.16", "4.6.16.rc.5", "4.6.x", "10.1.1", "63.1.1.sp.4.6.15"]
    words = [r["v"] for r in df.orderBy(X.version_key("v", "words")).collect()]
    assert words.index("4.6.9") < words.index("4.6.16") < words.index("4.6.x")
    assert one(spark, X.family_scan("v"), "63.1.1.sp.4.6.15.rc.3") == "family4"
    assert one(spark, X.family_sp("v"), "63.1.1.sp.4.6.15.rc.3") == "family4"
    assert one(spark, X.family_scan("v"), "9.9") == "other"


def test_same_value(spark):
    pairs = [("1", "true", True), ("On", "yes", True), ("1.0", "1", True), ("0.0", "off", True), ("2", "2.0", True), ("2", "3", False), ("A", "a", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", X.same_value("a", "b")).collect())


def test_integers(spark):
    assert one(spark, S.to_int("v", 8), "-128.9") == -128
    assert one(spark, S.to_int("v", 8), "128") is None
    assert one(spark, S.to_int("v", 64), "9223372036854775807") == 9223372036854775807
    assert one(spark, S.to_int("v", 64), "9223372036854775808") is None
    assert int(one(spark, S.to_int("v", 64, False), "18446744073709551615")) == 18446744073709551615
    assert one(spark, S.to_int("v"), "nan") is None and one(spark, S.to_int("v"), "x") is None
    assert one(spark, S.to_float("v"), "inf") is None and one(spark, S.to_float("v", 32), "1e39") is None


def test_numbers(spark):
    rows = [(0.0, 0.0, 0.0), (0.0, 3.0, float("inf")), (-4.0, -2.0, 50.0), (None, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, want double")
    assert [r["c"] for r in df.select(S.change_pct("a", "b").alias("c")).collect()] == [r[2] for r in rows]
    assert one(spark, S.ratio("v", F.lit(0.0)), 3.0, "double") is None
    assert one(spark, S.epoch_text("v"), 0, "bigint") == "" and one(spark, S.epoch_to_timestamp("v"), -1, "bigint") is None


def test_priorities(spark):
    df = spark.createDataFrame([(p,) for p in ("P100", "high", "P2", "P10", None)], "p string")
    assert [r["p"] for r in df.orderBy(X.priority_key("p")).collect()][:3] == ["P2", "P10", "P100"]


def test_fraction_stops_the_load(spark):
    import pytest

    with pytest.raises(Exception, match="fractional"):
        spark.createDataFrame([(1.5,)], "v double").select(S.integral("v", "code")).collect()


def test_project_observation(spark):
    """Every column of a document by the paths of the reference, and the defaults of an empty one."""
    import datetime
    import json

    from tripline.plans.observations import project_observation
    from tripline.sources.readers import OBSERVATION_SCHEMA

    doc = {
        "deviceId": "d1", "app_ver": "4.6", "udid": "u", "videoName": "0_1793148914428_x.mp4", "prevVideoName": "p.mp4", "nextVideoName": "n.mp4", "startTime": 1793148914428,
        "endTime": 1793148974428, "startTimeLd": 1, "inwardStartTime": 2, "inwardStartTimeLd": 3, "systemUpTime": 77, "serviceUpTime": 66, "Voltage in Volts": 12.5,
        "deviceModes": {"ignition_status": 1, "privacymode": 0, "disMode": "a", "processing_mode": 2, "idle": 0}, "NRT_STATUS": "ok", "tripNo": 9,
        "networkInfo": {"rssi": -70, "sinr": 3.5, "rat": "LTE", "recordedTime": 5}, "videoMetaData": [{"speed": 10}, {"speed": 500}], "sensorMetaData": [{}, {}, {}],
        "driverInvariantSession": "s", "driverId": ["id: 42"], "vehClass": "c", "vehicleId": "v", "cameras": 3, "vin": "V", "can_firmware_ver": "f", "offset": 4, "can_src": "x",
        "can_sn": "y", "engine_status": "on", "session_embedding": {"a": 1}, "burst_mode": {"b": 2}, "fuel_report": {"c": 3}, "irled_status": "1",
        "irled_states": [{"time": 1, "status": "on"}, {"status": "off"}], "audioEnable": True, "user_generated_alert": [1], "rtcValid": True, "rtc_jump_from": 1, "rtc_jump_to": 2,
        "sessionCount": 5, "validGPSEntries": 6, "gpsStartTime": 7, "gpsEndTime": 8, "obdFormat": "o",
        "inference_data": {
            "observations_data": {"module": ["Inertial", "inward_vision"], "canMetaData": [1], "protocol_info": "p", "idling_report": {"i": 1}, "numFrames": 100, "multiLane": None,
                                  "roadBoundaryTracks": 1, "carBoxTrackerListCompressed": 1},
            "alerts_data": {"num_alerts": 1, "alerts": [{"uuid": "A", "x": 1}]},
            "audio_events": {"num_alerts": 2, "alerts": [{"uuid": "B", "event_code": "e", "reason": "r"}]},
            "events_data": {"num_alerts": 3, "alerts": [{"uuid": "C", "description": "d"}]},
            "inward": {"frames_processed_info": {"num_frames_processed": 50}, "face": 1, "ipc_events": 1}, "dms": {"frames_processed_info": {"num_frames_processed": 40}, "gaze": 1},
            "video_data": {"transcode_recommendation": "t"}, "is_inward_processed_on_device": True, "is_dms_processed_on_device": False, "faceImageCaptured": True, "is_inward_cam_obstructed": False,
        }}
    want = {
        "device_id": "d1", "file_name": "0_1793148914428_x", "ota": "4.6", "ignition_status": 1, "uptime": 77, "product_line": None, "trigger_hash": None, "s3_path": "p1", "udid": "u",
        "file_timestamp": 1793148914428, "service_uptime": 66, "privacymode": 0, "dismode": "a", "voltage": 12.5, "processing_mode": 2, "inertial_processed": True,
        "vision_processed": True, "inward_vision_processed": True, "nrt_status": "ok", "tripno": "9", "sample_count": 2, "videometadatastatus": 2, "min_speed": 10.0, "max_speed": 10.0,
        "speed_data": None, "sensormetadata_count": 3, "driverinvariantsession": "s", "driverid": "42", "vehclass": "c", "vehicleid": "v", "cameras": 3, "prevvideoname": "p.mp4",
        "current_videoname": "0_1793148914428_x.mp4", "nextvideoname": "n.mp4", "devicemodes_itemscount": 5, "inference_data_itemscount": 11, "canmetadata": "[1]",
        "alerts_data_num_alerts": 1, "alerts_data": '[{"uuid":"A"}]', "audio_events_num_alerts": 2,
        "audio_events_data": '[{"uuid":"B","event_code":"e","playback_reason":"r","playback_success":null}]', "events_data_num_alerts": 3,
        "events_data": '[{"uuid":"C","event_code":null,"description":"d","event_initialization_time":null}]', "num_alerts": 3, "metadatastatus": "full", "starttime": "1793148914428",
        "starttimeld": "1", "inwardstarttime": "2", "inwardstarttimeld": "3", "rssi": -70, "sinr": 3.5, "nw_source": "LTE", "nw_recorded_time": "5", "vin": "V", "can_firmware_ver": "f",
        "offset": "4", "session_embedding": '{"a":1}', "burst_mode": '{"b":2}', "fuel_report": '{"c":3}', "can_src": "x", "can_sn": "y", "engine_status": "on", "protocol_info": "p",
        "idling_report": '{"i":1}', "tc_recommendation": "t", "num_frames_out": 100, "num_frames_in": 50, "num_frames_dms": 40, "inward_models_processed": ["face", "ipc_events"],
        "outward_models_processed": ["canMetaData", "carBoxTrackerListCompressed", "idling_report", "multiLane", "protocol_info", "roadBoundaryTracks"],
        "dms_models_processed": ["gaze"], "is_inward_processed": True, "is_dms_processed": False, "irled_status": "1", "irled_states_timestamp": "1", "irled_states_status": "on,off",
        "faceImageCaptured": True, "obs_filetype": "Observation", "audioEnable": "true", "user_generated_alert": "[1]", "rtc_valid": "true", "rtc_jump_from": "1", "rtc_jump_to": "2",
        "session_count": 5, "valid_gps_entries": 6, "gps_start_time": "7", "gps_end_time": "8", "idle": 0, "obdformat": "o", "is_inward_cam_obstructed": False, "has_multi_lane": True,
        "has_road_boundary_tracks": True, "has_ipc_events": True, "is_hd_file": True,
        "inference_keys": ["audio_events", "dms", "events_data", "faceImageCaptured", "inward", "is_dms_processed_on_device", "is_inward_cam_obstructed", "is_inward_processed_on_device",
                           "observations_data", "video_data"], "has_alerts": True,
    }
    docs = spark.createDataFrame([(json.dumps(doc), "p1"), ('{"deviceId":"d2"}', "p2"), ("{}", "p3")], "j string, path string").select(F.from_json("j", OBSERVATION_SCHEMA).alias("j"), "path")
    got = {r["device_id"]: r.asDict() for r in project_observation(docs.select("j.*", "path")).collect()}
    assert set(got) == {"d1", "d2"}
    first = got["d1"]
    assert isinstance(first.pop("start_time"), datetime.datetime) and isinstance(first.pop("end_time"), datetime.datetime)
    assert first == want
    empty = {k: v for k, v in got["d2"].items() if v is not None}
    assert empty == {"device_id": "d2", "s3_path": "p2", "inertial_processed": False, "vision_processed": False, "inward_vision_processed": False, "sample_count": 0, "videometadatastatus": 0,
                     "sensormetadata_count": 0, "devicemodes_itemscount": 0, "inference_data_itemscount": 0, "canmetadata": "[]", "alerts_data": "[]", "audio_events_data": "[]", "events_data": "[]",
                     "metadatastatus": "full", "session_embedding": "{}", "burst_mode": "{}", "fuel_report": "{}", "idling_report": "{}", "inward_models_processed": [], "outward_models_processed": [],
                     "dms_models_processed": [], "irled_states_timestamp": "", "irled_states_status": "", "obs_filetype": "Metadata", "user_generated_alert": "[]", "has_multi_lane": False,
                     "has_road_boundary_tracks": False, "has_ipc_events": False, "is_hd_file": False, "has_alerts": False}
    assert project_observation(docs.select("j.*", "path"), narrow=True).columns == list(got["d1"])[:3] + ["start_time", "end_time", "ignition_status", "uptime"]
