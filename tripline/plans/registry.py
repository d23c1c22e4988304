"""Fixed values of the metric registry: log patterns, metrics and expected ranges.

Texts here are formats of device logs; they are data, not logic.
"""

from __future__ import annotations

from tripline.plans.patterns import Pattern

_UPL = r"UPL: I: \d+: (\d+): "


def _p(key, services, literals, regex, groups=(), critical=False) -> Pattern:
    def many(x):
        return (x,) if isinstance(x, str) else tuple(x)

    return Pattern(key, many(services), many(literals), regex, many(groups) if groups else (), critical)


# Key, services, literal text, pattern, names of its groups, kept in critical logs
LINES = (
    _p("syslog_uptime", "syslogs", "uptime ", r"SYSLOG_MON: I: \d+: \d+: uptime (\d+\.\d+) s < 60 s", "s"),
    _p("ndc_system_uptime", "ndcentral", "System Uptime: ", r"NDC: I: \d+: \d+: System Uptime: (\d+) seconds", "s"),
    _p("pwr_uptime", "power_mon", "check_uptime max_uptime", r"check_uptime max_uptime \d+ uptime_secs ([1-5]?\d)$", "s"),
    _p("reboot_entering", "reboot", "@Reboot Entering", r"@Reboot Entering"),
    _p("ndc_service_uptime", "ndcentral", "serviceUpTime: ", r"NDC: I: \d+: \d+: serviceUpTime: (\d+)$", "s"),
    _p("gps_enum", "gps", "GPS Port Enumerate Time", r"GPSD: I: \d+: \d+: GPS Port Enumerate Time: (\d+) sec$", "s"),
    _p("sm_gps_enum", "service_mon", "GPS Port Enumerate Time",
       r"ND_GPS : \d+ : \d+ : -?\d+ : GPS Port Enumerate Time: \d+ seconds : (\d+)", "ms", True),
    _p("svc_start", "svc", "Starting SVC", r"######Starting SVC######"),
    _p("analytics_start", "analytics", "Starting Analytics Service", r"######## Starting Analytics Service"),
    _p("zmq_socket", "cam_rec", "SUCCESS IN CREATE zmq_socket", r"CAM_REC: I: \d+: \d+: SUCCESS IN CREATE zmq_socket"),
    _p("first_frame", "ndcentral", "first frame for cam num 0", r"first frame for cam num 0 registered@ (\d{13})", "epoch"),
    _p("lte_session", "conn_mgr", "LTE Data Session started successfully",
       r"CONN_MGR_SESSION: I: \d+: \d+: LTE Data Session started successfully"),
    _p("ka_reached", "power_mon", "reached_cloud 1", r"response_string :.*: reached_cloud 1"),
    _p("gps_ttff", "gps", "GPS First Fix time", r"GPS First Fix time: (\d+) sec", "s"),
    _p("prev_shutdown", "power_mon", "previous_shutdown_reason", r"POWER_MONITOR_ctx->previous_shutdown_reason (\S+)", "reason"),
    _p("wakeup_reason", ("power_mon", "apm"), "WAKEUP_REASON:",
       r"DEV\w*: I: \d+: \d+: WAKEUP_REASON:\s*(.+?)\s*--\s*RESET_REASON:\s*(\S+)", ("wakeup", "reset")),
    _p("pass_high", "power_mon", "Uptime Check Pass HIGH", r"CYCLIC_REBOOT: Uptime Check Pass HIGH", (), True),
    _p("uptime_long", "power_mon", "check_uptime max_uptime",
       r"check_uptime max_uptime (\d+) uptime_secs ([1-9]\d{5,})$", ("max", "s")),
    _p("soak_done", "power_mon", "CYCLIC_REBOOT: Soak done", r"CYCLIC_REBOOT: Soak done (\d+)s, rebooting", "soak", True),
    _p("shutdown_reason", "power_mon", "shutdown reason ::@ time",
       r"shutdown reason ::@ time (\d{13})\s+(Shuttingdown|restarting) because of ([A-Z_]+)", ("start", "mode", "reason"), True),
    _p("shutdown_initiated", "power_mon", "Device Shutdown Initiated", r"Device Shutdown Initiated \(defer_req_cnt="),
    _p("shutdown_exec", "power_mon", "system_execute cmd: ",
       r"SYS_U: I: \d+: \d+: system_execute cmd: (shutdown now|poweroff|reboot)\b", "cmd"),
    _p("pm_start", "power_mon", "STARTING POWER MONITOR", r"#####STARTING POWER MONITOR#####", (), True),
    _p("ota_size", ("otacheck", "updater"), "OTA package size in bytes", r"OTA package size in bytes = (\d+)", "bytes"),
    _p("ota_target_check", "otacheck", "version_check_version: ", r"version_check_version: (\S+) current_version:", "version"),
    _p("ota_target_upgrade", "updater", "Upgrade Version =", r"Upgrade Version =(\S+) and state", "version"),
    _p("sm_update_time", "service_mon", "updateTime: ",
       r"updateEngine : \d{13} : 210003 : -?\d+ : (\S+) \| updateTime: ([\d.]+)", ("version", "s"), True),
    _p("updater_update_time", "updater", "OTA updateTime: ", r"OTA updateTime: ([\d.]+) sec", "s"),
    _p("aon_sm", "service_mon", "AON Ver: ", r": 41015 : -?\d+ : AON Ver: (0x[0-9A-Fa-f]+)", "ver", True),
    _p("aon_apm", "apm", "get_aon_application_version returns", r"get_aon_application_version returns : (0x[0-9A-Fa-f]+)", "ver"),
    _p("obd_fw", "obd", "adapter fw ver : ", r"adapter fw ver : (\S+)", "ver"),
    _p("band_mask", "conn_mgr", "LTE band pref from device is", r"LTE band pref from device is ([0-9a-fA-F]+)", "mask"),
    _p("band_ext", "conn_mgr", "LTE band pref ext from device",
       r"LTE band pref ext from device bits_(1_64|65_128) is ([0-9a-fA-F]+)", ("range", "mask")),
    _p("updater_start", "updater", "Starting OTA update", r"Starting OTA update\s*::"),
    _p("updater_stop", "updater", "-c stop -n ", r"Command from file\s+\d+ = sudo /usr/bin/nd_service\.sh -c stop -n \w+"),
    _p("sm_cyclic", "service_mon", "Reboot - Cyclic", r": 40016 : -?\d+ : Reboot - Cyclic", (), True),
    _p("iot_reboot", "awsiot", "Received command: reboot-phone", r"Received command: reboot-phone"),
    _p("cam_crash", "ndcentral", "is crashed", r"NDC: E: \d+: \d+: cam_num (\d+) is crashed", "cam", True),
    _p("record_start", "ndcentral", "RECORD_START for cam num",
       r"RECORD_START for cam num (\d+) with session_cnt \d+ received @ epoch_time_ms: (\d{13})", ("cam", "epoch")),
    _p("sm_prev_shutdown", "service_mon", "Previous Shutdown:", r": 40105 : -?\d+ : Previous Shutdown:\s*(\S+) \(Speed", "reason", True),
    _p("conn_session_lost", "conn_mgr", "SessionStateCallback:DISCONNECTED", r"SessionStateCallback:DISCONNECTED"),
    _p("conn_exit", "conn_mgr", "Device disconnected : Exiting App", r"Device disconnected : Exiting App"),
    _p("data_connected", "conn_mgr", "Data session connected", r"Success : Data session connected"),
    _p("pushed_file", "circ_buff", "Pushed file ",
       r"Pushed file (\d+)_(trip\S+?_y)(\.mp4\.ld\.mp4|\.mp4|\.zip) with size (\d+) to file_size_check_queue",
       ("cam", "name", "ext", "size")),
    _p("frame_count", ("ndcentral", "cam_rec", "cam_streamer"), "Frame count rec",
       r"CAM(\d+): I: \d+: \d+: Frame count rec(?:ei|ie)ved: (\d+)", ("cam", "frames")),
    _p("storage_info", "deviceHealthClient", '"storage_info"',
       r'Received message: \{"storage_info": (?=(?:.*"no_of_hq": \{([^}]*)\})?)(?=(?:.*"no_of_lq": \{([^}]*)\})?)'
       r'(?=(?:.*"no_of_obs": "([^"]*)")?)', ("hq", "lq", "obs")),
    _p("obs_ld_size", "inference", "obsZipDestFile size", r"obsZipDestFile size: b'\S+/observations/\S+?\.zip' -- (\d+)", "size"),
    _p("disk_free", "svc", "Free space", r"DISK: I: \d+: \d+: Free space (?:at / )?: (\d+)$", "bytes"),
    _p("disk_used", "diagnostic", "used memory of /dev/mmcblk0 is", r"used memory of /dev/mmcblk0 is ([\d.]+)$", "used"),
    _p("waf", "diagnostic", ("Waf is ", "waf is "), r"\b[Ww]af is ([\d.]+)", "waf"),
    _p("bt_ignition_on", "btfv", "IGNITION ON received", r"BTMAN: I: \d+: \d+: (?:\[GEN\] )?IGNITION ON received"),
    _p("driver_adv_start", "btfv", "Starting Driver Login Advertisement", r"Starting Driver Login Advertisement"),
    _p("driver_scan_start", "btfv", "RegisterDriverLoginLegacyFilter", r"Inside: RegisterDriverLoginLegacyFilter"),
    _p("driver_scan_stop", "btfv", "DriverLogin legacy scan complete cb triggered",
       r"DriverLogin legacy scan complete cb triggered"),
    _p("commn_set", "inference", "commn_set", r"commn_set .*? event_codes \[([^\]]*)\]", "codes"),
    _p("delete_state", "inference", "to DELETE_STATE", r"Moving \S*/\d_(trip\S+?_y)\.STATE to DELETE_STATE", "key"),
    _p("upload_state", "inference", "to UPLOAD_STATE", r"Moving \S*/\d_(trip\S+?_y)\.STATE to UPLOAD_STATE\s+alerts found", "key"),
    _p("lla_msg_send", ("outwardAnalyticsClient", "inwardAnalyticsClient", "dmsAnalyticsClient", "inertialAnalyticsClient"),
       "msg_send: ",
       r'lla_handler\s+- msg_send: (?=.*"videoName": "\d_(trip[^"]+?_y)(?:\.mp4)?")(?=.*"uuid": "([0-9a-f]{32})")'
       r'(?=(?:.*"end_timestamp": (\d{13}))?)(?=(?:.*"event_code": "([\d.]+)")?)', ("key", "uuid", "end", "code")),
    _p("ialerts_found", "inference_inertial", "ialerts.json found at",
       r"ialerts\.json found at \S*/\d_(trip\S+?_y)/ialerts\.json, size=(\d+) bytes", ("key", "size")),
    _p("eventdata_summary", "unifieduploader", "Summary file size",
       _UPL + r"Summary file size: \d+ name:\s*\S*/\d_(trip\S+?_y)_summary\.json\.7z", ("tid", "key")),
    _p("eventdata_call", "unifieduploader", "upload/eventdata", _UPL + r"Calling service: \S+/upload/eventdata\b", "tid"),
    _p("eventdata_ok", "unifieduploader", "Upload successful for ", r"Upload successful for \d_(trip\S+?_y)\.mp4$", "key"),
    _p("eventdata_fail", "unifieduploader", "Upload failed for ", r"Upload failed for \d_(trip\S+?_y)\.mp4$", "key"),
    _p("vod_req", "unifieduploader", "VOD req received",
       r"VOD req received\. Id: \d+, vod_id: (\S+) , video: \S*/(\d)_(trip\S+?_y)\.mp4", ("vod", "cam", "key")),
    _p("video_ok", "unifieduploader", "Upload successful for video: ",
       r"Upload successful for video: \S*/(\d)_(trip\S+?_y)\.mp4", ("cam", "key")),
    _p("obs_req", "unifieduploader", "Upload Observations Request Received",
       _UPL + r"Upload Observations Request Received (\d{16})", ("tid", "rt")),
    _p("obs_zip_start", "unifieduploader", "Creating observations zip file at once",
       _UPL + r"Creating observations zip file at once!", "tid"),
    _p("obs_zip_done", "unifieduploader", "Obs zip file created", _UPL + r"Obs zip file created!", "tid"),
    _p("obs_call", "unifieduploader", "upload/observations", _UPL + r"Calling service: \S+/upload/observations\b", "tid"),
    _p("obs_uploaded", "unifieduploader", "File uploaded. Deleting", _UPL + r"File uploaded\. Deleting \d+", "tid"),
    _p("obs_fail", "unifieduploader", "Failed to fetch url",
       _UPL + r"ERROR: Failed to fetch url \(\S+/upload/observations\)", "tid"),
    _p("retry_details", "unifieduploader", "Details: type - msg type", r"\w+ Details: type - msg type: (\d+) msg level", "type"),
    _p("vod_attempt_failed", "unifieduploader", "VOD upload attempt failed", r"VOD upload attempt failed: (vod-[^\s,]+)", "vod", True),
    _p("vod_exhausted", "unifieduploader", "Exhausted all upload retries", r"Exhausted all upload retries for (vod-\S+)", "vod", True),
    _p("vod_deleted", "unifieduploader", "deleted VOD upload req", r"deleted VOD upload req \S+ - (vod-\S+) from DB", "vod"),
    _p("videolist_failed", "circ_buff", "collect_notify_videolist is FAILED", r"collect_notify_videolist is FAILED"),
    _p("videolist_ok", "circ_buff", "collect_notify_videolist is succeded", r"collect_notify_videolist is succeded"),
    _p("health_post_failed", "health", "curl exited", r"curl_with_health: curl exited (\d+)", "code"),
    _p("health_ok", "health", "Upload of Health Stats successful", r"Upload of Health Stats successful"),
    _p("ndc_lla_message", "ndcentral", "lla_message :{", r"NDC: C: \d+: \d+: lla_message :\{", (), True),
    _p("lla_hs_add", "unifieduploader", '"uploadadd"', r'"lla_([0-9a-f]{32})_(\d+)": \{"uploadadd": (\d{13})\}', ("uuid", "n", "add")),
    _p("lla_hs_result", "unifieduploader", '"uploadstart"',
       r'"lla_([0-9a-f]{32})_(\d+)": \{"uploadstart": (\d{13}), "uploadend": (\d{13}), "status": "(pass|fail)"',
       ("uuid", "n", "start", "end", "status")),
    _p("hc_config", "health_central", "Config (re)loaded: enabled=",
       r"HCTR: I: \d+: \d+: Config \(re\)loaded: enabled=(\d+) .*?upload_max_pending_interval_secs=(\d+) \(([^)]*)\)",
       ("enabled", "interval", "source")),
    _p("hc_interval", "health_central", ("upload interval ", "Upload interval "),
       r"HCTR: I: \d+: \d+: .*?[Uu]pload interval (?:\d+s -> )?(\d+)s \(server payloadFrequencyMinutes", "interval"),
    _p("hc_attempt", "health_central", "attempt_upload: starting",
       r"HCTR: I: (\d+: \d+): attempt_upload: starting, udid=(\d+) payloadId=(\d+) attempt=(\d+)",
       ("thr", "udid", "payload", "n")),
    _p("hc_call", "health_central", "Uploading component health to",
       r"UPLDCLIENT: I: (\d+: \d+): Uploading component health to \S+/upload/component-health", "thr"),
    _p("hc_ok", "health_central", "Upload succeeded for",
       r"HCTR: I: (\d+: \d+): Upload succeeded for (\d+) session\(s\) \(udid=(\d+) payloadId=(\d+)",
       ("thr", "sessions", "udid", "payload")),
    _p("hc_response", "health_central", "Upload response (HTTP",
       r'UPLDCLIENT: I: (\d+: \d+): Upload response \(HTTP (\d+)\): .*?"missingPayloads":\[(.?)', ("thr", "http", "missing")),
)
# Services whose silences are "last sign of life" points, camera lines, lines of detailed logs
ALIVE_SERVICES = ("ndcentral", "power_mon", "svc", "conn_mgr")
CAM_LINES = ("record_start", "pushed_file", "frame_count", "cam_crash", "vod_req", "video_ok")
DETAILED = ("alive", "ndc_service_uptime", "syslog_uptime", "pwr_uptime", "record_start")
POWER_KEYS = ("syslog_uptime", "ndc_system_uptime", "pwr_uptime")
CAMS = tuple(range(9))
OPTIONAL_CAMS = (4, 5, 6, 7, 8)

# Metric, unit, aggregation.  Ids ending in * have one metric per camera.
_METRICS = (
    ("kpi-alerts", "alerts_detected", "count", "sum"),
    ("kpi-alerts", "alerts_uploaded", "count", "sum"),
    ("kpi-alerts", "alerts_not_uploaded", "count", "sum"),
    ("kpi-alerts", "alerts_unique", "count", "sum"),
    ("kpi-alerts", "alerts_ed_calls", "count", "sum"),
    ("kpi-alerts", "alerts_cards", "count", "sum"),
    ("kpi-alerts", "alerts_video_cam*", "count", "sum"),
    ("kpi-alert-upload", "au_rec_start", "s", "mean"),
    ("kpi-alert-upload", "au_inertial", "s", "mean"),
    ("kpi-alert-upload", "au_vision", "s", "mean"),
    ("kpi-alert-upload", "au_api_trigger", "s", "mean"),
    ("kpi-alert-upload", "au_api_ok", "s", "mean"),
    ("kpi-alert-upload", "au_vod_req_cam*", "s", "mean"),
    ("kpi-alert-upload", "au_video_ok_cam*", "s", "mean"),
    ("kpi-alert-upload", "au_total", "s", "mean"),
    ("kpi-boot", "boot_power_on", "s", "mean"),
    ("kpi-boot", "boot_reboot_log", "s", "mean"),
    ("kpi-boot", "system_uptime", "s", "mean"),
    ("kpi-boot", "service_uptime", "s", "mean"),
    ("kpi-boot", "modem_enum", "s", "mean"),
    ("kpi-boot", "svc_start", "s", "mean"),
    ("kpi-boot", "analytics_start", "s", "mean"),
    ("kpi-boot", "zmq_socket", "s", "mean"),
    ("kpi-boot", "first_frame", "s", "mean"),
    ("kpi-boot", "data_connectivity", "s", "mean"),
    ("kpi-boot", "keep_alive_reboot", "s", "mean"),
    ("kpi-boot", "gps_ttff_lpw", "s", "mean"),
    ("kpi-boot", "gps_ttff_cyclic", "s", "mean"),
    ("kpi-boot", "cyclic_reboot_uptime", "h", "mean"),
    ("kpi-boot", "cyclic_crank_high", "s", "mean"),
    ("kpi-boot", "shutdown_time", "s", "mean"),
    ("kpi-ota", "ota_size", "MB", "last"),
    ("kpi-ota", "ota_update_time", "s", "last"),
    ("kpi-ota", "aon_version", "text", "last"),
    ("kpi-ota", "isp_version", "text", "last"),
    ("kpi-ota", "obd_version", "text", "last"),
    ("kpi-ota", "bands", "text", "last"),
    ("kpi-downtime", "down_ota", "s", "mean"),
    ("kpi-downtime", "down_cyclic", "s", "mean"),
    ("kpi-downtime", "down_iot", "s", "mean"),
    ("kpi-downtime", "down_cam_crash", "s", "mean"),
    ("kpi-downtime", "down_abrupt", "s", "mean"),
    ("kpi-downtime", "down_abrupt_supercap", "s", "mean"),
    ("kpi-downtime", "down_abrupt_reboot", "s", "mean"),
    ("kpi-downtime", "down_lte_ota", "s", "mean"),
    ("kpi-downtime", "down_lte_disconnect", "s", "mean"),
    ("kpi-crash", "crash_cam*", "count", "sum"),
    ("kpi-crash", "crash_cam*_pct", "%", "pct"),
    ("kpi-video-hd", "hd_size_cam*", "MB", "mean"),
    ("kpi-video-hd", "hd_fps_cam*", "fps", "mean"),
    ("kpi-video-ld", "ld_size_cam0", "MB", "mean"),
    ("kpi-video-ld", "ld_size_cam1", "MB", "mean"),
    ("kpi-video-ld", "ld_size_cam2", "MB", "mean"),
    ("kpi-video-ld", "ld_size_cam3", "MB", "mean"),
    ("kpi-video-ld", "ld_size_cam4", "MB", "mean"),
    ("kpi-video-ld", "ld_size_cam5", "MB", "mean"),
    ("kpi-video-ld", "ld_size_cam6", "MB", "mean"),
    ("kpi-video-ld", "ld_size_cam7", "MB", "mean"),
    ("kpi-video-ld", "ld_size_cam8", "MB", "mean"),
    ("kpi-video-ld", "ld_fps_cam0", "fps", "mean"),
    ("kpi-video-ld", "ld_fps_cam1", "fps", "mean"),
    ("kpi-preview", "pv_ld_cam0", "MB", "last"),
    ("kpi-preview", "pv_ld_cam1", "MB", "last"),
    ("kpi-preview", "pv_hd_cam0", "MB", "last"),
    ("kpi-preview", "pv_hd_cam1", "MB", "last"),
    ("kpi-obs", "obs_alloc", "MB", "last"),
    ("kpi-obs", "obs_hd_max", "count", "last"),
    ("kpi-obs", "obs_hd_avg", "KB", "mean"),
    ("kpi-obs", "obs_ld_max", "count", "last"),
    ("kpi-obs", "obs_ld_avg", "KB", "mean"),
    ("kpi-obs", "obs_gps_size", "KB", "mean"),
    ("kpi-emmc", "emmc_cam0", "count", "last"),
    ("kpi-emmc", "emmc_cam1", "count", "last"),
    ("kpi-emmc", "emmc_cam2", "count", "last"),
    ("kpi-emmc", "emmc_cam3", "count", "last"),
    ("kpi-emmc", "emmc_ext", "count", "last"),
    ("kpi-emmc", "emmc_obs", "count", "last"),
    ("kpi-emmc", "emmc_hours", "h", "last"),
    ("kpi-root", "root_size", "GB", "last"),
    ("kpi-waf", "waf_ext", "WAF", "last"),
    ("kpi-waf", "waf_int", "WAF", "last"),
    ("kpi-watchdog", "wdt_resets", "count", "sum"),
    ("kpi-watchdog", "wdt_pm_start", "s", "mean"),
    ("kpi-watchdog", "wdt_reboot_time", "s", "mean"),
    ("kpi-driver-app", "dl_ign", "s", "mean"),
    ("kpi-driver-app", "dl_adv", "s", "mean"),
    ("kpi-driver-app", "dl_scan_start", "s", "mean"),
    ("kpi-driver-app", "dl_scan_stop", "s", "mean"),
    ("kpi-obs-upload", "ou_received", "s", "mean"),
    ("kpi-obs-upload", "ou_files_added", "s", "mean"),
    ("kpi-obs-upload", "ou_zip", "s", "mean"),
    ("kpi-obs-upload", "ou_upload_start", "s", "mean"),
    ("kpi-obs-upload", "ou_upload_ok", "s", "mean"),
    ("kpi-retry", "rt_eventdata_n", "count", "sum"),
    ("kpi-retry", "rt_eventdata_s", "s", "mean"),
    ("kpi-retry", "rt_video_n", "count", "sum"),
    ("kpi-retry", "rt_video_s", "s", "mean"),
    ("kpi-retry", "rt_obs_n", "count", "sum"),
    ("kpi-retry", "rt_obs_s", "s", "mean"),
    ("kpi-retry", "rt_videolist_n", "count", "sum"),
    ("kpi-retry", "rt_videolist_s", "s", "mean"),
    ("kpi-retry", "rt_status_n", "count", "sum"),
    ("kpi-retry", "rt_status_s", "s", "mean"),
    ("kpi-lla", "lla_rec_start", "s", "mean"),
    ("kpi-lla", "lla_ndc_create", "s", "mean"),
    ("kpi-lla", "lla_ndc_notify", "s", "mean"),
    ("kpi-lla", "lla_api_trigger", "s", "mean"),
    ("kpi-lla", "lla_api_ok", "s", "mean"),
    ("kpi-lla", "lla_total", "s", "mean"),
    ("kpi-lla", "lla_retry_n", "count", "sum"),
    ("kpi-lla", "lla_retry_s", "s", "mean"),
    ("kpi-health-central", "hc_attempted", "count", "sum"),
    ("kpi-health-central", "hc_success", "count", "sum"),
    ("kpi-health-central", "hc_failed", "count", "sum"),
    ("kpi-health-central", "hc_upload_s", "s", "mean"),
    ("kpi-health-central", "hc_missing", "count", "sum"),
)


def metrics() -> list[tuple[str, str, str, str]]:
    """(table, metric, unit, aggregation) of the whole registry; a metric with * is one per camera."""
    return [(table, name.replace("*", str(cam)), unit, agg) for table, name, unit, agg in _METRICS for cam in (CAMS if "*" in name else ("",))]


# Table of the metrics of a boot's start-up; count metrics that are 0 only in boots with this line
START_UP = "kpi-boot"
ZERO_ONLY_WITH = {"kpi-health-central": "hc_config"}
# Count metrics whose lines are all in critical logs
CRITICAL_COUNTS = ("rt_video_n", *[f"crash_cam{c}" for c in CAMS])

# Expected ranges (metric, lowest, highest)
RANGES = (
    ("boot_power_on", None, 30), ("svc_start", None, 30), ("wdt_pm_start", None, 30), ("system_uptime", None, 32),
    ("service_uptime", None, 30), ("first_frame", None, 62), ("modem_enum", None, 120), ("zmq_socket", None, 38.5),
    ("keep_alive_reboot", None, 160), ("gps_ttff_lpw", None, 180), ("cyclic_reboot_uptime", 16, 48.5),
    ("cyclic_crank_high", None, 1830), ("shutdown_time", None, 6), ("down_cyclic", None, 112), ("down_iot", None, 112),
    ("down_cam_crash", None, 42), ("wdt_resets", None, 0), ("wdt_reboot_time", None, 125), ("obs_hd_max", None, 10_000),
    ("emmc_obs", None, 10_000), ("obs_hd_avg", None, 9_000), ("obs_gps_size", None, 9_000), ("waf_int", None, 3.0),
    ("waf_ext", None, 3.0), ("ou_received", None, 2), ("rt_videolist_s", None, 300), ("lla_api_trigger", None, 1),
    ("lla_api_ok", None, 40.4), ("lla_retry_s", None, 30), ("hc_missing", None, 0),
)
# Per camera HD bit rate, LD bit rate and frames per second; tolerated shares of them
CAMERA_SPEC = {
    0: (6_000_000, 1_000_000, 30), 1: (2_000_000, 500_000, 15), 2: (500_000, None, 15), 3: (500_000, None, 15),
    4: (5_000_000, 1_000_000, 15), 5: (5_000_000, 1_000_000, 15), 6: (5_000_000, 1_000_000, 15),
    7: (5_000_000, 1_000_000, 15), 8: (8_000_000, 1_000_000, 30),
}
SIZE_SHARE, FPS_SHARE = (0.75, 1.10), (0.90, 1.10)


def baselines() -> list[tuple[str, float | None, float | None, float | None, float | None, float | None]]:
    """(metric, lo, hi, expect, low share, high share): a minute of video has rate * 60 / 8 bytes."""
    rows = [(m, None if lo is None else float(lo), None if hi is None else float(hi), None, None, None) for m, lo, hi in RANGES]
    for cam, (hd, ld, fps) in CAMERA_SPEC.items():
        rows += [(f"crash_cam{cam}", None, 0.0, None, None, None), (f"crash_cam{cam}_pct", None, 0.0, None, None, None),
                 (f"hd_size_cam{cam}", None, None, hd * 60 / 8 / 1e6, *SIZE_SHARE),
                 (f"hd_fps_cam{cam}", None, None, float(fps), *FPS_SHARE)]
        if ld:
            rows.append((f"ld_size_cam{cam}", None, None, ld * 60 / 8 / 1e6, *SIZE_SHARE))
    for cam in (0, 1):
        hd, ld, fps = CAMERA_SPEC[cam]
        rows += [(f"ld_fps_cam{cam}", None, None, float(fps), *FPS_SHARE),
                 (f"pv_ld_cam{cam}", None, None, ld * 60 / 8 / 1e6, *SIZE_SHARE),
                 (f"pv_hd_cam{cam}", None, None, hd * 60 / 8 / 1e6, *SIZE_SHARE)]
    return rows
