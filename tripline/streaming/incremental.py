"""Incremental loads (STR-01, STR-02)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tripline.session import configure


def new_files(spark: SparkSession, src: str, schema, fmt: str = "parquet") -> DataFrame:
    """Stream of the files a folder gains."""
    return spark.readStream.format(fmt).schema(schema).load(src)


def stream_classify(spark: SparkSession, src: str, dst: str, checkpoint: str, schema,
                    classify: Callable[[DataFrame], DataFrame], ts: str = "ts") -> None:
    """STR-01: classify the event files that arrived since the last run, then stop.

    Every micro-batch owns one folder of the target (``batch=<id>``) and overwrites it, so a
    batch that is run again after a failure leaves its rows once.  The stream's checkpoint
    remembers the files already taken.
    """
    configure(spark)

    def write(batch: DataFrame, number: int) -> None:
        out = classify(batch).withColumn("day", F.to_date(ts))
        out.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("day").parquet(f"{dst}/batch={number}")

    query = (new_files(spark, src, schema).writeStream.foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def late_days(index: DataFrame, now, final_after_hours: int = 24) -> DataFrame:
    """STR-02: device days to read (again): uploads after the last read, or a day not yet final.

    ``index``: device, day, uploaded_at, read_at (NULL: never read).
    """
    per = index.groupBy("device", "day").agg(F.max("uploaded_at").alias("uploaded_at"), F.max("read_at").alias("read_at"))
    day_end = F.col("day").cast("timestamp") + F.expr("INTERVAL 1 DAY")
    final = day_end + F.expr(f"INTERVAL {final_after_hours} HOURS")
    due = F.col("read_at").isNull() | (F.col("uploaded_at") > F.col("read_at")) | (F.col("read_at") < final)
    return per.filter(due & (day_end <= now)).select("device", "day")


def dedup_stream(stream: DataFrame, keys: list[str], ts: str, delay: str = "24 hours") -> DataFrame:
    """STR-02: rows of overlapping uploads once, as long as copies arrive within ``delay``."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _utc_ms(t) -> int:
    return int(pd.Timestamp(t).tz_localize("UTC").timestamp() * 1000) if pd.Timestamp(t).tzinfo is None else int(pd.Timestamp(t).timestamp() * 1000)


class DayFinality(StatefulProcessor):
    """State of one device day: uploads seen and the last one's time.  A timer at the day's finality asks for the last reading and clears it."""

    def __init__(self, final_after_hours: int):
        self.wait_ms = (24 + final_after_hours) * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "uploads bigint, last_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        device, day = key
        n, last = 0, None
        for part in rows:
            n += len(part)
            newest = max(_utc_ms(t) for t in part["uploaded_at"])
            last = newest if last is None else max(last, newest)
        before = self.seen.get() if self.seen.exists() else (0, last)
        final = _utc_ms(day) + self.wait_ms
        if final > timerValues.getCurrentWatermarkInMs():
            if not self.seen.exists():
                self.handle.registerTimer(final)
            self.seen.update((int(before[0]) + n, max(int(before[1]), last)))
        yield self._event(device, day, "upload", last, int(before[0]) + n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        uploads = int(self.seen.get()[0]) if self.seen.exists() else 0
        self.seen.clear()
        yield self._event(*key, "final", expiredTimerInfo.getExpiryTimeInMs(), uploads)

    @staticmethod
    def _event(device, day, reason: str, at_ms: int, uploads: int) -> pd.DataFrame:
        at = dt.datetime.fromtimestamp(at_ms / 1000, dt.UTC).replace(tzinfo=None)
        return pd.DataFrame({"device": [device], "day": [day], "reason": [reason], "at": [at], "uploads": [uploads]})

    def close(self) -> None:
        pass


def reading_events(uploads: DataFrame, final_after_hours: int = 24, delay: str = "0 seconds") -> DataFrame:
    """STR-02: stream of device days to read: (device, day, reason, at, uploads).

    ``uploads`` streams (device, day, uploaded_at).  A batch's uploads of a day ask for one reading (``upload``, at the last of them); when the watermark of the
    upload times passes the day's end by ``final_after_hours``, the day is asked for a last time (``final``) and forgotten.  An upload after that asks again,
    without being kept.  State is one small row per day that is not final; null devices and days are left out.
    """
    rows = uploads.filter("device is not null and day is not null and uploaded_at is not null").select("device", "day", F.col("uploaded_at").cast("timestamp").alias("uploaded_at"))
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kind = uploads.schema["device"].dataType.simpleString()
    return (rows.withWatermark("uploaded_at", delay).groupBy("device", "day")
            .transformWithStateInPandas(DayFinality(final_after_hours), f"device {kind}, day date, reason string, at timestamp, uploads bigint", "Append", "EventTime"))


def run_readings(spark: SparkSession, src: str, dst: str, checkpoint: str, final_after_hours: int = 24) -> None:
    """STR-02: take the upload files that arrived since the last run and append the readings they ask for; then stop.

    State, timers and the files taken live in ``checkpoint``, so a later run goes on where this one ended.
    """
    configure(spark)
    events = reading_events(new_files(spark, src, "device string, day date, uploaded_at timestamp"), final_after_hours)
    query = events.writeStream.format("parquet").option("path", dst).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
