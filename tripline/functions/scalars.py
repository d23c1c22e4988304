"""Projections, coercions, dates and numbers (PRJ-*, FN-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ── nested values ────────────────────────────────────────────────────────────

def _in_range(col: Column | str, lo: float, hi: float) -> Column:
    numbers = F.transform(_c(col), lambda x: x.try_cast("double"))
    return F.filter(numbers, lambda x: x.between(lo, hi))


def array_low(col: Column | str, lo: float = 0, hi: float = 300) -> Column:
    """PRJ-04: smallest plausible number of an array."""
    return F.array_min(_in_range(col, lo, hi))


def array_high(col: Column | str, lo: float = 0, hi: float = 300) -> Column:
    """PRJ-04: largest plausible number of an array."""
    return F.array_max(_in_range(col, lo, hi))


def keys_except(col: Column | str, excluded: Sequence[str]) -> Column:
    """PRJ-05: names of a JSON object's members minus a list, sorted."""
    return F.array_sort(F.array_except(F.json_object_keys(_c(col)), F.array(*[F.lit(x) for x in excluded])))


def has_key(col: Column | str, name: str) -> Column:
    """PRJ-06: whether a JSON object has the member, even when it is null."""
    return F.coalesce(F.array_contains(F.json_object_keys(_c(col)), name), F.lit(False))


def any_contains(col: Column | str, text: str) -> Column:
    """PRJ-07: whether an array element contains the text, ignoring case."""
    return F.coalesce(F.exists(_c(col), lambda x: F.contains(F.lower(x), F.lit(text.lower()))), F.lit(False))


def project_array(col: Column | str, fields: Sequence[str]) -> Column:
    """PRJ-08: array of structs cut to some fields."""
    return F.transform(_c(col), lambda x: F.struct(*[x[f].alias(f) for f in fields]))


def join_field(col: Column | str, field: str) -> Column:
    """PRJ-09: one field of every element, comma separated, NULLs skipped."""
    values = F.transform(_c(col), lambda x: x[field].cast("string"))
    return F.array_join(F.filter(values, lambda v: v.isNotNull()), ",")


def driver_id(col: Column | str) -> Column:
    """PRJ-10: the first element's text after its last ``': '``."""
    return F.element_at(F.split(F.get(_c(col), F.lit(0)), ": "), -1)


def json_text(col: Column | str, is_text: bool = False) -> Column:
    """PRJ-11: compact JSON of a nested value; text passes through, NULL stays."""
    return _c(col).cast("string") if is_text else F.to_json(_c(col))


# ── coercions ────────────────────────────────────────────────────────────────

def to_int(col: Column | str, bits: int = 64, signed: bool = True) -> Column:
    """PRJ-12: truncated number, NULL when it is none or outside the integer type's range.

    Text of whole numbers keeps all its digits; the unsigned 64-bit range needs a decimal.
    """
    lo, hi = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    target = "decimal(20,0)" if hi > (1 << 63) - 1 else "bigint"
    exact = _c(col).cast("string").try_cast("decimal(38,9)")
    loose = _c(col).cast("string").try_cast("double").try_cast("decimal(38,9)")
    value = F.coalesce(exact, loose)
    cut = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("decimal(38,0)")
    lo_c, hi_c = F.lit(str(lo)).cast("decimal(38,0)"), F.lit(str(hi)).cast("decimal(38,0)")
    return F.when(cut.between(lo_c, hi_c), cut.cast(target))


def to_float(col: Column | str, bits: int = 64) -> Column:
    """PRJ-13: number, NULL when it is none, not finite or beyond the type's range."""
    value = _c(col).cast("string").try_cast("double")
    largest = 3.4028234663852886e38 if bits == 32 else 1.7976931348623157e308
    return F.when(~F.isnan(value) & (F.abs(value) <= largest), value)


def flag(col: Column | str) -> Column:
    """PRJ-14: boolean as 0 / 1."""
    return _c(col).cast("boolean").cast("int")


def list_or_empty(col: Column | str) -> Column:
    """PRJ-14: array, empty instead of NULL."""
    return F.coalesce(_c(col), F.array().cast("array<string>"))


def integral(col: Column | str, name: str) -> Column:
    """PRJ-15: value as a whole number; a fraction stops the job."""
    value = _c(col)
    whole = value.isNull() | (value.cast("double") == F.floor(value.cast("double")))
    return F.when(whole, value.cast("bigint")).otherwise(
        F.raise_error(F.concat(F.lit(f"{name} has a fractional value: "), value.cast("string"))).cast("bigint"))


def ts19(col: Column | str) -> Column:
    """PRJ-16: date time text of 19 characters with a blank between date and time."""
    return F.substring(F.replace(_c(col).cast("string"), F.lit("T"), F.lit(" ")), 1, 19)


def severity(col: Column | str) -> Column:
    """PRJ-17: ``error`` for ERROR, ``info`` for everything else."""
    return F.when(F.upper(F.trim(_c(col))) == "ERROR", "error").otherwise("info")


def clean_label(col: Column | str, default: str = "UNKNOWN", upper: bool = True) -> Column:
    """PRJ-18: trimmed label; NULL and its spellings become ``default``."""
    text = F.trim(_c(col))
    text = F.upper(text) if upper else text
    return F.when(text.isNull() | F.upper(text).isin("", "NAN", "NONE", "NULL"), default).otherwise(text)


# ── time ─────────────────────────────────────────────────────────────────────

# Fixed value: the last epoch (ms) taken for a time, 2100-01-01
LAST_EPOCH_MS = 4_102_444_800_000


def epoch_to_timestamp(col: Column | str) -> Column:
    """FN-01: whole-second UTC timestamp of a plausible epoch in ms."""
    ms = _c(col)
    return F.when(ms.between(0, LAST_EPOCH_MS), F.timestamp_millis(ms - ms % 1000))


def epoch_text(col: Column | str) -> Column:
    """FN-02: display text of an epoch in ms; '' for 0 or NULL."""
    ms = _c(col)
    return F.coalesce(F.when(ms != 0, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")), F.lit(""))


def seconds_of(col: Column | str) -> Column:
    """FN-03: timestamp of an epoch in ms, cut to seconds."""
    return F.timestamp_seconds(F.floor(_c(col) / 1000))


def ten_digits(col: Column | str) -> Column:
    """FN-03: the first ten digits of an epoch."""
    return F.substring(_c(col).cast("string"), 1, 10).try_cast("bigint")


def text_to_ms(col: Column | str) -> Column:
    """FN-03: epoch ms of a date time text, 0 when it is none."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(_c(col), F.lit("yyyy-MM-dd HH:mm:ss"))), F.lit(0).cast("bigint"))


def uptime_text(col: Column | str) -> Column:
    """FN-03: ms as HH:MM:SS."""
    s = F.floor(_c(col) / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def days_between(start: Column | str, end: Column | str) -> Column:
    """FN-04: every day of an inclusive range."""
    return F.sequence(F.to_date(_c(start)), F.to_date(_c(end)))


def week_buckets(start: Column | str, end: Column | str) -> Column:
    """FN-05: ISO year-week numbers (yyyyww) of an inclusive range."""
    weeks = F.transform(days_between(start, end), lambda d: F.extract(F.lit("YEAROFWEEK"), d) * 100 + F.weekofyear(d))
    return F.array_distinct(weeks)


def zone_parts(now: Column, zone: str) -> Column:
    """FN-06: date, time and weekday of an instant in a fixed zone."""
    local = F.from_utc_timestamp(now, zone)
    return F.struct(F.lit(zone).alias("timezone"), F.date_format(local, "yyyy-MM-dd").alias("current_date"),
                    F.date_format(local, "HH:mm:ss").alias("current_time"),
                    F.date_format(local, "EEEE").alias("weekday"))


def day_windows(start: Column | str, end: Column | str) -> Column:
    """FN-07: per day the part of a range on it, each ending at 23:59:59 or the range end; empty parts dropped."""
    a, b = _c(start).cast("timestamp"), _c(end).cast("timestamp")
    one = F.expr("INTERVAL 1 DAY - INTERVAL 1 SECOND")
    parts = F.transform(F.sequence(F.to_date(a), F.to_date(b)), lambda d: F.struct(
        F.greatest(d.cast("timestamp"), a).alias("start"), F.least(d.cast("timestamp") + one, b).alias("end")))
    return F.filter(parts, lambda p: p["start"] < p["end"])


def inclusive_end(text: str) -> tuple[str, str]:
    """FLT-02: inclusive end as (text, interval to add): a date means its whole day, an instant one ms more."""
    text = text.strip()
    return (text, "INTERVAL 1 DAY") if len(text) == 10 else (text, "INTERVAL 0.001 SECOND")


def range_label(start: Column | str, end: Column | str, sep: str = "_to_") -> Column:
    """FN-15: label of a half-open range: its first and last covered day, one day alone when equal."""
    a = F.date_format(_c(start), "yyyy-MM-dd")
    b = F.date_format(_c(end).cast("timestamp") - F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd")
    return F.when(a == b, a).otherwise(F.concat(a, F.lit(sep), b))


# ── numbers ──────────────────────────────────────────────────────────────────

def change_pct(a: Column | str, b: Column | str) -> Column:
    """FN-08: change from a to b in %; 0 to 0 is 0, 0 to anything else infinite, NULL without numbers."""
    x, y = _c(a).try_cast("double"), _c(b).try_cast("double")
    return (F.when(x.isNull() | y.isNull(), None).when((x == 0) & (y == 0), 0.0)
            .when(x == 0, float("inf")).otherwise((y - x) * 100.0 / F.abs(x)))


def ratio(a: Column | str, b: Column | str) -> Column:
    """FN-09: a / b, NULL for a zero base."""
    return _c(a) / F.nullif(_c(b), F.lit(0))


def percentage(a: Column | str, b: Column | str) -> Column:
    """FN-09: 100 a / b, NULL for a zero base."""
    return F.lit(100.0) * _c(a) / F.nullif(_c(b), F.lit(0))


def deviation(value: Column | str, lo: Column | str, hi: Column | str, expect: Column | str) -> Column:
    """FN-10: how far a value lies outside its expected range, relative to the bound it misses."""
    v, low, high, want = _c(value), _c(lo), _c(hi), _c(expect)

    def base(x: Column) -> Column:
        return F.coalesce(F.nullif(F.abs(x), F.lit(0.0)), F.lit(1.0))

    return (F.when(v.isNull(), 0.0).when(want.isNotNull(), F.abs(v - want) / base(want))
            .when(v > high, (v - high) / base(high)).when(v < low, (low - v) / base(low)).otherwise(0.0))


def dot(a: Column | str, b: Column | str) -> Column:
    """FN-11: dot product of two arrays, summed in double precision."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """FN-11: cosine of two arrays, NULL for a zero vector."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """FN-12: weighted mean over rows with a value and a positive weight."""
    v, w = _c(value), _c(weight)
    use = v.isNotNull() & (w > 0)
    return F.sum(F.when(use, v * w)) / F.sum(F.when(use, w))


def single_or(col: Column | str, label: str) -> Column:
    """FN-13: the only distinct non-empty value, '' without any, ``label`` for several."""
    v = F.when(F.trim(_c(col)).isin("", "None"), None).otherwise(_c(col))
    return F.when(F.min(v).isNull(), "").when(F.min(v) == F.max(v), F.min(v)).otherwise(label)


def json_get(col: Column | str, *path: str, default: str | None = None) -> Column:
    """FN-14: nested JSON member as text with a default."""
    return F.coalesce(F.get_json_object(_c(col), "$." + ".".join(path)), F.lit(default))
