"""Text expressions: masks, line parsing, versions, names (TXT-01 .. TXT-08, TXT-17 .. TXT-24)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token mask and the characters a template is trimmed of
MASK = "<N>"
MASKED_TOKEN = r"\S*[0-9]\S*"
TRIMMED = "\t\n\f\r "


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_description(col: Column | str, strip: str = "chars") -> Column:
    """TXT-01 / TXT-03: tokens with a digit become ``<N>``, outer white space goes, NULL is ''."""
    masked = F.regexp_replace(F.coalesce(_c(col), F.lit("")), MASKED_TOKEN, MASK)
    if strip == "regex":
        return F.regexp_replace(F.regexp_replace(masked, r"^\s+", ""), r"\s+$", "")
    return F.btrim(masked, F.lit(TRIMMED))


def mask_tokens(col: Column | str, unicode_digits: bool = False) -> Column:
    """TXT-02: the same mask without trimming; NULL stays."""
    digit = r"\S*\p{Nd}\S*" if unicode_digits else MASKED_TOKEN
    return F.regexp_replace(_c(col), digit, MASK)


def normalize_prefix(col: Column | str) -> Column:
    """TXT-04: upper case up to the first character outside A-Z and blank, the rest is one ``%``."""
    up = F.upper(F.trim(F.coalesce(_c(col), F.lit(""))))
    numbers = F.regexp_replace(up, r"\b[0-9]+(?:\.[0-9]+)?\b", "%")
    cut = F.regexp_replace(numbers, r" *[^A-Z ].*$", "%")
    return F.regexp_replace(cut, r"%+", "%")


def search_phrase(col: Column | str) -> Column:
    """TXT-06: the words before the first word with a digit, punctuation but ``.`` and ``'`` blanked."""
    head = F.regexp_replace(F.trim(F.coalesce(_c(col), F.lit(""))), r"(?s)(^|\s)\S*[0-9].*$", "")
    plain = F.regexp_replace(head, r"[^\p{L}\p{N}_\s.']", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def line_ts(col: Column | str) -> Column:
    """TXT-07: epoch ms of a log line: 13-digit prefix, or a UTC date time with ``,`` / ``.`` millis."""
    text = _c(col)
    epoch = F.regexp_extract(text, r"^([0-9]{13}):", 1)
    stamp = F.regexp_extract(text, r"^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})[,.][0-9]{3}", 1)
    millis = F.regexp_extract(text, r"^[0-9-]{10} [0-9:]{8}[,.]([0-9]{3})", 1)
    dated = F.unix_millis(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss"))) + millis.try_cast("bigint")
    return F.coalesce(epoch.try_cast("bigint"), dated)


# Fixed value: the device line format
NATIVE_LINE = r"^([0-9]{13}):\s*([0-9]+):\s*([^:]+): ([A-Z]): ([0-9]+): ([0-9]+): (.*)$"


def native_fields(col: Column | str) -> dict[str, Column]:
    """TXT-08: fields of ``<epoch_ms>: <uptime_ms>: TAG: L: pid: tid: message``; NULL where it does not match."""
    text = _c(col)
    names = {"ts": "bigint", "uptime": "bigint", "tag": "string", "level": "string", "pid": "bigint",
             "tid": "bigint", "message": "string"}
    ok = text.rlike(NATIVE_LINE)
    return {n: F.when(ok, F.regexp_extract(text, NATIVE_LINE, i).cast(t))
            for i, (n, t) in enumerate(names.items(), start=1)}


def front_matter_description(col: Column | str, limit: int = 150) -> Column:
    """TXT-12: the ``description:`` of a document's leading ``---`` block, cut to ``limit`` characters."""
    block = F.regexp_extract(_c(col), r"(?s)^---\s*\n(.*?)\n---", 1)
    line = F.regexp_extract(block, r"(?m)^description:[ \t]*(.*)$", 1)
    return F.nullif(F.substring(F.regexp_replace(F.trim(line), "^[\"']|[\"']$", ""), 1, limit), F.lit(""))


# The coordinates a recording name carries without a position fix
NO_FIX = ("91.0000", "181.0000")


def media_name_fields(col: Column | str) -> dict[str, Column]:
    """TXT-17: parts of ``<cam>_trip.._part.._<lat>_<long>_<speed>_<epoch>_y``."""
    name = _c(col)
    tail = r"_(-?[0-9]+\.[0-9]+)_(-?[0-9]+\.[0-9]+)_[0-9.]+_([0-9]{13})_y"
    lat, lon = F.regexp_extract(name, tail, 1), F.regexp_extract(name, tail, 2)
    return {
        "first_epoch": F.regexp_extract(name, r"([0-9]{13})", 1).try_cast("bigint"),
        "field7": F.get(F.split(name, "_"), F.lit(6)).try_cast("bigint"),
        "lat": lat.try_cast("double"),
        "lon": lon.try_cast("double"),
        "rec_epoch": F.regexp_extract(name, r"_([0-9]{13})_y", 1).try_cast("bigint"),
        "no_fix": (lat == NO_FIX[0]) & (lon == NO_FIX[1]),
    }


# Firmware major numbers that name a product family; labels are the caller's
FAMILY_MAJORS = (2, 3, 4, 5, 7)


def _labels(labels: Mapping[int, str] | None) -> Column:
    table = labels or {m: f"family{m}" for m in FAMILY_MAJORS}
    return F.create_map(*[F.lit(x) for k, v in table.items() for x in (str(k), v)])


def family_scan(col: Column | str, labels: Mapping[int, str] | None = None, other: str | None = "other") -> Column:
    """TXT-18: family of the first ``N.N.N`` group with a known major."""
    table = _labels(labels)
    majors = F.transform(F.regexp_extract_all(_c(col), F.lit(r"([0-9]+)\.[0-9]+\.[0-9]+"), F.lit(1)), lambda x: x)
    known = F.filter(F.transform(majors, lambda m: F.try_element_at(table, m)), lambda f: f.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), F.lit(other))


def family_sp(col: Column | str, labels: Mapping[int, str] | None = None) -> Column:
    """TXT-18: family of the ``.sp.N`` major, else of the leading number, else NULL."""
    sp = F.regexp_extract(_c(col), r"\.sp\.([0-9]+)", 1)
    lead = F.regexp_extract(_c(col), r"^([0-9]+)\.", 1)
    return F.try_element_at(_labels(labels), F.coalesce(F.nullif(sp, F.lit("")), lead))


def family_prefix(col: Column | str, labels: Mapping[int, str] | None = None, other: str | None = None) -> Column:
    """TXT-18: family of the leading number."""
    return F.coalesce(F.try_element_at(_labels(labels), F.regexp_extract(_c(col), r"^([0-9]+)\.", 1)), F.lit(other))


def version_key(col: Column | str, variant: str = "runs") -> Column:
    """TXT-19: natural order of versions as an array to sort by.

    ``runs``: digit runs as numbers, other runs as text, text before number.
    ``words``: punctuation dropped, letters lower-cased, number before text.
    """
    if variant == "runs":
        parts = F.regexp_extract_all(_c(col), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
        number_kind, text_kind, fold = 1, 0, (lambda x: x)
    else:
        parts = F.regexp_extract_all(_c(col), F.lit(r"([0-9]+|[A-Za-z]+)"), F.lit(1))
        number_kind, text_kind, fold = 0, 1, F.lower
    return F.transform(parts, lambda x: F.struct(
        F.when(x.rlike("^[0-9]+$"), F.lit(number_kind)).otherwise(F.lit(text_kind)).alias("kind"),
        F.when(x.rlike("^[0-9]+$"), x.try_cast("decimal(38,0)")).alias("num"),
        F.when(~x.rlike("^[0-9]+$"), fold(x)).alias("text")))


# Texts that mean true and false in a configuration
TRUE_WORDS = ("true", "1", "on", "enable", "enabled", "yes")
FALSE_WORDS = ("false", "0", "off", "disable", "disabled", "no")


def canonical_value(col: Column | str) -> Column:
    """Configuration value with booleans and numbers in one spelling (TXT-22)."""
    text = F.lower(F.btrim(F.trim(_c(col)), F.lit('"')))
    number = text.try_cast("double")
    whole = F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(number.cast("string"))
    return (F.when(text.isin(*TRUE_WORDS), "true").when(text.isin(*FALSE_WORDS), "false")
            .when(number.isNull(), text)
            .when(whole.isin(*TRUE_WORDS), "true").when(whole.isin(*FALSE_WORDS), "false").otherwise(whole))


def same_value(a: Column | str, b: Column | str) -> Column:
    """TXT-22: equality of two configuration values."""
    return canonical_value(a) == canonical_value(b)


def slug(col: Column | str) -> Column:
    """TXT-23: text with every other character run as ``_``."""
    text = F.regexp_replace(F.trim(F.coalesce(_c(col), F.lit(""))), r"[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.btrim(text, F.lit("_")), F.lit("")), F.lit("report"))


def safe_name(col: Column | str, fallback: str = "part") -> Column:
    """TXT-23: text usable as a file name: reserved characters become ``_``, at most 64 characters."""
    text = F.trim(F.coalesce(_c(col), F.lit("")))
    text = F.when(text == "", fallback).otherwise(text)
    cut = F.substring(F.btrim(F.regexp_replace(text, r"[\[\]:*?/\\]", "_"), F.lit("'")), 1, 64)
    return F.when(cut == "", fallback).otherwise(cut)


def match_tokens(col: Column | str, shortest: int = 3) -> Column:
    """TXT-24: distinct lower-case tokens of at least ``shortest`` characters."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(_c(col), F.lit(""))), "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= shortest))


def priority_key(col: Column | str) -> Column:
    """TOP-03: order of priorities: P0 .. P99, then P100 and up, then everything else."""
    up = F.upper(F.trim(F.coalesce(_c(col), F.lit(""))))
    number = F.regexp_extract(up, "^P([0-9]+)$", 1).try_cast("bigint")
    return F.struct(F.when(number.isNull(), 2).when(number < 100, 0).otherwise(1).alias("band"),
                    F.coalesce(number, F.lit(0)).alias("number"), up.alias("text"))
