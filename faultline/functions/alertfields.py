"""Scalar rules of alert normalisation."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.text import blank_to_null, empty_to_null, is_blank

# --- fixed values: ISO time with an optional offset; signed whole number; log line time format ---
ISO_TIME = (
    r"^(?i)([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?)"
    r"(?:Z|[+-][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?$"
)
PLAIN_TIME = r"^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})$"
WHOLE_NUMBER = r"^[+-]?[0-9]+$"
LOG_LINE_TIME = "yyyy-MM-dd'T'HH:mm:ss"
ASCII_WORD = "".join(chr(code) for code in range(128) if chr(code).isalnum())
ASCII_NON_WORD = "".join(chr(code) for code in range(128) if not chr(code).isalnum())


def alert_datetime(text: Column) -> Column:
    """Wall-clock time as written: an offset is dropped, not applied."""
    iso = F.upper(F.regexp_extract(text, ISO_TIME, 1)).try_cast("timestamp_ntz")
    plain = F.regexp_extract(text, PLAIN_TIME, 1).try_cast("timestamp_ntz")
    return F.coalesce(iso, plain)


def whole_number(text: Column) -> Column:
    """Integer value of a trimmed text; decimals and other text give null."""
    return F.when(F.rlike(text, F.lit(WHOLE_NUMBER)), text.try_cast("int"))


def severity_from_level(level: Column) -> Column:
    name = F.upper(blank_to_null(level))
    return (
        F.when(name.isin("ERROR", "FATAL"), F.lit("critical"))
        .when(name.isin("WARN", "WARNING"), F.lit("warning"))
        .when(name.isin("INFO", "DEBUG", "TRACE"), F.lit("info"))
        .otherwise(F.lower(name))
    )


def normalize_incident_status(status: Column) -> Column:
    name = F.upper(blank_to_null(status))
    return F.when(name.isin("ACKNOWLEDGED", "RESOLVED", "FAILED"), name).otherwise(F.lit("OPEN"))


def log_level_of(severity: Column) -> Column:
    return F.when(F.lower(severity).isin("critical", "error"), F.lit("ERROR")).otherwise(F.lit("WARN"))


def synthesize_raw_log(
    level: Column, created: Column, service: Column, trace: Column, status: Column, failure: Column, message: Column
) -> Column:
    """One log line in the shape the log parser reads back."""
    return F.concat(
        F.date_format(created, LOG_LINE_TIME), F.lit(" "), level,
        F.lit(" service="), service,
        F.lit(" traceId="), trace,
        F.lit(" status="), F.coalesce(status.cast("string"), F.lit("500")),
        F.lit(" failure="), failure,
        F.lit(" java.lang.IllegalStateException: "), message,
    )


def summarize_text(text: Column, limit: int = C.SUMMARY_CHARS) -> Column:
    return (
        F.when(is_blank(text), F.lit(C.NO_DETAILS))
        .when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("...")))
        .otherwise(text)
    )


def incident_number(service: Column, key: Column | None = None) -> Column:
    """Service prefix of at most 8 letters or digits and 8 hex digits; repeatable when a key is given."""
    # Dropping listed characters costs far less than a pattern, which is left for texts with others.
    plain = F.translate(service, ASCII_NON_WORD, "")
    kept = F.when(F.btrim(plain, F.lit(ASCII_WORD)) == "", plain).otherwise(F.regexp_replace(plain, "[^A-Za-z0-9]", ""))
    letters = F.upper(kept)
    prefix = F.substring(F.coalesce(empty_to_null(letters), F.lit("INC")), 1, 8)
    digits = F.uuid() if key is None else F.md5(key.cast("string"))
    return F.concat(prefix, F.lit("-"), F.upper(F.substring(digits, 1, 8)))


def reference_number(prefix: str, length: int, key: Column | None = None) -> Column:
    """Prefix and the first characters of a random identifier (8 hex digits, then a dash).

    With a key the digits come from its hash, so a rerun gives the same reference.
    """
    if key is None:
        digits = F.uuid()
    else:
        hashed = F.md5(key.cast("string"))
        digits = F.concat(F.substring(hashed, 1, 8), F.lit("-"), F.substring(hashed, 9, 4))
    return F.concat(F.lit(prefix), F.upper(F.substring(digits, 1, length)))
