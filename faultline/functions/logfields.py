"""Fields of a raw log text as column expressions (usable on batches and streams)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.text import chain, empty_to_null, match, strip

# --- fixed values: shape of the offset at the end of a time, and the replacement for odd characters ---
ZONE_TAIL = r"(Z|[+-][0-9]{2}:[0-9]{2})$"
NON_WORD = "[^A-Za-z0-9]+"
# A name of these characters and no double underscore is clean already; looking costs far less than a pattern.
CLEAN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"

PATTERNS = {
    "timestamp": C.LOG_TIMESTAMP, "service": C.LOG_SERVICE, "level": C.LOG_LEVEL, "status": C.LOG_STATUS,
    "trace": C.LOG_TRACE, "failure": C.LOG_FAILURE, "message": C.LOG_MESSAGE, "exception": C.LOG_EXCEPTION,
}


def capture(column: str, name: str) -> Column:
    """First capture of one of the log patterns, empty when it does not match.

    The exception pattern tries every token, so texts without either ending skip it.
    """
    found = F.regexp_extract(column, PATTERNS[name], 1)
    if name == "exception":
        ends = F.contains(F.col(column), F.lit("Exception")) | F.contains(F.col(column), F.lit("Error"))
        return F.when(ends, found).otherwise(F.lit(""))
    return found


def parse_log_datetime(text: Column, zone: str = "UTC") -> Column:
    """Wall-clock time of a matched date-time text; a zoned time is moved to `zone`.

    A blank separator with an offset, and `T` with comma fractions, are no known format: null.
    """
    zoned = F.rlike(text, F.lit(ZONE_TAIL))
    has_t = F.substring(text, 11, 1) == "T"
    plain = F.when(has_t & F.contains(text, F.lit(",")), F.lit(None)).otherwise(F.replace(text, F.lit(","), F.lit(".")))
    wall = plain.try_cast("timestamp_ntz")
    local = F.regexp_replace(plain, ZONE_TAIL, "").try_cast("timestamp_ntz")
    tail = F.regexp_extract(text, ZONE_TAIL, 1)
    sign = F.when(F.startswith(tail, F.lit("-")), -1).otherwise(1)
    shift = F.make_dt_interval(
        F.lit(0),
        sign * F.coalesce(F.substring(tail, 2, 2).try_cast("int"), F.lit(0)),
        sign * F.coalesce(F.substring(tail, 5, 2).try_cast("int"), F.lit(0)),
        F.lit(0.0),
    )
    moved = F.convert_timezone(F.lit("UTC"), F.lit(zone), local - shift)
    return F.when(~zoned, wall).when(has_t, moved)


def extract_timestamp(raw: Column, fallback: Column, zone: str = "UTC") -> Column:
    return F.coalesce(parse_log_datetime(match(raw, C.LOG_TIMESTAMP), zone), fallback)


def extract_service(raw: Column, fallback: Column) -> Column:
    return F.coalesce(match(raw, C.LOG_SERVICE), fallback)


def extract_log_level(raw: Column) -> Column:
    return match(raw, C.LOG_LEVEL)


def extract_status_code(raw: Column, fallback: Column) -> Column:
    return F.coalesce(match(raw, C.LOG_STATUS).try_cast("int"), fallback.cast("int"))


def extract_trace_id(raw: Column, fallback: Column) -> Column:
    return F.coalesce(match(raw, C.LOG_TRACE), fallback)


def extract_exception(raw: Column) -> Column:
    return match(raw, C.LOG_EXCEPTION)


def error_message(raw: Column, exception: Column, marker: Column, named: Column, fallback: Column) -> Column:
    """Text behind the exception (at `marker`), else the `message=` value, else behind a dash, else fallback, else all."""
    dash = F.instr(raw, F.lit(C.LOG_DASH))
    whole = F.length(raw)
    text = chain(
        [
            (marker > 0, F.substring(raw, marker + F.length(exception) + 1, whole)),
            (named != "", named),
            (dash > 0, F.substring(raw, dash + len(C.LOG_DASH), whole)),
        ],
        F.lit(None).cast("string"),
    )
    return F.coalesce(strip(text), empty_to_null(fallback), strip(raw))


def extract_error_message(raw: Column, exception: Column, fallback: Column) -> Column:
    marker = F.coalesce(F.instr(raw, F.concat(exception, F.lit(":"))), F.lit(0))
    return error_message(raw, exception, marker, F.regexp_extract(raw, C.LOG_MESSAGE, 1), fallback)


def cleaned_name(text: Column) -> Column:
    """Upper-case words joined by one underscore; empty when nothing is left."""
    name = F.upper(strip(text))
    clean = (F.btrim(name, F.lit(CLEAN)) == "") & ~F.contains(name, F.lit("__"))
    words = F.when(clean, name).otherwise(F.regexp_replace(name, NON_WORD, "_"))
    return F.btrim(words, F.lit("_"))


def normalize_failure_type(text: Column) -> Column:
    return F.coalesce(empty_to_null(cleaned_name(text)), F.lit(C.DEFAULT_FAILURE))


def everything(raw: Column, exception: Column, message: Column) -> Column:
    blank = F.lit("")
    return F.lower(F.concat_ws(" ", F.coalesce(exception, blank), F.coalesce(message, blank), raw))


def failure_by_rule(text: Column, status: Column) -> Column:
    """Failure type by keywords of the lower-case text, then by status code."""

    def says(word: str) -> Column:
        return F.contains(text, F.lit(word))

    return chain(
        [
            (says("timeout"), F.lit("TIMEOUT")),
            (
                says("invalid login") | says("authentication") | F.coalesce(status == 401, F.lit(False)),
                F.lit("AUTHENTICATION_FAILURE"),
            ),
            (says("blocked") & says("payment"), F.lit("PAYMENT_BLOCKED")),
            (status >= 500, F.lit("SERVER_ERROR")),
            (status >= 400, F.lit("CLIENT_ERROR")),
        ],
        F.lit(C.DEFAULT_FAILURE),
    )


def classify_failure(
    raw: Column, fallback: Column, exception: Column, message: Column, status: Column
) -> Column:
    """A named failure type, else the caller's, else keyword and status rules in order."""
    named = F.coalesce(match(raw, C.LOG_FAILURE), empty_to_null(fallback))
    by_rule = failure_by_rule(everything(raw, exception, message), status)
    return F.when(named.isNotNull(), normalize_failure_type(named)).otherwise(by_rule)
