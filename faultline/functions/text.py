"""Text and time helpers shared by all column expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: characters that count as white space at the ends of a text ---
CONTROL_SPACE = "".join(chr(code) for code in range(33))
UNICODE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
EPOCH = "1970-01-01 00:00:00"


def strip(text: Column) -> Column:
    """Drop white space of any kind from both ends (F.trim drops blanks only)."""
    return F.btrim(text, F.lit(UNICODE_SPACE))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def blank_to_null(text: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.when(~is_blank(text), F.btrim(text, F.lit(CONTROL_SPACE)))


def sql_text(text: str) -> str:
    """A text as an SQL literal, every character escaped."""
    return "'" + "".join(f"\\u{ord(char):04x}" for char in text) + "'"


def blank_to_null_sql(name: str) -> str:
    """`blank_to_null` of a column as SQL text, for projections of many columns."""
    return (
        f"case when btrim({name}, {sql_text(UNICODE_SPACE)}) <> '' then btrim({name}, {sql_text(CONTROL_SPACE)}) end"
    )


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def text_or(text: Column, default: str) -> Column:
    """The text, or the default when it is null or empty."""
    return F.coalesce(empty_to_null(text), F.lit(default))


def match(text: Column, pattern: str) -> Column:
    """First capture of a pattern, null when it does not match."""
    return empty_to_null(F.regexp_extract(text, pattern, 1))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def epoch_seconds(ts: Column) -> Column:
    return seconds_between(F.lit(EPOCH).cast("timestamp_ntz"), ts)


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_add(
        "MICROSECOND", F.round(seconds * 1e6).cast("bigint"), F.lit(EPOCH).cast("timestamp_ntz")
    )


def instant(value) -> Column:
    """A time parameter as a zone-free timestamp column; None means now (UTC)."""
    if value is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def chain(cases: list[tuple[Column, Column]], default: Column) -> Column:
    """First matching case of an ordered list."""
    (condition, value), *rest = cases
    return reduce(lambda col, case: col.when(*case), rest, F.when(condition, value)).otherwise(default)
