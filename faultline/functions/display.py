"""Display rules: tones, labels, ranks, bands, local time."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.text import empty_to_null, strip


def _name(text: Column) -> Column:
    return F.upper(strip(text))


def _tone(text: Column, tones: dict[str, str], other: str) -> Column:
    return F.coalesce(rank_of(_name(text), tones), F.lit(other))


def severity_tone(severity: Column) -> Column:
    return _tone(severity, C.SEVERITY_TONES, C.SEVERITY_TONE)


def parser_tone(status: Column) -> Column:
    return _tone(status, C.PARSER_TONES, C.PARSER_TONE)


def status_tone(status: Column) -> Column:
    return _tone(status, C.STATUS_TONES, C.STATUS_TONE)


def _checked(texts: tuple[str, str, str], checked: Column, is_anomaly: Column) -> Column:
    return F.when(~checked, texts[0]).when(is_anomaly, texts[1]).otherwise(texts[2])


def anomaly_label(checked: Column, is_anomaly: Column) -> Column:
    return _checked(C.ANOMALY_LABELS, checked, is_anomaly)


def anomaly_tone(checked: Column, is_anomaly: Column) -> Column:
    return _checked(C.ANOMALY_TONES, checked, is_anomaly)


def display_incident_number(number: Column, key: Column) -> Column:
    """The number, or INC- and the id padded to five digits; longer ids stay whole."""
    digits = F.coalesce(key, F.lit(0)).cast("string")
    padded = F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits)
    return F.coalesce(empty_to_null(number), F.concat(F.lit("INC-"), padded))


def local_time(ts: Column, zone: str = C.LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def local_day(ts: Column, zone: str = C.LOCAL_ZONE) -> Column:
    """Local calendar day as text; no time gives an empty text."""
    return F.coalesce(F.date_format(local_time(ts, zone), "yyyy-MM-dd"), F.lit(""))


def format_local(ts: Column, zone: str = C.LOCAL_ZONE) -> Column:
    return F.coalesce(F.date_format(local_time(ts, zone), C.LOCAL_FORMAT), F.lit(C.NOT_AVAILABLE))


def rank_of(value: Column, ranks: dict) -> Column:
    """Entry of a fixed map; values the map does not name give null."""
    pairs = [F.lit(item) for pair in ranks.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), value)


def severity_rank(severity: Column) -> Column:
    return rank_of(severity, C.SEVERITY_RANK)


def state_rank(status: Column, open_is_active: bool = False) -> Column:
    extra = {"OPEN": 2, "open": 2} if open_is_active else {}
    return rank_of(status, C.STATE_RANK | extra)


def threshold_band(value: Column, bands: list[tuple]) -> Column:
    """Colour of the highest step that the value reaches; the first step has no lower bound."""
    colour = F.lit(bands[0][1])
    for step, name in bands[1:]:
        colour = F.when(value >= step, F.lit(name)).otherwise(colour)
    return F.when(value.isNotNull(), colour)
