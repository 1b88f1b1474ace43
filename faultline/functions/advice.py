"""Rule texts of root-cause recommendations and answer sections."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.text import chain, empty_to_null, strip, text_or


def _around(parts: tuple[str, str], middle: Column) -> Column:
    return F.concat(F.lit(parts[0]), middle, F.lit(parts[1]))


def resolution_from_notes(notes: Column) -> Column:
    """Steps between the two headings, case-insensitive; the whole notes when there is no heading."""
    head = F.instr(F.lower(notes), F.lit(C.NOTES_HEADING))
    steps = strip(F.substring(notes, head + F.lit(len(C.NOTES_HEADING)), F.length(notes)))
    end = F.instr(F.lower(steps), F.lit(C.NOTES_END))
    return (
        F.when((head > 0) & (end > 0), strip(F.substring(steps, F.lit(1), end - 1)))
        .when(head > 0, steps)
        .otherwise(strip(notes))
    )


def extract_section(answer: Column, heading: str) -> Column:
    """Text under a heading up to the next heading; empty when the heading is absent."""
    start = F.instr(F.lower(answer), F.lit(heading.lower()))
    value = strip(F.substring(answer, start + F.lit(len(heading)), F.length(answer)))
    for other in (C.ROOT_CAUSE_HEADING, C.FIX_HEADING):
        at = F.instr(F.lower(value), F.lit(other.lower()))
        value = F.when(at > 1, strip(F.substring(value, F.lit(1), at - 1))).otherwise(value)
    return F.when(start > 0, F.btrim(value, F.lit("- \n"))).otherwise(F.lit(""))


def rule_recommendation(
    service: Column, parsed_service: Column, failure: Column, status: Column, notes: Column
) -> tuple[Column, Column]:
    """(root cause, fix) by ordered rules; notes of the best match win."""
    name = F.coalesce(empty_to_null(service), empty_to_null(parsed_service), F.lit("affected service"))
    kind = F.upper(F.coalesce(failure, F.lit("")))
    code = F.coalesce(status, F.lit(0))
    has_notes = empty_to_null(notes).isNotNull()
    payment = F.contains(F.upper(name), F.lit("PAYMENT")) | F.contains(kind, F.lit("PAYMENT"))
    login = (code == 401) | F.contains(kind, F.lit("AUTH"))
    server = code >= 500
    cause = chain(
        [
            (has_notes, _around(C.CAUSE_SIMILAR, name)),
            (payment, F.lit(C.CAUSE_PAYMENT)),
            (login, F.lit(C.CAUSE_AUTH)),
            (server, _around(C.CAUSE_SERVER, name)),
        ],
        _around(C.CAUSE_DEFAULT, name),
    )
    fix = chain(
        [
            (has_notes, resolution_from_notes(notes)),
            (payment, F.lit(C.FIX_PAYMENT)),
            (login, F.lit(C.FIX_AUTH)),
            (server, _around(C.FIX_SERVER, name)),
        ],
        _around(C.FIX_DEFAULT, name),
    )
    return cause, fix


def score_text(score: Column) -> Column:
    """Score as shown in texts: up to four decimals, at least one, no trailing zeros."""
    fixed = F.format_string("%.4f", score)
    return F.regexp_replace(fixed, r"(\.[0-9]+?)0+$", "$1")


def build_evidence(
    service: Column, alert: Column, failure: Column, status: Column, best_name: Column, best_score: Column
) -> Column:
    code = F.when(status != 0, status.cast("string"))
    best = F.when(
        best_name.isNotNull(),
        F.concat(F.lit(C.BEST_MATCH[0]), best_name, F.lit(C.BEST_MATCH[1]), score_text(best_score)),
    ).otherwise(F.lit(C.NO_MATCH_LINE))
    shown = [text_or(value, C.UNKNOWN_TEXT) for value in (service, alert, failure)]
    shown.append(F.coalesce(code, F.lit(C.UNKNOWN_TEXT)))
    return F.concat_ws("\n", *[F.concat(F.lit(head), value) for head, value in zip(C.EVIDENCE_LINES, shown)], best)


def build_prompt(current: Column, similar: Column) -> Column:
    """Analyst prompt from the incident text and its ranked similar incidents (array of structs)."""
    head, score, notes = C.PROMPT_ITEM
    lines = F.transform(
        similar,
        lambda item: F.concat(
            F.lit(head), F.coalesce(empty_to_null(item["incident_number"]), item["incident_id"].cast("string")),
            F.lit(score), score_text(item["similarity_score"]),
            F.lit(notes), text_or(item["notes"], C.PROMPT_NO_NOTES),
        ),
    )
    return F.concat(
        F.lit(C.PROMPT_HEAD), F.lit(C.PROMPT_CURRENT), current,
        F.lit(C.PROMPT_SIMILAR), text_or(F.concat_ws("\n\n", lines), C.PROMPT_NO_SIMILAR),
    )
