"""Series labels: matchers, keys, renames."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(label: Column, pattern: str) -> Column:
    """Regex matcher over the whole value; an absent label counts as empty."""
    return F.rlike(F.coalesce(label, F.lit("")), F.lit(f"^(?:{pattern})$"))


def match_labels(labels: Column, equal: dict | None = None, regex: dict | None = None) -> Column:
    condition = F.lit(True)
    for name, value in (equal or {}).items():
        condition = condition & (F.coalesce(labels[name], F.lit("")) == value)
    for name, pattern in (regex or {}).items():
        condition = condition & matches(labels[name], pattern)
    return condition


def series_key(labels: Column) -> Column:
    """Canonical, groupable form of a label map."""
    return F.array_sort(F.map_entries(labels))


def rename_label(labels: Column, old: str, new: str) -> Column:
    """Copy label `old` to `new`, as a replace-all of one label by another does; both stay."""
    kept = F.map_filter(labels, lambda key, _: key != new)
    return F.map_concat(kept, F.create_map(F.lit(new), F.coalesce(labels[old], F.lit(""))))


def phrase(text: Column, words: str) -> Column:
    """Whole-token phrase search, ignoring case.

    A dot, colon or apostrophe between two word characters joins them into one token, so the last
    part of a dotted class name is no token of its own.
    """
    joined = r"\W+".join(words.split())
    return F.rlike(text, F.lit(rf"(?iU)(?<!\w)(?<!\w[.:'])(?:{joined})(?!\w)(?![.:']\w)"))


def has_phrase(text: Column, words: str) -> Column:
    return F.coalesce(phrase(text, words), F.lit(False))


def contains_text(text: Column, words: str) -> Column:
    return F.contains(F.lower(text), F.lit(words.lower()))
