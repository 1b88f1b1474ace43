"""Registered queries and the SQL that checks them.

A checking SQL names source tables and mappings in braces; the mappings it needs become its WITH list.
"""

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.plans import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MAPPINGS: dict[str, str] = {
    "event_fields": A.EVENT_FIELDS,
    "requests": A.PARSE_REQUESTS,
    "logs": A.LOG_EVENTS,
    "payloads": A.ALERT_PAYLOADS,
    "incidents": A.INCIDENTS,
    "updates": A.INCIDENT_UPDATES,
    "accounts": A.ACCOUNTS,
    "account_requests": A.ACCOUNT_REQUESTS,
    "payments": A.PAYMENTS,
    "transfers": A.TRANSFERS,
    "balance_updates": A.BALANCE_UPDATES,
    "doc_incidents": A.SIMILARITY_INCIDENTS,
    "uris": A.REQUESTS,
    "answers": A.ANSWERS,
    **{f"m_{name}": sql for name, sql in A.METRICS.items()},
}
NAMES = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(run):
        key = name or run.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = compose(sql)
        return run

    return add


def compose(sql: str) -> str:
    """Fill in table names and put the needed mappings in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in NAMES.findall(text):
            if name in MAPPINGS and name not in needed:
                visit(MAPPINGS[name])
                needed.append(name)

    def plain(text: str) -> str:
        return text.format(**{name: name for name in NAMES.findall(text)}).replace(
            "timestamp_ntz", "timestamp"
        )

    visit(sql)
    parts = [f"{name} as ({plain(MAPPINGS[name])})" for name in needed]
    body = plain(sql).strip()
    own = re.match(r"with\s+(recursive\s+)?", body, re.IGNORECASE)
    if not parts:
        return body
    if own:
        return "with recursive " + ",\n".join(parts) + ",\n" + body[own.end():]
    return "with " + ",\n".join(parts) + "\n" + body
