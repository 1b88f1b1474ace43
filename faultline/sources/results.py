"""Stored results of incidents: one row per incident, the newest one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schemas
from faultline.sources import store

TABLES = {
    "anomaly_results": (schemas.ANOMALY_RESULT, "incident_id"),
    "recommendations": (schemas.RECOMMENDATION, "incident_id"),
}
OWN = ("id", "created_at", "updated_at")


def save_results(spark: SparkSession, path: str, name: str, results: DataFrame, source: str, batch: int, as_of=None) -> int:
    """Keep results by incident: a later result replaces an earlier one and keeps its id and time of creation; a repeated
    batch changes nothing. Results that were not found are not kept."""
    store.create(spark, path, TABLES)
    found = results.filter("found") if "found" in results.columns else results
    stored = [f.split()[0] for f in TABLES[name][0].split(", ")]
    rows = found.select(*[c for c in stored if c not in OWN]).withColumn("place", F.lit(0))
    return store.commit(spark, path, {name: (rows, ["place"])}, source, batch, as_of)


def saved_results(spark: SparkSession, path: str, name: str) -> DataFrame:
    return store.read(spark, path, name)
