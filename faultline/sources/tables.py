"""Stored tables: scans, versioned tables, models."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from faultline.sources import files

POINTER = "_current"


def scan_table(spark: SparkSession, path: str, schema: str | None = None, format: str = "parquet") -> DataFrame:
    """A stored table; filters and column choices reach the file scan."""
    reader = spark.read.format(format)
    return (reader.schema(schema) if schema else reader).load(path)


def scan_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A database table read in key ranges by many tasks."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
        .options(**options)
        .load()
    )


def write_version(df: DataFrame, path: str, partition_by: list[str] = []) -> str:
    """Write a new version of a table, then switch the pointer to it.

    Readers keep the version they opened; a failed or repeated write leaves the old one in place.
    """
    version, start = uuid.uuid4().hex, _number(df.sparkSession, path)
    df.write.partitionBy(*partition_by).parquet(f"{path}/{version}")
    return _point(df.sparkSession, path, version, start)


def _point(spark: SparkSession, path: str, version: str, start: int | None = None) -> str:
    """Make a written version the current one: the pointer with the highest number wins, whatever the clocks say.

    A number is given once: of two writers that start from the same version the second fails.
    """
    number = (_number(spark, path) if start is None else start) + 1
    files.write_new(spark, f"{path}/{POINTER}/{number:012d}", version)
    return version


def _number(spark: SparkSession, path: str) -> int:
    """Number of the newest pointer, 0 without one."""
    return max(map(int, files.names(spark, f"{path}/{POINTER}")), default=0)


def current_version(spark: SparkSession, path: str) -> str | None:
    number = _number(spark, path)
    return files.read(spark, f"{path}/{POINTER}/{number:012d}") if number else None


def read_version(spark: SparkSession, path: str, version: str | None = None) -> DataFrame | None:
    """The newest (or a given) version of a table; None when nothing is stored."""
    version = version or current_version(spark, path)
    return None if version is None else spark.read.parquet(f"{path}/{version}")


def save_model(path: str, encoders: DataFrame, nodes: DataFrame, params: DataFrame) -> str:
    """Write all parts of a model under one version, then switch one pointer, so no reader mixes two models."""
    version, start = uuid.uuid4().hex, _number(encoders.sparkSession, path)
    for name, table in (("encoders", encoders), ("nodes", nodes), ("params", params)):
        table.write.parquet(f"{path}/{version}/{name}")
    return _point(encoders.sparkSession, path, version, start)


def load_model(spark: SparkSession, path: str):
    """(encoders, (nodes, params)) of the newest model; (None, None) when none is stored."""
    version = current_version(spark, path)
    if version is None:
        return None, None
    encoders, nodes, params = (spark.read.parquet(f"{path}/{version}/{name}") for name in ("encoders", "nodes", "params"))
    return encoders, (nodes, params)


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
