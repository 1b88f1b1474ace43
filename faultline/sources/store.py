"""Keyed tables in hash buckets, several of them under one manifest.

A store holds tables with one row per key. The rows of a key lie in the bucket of its hash; a manifest names the folder of every
bucket of every table and is the only thing a reader needs. A commit merges updates into the buckets they touch, writes those
anew beside the old ones and then the next manifest, which changes all tables at once. Readers keep the version they
opened, a failed commit leaves nothing in use, and of two writers that start from one version the second fails.

Each manifest carries a ledger with the last batch of every source: a batch that comes again changes nothing. Manifests are
small JSON files: tables x buckets names. Choose `buckets` so that a bucket fits a task. Rows with a null key are not stored.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions.text import instant
from faultline.operators import keyed
from faultline.session import stage
from faultline.sources import files

BUCKETS = 32
SALTS = 4
BUCKET = "_bucket"
MANIFESTS, DATA = "manifests", "data"


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(name.removesuffix(".json")) for name in files.names(spark, f"{path}/{MANIFESTS}") if name.endswith(".json")]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The newest (or a given) manifest; one that is still being written is passed over."""
    for number in [version] if version is not None else reversed(versions(spark, path)):
        try:
            return json.loads(files.read(spark, f"{path}/{MANIFESTS}/{number:012d}.json"))
        except json.JSONDecodeError:
            continue
    return None


def _commit(spark: SparkSession, path: str, state: dict) -> int:
    files.write_new(spark, f"{path}/{MANIFESTS}/{state['version']:012d}.json", json.dumps(state, sort_keys=True))
    return state["version"]


def create(spark: SparkSession, path: str, tables: dict[str, tuple[str, str]], buckets: int = BUCKETS) -> None:
    """Make a store of tables (name: (schema, key)); nothing happens if it is there."""
    if manifest(spark, path) is None:
        state = {name: {"schema": schema, "key": key, "buckets": buckets, "top": 0, "files": {}} for name, (schema, key) in tables.items()}
        _commit(spark, path, {"version": 0, "tables": state, "applied": {}})


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _rows(spark: SparkSession, path: str, table: dict, touched: list[str] | None = None) -> DataFrame:
    places = [f"{path}/{place}" for bucket, place in sorted(table["files"].items()) if touched is None or bucket in touched]
    if not places:
        return spark.createDataFrame([], table["schema"])
    return spark.read.schema(table["schema"]).parquet(*places)


def read(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the newest (or a given) version."""
    return _rows(spark, path, manifest(spark, path, version)["tables"][name])


def commit(
    spark: SparkSession, path: str, changes: dict[str, tuple[DataFrame, list[str] | None]], source: str, batch: int, as_of=None
) -> int:
    """Merge updates (table: (rows, their order)) as one version; gives its number.

    The newest update of a key wins and keeps the key's id. Updates without an order have one row per key and are read from
    stored tables: they are neither staged nor reduced again. A batch that the source has committed before changes nothing.
    """
    state = manifest(spark, path)
    if state["applied"].get(source, -1) >= batch:
        return state["version"]
    for name, (updates, order) in changes.items():
        table = state["tables"][name]
        key = table["key"]
        bucket = bucket_of(F.col(key).cast(_kind(spark, table)), table["buckets"])
        new = updates.where(F.col(key).isNotNull()).withColumn(BUCKET, bucket)
        new = new if order is None else stage(new, name)
        touched = [str(r[0]) for r in new.select(BUCKET).distinct().collect()]
        if not touched:
            continue
        target = _rows(spark, path, table, touched)
        # The rows of a bucket are written by SALTS tasks, so that few buckets of many rows do not mean few tasks.
        salt = F.pmod(F.xxhash64(F.col(key).cast(_kind(spark, table)), F.lit(1)), F.lit(SALTS))
        if "id" in target.columns:
            merged = keyed.upsert_by_key(target, new.drop(BUCKET), key, order or [key], as_of, table["top"])
            merged = merged.withColumn(BUCKET, bucket).repartition(BUCKET, salt)
        else:
            newest = new if order is None else keyed.latest_per_key(new, [key], order)
            merged = _merged(target.withColumn(BUCKET, bucket), newest, key, salt, as_of)
        place = f"{DATA}/{name}-{uuid.uuid4().hex}"
        merged.write.partitionBy(BUCKET).parquet(f"{path}/{place}")
        table["files"] |= {b: f"{place}/{BUCKET}={b}" for b in touched}
        if "id" in merged.columns:
            table["top"] = max(table["top"], _rows(spark, path, table, touched).agg(F.max("id")).first()[0] or 0)
    state["applied"][source] = batch
    state["version"] += 1
    return _commit(spark, path, state)


def _merged(target: DataFrame, newest: DataFrame, key: str, salt: Column, as_of=None) -> DataFrame:
    """The rows of `keyed.upsert_by_key` for a target without numbers and updates with one row per key, dealt for writing.

    Old and new rows meet in the bucket and salt that write them, so they are shuffled once for the merge and the write.
    """
    now = instant(as_of)
    own = [c for c in target.columns if c in newest.columns and c not in ("created_at", "updated_at")]
    rest = [c for c in target.columns if c not in own]
    times = [now.alias(c) for c in rest if c in ("created_at", "updated_at")]
    added = newest.select(*own, *times, F.lit(False).alias("_old"))
    both = target.withColumn("_old", F.lit(True)).unionByName(added, allowMissingColumns=True)
    dealt = both.withColumn("_salt", salt).repartition(BUCKET, "_salt")
    order = Window.partitionBy(BUCKET, "_salt", key).orderBy("_old")
    before = F.lead(F.struct("_old", *rest)).over(order)
    placed = dealt.withColumns({"_n": F.row_number().over(order), "_before": before}).filter("_n = 1")

    def value(name: str) -> Column:
        if name == "created_at":
            return F.coalesce(F.col("_before.created_at"), F.col(name), now)
        if name == "updated_at" or name in own:
            return F.col(name)
        return F.when(F.col("_old"), F.col(name)).otherwise(F.col(f"_before.{name}"))

    return placed.select(*[value(name).alias(name) for name in target.columns])


def _kind(spark: SparkSession, table: dict) -> str:
    """The key's stored type; updates may bring another."""
    return spark.createDataFrame([], table["schema"]).schema[table["key"]].dataType.simpleString()


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove manifests but the newest `keep`, and the folders that these do not name; gives the number of folders."""
    numbers = versions(spark, path)
    kept = [manifest(spark, path, n) for n in numbers[-keep:]]
    used = {place for state in kept for table in state["tables"].values() for place in table["files"].values()}
    for n in numbers[:-keep]:
        files.remove(spark, f"{path}/{MANIFESTS}/{n:012d}.json")
    gone = 0
    for write in files.names(spark, f"{path}/{DATA}"):
        for bucket in files.names(spark, f"{path}/{DATA}/{write}"):
            if bucket.startswith(f"{BUCKET}=") and f"{DATA}/{write}/{bucket}" not in used:
                gone += files.remove(spark, f"{path}/{DATA}/{write}/{bucket}")
    return gone
