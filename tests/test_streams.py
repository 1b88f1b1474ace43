"""The files that streams of whole tables read."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from faultline.plans import streams
from faultline.streaming import jobs

START = datetime(2026, 1, 1)


def timed(spark, n):
    return spark.range(n).select("id", (F.lit(START).cast("timestamp_ntz") + F.expr("id * interval '1' minute")).alias("ts"))


def tasks_of_triggers(spark, stream):
    """Partitions and rows of every trigger."""
    seen = []
    jobs.for_each_batch(stream, lambda batch, _: seen.append((batch.rdd.getNumPartitions(), batch.count())), streams.scratch(spark, "p")).awaitTermination()
    return seen


def test_a_trigger_is_read_by_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(4000).withColumn("text", F.sha2(F.col("id").cast("string"), 512))
    stream = streams.as_stream(rows, "rows", triggers=2)
    seen = tasks_of_triggers(spark, stream)
    assert len(seen) == 2 and sum(n for _, n in seen) == 4000
    assert all(parts >= cores for parts, _ in seen)


def test_the_far_later_row_is_found_without_gathering_all(spark):
    rows = timed(spark, 1000)
    later = streams.far_later(rows)
    plan = later._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" in plan and "Union" not in plan and "Coalesce" not in plan
    (row,) = later.collect()
    assert (row.id, row.ts) == (999, START + timedelta(minutes=999, days=400))


def test_shuffled_slices_hold_all_rows_and_one_more(spark):
    rows = timed(spark, 1000)
    seen = tasks_of_triggers(spark, streams.shuffled_stream(rows, "rows"))
    assert sum(n for _, n in seen) == 1001 and seen[-1][1] == 1 and len(seen) == 5
