"""Local session for tests and checks."""

import os
import tempfile

from pyspark.sql import SparkSession

from faultline.session import configure


def local_session(cores: str | int = "8", memory: str = "8g") -> SparkSession:
    cores = os.environ.get("BENCH_CPUS", cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("faultline")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return configure(spark)
