"""Small files in a shared folder, through the file system that Spark uses."""

from pyspark.sql import SparkSession


def place(spark: SparkSession, path: str):
    """(file system, path object) of a path."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Create a file; fails if it exists, which is what tells a second writer that it came too late."""
    fs, file = place(spark, path)
    out = fs.create(file, False)
    out.write(bytearray(text.encode()))
    out.close()


def read(spark: SparkSession, path: str) -> str:
    fs, file = place(spark, path)
    stream = fs.open(file)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> bool:
    fs, found = place(spark, path)
    return fs.delete(found, True)
