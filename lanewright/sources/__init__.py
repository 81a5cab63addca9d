"""Sources: functions that return a frame of payloads (column output)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.functions.identity import canonical_text


def packed(frame: DataFrame) -> DataFrame:
    """Each row as one struct payload."""
    return frame.select(F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias("output"))


def folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Text files below a folder, each one payload {path, text}."""
    read = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("wholetext", "true")
    return packed(read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def csv_rows(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """Rows of a CSV file with a header; every value is a string."""
    return packed(spark.read.options(header=True, **options).csv(path))


def csv_table(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """A CSV file as one table value."""
    return spark.read.options(header=True, **options).csv(path)


def table_rows(spark: SparkSession, table: str) -> DataFrame:
    """Rows of a table of the catalogue."""
    return packed(spark.table(table))


def jdbc_rows(spark: SparkSession, url: str, table: str, **options: Any) -> DataFrame:
    """Rows of a database table; partitionColumn and bounds make the read parallel."""
    return packed(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load())


def parquet_rows(spark: SparkSession, path: str) -> DataFrame:
    return packed(spark.read.parquet(path))


def object_list(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """{key, etag, size} of objects below a path, without reading their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    etag = F.sha2(F.concat_ws(":", "path", F.col("modificationTime").cast("string"), F.col("length").cast("string")), 256)
    return packed(files.select(F.col("path").alias("key"), etag.alias("etag"), F.col("length").alias("size")))


def generated(spark: SparkSession, payloads: Callable[[], Iterable[Any]]) -> DataFrame:
    """Payloads of a Python generator, as canonical JSON; for small sources that the driver lists."""
    rows = [(canonical_text(p),) for p in payloads()]
    return spark.createDataFrame(rows, "output string")


def fetch(listed: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Bytes of listed objects: (key, content), reading only the keys that are asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    keys = listed.select(F.col("output.key").alias("path"))
    return files.join(keys, "path", "left_semi").select(F.col("path").alias("key"), "content")
