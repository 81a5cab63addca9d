"""Expanding rows into rows whose lane is their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.functions.identity import canonical, lane_of, sha


def expand(frame: DataFrame, payloads: Column, row_key: str | None = None) -> DataFrame:
    """(lane, output) of each distinct payload in an array column.

    With a row key the lane depends on that field alone; a null or repeated key
    is an error.
    """
    return mint(frame.select(F.explode(payloads).alias("output")), row_key)


def mint(rows: DataFrame, row_key: str | None = None) -> DataFrame:
    """(lane, output) for a column output of payloads; equal payloads collapse."""
    output = F.col("output")
    if row_key is None:
        kind = rows.schema["output"].dataType.simpleString()
        hashed = sha(F.concat(F.lit("b:"), output.cast("string"))) if kind == "binary" else sha(canonical(output))
        return rows.select(lane_of(hashed).alias("lane"), "output").dropDuplicates(["lane"])
    key = output[row_key].cast("string")
    safe = F.coalesce(key, F.raise_error(F.lit(f"null row key {row_key}")).cast("string"))
    keyed = rows.select(lane_of(sha(safe)).alias("lane"), "output")
    once = keyed.groupBy("lane").agg(F.first("output").alias("output"), F.count("*").alias("n"))
    fail = F.raise_error(F.lit(f"repeated row key {row_key}")).cast("string")
    return once.select(F.when(F.col("n") > 1, fail).otherwise(F.col("lane")).alias("lane"), "output")
