"""Where intermediate results live, and how lineage is cut."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lanewright.session import shared_dir, ship


class Scratch:
    """Parquet tables below one fresh folder of the shared directory.

    ``cut`` writes a frame there and reads it back, so later plans start from
    files that outlive any executor.  ``drop`` deletes a table as soon as no
    later step reads it, and lets Spark release the shuffle files of plans
    that are no longer referenced.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def cut(self, frame: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/t{self.count}"
        writer = frame.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(self.spark.read.parquet(path).schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(frame.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Ask for a collection now: shuffle files go when their plans do."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
