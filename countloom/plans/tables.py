"""Tables written between the steps of an iteration, in the folder that executors share: they cut lineage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from countloom.workers import reachable


class Tables:
    own: str | None = None

    def __init__(self, spark: SparkSession):
        at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not at:
            master = spark.sparkContext.master
            if not re.fullmatch(r"local(\[.*\])?", master):
                raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (the master is {master})")
            Tables.own = at = Tables.own or "file://" + tempfile.mkdtemp(prefix="countloom-")
        self.spark, self.base = reachable(spark), f"{at.rstrip('/')}/tables-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def settle(self) -> None:
        """Let go of the shuffle files of queries that are done: they stay until the driver collects its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()
