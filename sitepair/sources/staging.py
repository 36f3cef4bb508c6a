"""Written tables that cut lineage: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sitepair-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Stage:
    """Tables of one run; ``close`` drops them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self._n = spark, f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
