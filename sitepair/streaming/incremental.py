"""New files of a mirror, identified and extracted as they arrive; the folds are run again by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import identify
from ..operators.inventory import gate
from ..plans.extract import extract_pages
from ..sources.config import SiteConfig


def start(spark: SparkSession, source: str, schema: str, config: SiteConfig, sink: str, checkpoint: str):
    """A query that adds what ``source`` (Parquet of ``rel_path, html``) gains to Parquet in ``sink``.

    Each batch has a folder of its own, ``batch=n``, so that a repeated one replaces itself. A page whose output path
    an earlier batch owns is left out, whatever its case.
    """

    def add(batch: DataFrame, n: int) -> None:
        safe = gate(identify(batch, config)).where("issue is null").drop("issue")
        if n:
            owned = spark.read.schema("md_path string, batch long").option("basePath", sink).parquet(sink).where(F.col("batch") < n)
            safe = safe.join(owned.select(F.lower("md_path").alias("_o")).distinct(), F.lower("md_path") == F.col("_o"), "left_anti")
        extract_pages(safe, config).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return spark.readStream.schema(schema).parquet(source).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()
