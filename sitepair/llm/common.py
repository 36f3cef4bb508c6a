"""Shared plumbing: scratch tables in the cluster's shared folder and Arrow group iteration."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a local session (as in tests) gets a temporary
    folder; on a cluster that is an error, as executors don't share one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sitepair-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Short rows of one file of a scratch table.
ROWS_A_FILE = 50_000


class Scratch:
    """Written tables that cut lineage: Parquet in the shared folder, so a lost executor loses nothing."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/sitepair-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: set[str] = set()

    def write(self, df: DataFrame, name: str = "t", rows: int | None = None) -> DataFrame:
        """``rows``: how many short rows there are at most, where that is known: few rows are few files."""
        self._n += 1
        if rows is not None and (files := max(1, -(-rows // ROWS_A_FILE))) < int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(files)
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        self._paths.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def delete(self, *frames: DataFrame) -> None:
        """Drop tables that nothing will read again."""
        for df in frames:
            delete_path(self.spark, df._scratch_path)
            self._paths.discard(df._scratch_path)

    def close(self, *kept: DataFrame) -> None:
        """Drop every table but ``kept``, which a result still reads."""
        keep = {df._scratch_path for df in kept}
        for path in self._paths - keep:
            delete_path(self.spark, path)
        self._paths = keep
        if not keep:
            delete_path(self.spark, self.root)

    def free_shuffles(self) -> None:
        """Let the driver drop shuffles of finished jobs that no variable names: their files stay until both
        of its memories are collected."""
        gc.collect()
        self.spark._jvm.System.gc()


def groups(batches, n_keys: int):
    """Tables of equal first ``n_keys`` integer columns, from Arrow batches sorted by them; one group is held at a time."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None and held.num_rows else table
        if not table.num_rows:
            held = table
            continue
        keys = [table.column(i).to_numpy() for i in range(n_keys)]
        change = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        cuts = np.flatnonzero(change) + 1
        start = 0
        for cut in cuts.tolist():
            yield table.slice(start, cut - start)
            start = cut
        held = table.slice(start)
    if held is not None and held.num_rows:
        yield held


def held_out(doc_id):
    """crc32 of the id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
