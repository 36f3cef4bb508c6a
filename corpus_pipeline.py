"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, BPE encoding.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from itertools import accumulate

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitepair.llm import bpe, mixing, near_dedup, quality_rules, substring_dedup
from sitepair.llm.common import Scratch, read
from sitepair.llm.queries import VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dedup.deduplicate(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 13-word windows that an earlier document holds go."""
    return substring_dedup.clean(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    return mixing.in_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, counted and digested, the digest of the decoded bytes, and ``position``: the row's place, from 0, in the mixture.

    ``docs`` is the table that the mixture was written to: its order is that of its files and of the rows in them, which
    Spark reads in an order of its own.
    """
    placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    part = F.regexp_extract("_file", r"part-(\d+)", 1).cast("long")
    files = placed.groupBy("_file").agg(F.count("*").alias("n")).orderBy(part, "_file").collect()  # a row for each file
    before = dict(zip((r[0] for r in files), accumulate((r[1] for r in files), initial=0)))
    starts = F.broadcast(spark.createDataFrame(list(before.items()), "_file string, _start long"))
    placed = placed.join(starts, "_file").select(F.struct("doc_id", (F.col("_start") + F.col("_at")).alias("position")).alias("_key"), "text")
    coded = bpe.encode_digests(placed, bpe.load_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN, "_key")
    return coded.select("_key.doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "_key.position")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("substrings", substrings), ("mixture", mixture), ("tokens", tokens)]

#: Near duplicates and byte-pair merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
