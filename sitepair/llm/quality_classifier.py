"""Operator 3, quality classifier: importance resampling by hashed n-gram models.

Two generative models over hashed word unigrams and bigrams, one of the target (labelled good, not
toxic) and one of the raw corpus, give each document the log ratio of its likelihoods. Adding Gumbel
noise to the log weights and taking the k greatest draws k documents without replacement, each with
chances in proportion to its weight.

The raw counts cover every document. The target model is fitted on ``FIT_ROWS`` labelled rows at most,
those with the least hashed ids. Null texts and texts without words have a null weight and are not
drawn. Keys are compared in steps of 2^-20; ties at the k-th key, as of repeated rows, are all drawn.
An empty table, or one without labelled rows (all weights 0), gives a defined result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import Scratch

BUCKETS = 1 << 14
FIT_ROWS = 20_000
KEEP_SHARE = 0.85
STEP = 1 << 20
BINS = 4096


def features(data: bytes) -> np.ndarray:
    starts, ends = tx.spans(data)
    h = tx.word_hashes(data, starts, ends, 3)
    return (np.concatenate([h, tx.grams(h, 2)]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Log ratio of each hashed n-gram."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(fit_rows).withColumn("_target", F.lit(1))
    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(good), "doc_id", "left").select("text", "_target")  # fit_rows ids at most

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts, marks = batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()
            for value, mark in zip(texts, marks, strict=True):
                if value.is_valid:
                    n = np.bincount(features(value.as_py()), minlength=BUCKETS)
                    raw += n
                    if mark:
                        target += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    sums = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, n, m in sums.collect():  # BUCKETS rows at most
        raw[bucket], target[bucket] = n, m
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def score(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``doc_id, n_features, log_weight``."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS numbers

    def run(batches):
        for batch in batches:
            ns, ws = [], []
            for value in batch.column(1).cast(pa.binary()):
                f = features(value.as_py()) if value.is_valid else ()
                ns.append(len(f))
                ws.append(float(shared.value[f].sum()) if len(f) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(ws, pa.float64())], names=["doc_id", "n_features", "log_weight"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, n_features long, log_weight double")


def kth_greatest(keys: DataFrame, k: int) -> int | None:
    """The k-th greatest of the long column ``key``, by histograms of BINS bins; None if there are fewer."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k < 1 or n < k:
        return None
    while low < high:
        width = -(-(high - low + 1) // BINS)
        bins = keys.where(F.col("key").between(low, high)).groupBy(F.expr(f"(key - ({low}L)) div {width}L").alias("bin")).count()
        for b, c in sorted(bins.collect(), reverse=True):  # BINS rows at most
            if c >= k:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            k -= c
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float = KEEP_SHARE, seed: int = 5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, n_features, log_weight, gumbel_key, selected``, a row for each document."""
    scratch = Scratch(docs.sparkSession)
    scored = score(docs, fit(docs, labels, fit_rows))
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    key = F.col("log_weight") - F.log(-F.log(uniform))
    keyed = scratch.write(scored.withColumn("gumbel_key", key).withColumn("key", F.round(F.col("gumbel_key") * STEP).cast("long")), "keys")
    n = keyed.where("key is not null").count()
    bound = kth_greatest(keyed, math.ceil(share * n))
    chosen = F.lit(False) if bound is None else F.coalesce(F.col("key") >= bound, F.lit(False))
    return keyed.withColumn("selected", chosen).drop("key")
