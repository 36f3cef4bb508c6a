"""Validation of declared hreflang links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate(links: DataFrame, routes: DataFrame) -> DataFrame:
    """``links(source_url, source_route, source_key, source_locale, hreflang, target_url, target_route)``
    against ``routes(route, key)``; a row for each link with its verdict."""
    keyed = links.join(routes.select(F.col("route").alias("target_route"), F.col("key").alias("target_key")), "target_route", "left")
    declared = links.where("target_route is not null").select(F.col("source_route").alias("target_route"), F.col("target_route").alias("source_route")).distinct()
    keyed = keyed.join(declared.withColumn("_back", F.lit(True)), ["source_route", "target_route"], "left")
    reason = (
        F.when(F.col("target_key").isNull(), "not_in_mirror")
        .when(F.lower("hreflang") == "x-default", "x_default")
        .when(F.col("target_key") == F.col("source_key"), "self_reference")
        .when(F.col("source_key").startswith("/") | F.col("target_key").startswith("/"), "site_level")
    )
    keyed = keyed.withColumn("_reason", reason)
    claims = keyed.where("_reason is null").groupBy("target_key", "source_locale").agg(F.min("source_key").alias("_a"), F.max("source_key").alias("_b"))
    claims = claims.where("_a <> _b").select("target_key", "source_locale", F.lit(True).alias("_several"))
    keyed = keyed.join(claims, ["target_key", "source_locale"], "left")
    final = F.coalesce("_reason", F.when(F.col("_several"), "ambiguous_target"))
    return keyed.select(
        "source_url",
        "hreflang",
        "target_url",
        F.coalesce("target_key", F.lit("")).alias("target_translation_key"),
        F.col("target_key").isNotNull().alias("in_mirror"),
        F.coalesce("_back", F.lit(False)).alias("reciprocal"),
        final.isNull().alias("usable"),
        F.coalesce(final, F.lit("")).alias("reject_reason"),
        "source_key",
    )


def alternates(rows: DataFrame) -> DataFrame:
    """``a, b, token``: of usable declarations, the first hreflang in the order of the report."""
    first = F.min_by("hreflang", F.struct("source_url", "hreflang", "target_url"))
    return rows.where("usable").groupBy(F.col("source_key").alias("a"), F.col("target_translation_key").alias("b")).agg(first.alias("token"))


def reject_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("reject_reason").agg(F.count("*").alias("n"), F.sum(F.col("reciprocal").cast("long")).alias("n_reciprocal"))
