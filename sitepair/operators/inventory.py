"""Folds over pages: the safety gate, the content inventory, media and counts.

First seen and last wins mean the order of ``rel_path`` (then ``page_id`` where paths repeat).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import locale_column, path_issue


def gate(pages: DataFrame, order: tuple[str, ...] = ("rel_path",)) -> DataFrame:
    """Adds ``issue``: null for a page that is safe to write, and the first to have its output path.

    A window on the lower-case path: its partitions are pages of one output path, few by nature.
    """
    pages = pages.withColumn("_unsafe", path_issue(F.col("md_path")))
    owners = W.partitionBy(F.col("_unsafe").isNull(), F.when(F.col("_unsafe").isNull(), F.lower("md_path")).otherwise(F.col("md_path"))).orderBy(*order)
    first = F.first("md_path").over(owners)
    collision = F.when(first == F.col("md_path"), F.concat(F.lit("duplicate output path (another source also maps to '"), F.col("md_path"), F.lit("')"))).otherwise(F.concat(F.lit("case-insensitive collision with '"), first, F.lit("'")))
    return pages.withColumn("issue", F.coalesce("_unsafe", F.when(F.row_number().over(owners) > 1, collision))).drop("_unsafe")


def _order(order: tuple[str, ...]) -> Column:
    return F.struct(*order)


def fold(pages: DataFrame, locales: list[str], order: tuple[str, ...] = ("rel_path",)) -> DataFrame:
    """A row for each translation key. Pages carry ``text_length, image_count, flags`` (array)."""
    by = _order(order)
    lengths = [F.max_by("text_length", F.when(F.col("locale") == loc, by)).alias(f"text_len_{locale_column(loc)}") for loc in locales]
    has = [F.max(F.when(F.col("locale") == loc, 1).otherwise(0)).cast("boolean").alias(f"has_{locale_column(loc)}") for loc in locales]
    first = F.min_by(F.struct("section", "slug", "page_type", "title"), by).alias("_first")
    out = pages.groupBy("translation_key").agg(first, F.max("image_count").alias("image_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("flags")))).alias("flags"), *lengths, *has)
    lens = {f"text_len_{locale_column(loc)}": F.when(F.col(f"has_{locale_column(loc)}"), F.col(f"text_len_{locale_column(loc)}")) for loc in locales}
    return out.select("translation_key", "_first.*", "flags", "image_count", *[F.col(f"has_{locale_column(loc)}") for loc in locales], *[v.alias(k) for k, v in lens.items()])


def pair_status(locales: list[str], suggested: Column) -> Column:
    if len(locales) < 2:
        return F.lit("")
    everywhere = F.lit(True)
    for loc in locales:
        everywhere = everywhere & F.col(f"has_{locale_column(loc)}")
    return F.when(F.col("translation_key").startswith("/"), "site_level").when(everywhere, "paired").when(suggested.isNotNull(), "heuristic_suggested").otherwise("missing")


def content_inventory(folded: DataFrame, locales: list[str], suggestions: DataFrame | None = None) -> DataFrame:
    """The inventory's rows. ``suggestions(translation_key, suggested_pair, pair_evidence)``, both ways round."""
    if suggestions is None:
        joined = folded.withColumn("suggested_pair", F.lit(None).cast("string")).withColumn("pair_evidence", F.lit(None).cast("string"))
    else:
        joined = folded.join(suggestions, "translation_key", "left")
    names = [locale_column(loc) for loc in locales]
    status = pair_status(locales, F.col("suggested_pair"))
    return joined.select(
        "translation_key",
        "section",
        "slug",
        *[F.col(f"has_{n}") for n in names],
        F.col("page_type").alias("suggested_type"),
        F.lit("").alias("final_type"),
        F.array_join("flags", ";").alias("flags"),
        status.alias("pair_status"),
        F.coalesce("suggested_pair", F.lit("")).alias("suggested_pair"),
        F.coalesce("pair_evidence", F.lit("")).alias("pair_evidence"),
        *[F.coalesce(F.col(f"text_len_{n}").cast("long"), F.lit(0).cast("long")).alias(f"text_len_{n}") for n in names],
        F.col("image_count").cast("long").alias("image_count"),
        F.lit("").alias("notes"),
    )


def single_locale_counts(folded: DataFrame, locales: list[str]) -> DataFrame:
    """Keys found in one locale alone, site-level ones too; none for a monolingual site."""
    names = [locale_column(loc) for loc in locales]
    n = sum((F.col(f"has_{x}").cast("int") for x in names), F.lit(0))
    which = F.coalesce(*[F.when(F.col(f"has_{x}"), loc) for x, loc in zip(names, locales, strict=True)])
    rows = folded.where(n == 1) if len(locales) > 1 else folded.where(F.lit(False))
    return rows.select(which.alias("locale")).groupBy("locale").agg(F.count("*").alias("n"))


def flag_counts(folded: DataFrame) -> DataFrame:
    """``flag, n``: the keys that carry each flag."""
    return folded.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def route_keys(pages: DataFrame, order: tuple[str, ...] = ("rel_path",)) -> DataFrame:
    """``route, key``: the last page of a route wins."""
    return pages.groupBy("route").agg(F.max_by("translation_key", _order(order)).alias("key"))


def media_manifest(uses: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``uses(media, original_url, page, alt, rel_path, pos)`` folded for each file; ``files(media, sha1, bytes)``."""
    out = uses.groupBy("media").agg(
        F.min_by("original_url", F.struct("rel_path", "pos")).alias("original_url"),
        F.array_join(F.array_sort(F.collect_set("page")), " | ").alias("referenced_by"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("alt") != "", F.col("alt")))), " | ").alias("alt"),
    )
    return out if files is None else out.join(files, "media", "left")
