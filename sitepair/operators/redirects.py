"""Redirects from old addresses to new routes, and the exporters that render them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.routing import url_path

#: Name of an exporter: the file that it writes, and the line of a redirect.
EXPORTERS: dict[str, tuple[str, Column]] = {}


def exporters() -> dict[str, tuple[str, Column]]:
    nginx = F.concat(F.lit("location = "), F.col("old"), F.lit(" { return 301 "), F.col("new"), F.lit("; }"))
    return {"nginx": ("redirects.nginx.conf", nginx), "netlify": ("_redirects", F.concat(F.col("old"), F.lit(" "), F.col("new"), F.lit(" 301"))), **EXPORTERS}


def redirect_map(pages: DataFrame, *also: str) -> DataFrame:
    """A row for each safe page, which has ``route``; ``also`` are columns of the page to keep, as to sort by."""
    return pages.select(*also, F.col("source_url").alias("old_url"), F.col("route").alias("new_path"), F.col("locale").alias("lang"), "translation_key")


def deployable(redirects: DataFrame) -> DataFrame:
    """``old, new`` of the addresses that change."""
    return redirects.select(url_path(F.col("old_url")).alias("old"), F.col("new_path").alias("new")).where("old <> new").distinct()


def rules(redirects: DataFrame) -> DataFrame:
    """``old`` and the line of each exporter."""
    return deployable(redirects).select("old", *[line.alias(name) for name, (_, line) in exporters().items()])
