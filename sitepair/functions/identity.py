"""A page's identity from its path: locale, section, slug, key, output path, type; path safety."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.config import SiteConfig

#: Device names that no file may have, and characters that no name may hold.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
INVALID = r'[<>:"\\|?*\x00-\x1F\x7F-\x9F]'
PATH_LIMIT = 259


def lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    if not table:
        return default
    return reduce(lambda w, kv: w.when(key == kv[0], kv[1]), list(table.items())[1:], F.when(key == next(iter(table)), next(iter(table.values())))).otherwise(default)


def strip_suffix(name: Column, suffixes: list[str]) -> Column:
    """Without the first suffix, in order, that ends it."""
    out = F.when(F.lit(False), name)
    for s in suffixes:
        out = out.when(name.endswith(s), F.substring(name, F.lit(1), F.length(name) - len(s)))
    return out.otherwise(name)


def classify(section: Column, slug: Column, section_types: dict[str, str]) -> Column:
    if not section_types:
        return F.lit("page")
    return F.when(section.isin(list(section_types)), F.when(slug == "index", "listing").otherwise(lookup(section, section_types, F.lit("page")))).otherwise("page")


def identify(mirror: DataFrame, config: SiteConfig) -> DataFrame:
    """Adds the identity to each ``rel_path`` of a mirror."""
    up = config.url_pattern
    rel = F.col("rel_path")
    parts = F.split(rel, "/")
    first = F.element_at(parts, 1)
    prefix = F.when(first.isin(list(up.lang_map)), first).otherwise("")
    out = mirror.withColumn("lang_prefix", prefix).withColumn("locale", lookup(prefix, up.lang_map, F.lit(up.default_lang)))
    tail = F.when(F.col("lang_prefix") != "", F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    out = out.withColumn("_tail", tail)
    t = F.col("_tail")
    slug = strip_suffix(F.coalesce(F.element_at(t, -1), F.lit("")), up.suffixes)
    key = strip_suffix(F.array_join(t, "/"), up.suffixes)
    out = out.withColumn("section", F.when(F.size(t) > 1, F.element_at(t, 1)).otherwise("")).withColumn("slug", F.when(slug == "", "index").otherwise(slug))
    out = out.withColumn("source_url", F.concat(F.lit(config.site.base_url.rstrip("/") + "/"), F.regexp_replace(rel, r"\.html$", "")))
    out = out.withColumn("translation_key", F.when(F.col("lang_prefix") == "", F.concat(F.lit("/"), key)).otherwise(key))
    names = F.filter(F.array(F.lit("content"), F.col("lang_prefix"), F.col("section"), F.concat("slug", F.lit(".md"))), lambda x: x != "")
    out = out.withColumn("md_path", F.array_join(names, "/"))
    return out.withColumn("page_type", classify(F.col("section"), F.col("slug"), config.extract.section_types)).drop("_tail")


def path_issue(path: Column) -> Column:
    """What makes a relative path unsafe, of its first unsafe segment; null if nothing does."""

    def of(segment: Column) -> Column:
        stem = F.upper(F.substring_index(segment, ".", 1))
        return (
            F.when(stem.isin(list(RESERVED)), F.concat(F.lit("reserved device name '"), segment, F.lit("'")))
            .when(segment.rlike(INVALID), F.concat(F.lit("invalid character in '"), segment, F.lit("'")))
            .when(segment.rlike(r"[. ]\z"), F.concat(F.lit("trailing dot/space in '"), segment, F.lit("'")))
        )

    found = F.filter(F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), of), lambda x: x.isNotNull())
    return F.get(found, F.lit(0))


def length_issue(absolute: Column) -> Column:
    n = F.length(absolute)
    return F.when(n > PATH_LIMIT, F.concat(F.lit("path length "), n.cast("string"), F.lit(" exceeds classic Windows limit (260)")))


def locale_column(locale: str) -> str:
    return locale.replace("-", "_").lower()
