"""Inputs of the registered queries, derived from the driver's tables.

``mirror`` reads page paths as they are; the others are declared synthetic derivations, for what the
tables lack (versions in several languages, declarations, links, media, responses).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import identify
from ..functions.routing import route_for_path, url_path
from ..operators.inventory import gate
from ..sources.config import Extract, SiteConfig, Site, UrlPattern

BASE = "https://site.example"
CONFIG = SiteConfig(
    site=Site(base_url=BASE),
    url_pattern=UrlPattern(lang_map={"en": "en", "fr": "fr", "de": "de", "es": "es"}, default_lang="en", strip_extensions=[".html"]),
    extract=Extract(content="article", section_types={"s0": "article", "s1": "event"}, section_flags={"s2": "needs_rebuild"}),
)
#: Several prefixes of one locale.
TWO_LOCALES = SiteConfig(site=Site(base_url=BASE), url_pattern=UrlPattern(lang_map={"en": "en", "fr": "intl", "de": "intl", "es": "intl"}, default_lang="en", strip_extensions=[".html"]), extract=CONFIG.extract)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.concat(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), F.lit(".html"))
    return table(spark, sf_dir, "pages").select("page_id", rel.alias("rel_path"), "html")


def pages(spark: SparkSession, sf_dir: str, config: SiteConfig = CONFIG) -> DataFrame:
    out = identify(mirror(spark, sf_dir), config)
    return out.withColumn("route", route_for_path(url_path(F.col("source_url")), config.url_pattern.strip_extensions))


def safe_pages(spark: SparkSession, sf_dir: str, config: SiteConfig = CONFIG) -> DataFrame:
    return gate(pages(spark, sf_dir, config), ("rel_path", "page_id")).where("issue is null")


def versions(spark: SparkSession, sf_dir: str, config: SiteConfig = CONFIG) -> DataFrame:
    """Synthetic: paths by which pages fall together as language versions; measures from the html."""
    rows = table(spark, sf_dir, "pages").select("page_id", "html", F.regexp_extract("url", r"/(en|fr|de|es)/([0-9]+)", 1).alias("p"), F.regexp_extract("url", r"/(en|fr|de|es)/([0-9]+)", 2).cast("long").alias("n"))
    rel = F.expr("concat(p, '/s', (n div 6) % 5, '/', n div 6, '.html.html')")
    out = identify(rows.where("n is not null").select("page_id", "html", rel.alias("rel_path")), config)
    flags = F.when(F.col("section") == "s2", F.array(F.lit("needs_rebuild"))).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("title", F.regexp_extract("html", "<title>([^<]*)", 1)).withColumn("text_length", F.length("html").cast("long"))
    out = out.withColumn("image_count", F.expr("size(split(html, '<li')) - 1").cast("long")).withColumn("flags", flags).drop("html", "p", "n")
    return gate(out, ("rel_path", "page_id")).where("issue is null").drop("issue")


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic: page p declares page (7p + 3) mod n, and that one p if p is even; every tenth is x-default."""
    own = safe_pages(spark, sf_dir).select("page_id", "source_url", "route", "translation_key", "locale")
    count = table(spark, sf_dir, "pages").agg(F.count("*").alias("n"))
    ends = own.crossJoin(F.broadcast(count)).select("page_id", F.expr("(7 * page_id + 3) % n").alias("target_id"))  # a one-row table
    ends = ends.union(ends.where("page_id % 2 = 0").select("target_id", "page_id"))
    a = own.select("page_id", "source_url", F.col("route").alias("source_route"), F.col("translation_key").alias("source_key"), F.col("locale").alias("source_locale"))
    b = own.select(F.col("page_id").alias("target_id"), F.col("source_url").alias("target_url"), F.col("route").alias("target_route"), F.col("locale").alias("_lang"))
    rows = ends.join(a, "page_id").join(b, "target_id", "left")
    gone = F.concat(F.lit(f"{BASE}/gone/"), F.col("target_id").cast("string"))
    hreflang = F.when(F.col("page_id") % 10 == 0, "x-default").otherwise(F.coalesce("_lang", F.lit("en")))
    return rows.select("source_url", "source_route", "source_key", "source_locale", hreflang.alias("hreflang"), F.coalesce("target_url", gone).alias("target_url"), F.coalesce("target_route", F.concat(F.lit("/gone/"), F.col("target_id").cast("string"))).alias("target_route"))


def title_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic: a document is a page, its source the section, its first sentence the title."""
    title = F.regexp_extract("text", r"^[^.\n]*", 0)
    slug = F.concat(F.lit("d-"), F.expr("doc_id div 3").cast("string"))
    media = F.array(F.concat(F.lit("m"), F.expr("doc_id div 4").cast("string")), F.concat(F.lit("m"), F.expr("doc_id div 6").cast("string")))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("k"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("key"), F.col("source").alias("section"), F.col("lang").alias("locale"), slug.alias("slug"), title.alias("title"), media.alias("media"))


def order_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic: an order's date in one of three forms is a slug; its status the locale, its priority the section."""
    form = F.expr("case o_orderkey % 4 when 0 then date_format(o_orderdate, 'yyyyMMdd') when 1 then date_format(o_orderdate, 'MMddyyyy') when 2 then concat('news-', date_format(o_orderdate, 'ddMMyyyy'), 'x') else concat('n', o_orderkey) end")
    return table(spark, sf_dir, "orders").select("o_orderkey", form.alias("slug"), F.col("o_orderstatus").alias("locale"), F.concat_ws("-", "o_orderpriority", F.expr("cast(o_custkey % 50 as string)")).alias("section"))


def media_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic: an order is a page that uses its parts as media."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("media"),
        F.concat(F.lit(f"{BASE}/files/part"), F.col("l_partkey").cast("string"), F.lit("?"), F.col("l_linenumber").cast("string")).alias("original_url"),
        F.concat(F.lit(f"{BASE}/o"), F.col("l_orderkey").cast("string")).alias("page"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise("").alias("alt"),
        F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("rel_path"),
        F.concat(F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.col("l_suppkey").cast("string")).alias("pos"),
    )
