"""Planning of requests for pages that no page links, and their results as a table of responses.

``responses(url, attempt, status)``: what a client got, or null for a transport error. ``probe`` and ``fetch`` take a
client that gives status, type and body, and ask it politely, one request after the other.
"""

from __future__ import annotations

import os
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import html as dom
from ..functions.page import media_relative, resolve
from ..sources.files import write_bytes

#: Letters that follow a date where a day has several pages.
SUFFIXES = ("A", "B", "C", "D")
ASSET_TYPES = ("jpg", "jpeg", "png", "gif", "webp", "pdf", "mp4")


def date_candidates(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """``day, form, slug``: every day of the years, as MMDDYYYY and YYYYMMDD."""
    days = spark.sql(f"SELECT explode(sequence(make_date({first_year}, 1, 1), make_date({last_year}, 12, 31), interval 1 day)) AS day")
    forms = F.array(F.struct(F.lit(0).alias("form"), F.date_format("day", "MMddyyyy").alias("slug")), F.struct(F.lit(1).alias("form"), F.date_format("day", "yyyyMMdd").alias("slug")))
    return days.select("day", F.inline(forms))


def final_status(responses: DataFrame) -> DataFrame:
    """``url, status``: the second attempt counts after a 409 or a transport error."""
    first = responses.where("attempt = 1").select("url", F.col("status").alias("s1"))
    second = responses.where("attempt = 2").select("url", F.col("status").alias("s2"))
    again = F.col("s1").isNull() | (F.col("s1") == 409)
    return first.join(second, "url", "left").select("url", F.when(again, F.col("s2")).otherwise(F.col("s1")).alias("status"))


def hits(candidates: DataFrame, known: DataFrame, responses: DataFrame, prefix: str, extension: str) -> DataFrame:
    """``slug``: candidates not known that answer 200, and their suffixed pages up to the first miss."""
    status = final_status(responses)
    url = F.concat(F.lit(prefix), F.col("probe"), F.lit(extension))
    base = candidates.select("slug").distinct().join(known.select("slug"), "slug", "left_anti").withColumn("probe", F.col("slug"))
    base = base.withColumn("url", url).join(status.where("status = 200"), "url", "left_semi")
    tries = base.select("slug", F.posexplode(F.array(*[F.lit(s) for s in SUFFIXES])).alias("pos", "suffix")).withColumn("probe", F.concat("slug", "suffix"))
    tries = tries.withColumn("url", url).join(status, "url", "left").withColumn("hit", F.coalesce(F.col("status") == 200, F.lit(False)))
    miss = F.min(F.when(~F.col("hit"), F.col("pos"))).over(W.partitionBy("slug"))
    more = tries.withColumn("miss", miss).where("hit and (miss is null or pos < miss)")
    return base.select("slug").union(more.select("probe"))


def fetch_plan(slugs: DataFrame, prefixes: list[str], existing: DataFrame) -> DataFrame:
    """``lang_prefix, slug`` of each version that is not in the mirror; one row of prefixes for each slug."""
    grid = slugs.select("slug").distinct().select(F.explode(F.array(*[F.lit(p) for p in prefixes])).alias("lang_prefix"), "slug")
    return grid.join(existing.select("lang_prefix", "slug").distinct(), ["lang_prefix", "slug"], "left_anti")


def mirror_slugs(mirror: DataFrame, section: str, prefixes: list[str]) -> DataFrame:
    """``lang_prefix, slug`` of the html files right in a section, with or without a language folder;
    a slug is the file name up to its first dot."""
    parts = F.split("rel_path", "/")
    rows = mirror.where(F.col("rel_path").endswith(".html")).select(parts.alias("p"))
    with_prefix = (F.size("p") == 3) & F.col("p")[0].isin(prefixes) & (F.get("p", F.lit(1)) == section)
    without = (F.size("p") == 2) & (F.col("p")[0] == section)
    rows = rows.where(with_prefix | without)
    rows = rows.select(F.when(F.size("p") == 3, F.col("p")[0]).otherwise("").alias("lang_prefix"), F.substring_index(F.element_at("p", -1), ".", 1).alias("slug"))
    return rows.where("slug <> ''").distinct()


def asset_urls(html: str, page_url: str, config) -> list[tuple[str, str]]:
    """Address and media path of each image and source in a page's content, sorted by reference: of the site's own host
    and of ``ASSET_TYPES``. A page without the content selector has none."""
    doc = dom.parse(html.removeprefix("\ufeff"))
    refs = sorted({n.attrs["src"] for top in dom.select(doc, config.extract.content) for n in top.walk() if n.tag in ("img", "source") and "src" in n.attrs})
    host, out = urlsplit(config.site.base_url).hostname, []
    for ref in refs:
        url = resolve(page_url, ref)
        rel = media_relative(url) if url else None
        if rel and urlsplit(url).hostname == host and urlsplit(url).path.rsplit(".", 1)[-1].lower() in ASSET_TYPES:
            out.append((url, rel))
    return out


def answer(client, url: str) -> bool:
    """Whether ``url`` is there; asked once more after a conflict or a transport error."""
    got = client.request(url, "HEAD")
    if got is None or got[0] == 409:
        got = client.request(url, "HEAD")
    return got is not None and got[0] == 200


def probe(client, candidates, prefix: str, extension: str, say=lambda text: None) -> list[str]:
    """Slugs that answer, in the order asked, each with its suffixed ones up to the first miss. One request at a time:
    a live site is not to be asked in parallel."""
    out = []
    for n, slug in enumerate(candidates, 1):
        if answer(client, prefix + slug + extension):
            out.append(slug)
            for suffix in SUFFIXES:
                if not answer(client, prefix + slug + suffix + extension):
                    break
                out.append(slug + suffix)
        if n % 100 == 0:
            say(f"{n} asked, {len(out)} found")
    return out


def fetch(client, slugs: list[str], section: str, raw: str, media_dir: str, config, say=lambda text: None) -> dict:
    """Saves the pages of ``slugs`` that the mirror lacks, in every language, and the assets that they name."""
    done = {"pages_fetched": 0, "pages_skipped": 0, "assets_fetched": 0, "errors": []}
    extension = config.url_pattern.strip_extensions[0] if config.url_pattern.strip_extensions else ""
    for slug in slugs:
        for prefix in config.url_pattern.lang_map:
            name = f"{prefix}/{safe_segment(section)}/{safe_segment(slug)}"
            url, path = f"{config.site.base_url.rstrip('/')}/{name}{extension}", f"{raw}/{name}{extension}.html"
            if os.path.exists(path):
                done["pages_skipped"] += 1
                continue
            got = client.request(url)
            if got is None or got[0] != 200 or "html" not in got[1]:
                done["errors"].append(f"{name}: {'no answer' if got is None else f'status {got[0]}, {got[1]}'}")
                continue
            write_bytes(path, got[2])
            done["pages_fetched"] += 1
            say(f"fetched {name}")
            for asset, rel in asset_urls(got[2].decode(config.site.encoding or "utf-8", "replace"), url, config):
                if not os.path.exists(f"{media_dir}/{rel}") and (found := client.request(asset)) and found[0] == 200 and found[2]:
                    write_bytes(f"{media_dir}/{rel}", found[2])
                    done["assets_fetched"] += 1
    return done


def safe_segment(name: str) -> str:
    if ".." in name or any(c in name for c in "/\\:"):
        raise ValueError(f"'{name}' is not a name in a folder")
    return name
