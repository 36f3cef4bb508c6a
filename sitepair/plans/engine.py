"""The engine over a site's folders: extract, verify, slugs."""

from __future__ import annotations

import os
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import identify, length_issue
from ..functions.routing import route_for_path, route_for_url, url_path
from ..operators import hreflang, inventory, media, orphans, pairing, redirects, verify
from ..sources import files, frontmatter
from ..sources.client import Client
from ..sources.config import SiteConfig, Thumbnails, load_file
from ..sources.staging import Stage
from .extract import extract_pages, image_uses

#: In the output folder, for the next run.
CACHE_FILE = "media_hash_cache.csv"


@dataclass
class ExtractReport:
    pages: int
    translation_keys: int
    suggested_pairs: int
    missing_images: int
    need_fetch: int
    declared: int
    usable: int
    hreflang_in_fallback: bool
    images: int
    types: dict[str, int]
    flags: dict[str, int]
    single_locale: dict[str, int]
    path_errors: int
    path_warnings: int
    stale: list[str]

    @property
    def has_errors(self) -> bool:
        return self.path_errors > 0

    @property
    def has_warnings(self) -> bool:
        """Files that the run no longer writes are reported, and don't count."""
        return bool(self.missing_images or self.need_fetch or self.path_warnings)

    @property
    def exit_code(self) -> int:
        return 2 if self.has_errors else int(self.has_warnings)


class SiteEngine:
    def __init__(self, spark: SparkSession, config: SiteConfig):
        self.spark, self.config = spark, config

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> SiteEngine:
        return cls(spark, load_file(path))

    def tables(self, mirror: DataFrame, media_files: DataFrame, stage: Stage | None = None) -> dict[str, DataFrame]:
        """Every inventory of ``mirror(rel_path, html)`` and ``media_files(media, bytes, sha1)``, as views too.

        Pages, declarations and pairs are written once to ``stage``, from which all others are read.
        """
        stage = stage or Stage(self.spark)
        cfg, up = self.config, self.config.url_pattern
        gated = inventory.gate(identify(mirror, cfg))
        safe = gated.where("issue is null").drop("issue").withColumn("route", route_for_path(url_path(F.col("source_url")), up.strip_extensions))
        pages = stage.write(extract_pages(safe, cfg))  # parsed once, read by every table below
        uses, missing = image_uses(pages, media_files)
        folded = inventory.fold(pages, up.locales)
        host = cfg.site.base_url.split("//", 1)[-1].split("/")[0]
        links = pages.select("source_url", F.col("route").alias("source_route"), F.col("translation_key").alias("source_key"), F.col("locale").alias("source_locale"), F.explode("alternates").alias("x"))
        links = links.select("source_url", "source_route", "source_key", "source_locale", "x.hreflang", "x.target_url").withColumn("target_route", route_for_url(F.col("target_url"), host, up.strip_extensions))
        declared = stage.write(hreflang.validate(links, inventory.route_keys(pages)))
        names = [inventory.locale_column(loc) for loc in up.locales]
        count = sum((F.col(f"has_{n}").cast("int") for n in names), F.lit(0))
        locale = F.coalesce(*[F.when(F.col(f"has_{n}"), loc) for n, loc in zip(names, up.locales, strict=True)])
        held = uses.join(pages.select("rel_path", "translation_key"), "rel_path").groupBy(F.col("translation_key").alias("key")).agg(F.collect_set("media").alias("media"))
        alone = folded.where(count == 1).where(~F.col("translation_key").startswith("/")) if len(names) > 1 else folded.where(F.lit(False))
        pool = alone.select(F.col("translation_key").alias("key"), "section", locale.alias("locale"), "slug", "title").join(held, "key", "left").withColumn("media", F.coalesce("media", F.array().cast("array<string>")))
        pairs = stage.write(pairing.match(pairing.candidates(pool, cfg.pairing.fallback, hreflang.alternates(declared))))
        moved = redirects.redirect_map(pages)
        out = {
            "pages": pages,
            "folded": folded,
            "uses": uses,
            "missing_images": missing,
            "path_issues": gated.where("issue is not null").select(F.lit("error").alias("severity"), F.col("rel_path").alias("page"), "issue"),
            "content_inventory": inventory.content_inventory(folded, up.locales, pairing.both_ways(pairs)),
            "hreflang_map": declared,
            "pairs": pairs,
            "media_manifest": inventory.media_manifest(uses, media_files),
            "redirect_map": moved,
            "redirect_rules": redirects.rules(moved),
            "need_fetch": pages.select(F.explode("need_fetch").alias("url")).distinct(),
        }
        for name, df in out.items():
            df.createOrReplaceTempView(name)
        return out

    def _media(self, media_dir: str, out: str, stage: Stage) -> tuple[DataFrame, DataFrame]:
        """Media with their hashes, and the cache that they were read from; only changed files are read."""
        spark = self.spark
        empty = spark.createDataFrame([], media.CACHE)
        if not os.path.isdir(media_dir):
            return empty, empty
        cache = media.read_cache(spark, f"{out}/{CACHE_FILE}") if os.path.exists(f"{out}/{CACHE_FILE}") else empty
        listed = stage.write(files.listing(spark, media_dir))
        changed = media.changed(listed, cache)
        # Names of changed files are sought among all; the content column is read for the rows that are left.
        read = files.scan(spark, media_dir, "*").select(F.col("rel_path").alias("media"), "content").join(changed.select("media"), "media", "left_semi")
        fresh = changed.join(read.select("media", F.sha1("content").alias("sha1")), "media")
        return stage.write(media.unchanged(listed, cache).unionByName(fresh.select("media", "bytes", "modified", "sha1"))), cache

    def extract(self, raw: str, media_dir: str, out: str, dry_run: bool = False) -> ExtractReport:
        stage = Stage(self.spark)
        try:
            return self._extract(raw, media_dir, out, dry_run, stage)
        finally:
            stage.close()

    def _extract(self, raw: str, media_dir: str, out: str, dry_run: bool, stage: Stage) -> ExtractReport:
        spark, cfg = self.spark, self.config
        mirror = files.decode(files.scan(spark, raw).select("rel_path", "content"), cfg.site.encoding)
        found, cache = self._media(media_dir, out, stage)
        t = self.tables(mirror, found.select("media", "bytes", "sha1"), stage)
        long = t["pages"].select(F.col("md_path").alias("page"), length_issue(F.concat(F.lit(out.rstrip("/") + "/"), F.col("md_path"))).alias("issue")).where("issue is not null")
        issues = stage.write(t["path_issues"].unionByName(long.select(F.lit("warning").alias("severity"), "page", "issue")))
        stale = []
        if os.path.isdir(f"{out}/content"):
            on_disk = files.listing(spark, f"{out}/content", "*.md").select(F.concat(F.lit("content/"), "media").alias("md_path"))
            stale = sorted(r[0] for r in verify.stale(on_disk, t["pages"]).toLocalIterator())
        counts = {r[0]: r[1] for r in issues.groupBy("severity").count().collect()}
        pages = t["pages"].agg(F.count("*").alias("n"), F.coalesce(F.sum("image_count"), F.lit(0)).alias("images")).first()
        declared = t["hreflang_map"].agg(F.count("*"), F.count_if("usable")).first()
        locales = cfg.url_pattern.locales
        report = ExtractReport(
            pages=pages.n,
            translation_keys=t["folded"].count(),
            suggested_pairs=t["pairs"].count(),
            missing_images=t["missing_images"].count(),
            need_fetch=t["need_fetch"].count(),
            declared=declared[0],
            usable=declared[1],
            hreflang_in_fallback="hreflang" in cfg.pairing.fallback,
            images=pages.images,
            types={r[0]: r[1] for r in t["folded"].groupBy("page_type").count().collect()},
            flags={r.flag: r.n for r in inventory.flag_counts(t["folded"]).collect()},
            single_locale={r.locale: r.n for r in inventory.single_locale_counts(t["folded"], locales).collect()},
            path_errors=counts.get("error", 0),
            path_warnings=counts.get("warning", 0),
            stale=stale,
        )
        if not dry_run:
            self._write(t, issues, out)
            same = found.join(cache, found.columns, "left_semi").count()
            if same != found.count() or same != cache.count():
                media.write_cache(found, f"{out}/{CACHE_FILE}")
        return report

    def _write(self, t: dict[str, DataFrame], issues: DataFrame, out: str) -> None:
        shown = t["uses"].groupBy("rel_path").agg(F.array_sort(F.collect_list(F.struct("pos", "web", "alt"))).alias("shown"))

        def write_pages(rows):
            for row in rows:
                r = row.asDict(recursive=True)
                files.write_text(f"{out}/{r['md_path']}", frontmatter.page(r, r["shown"] or []))

        t["pages"].join(shown, "rel_path", "left").foreachPartition(write_pages)  # by the executors, to the site's shared disk
        flag = lambda c: F.when(F.col(c), "True").otherwise("False").alias(c)
        inv = t["content_inventory"]
        files.write_csv(inv.select(*[flag(c) if c.startswith("has_") else F.col(c) for c in inv.columns]), f"{out}/content_inventory.csv", ["translation_key"])
        h = t["hreflang_map"].drop("source_key")
        files.write_csv(h.select(*[flag(c) if c in ("in_mirror", "reciprocal", "usable") else F.col(c) for c in h.columns]), f"{out}/hreflang_map.csv", ["source_url", "hreflang", "target_url"])
        m = t["media_manifest"].select(F.concat(F.lit("media/"), F.col("media")).alias("local_path"), "original_url", "referenced_by", "alt", F.coalesce("sha1", F.lit("")).alias("sha1"), F.coalesce(F.col("bytes").cast("string"), F.lit("")).alias("bytes"))
        files.write_csv(m, f"{out}/media_manifest.csv", ["local_path"])
        moved = redirects.redirect_map(t["pages"])
        files.write_csv(redirects.redirect_map(t["pages"], "rel_path"), f"{out}/redirect_map.csv", ["rel_path"], moved.columns)
        files.write_csv(issues, f"{out}/path_issues.csv", ["severity", "page"])
        gone = t["missing_images"].orderBy("rel_path", "pos").select("source_page", "missing_image")
        files.write_text(f"{out}/missing_images.csv", files.csv_text(gone.columns, gone.toLocalIterator()))
        for name, (file, _) in redirects.exporters().items():
            rows = t["redirect_rules"].orderBy("old").select(name).toLocalIterator()
            files.write_text(f"{out}/{file}", "".join(r[0] + "\n" for r in rows))
        files.write_text(f"{out}/need_fetch_media.txt", "\n".join(r[0] for r in t["need_fetch"].orderBy("url").toLocalIterator()))

    def verify(self, out: str, media_dir: str | None = None, prefix: str = "/media/", allow: list[str] = ()) -> DataFrame:
        """``severity, page, kind, detail``, sorted, also written as ``verify_report.csv``."""
        spark = self.spark
        if not os.path.isdir(f"{out}/content"):
            return spark.createDataFrame([("error", "", "no_content", "no content directory")], "severity string, page string, kind string, detail string")
        rows = files.decode(files.scan(spark, f"{out}/content", "*.md").select("rel_path", "content")).select(F.col("rel_path").alias("page"), F.col("html").alias("content"))

        rows = verify.split_frontmatter(rows)

        def read(batches):
            for batch in batches:
                parsed = [frontmatter.parse(y) if y is not None else None for y in batch["yaml"]]
                fields = [None if p is None else {k: v for k, v in p.items() if isinstance(v, str)} for p in parsed]
                yield pd.DataFrame({"page": batch["page"], "content": batch["content"], "fields": fields, "images": [frontmatter.local_images(p) for p in parsed]})

        rows = rows.select("page", "content", "yaml").mapInPandas(read, "page string, content string, fields map<string,string>, images array<string>")
        found = files.listing(spark, media_dir) if media_dir and os.path.isdir(media_dir) else None
        missing = f"{out}/missing_images.csv"
        known = [r[1:2] for r in files.read_csv(open(missing, encoding="utf-8").read())[1:] if len(r) > 1] if os.path.exists(missing) else []
        allowed = spark.createDataFrame([(a,) for a in allow], "allow string")
        report = verify.report(rows, found, spark.createDataFrame(known, "missing_image string"), allowed, prefix)
        files.write_csv(report, f"{out}/verify_report.csv", ["severity", "page", "detail"])
        return report.orderBy("severity", "page", "detail")

    def probe_orphans(self, raw: str, section: str, years: tuple[int, int], lang: str | None = None, client: Client | None = None, say=lambda text: None) -> list[str]:
        """Slugs of dates that no page links but that the site has, in the order asked."""
        cfg = self.config
        lang = lang or next(iter(cfg.url_pattern.lang_map))
        known = self.mirror_slugs(raw, section, lang) or []
        known = self.spark.createDataFrame([(k,) for k in known], "slug string")
        asked = orphans.date_candidates(self.spark, *years).join(known, "slug", "left_anti").orderBy("day", "form").select("slug")
        extension = cfg.url_pattern.strip_extensions[0] if cfg.url_pattern.strip_extensions else ""
        prefix = f"{cfg.site.base_url.rstrip('/')}/{lang}/{orphans.safe_segment(section)}/"
        return orphans.probe(client or Client(cfg.site), (r[0] for r in asked.toLocalIterator()), prefix, extension, say)

    def fetch_orphans(self, raw: str, media_dir: str, section: str, slugs: list[str], client: Client | None = None, say=lambda text: None) -> dict:
        return orphans.fetch(client or Client(self.config.site, follow=True), slugs, section, raw, media_dir, self.config, say)

    def thumbnails(self, media_dir: str, out: str) -> tuple[DataFrame, DataFrame]:
        """The plan of thumbnails that are not in ``out`` yet, and ``media, error`` of each as made by the executors;
        without Pillow nothing can be made, and the error says so."""
        spark, own = self.spark, self.config.media.thumbnails or Thumbnails()
        every = files.scan(spark, media_dir, "*").select(F.col("rel_path").alias("media"), "content")
        made = files.listing(spark, out) if os.path.isdir(out) else spark.createDataFrame([], "media string")
        images = media.images_only(every)
        plan = media.thumbnail_plan(images, made, own.max_width)
        return plan, media.make_thumbnails(plan.join(images, "media"), out, own.quality)

    def mirror_slugs(self, raw: str, section: str, lang: str | None = None) -> list[str] | None:
        """Sorted slugs of a section; None if no language, or not that of the prefix ``lang``, has such a folder."""
        prefixes = list(self.config.url_pattern.lang_map) if lang is None else [lang]
        if not any(os.path.isdir(os.path.join(raw, p, orphans.safe_segment(section))) for p in (prefixes if lang is not None else ("", *prefixes))):
            return None
        rows = orphans.mirror_slugs(files.scan(self.spark, raw).select("rel_path"), section, prefixes)
        rows = rows if lang is None else rows.where(F.col("lang_prefix") == lang)
        return [r[0] for r in rows.select("slug").distinct().orderBy("slug").toLocalIterator()]
