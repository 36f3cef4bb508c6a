"""Audit of written pages: frontmatter, links, media, pages that nothing links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.routing import depth, markdown_route, normalize_route, unescape

#: Fields that a page must have.
REQUIRED = ("source_url", "lang", "slug", "translation_key", "title", "page_type")
UNLINKED = "not linked from any content page (menus are not checked)"


def split_frontmatter(pages: DataFrame) -> DataFrame:
    """Adds ``yaml`` and ``body`` to ``page, content``; null where there is no block."""
    text = F.regexp_replace("content", "\r", "")
    end = F.locate("\n---\n", F.col("_t"), 5)
    ok = F.col("_t").startswith("---\n") & (F.col("_e") > 0)
    rows = pages.withColumn("_t", text).withColumn("_e", end)
    return rows.withColumn("yaml", F.when(ok, F.expr("substring(_t, 5, _e - 4)"))).withColumn("body", F.when(ok, F.expr("substring(_t, _e + 5)"))).drop("_t", "_e")


def body_refs(body):
    """Targets within the site, in order: of Markdown links, then of ``href`` and ``src``."""
    links = F.regexp_extract_all(body, F.lit(r"\]\(([^)\s]+)\)"), 1)
    double = F.regexp_extract_all(body, F.lit(r'(?i)(?:href|src)\s*=\s*"([^"]*)"'), 1)
    single = F.regexp_extract_all(body, F.lit(r"(?i)(?:href|src)\s*=\s*'([^']*)'"), 1)
    return F.filter(F.concat(links, double, single), lambda r: r.rlike("^/(?!/)"))


def resolve(refs: DataFrame, routes: DataFrame) -> DataFrame:
    """Adds ``route`` and ``found`` to each ``ref``: as it stands, else percent-decoded, else as it stands."""
    known = routes.select("route").distinct()
    rows = refs.withColumn("_r", normalize_route(F.col("ref"))).withColumn("_d", normalize_route(F.coalesce(unescape(F.col("ref")), F.col("ref"))))
    rows = rows.join(known.select(F.col("route").alias("_r"), F.lit(True).alias("_kr")), "_r", "left")
    rows = rows.join(known.select(F.col("route").alias("_d"), F.lit(True).alias("_kd")), "_d", "left")
    decoded = F.col("_kr").isNull() & F.col("_kd").isNotNull()
    return rows.withColumn("route", F.when(decoded, F.col("_d")).otherwise(F.col("_r"))).withColumn("found", F.coalesce("_kr", "_kd", F.lit(False))).drop("_r", "_d", "_kr", "_kd")


def broken_links(refs: DataFrame, routes: DataFrame) -> DataFrame:
    return resolve(refs, routes).where("not found")


def unlinked(pages: DataFrame, links: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """``pages(page, route, page_type, is_index)`` that no other page's link ``(self_route, route)`` reaches."""
    reached = links.where("route <> self_route").select("route").distinct()
    exempt = (F.col("is_index") & (depth(F.col("route")) <= 1)) | (F.col("page_type") == "listing")
    out = pages.where(~exempt).join(reached, "route", "left_anti")
    if allowed is not None:
        out = out.join(allowed.select(F.col("allow").alias("page")), "page", "left_anti").join(allowed.select(F.col("allow").alias("route")), "route", "left_anti")
    return out


def media_issues(refs: DataFrame, files: DataFrame, known_missing: DataFrame, prefix: str = "/media/") -> DataFrame:
    """``page, ref`` below ``prefix`` whose file ``files(media)`` lacks, with severity and kind."""
    rows = refs.where(F.col("ref").startswith(prefix)).withColumn("clean", F.regexp_replace("ref", r"(?s)[#?].*$", ""))
    rows = rows.withColumn("media", F.coalesce(unescape(F.substring("clean", len(prefix) + 1, 1 << 30)), F.lit("")))
    rows = rows.join(files.select("media").distinct(), "media", "left_anti")
    rows = rows.join(known_missing.select(F.col("missing_image").alias("clean"), F.lit(True).alias("_k")).distinct(), "clean", "left")
    known = F.col("_k").isNotNull()
    return rows.select(F.when(known, "warning").otherwise("error").alias("severity"), "page", F.when(known, "known_missing_media").otherwise("missing_media").alias("kind"), F.col("ref").alias("detail"))


def report(pages: DataFrame, files: DataFrame | None, known_missing: DataFrame, allowed: DataFrame | None = None, prefix: str = "/media/") -> DataFrame:
    """``severity, page, kind, detail`` of ``pages(page, content, fields map, images array)``.

    ``fields`` is null where the frontmatter can't be read. Without ``files`` media aren't checked.
    """
    rows = split_frontmatter(pages).withColumn("self_route", markdown_route(F.col("page")))
    bad = F.col("yaml").isNull() | F.col("fields").isNull()
    invalid = rows.where(bad).select(F.lit("error").alias("severity"), "page", F.lit("invalid_frontmatter").alias("kind"), F.when(F.col("yaml").isNull(), "no frontmatter block").otherwise("unreadable").alias("detail"))
    good = rows.where(~bad)
    needed = F.explode(F.filter(F.array(*[F.lit(f) for f in REQUIRED]), lambda f: F.coalesce(F.element_at("fields", f), F.lit("")) == ""))
    missing = good.select(F.lit("error").alias("severity"), "page", F.lit("missing_field").alias("kind"), needed.alias("detail"))
    refs = good.select("page", "self_route", F.explode(F.concat(body_refs(F.col("body")), F.coalesce("images", F.array().cast("array<string>")))).alias("ref"))
    routes = rows.select(F.col("self_route").alias("route"))
    links = resolve(refs.where(~F.col("ref").startswith(prefix)), routes)
    broken = links.where("not found").select(F.lit("error").alias("severity"), "page", F.lit("broken_link").alias("kind"), F.col("ref").alias("detail"))
    own = good.select("page", F.col("self_route").alias("route"), F.coalesce(F.element_at("fields", F.lit("page_type")), F.lit("")).alias("page_type"), ((F.col("page") == "index.md") | F.col("page").endswith("/index.md")).alias("is_index"))
    alone = unlinked(own, links, allowed).select(F.lit("warning").alias("severity"), "page", F.lit("unlinked_page").alias("kind"), F.lit(UNLINKED).alias("detail"))
    out = invalid.unionByName(missing).unionByName(broken).unionByName(alone)
    return out if files is None else out.unionByName(media_issues(refs, files, known_missing, prefix))


def counters(pages: DataFrame, found: DataFrame, files: DataFrame | None, prefix: str = "/media/") -> DataFrame:
    """One row: errors and warnings of the report ``found``, pages, links and media references, repeated ones too, and
    whether media were left unchecked."""
    rows = split_frontmatter(pages).withColumn("_good", F.col("yaml").isNotNull() & F.col("fields").isNotNull())
    refs = F.when(F.col("_good"), F.concat(body_refs(F.col("body")), F.coalesce("images", F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))
    rows = rows.select(F.size(refs).alias("n"), F.size(F.filter(refs, lambda r: r.startswith(prefix))).alias("m"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    checked = rows.agg(F.count("*").alias("pages"), total(F.col("n") - F.col("m")).alias("links"), total(F.lit(0) if files is None else F.col("m")).alias("media_refs"))
    issues = found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return issues.crossJoin(F.broadcast(checked)).withColumn("media_skipped", F.lit(files is None))  # one row each


def stale(on_disk: DataFrame, written: DataFrame) -> DataFrame:
    """Paths on disk that the run didn't write; reported, never removed."""
    return on_disk.select("md_path").distinct().join(written.select("md_path"), "md_path", "left_anti")
