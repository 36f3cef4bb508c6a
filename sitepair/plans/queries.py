"""The registered queries of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import length_issue, path_issue
from ..functions.routing import depth, media_relative, normalize_route, normalize_ws, web_path
from ..functions.scalars import csv_guard, normalize_slug, slug_date, strip_date_prefix, yaml_needs_quoting
from ..operators import hreflang, inventory, orphans, pairing, redirects, verify
from . import inputs
from .extract import extract_pages as extract

#: Paths that a mirror may hold and a file system not.
BAD_PATHS = ("content/con.md", "content/console.md", "content/COM1/a.md", "content/a:b.md", "content/what?.md", "content/a|b.md", "content/end..md", "content/dot./a.md", "content/sp /a.md", "content/新聞.md", "content/nul", "content//a.md")
SCALARS = ("20260712", "-42", "3.14", "1_000", "no", "Off", "null", "2024-01-18", "2024-1-8", "19:30", "0x1F", "0o17", ".inf", ".5", "plain", "2026_cjgx", "=1+1", "+1+2", "-2+3", "@SUM(A1)", "a=b", "", "~", "1.", "12:99")
MEDIA_URLS = ("https://x.example/images/a%20b.jpg", "https://x.example/", "https://x.example/a/../b.jpg", "https://x.example/%2e%2e/b.jpg", "https://x.example/a+b.png?v=2", "https://x.example/a/%2E/c.png", "https://x.example/d%5C..%5Ce.png", "https://x.example/ok/f(1)!.jpg")


def _values(spark, name: str, values) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def page_identity(spark, sf_dir):
    return inputs.pages(spark, sf_dir).select("page_id", "rel_path", "lang_prefix", "locale", "section", "slug", "source_url", "translation_key", "md_path", "page_type")


def page_routes(spark, sf_dir):
    return inputs.pages(spark, sf_dir).select("page_id", "route", normalize_route(F.col("route")).alias("normal"), depth(F.col("route")).cast("long").alias("depth"))


def _inventory(spark, sf_dir, config):
    locales = config.url_pattern.locales
    return inventory.content_inventory(inventory.fold(inputs.versions(spark, sf_dir, config), locales, ("rel_path", "page_id")), locales)


def content_inventory(spark, sf_dir):
    return _inventory(spark, sf_dir, inputs.CONFIG)


def content_inventory_two_locales(spark, sf_dir):
    return _inventory(spark, sf_dir, inputs.TWO_LOCALES)


def inventory_status_counts(spark, sf_dir):
    return content_inventory(spark, sf_dir).groupBy("suggested_type", "flags", "pair_status").agg(F.count("*").alias("n"), F.max("image_count").alias("max_images"))


def single_locale_counts(spark, sf_dir):
    locales = inputs.CONFIG.url_pattern.locales
    return inventory.single_locale_counts(inventory.fold(inputs.versions(spark, sf_dir), locales, ("rel_path", "page_id")), locales)


def path_safety(spark, sf_dir):
    paths = inputs.pages(spark, sf_dir).select("md_path").union(_values(spark, "md_path", BAD_PATHS))
    long = F.concat(F.repeat(F.lit("x"), 250), F.lit("/"), F.col("md_path"))
    return paths.distinct().select("md_path", path_issue(F.col("md_path")).alias("issue"), length_issue(long).alias("length_issue"))


def path_collisions(spark, sf_dir):
    rows = inventory.gate(inputs.pages(spark, sf_dir).withColumn("md_path", F.expr("if(page_id % 3 = 0, upper(md_path), md_path)")), ("rel_path", "page_id"))
    return rows.where("issue is not null").select("page_id", "md_path", "issue")


def redirect_map(spark, sf_dir):
    return redirects.redirect_map(inputs.safe_pages(spark, sf_dir))


def redirect_rules(spark, sf_dir):
    return redirects.rules(redirects.redirect_map(inputs.safe_pages(spark, sf_dir)))


def page_titles(spark, sf_dir):
    raw = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    dated = F.expr("concat(case page_id % 4 when 0 then '2025/02/02 News: ' when 1 then 'News 02/02/2025:' when 2 then '02-02-2025新聞:' else '' end, t)")
    rows = inputs.table(spark, sf_dir, "pages").select("page_id", raw.alias("t")).select("page_id", dated.alias("raw"))
    return rows.select("page_id", normalize_ws(F.col("raw")).alias("raw_title"), strip_date_prefix(normalize_ws(F.col("raw")), ["新聞", "News"]).alias("title"))


def _links(spark, sf_dir):
    return inputs.table(spark, sf_dir, "pages").select("page_id", F.explode(verify.body_refs(F.col("html"))).alias("ref"))


def internal_links(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct(normalize_route(F.col("ref"))).alias("n_routes"))


def broken_links(spark, sf_dir):
    routes = inputs.safe_pages(spark, sf_dir).select(normalize_route(F.col("route")).alias("route"))
    known = inputs.safe_pages(spark, sf_dir).select("page_id", F.concat("route", F.lit("?a=1#b")).alias("ref"))
    return verify.broken_links(_links(spark, sf_dir).union(known), routes).select("page_id", "ref", "route")


def _graph(spark, sf_dir):
    """Synthetic: page p of n links to page (13p + 5) mod n."""
    own = inputs.safe_pages(spark, sf_dir).select("page_id", F.col("md_path").alias("page"), normalize_route(F.col("route")).alias("route"), "page_type", "slug")
    count = inputs.table(spark, sf_dir, "pages").agg(F.count("*").alias("n"))
    ends = own.crossJoin(F.broadcast(count)).select(F.col("route").alias("self_route"), F.expr("(13 * page_id + 5) % n").alias("page_id"))  # a one-row table
    return own, ends.join(own.select("page_id", "route"), "page_id").select("self_route", "route")


def unlinked_pages(spark, sf_dir):
    own, links = _graph(spark, sf_dir)
    own = own.withColumn("is_index", F.col("slug") == "index")
    allowed = own.where("page_id % 17 = 0").select(F.col("page").alias("allow"))
    return verify.unlinked(own, links, allowed).select("page", "route")


def hreflang_map(spark, sf_dir):
    routes = inventory.route_keys(inputs.safe_pages(spark, sf_dir), ("rel_path", "page_id"))
    return hreflang.validate(inputs.declarations(spark, sf_dir), routes)


def hreflang_reject_counts(spark, sf_dir):
    return hreflang.reject_counts(hreflang_map(spark, sf_dir))


def hreflang_alternates(spark, sf_dir):
    return hreflang.alternates(hreflang_map(spark, sf_dir))


def slug_dates(spark, sf_dir):
    return inputs.order_slugs(spark, sf_dir).select("o_orderkey", "slug", slug_date(F.col("slug")).alias("day"))


def pairs_by_date(spark, sf_dir):
    pool = inputs.order_slugs(spark, sf_dir).select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("key"), "section", "locale", "slug")
    return pairing.by_date(pool)


def pairs_by_slug(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("key"), F.col("p_type").alias("section"), F.expr("if(p_partkey % 2 = 0, 'en', 'fr')").alias("locale"), F.concat_ws("-", F.upper("p_brand"), F.expr("cast(p_size as string)")).alias("slug"))
    return pairing.by_slug(rows)


def shared_media(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("m"), F.col("l_partkey").cast("string"))).alias("media"))
    pool = rows.select(F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("key"), F.expr("cast(l_orderkey % 20 as string)").alias("section"), F.expr("if(l_orderkey div 20 % 2 = 0, 'en', 'fr')").alias("locale"), "media")
    return pairing.by_media(pool)


def media_manifest(spark, sf_dir):
    files = inputs.table(spark, sf_dir, "part").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("media"), F.sha1(F.col("p_name").cast("binary")).alias("sha1"), F.octet_length("p_name").cast("long").alias("bytes"))
    return inventory.media_manifest(inputs.media_uses(spark, sf_dir), files).select("media", "original_url", "referenced_by", "alt", F.coalesce("sha1", F.lit("")).alias("sha1"), F.coalesce(F.col("bytes").cast("string"), F.lit("")).alias("bytes"))


def title_similarity(spark, sf_dir):
    return pairing.by_title(inputs.title_pool(spark, sf_dir))


FALLBACK = ["hreflang", "slug_normalized", "shared_media", "date", "title_similarity"]


def _declared(spark, sf_dir):
    """Synthetic: every ninth document declares the one before it."""
    key = lambda c: F.concat(F.lit("k"), F.lpad(c.cast("string"), 9, "0"))
    rows = inputs.table(spark, sf_dir, "documents").where("doc_id % 9 = 4")
    return rows.select(key(F.col("doc_id")).alias("a"), key(F.col("doc_id") - 1).alias("b"), F.col("lang").alias("token"))


def pair_candidates(spark, sf_dir):
    return pairing.candidates(inputs.title_pool(spark, sf_dir), FALLBACK, _declared(spark, sf_dir))


def pair_suggestions(spark, sf_dir):
    return pairing.match(pair_candidates(spark, sf_dir))


def date_candidates(spark, sf_dir):
    return orphans.date_candidates(spark, 2024, 2025)


def _responses(orders):
    """Synthetic: an order's date answers on the status of the order; every seventh needs a second attempt."""
    slug = F.expr("concat(date_format(o_orderdate, 'yyyyMMdd'), case o_orderkey % 9 when 0 then '' when 3 then 'A' else 'B' end)")
    rows = orders.groupBy(slug.alias("slug")).agg(F.min("o_orderkey").alias("k"), F.min("o_orderstatus").alias("s"))
    url = F.concat(F.lit("https://site.example/en/news/"), F.col("slug"), F.lit(".php"))
    status = F.expr("if(s = 'F', 200, if(s = 'O', 404, 200))")
    first = rows.select(url.alias("url"), F.lit(1).alias("attempt"), F.when(F.col("k") % 7 == 0, F.when(F.col("k") % 2 == 0, 409)).otherwise(status).alias("status"))
    return first.union(rows.where("k % 7 = 0").select(url, F.lit(2), status))


def _orphan_hits(spark, sf_dir, answering):
    known = inputs.table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.date_format("o_orderdate", "yyyyMMdd").alias("slug"))
    return orphans.hits(orphans.date_candidates(spark, 1990, 2000), known, _responses(answering), "https://site.example/en/news/", ".php")


def orphan_hits(spark, sf_dir):
    """Only the orders whose key is a multiple of 3 answer; in ``orphan_hits_all_orders`` all do."""
    return _orphan_hits(spark, sf_dir, inputs.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0"))


def orphan_hits_all_orders(spark, sf_dir):
    return _orphan_hits(spark, sf_dir, inputs.table(spark, sf_dir, "orders"))


def fetch_plan(spark, sf_dir):
    own = inputs.safe_pages(spark, sf_dir)
    return orphans.fetch_plan(own.select("slug"), ["en", "fr", "de", "es"], own.select("lang_prefix", "slug"))


def mirror_slugs(spark, sf_dir):
    rows = inputs.versions(spark, sf_dir).select("rel_path")
    return orphans.mirror_slugs(rows, "s1", ["en", "fr", "de", "es"])


def stale_outputs(spark, sf_dir):
    own = inputs.safe_pages(spark, sf_dir)
    return verify.stale(own, own.where("page_id % 5 <> 0"))


def _csv_values(spark, sf_dir, text):
    rows = inputs.table(spark, sf_dir, "documents").select(F.concat(F.expr("case doc_id % 5 when 0 then '=' when 1 then '-' else '' end"), text).alias("value"))
    rows = rows.union(_values(spark, "value", SCALARS)).distinct()
    return rows.select("value", csv_guard(F.col("value")).alias("guarded"))


def csv_fields(spark, sf_dir):
    """Guards of the first line of each text, as fields of one line; ``csv_texts`` takes whole texts."""
    return _csv_values(spark, sf_dir, F.substring_index("text", "\n", 1))


def csv_texts(spark, sf_dir):
    """Guards of whole texts, all lines."""
    return _csv_values(spark, sf_dir, F.col("text"))


def yaml_quoting(spark, sf_dir):
    rows = _values(spark, "value", SCALARS).union(inputs.table(spark, sf_dir, "part").select("p_name")).union(inputs.order_slugs(spark, sf_dir).select("slug")).distinct()
    return rows.select("value", yaml_needs_quoting(F.col("value")).alias("quoted"), normalize_slug(F.col("value")).alias("folded"))


def media_paths(spark, sf_dir):
    rows = _values(spark, "url", MEDIA_URLS)
    return rows.select("url", media_relative(F.col("url")).alias("rel"), web_path(media_relative(F.col("url")), "/media/").alias("web"))


def extract_pages(spark, sf_dir):
    rows = extract(inputs.safe_pages(spark, sf_dir), inputs.CONFIG)
    return rows.select("page_id", "md_path", "title", "text_length", "image_count", "flags", "body")


def verify_report(spark, sf_dir):
    """The audit of pages that the extraction writes."""
    rows = extract(inputs.safe_pages(spark, sf_dir), inputs.CONFIG)
    fields = F.create_map(*[x for f in ("source_url", "slug", "translation_key", "title", "page_type") for x in (F.lit(f), F.col(f))], F.lit("lang"), F.col("locale"))
    content = F.concat(F.lit("---\ntitle: x\n---\n"), F.col("body"), F.lit("\n"))
    out = rows.select(F.regexp_replace("md_path", "^content/", "").alias("page"), content.alias("content"), fields.alias("fields"), F.array().cast("array<string>").alias("images"))
    return verify.report(out, None, _values(spark, "missing_image", ()))


def _audited(spark, sf_dir):
    """Synthetic: html as the body of pages, of which some lack their block, its end, a field or readable fields, and
    all name one of seven files; four are there, one is known to be missing."""
    rows = inputs.safe_pages(spark, sf_dir).withColumn("_d", F.expr("page_id % 10"))
    body = F.concat("html", F.expr("concat('\n<img src=\"/media/p', page_id % 7, '.jpg\">')"))
    content = F.when(F.col("_d") == 0, body).when(F.col("_d") == 1, F.concat(F.lit("---\ntitle: x\n"), body)).otherwise(F.concat(F.lit("---\ntitle: x\n---\n"), body))
    title = F.when(F.col("_d") != 2, "x").otherwise("")
    fields = F.create_map(*[x for f in ("source_url", "slug", "translation_key", "page_type") for x in (F.lit(f), F.col(f))], F.lit("lang"), F.col("locale"), F.lit("title"), title)
    pages = rows.select(F.regexp_replace("md_path", "^content/", "").alias("page"), content.alias("content"), F.when(F.col("_d") != 3, fields).alias("fields"), F.array().cast("array<string>").alias("images"))
    return pages, _values(spark, "media", [f"p{i}.jpg" for i in range(4)]), _values(spark, "missing_image", ["/media/p4.jpg"])


def verify_audit(spark, sf_dir):
    return verify.report(*_audited(spark, sf_dir))


def verify_counters(spark, sf_dir):
    pages, files, _ = _audited(spark, sf_dir)
    return verify.counters(pages, verify_audit(spark, sf_dir), files)


def flag_counts(spark, sf_dir):
    locales = inputs.CONFIG.url_pattern.locales
    return inventory.flag_counts(inventory.fold(inputs.versions(spark, sf_dir), locales, ("rel_path", "page_id")))


def queries() -> dict:
    own = (verify_audit, verify_counters, flag_counts, content_inventory, content_inventory_two_locales, page_identity, page_routes, inventory_status_counts, single_locale_counts, path_safety, path_collisions, redirect_map, redirect_rules, page_titles, internal_links, broken_links, unlinked_pages, hreflang_map, hreflang_reject_counts, hreflang_alternates, slug_dates, pairs_by_date, pairs_by_slug, shared_media, media_manifest, title_similarity, pair_candidates, pair_suggestions, date_candidates, orphan_hits, orphan_hits_all_orders, fetch_plan, mirror_slugs, stale_outputs, csv_fields, csv_texts, yaml_quoting, media_paths, extract_pages, verify_report)
    return {f.__name__: f for f in own}


