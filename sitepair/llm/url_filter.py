"""Operator 2, URL filter: rules, and block decisions carried over redirects and canonical links.

A rule names a host suffix and a path prefix; the longest fitting rule decides. Where none fits, the
address takes the decision of its redirect class: connected components over redirect and canonical
edges, blocked if any address in it is blocked by a rule. An explicit allow on the address itself
stands. All of it is DataFrame expressions.

An address is host, path and query; ``.`` and ``..`` are resolved in its path, and an empty path is ``/``.
A page's edges are its canonical links and meta refreshes outside of comments, scripts and styles. Their
targets may be relative, and the entities of ``&``, ``<``, ``>`` and both quotes are decoded in them;
targets of other schemes (``mailto:``) and mere fragments make no edge.

Null or malformed urls have an empty host and path, fit no rule and are allowed. Repeated rows are
judged alike. Null html declares no edge, nor does a tag without a target; other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)"
CANONICAL = r"""(?is)(<link\b[^>]*[\s"']rel\s*=\s*["']?\s*canonical\b[^>]*>)"""
REFRESH = r"""(?is)(<meta\b[^>]*[\s"']http-equiv\s*=\s*["']?\s*refresh\b[^>]*>)"""
MOVED = r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)"""
#: Fixed values of HTML, decoded in this order.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#38;", "&"), ("&amp;", "&"))
#: Fixed values: (verdict, host, path prefix).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_of(url):
    return F.translate(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path_of(url):
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def resolved(path):
    """``path`` without ``.`` and ``..`` segments; empty, it is ``/``."""
    fold = F.aggregate(
        F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/"))),
        F.array(F.lit("")),
        lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))),
    )
    out = F.concat(F.array_join(fold, "/"), F.when(path.rlike(r"/\.\.?\z"), "/").otherwise(""))
    out = F.when(path.contains("/."), out).otherwise(path)
    return F.when(out == "", "/").otherwise(out)


def address_of(url):
    """What names a resource: host, path and query, without scheme and fragment; null where there is no host."""
    address = F.concat(host_of(url), resolved(path_of(url)), F.regexp_extract(url, ADDRESS, 3))
    return F.when(host_of(url) != "", address)


def rule_struct(host, path, rules=RULES):
    """The longest fitting rule as struct(rule, verdict), compiled to one CASE; null if none fits."""
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _attribute(tag, name: str):
    """An attribute's value: quoted either way, or bare."""
    value = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, value, i) for i in (1, 2, 3)])


def target(url, to):
    """The absolute form of the link ``to`` of a page at ``url``; null if it leads nowhere else."""
    for entity, character in ENTITIES:
        to = F.replace(to, F.lit(entity), F.lit(character))
    to = F.trim(F.translate(to, "\t\r\n", "   "))
    root = F.concat(F.lit("http://"), host_of(url))
    folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path_of(url), "^/", ""), "[^/]*\\z", ""))
    return (
        F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when((to == "") | to.startswith("#") | to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.startswith("/"), F.concat(root, to))
        .when(to.startswith("?"), F.concat(root, path_of(url), to))
        .otherwise(F.concat(root, folder, to))
    )


def html_edges(pages: DataFrame) -> DataFrame:
    """``u, v``: addresses that a page's canonical links and meta refreshes tie to its own."""
    shown = F.regexp_replace("html", HIDDEN, " ")
    tags = F.concat(F.regexp_extract_all(shown, F.lit(CANONICAL), 1), F.regexp_extract_all(shown, F.lit(REFRESH), 1))
    tags = pages.where(F.lower("html").rlike("canonical|refresh")).select("url", F.explode(tags).alias("tag"))
    moved = F.regexp_extract(_attribute(F.col("tag"), "content"), MOVED, 1)
    to = F.when(F.lower(F.substring("tag", 1, 5)) == "<link", _attribute(F.col("tag"), "href")).otherwise(moved)
    tags = tags.select("url", to.alias("to"))
    return tags.select(address_of(F.col("url")).alias("u"), address_of(target(F.col("url"), F.col("to"))).alias("v")).where("u is not null and v is not null")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, via`` for each row of ``pages(page_id, url, html)``.

    ``redirects(source_url, target_url)`` adds edges to those declared in the html. ``via`` is
    ``rule``, ``redirect_class`` or ``default``.
    """
    scratch = Scratch(pages.sparkSession)
    url = F.col("url")
    edges = html_edges(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.union(redirects.select(address_of(F.col("source_url")).alias("u"), address_of(F.col("target_url")).alias("v")).where("u is not null and v is not null"))
    classes = components(edges, scratch)
    base = pages.select("page_id", address_of(url).alias("address"), host_of(url).alias("host"), path_of(url).alias("path"))
    base = base.withColumn("hit", rule_struct(F.col("host"), F.col("path"), rules))
    if classes.isEmpty():
        scratch.close()
        found = base.withColumn("blocked", F.lit(False))
    else:
        node = F.concat(F.lit("x://"), F.col("node"))
        judged = classes.withColumn("hit", rule_struct(host_of(node), path_of(node), rules))
        bad = judged.where("hit.verdict = 'block'").select("label").distinct()
        aliases = scratch.write(classes.join(bad, "label").select(F.col("node").alias("address")), "blocked")
        scratch.close(aliases)
        found = base.join(aliases.withColumn("blocked", F.lit(True)), "address", "left")
    blocked = F.coalesce("blocked", F.lit(False))
    return found.select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("hit").isNotNull(), "rule").when(blocked, "redirect_class").otherwise("default").alias("via"),
    )
