"""Routes and links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def route_for_path(path: Column, extensions: list[str]) -> Column:
    """``/``, ``/one/`` or ``/a/b``: without the first extension that fits, empty segments and a last ``index``."""
    bare = F.when(F.lit(False), path)
    for e in extensions:
        bare = bare.when(path.endswith(e), F.substring(path, F.lit(1), F.length(path) - len(e)))
    parts = F.filter(F.split(bare.otherwise(path), "/"), lambda s: s != "")
    parts = F.when(F.element_at(F.concat(F.array(F.lit("")), parts), -1) == "index", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    joined = F.concat(F.lit("/"), F.array_join(parts, "/"))
    return F.when(F.size(parts) == 1, F.concat(joined, F.lit("/"))).otherwise(joined)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def route_for_url(url: Column, host: str, extensions: list[str]) -> Column:
    """Null for another host."""
    return F.when(url_host(url) == host.lower(), route_for_path(url_path(url), extensions))


def unescape(text: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone; null where the escapes are broken."""
    return F.try_url_decode(F.regexp_replace(text, r"\+", "%2B"))


def media_relative(url: Column) -> Column:
    """The file below the media folder; null for the root and for paths that would leave the folder."""
    rel = F.regexp_replace(unescape(url_path(url)), "^/+", "")
    unsafe = F.exists(F.split(F.regexp_replace(rel, r"\\", "/"), "/"), lambda s: s.isin(".", ".."))
    return F.when((rel != "") & ~unsafe, rel)


def web_path(rel: Column, prefix: str) -> Column:
    def encode(s: Column) -> Column:
        return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    return F.concat(F.lit(prefix), F.array_join(F.transform(F.split(rel, "/"), encode), "/"))


def normalize_route(link: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(link, r"(?s)[#?].*$", ""), "/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def markdown_route(md_path: Column) -> Column:
    """The route that a page of the output has."""
    rel = F.regexp_replace(md_path, r"\.md$", "")
    return normalize_route(F.when(rel == "index", "/").otherwise(F.concat(F.lit("/"), F.regexp_replace(rel, "/index$", ""))))


def depth(route: Column) -> Column:
    return F.when(route == "/", 0).otherwise(F.length(route) - F.length(F.replace(route, F.lit("/"), F.lit(""))))


def normalize_ws(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")
