"""Extraction of one page: title, body, links, media. Pure functions of the html and the identity."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote, urljoin, urlsplit, urlunsplit

from ..sources.config import SiteConfig
from . import html as dom
from .scalars import title_prefixes

#: Links that are left as they are.
PASS = ("http://", "https://", "#", "mailto:", "tel:", "//", "javascript:")
#: What may stand between a title and a site's name, and the markup of embedded media.
EDGE = " \t\r\n-–—|:：·,，"
VIDEO = '<div style="position:relative;padding-bottom:56.25%;height:0;margin:18px 0;border-radius:8px;overflow:hidden;background:#000;">{}</div>'
FILL = "position:absolute;top:0;left:0;width:100%;height:100%;"
YOUTUBE = f'<iframe src="{{}}" title="video" loading="lazy" style="{FILL}border:0;" allow="accelerometer; autoplay; clipboard-write; encrypted-media; gyroscope; picture-in-picture" allowfullscreen></iframe>'
LOCAL = f'<video controls preload="metadata" src="{{}}" style="{FILL}background:#000;"></video>'
PDF = '<div style="margin:18px 0;text-align:center;"><iframe src="{0}" title="PDF" loading="lazy" style="width:100%;height:820px;border:1px solid #e5ddc8;border-radius:8px;"></iframe><p style="font-size:15px;margin:8px 0;"><a href="{0}" target="_blank" rel="noopener" style="color:#b56f13;">📄 {1}</a></p></div>'


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def resolve(base: str, ref: str) -> str | None:
    """Absolute, with lower-case host, no default port and percent-encoded path; None if it makes no URL."""
    try:
        parts = urlsplit(urljoin(base, ref.strip()))
        port = parts.port
    except ValueError:
        return None
    if not parts.scheme or not (parts.netloc or parts.scheme not in ("http", "https")):
        return None
    host = parts.netloc.lower()
    if port == {"http": 80, "https": 443}.get(parts.scheme):
        host = host.rsplit(":", 1)[0]
    keep = "/%:@!$&'()*+,;=~-._"
    path = quote(parts.path, keep) or ("/" if host else "")
    return urlunsplit((parts.scheme, host, path, quote(parts.query, keep + "?"), quote(parts.fragment, keep + "?")))


def media_relative(url: str) -> str | None:
    rel = unquote(urlsplit(url).path).lstrip("/")
    if not rel or any(s in (".", "..") for s in rel.replace("\\", "/").split("/")):
        return None
    return rel


def web_path(rel: str, prefix: str) -> str:
    return prefix + "/".join(quote(s, "") for s in rel.split("/"))


def route(path: str, extensions: list[str]) -> str:
    for e in extensions:
        if path.endswith(e):
            path = path[: -len(e)]
            break
    parts = [s for s in path.split("/") if s]
    if parts and parts[-1] == "index":
        parts.pop()
    return f"/{parts[0]}/" if len(parts) == 1 else "/" + "/".join(parts)


def rewrite(href: str, page_url: str, config: SiteConfig) -> str:
    """A link within the site as its new route; what is absolute, special or elsewhere stays."""
    if not href or href.lower().startswith(PASS):
        return href
    url = resolve(page_url, href)
    if url is None:
        return href
    parts = urlsplit(url)
    if parts.netloc != urlsplit(config.site.base_url).netloc.lower():
        return href
    tail = (f"?{parts.query}" if parts.query else "") + (f"#{parts.fragment}" if parts.fragment else "")
    return route(parts.path, config.url_pattern.strip_extensions) + tail


def _any_of(words: list[str]) -> str:
    return "|".join(map(re.escape, sorted(filter(None, words), key=len, reverse=True)))


def without_noise(title: str, markers: list[str], noise: list[str]) -> str:
    """What stands after a marker and its colon, if there is one; else the title without site names at its ends."""
    if (marked := _any_of(markers)) and (found := re.search(rf"(?:{marked})\s*[:：]\s*", title, re.I)):
        return title[found.end() :].strip()
    if not (names := _any_of(noise)):
        return title
    edge = re.escape(EDGE).replace("/", r"\/")
    return re.sub(rf"^(?:(?:{names})[{edge}]*)+|(?:[{edge}]*(?:{names}))+$", "", title)


def clean_title(title: str, config: SiteConfig, strip_noise: bool) -> str:
    """Without site names (of a page's ``title`` alone), leading dates and what is left of separators."""
    ex = config.extract
    title = title.strip()
    if strip_noise:
        title = without_noise(title, ex.title_markers, ex.title_noise)
    prefixes = title_prefixes(ex.title_markers, ex.strip_title_prefix)
    for _ in range(3):
        left = title
        for prefix in prefixes:
            left = re.sub(prefix, "", left, flags=re.I)
        left = left.strip(" \t\r\n-–—|:：")
        if left == title:
            break
        title = left
    return title.strip()


def extract(html: str, page: dict, config: SiteConfig) -> dict:
    """What a page holds. Whether an image's file is there is left to a join: ``images`` are candidates."""
    ex, base = config.extract, page["source_url"]
    doc = dom.parse(html.removeprefix("﻿"))
    nodes = dom.select(doc, ex.content) or dom.select(doc, "body")[:1] or [doc]
    text_length = units(" ".join(squeeze(n.text()) for n in nodes).strip())
    image_count = sum(d.tag == "img" for n in nodes for d in n.walk())
    alternates = []
    for link in dom.select(doc, "link[hreflang][href]"):
        lang, href = link.attrs["hreflang"].strip(), link.attrs["href"]
        target = resolve(base, href) if href else None
        if lang and target and "alternate" in link.attrs.get("rel", "").lower().split():
            alternates.append({"hreflang": lang, "href": href, "target_url": target})
    rules = ex.type_rules.get(page["page_type"])
    title = ""
    if rules and rules.title_selector and (found := dom.select(doc, rules.title_selector)):
        title = clean_title(squeeze(found[0].text()), config, False)
    if not title:
        found = dom.select(doc, "title")
        title = clean_title(squeeze(found[0].text()), config, True) if found else ""
    title = title or page["slug"]
    for s in rules.remove_selectors if rules else ():
        for n in dom.select(doc, s):
            n.remove()
    flags = [ex.section_flags[page["section"]]] if page["section"] in ex.section_flags else []
    if text_length < ex.text_in_image_max_length and image_count and page["page_type"] != "listing":
        flags.append("text_in_image")

    embeds: list[str] = []
    out: dict = {"images": [], "videos": [], "documents": [], "need_fetch": []}

    def media(ref: str) -> tuple[str, str, str] | None:
        url = resolve(base, ref)
        rel = media_relative(url) if url else None
        return (url, rel, web_path(rel, config.media.web_prefix)) if rel else None

    def embed(node: dom.Node, markup: str) -> None:
        node.replace(f"@@EMBED{len(embeds)}@@")
        embeds.append(markup)

    for node in nodes:
        below = list(node.walk())
        for n in below:
            if n.tag == "a" and "href" in n.attrs:
                n.attrs["href"] = rewrite(n.attrs["href"], base, config)
        for n in below:
            if n.tag != "iframe" or "src" not in n.attrs:
                continue
            src = n.attrs["src"]
            low = src.lower().split("?")[0]
            if "youtube.com/embed" in low or "youtu.be" in low:
                embed(n, VIDEO.format(YOUTUBE.format(src)))
                out["videos"].append({"type": "youtube", "url": src, "src": None})
            elif low.endswith(".pdf") and (found := media(src)):
                embed(n, PDF.format(found[2], config.media.pdf_labels.get(page["locale"], "View PDF")))
                out["documents"].append({"src": found[2], "orig": found[0]})
                out["need_fetch"].append(found[0])
        for n in [x for x in below if x.tag == "video"]:
            last = None
            for source in [x for x in n.walk() if x.tag == "source" and "src" in x.attrs]:
                if found := media(source.attrs["src"]):
                    last = found[2]
                    out["videos"].append({"type": "local", "url": None, "src": last})
                    out["need_fetch"].append(found[0])
            if last:
                embed(n, VIDEO.format(LOCAL.format(last)))
            else:
                n.remove()
        for n in [x for x in node.walk() if x.tag == "img" and "src" in x.attrs]:
            if not (found := media(n.attrs["src"])):
                continue
            out["images"].append({"media": found[1], "original_url": found[0], "web": found[2], "alt": n.attrs.get("alt", "")})
            if rules and rules.images_to_gallery:
                (n.parent if n.parent is not None and n.parent.tag == "a" else n).remove()
            else:
                n.attrs["src"] = found[2]
        for n in [x for x in node.walk() if x.tag in ("script", "style")]:
            n.remove()
    body = dom.tidy(dom.to_markdown(nodes))
    body = re.sub(r"@@EMBED(\d+)@@", lambda m: f"\n\n{embeds[int(m[1])]}\n\n" if int(m[1]) < len(embeds) else m[0], body)
    return {"title": title, "flags": flags, "text_length": text_length, "image_count": image_count, "body": re.sub("\n{3,}", "\n\n", body).strip(), "alternates": alternates, **out}
