"""Site configuration: one YAML file for each site, bound strictly and checked as a whole."""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass, field, is_dataclass
from typing import Any, get_args, get_type_hints
from urllib.parse import urlsplit

#: Heuristics that pairing can fall back on.
HEURISTICS = ("hreflang", "slug_normalized", "shared_media", "date", "title_similarity")
USER_AGENT = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/125.0 Safari/537.36"


class ConfigError(ValueError):
    """All that is wrong with a configuration, in one message."""


@dataclass
class Polite:
    delay_ms: int = 3000


@dataclass
class AuthWorkaround:
    type: str = "cookie"
    set: dict[str, str] = field(default_factory=dict)


@dataclass
class Site:
    base_url: str = ""
    encoding: str | None = None
    polite: Polite = field(default_factory=Polite)
    auth_workaround: AuthWorkaround | None = None
    user_agent: str = USER_AGENT


@dataclass
class UrlPattern:
    lang_map: dict[str, str] = field(default_factory=dict)
    default_lang: str = ""
    strip_extensions: list[str] = field(default_factory=lambda: [".php"])

    @property
    def locales(self) -> list[str]:
        return list(dict.fromkeys(self.lang_map.values()))

    @property
    def suffixes(self) -> list[str]:
        return [*(e + ".html" for e in self.strip_extensions), ".html"]


@dataclass
class TypeRules:
    title_selector: str | None = None
    remove_selectors: list[str] = field(default_factory=list)
    images_to_gallery: bool = False


@dataclass
class Extract:
    content: str = ""
    title_noise: list[str] = field(default_factory=list)
    title_markers: list[str] = field(default_factory=lambda: ["新聞", "News"])
    strip_title_prefix: list[str] = field(default_factory=list)
    section_types: dict[str, str] = field(default_factory=dict)
    type_rules: dict[str, TypeRules] = field(default_factory=dict)
    section_flags: dict[str, str] = field(default_factory=dict)
    text_in_image_max_length: int = 80


@dataclass
class Pairing:
    fallback: list[str] = field(default_factory=list)


@dataclass
class Thumbnails:
    max_width: int = 1000
    quality: int = 82


@dataclass
class Media:
    web_prefix: str = "/media/"
    pdf_labels: dict[str, str] = field(default_factory=dict)
    thumbnails: Thumbnails | None = None


@dataclass
class SiteConfig:
    config_version: int = 1
    site: Site = field(default_factory=Site)
    url_pattern: UrlPattern = field(default_factory=UrlPattern)
    extract: Extract = field(default_factory=Extract)
    pairing: Pairing = field(default_factory=Pairing)
    media: Media = field(default_factory=Media)


def _bind(kind: Any, value: Any, at: str) -> Any:
    options = [t for t in get_args(kind) if t is not type(None)]
    if type(None) in get_args(kind):
        return None if value is None else _bind(options[0], value, at)
    if is_dataclass(kind):
        if value is None:
            return kind()
        if not isinstance(value, dict):
            raise ConfigError(f"{at or 'config'} must be a mapping")
        hints = get_type_hints(kind)
        for key in value:
            if key not in hints:
                raise ConfigError(f"unknown field '{f'{at}.{key}'.strip('.')}'")
        return kind(**{k: _bind(hints[k], v, f"{at}.{k}".strip(".")) for k, v in value.items()})
    origin = getattr(kind, "__origin__", kind)
    if origin is dict:
        if not isinstance(value or {}, dict):
            raise ConfigError(f"{at} must be a mapping")
        return {str(k): _bind(get_args(kind)[1], v, f"{at}.{k}") for k, v in (value or {}).items()}
    if origin is list:
        if not isinstance(value or [], list):
            raise ConfigError(f"{at} must be a list")
        return [_bind(get_args(kind)[0], v, at) for v in value or []]
    try:
        if kind is bool:
            return {"true": True, "false": False}[str(value).lower()]
        return kind(value if value is not None else "")
    except (ValueError, KeyError):
        raise ConfigError(f"{at}: cannot read {value!r} as {kind.__name__}") from None


def _known(find, value: str, error) -> bool:
    try:
        find(value)
    except error:
        return False
    return True


def check(c: SiteConfig) -> list[str]:
    """What is wrong, section by section of the file: the path of a field and what it lacks."""
    up, ex, thumbs = c.url_pattern, c.extract, c.media.thumbnails
    url, locales = urlsplit(c.site.base_url), up.lang_map.values()
    workaround = c.site.auth_workaround.type if c.site.auth_workaround else "cookie"
    rules = [
        (c.config_version == 1, f"config_version: only 1 can be read, not {c.config_version}"),
        (url.scheme in ("http", "https") and bool(url.netloc), f"site.base_url: {c.site.base_url!r} has no http(s) scheme and host"),
        (c.site.encoding is None or _known(codecs.lookup, c.site.encoding, LookupError), f"site.encoding: no encoding is named {c.site.encoding!r}"),
        (c.site.polite.delay_ms >= 0, f"site.polite.delay_ms: {c.site.polite.delay_ms} is negative"),
        (workaround == "cookie", f"site.auth_workaround.type: only 'cookie' is known, not {workaround!r}"),
        (bool(locales), "url_pattern.lang_map: at least one prefix with its locale is needed"),
        (all(v.strip() for v in locales), "url_pattern.lang_map: a locale is empty"),
        (bool(up.default_lang.strip()), "url_pattern.default_lang: missing"),
        (not up.default_lang.strip() or not locales or up.default_lang in locales, f"url_pattern.default_lang: {up.default_lang!r} is no locale of lang_map"),
        (bool(ex.content.strip()), "extract.content: a selector of the content is needed"),
        (ex.text_in_image_max_length >= 0, f"extract.text_in_image_max_length: {ex.text_in_image_max_length} is negative"),
        *((_known(re.compile, p, re.error), f"extract.strip_title_prefix: {p!r} is no pattern") for p in ex.strip_title_prefix),
        *((h in HEURISTICS, f"pairing.fallback: no heuristic is named {h!r}; there are {', '.join(HEURISTICS)}") for h in c.pairing.fallback),
        (thumbs is None or thumbs.max_width >= 1, "media.thumbnails.max_width: must be 1 or more"),
        (thumbs is None or 1 <= thumbs.quality <= 100, "media.thumbnails.quality: must be 1 to 100"),
    ]
    return [said for fits, said in rules if not fits]


def load(text: str, source: str = "config") -> SiteConfig:
    import yaml

    try:
        raw = yaml.load(text, yaml.BaseLoader)
    except yaml.YAMLError as e:
        raise ConfigError(f"{source}: {e}") from None
    try:
        config = _bind(SiteConfig, raw or {}, "")
    except ConfigError as e:
        raise ConfigError(f"{source}: {e}") from None
    if errors := check(config):
        raise ConfigError(f"{source}: " + "\n  - ".join(["not usable:", *errors]))
    return config


def load_file(path: str) -> SiteConfig:
    with open(path, encoding="utf-8-sig") as f:
        return load(f.read(), path)


