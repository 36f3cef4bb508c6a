"""Markdown pages with a YAML block."""

from __future__ import annotations

import re

from ..functions.scalars import YAML_PATTERNS, YAML_WORDS

_SPECIAL = re.compile(r"^[\s\-?:,\[\]{}#&*!|>'\"%@`]|: |:$| #|\s$|[\x00-\x1f]")


def needs_quoting(value: str) -> bool:
    """What YAML 1.1 would read as other than a string."""
    return value.lower() in YAML_WORDS or any(re.search(p, value) for p in YAML_PATTERNS)


def scalar(value) -> str:
    if isinstance(value, int):
        return str(value)
    if value == "":
        return "''"
    if "\n" in value or "\r" in value:
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r") + '"'
    if needs_quoting(value) or _SPECIAL.search(value):
        return "'" + value.replace("'", "''") + "'"
    return value


def block(fields: dict) -> str:
    out = []
    for key, value in fields.items():
        if not isinstance(value, list):
            out.append(f"{key}: {scalar(value)}")
        elif not value:
            out.append(f"{key}: []")
        else:
            out.append(f"{key}:")
            for item in value:
                pairs = [f"{k}: {scalar(v)}" for k, v in item.items() if v is not None] if isinstance(item, dict) else [scalar(item)]
                out += [("- " if i == 0 else "  ") + p for i, p in enumerate(pairs)]
    return "---\n" + "\n".join(out) + "\n---\n\n"


def page(row: dict, images: list[dict]) -> str:
    """A written page; ``images`` are those whose file is there."""
    fields = {
        "source_url": row["source_url"],
        "lang": row["locale"],
        "section": row["section"],
        "slug": row["slug"],
        "translation_key": row["translation_key"],
        "title": row["title"],
        "page_type": row["page_type"],
        "flags": list(row["flags"]),
        "text_length": row["text_length"],
        "image_count": row["image_count"],
        "images": [{"local": i["web"], "alt": i["alt"]} for i in images],
        "videos": [dict(v) for v in row["videos"]],
        "documents": [dict(d) for d in row["documents"]],
    }
    return block(fields) + row["body"] + "\n"


def local_images(fields: dict | None) -> list[str]:
    """The files of a page's ``images``."""
    images = (fields or {}).get("images")
    return [i["local"] for i in images if isinstance(i, dict) and isinstance(i.get("local"), str)] if isinstance(images, list) else []


def parse(yaml_text: str) -> dict | None:
    """All scalars as strings; None if it can't be read."""
    import yaml

    try:
        found = yaml.load(yaml_text, yaml.BaseLoader)
    except yaml.YAMLError:
        return None
    return found if isinstance(found, dict) else {}
