"""Dates in slugs, slug folding, CSV and YAML quoting, title cleaning, bigrams, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scalars that YAML 1.1 reads as other than strings.
YAML_PATTERNS = (
    r"^[-+]?[0-9][0-9_]*(\.[0-9_]+)?$",
    r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([Tt ].*)?$",
    r"^[-+]?[0-9][0-9_]*(:[0-5]?[0-9])+$",
    r"^[-+]?0(x[0-9a-fA-F_]+|o[0-7_]+|b[01_]+)$",
    r"^[-+]?\.[0-9][0-9_]*$",
)
YAML_WORDS = ("true", "false", "yes", "no", "on", "off", "null", "~", ".inf", "+.inf", "-.inf", ".nan")
YEARS = (1990, 2100)


def slug_date(slug: Column) -> Column:
    """The date in the first run of eight digits, as YMD, else MDY, else DMY, of the years 1990 to 2100."""
    run = F.regexp_extract(slug, "[0-9]{8}", 0)
    tries = []
    for pattern in ("yyyyMMdd", "MMddyyyy", "ddMMyyyy"):
        day = F.try_to_date(F.when(run != "", run), pattern)
        tries.append(F.when(F.year(day).between(*YEARS), day))
    return F.coalesce(*tries)


def normalize_slug(slug: Column) -> Column:
    return F.lower(F.translate(slug, "-_ ", ""))


def csv_guard(value: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def yaml_needs_quoting(value: Column) -> Column:
    out = F.lower(value).isin(list(YAML_WORDS))
    for pattern in YAML_PATTERNS:
        out = out | value.rlike(pattern)
    return out


def title_prefixes(markers: list[str], own: list[str] = ()) -> list[str]:
    """Patterns of a leading date, with or without a marker such as ``News:``; ``own`` are the site's.

    A date is three numbers between slashes, dots or dashes, the year of four digits at either end; after a marker
    any number may be the short one.
    """
    sep, end = r"[/.\-]", r"\s*[:：]?\s*"
    named = "|".join(map(re.escape, filter(None, markers)))
    after = rf"\s*(?:{named})?" if named else r"\s*"
    lengths = [("4", "1,2", "1,2"), ("1,2", "1,2", "4")]
    dated = [r"^\s*" + sep.join(f"[0-9]{{{n}}}" for n in three) + after + end for three in lengths]
    loose = sep.join(f"[0-9]{{{n}}}" for n in ("1,4", "1,2", "1,4"))
    return dated + ([rf"^\s*(?:{named}){end}{loose}{end}"] if named else []) + list(own)


def strip_date_prefix(title: Column, markers: list[str]) -> Column:
    """Three rounds, as many as a title is cleaned for."""
    for _ in range(3):
        for pattern in title_prefixes(markers):
            title = F.regexp_replace(title, "(?i)" + pattern, "")
        title = F.regexp_replace(title, r"^[ \-–—|:：]+|[ \-–—|:：]+$", "")
    return title


def bigrams(text: Column) -> Column:
    low = F.lower(text)
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(2)))
    return F.when(F.length(low) < 2, F.array().cast("array<string>")).otherwise(every)
