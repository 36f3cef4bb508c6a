"""The extraction as one Arrow-batched pass over safe pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.page import extract
from ..sources.config import SiteConfig

RESULT = (
    "title string, flags array<string>, text_length long, image_count long, body string, "
    "alternates array<struct<hreflang:string,href:string,target_url:string>>, "
    "images array<struct<media:string,original_url:string,web:string,alt:string>>, "
    "videos array<struct<type:string,url:string,src:string>>, documents array<struct<src:string,orig:string>>, need_fetch array<string>"
)


def extract_pages(pages: DataFrame, config: SiteConfig) -> DataFrame:
    """Adds what each page holds to identified ``pages`` with ``html``. Null html is an empty page.

    Gate unsafe pages out first: Spark doesn't move filters below this.
    """
    needed = ("source_url", "locale", "section", "slug", "page_type")
    kept = [c for c in pages.columns if c not in {f.split()[0] for f in RESULT.split(", ")}]
    rows = pages.select(*kept)
    names = [f.split()[0] for f in RESULT.split(", ") if " " in f]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [extract(h or "", dict(zip(needed, p, strict=True)), config) for h, *p in zip(batch["html"], *(batch[c] for c in needed), strict=True)]
            out = batch.drop(columns=["html"])
            for name in names:
                out[name] = pd.Series([m[name] for m in made], index=out.index, dtype=object if name not in ("text_length", "image_count") else "int64")
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "html")
    return rows.mapInPandas(run, f"{fields}, {RESULT}")


def image_uses(extracted: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images whose file is in ``files(media)``, and those that are missing, by one join."""
    each = extracted.select("rel_path", F.col("source_url").alias("page"), F.posexplode("images").alias("pos", "i")).select("rel_path", "page", "pos", "i.*")
    known = files.select("media").distinct()
    uses = each.join(known, "media", "left_semi")
    missing = each.join(known, "media", "left_anti").select("rel_path", "pos", F.col("page").alias("source_page"), F.col("web").alias("missing_image"))
    return uses, missing
