"""Saved pages to message blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltbook.functions.timecols import squash

#: A block pattern first, then fallbacks that count only from three matches on.
BLOCKS = (r"(?is)<p[^>]*>(.*?)</p>", r"(?is)<li[^>]*>(.*?)</li>")


def strip_tags(c):
    return squash(F.regexp_replace(c, r"(?s)<[^>]*>", " "))


def page_blocks(pages: DataFrame, patterns: Sequence[str] = BLOCKS, id_col: str = "page_id", html_col: str = "html", least: int = 3) -> DataFrame:
    """(id, pos, raw, text) of each page's blocks by the first pattern that applies."""
    found = None
    for k, p in reversed(list(enumerate(patterns))):
        hits = F.regexp_extract_all(html_col, F.lit(p), F.lit(1))
        some = F.when(F.size(hits) >= (1 if k == 0 else least), hits)
        found = some if found is None else F.coalesce(some, found)
    blocks = pages.select(F.col(id_col), F.posexplode(found).alias("pos", "raw"))
    return blocks.withColumn("text", strip_tags(F.col("raw")))
