"""The text items of a sections table: its titles and the paragraphs of its contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paragraphs(sections: DataFrame, keep: Column | None = None, where=None) -> DataFrame:
    """section_id, item_no (position in contents, from 0), text: the paragraphs that are neither null nor empty.

    A null or empty ``contents`` gives no row; rows that repeat a section repeat its paragraphs.
    ``keep`` filters sections, ``where`` is a function of the text column that filters paragraphs.
    """
    df = sections if keep is None else sections.filter(keep)
    out = df.select("section_id", F.posexplode("contents").alias("item_no", "text")).filter(F.length("text") > 0)
    return out if where is None else out.filter(where(F.col("text")))


def titles_and_paragraphs(sections: DataFrame) -> DataFrame:
    """As ``paragraphs``, with the titles as item_no -1."""
    empty = F.array().cast("array<string>")
    items = F.concat(F.array("title"), F.coalesce(F.col("contents"), empty))
    return sections.select("section_id", F.posexplode(items).alias("at", "text")).filter(F.length("text") > 0).select("section_id", (F.col("at") - 1).alias("item_no"), "text")
