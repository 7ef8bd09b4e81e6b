"""Section titles from font statistics.

``texts``: paper_id, page_number, ord (position in the paper), font_id, text.
``fonts``: paper_id, font_id, size, family.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstruct.functions import text as X


def font_specs(scan: DataFrame) -> DataFrame:
    """One row per font: of several definitions the last one (by ord) counts; missing values are 0 and empty."""
    s = scan.groupBy("paper_id", "font_id").agg(F.max_by(F.struct("size", "family"), "ord").alias("s"))
    return s.select("paper_id", "font_id", F.coalesce("s.size", F.lit(0.0)).alias("size"), F.coalesce("s.family", F.lit("")).alias("family"))


def font_usage(texts: DataFrame) -> DataFrame:
    """Characters set in each font, without the white space around texts."""
    n = F.char_length(X.trim_white(F.col("text")))
    return texts.withColumn("n", n).filter("n > 0").groupBy("paper_id", "font_id").agg(F.sum("n").alias("n_chars"))


def body_font(texts: DataFrame, fonts: DataFrame) -> DataFrame:
    """The font of most characters (of equal ones the least id) and its size, 0 if it has no definition."""
    top = font_usage(texts).groupBy("paper_id").agg(F.max_by("font_id", F.struct("n_chars", -F.col("font_id"))).alias("font_id"))
    return top.join(fonts, ["paper_id", "font_id"], "left").select("paper_id", F.col("font_id").alias("body_font_id"), F.coalesce("size", F.lit(0.0)).alias("body_size"))


def anchor_fonts(texts: DataFrame) -> DataFrame:
    """Fonts some text of which is an anchor word, with or without a number before it."""
    t = F.lower(X.trim_white(F.col("text")))
    return texts.filter(t.isin(X.ANCHOR_WORDS) | X.strip_title_number(t).isin(X.ANCHOR_WORDS)).select("paper_id", "font_id").distinct()


def font_scores(texts: DataFrame, fonts: DataFrame) -> DataFrame:
    """paper_id, font_id, size, is_anchor, score: size against the body's, bold or black family, anchor."""
    j = fonts.join(body_font(texts, fonts), "paper_id").join(anchor_fonts(texts).withColumn("is_anchor", F.lit(True)), ["paper_id", "font_id"], "left").withColumn("is_anchor", F.coalesce("is_anchor", F.lit(False)))
    sized = F.when(F.col("body_size") > 0, F.when(F.col("size") > F.col("body_size"), 1.0).when(F.col("size") < F.col("body_size"), -1.0).otherwise(0.0)).otherwise(0.0)
    family = F.lower("family")
    bold = F.when(family.contains("bold") | family.contains("black"), 0.3).otherwise(0.0)
    return j.select("paper_id", "font_id", "size", "body_size", "is_anchor", (sized + bold + F.when(F.col("is_anchor"), 0.5).otherwise(0.0)).alias("score"))


def title_fonts(texts: DataFrame, fonts: DataFrame) -> DataFrame:
    """Fonts of section titles: candidates score 1 or more; with anchors among them only those of the least anchor size."""
    c = font_scores(texts, fonts).filter("score >= 1.0")
    least = F.min(F.when(F.col("is_anchor") & (F.col("size") > F.col("body_size")), F.col("size"))).over(Window.partitionBy("paper_id"))
    return c.withColumn("least", least).filter(F.col("least").isNull() | (F.abs(F.col("size") - F.col("least")) < 0.1)).select("paper_id", "font_id")


def section_titles(texts: DataFrame, fonts: DataFrame) -> DataFrame:
    """paper_id, ord, page_number, title: texts in title fonts from the abstract on.

    Pure numbers are no titles and numbers before titles fall off. Without an
    "abstract" in any font the titles begin at the first anchor word, with an
    Abstract on page 1 before it if that is on a later page; without any anchor
    there are none, and the paper is read as one text.
    """
    pending = (
        texts.join(title_fonts(texts, fonts), ["paper_id", "font_id"], "left_semi")
        .withColumn("t", X.trim_white(F.col("text")))
        .filter((F.col("t") != "") & ~F.col("t").rlike(r"(?U)^\d+$"))
        .select("paper_id", "page_number", "ord", X.strip_title_number(F.col("t")).alias("title"))
    )
    abstract = texts.filter(F.lower(X.trim_white(F.col("text"))) == "abstract").groupBy("paper_id").agg(F.min("ord").alias("abstract_ord"))
    p = pending.join(abstract, "paper_id", "left")
    anchored = F.when(F.lower("title").isin(X.ANCHOR_WORDS), F.col("ord"))
    p = p.withColumn("anchor_ord", F.min(anchored).over(Window.partitionBy("paper_id")))
    kept = p.filter(F.col("ord") >= F.coalesce("abstract_ord", "anchor_ord"))
    first = p.filter(F.col("abstract_ord").isNull() & (F.col("ord") == F.col("anchor_ord")) & (F.col("page_number") > 1))
    made = first.select("paper_id", F.lit(1).alias("page_number"), F.lit(-1).cast(texts.schema["ord"].dataType).alias("ord"), F.lit("Abstract").alias("title"))
    return kept.select("paper_id", "page_number", "ord", "title").unionByName(made.distinct())
