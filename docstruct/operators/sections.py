"""Sections: labels carried down the lines, hyphen chains over blocks, paragraphs by section."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstruct.functions import text as X
from docstruct.operators.layout import BLOCK, LINE, PAGE

#: Positions in a page: the order of a block is its page times this and its place.
STRETCH = 1_000_000


def assign_sections(line_rows: DataFrame, titles: DataFrame) -> DataFrame:
    """paper_id, page_number, block_idx, section: the label of each block after its last line.

    A line that is a title of its page (or of any page, where the title's page
    is negative) makes itself, without its first number, the label from there
    on; before the first the label is "Abstract". A paper without titles is all
    "Content". ``titles``: paper_id, page_number, title.

    Lines are only sorted within their page; what goes from page to page is one
    row for each, so a paper of any length is no single task.
    """
    t = titles.filter("title IS NOT NULL").groupBy("paper_id", F.lower("title").alias("key")).agg(F.collect_set(F.col("page_number").cast("int")).alias("title_pages"))
    has = t.select("paper_id").distinct().withColumn("has_titles", F.lit(True))
    rows = line_rows.select(*LINE, X.trim_white(X.strip_first_number(F.col("text"))).alias("label")).withColumn("key", F.lower("label"))
    hit = F.array_contains("title_pages", F.col("page_number").cast("int")) | F.exists("title_pages", lambda p: p < 0)
    marked = rows.join(t, ["paper_id", "key"], "left").select(*LINE, F.when(hit, F.col("label")).alias("mark"))
    at = F.struct("line_idx", "mark")
    b = marked.groupBy(*BLOCK).agg(F.max(F.when(F.col("mark").isNotNull(), at))["mark"].alias("mark"))
    in_page = Window.partitionBy(*PAGE).orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("here", F.last("mark", ignorenulls=True).over(in_page))
    over_pages = Window.partitionBy("paper_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    carried = b.groupBy(*PAGE).agg(F.max_by("here", "block_idx").alias("page_mark")).withColumn("before", F.last("page_mark", ignorenulls=True).over(over_pages)).select(*PAGE, "before")
    per = b.join(carried, PAGE).join(has, "paper_id", "left")
    return per.select(*BLOCK, F.when(F.col("has_titles").isNull(), "Content").otherwise(F.coalesce("here", "before", F.lit("Abstract"))).alias("section"))


def classify_blocks(block_rows: DataFrame) -> DataFrame:
    """Adds block_type: Caption or Body."""
    return block_rows.withColumn("block_type", F.when(X.is_caption(F.col("text")), "Caption").otherwise("Body"))


def merge_hyphen_chains(block_rows: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Blocks that end in a hyphen joined to the next block, which gives section and type; a chain without end is lost.

    ``block_rows``: paper_id, ord, text, section, block_type (and ``extra`` text
    columns, joined along). Blocks are sorted within stretches of ``STRETCH``
    positions (a page, in the plan's order); counts go from one to the next. Result: paper_id, ord, text, section, block_type.
    """
    open_end = F.col("text").endswith("-")
    # closed blocks so far: within a stretch of the order, and over the stretches before it
    closed_one = F.when(open_end, 0).otherwise(1)
    b = block_rows.withColumn("stretch", F.floor(F.col("ord") / STRETCH))
    within = Window.partitionBy("paper_id", "stretch").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("paper_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = b.groupBy("paper_id", "stretch").agg(F.sum(closed_one).alias("n")).withColumn("n_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    g = b.withColumn("n_within", F.coalesce(F.sum(closed_one).over(within), F.lit(0))).join(sums, ["paper_id", "stretch"]).withColumn("chain", F.col("n_before") + F.col("n_within"))
    parts = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.when(open_end, F.regexp_replace(c, "-+$", "")).otherwise(F.col(c)).alias("t")))), lambda s: s["t"]), "")
    closed = F.when(~open_end, F.struct("section", "block_type", F.col("ord").alias("at")))
    merged = g.groupBy("paper_id", "chain").agg(*[parts(c).alias(c) for c in ("text", *extra)], F.max(closed).alias("end"))
    return merged.filter(F.col("end").isNotNull()).select("paper_id", F.col("end.at").alias("ord"), "text", *extra, F.col("end.section").alias("section"), F.col("end.block_type").alias("block_type"))


def section_rows(merged: DataFrame, math: str | None = None) -> DataFrame:
    """paper_id, index, title, contents, math_contents, captions of blocks after ``merge_hyphen_chains``.

    The index of a section counts the other sections begun before its first body
    paragraph, plus one if a caption began it; ties go by first appearance.
    math_contents (from the column ``math``) is null unless a paragraph differs.
    """
    spaced = merged.withColumn("paragraph", X.sentence_spacing(F.col("text")))
    spaced = spaced.withColumn("math_paragraph", X.sentence_spacing(F.coalesce(F.col(math), F.col("text"))) if math else F.col("paragraph"))
    body = F.col("block_type") != "Caption"
    ordered = lambda c, cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", F.col(c).alias("t"))))), lambda s: s["t"])
    s = spaced.groupBy("paper_id", "section").agg(
        F.min("ord").alias("first_any"), F.min(F.when(body, F.col("ord"))).alias("first_body"),
        ordered("paragraph", body).alias("contents"), ordered("math_paragraph", body).alias("math_contents"), ordered("paragraph", ~body).alias("captions"),
    )
    s = s.withColumn("start", F.coalesce("first_body", "first_any"))
    # sections begun before a start: begins and starts in one order, the begins counted up to each start
    begin, ask = (F.struct(F.col(c).alias("pos"), F.lit(n).alias("begins")) for c, n in (("first_any", 1), ("start", 0)))
    rest = ["contents", "math_contents", "captions"]
    events = s.select("paper_id", "section", "first_any", "first_body", "start", F.explode(F.array(begin, ask)).alias("e"), *rest).select("paper_id", "section", "first_any", "first_body", "start", "e.*", *[F.when(F.col("e.begins") == 0, F.col(c)).alias(c) for c in rest])
    earlier = Window.partitionBy("paper_id").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("begins").over(earlier), F.lit(0)) - F.when(F.col("first_any") < F.col("start"), 1).otherwise(0)
    late = F.when(F.col("first_body").isNotNull() & (F.col("first_any") < F.col("first_body")), 1).otherwise(0)
    differs = F.exists(F.zip_with("contents", "math_contents", lambda a, b: ~a.eqNullSafe(b)), lambda x: x)
    asked = events.withColumn("tied", before + late).filter("begins = 0")
    out = asked.select("paper_id", "tied", "first_any", F.col("section").alias("title"), "contents", F.when(differs, F.col("math_contents")).alias("math_contents"), "captions")
    w = Window.partitionBy("paper_id").orderBy("tied", "first_any")
    return out.select("paper_id", F.row_number().over(w).cast("smallint").alias("place"), F.col("tied").cast("smallint").alias("index"), "title", "contents", "math_contents", "captions")


def with_captions(sections: DataFrame) -> DataFrame:
    """Captions moved to the end of contents."""
    return sections.withColumns({"contents": F.concat("contents", "captions"), "captions": F.array().cast("array<string>")})


def section_text(c="contents"):
    """Paragraphs joined by line breaks; null paragraphs do not count, no contents give an empty text."""
    return F.coalesce(F.array_join(c, "\n"), F.lit(""))


def section_math_text():
    """The math form if there is one, else the plain text."""
    return F.when(F.size("math_contents") > 0, F.array_join("math_contents", "\n")).otherwise(section_text())
