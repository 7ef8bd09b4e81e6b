"""Words to lines, blocks and pages; text areas, columns and filters over them.

Frames: words(paper_id, page_number, block_idx, line_idx, word_idx, text, x, y,
width, height); lines and blocks keep the keys of their level and a box x1, y1,
x2, y2. Order is data: the ordinals, never the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstruct.functions import geometry as G
from docstruct.functions import text as X

PAGE = ["paper_id", "page_number"]
BLOCK = [*PAGE, "block_idx"]
LINE = [*BLOCK, "line_idx"]
#: Page size taken for a document without pages.
DEFAULT_PAGE = (595.0, 842.0)


def lines(words: DataFrame) -> DataFrame:
    """Lines with text (words joined by a blank), box, the least and greatest word height and the number of words.

    Words without text and rows repeated as they are do not count; a line
    without text is no line, a block without lines no block, and page numbers
    keep their gaps. The one shuffle is by page, which the steps after it share.
    """
    text = X.trim_white(F.col("text"))
    w = words.select(*LINE, "word_idx", text.alias("text"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")]).filter("text <> ''").repartition(*PAGE).distinct()
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda s: s["text"]), " ")
    return w.groupBy(*LINE).agg(
        joined.alias("text"), F.min("x").alias("x1"), F.min("y").alias("y1"), F.max(F.col("x") + F.col("width")).alias("x2"), F.max(F.col("y") + F.col("height")).alias("y2"),
        F.max("height").alias("font_size"), F.count("*").alias("n_words"),
    )


def fold_lines(texts):
    """Line texts in order as one text: a hyphen at a line end is taken out with the break, other breaks are blanks."""
    joined = F.regexp_replace(F.regexp_replace(F.array_join(texts, "\n"), "-+\n", ""), "\n", " ")
    return X.trim_white(X.suffix_hyphens(X.trim_white(joined)))


def blocks(line_rows: DataFrame) -> DataFrame:
    """Blocks with text, box, line count and mean line width."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda s: s["text"])
    b = line_rows.groupBy(*BLOCK).agg(ordered.alias("line_texts"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("n_lines"), F.avg(F.col("x2") - F.col("x1")).alias("line_width"), F.max("font_size").alias("font_size"))
    return b.select(*BLOCK, fold_lines(F.col("line_texts")).alias("text"), "x1", "y1", "x2", "y2", "n_lines", "line_width", "font_size")


def page_text(block_rows: DataFrame) -> DataFrame:
    """The text of each page: its blocks, each with a blank line after it."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "text"))), lambda s: F.concat(s["text"], F.lit("\n\n")))
    return block_rows.groupBy(*PAGE).agg(F.array_join(ordered, "").alias("text"))


def page_extents(line_rows: DataFrame) -> DataFrame:
    return line_rows.groupBy(*PAGE).agg(F.min("y1").alias("top"), F.max("y2").alias("bottom"), F.min("x1").alias("left"), F.max("x2").alias("right"))


def page_sizes(pages: DataFrame) -> DataFrame:
    """One size per page; of repeated rows the largest."""
    return pages.groupBy(*PAGE).agg(F.max(F.col("width").cast("double")).alias("page_width"), F.max(F.col("height").cast("double")).alias("page_height"))


def live_pages(pages: DataFrame, line_rows: DataFrame) -> DataFrame:
    """The pages that have a line: a page without text is no page of its paper."""
    return pages.join(line_rows.select(*PAGE).distinct(), PAGE, "left_semi")


def text_area(line_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Per paper the median over its pages of each edge; the first page's size if that is too small or there is none."""
    sizes = page_sizes(pages)
    first = sizes.groupBy("paper_id").agg(F.min_by("page_width", "page_number").alias("w"), F.min_by("page_height", "page_number").alias("h"))
    med = page_extents(line_rows).groupBy("paper_id").agg(*[F.median(c).alias(c) for c in ("left", "top", "right", "bottom")])
    j = first.join(med, "paper_id", "full_outer").withColumns({"w": F.coalesce("w", F.lit(DEFAULT_PAGE[0])), "h": F.coalesce("h", F.lit(DEFAULT_PAGE[1]))})
    bad = F.col("top").isNull() | (F.col("bottom") - F.col("top") < 0.2 * F.col("h")) | (F.col("right") - F.col("left") < 0.2 * F.col("w"))
    pick = lambda full, own, name: F.when(bad, full).otherwise(F.col(own)).alias(name)
    return j.select("paper_id", pick(F.lit(0.0), "left", "ax1"), pick(F.lit(0.0), "top", "ay1"), pick(F.col("w"), "right", "ax2"), pick(F.col("h"), "bottom", "ay2"))


def in_text_area(block_rows: DataFrame, areas: DataFrame) -> DataFrame:
    """Blocks that share any of the paper's text area."""
    hit = G.iou(G.Rect(F.col("ax1"), F.col("ay1"), F.col("ax2"), F.col("ay2")), G.Rect.of())
    return block_rows.join(areas, "paper_id").filter(F.abs(hit) >= 1e-6).drop("ax1", "ay1", "ax2", "ay2")


def without_small_blocks(block_rows: DataFrame, pages: DataFrame, titles: DataFrame) -> DataFrame:
    """Drop blocks that are narrow and have fewer than four lines, unless they are a known title.

    ``titles``: paper_id, title. A paper without titles keeps all its blocks.
    """
    known = titles.select("paper_id", F.lower("title").alias("known_title")).distinct()
    has = known.select("paper_id").distinct().withColumn("has_titles", F.lit(True))
    j = (
        block_rows.join(page_sizes(pages), PAGE, "left")
        .join(has, "paper_id", "left")
        .withColumn("as_title", F.lower(X.trim_white(X.strip_first_number(F.col("text")))))
        .join(known.withColumn("is_title", F.lit(True)).withColumnRenamed("known_title", "as_title"), ["paper_id", "as_title"], "left")
    )
    narrow = (F.col("x2") - F.col("x1")) / (F.coalesce("page_width", F.lit(DEFAULT_PAGE[0])) / 1.1) < 0.3
    keep = F.col("has_titles").isNull() | F.col("is_title").isNotNull() | ~(narrow & (F.col("n_lines") < 4))
    return j.filter(keep).select(*block_rows.columns)


def without_tables(line_rows: DataFrame, boxes: DataFrame, titles: DataFrame) -> DataFrame:
    """Drop lines more than 30 % covered by a table box of their page, except lines that are a known title."""
    known = titles.select("paper_id", F.lower("title").alias("as_title")).distinct()
    as_title = F.lower(X.trim_white(X.strip_title_number(F.regexp_replace(F.col("text"), r"(?U)\s+", " "))))
    keyed = line_rows.withColumn("as_title", as_title).join(known.withColumn("is_title", F.lit(True)), ["paper_id", "as_title"], "left")
    b = boxes.select(*PAGE, *[F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")])
    inside = G.covered(G.Rect(keyed["x1"], keyed["y1"], keyed["x2"], keyed["y2"]), G.Rect.of("t_"))
    kept = keyed.join(b, [keyed[k] == b[k] for k in PAGE] + [keyed["is_title"].isNull() & inside], "left_anti")
    return kept.select(*line_rows.columns)


def column_counts(block_rows: DataFrame, pages: DataFrame, titles: DataFrame, widths: DataFrame | None = None) -> DataFrame:
    """paper_id, number_of_columns: 2 if the mean line width is under two thirds of the page width, else 1.

    The mean is over the pages up to the last one with a title, but divided by
    the count of all pages; an emptied page among them makes it not a number,
    and the paper keeps one column, as does a paper without titles.
    ``titles``: paper_id, page_number; ``widths``: paper_id, page_width of the
    document, where it is not that of the first page.
    """
    sizes = page_sizes(pages)
    if widths is not None:
        own = widths.select("paper_id", F.col("page_width").cast("double").alias("own_width"))
        sizes = sizes.join(own, "paper_id", "left").withColumn("page_width", F.coalesce("own_width", "page_width")).drop("own_width")
    last = titles.groupBy("paper_id").agg(F.max("page_number").alias("last_page"))
    means = block_rows.groupBy(*PAGE).agg(F.avg("line_width").alias("m"))
    j = sizes.join(last, "paper_id").join(means, PAGE, "left")
    upto = F.when(F.col("page_number") <= F.col("last_page"), F.coalesce("m", F.lit(float("nan")))).otherwise(0.0)
    agg = j.groupBy("paper_id").agg((F.sum(upto) / F.count("*")).alias("line_width"), F.min_by("page_width", "page_number").alias("page_width"))
    two = ~F.isnan("line_width") & (F.col("line_width") < F.col("page_width") / 1.5)
    found = agg.select("paper_id", F.when(two, 2).otherwise(1).alias("number_of_columns"), "page_width")
    rest = sizes.groupBy("paper_id").agg(F.min_by("page_width", "page_number").alias("page_width")).join(found, "paper_id", "left_anti")
    return found.unionByName(rest.select("paper_id", F.lit(1).alias("number_of_columns"), "page_width"))


def column_order(block_rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Blocks with their place in reading order: in two-column papers the left column of a page before the right."""
    j = block_rows.join(counts, "paper_id")
    right = F.when((F.col("number_of_columns") == 2) & (F.col("x1") > F.col("page_width") / 2.2), 1).otherwise(0)
    w = Window.partitionBy(*PAGE).orderBy("is_right", "block_idx")
    return j.withColumn("is_right", right).withColumn("place", F.row_number().over(w) - 1).drop("page_width")


def ruling_tables(segments: DataFrame) -> DataFrame:
    """Table boxes from ruling lines: page_id, x1, y1, x2, y2.

    ``segments``: page_id, x1, y1, x2, y2, page_width, page_height. Kept are
    level lines at least a quarter of the page long; lengths (whole points)
    that differ by at most two from the least of a group form it, taken from the
    shortest up; three lines or more are a table unless their box covers more
    than half the page.
    """
    slope = F.abs((F.col("y2") - F.col("y1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0)))
    length = F.floor(F.sqrt(F.pow(F.col("x1") - F.col("x2"), F.lit(2)) + F.pow(F.col("y1") - F.col("y2"), F.lit(2))))
    level = segments.withColumn("len", length).filter((slope <= 0.01) & (F.col("len") >= F.col("page_width") / 4))
    lens = level.groupBy("page_id").agg(F.array_sort(F.collect_set("len")).alias("lens"))
    keys = F.aggregate("lens", F.array().cast("array<bigint>"), lambda a, x: F.when((F.size(a) > 0) & (x - F.element_at(a, -1) < 3), a).otherwise(F.concat(a, F.array(x))))
    groups = lens.select("page_id", F.explode(keys).alias("key"))
    j = level.join(groups, "page_id").filter((F.col("len") >= F.col("key")) & (F.col("len") - F.col("key") < 3))
    boxes = j.groupBy("page_id", "key").agg(F.count("*").alias("n"), F.min(F.least("x1", "x2")).alias("x1"), F.min(F.least("y1", "y2")).alias("y1"), F.max(F.greatest("x1", "x2")).alias("x2"), F.max(F.greatest("y1", "y2")).alias("y2"), F.max("page_width").alias("pw"), F.max("page_height").alias("ph"))
    page_area = F.col("pw") * F.col("ph")
    return boxes.filter((F.col("n") >= 3) & ((page_area <= 0) | (G.area(G.Rect.of()) / page_area <= 0.5))).select("page_id", "x1", "y1", "x2", "y2")
