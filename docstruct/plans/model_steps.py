"""The steps an outside model takes part in: title validation, page texts with mathematics, bibliographies.

A model is any callable of ``sources.providers``; every step is the same plan
with or without it, and an answer that fails or is empty leaves what was there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstruct.functions import text as X
from docstruct.operators import layout, math_markup, references
from docstruct.operators.layout import PAGE
from docstruct.scale import cut
from docstruct.sources.providers import Model, ask

#: Page images shown for the titles, and the questions.
TITLE_PAGES = 3
ASK_TITLES = "List the section titles printed on these pages, in order and without numbers, as a JSON array of strings and nothing else."
ASK_PAGE = "Write down the text of this page, its paragraphs parted by blank lines and its formulas as LaTeX between dollar signs."
ASK_REFERENCES = "List the works of this bibliography as a JSON array of objects with raw_text, authors (array of strings), title, year (integer), venue, doi, url, arxiv_id, volume and pages; null where one is missing. Only the array."


def validated_titles(titles: DataFrame, figures: DataFrame, model: Model) -> DataFrame:
    """Font titles merged with those the model reads on the first pages.

    ``figures``: paper_id, page_number, image. Papers without font titles are not
    asked; where the answer has no title the font titles stay.
    """
    first = figures.join(titles.select("paper_id").distinct(), "paper_id", "left_semi").filter(F.col("page_number").between(1, TITLE_PAGES))
    shown = first.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "image"))), lambda s: s["image"]).alias("images"))
    answers = cut(ask(shown, ["paper_id"], "images", ASK_TITLES, model))  # read twice, asked once
    listed = answers.select("paper_id", F.posexplode(references.parse_title_list(F.col("answer"))).alias("pos", "title"))
    n_pages = figures.groupBy("paper_id").agg(F.count_distinct("page_number").alias("n_figures")).join(listed.select("paper_id").distinct(), "paper_id", "left_semi")
    known = titles.join(n_pages, "paper_id", "left")
    # of a paper without an answer no page was seen
    return references.merge_titles(known, listed, 1, F.least(F.coalesce("n_figures", F.lit(0)), F.lit(TITLE_PAGES))).select("paper_id", "ord", "page_number", "title")


def model_markup(block_rows: DataFrame, figures: DataFrame, model: Model) -> DataFrame:
    """paper_id, page_number, block_idx, math_text: blocks of pages dense with mathematics, from the model's reading of their image.

    Other pages, and pages whose answer is empty, get none. ``block_rows``:
    paper_id, page_number, block_idx (in reading order), text.
    """
    dense = math_markup.dense_pages(layout.page_text(block_rows)).select(*PAGE)
    answers = cut(ask(figures.join(dense, PAGE, "left_semi"), PAGE, "image", ASK_PAGE, model)).filter("answer <> ''")
    texts = answers.select(*PAGE, X.latex_to_math_tags(F.col("answer")).alias("text"))
    return math_markup.align_paragraphs(texts, block_rows).withColumn("math_text", X.unicode_math_to_latex(F.col("math_text")))


def extract_references(block_rows: DataFrame, model: Model) -> DataFrame:
    """paper_id, references: the records the model reads in each paper's bibliography; a paper without one is not asked."""
    answers = ask(references.references_text(block_rows), ["paper_id"], "text", ASK_REFERENCES, model)
    return answers.select("paper_id", references.parse_references(F.col("answer")).alias("references"))
