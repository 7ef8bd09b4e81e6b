"""The whole path from words, or the texts page tools print, to sections."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstruct.functions.text import unicode_math_to_latex
from docstruct.operators import fonts, layout, math_markup, references, sections
from docstruct.plans import model_steps
from docstruct.scale import cut
from docstruct.sinks import export
from docstruct.sources import formats
from docstruct.sources.providers import Model


@dataclass(frozen=True)
class Corpus:
    """A corpus of laid-out papers; every step returns a new one.

    Titles of sources, lines, filtered and ordered blocks are written to the shared checkpoint folder
    as they are made, since two or more later steps read each of them: these writes
    run when the step is called, all else when a result is asked for. A filter on
    papers belongs on ``words``, before the first of them.

    ``titles``: paper_id, ord, page_number, title; ``widths``: paper_id,
    page_width of the document, if it is known apart from its pages.
    """

    words: DataFrame
    pages: DataFrame
    titles: DataFrame
    lines: DataFrame
    blocks: DataFrame
    widths: DataFrame | None = None

    @staticmethod
    def from_layout(words: DataFrame, pages: DataFrame, titles: DataFrame | None = None, widths: DataFrame | None = None) -> "Corpus":
        return Corpus.from_lines(layout.lines(words), pages, titles, widths)

    @staticmethod
    def from_lines(line_rows: DataFrame, pages: DataFrame, titles: DataFrame | None = None, widths: DataFrame | None = None) -> "Corpus":
        """``titles`` may be a function of the line rows that were written down."""
        rows = cut(line_rows)
        if titles is None:
            titles = fonts.section_titles(*font_frames(rows))
        elif callable(titles):
            titles = titles(rows)
        return Corpus(rows, layout.live_pages(pages, rows), titles, rows, layout.blocks(rows), widths)

    @staticmethod
    def from_sources(xhtml: DataFrame, font_xml: DataFrame, info: DataFrame | None = None, boxes: DataFrame | None = None) -> "Corpus":
        """From the texts of the page tools, each path, text; a paper is a file name without its ending.

        Titles come from the fonts, page sizes from the layout and the document's
        width from the info; lines in table ``boxes`` fall out before all else.
        """
        texts, defined = formats.font_texts(font_xml)
        titles = cut(fonts.section_titles(texts, fonts.font_specs(defined)))
        rows = layout.lines(formats.paper_words(xhtml))
        if boxes is not None:
            rows = layout.without_tables(rows, boxes, titles)
        widths = None if info is None else info.select(formats.paper_of(F.col("path")).alias("paper_id"), formats.info_map(formats.checked_info(F.col("text")))["page_width"].try_cast("double").alias("page_width"))
        return Corpus.from_lines(rows, formats.layout_pages(xhtml), titles, widths)

    def filter_tables(self, boxes: DataFrame) -> "Corpus":
        rows = layout.without_tables(self.lines, boxes, self.titles)
        return replace(self, lines=rows, pages=layout.live_pages(self.pages, rows), blocks=layout.blocks(rows))

    def text_area(self) -> "Corpus":
        areas = layout.text_area(self.lines, self.pages)
        kept = layout.without_small_blocks(layout.in_text_area(self.blocks, areas), self.pages, self.titles)
        return replace(self, blocks=cut(kept))

    def validate_titles(self, figures: DataFrame, model: Model) -> "Corpus":
        """Titles merged with those a model reads; columns and filters keep to the font titles, so call it last."""
        # written down, so that the model is asked once
        return replace(self, titles=cut(model_steps.validated_titles(self.titles, figures, model)), blocks=cut(self.placed()))

    def placed(self) -> DataFrame:
        """Blocks with their place in reading order."""
        if "place" in self.blocks.columns:
            return self.blocks
        return layout.column_order(self.blocks, layout.column_counts(self.blocks, self.pages, self.titles, self.widths))

    def ordered_blocks(self) -> DataFrame:
        """Blocks in reading order with section and type: paper_id, ord, page_number, block_idx, text, section, block_type."""
        order = F.col("page_number").cast("long") * sections.STRETCH + F.col("place")
        b = self.placed().withColumn("ord", order)
        renumbered = self.lines.join(b.select(*layout.BLOCK, "place"), layout.BLOCK).withColumn("block_idx", F.col("place")).drop("place")
        labels = sections.assign_sections(renumbered, self.titles).withColumnRenamed("block_idx", "place")
        return sections.classify_blocks(b.join(labels, ["paper_id", "page_number", "place"])).select("paper_id", "ord", "page_number", "block_idx", "place", "text", "section", "block_type")

    def math_texts(self, block_rows: DataFrame, figures: DataFrame | None = None, model: Model | None = None) -> DataFrame:
        """paper_id, ord, math_text: from a model for dense pages, or, without one, by the rules for all blocks."""
        if model is None:
            return math_markup.heuristic_markup(block_rows).select("paper_id", "ord", unicode_math_to_latex(F.col("math_text")).alias("math_text"))
        found = model_steps.model_markup(block_rows.select("paper_id", "page_number", F.col("place").alias("block_idx"), "text"), figures, model)
        return cut(found).select("paper_id", (F.col("page_number").cast("long") * sections.STRETCH + F.col("block_idx")).alias("ord"), "math_text")

    def sections(self, math: bool = False, figures: DataFrame | None = None, model: Model | None = None) -> DataFrame:
        b = cut(self.ordered_blocks())
        if not math:
            return sections.section_rows(sections.merge_hyphen_chains(b))
        joined = b.join(self.math_texts(b, figures, model), ["paper_id", "ord"], "left").withColumn("math_text", F.coalesce("math_text", "text"))
        return sections.section_rows(sections.merge_hyphen_chains(joined, ["math_text"]), "math_text")

    def references_text(self) -> DataFrame:
        return references.references_text(self.ordered_blocks())

    def extract_references(self, model: Model) -> DataFrame:
        return cut(model_steps.extract_references(self.ordered_blocks(), model))

    def papers(self, math: bool = False) -> DataFrame:
        return export.sections_json(self.sections(math))


def font_frames(line_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts and fonts of lines without font names: the font is the word height in tenths of a point, its size the height."""
    font = F.round(F.col("font_size") * 10).cast("int")
    order = (F.col("page_number").cast("long") * 100_000 + F.col("block_idx")) * 10_000 + F.col("line_idx")
    texts = line_rows.select("paper_id", "page_number", order.alias("ord"), font.alias("font_id"), "text")
    specs = line_rows.select("paper_id", font.alias("font_id"), (F.round(F.col("font_size") * 10) / 10).alias("size"), F.lit("").alias("family")).distinct()
    return texts, specs
