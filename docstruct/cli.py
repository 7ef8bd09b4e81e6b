"""Command line: the texts of page tools, or words and page tables, to one JSON text per paper.

The input is a folder with words.parquet and paper_pages.parquet, or with the
texts of the page tools: *.xhtml (layout), *.xml (fonts), *.info (key and value)
and, for a model, page images named PAPER-PAGE.jpg. A model is a callable named
by --model module:function.
"""

from __future__ import annotations

import argparse
import importlib
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstruct.plans.corpus import Corpus
from docstruct.sinks.export import write_papers
from docstruct.sources import formats

log = logging.getLogger("docstruct")


def read_corpus(spark: SparkSession, folder: str) -> Corpus:
    if os.path.exists(f"{folder}/words.parquet"):
        return Corpus.from_layout(spark.read.parquet(f"{folder}/words.parquet"), spark.read.parquet(f"{folder}/paper_pages.parquet"))
    read = lambda end: formats.read_whole(spark, f"{folder}/*.{end}")
    info = read("info") if any(n.endswith(".info") for n in os.listdir(folder)) else None
    return Corpus.from_sources(read("xhtml"), read("xml"), info)


def page_images(spark: SparkSession, folder: str) -> DataFrame:
    """paper_id, page_number, image of the page images of a folder."""
    files = formats.read_binary(spark, f"{folder}/*.jpg")
    return files.select(F.regexp_replace(formats.paper_of(F.col("path")), r"-[0-9]+$", "").alias("paper_id"), formats.figure_page(F.col("path")).alias("page_number"), F.col("content").alias("image"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="docstruct", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("-p", "--pdf", "-i", "--input", dest="input", required=True, help="folder of the converted papers")
    p.add_argument("-o", "--out", default="output.json")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--model", help="module:function of the outside model")
    p.add_argument("--no-llm", action="store_true", help="do not ask the model for titles and mathematics")
    p.add_argument("--include-captions", action="store_true", help="captions at the end of contents")
    p.add_argument("--no-math-markup", action="store_true")
    p.add_argument("--extract-references", action="store_true", help="structured references (needs a model)")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING)
    if not os.path.exists(a.input):
        log.error("no such input: %s", a.input)
        sys.exit(255)
    if not a.out.endswith(".json"):
        p.error("the output must end in .json")
    model = None
    if a.model:
        module, name = a.model.split(":")
        model = getattr(importlib.import_module(module), name)
    spark = SparkSession.builder.appName("docstruct").getOrCreate()
    corpus = read_corpus(spark, a.input).text_area()
    asked = model is not None and not a.no_llm
    if not asked and not a.no_llm:
        log.warning("no model is named; titles and mathematics are found by rules")
    figures = page_images(spark, a.input) if asked else None
    if asked:
        corpus = corpus.validate_titles(figures, model)
    found = None
    if a.extract_references:
        if model is None:
            log.warning("references need a model; none are extracted")
            found = spark.createDataFrame([], f"paper_id {corpus.lines.schema['paper_id'].dataType.simpleString()}, references array<string>")
        else:
            found = corpus.extract_references(model)
    rows = corpus.sections(math=not a.no_math_markup, figures=figures, model=model if asked else None)
    write_papers(rows, a.out, found, include_captions=a.include_captions, math_markup=not a.no_math_markup)
    log.info("written: %s", a.out)


if __name__ == "__main__":
    main()
