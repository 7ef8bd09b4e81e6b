"""The pN_ queries: each problem's operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docstruct.llm.confusables import found_items, section_forms, skeleton_groups
from docstruct.llm.garbled import find_garbled
from docstruct.llm.names import linked_names
from docstruct.llm.near_duplicates import similar_pairs
from docstruct.llm.ocr import OcrRepair
from docstruct.llm.packing import pack_texts
from docstruct.llm.sections_io import titles_and_paragraphs
from docstruct.llm.sentences import section_sentences
from docstruct.llm.splitting import split_sections
from docstruct.llm.tokenize import encode_texts
from docstruct.scale import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return found_items(cut(section_forms(table(spark, d, "sections"))), ["section_id", "item_no"])


def p1_skeleton_groups(spark: SparkSession, d: str) -> DataFrame:
    return skeleton_groups(titles_and_paragraphs(table(spark, d, "sections")), [], "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return OcrRepair(table(spark, d, "sections"), table(spark, d, "words")).found()


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return OcrRepair(table(spark, d, "sections"), table(spark, d, "words")).paragraphs().distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(table(spark, d, "bib_entries"), "ref_id", ["raw_text", "title"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_sections(table(spark, d, "sections"), table(spark, d, "size_profiles"))
    return pieces.filter("piece_no = 1").select("section_id", "item_no").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_sections(table(spark, d, "sections"), table(spark, d, "size_profiles")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return section_sentences(table(spark, d, "sections"), "text").select("section_id", "item_no", "end_pos").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_names(table(spark, d, "bib_entries"), "authors", table(spark, d, "given_forms"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(table(spark, d, "documents"), table(spark, d, "size_profiles"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_garbled(table(spark, d, "documents")).select("doc_id", "line_no").distinct()


def p9_repaired(spark: SparkSession, d: str) -> DataFrame:
    return find_garbled(table(spark, d, "documents"))


P4_SQL = """
SELECT DISTINCT section_id, item_no FROM (
  SELECT section_id, CAST(generate_subscripts(contents, 1) - 1 AS INTEGER) AS item_no, unnest(contents) AS t FROM sections)
WHERE length(t) > (SELECT capacity FROM size_profiles WHERE profile_name = 'section_split')
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_skeleton_groups, p2_found, p2_paragraphs, p3_found, p4_found, p4_pieces, p5_found, p6_found, p7_ids, p8_containers, p9_found, p9_repaired)}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL}
