"""JSON of sections and papers, with the field order of the records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstruct.operators.sections import section_text, with_captions


def section_struct():
    """A section as it is written: math_contents left out if null, captions if empty."""
    captions = F.when(F.size("captions") > 0, F.col("captions"))
    return F.struct(F.col("index"), F.col("title"), F.col("contents"), F.col("math_contents"), captions.alias("captions"))


def _ordered(value, alias: str):
    return F.transform(F.array_sort(F.collect_list(F.struct("place", value.alias("v")))), lambda s: s["v"]).alias(alias)


def legacy_json(sections: DataFrame) -> DataFrame:
    """paper_id, json: an array of title and joined contents."""
    return sections.groupBy("paper_id").agg(F.to_json(_ordered(F.struct("title", section_text().alias("contents")), "x")).alias("json"))


def sections_json(sections: DataFrame) -> DataFrame:
    """paper_id, json: an array of the sections in order."""
    return sections.groupBy("paper_id").agg(F.to_json(_ordered(section_struct(), "x")).alias("json"))


def paper_output(sections: DataFrame, references: DataFrame) -> DataFrame:
    """paper_id, json: sections and, if there are any, references. ``references``: paper_id, references (array of records)."""
    s = sections.groupBy("paper_id").agg(_ordered(section_struct(), "sections"))
    j = s.join(references, "paper_id", "left")
    refs = F.when(F.size("references") > 0, F.col("references"))
    return j.select("paper_id", F.to_json(F.struct("sections", refs.alias("references"))).alias("json"))


def write_papers(sections: DataFrame, path: str, references: DataFrame | None = None, include_captions: bool = False, math_markup: bool = True) -> None:
    """Write one JSON text per paper, with the options of the command line."""
    s = with_captions(sections) if include_captions else sections
    if not math_markup:
        s = s.withColumn("math_contents", F.lit(None).cast("array<string>"))
    out = sections_json(s) if references is None else paper_output(s, references)
    out.select(F.col("json").alias("value")).write.mode("overwrite").text(path)
