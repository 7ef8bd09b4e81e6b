"""Bibliography text, title lists and the records that language models return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstruct.functions import text as X

HEADINGS = ["references", "bibliography"]
REFERENCE = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if n == "authors" else T.IntegerType() if n == "year" else T.StringType()) for n in ("raw_text", "authors", "title", "year", "venue", "doi", "url", "arxiv_id", "volume", "pages")])


def references_text(block_rows: DataFrame) -> DataFrame:
    """paper_id, text: the blocks of the reference section without its heading.

    Blocks outside such a section count once a block that is just the heading
    came before: the first such block of a paper is an aggregate, so no task
    sorts a whole paper. ``block_rows``: paper_id, ord, text, section.
    """
    inside = F.lower("section").isin(HEADINGS)
    heading = F.lower(X.trim_white(F.col("text"))).isin(HEADINGS)
    b = block_rows.withColumns({"inside": inside, "heading": heading})
    first = b.filter("NOT inside AND heading").groupBy("paper_id").agg(F.min("ord").alias("first_heading"))
    kept = b.join(first, "paper_id", "left").filter("(inside AND NOT heading) OR (NOT inside AND ord > first_heading)")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), "\n")
    return kept.groupBy("paper_id").agg(X.trim_white(joined).alias("text"))


def merge_titles(titles: DataFrame, listed: DataFrame, low, high) -> DataFrame:
    """Font titles of the pages low..high that are also listed, all others as they are, and listed ones not used, on page -1.

    ``low`` and ``high`` are numbers or columns of ``titles``.
    ``titles``: paper_id, ord, page_number, title; ``listed``: paper_id, pos, title.
    """
    keys = listed.select("paper_id", F.lower("title").alias("k")).distinct()
    t = titles.withColumn("k", F.lower("title"))
    ranged = F.col("page_number").between(low, high)
    kept = t.filter(ranged).join(keys, ["paper_id", "k"], "left_semi").unionByName(t.filter(~ranged))
    used = kept.select("paper_id", "k").distinct()
    new = listed.withColumn("k", F.lower("title")).join(used, ["paper_id", "k"], "left_anti")
    return kept.select("paper_id", F.lit(0).alias("part"), F.col("ord").cast("long").alias("ord"), F.col("page_number").cast("int").alias("page_number"), "title").unionByName(new.select("paper_id", F.lit(1).alias("part"), F.col("pos").cast("long").alias("ord"), F.lit(-1).alias("page_number"), "title"))


def _items(c: Column) -> Column:
    """The elements of a text that is one JSON array and nothing else, as variants; else null."""
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")
    return F.try_variant_get(F.when(F.size(alone) == 1, alone[0]), "$", "array<variant>")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _whole_or_sliced(c: Column, read) -> Column:
    """What ``read`` makes of the text, else of the part from the first [ to the last ]."""
    return F.coalesce(read(c), read(F.regexp_extract(c, r"\[[\s\S]*\]", 0)))


def parse_title_list(c: Column) -> Column:
    """A JSON array of strings, else the part from the first [ to the last ], else an empty array.

    One element that is no string makes the whole array empty.
    """

    def read(text: Column) -> Column:
        items = _items(text)
        return F.when(F.forall(items, lambda e: _kind(e) == "STRING"), F.transform(items, lambda e: F.try_variant_get(e, "$", "string")))

    return F.coalesce(_whole_or_sliced(c, read), F.array().cast("array<string>"))


def parse_references(c: Column) -> Column:
    """An array of reference records; one with a value of a wrong type makes the whole array empty, as does text that is none.

    The types are those of the JSON text: a number is no title, a fraction no
    year, an element of authors that is no string no author, and an object that
    stands alone no array. Unknown fields are ignored and missing ones null.
    """

    def right(e: Column) -> Column:
        checks = F.startswith(_kind(e), F.lit("OBJECT"))
        for f in REFERENCE.fields:
            v = F.try_variant_get(e, f"$.{f.name}", "variant")
            if f.name == "authors":
                names = F.try_variant_get(v, "$", "array<variant>")
                checks &= (_kind(v) == "VOID") | F.coalesce(F.forall(names, lambda x: _kind(x) == "STRING"), F.lit(False))
            elif f.name == "year":
                checks &= (_kind(v) == "VOID") | (_kind(v) == "BIGINT") & F.try_variant_get(v, "$", "int").isNotNull()
            else:
                checks &= _kind(v).isin("VOID", "STRING")
        return checks

    def record(e: Column) -> Column:
        return F.struct(*[F.try_variant_get(e, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in REFERENCE.fields])

    def read(text: Column) -> Column:
        items = _items(text)
        return F.when(F.forall(items, right), F.transform(items, record))

    return F.coalesce(_whole_or_sliced(c, read), F.array().cast(T.ArrayType(REFERENCE)))
