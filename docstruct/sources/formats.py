"""Readers for what page tools print: key/value info, font XML, layout XHTML and page images.

The converters themselves (PDF to these texts) are external programs; they plug
in as a ``Provider`` and are never needed for the rest.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A converter of a binary document: name and bytes to a text.
Provider = Callable[[str, bytes], str]


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of the files under a local or shared path."""
    return spark.read.format("binaryFile").load(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def convert(files: DataFrame, provider: Provider) -> DataFrame:
    """path, text: every file through a converter, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [provider(p, bytes(c)) for p, c in zip(b["path"], b["content"])]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def info_map(c: Column) -> Column:
    """``Key: value`` lines as a map: keys lower case with underscores, the value up to a second colon, the last of equal keys.

    A page size adds page_width and page_height.
    """
    lines = F.filter(F.split(c, "\n"), lambda ln: F.size(F.split(ln, ":")) >= 2)
    pair = lambda ln: F.struct(F.replace(F.lower(F.trim(F.split(ln, ":")[0])), F.lit(" "), F.lit("_")).alias("key"), F.trim(F.split(ln, ":")[1]).alias("value"))
    pairs = F.transform(lines, pair)
    size = F.element_at(F.filter(pairs, lambda p: p["key"] == "page_size"), -1)["value"]
    dims = F.array(*[F.struct(F.lit(k).alias("key"), F.regexp_extract(size, r"([\d|.]+) x ([\d|.]+)", i).alias("value")) for i, k in ((1, "page_width"), (2, "page_height"))])
    every = F.when(size.rlike(r"[\d|.]+ x [\d|.]+"), F.concat(pairs, dims)).otherwise(pairs)
    keys = F.array_distinct(F.transform(every, lambda p: p["key"]))
    last = lambda k: F.element_at(F.filter(every, lambda p: p["key"] == k), -1)
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), last(k)["value"].alias("value"))))


def checked_info(c: Column) -> Column:
    """The info text; the query fails if the tool printed nothing."""
    return F.when(c.isNull() | (F.trim(c) == ""), F.raise_error(F.lit("the info tool printed nothing"))).otherwise(c)


def paper_of(path: Column) -> Column:
    """The name of a file without folder and ending: the key its paper has in all its texts."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def figure_page(path: Column) -> Column:
    """The page number at the end of a page image's name."""
    return F.try_to_number(F.regexp_extract(path, r"-([0-9]+)\.jpe?g$", 1), F.lit("99999")).cast("int")


def typed(c: Column, kind: str, required: bool = True) -> Column:
    """An attribute in its type: required ones fail if missing or not readable, others become null."""
    value = c.try_cast(kind)
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"no valid {kind}: "), F.coalesce(c, F.lit("missing"))))).otherwise(value) if required else value


def whole_points(c: Column) -> Column:
    """A page measure as an integer; null if it has a fraction."""
    return c.try_cast("int")


_TAG = re.compile(r"<(/?)(page|block|line|word)\b([^>]*?)(/?)>", re.I)
_ATTR = re.compile(r"([\w-]+)\s*=\s*[\"']([^\"']*)[\"']")
WORD_ROWS = "path string, page_number int, page_width double, page_height double, block_idx int, line_idx int, word_idx int, text string, x double, y double, width double, height double"


def layout_words(texts: DataFrame) -> DataFrame:
    """The words of layout XHTML (page > block > line > word with xmin..ymax), pages numbered as they come."""

    def rows(path: str, text: str) -> Iterator[tuple]:
        page = block = line = word = -1
        pw = ph = None
        for m in _TAG.finditer(text):
            close, tag, attrs = m.group(1), m.group(2).lower(), dict((k.lower(), v) for k, v in _ATTR.findall(m.group(3)))
            if close:
                continue
            if tag == "page":
                page, block, pw, ph = page + 1, -1, float(attrs["width"]), float(attrs["height"])
            elif tag == "block":
                block, line = block + 1, -1
            elif tag == "line":
                line, word = line + 1, -1
            else:
                word += 1
                x1, y1, x2, y2 = (float(attrs[k]) for k in ("xmin", "ymin", "xmax", "ymax"))
                end = text.find("<", m.end())
                yield path, page + 1, pw, ph, block, line, word, unescape(text[m.end() : end]).strip(), x1, y1, x2 - x1, y2 - y1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in WORD_ROWS.split(", ")]
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b["path"], b["text"]) for r in rows(p, t or "")], columns=names)

    return texts.select("path", "text").mapInPandas(run, WORD_ROWS)


def layout_pages(texts: DataFrame) -> DataFrame:
    """paper_id, page_number, width, height of every page of layout XHTML, those without words too."""
    tags = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)<page\b[^>]*>"), F.lit(0)), lambda t, i: F.struct((i + 1).alias("page_number"), *[F.regexp_extract(t, rf"(?i)\b{k}\s*=\s*[\"']([^\"']*)", 1).try_cast("double").alias(k) for k in ("width", "height")]))
    return texts.select(paper_of(F.col("path")).alias("paper_id"), F.inline(tags))


def paper_words(texts: DataFrame) -> DataFrame:
    """``layout_words`` with paper_id, the columns of a words table."""
    return layout_words(texts).select(paper_of(F.col("path")).alias("paper_id"), "page_number", "block_idx", "line_idx", "word_idx", "text", "x", "y", "width", "height")


def font_texts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts (paper_id, page_number, ord, font_id, text) and the definitions (paper_id, ord, font_id, size, family) of font XML."""
    scan = font_xml(texts).withColumn("paper_id", paper_of(F.col("path")))
    return scan.filter("kind = 'text'").select("paper_id", "page_number", "ord", "font_id", "text"), scan.filter("kind = 'font'").select("paper_id", "ord", "font_id", "size", "family")


FONT_ROWS = "path string, ord int, page_number int, kind string, font_id int, size double, family string, text string"
_FONT_TAG = re.compile(r"<page\b([^>]*)>|<fontspec\b([^>]*?)/?>|<text\b([^>]*)>(.*?)</text>", re.I | re.S)


def font_xml(texts: DataFrame) -> DataFrame:
    """Font definitions and texts of font XML in their order: kind ``font`` or ``text``; missing attributes are 0 and empty."""

    def rows(path: str, text: str) -> Iterator[tuple]:
        page = 0
        for k, m in enumerate(_FONT_TAG.finditer(text)):
            attrs = dict((a.lower(), v) for a, v in _ATTR.findall(m.group(1) or m.group(2) or m.group(3) or ""))
            if m.group(1) is not None:
                page = int(attrs.get("number", 0))
            elif m.group(2) is not None:
                yield path, k, page, "font", int(attrs.get("id", 0)), float(attrs.get("size", 0)), attrs.get("family", ""), None
            else:
                yield path, k, page, "text", int(attrs.get("font", 0)), None, None, unescape(re.sub(r"<[^>]*>", "", m.group(4)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FONT_ROWS.split(", ")]
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b["path"], b["text"]) for r in rows(p, t or "")], columns=names)

    return texts.select("path", "text").mapInPandas(run, FONT_ROWS)
