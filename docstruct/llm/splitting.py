"""Problem 4: oversized texts cut at natural boundaries by structure-tree packing.

A text is read as a tree: sections under headings of six depths, blocks parted
by blank lines, list items nested by their indent, lines, sentences, clauses,
words, characters. Only a node larger than the limit is opened. Bottom-up,
neighbouring siblings that are whole are merged as long as they fit; what an
opened node gave is not merged with its siblings, so no piece joins the end of
one section with the beginning of the next. Levels are opened lazily, so a text
costs time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstruct.llm.sections_io import paragraphs
from docstruct.scale import config_rows

#: Where the children of a node begin, from the top of the tree to its leaves: the end of each match is a cut.
_ITEM = r"(?:[-*•–]|\(?\d+[.)]|\(?\p{Ll}[.)])\s"
LEVELS = [
    # headings: marked by signs, or numbered and alone on their line
    *(regex.compile(rf"\n(?=#{{{d}}}\s|\d+(?:\.\d+){{{d - 1}}}\.?\s+\p{{Lu}}[^.\n]{{0,80}}\n)") for d in range(1, 7)),
    regex.compile(r"\n[^\S\n]*(?:\n\s*)+"),  # blocks
    # list items by their indent
    *(regex.compile(rf"\n(?=[ \t]{{{a},{b}}}{_ITEM})") for a, b in ((0, 1), (2, 3), (4, 5), (6, 1000))),
    regex.compile(r"\n"),  # lines
    regex.compile(r"""[.!?…؟।]+["'”’»“)\]]*(?:\[\d+\])*\s+(?=\P{Ll})|[。！？]+[」』”）]*"""),  # sentences
    regex.compile(r"[,;:،؛]\s+|[、，；：]|\s[–—]\s"),  # clauses
    regex.compile(r"\s+"),  # words
    regex.compile(r"\X"),  # characters as read
]


def _children(text: str, a: int, b: int, level: int) -> list[int]:
    cuts = [m.end() for m in LEVELS[level].finditer(text, a, b)]
    return [c for c in cuts if a < c < b]


def _pack(text: str, a: int, b: int, level: int, first: int, limit: int) -> list[tuple[int, int]]:
    """Pieces that cover [a, b); the piece at position 0 may have ``first`` characters, others ``limit``."""
    room = lambda s: first if s == 0 else limit
    if b - a <= room(a):
        return [(a, b)]
    if level == len(LEVELS):  # a single character as read, longer than the limit: cut it anywhere
        out = []
        while a < b:
            out.append((a, min(b, a + room(a))))
            a = out[-1][1]
        return out
    marks = [a, *_children(text, a, b, level), b]
    out: list[tuple[int, int]] = []
    whole = False  # whether the last piece is made of whole siblings
    for s, e in zip(marks, marks[1:]):
        if whole and e - out[-1][0] <= room(out[-1][0]):
            out[-1] = (out[-1][0], e)
            continue
        pieces = _pack(text, s, e, level + 1, first, limit)
        whole = len(pieces) == 1
        out += pieces
    return out


def split_text(text: str, capacity: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each piece: at most ``capacity`` characters, each piece beginning ``overlap`` before the end of the last."""
    if not 0 <= overlap < capacity:
        raise ValueError("overlap must be at least 0 and smaller than the capacity")
    spans = _pack(text, 0, len(text), 0, capacity, capacity - overlap)
    while len(spans) > 1 and spans[0][1] < overlap:  # too short to be repeated: the next one always fits beside it
        spans[:2] = [(0, spans[1][1])]
    return [(max(0, s - overlap) if k else s, e) for k, (s, e) in enumerate(spans)]


def split_oversized(items: DataFrame, keys: list[str], text: str, capacity: int, overlap: int) -> DataFrame:
    """The pieces of every text longer than ``capacity``: ``keys``, piece_no, start_pos, end_pos, piece.

    Texts within the capacity, null and empty ones give no row, and are dropped
    before Python sees them; repeated rows give repeated pieces. Of consecutive
    pieces the later one begins with the last ``overlap`` characters of the one
    before; without these overlaps the pieces join to the text. A text with no
    boundary at all is cut between characters as read.
    """
    kinds = [T.StructField(k, items.schema[k].dataType) for k in keys]
    schema = T.StructType([*kinds, T.StructField("piece_no", T.IntegerType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), T.StructField("piece", T.StringType())])
    arrow = [pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, nos, starts, ends, parts = [], [], [], [], []
            for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                for no, (s, e) in enumerate(split_text(t, capacity, overlap)):
                    rows.append(i)
                    nos.append(no)
                    starts.append(s)
                    ends.append(e)
                    parts.append(t[s:e])
            take = pa.array(rows, pa.int64())
            cols = [batch.column(k).take(take) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(v, k) for v, k in zip((nos, starts, ends, parts), arrow))], names=schema.names)

    return items.filter(F.length(text) > capacity).select(*keys, F.col(text)).mapInArrow(run, schema)


def split_sections(sections: DataFrame, profiles: DataFrame, profile: str = "section_split") -> DataFrame:
    """Pieces of the paragraphs of ``sections`` that exceed the named profile (unit ``char``).

    Columns as ``split_oversized`` with section_id and item_no as keys. Raises if
    the profile is missing. Rows that repeat a section repeat its pieces.
    """
    found = config_rows(profiles.filter((F.col("profile_name") == profile) & (F.col("unit_name") == "char")).select("capacity", "overlap_size"))
    if len(found) != 1:
        raise ValueError(f"size_profiles must have the profile {profile} once")
    return split_oversized(paragraphs(sections), ["section_id", "item_no"], "text", int(found[0][0]), int(found[0][1] or 0))
