"""Queries over the driver's tables, one or more for each operator of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstruct.functions import geometry as G
from docstruct.functions import text as X
from docstruct.operators import fonts, layout, math_markup, references, sections
from docstruct.plans.corpus import Corpus
from docstruct.scale import cut, distinct_rows, table
from docstruct.sinks import export
from docstruct.sources import formats
from docstruct.streaming.paragraphs import paragraph_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# SQL fragments -------------------------------------------------------------------------------------------------
W = r"\pL\pM\pN\p{Pc}"
S = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
DL = "dl AS (SELECT doc_id, line_no, line FROM (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '')"
PARA = "pa AS (SELECT DISTINCT section_id, item_no, t AS paragraph FROM (SELECT section_id, CAST(generate_subscripts(contents, 1) - 1 AS INTEGER) AS item_no, unnest(contents) AS t FROM sections) WHERE length(t) > 0)"


def white(x: str) -> str:
    return rf"regexp_replace({x}, '^[{S}]+|[{S}]+$', '', 'g')"


def one_blank(x: str) -> str:
    return rf"regexp_replace({x}, '[{S}]+', ' ', 'g')"


def suffix_sql(x: str) -> str:
    for s in sorted(X.HYPHEN_SUFFIXES, key=len, reverse=True):
        for _ in range(2):
            x = rf"regexp_replace({x}, '(^|[^{W}-])([A-Za-z]+){s}($|[^{W}])', '\1\2-{s}\3', 'g')"
    return x


def spacing_sql(x: str) -> str:
    return one_blank(rf"regexp_replace({x}, '(\.)([^{W}])', '\1 \2', 'g')")


def latex_sql(x: str) -> str:
    for k, v in X.LATEX.items():
        x = f"replace({x}, '{k}', '{v}')"
    return x


def trigram_sql(x: str) -> str:
    return f"CASE WHEN length({x}) >= 3 THEN list_distinct(list_transform(generate_series(1, length({x}) - 2), lambda i: substring({x}, i, 3))) WHEN length({x}) > 0 THEN [{x}] ELSE [] END"


CAPTION_SQL = rf"(?i)^(?:fig(?:ure)?\.?[{S}]*\pN+|table\.?[{S}]*\pN+|(?:scheme|algorithm)\.?[{S}]*\pN+|listing\.?[{S}]*\pN+|(?:appendix[{S}]+)?(?:fig(?:ure)?|table)\.?[{S}]*[a-z]?\pN+)"
BB, BE = rf"(?:^|[^{W}])", rf"(?:$|[^{W}])"
STRUCTURE_SQL = "|".join(p.replace(r"\s", f"[{S}]").replace(r"\d", r"\p{Nd}") for p in [
    X.MATH_STRUCTURES[0], X.MATH_STRUCTURES[1], rf"{BB}\d{{1,3}}\s*/\s*\d{{1,3}}{BE}", X.MATH_STRUCTURES[3], f"{BB}(?:sum|prod|lim){BE}",
    X.MATH_STRUCTURES[5].replace(r"\b", BB), X.MATH_STRUCTURES[6], X.MATH_STRUCTURES[7], rf"{BB}[a-zA-Z]\s*/\s*[a-zA-Z]{BE}", X.MATH_STRUCTURES[9],
])
MATH_SQL = f"(regexp_matches(%s, '[{X.MATH_CHARS}]') OR regexp_matches(%s, '{STRUCTURE_SQL}'))"
WORDS = f"w AS (SELECT DISTINCT paper_id, page_number, block_idx, line_idx, word_idx, {white('text')} AS text, CAST(x AS DOUBLE) x, CAST(y AS DOUBLE) y, CAST(width AS DOUBLE) width, CAST(height AS DOUBLE) height FROM words WHERE {white('text')} <> '')"
LINES = WORDS + ", ln AS (SELECT paper_id, page_number, block_idx, line_idx, string_agg(text, ' ' ORDER BY word_idx, text) AS text, min(x) x1, min(y) y1, max(x + width) x2, max(y + height) y2, max(height) font_size, count(*) n_words FROM w GROUP BY ALL)"
FOLD = "regexp_replace(regexp_replace(string_agg(text, chr(10) ORDER BY line_idx), '-+\\n', '', 'g'), '\\n', ' ', 'g')"
BLOCKS = LINES + f", bk AS (SELECT paper_id, page_number, block_idx, {white(suffix_sql(white(FOLD)))} AS text, min(x1) x1, min(y1) y1, max(x2) x2, max(y2) y2, count(*) n_lines, avg(x2 - x1) line_width, max(font_size) font_size FROM ln GROUP BY ALL)"
# lines as real papers have them: numbered titles, anchor words, a bare number; text by page of the lines in a large font
_HEADS = ["Abstract", "1. Introduction", "2. ", "3 ", "42", "7. References"]
_PICK = "CASE WHEN font_size <= 12 THEN text WHEN page_number % 6 IN (2, 3) THEN CASE page_number % 6 WHEN 2 THEN '2. ' ELSE '3 ' END || text WHEN page_number % 6 = 5 AND paper_id % 2 = 0 THEN '7. References' WHEN page_number % 6 = 4 THEN '42' WHEN page_number % 6 = 1 THEN CASE WHEN paper_id % 3 = 0 THEN 'Abstract' ELSE '1. Introduction' END ELSE text END"
HEADED = LINES.replace(", ln AS (", ", ln0 AS (") + f", ln AS (SELECT paper_id, page_number, block_idx, line_idx, {_PICK} AS text, x1, y1, x2, y2, font_size, n_words FROM ln0)"
HEADED_BLOCKS = HEADED + BLOCKS.removeprefix(LINES)
SIZES = ", sz AS (SELECT paper_id, page_number, max(CAST(width AS DOUBLE)) page_width, max(CAST(height AS DOUBLE)) page_height FROM paper_pages SEMI JOIN (SELECT DISTINCT paper_id, page_number FROM ln) q USING (paper_id, page_number) GROUP BY ALL)"
EXTENTS = ", ex AS (SELECT paper_id, page_number, min(y1) top, max(y2) bottom, min(x1) \"left\", max(x2) \"right\" FROM ln GROUP BY ALL)"
AREA = SIZES + EXTENTS + """, md AS (SELECT paper_id, median("left") l, median(top) t, median("right") r, median(bottom) b FROM ex GROUP BY ALL),
fp AS (SELECT paper_id, min_by(page_width, page_number) w, min_by(page_height, page_number) h FROM sz GROUP BY ALL),
ar0 AS (SELECT coalesce(fp.paper_id, md.paper_id) paper_id, coalesce(w, 595.0) w, coalesce(h, 842.0) h, l, t, r, b FROM fp FULL JOIN md ON fp.paper_id = md.paper_id),
ar AS (SELECT paper_id, CASE WHEN bad THEN 0.0 ELSE l END ax1, CASE WHEN bad THEN 0.0 ELSE t END ay1, CASE WHEN bad THEN w ELSE r END ax2, CASE WHEN bad THEN h ELSE b END ay2 FROM (SELECT *, (t IS NULL OR b - t < 0.2 * h OR r - l < 0.2 * w) bad FROM ar0))"""
_KIND = "(page_number + block_idx) % 3"
FONTS = HEADED + f""", tx AS (SELECT paper_id, page_number, (CAST(page_number AS BIGINT) * 100000 + block_idx) * 10000 + line_idx AS ord, CAST(round(font_size * 10) AS INTEGER) * 10 + {_KIND} AS font_id, text FROM ln),
fs AS (SELECT DISTINCT paper_id, CAST(round(font_size * 10) AS INTEGER) * 10 + {_KIND} AS font_id, CASE WHEN font_size > 12 AND {_KIND} = 2 THEN font_size + 0.5 ELSE font_size END AS size, ['Times', 'Times-Bold', 'Arial Black'][{_KIND} + 1] AS family FROM ln)"""
USAGE = FONTS + ", us AS (SELECT paper_id, font_id, CAST(sum(length(text)) AS BIGINT) n_chars FROM tx GROUP BY ALL)"
BODY = USAGE + ", bf AS (SELECT u.paper_id, u.font_id body_font_id, coalesce(fs.size, 0.0) body_size FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY n_chars DESC, font_id) k FROM us) u LEFT JOIN fs ON u.paper_id = fs.paper_id AND u.font_id = fs.font_id WHERE k = 1)"
ANCHOR_LIST = "(" + ", ".join(f"'{w}'" for w in X.ANCHOR_WORDS) + ")"
NUMBER = rf"regexp_replace(%s, '^\p{{Nd}}+\.?[{S}]*', '')"
ANCHORS = BODY + f", an AS (SELECT DISTINCT paper_id, font_id FROM tx WHERE lower(text) IN {ANCHOR_LIST} OR {NUMBER % 'lower(text)'} IN {ANCHOR_LIST})"
SCORES = ANCHORS + ", sc AS (SELECT fs.paper_id, fs.font_id, fs.size, body_size, an.font_id IS NOT NULL is_anchor, CASE WHEN body_size > 0 AND size > body_size THEN 1.0 WHEN body_size > 0 AND size < body_size THEN -1.0 ELSE 0.0 END + CASE WHEN contains(lower(family), 'bold') OR contains(lower(family), 'black') THEN 0.3 ELSE 0.0 END + CASE WHEN an.font_id IS NOT NULL THEN 0.5 ELSE 0.0 END AS score FROM fs JOIN bf USING (paper_id) LEFT JOIN an ON fs.paper_id = an.paper_id AND fs.font_id = an.font_id)"
TFONTS = SCORES + ", tf AS (SELECT paper_id, font_id FROM (SELECT *, min(CASE WHEN is_anchor AND size > body_size THEN size END) OVER (PARTITION BY paper_id) least FROM sc WHERE score >= 1.0) WHERE least IS NULL OR abs(size - least) < 0.1)"
TITLES = TFONTS + f""", pe AS (SELECT tx.paper_id, page_number, ord, {NUMBER % 'text'} AS title FROM tx JOIN tf USING (paper_id, font_id) WHERE NOT regexp_matches(text, '^\\p{{Nd}}+$')),
ab AS (SELECT paper_id, min(ord) abstract_ord FROM tx WHERE lower(text) = 'abstract' GROUP BY ALL),
pf AS (SELECT pe.*, abstract_ord, min(CASE WHEN lower(title) IN {ANCHOR_LIST} THEN ord END) OVER (PARTITION BY pe.paper_id) anchor_ord FROM pe LEFT JOIN ab USING (paper_id)),
ti AS (SELECT paper_id, page_number, ord, title FROM pf WHERE ord >= coalesce(abstract_ord, anchor_ord)
  UNION ALL SELECT DISTINCT paper_id, 1, -1, 'Abstract' FROM pf WHERE abstract_ord IS NULL AND ord = anchor_ord AND page_number > 1)"""
# every large-font line is a title of its page, without its number
BIG = f", bt AS (SELECT DISTINCT paper_id, page_number, {NUMBER % 'text'} AS title FROM ln WHERE font_size > 12)"


def _lines_of_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return docs.filter(F.trim("line") != "")


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sections").select("section_id", F.posexplode("contents").alias("item_no", "paragraph"))
    return s.filter(F.length("paragraph") > 0).distinct()


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.lines(table(spark, d, "words"))


def _big_titles(line_rows: DataFrame) -> DataFrame:
    return line_rows.filter("font_size > 12").select("paper_id", "page_number", X.strip_title_number(F.col("text")).alias("title")).distinct()


def _headed(spark: SparkSession, d: str) -> DataFrame:
    """The lines with titles as real papers have them; see ``_PICK``."""
    return _lines(spark, d).withColumn("text", F.expr(_PICK))


def _fonts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Texts and fonts of the headed lines, each size in three families."""
    rows, kind = _headed(spark, d), (F.col("page_number") + F.col("block_idx")) % 3
    font = (F.round(F.col("font_size") * 10).cast("int") * 10 + kind).cast("int").alias("font_id")
    size = F.when((F.col("font_size") > 12) & (kind == 2), F.col("font_size") + 0.5).otherwise(F.col("font_size"))
    family = F.element_at(F.array(F.lit("Times"), F.lit("Times-Bold"), F.lit("Arial Black")), kind.cast("int") + 1)
    order = (F.col("page_number").cast("long") * 100_000 + F.col("block_idx")) * 10_000 + F.col("line_idx")
    return rows.select("paper_id", "page_number", order.alias("ord"), font, "text"), rows.select("paper_id", font, size.alias("size"), family.alias("family")).distinct()


def _boxes(line_rows: DataFrame) -> DataFrame:
    """Table boxes where no page images are: blocks that hold numbers only."""
    b = layout.blocks(line_rows).filter(~F.col("text").rlike(r"[^0-9. ]") & (F.col("x2") - F.col("x1") > 60))
    return b.select("paper_id", "page_number", "x1", "y1", "x2", "y2")


BOXES = ", bx AS (SELECT paper_id, page_number, x1, y1, x2, y2 FROM bk WHERE NOT regexp_matches(text, '[^0-9. ]') AND x2 - x1 > 60)"


def _corpus(spark: SparkSession, d: str) -> Corpus:
    titles = lambda rows: _big_titles(rows).withColumn("ord", F.col("page_number").cast("long"))
    return Corpus.from_lines(_headed(spark, d), table(spark, d, "paper_pages"), titles).text_area()


# text ----------------------------------------------------------------------------------------------------------
@query(f"WITH {DL} SELECT doc_id, line_no, {suffix_sql('line')} AS fixed FROM dl")
def suffix_hyphens(spark, d):
    return _lines_of_documents(spark, d).select("doc_id", "line_no", X.suffix_hyphens(F.col("line")).alias("fixed"))


@query(f"WITH {DL} SELECT doc_id, line_no, {spacing_sql('line')} AS spaced FROM dl")
def sentence_spacing(spark, d):
    return _lines_of_documents(spark, d).select("doc_id", "line_no", X.sentence_spacing(F.col("line")).alias("spaced"))


_NORM = white(one_blank(r"regexp_replace(lower(line), '[!-/:-@\[-\x60{-~]', ' ', 'g')"))


@query(f"WITH {DL} SELECT doc_id, line_no, replace({_NORM}, 'ς', 'σ') AS normal FROM dl")
def normalize_match(spark, d):
    return _lines_of_documents(spark, d).select("doc_id", "line_no", F.replace(X.normalize_for_matching(F.col("line")), F.lit("ς"), F.lit("σ")).alias("normal"))


@query(rf"WITH {DL} SELECT doc_id, line_no, {NUMBER % 'line'} AS as_title, regexp_replace(line, '\p{{Nd}}+\.', '') AS as_line FROM dl")
def number_strip(spark, d):
    return _lines_of_documents(spark, d).select("doc_id", "line_no", X.strip_title_number(F.col("line")).alias("as_title"), X.strip_first_number(F.col("line")).alias("as_line"))


_PREFIXES = ["Figure 3: ", "Tab. 2 ", "ALGORITHM 1. ", "see Figure 1 ", "Appendix Table B2. ", ""]
_PREFIX_SQL = "[" + ", ".join(f"'{p}'" for p in _PREFIXES) + "][CAST(doc_id % 6 AS INTEGER) + 1] || line"


@query(f"WITH {DL} SELECT doc_id, line_no, regexp_matches({white(_PREFIX_SQL)}, '{CAPTION_SQL}') AS is_caption FROM dl")
def caption_flags(spark, d):
    prefix = F.element_at(F.array(*[F.lit(p) for p in _PREFIXES]), (F.col("doc_id") % 6).cast("int") + 1)
    return _lines_of_documents(spark, d).select("doc_id", "line_no", X.is_caption(F.concat(prefix, "line")).alias("is_caption"))


@query(f"WITH {PARA} SELECT section_id, item_no, md5(paragraph) AS h, {MATH_SQL % ('paragraph', 'paragraph')} AS has_math FROM pa")
def contains_math(spark, d):
    return _paragraphs(spark, d).select("section_id", "item_no", F.md5("paragraph").alias("h"), X.contains_math(F.col("paragraph")).alias("has_math"))


_PLAIN = r"regexp_replace(regexp_replace(paragraph, '\p{Nd}', '0', 'g'), '[\pL\pM\p{Nl}\p{No}\p{Pc}]', 'a', 'g')"
_CNT = "len(regexp_extract_all({x}, '{p}')) / length(paragraph) * {k}"
_DENSITY = " + ".join(f"least({_CNT.format(x=x, p=p, k=k)}, {m})" for x, p, k, m in [
    ("paragraph", "[∀-⋿←-⇿⨀-⫿±×÷]", 50.0, 0.3), (_PLAIN, rf"(?:\b\w\b[{S}]){{3,}}", 100.0, 0.3), (_PLAIN, rf"0+[{S}]*/[{S}]*0+", 100.0, 0.2), ("paragraph", "[₀-₉⁰-⁹]", 100.0, 0.2)])


@query(f"WITH {PARA} SELECT section_id, item_no, md5(paragraph) AS h, round(least({_DENSITY}, 1.0), 6) AS density FROM pa")
def math_density(spark, d):
    return _paragraphs(spark, d).select("section_id", "item_no", F.md5("paragraph").alias("h"), F.round(X.math_density(F.col("paragraph")), 6).alias("density"))


@query(rf"""WITH {DL} SELECT doc_id, line_no, regexp_replace(regexp_replace(l, '\$\$([^$]+)\$\$', '<math display="block">\1</math>', 'g'), '\$([^$]+)\$', '<math>\1</math>', 'g') AS tagged FROM (SELECT doc_id, line_no, line || ' $a_' || doc_id || '$ and $$b$$ $' AS l FROM dl)""")
def latex_tags(spark, d):
    text = F.concat("line", F.lit(" $a_"), F.col("doc_id").cast("string"), F.lit("$ and $$b$$ $"))
    return _lines_of_documents(spark, d).select("doc_id", "line_no", X.latex_to_math_tags(text).alias("tagged"))


@query(f"""WITH {PARA} SELECT section_id, item_no, md5(paragraph) AS h, md5('α ' || CASE WHEN item_no % 2 = 0 THEN '<math>' ELSE '<math display="block">' END || {latex_sql("replace(paragraph, '<', ' ')")} || '</math> ≤') AS latex FROM pa""")
def unicode_latex(spark, d):
    tag = F.when(F.col("item_no") % 2 == 0, F.lit("<math>")).otherwise(F.lit('<math display="block">'))
    text = F.concat(F.lit("α "), tag, F.replace("paragraph", F.lit("<"), F.lit(" ")), F.lit("</math> ≤"))
    return _paragraphs(spark, d).select("section_id", "item_no", F.md5("paragraph").alias("h"), F.md5(X.unicode_math_to_latex(text)).alias("latex"))


@query(f"WITH {DL} SELECT doc_id, line_no, CAST(len(g) AS INTEGER) AS n, md5(array_to_string(list_sort(g), '|')) AS grams FROM (SELECT doc_id, line_no, {trigram_sql('line')} AS g FROM dl)")
def trigram_set(spark, d):
    g = _lines_of_documents(spark, d).select("doc_id", "line_no", X.trigrams(F.col("line")).alias("g"))
    return g.select("doc_id", "line_no", F.size("g").alias("n"), F.md5(F.array_join(F.array_sort("g"), "|")).alias("grams"))


_BIB = "b AS (SELECT DISTINCT ref_id, title, raw_text FROM bib_entries WHERE title IS NOT NULL AND raw_text IS NOT NULL)"


@query(f"WITH {_BIB} SELECT ref_id, md5(raw_text) AS h, round(len(list_intersect(a, c)) / len(list_distinct(list_concat(a, c))), 6) AS jaccard FROM (SELECT ref_id, raw_text, {trigram_sql('title')} AS a, {trigram_sql('raw_text')} AS c FROM b)")
def trigram_jaccard(spark, d):
    b = distinct_rows(table(spark, d, "bib_entries").select("ref_id", "title", "raw_text").dropna(), "ref_id")
    return b.select("ref_id", F.md5("raw_text").alias("h"), F.round(X.trigram_jaccard(F.col("title"), F.col("raw_text")), 6).alias("jaccard"))


@query()
def best_alignment(spark, d):
    b = distinct_rows(table(spark, d, "bib_entries").select("ref_id", "title", "raw_text").dropna(), "ref_id")
    return b.select("ref_id", math_markup.aligned(F.col("title"), F.col("raw_text")).alias("s")).select("ref_id", "s.start", "s.end")


@query()
def math_markup_text(spark, d):
    return math_markup.heuristic_markup(_paragraphs(spark, d), "paragraph").select("section_id", "item_no", "math_text")


@query()
def align_blocks(spark, d):
    # written once, since the texts and the blocks they meet are both made of them
    b = cut(layout.blocks(_lines(spark, d)).select(*layout.BLOCK, "text")).repartition(*layout.PAGE)
    texts = layout.page_text(b.withColumn("text", F.regexp_replace("text", "e", "é")))
    return math_markup.align_paragraphs(texts, b)


# lines, blocks, pages --------------------------------------------------------------------------------------------
@query(f"WITH {LINES} SELECT paper_id, page_number, block_idx, line_idx, text, x1, y1, x2, y2, n_words FROM ln")
def line_text(spark, d):
    return _lines(spark, d).select("paper_id", "page_number", "block_idx", "line_idx", "text", "x1", "y1", "x2", "y2", "n_words")


@query(f"WITH {BLOCKS} SELECT paper_id, page_number, block_idx, text, n_lines, round(line_width, 4) AS line_width FROM bk")
def block_text(spark, d):
    return layout.blocks(_lines(spark, d)).select("paper_id", "page_number", "block_idx", "text", "n_lines", F.round("line_width", 4).alias("line_width"))


@query(f"WITH {BLOCKS} SELECT paper_id, page_number, string_agg(text || chr(10) || chr(10), '' ORDER BY block_idx) AS text FROM bk GROUP BY ALL")
def page_text(spark, d):
    return layout.page_text(layout.blocks(_lines(spark, d)))


@query("SELECT DISTINCT section_id, coalesce(array_to_string(contents, chr(10)), '') AS text, CASE WHEN len(math_contents) > 0 THEN array_to_string(math_contents, chr(10)) ELSE coalesce(array_to_string(contents, chr(10)), '') END AS math_text FROM sections")
def section_text(spark, d):
    return table(spark, d, "sections").select("section_id", sections.section_text().alias("text"), sections.section_math_text().alias("math_text")).distinct()


@query(f"WITH {LINES} SELECT paper_id, page_number, block_idx, line_idx, x2 - x1 AS width, y2 - y1 AS height, round((x2 - x1) * (y2 - y1), 4) AS area, font_size FROM ln")
def rect_measures(spark, d):
    r = G.Rect.of()
    return _lines(spark, d).select("paper_id", "page_number", "block_idx", "line_idx", G.width(r).alias("width"), G.height(r).alias("height"), F.round(G.area(r), 4).alias("area"), "font_size")


_PAIRS = "FROM bk a JOIN bk b ON a.paper_id = b.paper_id AND a.page_number = b.page_number AND a.block_idx < b.block_idx"
_OVER = "a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2"
_IX = "(least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_AA, _AB = "((a.x2 - a.x1) * (a.y2 - a.y1))", "((b.x2 - b.x1) * (b.y2 - b.y1))"


@query(f"WITH {BLOCKS} SELECT a.paper_id, a.page_number, a.block_idx AS block_a, b.block_idx AS block_b, round({_IX}, 4) AS shared, round({_IX} / ({_AA} + {_AB} - {_IX}), 6) AS iou, {_IX} / {_AA} > 0.3 AS a_covered {_PAIRS} AND {_OVER}")
def rect_overlap_join(spark, d):
    b = layout.blocks(_lines(spark, d)).select("paper_id", "page_number", "block_idx", "x1", "y1", "x2", "y2")
    left = b.select("paper_id", "page_number", F.col("block_idx").alias("block_a"), *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    right = b.select("paper_id", "page_number", F.col("block_idx").alias("block_b"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    ra, rb = G.Rect.of("a_"), G.Rect.of("b_")
    j = left.join(right, ["paper_id", "page_number"]).filter((F.col("block_a") < F.col("block_b")) & G.overlaps(ra, rb))
    return j.select("paper_id", "page_number", "block_a", "block_b", F.round(G.area(G.intersection(ra, rb)), 4).alias("shared"), F.round(G.iou(ra, rb), 6).alias("iou"), G.covered(ra, rb).alias("a_covered"))


_COVER = f"((least(a.x2, b.x2) - greatest(a.x1, b.x1)) > 0 AND (least(a.y2, b.y2) - greatest(a.y1, b.y1)) > 0 AND {_IX} / {_AA} > 0.3)"
_AS_TITLE = f"lower({white(NUMBER % one_blank('a.text'))})"


@query(f"WITH {HEADED_BLOCKS}{BOXES}{BIG} SELECT a.paper_id, a.page_number, a.block_idx, a.line_idx FROM ln a WHERE EXISTS (SELECT 1 FROM bt WHERE bt.paper_id = a.paper_id AND lower(bt.title) = {_AS_TITLE}) OR NOT EXISTS (SELECT 1 FROM bx b WHERE b.paper_id = a.paper_id AND b.page_number = a.page_number AND {_COVER})")
def rect_cover_antijoin(spark, d):
    rows = _headed(spark, d)
    return layout.without_tables(rows, _boxes(rows), _big_titles(rows)).select("paper_id", "page_number", "block_idx", "line_idx")


@query(f"WITH {LINES}{EXTENTS} SELECT * FROM ex")
def page_extents(spark, d):
    return layout.page_extents(_lines(spark, d))


@query(f"WITH {LINES}{AREA} SELECT * FROM ar")
def text_area(spark, d):
    rows = _lines(spark, d)
    return layout.text_area(rows, layout.live_pages(table(spark, d, "paper_pages"), rows))


_IOU_AREA = "CASE WHEN least(ax2, x2) - greatest(ax1, x1) <= 0 OR least(ay2, y2) - greatest(ay1, y1) <= 0 THEN 0 ELSE (least(ax2, x2) - greatest(ax1, x1)) * (least(ay2, y2) - greatest(ay1, y1)) / ((ax2 - ax1) * (ay2 - ay1) + (x2 - x1) * (y2 - y1) - (least(ax2, x2) - greatest(ax1, x1)) * (least(ay2, y2) - greatest(ay1, y1))) END"
IN_AREA = f", ia AS (SELECT bk.* FROM bk JOIN ar USING (paper_id) WHERE abs({_IOU_AREA}) >= 1e-6)"


@query(f"WITH {BLOCKS}{AREA}{IN_AREA} SELECT paper_id, page_number, block_idx FROM ia")
def text_area_filter(spark, d):
    rows = _lines(spark, d)
    return layout.in_text_area(layout.blocks(rows), layout.text_area(rows, table(spark, d, "paper_pages"))).select("paper_id", "page_number", "block_idx")


SMALL = BIG + r""", sb AS (SELECT a.* FROM ia a LEFT JOIN sz ON a.paper_id = sz.paper_id AND a.page_number = sz.page_number WHERE NOT EXISTS (SELECT 1 FROM bt WHERE bt.paper_id = a.paper_id) OR EXISTS (SELECT 1 FROM bt WHERE bt.paper_id = a.paper_id AND lower(bt.title) = lower("""+white(r"regexp_replace(a.text, '\p{Nd}+\.', '')")+r""")) OR NOT ((x2 - x1) / (coalesce(page_width, 595.0) / 1.1) < 0.3 AND n_lines < 4))"""


@query(f"WITH {HEADED_BLOCKS}{AREA}{IN_AREA}{SMALL} SELECT paper_id, page_number, block_idx FROM sb")
def small_block_filter(spark, d):
    return _corpus(spark, d).blocks.select("paper_id", "page_number", "block_idx")


COLUMNS = """, lp AS (SELECT paper_id, max(page_number) last_page FROM bt GROUP BY ALL),
pm AS (SELECT sz.paper_id, sz.page_number, page_width, CASE WHEN sz.page_number <= last_page THEN coalesce(m, CAST('nan' AS DOUBLE)) ELSE 0.0 END u FROM sz JOIN lp USING (paper_id) LEFT JOIN (SELECT paper_id, page_number, avg(line_width) m FROM sb GROUP BY ALL) q ON sz.paper_id = q.paper_id AND sz.page_number = q.page_number),
pc AS (SELECT paper_id, sum(u) / count(*) lw, min_by(page_width, page_number) pw FROM pm GROUP BY ALL),
nc AS (SELECT paper_id, CASE WHEN NOT isnan(lw) AND lw < pw / 1.5 THEN 2 ELSE 1 END number_of_columns, pw FROM pc UNION ALL SELECT paper_id, 1, min_by(page_width, page_number) FROM sz WHERE paper_id NOT IN (SELECT paper_id FROM pc) GROUP BY paper_id)"""


@query(f"WITH {HEADED_BLOCKS}{AREA}{IN_AREA}{SMALL}{COLUMNS} SELECT paper_id, number_of_columns FROM nc")
def column_detect(spark, d):
    c = _corpus(spark, d)
    return layout.column_counts(c.blocks, c.pages, c.titles).select("paper_id", "number_of_columns")


PLACED = ", pl AS (SELECT sb.*, row_number() OVER (PARTITION BY sb.paper_id, sb.page_number ORDER BY CASE WHEN number_of_columns = 2 AND x1 > pw / 2.2 THEN 1 ELSE 0 END, block_idx) - 1 AS place FROM sb JOIN nc USING (paper_id))"


@query(f"WITH {HEADED_BLOCKS}{AREA}{IN_AREA}{SMALL}{COLUMNS}{PLACED} SELECT paper_id, page_number, block_idx, CAST(place AS INTEGER) AS place FROM pl")
def column_order(spark, d):
    c = _corpus(spark, d)
    return layout.column_order(c.blocks, layout.column_counts(c.blocks, c.pages, c.titles)).select("paper_id", "page_number", "block_idx", "place")


@query("""WITH RECURSIVE lv AS (SELECT l_orderkey AS page_id, 50.0 AS x1, CAST(l_linenumber * 40 AS DOUBLE) AS y, 50.0 + CAST(l_quantity AS DOUBLE) * 8 AS x2, floor(CAST(l_quantity AS DOUBLE) * 8) AS len FROM lineitem WHERE floor(CAST(l_quantity AS DOUBLE) * 8) >= 153),
ky AS (SELECT page_id, min(len) AS k FROM lv GROUP BY page_id UNION ALL SELECT page_id, k FROM (SELECT ky.page_id, min(lv.len) AS k FROM ky JOIN lv ON lv.page_id = ky.page_id AND lv.len >= ky.k + 3 GROUP BY ky.page_id, ky.k))
SELECT page_id, x1, y1, x2, y2 FROM (SELECT lv.page_id, k, count(*) n, min(x1) x1, min(y) y1, max(x2) x2, max(y) y2 FROM lv JOIN ky ON lv.page_id = ky.page_id AND lv.len >= k AND lv.len - k < 3 GROUP BY lv.page_id, k) WHERE n >= 3 AND (x2 - x1) * (y2 - y1) / (612.0 * 792.0) <= 0.5""")
def ruling_tables(spark, d):
    li = table(spark, d, "lineitem")
    y = (F.col("l_linenumber") * 40).cast("double")
    seg = li.select(F.col("l_orderkey").alias("page_id"), F.lit(50.0).alias("x1"), y.alias("y1"), (F.lit(50.0) + F.col("l_quantity") * 8).alias("x2"), y.alias("y2"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"))
    return layout.ruling_tables(seg)


@query(f"WITH {BLOCKS}, pt AS (SELECT paper_id, page_number, string_agg(text || chr(10) || chr(10), '' ORDER BY block_idx) AS paragraph FROM bk GROUP BY ALL) SELECT paper_id, page_number, round(least({_DENSITY}, 1.0), 6) AS density, least({_DENSITY}, 1.0) >= 0.002 AS is_dense FROM pt")
def page_density(spark, d):
    t = layout.page_text(layout.blocks(_lines(spark, d)))
    dense = math_markup.dense_pages(t, 0.002).select("paper_id", "page_number", F.lit(True).alias("is_dense"))
    return t.join(dense, ["paper_id", "page_number"], "left").select("paper_id", "page_number", F.round(X.math_density(F.col("text")), 6).alias("density"), F.coalesce("is_dense", F.lit(False)).alias("is_dense"))


# fonts -----------------------------------------------------------------------------------------------------------
@query(f"WITH {USAGE} SELECT * FROM us")
def font_usage(spark, d):
    return fonts.font_usage(_fonts(spark, d)[0])


@query(f"WITH {BODY} SELECT * FROM bf")
def body_font(spark, d):
    return fonts.body_font(*_fonts(spark, d))


@query(f"WITH {ANCHORS} SELECT * FROM an")
def anchor_fonts(spark, d):
    return fonts.anchor_fonts(_fonts(spark, d)[0])


@query(f"WITH {SCORES} SELECT paper_id, font_id, size, is_anchor, CAST(score AS DOUBLE) AS score FROM sc")
def font_scores(spark, d):
    return fonts.font_scores(*_fonts(spark, d)).drop("body_size")


@query(f"WITH {TFONTS} SELECT * FROM tf")
def title_fonts(spark, d):
    return fonts.title_fonts(*_fonts(spark, d))


@query(f"WITH {TITLES} SELECT paper_id, CAST(page_number AS INTEGER) AS page_number, CAST(ord AS BIGINT) AS ord, title FROM ti")
def section_titles(spark, d):
    return fonts.section_titles(*_fonts(spark, d))


# sections --------------------------------------------------------------------------------------------------------
ASSIGNED = rf""", la AS (SELECT ln.paper_id, ln.page_number, pl.place, line_idx, ln.text FROM ln JOIN pl ON ln.paper_id = pl.paper_id AND ln.page_number = pl.page_number AND ln.block_idx = pl.block_idx),
lm AS (SELECT la.*, CASE WHEN EXISTS (SELECT 1 FROM bt WHERE bt.paper_id = la.paper_id AND bt.page_number = la.page_number AND lower(bt.title) = lower({white("regexp_replace(la.text, '\\p{Nd}+\\.', '')")})) THEN {white("regexp_replace(la.text, '\\p{Nd}+\\.', '')")} END AS mark FROM la),
ls AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY page_number, place, line_idx ROWS UNBOUNDED PRECEDING) state FROM lm),
lb AS (SELECT paper_id, page_number, place, arg_max_null(state, line_idx) state FROM ls GROUP BY ALL),
ob AS (SELECT pl.paper_id, CAST(pl.page_number AS BIGINT) * 1000000 + pl.place AS ord, pl.page_number, pl.block_idx, pl.text, CASE WHEN NOT EXISTS (SELECT 1 FROM bt WHERE bt.paper_id = pl.paper_id) THEN 'Content' ELSE coalesce(state, 'Abstract') END AS section, CASE WHEN regexp_matches({white('pl.text')}, '{CAPTION_SQL}') THEN 'Caption' ELSE 'Body' END AS block_type FROM pl JOIN lb USING (paper_id, page_number, place))"""
ORDERED = f"{HEADED_BLOCKS}{AREA}{IN_AREA}{SMALL}{COLUMNS}{PLACED}{ASSIGNED}"


@query(f"WITH {ORDERED} SELECT paper_id, ord, page_number, block_idx, section, block_type FROM ob")
def section_assign(spark, d):
    return _corpus(spark, d).ordered_blocks().select("paper_id", "ord", "page_number", "block_idx", "section", "block_type")


CHAINS = """, ch AS (SELECT *, coalesce(sum(CASE WHEN text LIKE '%-' THEN 0 ELSE 1 END) OVER (PARTITION BY paper_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) chain FROM ob),
mg AS (SELECT paper_id, max(CASE WHEN text NOT LIKE '%-' THEN ord END) AS ord, string_agg(CASE WHEN text LIKE '%-' THEN regexp_replace(text, '-+$', '') ELSE text END, '' ORDER BY ord) AS text, max(CASE WHEN text NOT LIKE '%-' THEN section END) AS section, max(CASE WHEN text NOT LIKE '%-' THEN block_type END) AS block_type FROM ch GROUP BY paper_id, chain HAVING max(CASE WHEN text NOT LIKE '%-' THEN 1 ELSE 0 END) = 1)"""


@query(f"WITH {ORDERED}{CHAINS} SELECT paper_id, ord, text, section, block_type FROM mg")
def hyphen_merge(spark, d):
    return sections.merge_hyphen_chains(_corpus(spark, d).ordered_blocks())


SECTIONS = f""", sp AS (SELECT *, {spacing_sql('text')} AS paragraph FROM mg),
sg AS (SELECT paper_id, section, min(ord) first_any, min(CASE WHEN block_type = 'Body' THEN ord END) first_body, coalesce(list(paragraph ORDER BY ord) FILTER (block_type = 'Body'), []) contents, coalesce(list(paragraph ORDER BY ord) FILTER (block_type = 'Caption'), []) captions FROM sp GROUP BY ALL),
sx AS (SELECT a.*, (SELECT count(*) FROM sg b WHERE b.paper_id = a.paper_id AND b.section <> a.section AND b.first_any < coalesce(a.first_body, a.first_any)) + CASE WHEN first_body IS NOT NULL AND first_any < first_body THEN 1 ELSE 0 END AS tied FROM sg a)"""


@query(f"WITH {ORDERED}{CHAINS}{SECTIONS} SELECT paper_id, CAST(tied AS SMALLINT) AS \"index\", section AS title, contents, captions FROM sx")
def sections_table(spark, d):
    return _corpus(spark, d).sections().select("paper_id", "index", "title", "contents", "captions")


@query(f"WITH {ORDERED}{CHAINS}{SECTIONS} SELECT paper_id, section AS title, list_concat(contents, captions) AS contents FROM sx")
def captions_merged(spark, d):
    return sections.with_captions(_corpus(spark, d).sections()).select("paper_id", "title", "contents")


@query()
def sections_math(spark, d):
    return _corpus(spark, d).sections(math=True)


@query()
def sections_json(spark, d):
    return _corpus(spark, d).papers()


@query()
def legacy_json(spark, d):
    return export.legacy_json(_corpus(spark, d).sections())


@query()
def paper_output(spark, d):
    refs = table(spark, d, "bib_entries").select("paper_id", "entry_no", F.struct("raw_text", "authors", "title", F.col("pub_year").alias("year"), "venue", "doi", "url", "arxiv_id", "volume", "pages").alias("r")).distinct()
    listed = refs.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry_no", F.to_json("r").alias("k"), "r"))), lambda s: s["r"]).alias("references"))
    return export.paper_output(_corpus(spark, d).sections(), listed)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    # headings where every tenth block of a paper would have one: a reference section, and a bare heading
    b = layout.blocks(_lines(spark, d))
    order = F.col("page_number").cast("long") * 1000 + F.col("block_idx")
    text = F.when((F.col("paper_id") % 2 == 0) & (F.col("page_number") == 3) & (F.col("block_idx") == 1), F.lit(" References ")).when((F.col("paper_id") % 2 == 1) & (F.col("page_number") == 4) & (F.col("block_idx") == 0), F.lit("Bibliography")).otherwise(F.col("text"))
    section = F.when((F.col("paper_id") % 2 == 1) & (F.col("page_number") == 4), F.lit("BIBLIOGRAPHY")).otherwise(F.lit("Body"))
    return b.select("paper_id", order.alias("ord"), text.alias("text"), section.alias("section"))


@query(f"""WITH {BLOCKS}, lab AS (SELECT paper_id, CAST(page_number AS BIGINT) * 1000 + block_idx AS ord, CASE WHEN paper_id % 2 = 0 AND page_number = 3 AND block_idx = 1 THEN ' References ' WHEN paper_id % 2 = 1 AND page_number = 4 AND block_idx = 0 THEN 'Bibliography' ELSE text END AS text, CASE WHEN paper_id % 2 = 1 AND page_number = 4 THEN 'BIBLIOGRAPHY' ELSE 'Body' END AS section FROM bk),
lh AS (SELECT *, lower(section) IN ('references', 'bibliography') inside, lower({white('text')}) IN ('references', 'bibliography') heading FROM lab),
lf AS (SELECT *, coalesce(max(CASE WHEN NOT inside AND heading THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 aft FROM lh)
SELECT paper_id, {white("string_agg(text, chr(10) ORDER BY ord)")} AS text FROM lf WHERE (inside AND NOT heading) OR (NOT inside AND aft) GROUP BY ALL""")
def references_text(spark, d):
    return references.references_text(_labelled(spark, d))


_LISTED = "li AS (SELECT paper_id, CAST(section_index AS BIGINT) AS pos, t AS title FROM (SELECT DISTINCT paper_id, section_index, CASE WHEN section_index % 3 = 0 THEN 'Extra ' || section_index ELSE lower(title) END AS t FROM sections WHERE title <> ''))"
_STORED = "st AS (SELECT DISTINCT paper_id, CAST(section_index AS BIGINT) AS ord, CAST(section_index % 5 + 1 AS INTEGER) AS page_number, title FROM sections WHERE title <> '')"


@query(f"""WITH {_LISTED}, {_STORED}, kp AS (SELECT * FROM st WHERE NOT (page_number BETWEEN 1 AND 3) OR EXISTS (SELECT 1 FROM li WHERE li.paper_id = st.paper_id AND lower(li.title) = lower(st.title)))
SELECT paper_id, 0 AS part, ord, page_number, title FROM kp UNION ALL SELECT paper_id, 1, pos, -1, title FROM li WHERE NOT EXISTS (SELECT 1 FROM kp WHERE kp.paper_id = li.paper_id AND lower(kp.title) = lower(li.title))""")
def merge_sections(spark, d):
    s = table(spark, d, "sections").filter("title <> ''").select("paper_id", "section_index", "title").distinct()
    pos = F.col("section_index").cast("long")
    listed = s.select("paper_id", pos.alias("pos"), F.when(F.col("section_index") % 3 == 0, F.concat(F.lit("Extra "), F.col("section_index").cast("string"))).otherwise(F.lower("title")).alias("title")).distinct()
    titles = s.select("paper_id", pos.alias("ord"), (F.col("section_index") % 5 + 1).cast("int").alias("page_number"), "title")
    return references.merge_titles(titles, listed, 1, 3)


# answers a model may give, by ref_id % 10: only the first two are an array of records and nothing else, or one inside other text
@query("""SELECT DISTINCT ref_id, CASE WHEN ref_id % 10 IN (0, 1) THEN 1 ELSE 0 END AS n, CASE WHEN ref_id % 10 IN (0, 1) THEN title END AS title, CASE WHEN ref_id % 10 IN (0, 1) THEN pub_year END AS year FROM bib_entries""")
def references_json(spark, d):
    b = table(spark, d, "bib_entries").select("ref_id", "title", "pub_year").distinct()
    good = F.to_json(F.array(F.struct("title", F.col("pub_year").alias("year"), F.lit(1).alias("unknown"))))
    bad_year = F.to_json(F.array(F.struct("title", F.lit("next year").alias("year"))))
    bad = ['[{"title": 5}]', '[{"authors": ["a", 3]}]', '[{"doi": {"x": 1}}]', '{"title": "a"}', '[{"year": 2020.5}]', '[{"title": "a"}] and [{"title": "b"}]', "none"]
    kinds = [good, F.concat(F.lit("Here they are: "), good, F.lit(" done")), bad_year, *map(F.lit, bad)]
    r = b.select("ref_id", references.parse_references(F.element_at(F.array(*kinds), (F.col("ref_id") % 10).cast("int") + 1)).alias("r"))
    return r.select("ref_id", F.size("r").alias("n"), F.try_element_at("r", F.lit(1))["title"].alias("title"), F.try_element_at("r", F.lit(1))["year"].alias("year"))


@query("SELECT DISTINCT section_id, CASE WHEN section_id % 6 > 1 THEN [] ELSE ['Abstract', title] END AS titles FROM sections WHERE title IS NOT NULL")
def llm_titles_json(spark, d):
    s = table(spark, d, "sections").filter("title IS NOT NULL").select("section_id", "title").distinct()
    js = F.to_json(F.array(F.lit("Abstract"), "title"))
    kinds = [js, F.concat(F.lit("Sure: "), js, F.lit(" ok")), F.lit("sorry"), F.lit('["A", 3]'), F.lit('["A"] and ["B"]'), F.lit('["A", null]')]
    return s.select("section_id", references.parse_title_list(F.element_at(F.array(*kinds), (F.col("section_id") % 6).cast("int") + 1)).alias("titles"))


def _xhtml(spark: SparkSession, d: str) -> DataFrame:
    """Layout XHTML as page tools print it, made of the words: path, text."""
    esc = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    num = lambda c: F.col(c).cast("double")
    w = table(spark, d, "words").filter(X.trim_white(F.col("text")) != "").dropDuplicates(["paper_id", "page_number", "block_idx", "line_idx", "word_idx"])
    box = [F.lit('<word xMin="'), num("x").cast("string"), F.lit('" yMin="'), num("y").cast("string"), F.lit('" xMax="'), (num("x") + num("width")).cast("string"), F.lit('" yMax="'), (num("y") + num("height")).cast("string"), F.lit('">')]
    rows = w.select(*layout.LINE, "word_idx", F.concat(*box, esc, F.lit("</word>")).alias("t"))
    for level, tag in (("word_idx", "line"), ("line_idx", "block"), ("block_idx", 'page width="612.0" height="792.0"'), ("page_number", "doc")):
        keys = [c for c in rows.columns if c not in (level, "t")]
        inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(level, "t"))), lambda s: s["t"]), "\n")
        rows = rows.groupBy(*keys).agg(F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag.split()[0]}>")).alias("t"))
    return rows.select(F.concat(F.lit("/tmp/in/"), F.col("paper_id").cast("string"), F.lit(".xhtml")).alias("path"), F.col("t").alias("text"))


@query(rf"""WITH one AS (SELECT paper_id, page_number, block_idx, line_idx, word_idx, min({white('text')}) AS text FROM words WHERE {white('text')} <> '' GROUP BY ALL)
SELECT CAST(paper_id AS VARCHAR) AS paper_id, CAST(dense_rank() OVER (PARTITION BY paper_id ORDER BY page_number) AS INTEGER) AS page_number, CAST(count(*) AS INTEGER) AS n_words, CAST(max(length(text)) AS INTEGER) AS longest FROM one GROUP BY paper_id, page_number""")
def xhtml_words(spark, d):
    w = formats.paper_words(_xhtml(spark, d))
    return w.groupBy("paper_id", "page_number").agg(F.count("*").cast("int").alias("n_words"), F.max(F.length("text")).alias("longest"))


@query(f"WITH {TITLES} SELECT CAST(paper_id AS VARCHAR) AS paper_id, CAST(page_number AS INTEGER) AS page_number, title FROM ti")
def font_xml_titles(spark, d):
    """Titles from font XML made of the headed lines: definitions first on each page, then the texts."""
    texts, specs = _fonts(spark, d)
    esc = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = texts.select("paper_id", "page_number", "ord", F.concat(F.lit('<text font="'), F.col("font_id").cast("string"), F.lit('">'), esc, F.lit("</text>")).alias("t"))
    page = lines.groupBy("paper_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda s: s["t"]), "\n").alias("t"))
    page = page.select("paper_id", "page_number", F.concat(F.lit('<page number="'), F.col("page_number").cast("string"), F.lit('">'), "t", F.lit("</page>")).alias("t"))
    defined = specs.select("paper_id", F.concat(F.lit('<fontspec id="'), F.col("font_id").cast("string"), F.lit('" size="'), F.col("size").cast("string"), F.lit('" family="'), "family", F.lit('"/>')).alias("t")).groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list("t")), "\n").alias("specs"))
    doc = page.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "t"))), lambda s: s["t"]), "\n").alias("t")).join(defined, "paper_id")
    scan_texts, scan_fonts = formats.font_texts(doc.select(F.concat(F.lit("/tmp/in/"), F.col("paper_id").cast("string"), F.lit(".xml")).alias("path"), F.concat("specs", "t").alias("text")))
    return fonts.section_titles(scan_texts, fonts.font_specs(scan_fonts)).select("paper_id", "page_number", "title")


_DIM = r"regexp_extract(page_size, '([\d|.]+) x ([\d|.]+)', {})"


@query(f"""SELECT DISTINCT paper_id, CAST(n_pages AS VARCHAR) AS pages, page_size, CASE WHEN regexp_matches(page_size, '[\\d|.]+ x [\\d|.]+') THEN {_DIM.format(1)} END AS page_width, TRY_CAST(CASE WHEN regexp_matches(page_size, '[\\d|.]+ x [\\d|.]+') THEN {_DIM.format(2)} END AS DOUBLE) AS page_height, trim(string_split(source_path, ':')[1]) AS title FROM papers WHERE n_pages IS NOT NULL AND page_size IS NOT NULL""")
def pdfinfo_kv(spark, d):
    p = table(spark, d, "papers").filter("n_pages IS NOT NULL AND page_size IS NOT NULL")
    text = F.concat(F.lit("Title: old\nTitle: "), "source_path", F.lit(":cut\nno pair\nPages: "), F.col("n_pages").cast("string"), F.lit("\nPage size: "), "page_size", F.lit("\n"))
    m = p.select("paper_id", formats.info_map(text).alias("m"))
    return m.select("paper_id", *[F.col("m")[k].alias(k) for k in ("pages", "page_size", "page_width")], formats.typed(F.col("m")["page_height"], "double", required=False).alias("page_height"), F.col("m")["title"].alias("title")).distinct()


@query("SELECT DISTINCT paper_id, page_number, CAST(page_number AS INTEGER) AS found FROM paper_pages")
def figure_pages(spark, d):
    p = table(spark, d, "paper_pages").select("paper_id", "page_number").distinct()
    path = F.concat(F.lit("/tmp/a-7/paper-"), F.col("page_number").cast("string"), F.lit(".jpg"))
    return p.select("paper_id", "page_number", formats.figure_page(path).alias("found"))


@query(f"WITH {DL} SELECT doc_id, line_no, {spacing_sql(suffix_sql('line'))} AS paragraph, regexp_matches({white('line')}, '{CAPTION_SQL}') AS is_caption, {MATH_SQL % ('line', 'line')} AS has_math FROM dl WHERE {white('line')} <> ''")
def paragraph_stream(spark, d):
    return paragraph_rows(table(spark, d, "documents"))


# the corpus as one flagship plan
def sections_flagship(spark, d):
    return _corpus(spark, d).sections()


QUERIES["sections"] = sections_flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
