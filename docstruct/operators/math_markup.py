"""Math markup and fuzzy alignment: the parts that need byte windows or sliding windows run as Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstruct.functions import text as X

_CHAR = re.compile(f"[{X.MATH_CHARS}]")
_STRUCTURE = re.compile(X.MATH_STRUCTURE)
#: Runs with a symbol of mathematics, and false alarms.
_SYMBOLS = r"∀-⋿⨀-⫿α-ωΑ-Ω=<>±×÷→←↔⇒⇐⇔|/^_{}()\[\]"
_RUN = re.compile(rf"(?:(?:[a-zA-Z0-9]++\s*+)?[{_SYMBOLS}](?:\s*+[a-zA-Z0-9\^_{{}}()\[\]]++)*+)++")
_FALSE = re.compile(
    r"\b\d{2,4}\s*/\s*\d{2,4}\b"
    r"|\b[nNpPtTkK]\s*[=<>]\s*\d+(?:\.\d+)?\s*(?:participants|subjects|samples|items|trials|percent|%)"
    r"|\b(?:in|see|part|method|step|item|case|type|group)\s*\(\s*[a-zA-Z]\s*\)"
    r"|(?i:(?:section|eq|equation|fig|figure|table|ref|chapter|appendix)\s*[.(\[]\s*\d)"
)
#: Words that speak for mathematics.
_KEYWORDS = [
    "where", "given", "such that", "let ", "define", "denote", "equation", "formula", "compute", "calculate", "minimize", "maximize", "optimal", "converge",
    "theorem", "lemma", "proof", "corollary", "ratio", "element", "matrix", "vector", "scalar", "function", "variable", "coefficient", "parameter",
    "derivative", "integral", "gradient", "norm", "summation", "product", "limit", "approaches", "subject to", "constraint", "objective",
]
#: Bytes looked at on each side of a run: for false alarms, and for words that speak for mathematics.
_NEAR, _WIDE = 20, 50
LEAST_ALIKE = 0.4


def _window(text: str, start: int, end: int, reach: int) -> str:
    """The characters within ``reach`` UTF-8 bytes of [start, end), widened to whole characters."""
    a, left = start, reach
    while a > 0 and left > 0:
        a -= 1
        left -= len(text[a].encode("utf-8", "surrogatepass"))
    b, left = end, reach
    while b < len(text) and left > 0:
        left -= len(text[b].encode("utf-8", "surrogatepass"))
        b += 1
    return text[a:b]


def mark_math(text: str | None) -> str | None:
    """Wrap likely mathematics in math tags; text without any comes back unchanged."""
    if not text or not (_CHAR.search(text) or _STRUCTURE.search(text)):
        return text
    out, last = [], 0
    for m in _RUN.finditer(text):
        run = m.group().strip()
        if len(run.encode("utf-8", "surrogatepass")) < 2 or (run.isascii() and run.isdigit()):
            continue
        chars = _CHAR.search(run) is not None
        if not (chars or _STRUCTURE.search(run)) or _FALSE.search(_window(text, m.start(), m.end(), _NEAR)):
            continue
        if not chars:
            near = _window(text, m.start(), m.end(), _WIDE)
            low = near.lower()
            if not (any(k in low for k in _KEYWORDS) or _CHAR.search(near) or "<math>" in near or "</math>" in near):
                continue
        out += [text[last : m.start()], "<math>", run, "</math>"]
        last = m.end()
    return "".join(out) + text[last:]


@F.pandas_udf(T.StringType())
def _mark_udf(texts: pd.Series) -> pd.Series:
    return texts.map(mark_math, na_action="ignore")


def marked(c: Column) -> Column:
    """``mark_math`` of a column."""
    return _mark_udf(c)


def heuristic_markup(block_rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose markup changes, with math_text; rows without mathematics never reach Python."""
    gated = block_rows.filter(X.contains_math(F.col(text)))
    return gated.withColumn("math_text", marked(F.col(text))).filter(F.col("math_text") != F.col(text))


@lru_cache(4096)
def _gram_set(s: str) -> frozenset[str]:
    return frozenset(s[k : k + 3] for k in range(len(s) - 2)) if len(s) >= 3 else frozenset([s] if s else [])


def best_alignment(needle: str | None, hay: str | None) -> tuple[int, int] | None:
    """Start and end of the window of ``hay`` (0.7 to 1.3 times the needle's length) most like it by trigrams, at least 0.4.

    Of equal ones the smallest window, then the leftmost.
    """
    if not needle or not hay:
        return None
    grams = _gram_set(needle)
    n, m = len(needle), len(hay)
    low, high = max(1, int(np.floor(n * 0.7))), min(m, int(np.ceil(n * 1.3)))
    best, where = 0.0, None
    pos: dict[str, int] = {}
    prev = np.full(max(0, m - 2), -1)
    shared = np.zeros(max(0, m - 2), bool)
    for k in range(m - 2):
        g = hay[k : k + 3]
        prev[k] = pos.get(g, -1)
        pos[g] = k
        shared[k] = g in grams
    if m > 2 and len(set(hay[k : k + 3] for k in np.flatnonzero(shared))) < LEAST_ALIKE * len(grams) and low > 2:
        return None  # not even all shared trigrams together would do
    for size in range(low, high + 1):
        if size < 3:
            for k in range(m - size + 1):
                w = _gram_set(hay[k : k + size])
                s = len(w & grams) / len(w | grams)
                if s > best:
                    best, where = s, (k, k + size)
            continue
        # a trigram counts in the windows that hold it but not an earlier one like it
        span, starts = size - 2, m - size + 1
        p = np.arange(m - 2)
        first, last = np.maximum(prev + 1, p - span + 1).clip(0), np.minimum(p, starts - 1)
        ok = first <= last
        both = ok & shared
        total = np.bincount(first[ok], minlength=starts + 1) - np.bincount(last[ok] + 1, minlength=starts + 1)
        common = np.bincount(first[both], minlength=starts + 1) - np.bincount(last[both] + 1, minlength=starts + 1)
        c = np.cumsum(common)[:starts]
        s = c / (len(grams) + np.cumsum(total)[:starts] - c)
        k = int(np.argmax(s))
        if s[k] > best:
            best, where = float(s[k]), (k, k + size)
    return where if best >= LEAST_ALIKE else None


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.pandas_udf(_SPAN)
def _align_udf(needles: pd.Series, hays: pd.Series) -> pd.DataFrame:
    spans = [best_alignment(a, b) for a, b in zip(needles, hays)]
    return pd.DataFrame({"start": pd.array([s and s[0] for s in spans], "Int32"), "end": pd.array([s and s[1] for s in spans], "Int32")})


def aligned(needle: Column, hay: Column) -> Column:
    """``best_alignment`` of two columns: a struct of start and end, both null if nothing is near."""
    return _align_udf(needle, hay)


#: Density from which a page is worth a reading by an outside model.
DENSE = 0.3


def dense_pages(page_rows: DataFrame, least: float = DENSE) -> DataFrame:
    """Pages whose text is dense with mathematics; only these go to a provider."""
    return page_rows.filter(X.math_density(F.col("text")) >= least)


def _codes(s: str) -> np.ndarray:
    """The trigrams of a text in order, a number for each; a shorter text is its own only one, an empty one has none."""
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1  # no character is 0, so lengths never mix
    if len(c) >= 3:
        return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    return np.array([(c[0] << 21) | c[1] if len(c) == 2 else c[0]]) if len(c) else c


def _distinct(codes: np.ndarray) -> np.ndarray:
    """Sorted and without repeats; for some hundred numbers this takes half the time of ``np.unique``."""
    s = np.sort(codes)
    return s[np.concatenate([np.ones(min(1, len(s)), bool), s[1:] != s[:-1]])]


def _among(codes: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which of ``codes`` are in ``grams``, sorted and without repeats, one at least."""
    return grams[np.minimum(np.searchsorted(grams, codes), len(grams) - 1)] == codes


def _alike(common, other, n_grams: int):
    """Whether ``common`` trigrams of ``n_grams`` and ``other`` ones beside them make a score of LEAST_ALIKE, in whole numbers."""
    return 5 * common >= 2 * (n_grams + other)


def has_alignment(needle: str, hay: str) -> bool:
    """Whether ``best_alignment`` finds a window.

    A window holds at most what a larger one around it shares with the needle and
    at least what a smaller one in it doesn't, so a range of sizes without a start
    where these two would do is left out as a whole; other ranges are halved.
    """
    n, m = len(needle), len(hay)
    if not n or not m:
        return False
    if n < 3:
        return needle in hay
    low, high = max(3, int(np.floor(n * 0.7))), min(m, int(np.ceil(n * 1.3)))
    if low > high:
        return False
    grams, codes = _distinct(_codes(needle)), _codes(hay)
    shared, k = _among(codes, grams), len(grams)
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    prev, p = np.full(len(codes), -1), np.arange(len(codes))
    prev[order[1:][same]] = order[:-1][same]
    if not _alike(int((shared & (prev < 0)).sum()), 0, k):
        return False  # not even all shared trigrams together would do

    def windows(size: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct trigrams that the windows of one size share with the needle, and their others."""
        span, starts = size - 2, m - size + 1
        first, last = np.maximum(prev + 1, p - span + 1), np.minimum(p, starts - 1)
        ok = first <= last
        count = lambda which: np.cumsum(np.bincount(first[which], minlength=starts + 1) - np.bincount(last[which] + 1, minlength=starts + 1))[:starts]
        return count(ok & shared), count(ok & ~shared)

    ends = [(size, *windows(size)) for size in (low, high)]
    if any(_alike(c, x, k).any() for _, c, x in ends):
        return True
    ranges = [tuple(ends)]
    while ranges:
        least, most = ranges.pop()
        around = most[1][np.minimum(np.arange(len(least[1])), len(most[1]) - 1)]
        if most[0] - least[0] < 2 or not _alike(around, least[2], k).any():
            continue
        size = (least[0] + most[0]) // 2
        c, x = windows(size)
        if _alike(c, x, k).any():
            return True
        ranges += [(least, (size, c, x)), ((size, c, x), most)]
    return False


def nearest_paragraphs(blocks: list[str], paragraphs: list[str]) -> list[int | None]:
    """For each normalised block the place of the paragraph most like it, the first of equal ones; none if nothing is near.

    A pair's score is that of its trigrams; if that is less than LEAST_ALIKE but a
    window of the paragraph aligns with the block, it is LEAST_ALIKE. So windows
    only matter to a block without a paragraph of a greater score.
    """
    sets = [_distinct(_codes(t)) for t in paragraphs]
    sizes = np.array([len(g) for g in sets], int)
    codes, owner = np.concatenate([np.empty(0, np.int64), *sets]), np.repeat(np.arange(len(sets)), sizes)
    found: list[int | None] = []
    for text in blocks:
        if not text or not len(codes):
            found.append(None)
            continue
        grams = _distinct(_codes(text))
        common = np.bincount(owner[_among(codes, grams)], minlength=len(sets))
        score = common / (len(grams) + sizes - common)
        k = int(np.argmax(score))
        if score[k] > LEAST_ALIKE:
            found.append(k)
            continue
        maybe = np.flatnonzero(_alike(common, 0, len(grams)) | (len(text) < 3))
        found.append(next((int(i) for i in maybe if score[i] >= LEAST_ALIKE or has_alignment(text, paragraphs[i])), None))
    return found


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _nearest_udf(blocks: pd.Series, paragraphs: pd.Series) -> pd.Series:
    return pd.Series([nearest_paragraphs(list(b), list(p)) for b, p in zip(blocks, paragraphs)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _mark_all_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([[mark_math(t) for t in each] for each in texts], dtype=object)


def align_paragraphs(texts: DataFrame, block_rows: DataFrame) -> DataFrame:
    """For each block the paragraph of its page's text most like it, else its own markup if that changes it.

    ``texts``: paper_id, page_number, text (paragraphs parted by blank lines);
    ``block_rows``: paper_id, page_number, block_idx, text. Paragraphs and blocks
    meet only within a page, a row for each. Result: the block's keys and math_text.
    """
    page = ["paper_id", "page_number"]
    parts = F.transform(F.split("text", "\n\n"), lambda p, i: F.struct(i.alias("pos"), X.trim_white(p).alias("p")))
    paras = texts.groupBy(*page).agg(F.array_sort(F.flatten(F.collect_list(F.filter(parts, lambda s: s["p"] != "")))).alias("paras"))
    b = block_rows.groupBy(*page).agg(F.collect_list(F.struct("block_idx", "text", X.normalize_for_matching(F.col("text")).alias("n"))).alias("blocks"))
    met = b.join(paras, page).withColumn("near", _nearest_udf(F.col("blocks.n"), F.transform("paras", lambda s: X.normalize_for_matching(s["p"]))))
    # markup of a page's other blocks at once, those with mathematics only; what is made of a page's row isn't made again for the filter
    left = F.transform(F.arrays_zip("blocks", "near"), lambda z: F.when(z["near"].isNull() & X.contains_math(z["blocks"]["text"]), z["blocks"]["text"]))
    rows = F.transform(F.arrays_zip("blocks", "near", "own"), lambda z: F.struct(z["blocks"]["block_idx"].alias("block_idx"), z["blocks"]["text"].alias("text"), F.get("paras", z["near"])["p"].alias("p"), z["own"].alias("own")))
    each = met.withColumn("own", _mark_all_udf(left)).select(*page, F.inline(rows))
    return each.filter(F.col("p").isNotNull() | (F.col("own") != F.col("text"))).select(*page, "block_idx", F.coalesce("p", "own").alias("math_text"))
