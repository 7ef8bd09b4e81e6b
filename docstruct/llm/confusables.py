"""Problem 1: one consistent form for text that looks the same, by confusables skeletons.

``skeleton`` decomposes a text, drops what cannot be seen, replaces every
character by its prototype from the look-alike table and decomposes again:
texts that look alike have equal skeletons. ``consistent`` gives the form in
which they are kept: composed, with plain spaces, and every word in the script
it is written in, so that a letter borrowed from another script comes back. What
scripts can't tell (a look-alike of the same script, a word written wholly in
look-alikes) is told by the corpus: the usual word of equal skeleton.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstruct.llm.sections_io import titles_and_paragraphs
from docstruct.scale import cut, spread

#: Letters of other scripts that look like a Latin letter, with that letter.
CYRILLIC = dict(zip("асԁеһіјӏорԛѕуѵԝхАВСԌЕНІЈКМОРԚЅТУѴԜХҮ", "acdehijlopqsyvwxABCGEHIJKMOPQSTYVWXY"))
GREEK = dict(zip("ονϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϿ", "ovcjABEZHIKMNOPTYXCJ"))
ARMENIAN = dict(zip("օոսհցգզՍՕՏԼ", "onuhgqqUOSL"))
LATIN = dict(zip("ɑɡıȷʏɩ", "agijyi"))
#: Radical signs without a decomposition, with the character they look like.
RADICALS = dict(zip("⺁⺄⺊⺌⺎⺕⺟⺠⺢⺤⺥⺧⺩⺪⺫⺬⺭⺮⺱⺳⺷⺸⺻⺽⺾⺿⻁⻂⻃⻄⻅⻆⻈⻉⻋⻌⻐⻑⻒⻓⻔⻖⻘⻙⻚⻛⻜⻝⻠⻢⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻳",
                    "厂乙卜小兀彐母民水爪爫牛王疋目示礻竹网罒羊羊聿臼艹艹虎衤西西见角讠贝车辶钅長镸长门阝青韦页风飞食饣马鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜龟"))
#: Latin letters back to the script of the word they stand in (several to one: the first is taken).
_BACK = {"Cyrillic": {v: k for k, v in reversed(CYRILLIC.items())}, "Greek": {v: k for k, v in reversed(GREEK.items())}}
_BACK["Cyrillic"].update({"p": "р", "y": "у", "x": "х", "B": "В", "H": "Н"})
_TO_LATIN = CYRILLIC | GREEK | ARMENIAN | LATIN

#: Characters that leave no mark: soft hyphen, joiners, directions, the byte-order mark, variation selectors, tags.
INVISIBLE = regex.compile(r"[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻\U0001D173-\U0001D17A\U000E0000-\U000E0FFF]")
SPACES = regex.compile(r"[   -   　]")
#: Forms whose compatibility decomposition is the usual character: ligatures, joined, wide and radical forms, styled letters.
_FOLD = regex.compile(r"[ĲĳŉſǄ-ǌⅠ-ⅿ⺀-⿟豈-﫿ﬀ-﷿︰-﻾！-ﾟﾡ-￮\U0001D400-\U0001D7FF\U0002F800-\U0002FA1F]")
#: Full-width punctuation is the usual form where Chinese and Japanese are written.
_WIDE_SIGNS = regex.compile(r"[！-／：-＠［-｀｛-･]")
_EAST = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_HYPHENS = regex.compile(r"[‐‑﹣]")
_RUN = regex.compile(r"[\p{Latin}\p{Cyrillic}\p{Greek}\p{Armenian}\p{M}]+")
_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian")
_MIXED = regex.compile("|".join(rf"\p{{{a}}}\p{{M}}*\p{{{b}}}" for a in _SCRIPTS for b in _SCRIPTS if a != b))
_PLAIN = regex.compile(r"[\x00-\x7f]*")
_PLAIN_BLANKS = regex.compile(r"[ \t\r\n]+")


@lru_cache(1 << 16)
def _script(ch: str) -> str:
    for name in _SCRIPTS:
        if regex.match(rf"\p{{{name}}}", ch):
            return name
    return ""


@lru_cache(1 << 16)
def _folded(ch: str) -> str:
    if ch in RADICALS:
        return RADICALS[ch]
    return unicodedata.normalize("NFKC", ch) if _FOLD.match(ch) else ch


_PART = "\ue000"  # a character of nobody's, to part many in one call
_tables: dict[int, dict[str, str]] = {}


def prototypes(spark: SparkSession) -> dict[str, str]:
    """The public look-alike table as the Unicode library of the session has it: character -> prototype, some 6,000 entries.

    Ideographs and Hangul syllables without radicals of their own are left out.
    """
    known = _tables.get(id(spark))
    if known is None:
        checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
        points = [k for k in range(0x20000) if not (0x3400 <= k <= 0x9FFF or 0xAC00 <= k <= 0xE000 or 0x17000 <= k <= 0x18FFF) and unicodedata.category(chr(k))[0] in "LMNPS"]
        known = {}
        for at in range(0, len(points), 20_000):
            part = [chr(k) for k in points[at : at + 20_000]]
            like = checker.getSkeleton(0, _PART.join(part)).split(_PART)
            known.update((c, p) for c, p in zip(part, like) if unicodedata.normalize("NFD", c) != p)
        _tables.clear()
        _tables[id(spark)] = known
    return known


def skeleton(text: str, table: dict[str, str] | None = None) -> str:
    """The look-alike class of a text; equal for texts that look the same.

    ``table``: the prototypes of characters; without it those of the scripts that
    are told apart here.
    """
    t = SPACES.sub(" ", INVISIBLE.sub("", text))
    t = unicodedata.normalize("NFD", "".join(_folded(c) for c in t))
    if table is None:
        t = "".join(_TO_LATIN.get(c, "-" if _HYPHENS.match(c) else c) for c in t)
    else:
        t = "".join(table.get(c, c) for c in t)
    return unicodedata.normalize("NFD", t)


@lru_cache(1 << 17)
def _word(run: str, main: str = "") -> str:
    """A run of letters in one script: that of its letters with no look-alike, else ``main``, that of the text, or Latin, if it has letters of it, else that of most."""
    if len({_script(c) for c in run} - {""}) < 2:
        return run
    base = unicodedata.normalize("NFD", run)
    sure = Counter(_script(c) for c in base if _script(c) and not (c in _TO_LATIN or c in _BACK["Cyrillic"] and _script(c) == "Latin"))
    every = Counter(_script(c) for c in base if _script(c))
    home = max(every, key=lambda s: (sure[s], not sure and s == main, not sure and not main and s == "Latin", every[s]))
    back = _BACK.get(home)
    if home == "Latin":
        out = "".join(_TO_LATIN.get(c, c) for c in base)
    elif back:
        out = "".join(c if _script(c) == home else back.get(_TO_LATIN.get(c, c), c) for c in base)
    else:
        return run
    return unicodedata.normalize("NFC", out)


def consistent(text: str) -> str:
    """The text in its consistent form; a fixed point (``consistent(consistent(t)) == consistent(t)``).

    Signs as such stay: dashes, quotation marks, ellipses, superscripts, Greek
    letters that stand alone, full-width punctuation beside Chinese or Japanese.
    """
    if _PLAIN.fullmatch(text):
        return text
    t = SPACES.sub(" ", INVISIBLE.sub("", text))
    t = unicodedata.normalize("NFC", t)
    if _FOLD.search(t):
        east = _EAST.search(t) is not None
        t = "".join(c if c.isascii() or (east and _WIDE_SIGNS.match(c)) else _folded(c) for c in t)
        t = unicodedata.normalize("NFC", t)
    t = _HYPHENS.sub("-", t)
    if not _MIXED.search(t):
        return t
    sure = {n: len(p.findall(t)) for n, p in _SURE.items()}
    main = max(sure, key=sure.__getitem__)
    main = main if sure[main] else ""
    return _RUN.sub(lambda m: _word(m.group(), main), t)


WORD_FIELDS = ("original", "consistent", "skeleton", "script")


def _home(word: str) -> str:
    """The script of most letters, empty if it is none of those told apart."""
    found = Counter(_script(c) for c in word)
    return max(found, key=lambda s: (found[s], s)) if found else ""


def _member(original: str, form: str, table: dict[str, str]) -> dict[str, str]:
    return {"original": original, "consistent": form, "skeleton": skeleton(original, table), "script": _home(form)}


def consistent_items(items: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, text, consistent_text, is_changed and, of changed items, words (original, consistent form, skeleton, script of the form).

    Words are parted by plain blanks and line breaks; where they are as they were
    but the text is not, the text is the word.

    A null text gives null forms and is_changed false, an empty one stays empty;
    repeated rows give repeated rows. No shuffle.
    """
    word = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in WORD_FIELDS]))
    schema = T.StructType([*(T.StructField(k, items.schema[k].dataType) for k in keys), T.StructField("text", T.StringType()), T.StructField("consistent_text", T.StringType()), T.StructField("is_changed", T.BooleanType()), T.StructField("words", word)])
    kind = pa.list_(pa.struct([(n, pa.string()) for n in WORD_FIELDS]))
    shared = items.sparkSession.sparkContext.broadcast(prototypes(items.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            forms = [None if t is None else consistent(t) for t in texts]
            words = []
            for t, f in zip(texts, forms):
                if t == f:
                    words.append(None)
                    continue
                split = {w: f for w in _PLAIN_BLANKS.split(t) if (f := consistent(w)) != w} or {t: f}
                words.append([_member(w, g, shared.value) for w, g in sorted(split.items())])
            cols = [batch.column(k) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array(forms, pa.string()), pa.array([t != f for t, f in zip(texts, forms)]), pa.array(words, kind)], names=schema.names)

    return spread(items.select(*keys, F.col(text))).mapInArrow(run, schema)


#: Letters of a script that look like none of Latin (of Latin: like none of Cyrillic or Greek); a text with one is written in it.
_SURE = {n: regex.compile(rf"(?![{''.join(like)}])\p{{{n}}}") for n, like in (("Latin", [*_BACK["Cyrillic"], *_BACK["Greek"], *LATIN]), ("Cyrillic", CYRILLIC), ("Greek", GREEK), ("Armenian", ARMENIAN))}
_LATIN_LIKE = regex.compile(f"[{''.join(LATIN)}]")
#: Words wholly in look-alikes: of Latin by script, and Latin ones by the script they look like.
_ALIKE = {n: regex.compile(rf"(?<![\p{{L}}\p{{M}}])[{''.join(like)}]+(?![\p{{L}}\p{{M}}])") for n, like in (("Cyrillic", CYRILLIC), ("Greek", GREEK), ("Armenian", ARMENIAN))}
_LATIN_ALIKE = {n: regex.compile(rf"(?<![\p{{L}}\p{{M}}])[{''.join(back)}]{{2,}}(?![\p{{L}}\p{{M}}])") for n, back in _BACK.items()}


def suspects(text: str) -> dict[str, tuple[str, bool]]:
    """Words of a consistent text that may stand for another: the script of the other, and whether that must be the more usual one.

    Words with a Latin letter that looks like another Latin letter; words wholly
    in look-alikes of a script the text is not written in; Latin words wholly in
    look-alikes in a text of another script. Greek letters that stand alone and
    single Latin letters are signs.
    """
    out: dict[str, tuple[str, bool]] = {}
    if _PLAIN.fullmatch(text):
        return out
    if _LATIN_LIKE.search(text):
        out.update((w, ("Latin", True)) for w in _RUN.findall(text) if _LATIN_LIKE.search(w) and {_script(c) for c in w} <= {"Latin", ""})
    for script, alike in _ALIKE.items():
        if _SURE[script].search(text):
            if script in _LATIN_ALIKE:
                for w in _LATIN_ALIKE[script].findall(text):
                    out.setdefault(w, (script, True))
        elif (found := alike.findall(text)) and _SURE["Latin"].search(text):
            out.update((w, ("Latin", False)) for w in found if len(w) > 1 or script != "Greek")
    return out


def by_corpus(forms: DataFrame, keys: list[str]) -> DataFrame:
    """``forms`` (of ``consistent_items``) with the suspect words replaced by the usual word of the corpus of equal skeleton.

    Suspects and the words of the corpus meet by skeleton; where no text has a
    suspect the forms are returned as they are.
    """
    held = T.StructType([*(forms.schema[k] for k in [*keys, "text"]), T.StructField("skeleton", T.StringType()), T.StructField("word", T.StringType()), T.StructField("home", T.StringType()), T.StructField("is_rarer", T.BooleanType())])

    columns = forms.columns
    shared = forms.sparkSession.sparkContext.broadcast(prototypes(forms.sparkSession))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, skeleton(w), w, *x) for k, t in enumerate(batch.column(len(keys) + 1).to_pylist()) if t for w, x in suspects(t).items()]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys) + 1)), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2, 3)), pa.array([r[4] for r in rows], pa.bool_())], names=held.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter = Counter()
            for t in batch.column(0).to_pylist():
                words.update(sought.findall(t or ""))
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["form", "n"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            scripts = [{_script(c) for c in w} - {""} for w in own]
            script = ["" if len(x) != 1 or _LATIN_LIKE.search(w) else next(iter(x)) for w, x in zip(own, scripts)]
            yield pa.RecordBatch.from_arrays([pa.array([skeleton(w) for w in own], pa.string()), batch.column(0), batch.column(1), pa.array(script, pa.string())], names=["skeleton", "form", "n", "script"])

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {k: batch.column(k).to_pylist() for k in batch.schema.names}
            for k, found in enumerate(rows["found"]):
                back = {x["word"]: x["form"] for x in found or ()}
                if back:
                    old = rows["consistent_text"][k]
                    rows["consistent_text"][k] = _RUN.sub(lambda m: back.get(m.group(), m.group()), old)
                    rows["is_changed"][k] = True
                    rows["words"][k] = (rows["words"][k] or []) + [_member(w, f, shared.value) for w, f in sorted(back.items())]
            yield pa.RecordBatch.from_arrays([pa.array(rows[n], batch.schema.field(n).type) for n in columns], names=columns)

    found = cut(forms.select(*keys, "text", "consistent_text").mapInArrow(ask, held))
    # a word that looks like a suspect is a Latin one, or wholly in look-alikes of the other script; the suspects are counted too
    homes = {r["home"] for r in found.select("home").distinct().collect()}
    if not homes:
        return forms
    sought = _RUN if "Latin" in homes else regex.compile("|".join(x.pattern for n in sorted(homes) for x in (_ALIKE[n], _LATIN_ALIKE[n])))
    words = forms.select("consistent_text").mapInArrow(count, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))
    words = cut(words.mapInArrow(look, "skeleton string, form string, n long, script string"))
    own = words.select(F.col("form").alias("word"), F.col("n").alias("n_own"))
    pairs = found.select("skeleton", "word", "home", "is_rarer").distinct().join(own, "word").join(words, "skeleton")
    usual = pairs.filter("form <> word AND script = home AND n > 1 AND (n > n_own OR NOT is_rarer)").groupBy("word", "home", "is_rarer").agg(F.max_by("form", F.struct("n", "form")).alias("form"))
    per_item = found.join(usual, ["word", "home", "is_rarer"]).groupBy(*keys, "text").agg(F.collect_set(F.struct("word", "form")).alias("found"))
    return forms.join(per_item, [*keys, "text"], "left").select(*columns, "found").mapInArrow(replace, forms.schema)


def section_forms(sections: DataFrame) -> DataFrame:
    """``consistent_items`` of every title and paragraph of a sections table, what scripts can't tell told by the corpus."""
    keys = ["section_id", "item_no"]
    return by_corpus(cut(consistent_items(titles_and_paragraphs(sections), keys, "text")), keys)


def found_items(forms: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of the items with a word that is not the representative of its look-alike class.

    Originals are grouped by equal skeleton and the script they are kept in; the
    representative is the form most of the class are kept in, of equal ones the
    last by code point.
    """
    words = forms.filter("is_changed").select(*keys, F.inline("words"))
    members = words.groupBy("skeleton", "script", "consistent").agg(F.count("*").alias("n"))
    classes = members.groupBy("skeleton", "script").agg(F.max_by("consistent", F.struct("n", "consistent")).alias("representative"))
    return words.join(classes, ["skeleton", "script"]).filter("original <> representative").select(*keys).distinct()


def skeleton_groups(items: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Texts grouped by equal skeleton: skeleton, n_forms, n_rows, consistent_text; groups of several forms only.

    The skeletons and forms are counted before the shuffle, so a text repeated
    very often is one row of it for every task.
    """
    shared = items.sparkSession.sparkContext.broadcast(prototypes(items.sparkSession))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("skeleton", "form", "consistent_text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            table = shared.value
            yield pa.RecordBatch.from_arrays([pa.array([f(t) for t in texts], pa.string()) for f in (lambda t: skeleton(t, table), str, consistent)], names=schema.names)

    forms = spread(items.select(text)).mapInArrow(run, schema).groupBy("skeleton", "form").agg(F.count("*").alias("n"), F.min("consistent_text").alias("consistent_text"))
    groups = forms.groupBy("skeleton").agg(F.count("*").alias("n_forms"), F.sum("n").alias("n_rows"), F.min("consistent_text").alias("consistent_text"))
    return groups.filter("n_forms > 1")
