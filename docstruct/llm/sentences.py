"""Problem 5: sentence boundaries by a pushdown automaton.

The automaton runs over the marks of a text: stops, brackets, quotation marks,
item numbers, and blanks in scripts without stops. Its stack holds the open
brackets and quotations and the list levels. A stop in a bracket or quotation
after which the sentence goes on ends nothing, whatever stands there; a number
that goes on with a list level on the stack is an item's. Any other stop ends a
sentence unless the trie of abbreviations, read backwards from the stop, or what
follows says that the sentence goes on; the closing marks and citation numbers
behind the stop are taken into the sentence.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstruct.llm.sections_io import paragraphs
from docstruct.scale import spread

#: Abbreviations that always want something after them: titles, references, "for example", units of counting.
LEADING = """
dr prof mr mrs mx st rev hon gen col capt lt sgt messrs fig figs tab tabs sec secs eq eqs ch chap art arts app no nos vol vols pp p pg ed eds
cf viz vs v e.g i.e approx ca c esp incl resp vgl bzw z.b d.h i.d.r i.s.v sog gem abb nr abs ziff kap bd hrsg evtl ggf s.o s.u sr sra srta
dra d.ª pág págs fig núm p.ej p.ex aprox lic ing m mm mme mlle mgr env chap éd n.º n.° no.s art séc t.e т.е т.д.н см рис стр гл ст напр табл ср проф г-н г-жа акад им ул п пп
ص د م انظر श्री डॉ पृ कृ देखें กก ดร นพ พล.อ พ.ศ ค.ศ jan feb mar apr jun jul aug sept sep oct nov dec janv févr avr juil déc
""".split()
#: Abbreviations that may also end a sentence; what follows decides.
TRAILING = "etc al co inc ltd corp jr bros u.a z.t o.ä p.m a.m u.s u.k e.u ph.d usw u.s.w u.ä f ff jh n.chr v.chr и.др др т.д т.п и.т.д г гг в вв тыс млн млрд руб ee.uu uu s.a c.v cie ibid op.cit sqq et.seq ms".split()
#: Month names after a day number with a stop: the stop is the ordinal's.
MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

_LEADING_SET, _TRAILING_SET = frozenset(LEADING), frozenset(TRAILING)
_SPACED_SET = frozenset(w for w in LEADING + TRAILING if "." in w) | {"т.д", "т.п"}
#: Abbreviations that only a number or a small letter follows; before a capital they are words.
_NUMBERED = frozenset(("no", "art", "ill", "app", "ed", "sec", "abs"))
_STOPS = ".!?…؟।॥。！？．｡"
_OPEN, _CLOSE = "([{（［｛「『《〈【", ")]}）］｝」』》〉】"
_PAIR = dict(zip(_CLOSE, _OPEN))
_PLAIN_MARK = r"[.!?…؟।॥。！？．｡]+|[(\[{（［｛「『《〈【)\]}）］｝」』》〉】«»“”„\"]"
_MARK = regex.compile(_PLAIN_MARK)
_THAI = regex.compile(r"\p{Thai}")
#: With the blanks between Thai words, unless an abbreviation follows.
_THAI_MARK = regex.compile(_PLAIN_MARK + r"|(?<=\p{Thai}\p{M}*\p{Cf}*[)”\"»]?\p{Cf}*)[\s\p{Cf}]*\s[\s\p{Cf}]*(?=[(“\"«]?\p{Thai})(?!\p{Thai}{1,3}\.)")
_TAIL = regex.compile(r"(?:\p{Cf}*(?:[)\]}）］｝」』》〉】”’»“\"]|'(?!\w)|\s»|\[\d+(?:\s*[,–-]\s*\d+)*\]))+")
_GAP = regex.compile(r"[\s\p{Cf}]*")
#: Abbreviations written with blanks, before and after the stop at hand.
_SPACED = regex.compile(r"\b\p{L}{1,2}\.[\s\p{Cf}]+(?:\p{L}\.[\s\p{Cf}]+)?\p{L}{1,4}\Z")
_SPACED_ON = regex.compile(r"(\p{L}{1,4}(?:\.[\s\p{Cf}]*\p{L})?)\.")
_EAST = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_LIST_NO = regex.compile(r"(?:\(?\p{N}{1,3}|\(?\p{L}|[ivxlcIVXLC]{1,5})\Z")
#: A word written small that may open a sentence: a name with a capital inside or a letter joined by a hyphen.
_SMALL_NAME = regex.compile(r"\p{Ll}{1,3}\p{Lu}|\p{Ll}-\p{L}")
_INVISIBLE = regex.compile(r"\p{Cf}+")


def _trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        at = root
        for ch in reversed(w):
            at = at.setdefault(ch, {})
        at[""] = True
    return root


_LEADING, _TRAILING = _trie(LEADING), _trie(TRAILING)


def _in_trie(trie: dict, word: str) -> bool:
    """Whether the trie has ``word`` or its end after a letter that parts words."""
    at = trie
    for k in range(len(word) - 1, -1, -1):
        at = at.get(word[k])
        if at is None:
            return False
        if "" in at and (k == 0 or not (word[k - 1].isalnum() or word[k - 1] == ".")):
            return True
    return False


def _word_before(text: str, start: int) -> str:
    k = start
    while k > 0 and start - k < 40 and not text[k - 1].isspace() and text[k - 1] not in "([{«“„\"":
        k -= 1
    return text[k:start]


def _squeezed(s: str) -> str:
    return unicodedata.normalize("NFKC", _INVISIBLE.sub("", regex.sub(r"\s+", "", s))).lower()


def _goes_on(text: str, start: int, end: int, stop: str) -> bool:
    """Whether the sentence goes on after the stop at [start, end), tail excluded."""
    gap = _GAP.match(text, end).end()
    if gap == len(text):
        return False
    nxt = text[gap]
    spaced = any(c.isspace() for c in text[end:gap])
    if stop[-1] in "。！？｡":
        return nxt in "とっ" and spaced is False and end > start + len(stop)  # a quotation with its verb
    if stop[-1] in "।॥":
        return False
    follow = text[gap : gap + 24]
    small = nxt.islower() and not _SMALL_NAME.match(follow)
    if stop[-1] in "!?؟":
        return small or nxt in ",;:،؛"
    if nxt in ",;:،؛" or nxt in _STOPS:
        return True
    if _EAST.match(nxt) and not spaced and not stop.startswith(".."):
        return True
    if not spaced and end == start + len(stop):
        # no blank: only two whole words run together are two sentences
        before = _word_before(text, start)
        joined = stop[0] in ".．…" and len(before) > 2 and "." not in before and before[-1].islower() and nxt.isupper() and follow[1:2].islower()
        return not joined
    if stop[0] == "…" or stop.startswith(".."):
        return small or (start > 0 and text[start - 1].isspace())
    if end > start + len(stop):  # closing marks stand between
        return small
    as_written = unicodedata.normalize("NFKC", _INVISIBLE.sub("", _word_before(text, start)))
    word = as_written.lower()
    head = text[max(0, start - 24) : start]
    spaced_word = _SPACED.search(head)
    joined = _squeezed(spaced_word.group()) if spaced_word else ""
    if joined.count(".") > 1 and joined not in _SPACED_SET:
        joined = joined.split(".", 1)[1]
    if joined in _LEADING_SET:
        return True
    if joined in _TRAILING_SET:
        return small
    if len(word) < 3 and (more := _SPACED_ON.match(follow)) and _squeezed(word + "." + more.group(1)) in _SPACED_SET:
        return True  # the first half of an abbreviation written with a blank
    if as_written == "Ms" or _in_trie(_LEADING, word):
        return not (word in _NUMBERED and nxt.isupper())
    if len(word) == 1 and word.isalpha() and text[start - 1].isupper():
        return True  # an initial
    if _in_trie(_TRAILING, word):
        return small
    if word.isdigit():
        here = text.rfind("\n", 0, start) + 1
        if _LIST_NO.match(text[here:start].strip()) and len(text[here:start].strip()) <= 3:
            return True  # the number of a list item
        after = regex.match(r"\p{L}+", follow)
        if after and after.group().lower() in MONTHS and len(word) <= 2:
            return True
    return False


_BRACKETS = regex.compile(r"[(\[{（［｛「『《〈【)\]}）］｝」』》〉】«»“”„\"]")
_CLOSERS = frozenset(_CLOSE + "”»“\"’'")


def _opens(stack: list, ch: str) -> bool:
    return ch in _OPEN or ch == "„" or (ch in "“«\"" and not _closes(stack, ch))


def _held(text: str) -> list[tuple[int, int]]:
    """Brackets and quotations after whose end the sentence goes on: open and closing place of the outermost ones, in order.

    Only marks that have their partner count; an open one that is never closed
    holds nothing.
    """
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for m in _BRACKETS.finditer(text):
        ch, k = m.group(), m.start()
        if _opens(stack, ch):
            stack.append((ch, k))
            continue
        opened = _close(stack, ch)
        if opened is not None:
            spans.append((opened, k))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and b < out[-1][1]:
            continue  # inside one that holds already
        end = _TAIL.match(text, b).end() if _TAIL.match(text, b) else b + 1
        k = b
        while k > a and (text[k - 1] in _CLOSERS or text[k - 1].isspace()):
            k -= 1
        first = k
        while first > a and text[first - 1] in _STOPS:
            first -= 1
        goes_on = _goes_on(text, first, end, text[first:k]) if first < k else _GAP.match(text, end).end() < len(text)
        if goes_on:
            out.append((a, b))
    return out


class _Lists:
    """The list levels of the stack: what number each has next."""

    def __init__(self) -> None:
        self.levels: list[int] = []

    def item(self, number: int) -> bool:
        """Whether a number at the beginning of a sentence is that of an item; the levels follow it."""
        for k in range(len(self.levels) - 1, -1, -1):
            if self.levels[k] == number:
                del self.levels[k + 1 :]
                self.levels[k] += 1
                return True
        if number == 1:
            self.levels.append(2)
            return True
        return False


def sentence_ends(text: str) -> list[int]:
    """The end of each sentence; the last one is the end of the text. White space alone has no sentence."""
    if not text.strip():
        return []
    ends: list[int] = []
    stack: list[tuple[str, int]] = []
    lists = _Lists()
    held = _held(text)
    next_held, begin = 0, 0  # the first that ends behind the mark at hand; where the sentence at hand begins
    at, last = 0, len(text)
    marks = _THAI_MARK if _THAI.search(text) else _MARK
    while True:
        m = marks.search(text, at)
        if m is None:
            break
        mark, start, at = m.group(), m.start(), m.end()
        first = mark[0]
        while next_held < len(held) and held[next_held][1] < start:
            next_held += 1
        inside = next_held < len(held) and held[next_held][0] < start
        if first in _STOPS:
            tail = _TAIL.match(text, at)
            # a closing mark that was never opened but could open is left to what follows
            end = tail.end() if tail else at
            while tail and end > at and text[end - 1] in "“\"«" and not any(q == text[end - 1] or (q == "„" and text[end - 1] == "“") for q, _ in stack):
                end -= 1
                while end > at and text[end - 1].isspace():
                    end -= 1
            number = text[begin:start].strip()
            is_item = first == "." and number.isdecimal() and len(number) < 4 and text[at : at + 1].isspace() and lists.item(int(number))
            if not inside and not is_item and not _goes_on(text, start, end, mark):
                ends.append(end)
                begin = end
            for ch in text[at:end]:
                _close(stack, ch)
            at = max(at, end)
        elif _opens(stack, first):
            stack.append((first, start))
        elif first in _CLOSE or first in "”»“\"":
            _close(stack, first)
        elif not stack or stack[-1][0] not in "([（":  # a blank between two Thai words
            ends.append(start)
            begin = start
    body, front = len(text.rstrip(" \t\n\r\x0b\x0c")), _GAP.match(text, 0).end()
    ends = sorted({e for e in ends if front < e < body and _GAP.match(text, e).end() < last})
    ends.append(last)
    return ends


def _closes(stack: list, ch: str) -> bool:
    return bool(stack) and any(q == "„" if ch == "“" else q == ch for q, _ in stack[-2:])


def _close(stack: list, ch: str) -> int | None:
    """Close the nearest open mark that ``ch`` ends, and what was opened after it; its place."""
    want = {"”": "“", "»": "«", "“": "„", '"': '"'}.get(ch) or _PAIR.get(ch)
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == want:
            place = stack[k][1]
            del stack[k:]
            return place
    return None


def sentences(items: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, sentence_no, start_pos, end_pos of every sentence; positions count characters.

    White space around a sentence belongs to none, but the last sentence ends
    with the text. Null, empty and blank texts give no row; repeated rows give
    repeated rows. No shuffle, one pass over the whole text.
    """
    schema = T.StructType([*(T.StructField(k, items.schema[k].dataType) for k in keys), *(T.StructField(n, T.IntegerType()) for n in ("sentence_no", "start_pos", "end_pos"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, nos, starts, ends = [], [], [], []
            for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                begin = 0
                for no, e in enumerate(sentence_ends(t or "")):
                    rows.append(i)
                    nos.append(no)
                    starts.append(_GAP.match(t, begin).end())
                    ends.append(e)
                    begin = e
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(keys))), *(pa.array(v, pa.int32()) for v in (nos, starts, ends))], names=schema.names)

    return spread(items.select(*keys, F.col(text))).mapInArrow(run, schema)


def section_sentences(sections: DataFrame, layer: str | None = None) -> DataFrame:
    """``sentences`` of the paragraphs of a sections table, of one layer if given."""
    keep = None if layer is None else F.col("layer") == layer
    return sentences(paragraphs(sections, keep), ["section_id", "item_no"], "text")
