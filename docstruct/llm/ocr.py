"""Problem 2: text from scanned pages, its lines labelled by a hidden Markov model and put together again.

States of a line: running header, page number, body, and body that ends in a
cut word (break). A line is observed by its shape, its layout and its end. The
model starts from fixed tables and is trained on all lines (Viterbi training):
a first labelling of the corpus is counted, and the counts, added to the start,
give the tables of the final labelling. Misread words are those the corpus
lacks and gains by undoing characters a scanner confuses. The usual words are a
list every task has; the words it lacks are asked of the counts of the whole
text layer by a join, and a rare word is taken for what stood there if that is
likelier than a word not seen before (noisy channel, measured on the corpus).
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstruct.scale import cut

HEADER, NUMBER, BODY, BREAK = range(4)
SHAPES = ("empty", "number", "recurring", "headline", "text")
LAYOUTS = ("unknown", "margin", "normal", "large")
ENDS = ("none", "own hyphen", "cut")
#: Start of the model, as counts: transitions (from, to), and shape, layout and end by state.
START_MOVES = np.array([[2, 6, 40, 8], [10, 1, 40, 8], [6, 6, 1000, 150], [6, 6, 150, 25]], float)
START_FIRST = np.array([20, 2, 200, 30], float)
START_SHAPE = np.array([[0.2, 1, 60, 60, 4], [0.2, 200, 1, 0.2, 0.05], [2, 0.3, 1, 6, 1000], [0.1, 0.05, 0.2, 0.5, 200]], float)
START_LAYOUT = np.array([[100, 90, 0.5, 0.2], [100, 90, 0.5, 0.2], [1000, 0.01, 900, 90], [200, 0.002, 190, 1]], float)
START_END = np.array([[100, 1, 0.3], [100, 1, 0.1], [1000, 30, 0.1], [0.1, 0.1, 200]], float)

#: What a scanner reads, and what may have stood there.
CONFUSED = {
    "1": "l i", "0": "o", "5": "s", "3": "e", "8": "b", "6": "b g", "9": "g", "2": "z", "4": "a", "7": "t", "@": "a", "$": "s", "|": "l i", "!": "l i",
    "€": "e", "¢": "c", "c": "e o", "e": "c o", "o": "e c a", "a": "o", "rn": "m", "m": "rn in ni", "cl": "d", "d": "cl", "ri": "n", "n": "ri u h", "u": "n ii",
    "ii": "u n", "in": "m", "ni": "m", "f": "t", "t": "f l", "q": "g", "g": "q y", "h": "b li n", "li": "h", "b": "h", "vv": "w", "w": "vv", "v": "y", "y": "v g", "i": "l j", "l": "i t",
    "j": "i", "s": "5", "z": "2", "x": "k", "k": "x", "nn": "rm", "tl": "d",
}
_SWAPS = [(k, v.split()) for k, v in CONFUSED.items()]
_BY_FIRST: dict[str, list[tuple[str, list[str]]]] = {}
for _bad, _goods in _SWAPS:
    _BY_FIRST.setdefault(_bad[0], []).append((_bad, _goods))
_NUMBER = regex.compile(r"(?i)[\W_]*(?:page\s+|p\.\s*|seite\s+|pag\.?\s+)?[\dOlISB]{1,4}(?:\s*(?:of|/|von|de)\s*[\dOlISB]{1,4})?[^\w.,;:]*")
_HAS_DIGIT = regex.compile(r"\d|^[\W_]*[OlI]{1,3}[\W_]*$|(?i:^page)")
_TOKEN = regex.compile(r"[^\W_](?:[\p{L}\p{M}\p{N}@$|!€¢'’-]*[\p{L}\p{M}\p{N}@$|!€¢])?")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:[-'’]\p{L}[\p{L}\p{M}]*)*")
_HALF = regex.compile(r"[\p{L}\p{M}\p{N}@$|!'’-]*\Z")
_HEADLINE = regex.compile(r"[^.!?]*[^.!?,;-]")


class Lexicon:
    """The usual words of the corpus and the parts before a hyphen; asks for misreadings are remembered up to a bound."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        self.order = sorted(words)
        self.heads = {w.split("-", 1)[0] for w in words if "-" in w}
        self._misread: dict[str, tuple[str, int] | None] = {}
        self._pieces: dict[str, list[str]] = {}

    def misread(self, token: str) -> tuple[str, int] | None:
        """The word a token was misread from, and where; None if it is usual or nothing is near."""
        if token in self._misread:
            return self._misread[token]
        if len(self._misread) > 300_000:
            self._misread.clear()
        found = self._misread[token] = self._find(token)
        return found

    def asked(self, text: str) -> list[str]:
        """The tokens of a piece of text between blanks that the list lacks."""
        known = self._pieces.get(text)
        if known is None:
            if len(self._pieces) > 300_000:
                self._pieces.clear()
            known = self._pieces[text] = [t for t, _ in _unlisted(text, self)]
        return known

    def _find(self, token: str) -> tuple[str, int] | None:
        t = token.lower()
        if len(t) < 3 or t in self.words or t.strip("'’") in self.words:
            return None
        whole = self.misread_whole(token)
        if whole is None and "-" in t:
            for at, part in _parts(token)[1:]:
                inner = self.misread(part)
                if inner:
                    return inner[0], at + inner[1]
        return whole

    def misread_whole(self, token: str) -> tuple[str, int] | None:
        """As ``misread``, without a look at the parts between hyphens."""
        t = token.lower()
        if len(t) < 3 or t in self.words or t.strip("'’") in self.words:
            return None
        if token.isupper() is False and any(c.isupper() for c in token[1:]):
            t = "".join("l" if c == "I" and k else c.lower() for k, c in enumerate(token))
            if t in self.words and "I" in token[1:]:
                return t, token.index("I", 1)
        best, at, _ = self._nearest(t, 2 if len(t) > 5 else 1)
        return (best, at) if best else None

    def _nearest(self, t: str, most: int) -> tuple[str | None, int, int]:
        """The word of fewest undone confusions, of these the most usual, the first place and how many; only beginnings of words are followed."""
        words, order, n = self.words, self.order, len(t)
        best: tuple[int, int, str, int] | None = None
        stack = [(0, "", 0, n)]
        while stack:
            k, head, slips, place = stack.pop()
            if k == n:
                if slips and head in words:
                    found = (slips, -words[head], head, place)
                    if best is None or found < best:
                        best = found
                continue
            follow = [(t[k], 1, slips)]
            if slips < most and (best is None or slips < best[0]):
                follow += [(g, len(bad), slips + 1) for bad, goods in _BY_FIRST.get(t[k], ()) if t.startswith(bad, k) for g in goods]
            for piece, used, s in follow:
                longer = head + piece
                at = bisect.bisect_left(order, longer)
                if at < len(order) and order[at].startswith(longer):
                    stack.append((k + used, longer, s, place if s == slips else min(place, k)))
        return (best[2], best[3], best[0]) if best else (None, 0, 0)

    def is_cut(self, half: str, rest: str | None) -> bool:
        """Whether the hyphen after ``half`` only cuts the word that goes on with ``rest`` (None: not known)."""
        a = half.lower()
        if not a or not a[-1].isalnum():
            return False
        if rest is None or not rest:
            return a.rsplit("-", 1)[-1] not in self.heads
        b = rest.lower()
        if not b[0].isalpha() and not b[0].isdigit():
            return False
        whole, own = a + b, f"{a}-{b}"
        nw, no = self.words.get(whole, 0), self.words.get(own, 0)
        if nw or no:
            return nw >= no
        if self.misread(own) and "-" in self.misread(own)[0]:
            return False
        if self.misread(whole):
            return True
        if "-" in a and self.words.get(a.split("-")[-1] + b, 0):
            return True
        if a.rsplit("-", 1)[-1] in self.heads and (b in self.words or self.misread(b)):
            return False
        return rest[0].islower() or rest[0].isdigit()


def _undone(t: str) -> Iterator[tuple[str, int]]:
    for bad, goods in _SWAPS:
        k = t.find(bad)
        while k >= 0:
            for g in goods:
                yield t[:k] + g + t[k + len(bad) :], k
            k = t.find(bad, k + 1)


class LineModel:
    """The hidden Markov model in logarithms."""

    def __init__(self, counts: np.ndarray | None = None):
        start = np.concatenate([x.ravel() for x in (START_FIRST, START_MOVES, START_SHAPE, START_LAYOUT, START_END)])
        if counts is not None:
            # what was counted is scaled to the weight of the start, so the start only smooths it
            start = start + counts * min(1.0, 20 * start.sum() / max(1.0, counts.sum()))
        parts, at = [], 0
        for shape in ((1, 4), (4, 4), (4, len(SHAPES)), (4, len(LAYOUTS)), (4, len(ENDS))):
            n = shape[0] * shape[1]
            part = start[at : at + n].reshape(shape)
            parts.append(np.log(part / part.sum(1, keepdims=True)))
            at += n
        first, moves, shape, layout, end = parts
        self.first, self.moves = first[0].tolist(), moves.tolist()
        self.emit = {(a, b, c): (shape[:, a] + layout[:, b] + end[:, c]).tolist() for a in range(len(SHAPES)) for b in range(len(LAYOUTS)) for c in range(len(ENDS))}
        self.size = len(start)

    def label(self, seen: list[tuple[int, int, int]]) -> list[int]:
        """The likeliest states of the lines."""
        if not seen:
            return []
        moves, score, back = self.moves, None, []
        for o in seen:
            e = self.emit[o]
            if score is None:
                score = [self.first[s] + e[s] for s in range(4)]
                continue
            step, ptr = [], []
            for s in range(4):
                c0, c1, c2, c3 = score[0] + moves[0][s], score[1] + moves[1][s], score[2] + moves[2][s], score[3] + moves[3][s]
                m = max(c0, c1, c2, c3)
                ptr.append(2 if m == c2 else 3 if m == c3 else 0 if m == c0 else 1)
                step.append(m + e[s])
            score = step
            back.append(ptr)
        s = max(range(4), key=score.__getitem__)
        out = [s]
        for ptr in reversed(back):
            s = ptr[s]
            out.append(s)
        return out[::-1]

    def count(self, seen: list, states: list[int], into: np.ndarray) -> None:
        prev = None
        for (a, b, c), s in zip(seen, states):
            into[s if prev is None else 4 + prev * 4 + s] += 1
            into[20 + s * len(SHAPES) + a] += 1
            into[20 + 4 * len(SHAPES) + s * len(LAYOUTS) + b] += 1
            into[20 + 4 * (len(SHAPES) + len(LAYOUTS)) + s * len(ENDS) + c] += 1
            prev = s


def line_shape(line: str, recurring: bool) -> int:
    t = line.strip()
    if not t:
        return 0
    if len(t) < NUMBER_CHARS and _NUMBER.fullmatch(t) and _HAS_DIGIT.search(t):
        return 1
    if recurring:
        return 2
    words = t.split()
    if len(words) <= 9 and _HEADLINE.fullmatch(t) and (t.isupper() and len(words) > 1 or regex.match(r"\p{Lu}[\p{L}\p{N}-]+: \p{L}", t) or (words[-1].isdigit() and t[0].isupper() and len(words) > 1)):
        return 3
    return 4


def line_end(line: str, following: list[str], lexicon: Lexicon) -> int:
    """Whether a line ends in a hyphen of its own or one that cuts; ``following``: the lines after it, the nearest first."""
    t = line.rstrip()
    if len(t) < 2 or t[-1] not in "-‐­¬" or not t[-2].isalnum():
        return 0
    half = _HALF.search(t[:-1]).group()
    rest = None
    for f in following:
        if f.strip() and line_shape(f, False) in (2, 4):
            m = _TOKEN.match(f.lstrip())
            rest = m.group() if m else ""
            break
    return 2 if lexicon.is_cut(half, rest) else 1


def observe(lines: list[str], recurring: set[int], layouts: list[int] | None, lexicon: Lexicon) -> list[tuple[int, int, int]]:
    shapes = [line_shape(x, k in recurring) for k, x in enumerate(lines)]
    out = []
    for k, x in enumerate(lines):
        end = 0
        if x.rstrip()[-1:] in ("-", "‐", "­", "¬") and x.rstrip()[-1:]:
            after = [lines[m] for m in range(k + 1, min(len(lines), k + 6)) if shapes[m] not in (1, 2, 3) and (layouts is None or layouts[m] != 1)]
            end = line_end(x, after, lexicon)
        out.append((shapes[k], 0 if layouts is None else layouts[k], end))
    return out


def _counted(texts: DataFrame) -> DataFrame:
    """word, n_text, n_scan of the words of columns text and is_scan; counted in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = (Counter(), Counter())
            for t, scan in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # words at a line end may be cut
                both[bool(scan)].update(w.lower() for w in _WORD.findall(regex.sub(r"\S+-\s*\n\s*\S*", " ", t) if "-" in t and "\n" in t else t))
            words = list(both[0] | both[1])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([both[0][w] for w in words], pa.int64()), pa.array([both[1][w] for w in words], pa.int64())], names=["word", "n_text", "n_scan"])

    return texts.mapInArrow(run, "word string, n_text long, n_scan long").groupBy("word").agg(F.sum("n_text").alias("n_text"), F.sum("n_scan").alias("n_scan"))


#: Share of all words a word must make up to be on the list; it bounds the list's length by its inverse.
LEAST_SHARE = 4e-7


def build_lexicon(sections: DataFrame) -> tuple[dict[str, int], DataFrame]:
    """The usual words of the whole table, those of text layers, and of scans where no likelier word is near; and the counts of all words."""
    texts = sections.select(F.explode("contents").alias("text"), (F.col("layer") == "ocr").alias("is_scan")).filter(F.length("text") > 0)
    counts = cut(_counted(texts))
    total = counts.agg(F.sum("n_text") + F.sum("n_scan")).first()[0] or 0
    least = max(2, math.ceil(total * LEAST_SHARE))
    rows = counts.filter((F.col("n_text") >= least) | (F.col("n_scan") >= 25 * least)).toPandas()
    words = {w: int(n) for w, n in zip(rows["word"], rows["n_text"]) if n >= least}
    for w, t, s in zip(rows["word"], rows["n_text"], rows["n_scan"]):
        if w not in words and not any(words.get(c, 0) > s / 5 for c, _ in _undone(w)):
            words[w] = int(s)
    return words, counts


#: Every confusion as (read, stood); letters of the model of new words: a to z, the start of a word, other letters, other signs; and its lengths.
PAIRS = [(bad, good) for bad, goods in _SWAPS for good in goods]
_START, _CLASSES, _LENGTHS = 26, 29, 33
#: Counts up to this are corrected by how many words have them (Good-Turing).
_LOW_COUNTS = 10


def _classes(word: str) -> list[int]:
    return [_START, *(ord(c) - 97 if "a" <= c <= "z" else 27 if c.isalpha() else 28 for c in word)]


class Channel:
    """How often each confusion happens and what a word not seen before looks like, as logarithms; measured on the corpus, of fixed size."""

    SIZE = 2 * len(PAIRS) + _CLASSES**2 + _LENGTHS + _LOW_COUNTS + 2

    def __init__(self, counts: np.ndarray, least: int):
        n = len(PAIRS)
        hits, chances, letters, lengths, self._of_count = np.split(counts, np.cumsum([n, n, _CLASSES**2, _LENGTHS]))
        letters = letters.reshape(_CLASSES, _CLASSES)
        # a confusion never counted starts as one in a thousand, with the weight of a hundred readings
        self.slip = dict(zip(PAIRS, np.log(np.minimum(1, (hits + 0.1) / (chances + 100))).tolist()))
        self._letters = np.log((letters + 0.5) / (letters.sum(1, keepdims=True) + 0.5 * _CLASSES)).tolist()
        self._lengths = np.log((lengths + 0.5) / (lengths.sum() + 0.5 * _LENGTHS)).tolist()
        self._once = math.log(max(self._of_count[1], 1e-9))
        #: The logarithm of the largest count of a word that is not listed.
        self.most = math.log(max(1, least - 1))

    def new(self, token: str) -> float:
        """The weight of the token as a word not seen before: new words come as often, and look, as those seen once."""
        seen = _classes(token)
        return self._once + self._lengths[min(len(token), _LENGTHS - 1)] + sum(self._letters[a][b] for a, b in zip(seen, seen[1:]))

    def weight(self, n: int) -> float:
        """The weight of a word counted n times; few counts say too much of a word."""
        if n <= _LOW_COUNTS:
            n = min(n, (n + 1) * (self._of_count[n + 1] + 1) / (self._of_count[n] + 1))
        return math.log(n)

    def spellings(self, t: str, most: int, least: float) -> Iterator[tuple[str, int, int, float]]:
        """What may have stood where t was read: spelling, confusions, first place, and their weight if above least."""
        stack = [(0, "", 0, len(t), 0.0)]
        while stack:
            k, head, slips, place, chance = stack.pop()
            if slips:
                yield head + t[k:], slips, place, chance
            if slips == most:
                continue
            for i in range(k, len(t)):
                for bad, goods in _BY_FIRST.get(t[i], ()):
                    if t.startswith(bad, i):
                        for g in goods:
                            if chance + self.slip[bad, g] > least:
                                stack.append((i + len(bad), head + t[k:i] + g, slips + 1, min(place, i), chance + self.slip[bad, g]))


def _measure(counts: DataFrame, lexicon) -> np.ndarray:
    """The counts of a Channel: confusions that give a listed word, chances for them, letters of words seen once, words by count."""
    n = len(PAIRS)
    at = {p: k for k, p in enumerate(PAIRS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = _lexicon(lexicon)
        out = np.zeros(Channel.SIZE)
        for batch in batches:
            for w, text, scan in zip(*(c.to_pylist() for c in batch.columns)):
                if 0 < text <= _LOW_COUNTS + 1:
                    out[2 * n + _CLASSES**2 + _LENGTHS + text] += 1
                if w in lex.words:
                    if scan:
                        out[n : 2 * n] += [scan * w.count(good) for _, good in PAIRS]
                    continue
                if scan and not text and len(w) > 2:
                    near = [(lex.words[w[:k] + good + w[k + len(bad) :]], bad, good) for bad, good in PAIRS for k in range(len(w)) if w.startswith(bad, k) and w[:k] + good + w[k + len(bad) :] in lex.words]
                    if near:
                        out[at[max(near)[1:]]] += scan
                if text == 1:
                    seen = _classes(w)
                    for a, b in zip(seen, seen[1:]):
                        out[2 * n + a * _CLASSES + b] += 1
                    out[2 * n + _CLASSES**2 + min(len(w), _LENGTHS - 1)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(out)], names=["at", "n"])

    out = np.zeros(Channel.SIZE)
    for r in counts.mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def _parts(token: str) -> list[tuple[int, str]]:
    """The token, and the parts between its hyphens that are asked if it is neither known nor misread as a whole, with their places."""
    out, at = [(0, token)], 0
    if "-" in token:
        for part in token.split("-"):
            if len(part) > 3:
                out.append((at, part))
            at += len(part) + 1
    return out


def _as_read(token: str) -> str:
    """Lower case, a capital I inside a word of small letters as the l it looks like."""
    if not token.isupper() and any(c.isupper() for c in token[1:]):
        return "".join("l" if c == "I" and k else c.lower() for k, c in enumerate(token))
    return token.lower()


SPELLING_ROWS = "token string, part int, slips int, place int, chance double, word string"


def _token_spellings(token: str, lex: Lexicon, channel: Channel) -> Iterator[tuple]:
    """Rows of SPELLING_ROWS: what to look up among all words for a token, and one row that finds nothing."""
    yield token, 0, -1, 0, 0.0, "\0" + token
    for no, (_, part) in enumerate(_parts(token)):
        t = part.lower()
        if len(t) < 3 or t in lex.words or t.strip("'’") in lex.words:
            continue
        for w in {t, t.strip("'’")}:
            yield token, no, 0, 0, 0.0, w
        read, most = _as_read(part), 2 if len(t) > 5 else 1
        if read != t and read in lex.words or lex._nearest(read, most)[2] == 1:
            continue
        if read != t:
            yield token, no, 1, part.index("I", 1), channel.slip["i", "l"], read
        best: dict[str, tuple] = {}
        for w, slips, place, chance in channel.spellings(read, most, channel.new(read) - channel.most):
            if w not in best or chance > best[w][2]:
                best[w] = slips, place, chance
        for w, x in best.items():
            if w not in lex.words:
                yield token, no, *x, w


def _settled(token: str, found: list[tuple[int, int, int, float, str, int]], lex: Lexicon, channel: Channel) -> tuple[str, int] | None:
    """The word a token was misread from, and where; ``found``: part, confusions, place, weight, word and count of the words there are."""
    if {token.lower(), token.lower().strip("'’")} & lex.words.keys():
        return None
    for no, (at, part) in enumerate(_parts(token)):
        own = [x for x in found if x[0] == no]
        if any(x[1] == 0 for x in own):
            if no == 0:
                return None
            continue
        read = _as_read(part)
        hit = lex.misread(part) if no else lex.misread_whole(token)
        best = max(((chance + channel.weight(n), word, place) for _, _, place, chance, word, n in own), default=None)
        if best and best[0] <= channel.new(read):
            best = None
        if hit and best:
            listed = max((c for w, _, _, c in channel.spellings(read, 2, -math.inf) if w == hit[0]), default=0.0) + math.log(max(1, lex.words.get(hit[0], 1)))
            best = best if best[0] > listed else None
        if best or hit:
            word, place = best[1:] if best else hit
            return word, at + place
    return None


def misread_words(tokens: DataFrame, counts: DataFrame, lexicon, channel) -> DataFrame:
    """token, word, place of the misread ones of the unlisted tokens: every word of the text layer may be what stood there.

    The distinct tokens meet the whole count table by their spellings; those that
    could not win against a new word even with the largest count are left out.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, ch = _lexicon(lexicon), channel.value
        for batch in batches:
            rows = [r for t in batch.column(0).to_pylist() for r in _token_spellings(t, lex, ch)]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)], names=[f.split()[0] for f in SPELLING_ROWS.split(", ")])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, ch = _lexicon(lexicon), channel.value
        for batch in batches:
            rows = []
            for token, found in zip(*(c.to_pylist() for c in batch.columns)):
                hit = _settled(token, [tuple(x.values()) for x in found if x["n_text"] is not None], lex, ch)
                if hit:
                    rows.append((token, *hit))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 3, (pa.string(), pa.string(), pa.int32()))], names=["token", "word", "place"])

    all_words = counts.filter("n_text > 0").select("word", "n_text")
    met = tokens.distinct().mapInArrow(spell, SPELLING_ROWS).join(all_words, "word", "left").filter("n_text IS NOT NULL OR slips < 0")
    return cut(met.groupBy("token").agg(F.collect_list(F.struct("part", "slips", "place", "chance", "word", "n_text")).alias("found")).mapInArrow(settle, "token string, word string, place int"))


#: A running header has at most so many characters and words and at least so many letters; page numbers are shorter than that.
HEADER_CHARS, HEADER_WORDS, HEADER_LETTERS, NUMBER_CHARS = 80, 9, 8, 24
#: Rounds of Viterbi training, each over all lines.
TRAINING_ROUNDS = 2


def _recurring(sections: DataFrame) -> DataFrame:
    """section_id, lines (item_no, line_no): short lines that recur within their paper between different lines.

    Only short lines are shuffled. A line of a paragraph that is itself repeated
    stands between the same lines each time and is not taken for a header.
    """

    def plain(c):
        t = F.regexp_replace(F.lower(c), r"^[^\p{L}]+|[^\p{L}]+$", "")
        for k, v in (("rn", "m"), ("cl", "d"), ("ri", "n"), (r"\s+", " ")):
            t = F.regexp_replace(t, k, v)
        return F.translate(t, "1l|!05@ceqfa", "iiiiosaoogto")

    all_lines = F.split("text", "\n")
    # a header begins with a capital, or a letter of a script without case
    short = lambda x: (F.length(x) <= HEADER_CHARS) & x.rlike(r"^[^\p{L}]*[\p{Lu}\p{Lt}\p{Lo}]") & ~x.rlike(r"[-.,;:]\s*$") & x.rlike(r"\p{L}{3}") & ~x.rlike(rf"(?:\S+\s+){{{HEADER_WORDS}}}\S")
    near = lambda i: F.translate(F.lower(F.get(all_lines, i)), "0123456789", "")
    placed = F.transform(all_lines, lambda x, i: F.when(short(x), F.struct(i.alias("line_no"), x.alias("line"), F.xxhash64(near(i - 1), near(i + 1)).alias("between"))))
    same = Window.partitionBy("paper_id", "k")
    lines = (
        sections.select("paper_id", "section_id", F.posexplode("contents").alias("item_no", "text"))
        .filter(F.col("text").contains("\n"))
        .select("paper_id", "section_id", "item_no", F.inline(F.filter(placed, lambda s: s.isNotNull())))
        .select("paper_id", "section_id", "item_no", "line_no", plain(F.col("line")).alias("k"), "between")
        .filter(F.length("k") >= HEADER_LETTERS)
        .withColumns({"least": F.min("between").over(same), "most": F.max("between").over(same)})
        .filter("least <> most")
    )
    return lines.groupBy("section_id").agg(F.collect_set(F.struct("item_no", "line_no")).alias("lines"))


def _content_rows(sections: DataFrame) -> DataFrame:
    scanned = sections.filter("layer = 'ocr'")
    return scanned.select("section_id", "contents").join(_recurring(scanned), "section_id", "left")


def _paragraph_lines(batch: pa.RecordBatch, lexicon: Lexicon) -> Iterator[tuple]:
    """section_id, item_no, lines, observations of every paragraph of a batch."""
    for sid, contents, marks in zip(*(batch.column(k).to_pylist() for k in range(3))):
        at: dict[int, set[int]] = {}
        for m in marks or ():
            at.setdefault(m["item_no"], set()).add(m["line_no"])
        for no, text in enumerate(contents or ()):
            if text and text.strip():
                lines = text.split("\n")
                yield sid, no, lines, observe(lines, at.get(no, set()), None, lexicon)


def _word_pages(words: DataFrame) -> DataFrame:
    """The words in reading order, a page in one partition; rows repeated as they are come once."""
    cols = ["paper_id", "page_number", "block_idx", "line_idx", "word_idx", "word_id", "text", "y", "height"]
    return words.select(*cols).repartition("paper_id", "page_number").sortWithinPartitions("paper_id", "page_number", "block_idx", "line_idx", "word_idx", "word_id")


def _page_lines(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[tuple]:
    """paper, page, observations, word ids and word texts by line of every page, whole even where a batch ends inside one.

    Words that are blank do not count; a row repeated as it is comes once. A line
    is told by its height against the page's median and by its place at an edge.
    """
    held: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)] + [np.array(batch.column(6).to_pylist(), object)] + [batch.column(k).to_numpy(zero_copy_only=False) for k in (7, 8)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        n = len(cols[0])
        last = n - 1  # where the last page begins: it may go on in the next batch
        while last and cols[0][last - 1] == cols[0][n - 1] and cols[1][last - 1] == cols[1][n - 1]:
            last -= 1
        held = [c[last:] for c in cols]
        yield from _cut_pages([c[:last] for c in cols], lexicon)
    if held is not None:
        yield from _cut_pages(held, lexicon)


def _cut_pages(cols: list[np.ndarray], lexicon: Lexicon) -> Iterator[tuple]:
    n = len(cols[0])
    if not n:
        return
    once = np.r_[True, cols[5][1:] != cols[5][:-1]]
    paper, page, block, line, _, word_id, text, y, height = (c[once] for c in cols)
    n = len(paper)
    new_page = np.r_[True, (paper[1:] != paper[:-1]) | (page[1:] != page[:-1])]
    new_line = new_page | np.r_[True, (block[1:] != block[:-1]) | (line[1:] != line[:-1])]
    starts = np.flatnonzero(new_line)
    top = np.fmin.reduceat(y.astype(float), starts)
    tall = np.fmax.reduceat(height.astype(float), starts)
    texts = [t.strip() if t else "" for t in text]
    ids = word_id.tolist()
    bounds = [*starts.tolist(), n]
    first_line = np.flatnonzero(new_page[starts]).tolist() + [len(starts)]
    for a, b in zip(first_line, first_line[1:]):
        lo, hi = bounds[a], bounds[b]
        own_top, own_tall = np.nan_to_num(top[a:b]), tall[a:b]
        usual = float(np.nanmedian(height[lo:hi].astype(float))) if np.isfinite(height[lo:hi].astype(float)).any() else 0.0
        own_tall = np.where(np.isnan(own_tall), usual, own_tall)
        edge = (own_top == own_top.min()) | (own_top == own_top.max())
        edge[0] = edge[-1] = True
        layouts = np.where(own_tall > 1.15 * usual, 3, np.where((own_tall < 0.9 * usual) & edge, 1, 2)).tolist()
        kept = [[k for k in range(bounds[m], bounds[m + 1]) if texts[k]] for m in range(a, b)]
        lines = [" ".join([texts[k] for k in ks]) for ks in kept]
        yield paper[lo], page[lo], observe(lines, set(), layouts, lexicon), [[ids[k] for k in ks] for ks in kept], [[texts[k] for k in ks] for ks in kept]


LINE_ROWS = "paper_id long, page_number int, shape array<int>, layout array<int>, end array<int>, ids array<array<long>>, texts array<array<string>>"


def _observed_pages(words: DataFrame, lexicon) -> DataFrame:
    """A row for each page: the observations of its lines and their words that are not blank."""
    kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = _lexicon(lexicon)
        names = [f.split()[0] for f in LINE_ROWS.split(", ")]
        rows: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], names=names)
        for paper, page, seen, ids, texts in _page_lines(batches, lex):
            rows.append((paper, page, *([o[k] for o in seen] for k in range(3)), ids, texts))
            if len(rows) >= 64:
                yield pack()
                rows = []
        yield pack()

    return cut(_word_pages(words).mapInArrow(run, LINE_ROWS))


def _observations(batch: pa.RecordBatch, first: int = 0) -> Iterator[list[tuple[int, int, int]]]:
    for shapes, layouts, ends in zip(*(batch.column(first + k).to_pylist() for k in range(3))):
        yield list(zip(shapes, layouts, ends))


def _train(contents: DataFrame, pages: DataFrame, lexicon, before: np.ndarray | None = None) -> np.ndarray:
    """One round of Viterbi training over all lines, with the counts of the round ``before``; a table of fixed size comes back."""

    def total(sequences: Iterator[list]) -> pa.RecordBatch:
        model = LineModel(before)
        counts = np.zeros(model.size)
        for seen in sequences:
            model.count(seen, model.label(seen), counts)
        return pa.RecordBatch.from_arrays([pa.array(range(model.size), pa.int32()), pa.array(counts)], names=["at", "n"])

    def of_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = _lexicon(lexicon)
        yield total(seen for batch in batches for *_, seen in _paragraph_lines(batch, lex))

    def of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield total(seen for batch in batches for seen in _observations(batch))

    both = contents.mapInArrow(of_contents, "at int, n double").unionByName(pages.select("shape", "layout", "end").mapInArrow(of_pages, "at int, n double"))
    rows = both.groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(LineModel().size)
    for r in rows:
        out[r["at"]] = r["n"]
    return out


_lexicons: dict[int, Lexicon] = {}


def _lexicon(shared) -> Lexicon:
    value = shared.value
    if id(value) not in _lexicons:
        _lexicons.clear()
        _lexicons[id(value)] = Lexicon(value)
    return _lexicons[id(value)]


def _unlisted(line: str, lexicon: Lexicon) -> list[tuple[str, int]]:
    """The tokens of a line of running text that the list lacks and a scanner can have misread, and where they start."""
    return [(t, m.start()) for m in _TOKEN.finditer(line) if len(t := m.group()) > 2 and (low := t.lower()) not in lexicon.words and not _BY_FIRST.keys().isdisjoint(low) and any(c.isalpha() for c in t)]


class OcrRepair:
    """The trained operator over a sections and a words table."""

    def __init__(self, sections: DataFrame, words: DataFrame):
        spark = sections.sparkSession
        words_listed, self.word_counts = build_lexicon(sections)
        self.lexicon = spark.sparkContext.broadcast(words_listed)
        least = min(words_listed.values(), default=2)
        self.channel = spark.sparkContext.broadcast(Channel(_measure(self.word_counts, self.lexicon), least))
        self.contents = cut(_content_rows(sections))
        self.pages = _observed_pages(words, self.lexicon)
        self.counts = None
        for _ in range(TRAINING_ROUNDS):
            self.counts = _train(self.contents, self.pages, self.lexicon, self.counts)

    def _misread(self, tokens: DataFrame) -> DataFrame:
        return misread_words(tokens, self.word_counts, self.lexicon, self.channel)

    def content_noise(self) -> DataFrame:
        """NOISE_ROWS of the paragraphs of scanned sections."""
        shared, counts = self.lexicon, self.counts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lex, model = _lexicon(shared), LineModel(counts)
            for batch in batches:
                rows = []
                for sid, no, lines, seen in _paragraph_lines(batch, lex):
                    states = model.label(seen)
                    if BREAK in states:
                        rows.append((sid, no, "break", None, None, None))
                    if any(s in (HEADER, NUMBER) and o[0] for s, o in zip(states, seen)):
                        rows.append((sid, no, "furniture", None, None, None))
                    rows += [(sid, no, "misread", t, None, None) for t in sorted({t for t, _ in _unlisted(join_lines(lines, states), lex)})]
                yield _noise(rows)

        return self.contents.mapInArrow(run, NOISE_ROWS)

    def paragraphs(self) -> DataFrame:
        """section_id, item_no, text: the paragraphs of scanned sections, continuous and without noise."""
        shared, counts = self.lexicon, self.counts

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lex, model = _lexicon(shared), LineModel(counts)
            for batch in batches:
                rows = []
                for sid, no, lines, seen in _paragraph_lines(batch, lex):
                    body = join_lines(lines, model.label(seen))
                    rows.append((sid, no, body, sorted({t for t, _ in _unlisted(body, lex)})))
                cols = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string())))], names=["section_id", "item_no", "text", "tokens"])

        def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lex = _lexicon(shared)
            for batch in batches:
                texts = []
                for body, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    words = {x["token"]: x["word"] for x in found or ()}
                    for t, at in reversed(_unlisted(body, lex) if words else []):
                        word = words.get(t)
                        if word and ("-" not in t or "-" in word):
                            body = body[:at] + (word[:1].upper() + word[1:] if t[:1].isupper() else word) + body[at + len(t) :]
                    texts.append(body)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["section_id", "item_no", "text"])

        bodies = cut(self.contents.mapInArrow(join, "section_id long, item_no int, text string, tokens array<string>"))
        asked = bodies.select("section_id", "item_no", F.explode("tokens").alias("token")).distinct()
        found = asked.join(self._misread(asked.select("token")), "token").groupBy("section_id", "item_no").agg(F.collect_list(F.struct("token", "word")).alias("found"))
        return bodies.drop("tokens").join(found, ["section_id", "item_no"], "left").mapInArrow(repair, "section_id long, item_no int, text string")

    def word_noise(self) -> DataFrame:
        """NOISE_ROWS of the words table; item_no is 0."""
        shared, counts = self.lexicon, self.counts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lex, model = _lexicon(shared), LineModel(counts)
            out: list[tuple] = []
            for batch in batches:
                for seen, ids, texts in zip(_observations(batch), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                    out += _page_noise(ids, texts, seen, model.label(seen), lex)
                    if len(out) > 20_000:
                        yield _noise(out)
                        out = []
            yield _noise(out)

        return self.pages.select("shape", "layout", "end", "ids", "texts").mapInArrow(run, NOISE_ROWS)

    def found(self) -> DataFrame:
        """field_name, row_id, item_no, noise_kind of both tables, each once."""
        c = self.content_noise().withColumn("field_name", F.lit("contents"))
        rows = cut(c.unionByName(self.word_noise().withColumn("field_name", F.lit("word"))))
        asked = rows.filter("token IS NOT NULL")
        misread = asked.join(self._misread(asked.select("token")), "token").filter("start IS NULL OR start <= place AND place < stop")
        cols = ["field_name", "row_id", "item_no", "noise_kind"]
        return rows.filter("token IS NULL").select(*cols).unionByName(misread.select(*cols)).distinct()


#: A row with a token counts if the token is misread, and first from place start on before stop, if they are given.
NOISE_ROWS = "row_id long, item_no int, noise_kind string, token string, start int, stop int"
_NO_END = 1 << 30


def _page_noise(ids: list[list[int]], texts: list[list[str]], seen: list, states: list[int], lex: Lexicon) -> list[tuple]:
    """NOISE_ROWS of the words of a page."""
    out: list[tuple] = []
    usual = lex.words
    pending: list[tuple[int, str]] = []  # the parts so far of a cut word
    for row_ids, words, s, o in zip(ids, texts, states, seen):
        if s in (HEADER, NUMBER):
            out += [(r, 0, "furniture", None, None, None) for r in row_ids]
            continue
        if o[1] == 3 or not words:  # a title
            continue
        last = len(words) - 1
        for k, t in enumerate(words):
            is_break = k == last and s == BREAK
            if is_break:
                out.append((row_ids[k], 0, "break", None, None, None))
            if k == 0 and pending and not is_break:
                m = _TOKEN.match(t)
                whole = "".join(piece for _, piece in pending) + m.group() if m else ""
                if m and whole.lower() not in usual:
                    at = 0
                    for r, piece in pending:
                        out.append((r, 0, "misread", whole, at, at + len(piece)))
                        at += len(piece)
                    out.append((row_ids[0], 0, "misread", whole, at, _NO_END))
                pending = []
            elif is_break:
                pending = (pending if k == 0 else []) + [(row_ids[k], _HALF.search(t[:-1]).group())]
            elif t not in usual:
                out += [(row_ids[k], 0, "misread", token, None, None) for token in lex.asked(t)]
    return out


def _noise(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)], names=[f.split()[0] for f in NOISE_ROWS.split(", ")])


def join_lines(lines: list[str], states: list[int]) -> str:
    """The body lines as one text: cut words joined, headers and numbers left out."""
    out, glue = "", True
    for line, s in zip(lines, states):
        t = line.strip()
        if s in (HEADER, NUMBER) or not t:
            continue
        out += t if glue else " " + t
        glue = False
        if s == BREAK:
            out, glue = out.rstrip("-‐­¬"), True
        elif out.endswith("-"):
            glue = True
    return out
