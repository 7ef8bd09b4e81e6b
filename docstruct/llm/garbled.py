"""Problem 9: text decoded with a wrong encoding, found and restored by expectation-maximization.

Every line has a hidden chain: none, or a way it was garbled (written in one
encoding, read in another, perhaps twice). A character model of the whole
corpus says how likely a line is as it stands and with a chain undone; how
usual each chain is in a source and field is learned from all its lines by EM,
so that weak evidence in one line is helped by its fellows. The character model
is part of the maximization: what the first round finds garbled is taken out of
its counts, and the second round reads the whole corpus again. Each line is then
repaired by its posterior. No line with any evidence for a chain is left out, and
none of its chains.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstruct.scale import cut, spread

#: 8-bit encodings text is wrongly read in. Bytes an encoding leaves open are read as control characters.
READ_AS = ["cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "koi8_r", "cp866", "cp1253"]
READ_AS_WIDE = ["gb18030", "gbk", "cp932", "big5", "cp949"]
#: Chains to undo, as steps (written in, read as), the last garbling first.
CHAINS: list[tuple[tuple[str, str], ...]] = (
    [(("utf_8", d),) for d in READ_AS + READ_AS_WIDE]
    + [(("utf_8", d), ("utf_8", d)) for d in ("cp1252", "cp437", "cp850", "mac_roman")]
    + [((e, "cp1252"),) for e in ("mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866", "gb18030", "cp932", "euc_jp", "big5", "cp949")]
    + [((e, d),) for d, es in {"mac_roman": ["cp1252", "cp1251"], "cp437": ["cp1252", "cp866"], "cp850": ["cp1252", "cp866"], "cp1250": ["cp1252"], "cp1251": ["cp1252", "koi8_r", "cp866"], "koi8_r": ["cp1251", "cp866"], "cp866": ["cp1251", "koi8_r"], "gb18030": ["cp1252", "cp932", "euc_jp"], "gbk": ["cp1252"], "cp932": ["cp1252", "gb18030"]}.items() for e in es]
)
#: The chain of text with replacement characters: garbled, and not to be restored.
LOST = len(CHAINS)
CHAIN_NAMES = [", then ".join(f"{e} read as {d}" for e, d in steps) for steps in CHAINS] + ["lost"]

_SLOTS, _CHARS = 1 << 20, 1 << 16
#: Share of the words of a garbled line that are garbled themselves; the rest may be as they were.
WORD_SHARE = 0.7
_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3})+")


def _byte_of(name: str) -> dict[str, int]:
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 160):  # controls the encoding leaves open
        out.setdefault(chr(b), b)
    if name == "cp1252":
        for b in range(160, 256):
            out.setdefault(chr(b), b)
    return out


_BYTES = {d: _byte_of(d) for d in READ_AS}


def undo_step(word: str, written: str, read: str) -> str | None:
    """``word`` with one garbling undone, or None if it can't be a result of that garbling."""
    table = _BYTES.get(read)
    if table is None:  # a multi-byte encoding
        try:
            raw = word.encode(read)
        except UnicodeEncodeError:
            return None
        if len(raw) == len(word):
            return None
        out = raw.decode(written, "replace")
        return None if out.count("�") * 4 > len(out) else out
    if written == "utf_8":
        # only true UTF-8 sequences are undone, what stands between them stays
        raw = bytes(table.get(c, 0) if c > "\x7f" else ord(c) for c in word)
        parts, at = [], 0
        for m in _UTF8.finditer(raw):
            parts += [word[at : m.start()], m.group().decode("utf-8", "replace")]
            at = m.end()
        return "".join(parts) + word[at:] if parts else None
    raw = bytearray()
    for c in word:
        if c > "\x7f":
            b = table.get(c)
            if b is None:
                return None
            raw.append(b)
        else:
            raw.append(ord(c))
    out = bytes(raw).decode(written, "replace")
    return None if out.count("�") * 4 > len(out) else out


def undo(word: str, chain: int) -> str | None:
    for written, read in CHAINS[chain]:
        word = undo_step(word, written, read)
        if word is None:
            return None
    return word


#: Characters that stand for a first byte of a UTF-8 sequence, and the chains by the encoding undone first.
_FIRST = {d: frozenset(c for c, b in t.items() if 0xC2 <= b <= 0xF4) for d, t in _BYTES.items()}
_BY_READ = {d: ([c for c in range(LOST) if CHAINS[c][0] == ("utf_8", d)], [c for c in range(LOST) if CHAINS[c][0][1] == d and CHAINS[c][0][0] != "utf_8"]) for d in READ_AS + READ_AS_WIDE}


def _possible(word: str) -> list[int]:
    """The chains whose undoing can succeed, told from the set of the word's characters."""
    high = {c for c in word if c > "\x7f"}
    out: list[int] = []
    for d, (utf8, others) in _BY_READ.items():
        table = _BYTES.get(d)
        if table is None:
            if max(high) >= "\u2e80":
                # single bytes read in pairs need letters beside them
                out += utf8 + [c for c in others if CHAINS[c][0][0] != "cp1252" or word.upper() != word.lower()]
        else:
            if not _FIRST[d].isdisjoint(high):
                out += utf8
            if others and high <= table.keys():
                out += others
    return sorted(out)


class CharModel:
    """A smoothed bigram model in two tables of fixed size."""

    def __init__(self, pairs: np.ndarray, chars: np.ndarray):
        total = max(1.0, float(chars.sum()))
        one = (np.maximum(chars, 0) + 0.02) / (total + 0.02 * _CHARS)
        self.log_one = array("d", np.log(one))
        self.pairs = array("d", np.maximum(pairs, 0).astype(float))
        self.chars = array("d", np.maximum(chars, 0).astype(float))
        self.one = array("d", one)

    def score(self, word: str, own: int = 0) -> float:
        """Log-probability of a word; ``own`` occurrences, those of the line at hand, are left out of the counts."""
        pairs, chars, one = self.pairs, self.chars, self.one
        s, a = 0.0, 32
        for ch in word + " ":
            b = ord(ch)
            n = pairs[(a * 40503 + b * 2654435) & 0xFFFFF] - own
            m = chars[a & 0xFFFF] - own
            s += math.log(((n if n > 0 else 0) + 3 * one[b & 0xFFFF]) / ((m if m > 0 else 0) + 3))
            a = b
        return s


def count_chars(text: str, pairs: np.ndarray, chars: np.ndarray) -> None:
    """Add the characters of ``text`` and their neighbours to the tables; a line ends like a word."""
    codes = np.frombuffer(text.replace("\n", " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes):
        chars += np.bincount((codes & 0xFFFF).astype(np.int64), minlength=_CHARS)
        a, b = codes[:-1], codes[1:]
        pairs += np.bincount(((a * 40503 + b * 2654435) & 0xFFFFF).astype(np.int64), minlength=_SLOTS)


class Evidence:
    """For each chain the log-likelihood ratio of a line, word by word; words are remembered up to a bound."""

    def __init__(self, model: CharModel, keep: int = 200_000):
        self.model, self.keep = model, keep
        self.words: dict[str, tuple] = {}
        self.lines: dict[str, tuple[list[int], list[float]]] = {}

    def word(self, w: str) -> tuple[tuple[int, float, str], ...]:
        """Chain, evidence and the word with the chain undone, of the chains that can be undone."""
        known = self.words.get(w)
        if known is None:
            if len(self.words) > self.keep:
                self.words.clear()
            known = self.words[w] = self._word(w)
        return known

    def _word(self, w: str) -> tuple[tuple[int, float, str], ...]:
        if "�" in w:
            return ((LOST, 60.0, w),)
        out, base, memo = [], None, {}
        for c in _possible(w):
            t = undo(w, c)
            if t is None or t == w:
                continue
            if base is None:
                base = self.model.score(w, 1)
            if t not in memo:
                memo[t] = math.log1p(WORD_SHARE * (math.exp(min(50.0, self.model.score(t) - base)) - 1))
            out.append((c, memo[t], t))
        return tuple(out)

    def line(self, line: str) -> dict[int, float]:
        """Summed evidence of the chains some word speaks for; words that lose by a chain speak against it."""
        total: dict[int, float] = {}
        gains: set[int] = set()
        for w in line.split(" "):
            if not w.isascii():
                for c, s, _ in self.word(w):
                    total[c] = total.get(c, 0.0) + s
                    if s > 0:
                        gains.add(c)
        return {c: total[c] for c in gains}

    def chains(self, line: str) -> tuple[list[int], list[float]]:
        """The chains with evidence for them and their evidence; of chains that give the same text the first."""
        known = self.lines.get(line)  # lines recur in many texts
        if known is None:
            if len(self.lines) > self.keep // 4:
                self.lines.clear()
            known = self.lines[line] = self._chains(line)
        return known

    def _chains(self, line: str) -> tuple[list[int], list[float]]:
        found = sorted((c, s) for c, s in self.line(line).items() if s > 0)
        if len(found) > 1:
            # equal texts have equal evidence: only those are compared
            often = Counter(s for _, s in found)
            if len(often) < len(found):
                words = [self.word(w) for w in line.split(" ") if not w.isascii()]
                seen: set[tuple] = set()
                kept = []
                for c, s in found:
                    if often[s] > 1:
                        it = (s, *(next((t for d, gain, t in known if d == c and gain > 0), "") for known in words if known))
                        if it in seen:
                            continue
                        seen.add(it)
                    kept.append((c, s))
                found = kept
        return [c for c, _ in found], [s for _, s in found]

    def repair(self, line: str, chain: int) -> str:
        """The line with ``chain`` undone in the words that gain by it."""
        if chain == LOST:
            return line
        undone = lambda w: next((t for c, s, t in self.word(w) if c == chain and s > 0), w)
        return " ".join(w if w.isascii() else undone(w) for w in line.split(" "))


def _tables(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    flat = np.zeros(_SLOTS + _CHARS)
    flat[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return flat[:_SLOTS], flat[_SLOTS:]


def _count(texts: DataFrame) -> pd.DataFrame:
    """The tables over all texts; at most 2**20 + 2**16 rows, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, chars = np.zeros(_SLOTS, np.int64), np.zeros(_CHARS, np.int64)
        for batch in batches:
            part: list[str] = []
            size = 0
            for t in batch.column(0).to_pylist():
                if t:
                    part.append(t)
                    size += len(t)
                    if size > 2_000_000:
                        count_chars(" " + " ".join(part) + " ", pairs, chars)
                        part, size = [], 0
            if part:
                count_chars(" " + " ".join(part) + " ", pairs, chars)
        flat = np.concatenate([pairs, chars])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.int64())], names=["slot", "n"])

    return texts.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()


def _em(chains: list, evidence: list, n: np.ndarray, n_lines: float, rounds: int = 30) -> np.ndarray:
    """Shares of the chains among the lines of a group: ``n`` lines with these chains and evidence, of ``n_lines`` in all."""
    widest = max(map(len, chains))
    c = np.zeros((len(chains), widest), int)
    like = np.zeros((len(chains), widest))
    for k, (x, s) in enumerate(zip(chains, evidence)):
        c[k, : len(x)] = x
        like[k, : len(x)] = np.exp(np.minimum(s, 60.0))
    share = np.full(LOST + 1, 0.01 / (LOST + 1))
    for _ in range(rounds):
        clean = max(1e-6, 1 - share.sum())
        p = share[c] * like
        p /= (p.sum(1) + clean)[:, None]
        new = np.bincount(c.ravel(), (p * n[:, None]).ravel(), LOST + 1)
        share = (new + 0.01) / (n_lines + 1.0)  # a weak prior keeps every chain possible
        share *= min(1.0, 0.98 / share.sum())
    return share


def find_garbled(docs: DataFrame, key: str = "doc_id", text: str | list[str] = "text", source: str = "source") -> DataFrame:
    """Every garbled line: ``key``, field_name, line_no, chain, posterior, is_restored, line, restored.

    ``text`` is one field or several; what is usual is learned for each source
    and field. Lines are parted by U+000A only and counted from 0. A null or empty
    text has no line; a null source is a source of its own; repeated rows repeat
    their lines. A line with replacement characters is found but not restored.
    ``restored`` is the line itself where nothing can be had. What reaches the
    driver is of fixed size: the character tables.
    """
    spark = docs.sparkSession
    key_type = docs.schema[key].dataType
    fields = [text] if isinstance(text, str) else list(text)
    whose = F.coalesce(F.col(source).cast("string"), F.lit(""))
    stacked = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])
    base = spread(docs.select(F.col(key).alias("key"), whose.alias("source"), F.inline(stacked)).filter(F.length("text") > 0))
    pairs, chars = _tables(_count(base.select("text")))
    first = spark.sparkContext.broadcast((pairs, chars))
    n_lines = base.groupBy("source", "field_name").agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_lines"))
    found = cut(_evidence(base, key_type, first))
    shares = _shares(found, n_lines)

    # second round: the lines found garbled, and those that are valid UTF-8 when read
    # back (hardly by chance), leave the counts of the character model
    utf8 = [c for c, steps in enumerate(CHAINS) if steps[0][0] == "utf_8"]
    garbled = _posterior(found, shares).filter((F.col("posterior") >= 0.5) | F.col("chain").isin(utf8))
    less_pairs, less_chars = _tables(_count(garbled.select("line")))
    second = spark.sparkContext.broadcast((pairs - less_pairs, chars - less_chars))
    scored = cut(_evidence(base, key_type, second))
    final = _posterior(scored, _shares(scored, n_lines)).filter("posterior >= 0.5")
    names = F.array(*[F.lit(n) for n in CHAIN_NAMES])
    out_schema = T.StructType([T.StructField("key", key_type), T.StructField("field_name", T.StringType()), T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType()), T.StructField("chain", T.IntegerType()), T.StructField("posterior", T.DoubleType()), T.StructField("restored", T.StringType())])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(CharModel(*second.value))
        for batch in batches:
            fixed = [evidence.repair(line, c) for line, c in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(6)), pa.array(fixed, pa.string())], names=out_schema.names)

    done = final.select("key", "field_name", "line_no", "line", "chain", "posterior").mapInArrow(repair, out_schema)
    restored = (F.col("chain") != LOST) & ~F.col("restored").contains("�") & (F.col("restored") != F.col("line"))
    return done.select(F.col("key").alias(key), "field_name", "line_no", names[F.col("chain")].alias("chain"), "posterior", restored.alias("is_restored"), "line", "restored")


def _evidence(base: DataFrame, key_type: T.DataType, tables) -> DataFrame:
    """key, source, field_name, line_no, line, chains, evidence of every line that has any evidence."""
    schema = T.StructType([
        T.StructField("key", key_type), T.StructField("source", T.StringType()), T.StructField("field_name", T.StringType()), T.StructField("line_no", T.IntegerType()),
        T.StructField("line", T.StringType()), T.StructField("chains", T.ArrayType(T.IntegerType())), T.StructField("evidence", T.ArrayType(T.DoubleType())),
    ])
    kinds = [pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(CharModel(*tables.value))
        for batch in batches:
            rows, out = [], []
            for i, t in enumerate(batch.column(3).to_pylist()):
                if t.isascii():
                    continue
                for no, line in enumerate(t.split("\n")):
                    if not line.isascii():
                        chains, weights = evidence.chains(line)
                        if chains:
                            rows.append(i)
                            out.append((no, line, chains, weights))
            take = pa.array(rows, pa.int64())
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(3)), *(pa.array(v, k) for v, k in zip(cols, kinds))], names=schema.names)

    return base.select("key", "source", "field_name", "text").mapInArrow(run, schema)


def _shares(found: DataFrame, n_lines: DataFrame) -> DataFrame:
    """source, field_name, shares: EM per source and field over a histogram of its lines' chains and evidence in whole units.

    The histogram is what one task gets of a source; its rows are the kinds of
    lines, counted before the shuffle, not the lines.
    """
    # the best chain's evidence up to 40, the others' as far below it as they are
    most = F.array_max("evidence")
    whole = F.transform("evidence", lambda s: F.round(F.greatest(s - most, F.lit(-40.0)) + F.least(most, F.lit(40.0))))
    hist = found.groupBy("source", "field_name", "chains", whole.alias("evidence")).agg(F.count("*").alias("n")).join(n_lines, ["source", "field_name"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shares = _em(pdf["chains"].tolist(), pdf["evidence"].tolist(), pdf["n"].to_numpy(float), float(pdf["n_lines"].iloc[0]))
        return pd.DataFrame({"source": [pdf["source"].iloc[0]], "field_name": [pdf["field_name"].iloc[0]], "shares": [shares.tolist()]})

    return hist.groupBy("source", "field_name").applyInPandas(run, "source string, field_name string, shares array<double>")


def _posterior(found: DataFrame, shares: DataFrame) -> DataFrame:
    """``found`` with the likeliest chain and the probability that the line is garbled at all."""
    j = found.join(shares, ["source", "field_name"])
    # relative to the line's most evidence, so that no difference is lost
    most = F.array_max("evidence")
    weights = F.zip_with("chains", "evidence", lambda c, s: F.struct((F.log(F.try_element_at("shares", c + 1)) + s).alias("p"), (-c).alias("minus")))
    clean = F.greatest(F.lit(1e-6), 1 - F.aggregate("shares", F.lit(0.0), lambda a, x: a + x)) * F.exp(-most)
    total = F.aggregate(F.transform("weights", lambda w: F.exp(w["p"] - most)), F.lit(0.0), lambda a, x: a + x)
    j = j.withColumn("weights", weights)
    return j.select("key", "field_name", "line_no", "line", (-F.array_max("weights")["minus"]).alias("chain"), (total / (total + clean)).alias("posterior"))
