"""Problem 6: spellings of one name linked by n-gram cosine joins and average linkage.

Names are reduced to forms (folded words in order of the alphabet, initials
apart). The vector of a form is made of character n-grams: those of the surname
(its rarest word), each together with the first letter of the given name, again
with the given name itself, and with further initials, and those of the given
name with the first letter of the surname; n-grams weigh by the root of their rarity. So "J.
Temutaza" is near "Temutaza, Jean" and, by a slip, near "Jean Temuatza", but far
from "Jean Tomas" and "Karl Temutaza". Short forms of given names come from a
table and are learned from the corpus: two given names that share far more
surnames than chance has it. Vectors with a cosine above a bound are joined by
their rarest features, and average linkage on the cosines groups them, round by
round over all groups at once.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstruct.scale import config_rows, cut, distinct_rows

#: Words that are no part of a name, and those that mark an organisation, with their short forms.
TITLES = frozenset("dr prof professor mr mrs ms sir dame phd md msc dipl ing jr sr ii iii iv".split())
PARTICLES = frozenset("von van vom zu zur de der den del della di da do dos das du des la le ten ter af av al el bin ibn y e".split())
ORG_SHORT = {"inst": "institute", "lab": "laboratory", "labs": "laboratory", "assoc": "association", "consort": "consortium", "univ": "university", "dept": "department", "soc": "society", "acad": "academy", "ctr": "center", "centre": "center", "grp": "group", "comm": "committee", "fdn": "foundation", "natl": "national", "intl": "international"}
ORG_WORDS = frozenset("institute laboratory association consortium university department society academy center group committee foundation council agency team collaboration".split())
ORG_SMALL = frozenset("the of for and on in at".split())
_ET_AL = regex.compile(r"(?i)\s*(et\.?\s*al\.?|and others|u\.?\s*a\.?)\s*")
_PARENS = regex.compile(r"\s*\([^)]*\)\s*")
_SPLIT = regex.compile(r"[\p{L}\p{M}\p{N}'’]+(?:[-‐‑][\p{L}\p{M}\p{N}'’]+)*|(?:\p{L}\.[-‐‑]?)+")
#: Least cosine of two forms that are joined, and least average cosine of merged groups.
LEAST_COSINE, LEAST_LINKAGE = 0.38, 0.42
#: Squared weights of the surname with the first letter, with the given name, with further initials; and of the given name.
BLOCKS = (0.65, 0.2, 0.05, 0.1)
#: Squared weights of an organisation's words and its acronym.
ORG_BLOCKS = (0.6, 0.4)
#: Features whose exact counts every task has: all that make up this share of all features. It bounds the list by its inverse.
LISTED = 1 << 20
#: Forms expected in a bucket from which it is met part by part, and rows compared at a time.
HOT_FORMS, BLOCK_FORMS = 1 << 14, 512
#: Learning of short forms: surnames two given names share at least, how many times more than by chance, and the logarithm of the greatest probability of chance.
LEAST_SHARED, LEAST_LIFT, MOST_CHANCE = 3, 4.0, math.log(1e-4)


@lru_cache(1 << 16)
def fold(s: str) -> str:
    """Lower case without marks; letters with a stroke as their plain letters."""
    s = unicodedata.normalize("NFKD", s).casefold()
    s = "".join(c for c in s if not unicodedata.combining(c))
    return s.translate(str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ı": "i", "æ": "ae", "œ": "oe", "’": "'", "‐": "-", "‑": "-"}))


def form(name: str) -> str:
    """The form of a name: folded full words , ``|``, initials; for an organisation ``o:``, its words, ``|``, its acronym; for an acronym ``a:`` and it; empty for no name."""
    if _ET_AL.fullmatch(name):
        return ""
    plain = _PARENS.sub(" ", name)
    words = [fold(w) for w in _SPLIT.findall(plain)]
    spelled = [ORG_SHORT.get(w, w) for w in words]
    if len(words) == 1 and regex.fullmatch(r"\p{Lu}{3,6}", plain.strip()):
        return "a:" + words[0]
    if "wg" in spelled:
        k = spelled.index("wg")
        spelled[k : k + 1] = ["working", "group"]
    if any(w in ORG_WORDS for w in spelled) and len(spelled) > 1:
        turn = spelled.index("of") if "of" in spelled else -1
        acronym = "".join(w[0] for w in spelled[turn + 1 :] + spelled[: max(turn, 0)] if w not in ORG_SMALL)
        return "o:" + " ".join(sorted(w for w in spelled if w not in ORG_SMALL and len(w) > 1)) + "|" + acronym
    full, initials = [], []
    tokens = _SPLIT.findall(plain)
    surname_first = "," in plain
    for k, t in enumerate(tokens):
        letters = regex.sub(r"[^\p{L}]", "", t)
        f = fold(t)
        if not letters or f in TITLES or (f in PARTICLES and len(letters) > 1 and len(tokens) > 1):
            continue
        base = regex.sub(r"[^\p{L}]", "", f)
        capitals = t.isupper() and len(letters) <= 3 and (k == len(tokens) - 1 or surname_first) and k > 0 and "-" not in t
        if len(letters) == 1 or capitals or all(len(p) == 1 for p in regex.split(r"[-.]+", f.strip(".")) if p):
            initials += list(base)
        else:
            full.append(f)
    if not full:
        return ""
    return " ".join(sorted(full)) + "|" + " ".join(initials)


def _grams(w: str) -> list[str]:
    p = f"^{w}$"
    return sorted({p[k : k + 3] for k in range(max(1, len(p) - 2))})


class Statistics:
    """Counts of words and n-grams over all forms, and what short forms of given names stand for."""

    def __init__(self, counts: dict[str, int], below: int, same: dict[str, str]):
        self.counts, self.below, self.same = counts, below, same
        self.n = max(1, counts.get("n:", 1))

    def of(self, kind: str, x: str) -> int:
        return self.counts.get(kind + x, self.below)

    def idf(self, kind: str, x: str) -> float:
        return math.log1p(self.n / self.of(kind, x))

    def split(self, f: str) -> tuple[str, list[str], list[str]]:
        """Surname (the word that is rarest, by itself and its n-grams), given names and initials of a person's form."""
        words, initials = f.split("|")
        given = words.split()
        surname = max(given, key=lambda w: (sum(self.idf("g:", g) for g in _grams(w)) * self.idf("w:", w), w)) if len(given) > 1 else given[0]
        given.remove(surname)
        return surname, given, initials.split()

    def full(self, given: str) -> str:
        return self.same.get(given, given)


def _org_features(f: str) -> tuple[list[str], str]:
    words, acronym = f[2:].split("|")
    kinds = "+".join(w for w in words.split() if w in ORG_WORDS)
    rest = [w for w in words.split() if w not in ORG_WORDS]
    heads = "".join(sorted(w[0] for w in rest))
    return [f"o:{g}{kinds}{heads}" for w in rest for g in _grams(w)], "a:" + acronym


def vector(f: str, st: Statistics) -> list[tuple[int, float, float]]:
    """Feature, weight, forms expected to have it; the weights have the norm 1. In the order of rarity, which is the same for all forms."""
    out: dict[str, tuple[float, float]] = {}

    def block(items: dict[str, tuple[float, float]], square: float) -> None:
        norm = math.sqrt(sum(w * w for w, _ in items.values()))
        if norm:
            out.update((k, (math.sqrt(square) * w / norm, n)) for k, (w, n) in items.items())

    if f.startswith("a:"):
        out[f] = (1.0, st.of("", f))
    elif f.startswith("o:"):
        words, acronym = _org_features(f)
        block({x: (1.0, st.of("", x)) for x in words}, ORG_BLOCKS[0])
        block({acronym: (1.0, st.of("", acronym))}, ORG_BLOCKS[1])
    else:
        surname, given, initials = st.split(f)
        # the root of rarity: the n-grams a slip makes are the rarest and must not outweigh the others
        grams = {g: (math.sqrt(st.idf("g:", g)), st.of("g:", g) / st.n) for g in _grams(surname)}
        crossed = lambda kind, xs: {f"{kind}{g} {x}": (w, share * n) for x, n in xs.items() for g, (w, share) in grams.items()}
        full = {st.full(x) for x in given}
        letters = {x[0] for x in [*given, *full]} if given else set(initials[:1]) or {""}
        more = [*(initials if given else initials[1:]), *(p[0] for x in given for p in x.split("-")[1:] if p)]
        block(crossed("f", {x: st.of("l:", x) for x in letters}), BLOCKS[0])
        block(crossed("n", {x: st.of("w:", x) for x in full}), BLOCKS[1])
        block(crossed("m", {x: st.of("l:", x) for x in set(more)}), BLOCKS[2])
        here = st.of("l:", surname[0]) / st.n
        block({f"g{g} {surname[0]}": (1.0, st.of("g:", g) * here) for x in given for g in _grams(x)}, BLOCKS[3])
    norm = math.sqrt(sum(w * w for w, _ in out.values())) or 1.0
    rows = [(xxhash.xxh3_64_intdigest(k) >> 1, w / norm, n) for k, (w, n) in out.items()]
    return sorted(rows, key=lambda x: (x[2], x[0]))


def cosine(a: dict[int, float], b: dict[int, float]) -> float:
    return sum(a[h] * b[h] for h in a.keys() & b.keys())


def name_groups(records: DataFrame, names: str, given_forms: DataFrame) -> DataFrame:
    """Every distinct string among the elements of ``names`` that is a name: name, form, group_id.

    Null and empty arrays and null, blank or ``et al.`` elements give no row.
    Strings are told apart by case and blanks. A string without a partner is a
    group of its own.
    """
    spark = records.sparkSession
    strings = records.select(F.explode(names).alias("name")).filter(F.length(F.trim("name")) > 0).distinct()

    def to_form(batch):
        ns = batch.column(0).to_pylist()
        fs = [form(n) for n in ns]
        yield pa.RecordBatch.from_arrays([pa.array(ns, pa.string()), pa.array(fs, pa.string())], names=["name", "form"])

    named = cut(_map(strings, to_form, "name string, form string").filter("form <> ''"))
    forms = distinct_rows(named.select("form"), "form")  # the steps on forms are long per row
    shared = spark.sparkContext.broadcast(_statistics(forms, given_forms))
    edges = cut(_joined(forms, shared))
    groups = linked_groups(edges)
    return named.join(groups.withColumnRenamed("node", "form"), "form", "left").select("name", "form", F.coalesce("group_id", "form").alias("group_id"))


def _statistics(forms: DataFrame, given_forms: DataFrame) -> Statistics:
    """Counts over all forms, of what is frequent, and short forms from the table and from the corpus: one entry for each given name that has any."""
    spark = forms.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for f in batch.column(0).to_pylist():
                if f.startswith("a:"):
                    found[f] += 1
                elif f.startswith("o:"):
                    words, acronym = _org_features(f)
                    found.update({*words, acronym})
                else:
                    words, initials = (x.split() for x in f.split("|"))
                    found["n:"] += 1
                    found.update({*("w:" + w for w in words), *("g:" + g for w in words for g in _grams(w)), *("l:" + w[0] for w in words), *("l:" + i for i in initials)})
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["feature", "n"])

    counts = cut(forms.mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")))
    least = max(2, -(-(counts.agg(F.sum("n")).first()[0] or 0) // LISTED))
    listed = {r["feature"]: r["n"] for r in counts.filter(F.col("n") >= least).toLocalIterator()}  # LISTED rows at most
    st, same = Statistics(listed, least - 1, {}), {}

    def stands_for(x: str, y: str) -> None:
        # a short form stands for the most frequent name it goes with, or is that name itself
        same[x] = max(same.get(x, x), y, key=lambda w: (st.of("w:", w), w))

    for r in config_rows(given_forms.select("given_name", "short_form")):
        if r[0] and r[1]:
            stands_for(fold(r[1]), fold(r[0]))
    for a, b in _short_forms(forms, spark.sparkContext.broadcast(st)):
        stands_for(a, b)
        stands_for(b, a)
    st.same = same
    return st


def _short_forms(forms: DataFrame, shared) -> Iterator[tuple[str, str]]:
    """Pairs of given names that share more surnames than chance has it; every surname counts."""

    def split(batch):
        rows = [(x[0], x[1][0]) for f in batch.column(0).to_pylist() if f[1:2] != ":" and len((x := shared.value.split(f))[1]) == 1]
        yield _two(rows)

    rows = cut(_map(forms, split, "a string, b string").select(F.col("a").alias("surname"), F.col("b").alias("given")).distinct())
    sizes = rows.groupBy("surname").agg(F.count("*").alias("n"))
    n_all, total = sizes.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
    per = cut(rows.groupBy("given").agg(F.count("*").alias("n")))
    # a given name with fewer surnames can't share that many; nearly all slips are among them
    kept = rows.join(per.filter(F.col("n") >= LEAST_SHARED).select("given"), "given")
    both = kept.withColumnRenamed("given", "a").join(kept.withColumnRenamed("given", "b"), "surname").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("c")).filter(F.col("c") >= LEAST_SHARED)
    j = both.join(per.select(F.col("given").alias("a"), F.col("n").alias("na")), "a").join(per.select(F.col("given").alias("b"), F.col("n").alias("nb")), "b")
    chance = F.lit(2.0 * (total or 0) / (n_all or 1) ** 2) * F.col("na") * F.col("nb")
    # Chernoff's bound of a Poisson tail
    unlikely = F.col("c") - chance + F.col("c") * F.log(chance / F.col("c")) < MOST_CHANCE
    return ((r["a"], r["b"]) for r in j.filter((F.col("c") >= LEAST_LIFT * chance) & unlikely).select("a", "b").toLocalIterator())


_PAIR = np.dtype([("h", "<u4"), ("w", "<f2")])


def _bucket_rows(f: str, st: Statistics, least: float, hot: float) -> Iterator[tuple[int, bytes]]:
    """The buckets of a form, and for each its features from that of the bucket on, packed.

    Two forms as near as ``least`` share the first of their common features in
    the part of both vectors before what is left falls below ``least``, and
    nothing before it adds to their cosine. The forms of a hot feature are parted
    by their hash, and every two parts meet in a bucket of their own.
    """
    v = vector(f, st)
    packed = np.array([(h & 0xFFFFFFFF, w) for h, w, _ in v], _PAIR).tobytes()
    left = 1.0
    for k, (h, w, n) in enumerate(v):
        if left < least * least - 1e-9:
            return
        left -= w * w
        rest = packed[k * _PAIR.itemsize :]
        parts = math.ceil(n / max(hot, 1))
        if parts < 2:
            yield h, rest
            continue
        mine = xxhash.xxh3_64_intdigest(f) % parts
        for other in range(parts):
            cell = min(mine, other) * parts + max(mine, other)
            yield (h * 0x9E3779B97F4A7C15 + (cell + 1) * 0xBF58476D1CE4E5B9) >> 1 & 0x7FFFFFFFFFFFFFFF, rest


def _near_in_buckets(buckets: np.ndarray, packed: list[bytes], bound: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs p < q of rows of one bucket (equal ones adjacent) whose packed features have a product of ``bound`` or more.

    Rows that share a feature are paired feature by feature and the products
    summed, for many small buckets or two blocks of a large one at a time.
    """
    sizes = np.fromiter((len(x) // _PAIR.itemsize for x in packed), np.int64, len(packed))
    flat = np.frombuffer(b"".join(packed), _PAIR)
    weights = flat["w"].astype(np.float32)
    # what has no partner in its bucket even if all that is left of both agrees is left out
    norm = np.sqrt(np.bincount(np.repeat(np.arange(len(packed)), sizes), weights * weights, len(packed)))
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    most = np.repeat(np.maximum.reduceat(norm, starts), np.diff(np.r_[starts, len(packed)]))
    alive = norm * most >= bound
    rows = np.flatnonzero(alive)
    if not len(rows):
        return
    of_bucket = buckets[rows]
    starts = np.flatnonzero(np.r_[True, of_bucket[1:] != of_bucket[:-1]])
    counts = np.diff(np.r_[starts, len(rows)])
    ordinal = np.repeat(np.arange(len(starts)), counts)
    owner = np.repeat(np.cumsum(alive) - 1, sizes)  # of rows that are alive
    keep = np.repeat(alive, sizes)
    owner, weights, feature = owner[keep], weights[keep], flat["h"][keep]
    key = ordinal[owner].astype(np.uint64) << np.uint64(32) | feature
    order = np.argsort(key, kind="stable")  # by bucket, feature and row
    key, owner, weights = key[order], owner[order], weights[order]
    group = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.r_[group, len(key)])
    end = np.repeat(group + length, length)
    ends = np.searchsorted(key, np.arange(1, len(starts) + 1).astype(np.uint64) << np.uint64(32))  # entries of each bucket

    def summed(at: np.ndarray, low: np.ndarray, high: np.ndarray, slot, n: int) -> np.ndarray:
        """Slots whose products of entries ``at`` with those from ``low`` to ``high`` come up to the bound."""
        times = high - low
        i = np.repeat(at, times)
        j = np.arange(len(i)) + np.repeat(low - (np.cumsum(times) - times), times)
        return np.flatnonzero(np.bincount(slot(owner[i], owner[j]), weights[i] * weights[j], n) >= bound)

    b = 0
    while b < len(starts):
        c, slots = b + 1, counts[b] ** 2
        while c < len(starts) and slots + counts[c] ** 2 <= BLOCK_FORMS**2:
            slots += counts[c] ** 2
            c += 1
        first = ends[b - 1] if b else 0
        if counts[b] <= BLOCK_FORMS:
            before = np.cumsum(counts[b:c] ** 2) - counts[b:c] ** 2
            at = np.arange(first, ends[c - 1])

            def slot(x, y):
                o = ordinal[x]
                return before[o - b] + (x - starts[o]) * counts[o] + y - starts[o]

            found = summed(at, at + 1, end[at], slot, int(slots))
            o = np.searchsorted(before, found, side="right") - 1
            x, y = np.divmod(found - before[o], counts[b + o])
            yield rows[starts[b + o] + x], rows[starts[b + o] + y]
        else:
            mine = np.arange(first, ends[b])
            block = (owner[mine] - starts[b]) // BLOCK_FORMS
            code = (group_of := np.repeat(np.arange(len(group)), length)[mine]) * (block.max() + 1) + block  # rising, as rows are in order
            for i in range(block.max() + 1):
                at, of_group = mine[block == i], group_of[block == i]
                for j in range(i, block.max() + 1):
                    low, high = (first + np.searchsorted(code, of_group * (block.max() + 1) + j, side=side) for side in ("left", "right"))
                    x0, y0 = starts[b] + i * BLOCK_FORMS, starts[b] + j * BLOCK_FORMS
                    found = summed(at, at + 1 if i == j else low, high, lambda x, y: (x - x0) * BLOCK_FORMS + y - y0, BLOCK_FORMS**2)  # noqa: B023
                    x, y = np.divmod(found, BLOCK_FORMS)
                    yield rows[x0 + x], rows[y0 + y]
        b = c


def _near_in_bucket(packed: list[bytes], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one bucket whose packed features alone have nearly half of ``least``."""
    return _near_in_buckets(np.zeros(len(packed), np.int64), packed, least / 2 - 0.02)


def _joined(forms: DataFrame, shared, least: float = LEAST_COSINE, hot: float = HOT_FORMS) -> DataFrame:
    """a, b, s: the pairs of forms whose cosine is at least ``least``, each once, a < b."""

    def spell(batch):
        keys, ids, feats = [], [], []
        for f in batch.column(0).to_pylist():
            for key, rest in _bucket_rows(f, shared.value, least, hot):
                keys.append(key)
                ids.append(f)
                feats.append(rest)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.string()), pa.array(feats, pa.binary())], names=["bucket", "form", "features"])

    rows = _map(forms, spell, "bucket long, form string, features binary").repartition("bucket").sortWithinPartitions("bucket", "form")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()  # most pairs meet in many buckets; the rest is left to distinct()

        def pairs(keys: np.ndarray, ids: list[str], feats: list[bytes]) -> Iterator[pa.RecordBatch]:
            if len(seen) > 1_000_000:
                seen.clear()
            if not len(keys):
                return
            for p, q in _near_in_buckets(keys, feats, least - 0.002):  # weights are rounded
                new = {(ids[x], ids[y]) for x, y in zip(p.tolist(), q.tolist()) if ids[x] != ids[y]} - seen
                seen.update(new)
                yield _two(list(new))

        held: list | None = None
        for batch in batches:
            cols = [batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()]
            if held is not None:
                cols = [np.r_[held[0], cols[0]], held[1] + cols[1], held[2] + cols[2]]
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last bucket may go on in the next batch
            yield from pairs(*(c[:last] for c in cols))
            held = [c[last:] for c in cols]
        if held is not None:
            yield from pairs(*held)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors: dict[str, dict[int, float]] = {}

        def of(f: str) -> dict[int, float]:
            if f not in vectors:
                if len(vectors) > 50_000:
                    vectors.clear()
                vectors[f] = {h: w for h, w, _ in vector(f, shared.value)}
            return vectors[f]

        for batch in batches:
            near = [(a, b, cosine(of(a), of(b))) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield _edges([x for x in near if x[2] >= least])

    return rows.mapInArrow(meet, "a string, b string").distinct().mapInArrow(compare, "a string, b string, s double")


def linked_groups(edges: DataFrame, least: float = LEAST_LINKAGE) -> DataFrame:
    """node, group_id by average linkage over all edges at once: a, b (a < b), s; pairs without an edge count 0.

    In each round every two groups that are each other's nearest merge, which
    gives the groups that merging one pair at a time would; a group is named by
    its least node. No component is held by one task, and a round is a few
    aggregations of what is left of the edges. Of equally near ones the lesser
    names come first.
    """
    e = edges.select("a", "b", "s", F.lit(1).alias("na"), F.lit(1).alias("nb"))
    labels = None
    while True:
        e = cut(e.filter(F.col("s") > 0))
        mean = F.col("s") / (F.col("na") * F.col("nb"))
        pair = e.withColumn("mean", mean).filter(F.col("mean") >= least)
        # of equal means the pair whose names come first, the same for both its groups
        rank = F.struct(-F.round("mean", 9), "a", "b")
        sides = pair.select(F.explode(F.array("a", "b")).alias("node"), rank.alias("rank"), (F.col("na") + F.col("nb")).alias("n"))
        best = sides.groupBy("node").agg(F.min(F.struct("rank", "n")).alias("best"))
        mutual = best.groupBy("best").agg(F.count("*").alias("k")).filter("k = 2")
        moved = cut(mutual.select(F.explode(F.array("best.rank.a", "best.rank.b")).alias("old"), F.col("best.rank.a").alias("new"), F.col("best.n").alias("n")))
        if not moved.limit(1).count():
            return labels if labels is not None else e.select(F.col("a").alias("node"), F.col("a").alias("group_id")).limit(0)
        if labels is None:
            labels = moved.select(F.col("old").alias("node"), F.col("new").alias("group_id"))
        else:
            later = moved.select(F.col("old").alias("group_id"), F.col("new").alias("next"))
            known = labels.join(later, "group_id", "left").select("node", F.coalesce("next", "group_id").alias("group_id"))
            first = moved.join(labels.select(F.col("node").alias("old")), "old", "left_anti").select(F.col("old").alias("node"), F.col("new").alias("group_id"))
            labels = known.unionByName(first)
        labels = cut(labels)
        for x in "ab":
            m = moved.select(F.col("old").alias(x), F.col("new").alias("to"), F.col("n").alias("size"))
            e = e.join(m, x, "left").withColumns({f"n{x}": F.coalesce("size", f"n{x}"), x: F.coalesce("to", x)}).drop("to", "size")
        turned = e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s", F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"))
        e = turned.groupBy("a", "b", "na", "nb").agg(F.sum("s").alias("s")).select("a", "b", "s", "na", "nb")


def _map(df: DataFrame, fn, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def _two(out: list[tuple[str, str]]) -> pa.RecordBatch:
    a, b = zip(*out) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])


def _edges(out: list) -> pa.RecordBatch:
    a, b, s = zip(*out) if out else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(s, pa.float64())], names=["a", "b", "s"])


def linked_names(records: DataFrame, names: str, given_forms: DataFrame) -> DataFrame:
    """Pairs of different strings that name the same: name_a < name_b by code point, each once."""
    g = name_groups(records, names, given_forms).select("group_id", "name")
    a, b = g.withColumnRenamed("name", "name_a"), g.withColumnRenamed("name", "name_b")
    return a.join(b, "group_id").filter("name_a < name_b").select("name_a", "name_b")
