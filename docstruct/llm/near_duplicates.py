"""Problem 3: near-duplicate texts by multiple-global-order prefix filtering.

Texts are sets of words; two are alike if the words in both are at least a
given share of the words in either. Under any order of all words, two alike
sets share a word among the first few of each (their prefixes). Three orders
are used here, the rarest words first in each, but with the words dealt to two
halves: by rarity alone, with the one half in front, with the other half in
front. Sets that share a prefix word under the first order meet in a bucket;
of the pairs there only those that can also share prefix words under the two
other orders, and whose signatures differ in few enough bits, are verified on
the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstruct.scale import cut, spread

_WORD = regex.compile(r"[\p{L}\p{N}]+")
#: Words whose exact counts every task has: all that make up this share of all words. It bounds the list by its inverse.
LISTED = 1 << 22
#: Rows two of which may be compared in one bucket; larger buckets are parted by a second order, then split into blocks.
BUCKET_ROWS, BLOCK_ROWS = 8_000, 16_000
#: Copies of one text that are written out together; more are parted.
CHUNK_ROWS = 1_000
#: Fixed values of the signature filters: how many bits each has.
_SIGN_BITS, _ORDER_BITS = 63, 31


def words_of(text: str) -> set[str]:
    """The distinct words of a text: longest runs of letters and numbers in the lower-cased text."""
    return set(_WORD.findall(text.lower()))


def least_common(sizes, num: int, den: int):
    """Words two sets of together ``sizes`` words must share to be alike by num/den: ceil(num*sizes/(num+den))."""
    return (num * sizes + num + den - 1) // (num + den)


class _Hashes(dict):
    """Word -> 63-bit hash; dropped when it grows beyond a bound."""

    def __missing__(self, w: str):
        if len(self) > 500_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(w) >> 1
        self[w] = h
        return h


_hashes = _Hashes()


class Sets:
    """The word sets of a batch of texts, as flat arrays of word hashes."""

    def __init__(self, kinds: list[int], texts: list[str]):
        get, flat, sizes = _hashes.__getitem__, [], []
        for t in texts:
            before = len(flat)
            flat.extend(map(get, set(_WORD.findall(t.lower()))))
            sizes.append(len(flat) - before)
        self.n = np.array(sizes, np.int64)
        self.rows = np.flatnonzero(self.n)  # texts without a word are left out
        self.n = self.n[self.rows]
        self.kind = np.array(kinds, np.uint64)[self.rows]
        # words of different kinds of text are different words
        self.h = np.array(flat, np.uint64) ^ np.repeat(self.kind * np.uint64(0x51ED2701), self.n)
        self.start = np.r_[0, np.cumsum(self.n)[:-1]].astype(np.int64) if len(self.n) else np.zeros(0, np.int64)
        one = np.uint64(1)
        if len(self.n):
            # the last byte of a set's identity is its kind
            self.sid = (np.add.reduceat(self.h * (self.h | one), self.start) >> np.uint64(9)) << np.uint64(8) | self.kind
            self.sign = np.bitwise_xor.reduceat(one << (self.h % np.uint64(_SIGN_BITS)), self.start)
        else:
            self.sid = self.sign = np.zeros(0, np.uint64)

    def fresh(self, done: set[int]) -> np.ndarray:
        """Which sets come for the first time, as far as ``done`` remembers."""
        if len(done) > 1_000_000:
            done.clear()
        out = np.zeros(len(self.n), bool)
        for k, s in enumerate(self.sid.tolist()):
            if s not in done:
                done.add(s)
                out[k] = True
        return out

    def prefixes(self, counts: "WordCounts", num: int, den: int):
        """Words in the order of their rarity, set by set: set index, hash, count, rank; the prefix length of each set; the order filters."""
        owner = np.repeat(np.arange(len(self.n)), self.n)
        count = counts.of(self.h)
        order = np.argsort(np.minimum(count, (1 << 20) - 1).astype(np.uint64) << np.uint64(44) | self.h >> np.uint64(19), kind="stable")
        order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
        h, count = self.h[order], count[order]
        p = self.n - (num * self.n + den - 1) // den + 1  # the longest prefix a partner of any size can ask for
        rank = np.arange(len(h)) - self.start[owner]
        filters = np.zeros(len(self.n), np.uint64)
        fronts = []
        bit = np.uint64(1) << ((h >> np.uint64(20)) % np.uint64(_ORDER_BITS))
        for half in (0, 1):
            mine = (h >> np.uint64(40) & np.uint64(1)) == half
            seen = np.cumsum(mine)
            among = seen - 1 - (seen - mine)[self.start][owner]  # rank within the half in front
            front = np.where(mine, among, 0)
            total = np.add.reduceat(mine.astype(np.int64), self.start)
            front = np.where(mine, among, total[owner] + rank - among - 1)  # then the other half
            take = front < p[owner]
            filters |= np.bitwise_or.reduceat(np.where(take, bit, np.uint64(0)), self.start) << np.uint64(_ORDER_BITS * half)
            fronts.append(front)
        return owner, h, count, rank, p, filters, fronts[0]


class WordCounts:
    """The exact counts of the more frequent words; any other word is in at most ``below`` texts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, below: int):
        order = np.argsort(words)
        self.words, self.counts, self.below = words[order], counts[order], below

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(h), self.below, np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.counts[at], self.below).astype(np.int64)


#: A size from which a row does not tell its set's size; such rows pass the filters of size.
_LARGE = 0xFFFF


def _pairs_in_buckets(place, sid, sign, order, num: int, den: int):
    """Pairs (indexes) of rows of one bucket that pass all filters; rows are sorted by bucket."""
    key = place >> 32
    n = (place >> 16 & 0xFFFF).astype(np.int64)
    pos = (place & 0xFFFF).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])

    sign = sign.view(np.uint64)
    short = n.astype(np.int32)

    def keep(i, j):
        # the signatures first: they tell most pairs apart at the least cost
        long = (short[i] == _LARGE) | (short[j] == _LARGE)
        ok = long | (np.bitwise_count(sign[i] ^ sign[j]) * np.int32(num + den) <= (short[i] + short[j]) * np.int32(den - num))
        i, j, long = i[ok], j[ok], long[ok]
        need = least_common(n[i] + n[j], num, den)
        both = order[i] & order[j]
        ok = (sid[i] != sid[j]) & (long | (pos[i] <= n[i] - need) & (pos[j] <= n[j] - need))
        ok &= ((both & 0x7FFFFFFF) != 0) & ((both >> _ORDER_BITS) != 0)
        return i[ok], j[ok]

    out_i, out_j = [], []
    small = np.repeat(sizes <= 64, sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(key)) - 1  # rows of the bucket after this one
    at = np.flatnonzero(small & (left > 0))
    k = 1
    while len(at):
        at = at[num * n[at + k] <= den * n[at]]  # a bucket is in the order of size: no later row is nearer
        i, j = keep(at, at + k)
        out_i.append(i)
        out_j.append(j)
        k += 1
        at = at[left[at] >= k]
    for s, m in zip(starts[sizes > 64], sizes[sizes > 64]):
        rows = np.arange(s, s + m)
        step = max(1, 2_000_000 // int(m))
        for a in range(0, int(m), step):
            i = rows[a : a + step]
            ii, jj = np.repeat(i, m), np.tile(rows, len(i))
            later = jj > ii
            i, j = keep(ii[later], jj[later])
            out_i.append(i)
            out_j.append(j)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


def alike_sets(
    records: DataFrame, key: str, fields: list[str], num: int = 7, den: int = 10, bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS, listed: int = LISTED
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of alike texts as pairs of representatives, and who has these texts.

    Three frames: links (sid_a, sign_a, rep_a, n_a and the same of b), sets (sid,
    sign, rep, n) and members (sid, sign, key). A set is the words of one or more
    equal texts of one field, ``rep`` the least key that has it, ``n`` how many have.
    """
    if len(fields) > 256:
        raise ValueError("at most 256 fields")
    spark = records.sparkSession
    key_type = records.schema[key].dataType
    fields_array = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f).alias("text")) for k, f in enumerate(fields)])
    plain = records.select(F.col(key).alias("key"), F.inline(fields_array)).filter(F.length("text") > 0)
    texts = spread(plain)

    # one reading gives every text as a member of its set, and in how many sets (copies apart, as far as a task remembers) each word is
    fields_read = [T.StructField("key", key_type), T.StructField("sid", T.LongType()), T.StructField("sign", T.LongType()), T.StructField("is_count", T.BooleanType())]
    names = [f.name for f in fields_read]

    def counted(held: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.nulls(len(words), kind), pa.array(words.view(np.int64)), pa.array(n), pa.array(np.ones(len(words), bool))], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        held: list[np.ndarray] = []
        kind = None
        for batch in batches:
            sets = Sets(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            kind = batch.column(0).type
            held.append(sets.h[np.repeat(sets.fresh(done), sets.n)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(sets.rows)), pa.array(sets.sid.view(np.int64)), pa.array(sets.sign.view(np.int64)), pa.array(np.zeros(len(sets.n), bool))], names=names)
            if sum(map(len, held)) > 8_000_000:
                yield counted(held, kind)
                held = []
        if held:
            yield counted(held, kind)

    first = cut(texts.mapInArrow(read, T.StructType(fields_read)))
    counts = first.filter("is_count").groupBy("sid").agg(F.sum("sign").alias("n"))
    total = first.filter("is_count").agg(F.sum("sign")).first()[0] or 0
    least = max(2, -(-total // listed))  # at most ``listed`` words are in so many sets
    frequent = counts.filter(F.col("n") >= least).toPandas()
    shared = spark.sparkContext.broadcast(WordCounts(frequent["sid"].to_numpy(np.int64).view(np.uint64), frequent["n"].to_numpy(np.int64), least - 1))
    members = first.filter("not is_count").select("key", "sid", "sign")

    # the prefix rows of every set: bucket and place in it, identity, signature, order filters
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # copies are dropped before the shuffle, as far as the task remembers
        for batch in batches:
            kinds, all_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(kinds), 8_000):
                sets = Sets(kinds[at : at + 8_000], all_texts[at : at + 8_000])
                yield _prefix_rows(sets, sets.fresh(done), shared.value, num, den, bucket_rows, block_rows)

    rows = texts.select("kind", "text").mapInArrow(prefixes, "place long, sid long, sign long, filters long")
    rows = rows.repartition(F.shiftright("place", 32)).sortWithinPartitions("place", "sid")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = [batch.column(k).to_numpy() for k in range(4)]
            if held is not None:
                part = [np.concatenate(x) for x in zip(held, part)]
            last = np.searchsorted(part[0], part[0][-1] >> 32 << 32)  # the last bucket may go on in the next batch
            held = [x[last:] for x in part]
            yield emit([x[:last] for x in part])
        if held is not None:
            yield emit(held)

    def emit(cols: list[np.ndarray]) -> pa.RecordBatch:
        once = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])] if len(cols[0]) else np.zeros(0, bool)
        cols = [c[once] for c in cols]
        i, j = _pairs_in_buckets(*cols, num, den) if len(cols[0]) > 1 else (np.zeros(0, int), np.zeros(0, int))
        a, b = np.minimum(cols[1][i], cols[1][j]), np.maximum(cols[1][i], cols[1][j])
        sa, sb = np.where(cols[1][i] == a, cols[2][i], cols[2][j]), np.where(cols[1][i] == a, cols[2][j], cols[2][i])
        at = np.unique(np.stack([a, b]), axis=1, return_index=True)[1] if len(a) else np.zeros(0, int)
        return pa.RecordBatch.from_arrays([pa.array(x[at], pa.int64()) for x in (a, sa, b, sb)], names=["sid_a", "sign_a", "sid_b", "sign_b"])

    pairs = cut(rows.mapInArrow(join, "sid_a long, sign_a long, sid_b long, sign_b long").distinct())

    # verification on the words themselves, one text for each set
    sets = members.groupBy("sid", "sign").agg(F.min("key").alias("rep"), F.count("*").alias("n"))
    both = cut(pairs.join(_of(sets, "a"), ["sid_a", "sign_a"]).join(_of(sets, "b"), ["sid_b", "sign_b"]))
    kind = F.col("sid_a").bitwiseAND(F.lit(255)).cast("int")
    asked = both.withColumn("kind", kind)
    for x in "ab":
        asked = asked.join(plain.select(F.col("key").alias(f"rep_{x}"), "kind", F.col("text").alias(f"text_{x}")), [f"rep_{x}", "kind"])
    columns = both.columns

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, str], tuple[int, int, set[str]]] = {}  # texts come in many pairs
        for batch in batches:
            get = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            if len(known) > 50_000:
                known.clear()
            kinds = get["kind"].to_pylist()
            sides = [list(zip(kinds, get[f"text_{x}"].to_pylist())) for x in "ab"]
            new = list({t for side in sides for t in side if t not in known})
            found = Sets([k for k, _ in new], [t for _, t in new])
            known.update((new[r], (sid, sign, words_of(new[r][1]))) for r, sid, sign in zip(found.rows.tolist(), found.sid.view(np.int64).tolist(), found.sign.view(np.int64).tolist()))
            none = (0, 0, set())
            good = []
            for a, b, *own in zip(*sides, *(get[f"{c}_{x}"].to_pylist() for x in "ab" for c in ("sid", "sign"))):
                u, v = known.get(a, none), known.get(b, none)
                # of a key that has several texts only the one that is the set counts
                good.append(own == [*u[:2], *v[:2]] and den * len(u[2] & v[2]) >= num * len(u[2] | v[2]))
            m = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([get[c].filter(m) for c in columns], names=columns)

    links = asked.select(*columns, "kind", "text_a", "text_b").mapInArrow(verify, both.schema).distinct()
    return links, sets, members


def _of(sets: DataFrame, x: str) -> DataFrame:
    return sets.select(*[F.col(c).alias(f"{c}_{x}") for c in ("sid", "sign", "rep", "n")])


def similar_pairs(
    records: DataFrame, key: str, fields: list[str], num: int = 7, den: int = 10, bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS, listed: int = LISTED, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Pairs of different keys one of whose ``fields`` is alike by at least num/den: key_a < key_b, each once.

    Null texts and texts without a word are like nothing. Rows that repeat a key
    add nothing, unless their texts differ; then each text counts. Exact copies
    (equal word sets) are one member of the buckets, however many there are, and
    are only multiplied in the result, chunk by chunk. No pair is lost: no bucket
    is capped, one with more than ``bucket_rows`` rows is parted by the prefixes
    of a second order, and beyond ``block_rows`` into blocks that meet block by
    block.
    """
    links, sets, members = alike_sets(records, key, fields, num, den, bucket_rows, block_rows, listed)
    # the keys of a text with copies, in chunks of bounded length
    parts = lambda n: F.ceil(F.col(n) / F.lit(chunk_rows)).cast("int")
    copied = sets.filter("n > 1")
    chunk = F.pmod(F.xxhash64("key"), parts("n")).cast("int").alias("chunk")
    chunks = cut(members.join(copied, ["sid", "sign"]).select("sid", "sign", "key", chunk).groupBy("sid", "sign", "chunk").agg(F.collect_set("key").alias("keys")))

    def side(pairs: DataFrame, x: str) -> DataFrame:
        """``pairs`` with the keys of one side: the representative alone, or each chunk of the copies."""
        rest = [c for c in pairs.columns if c not in (f"sid_{x}", f"sign_{x}", f"rep_{x}", f"n_{x}")]
        alone = pairs.filter(f"n_{x} = 1").select(*rest, F.array(f"rep_{x}").alias(f"keys_{x}"))
        many = pairs.filter(f"n_{x} > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0), parts(f"n_{x}") - 1)))
        met = many.join(chunks.select(F.col("sid").alias(f"sid_{x}"), F.col("sign").alias(f"sign_{x}"), "chunk", F.col("keys").alias(f"keys_{x}")), [f"sid_{x}", f"sign_{x}", "chunk"])
        return alone.unionByName(met.select(*rest, f"keys_{x}"))

    across = side(side(cut(links), "a"), "b").select("keys_a", "keys_b")
    # copies of one text: every two chunks of it
    c = chunks.select("sid", "sign", F.col("chunk").alias("chunk_a"), F.col("keys").alias("keys_a"))
    same = c.join(chunks.select("sid", "sign", F.col("chunk").alias("chunk_b"), F.col("keys").alias("keys_b")), ["sid", "sign"]).filter("chunk_a <= chunk_b").select("keys_a", "keys_b")
    every = across.unionByName(same).withColumn("key_a", F.explode("keys_a")).select("key_a", F.explode("keys_b").alias("key_b"))
    every = every.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).filter("key_a < key_b")
    return every.distinct().select(F.col("key_a").alias(f"{key}_a"), F.col("key_b").alias(f"{key}_b"))


def _mix(*parts: int) -> int:
    x = 0x9E3779B97F4A7C15
    for p in parts:
        x = ((x ^ p) * 0xBF58476D1CE4E5B9 + (x >> 29)) & 0xFFFFFFFFFFFFFFFF
    return (x ^ x >> 31) & 0x7FFFFFFFFFFFFFFF


def _prefix_rows(sets: Sets, fresh: np.ndarray, counts: WordCounts, num: int, den: int, bucket_rows: int, block_rows: int) -> pa.RecordBatch:
    """A row for each bucket of each fresh set.

    The bucket of a prefix word is its own, or, if many texts have the word, one
    with each prefix word of a second order: a pair alike shares a prefix word
    there too, so it meets in one of them. If even that word is in too many texts
    the bucket is split into blocks; every pair of blocks meets. A row's place is
    its bucket (31 bits; two words in one bucket only cost comparisons), the
    size of its set and the word's rank in it.
    """
    names = ["place", "sid", "sign", "filters"]
    if not len(sets.n):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names=names)
    owner, h, count, rank, p, filters, front = sets.prefixes(counts, num, den)
    # a word of one text only brings it nowhere
    prefix = (rank < p[owner]) & fresh[owner] & (count > 1)
    one = np.flatnonzero(prefix & (count <= bucket_rows))
    bucket = h[one]
    who, place = owner[one], rank[one]
    many = np.flatnonzero(prefix & (count > bucket_rows))
    if len(many):
        keys, whos, places = [], [], []
        ends = np.r_[sets.start[1:], len(h)]
        for r in many.tolist():
            k = int(owner[r])
            second = np.arange(sets.start[k], ends[k])[front[sets.start[k] : ends[k]] < p[k]]
            for g in second.tolist():
                blocks = -(-int(min(count[r], count[g])) // block_rows)
                own = (int(sets.sid[k]) >> 8) % blocks if blocks else 0
                for other in range(max(1, blocks)):
                    keys.append(_mix(int(h[r]), int(h[g]), *((min(own, other), max(own, other)) if blocks > 1 else ())))
                    whos.append(k)
                    places.append(int(rank[r]))
        bucket = np.concatenate([bucket, np.array(keys, np.uint64)])
        who, place = np.concatenate([who, np.array(whos, np.int64)]), np.concatenate([place, np.array(places, np.int64)])
    b31 = (bucket ^ bucket >> np.uint64(31)) & np.uint64(0x7FFFFFFF)
    at = b31.view(np.int64) << 32 | np.minimum(sets.n[who], _LARGE) << 16 | np.minimum(place, _LARGE)
    cols = [at, sets.sid[who].view(np.int64), sets.sign[who].view(np.int64), filters[who].view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)
