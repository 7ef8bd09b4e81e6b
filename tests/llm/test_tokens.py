import random

import pytest
from pyspark.sql import functions as F

from docstruct.llm import packing
from docstruct.llm.bpe import TextEncoder, encode_sorted, load_model
from docstruct.llm.tokenize import encode_texts

PIECES = ["a", "b", "e", "t", " ", " ", "\n", "\t", "  ", "1", "é", "中", "ж", "'s", "'", ".", "!!", " ", "　", "\x1c", "the", "<|endoftext|>", "aaaa", "​", "XXXX"]


@pytest.fixture(scope="module")
def both(vocab_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab_path)
    t.encode_special_tokens = True
    return load_model(open(vocab_path, "rb").read()), t


def test_equals_the_public_tokenizer(both):
    model, ref = both
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(5_000)] + ["a" * 3000, "ab" * 2000, " " * 500, "x" + " " * 300 + "y", "", None, "a ", " a", "\n \n b"]
    ends, ids = TextEncoder(model, keep=2_000).encode(texts)
    want = ref.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for k in range(len(texts)):
        assert ids[ends[k] : ends[k + 1]].tolist() == want[k].ids, texts[k]


def test_trie_shares_prefixes(both):
    model, ref = both
    words = sorted({b"in", b"inter", b"internal", b"internally", b"x", "größe".encode()})
    for w, ids in zip(words, encode_sorted(model, words)):
        assert ids == ref.encode(w.decode(), add_special_tokens=False).ids


def test_query_form(spark, vocab_path):
    d = spark.createDataFrame([(1, "the cat"), (2, ""), (3, None), (None, "the cat"), (1, "the cat")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    rows = encode_texts(d, "doc_id", "text", vocab_path)
    assert rows.columns == ["doc_id", "ids"]
    got = sorted((r.doc_id or 0, r.ids) for r in rows.collect())
    assert [len(i) for _, i in got] == [2, 2, 2, 0, 0]
    assert encode_texts(d.limit(0), "doc_id", "text", vocab_path).count() == 0


def test_best_fit_holds_its_bounds():
    rnd = random.Random(2)
    for capacity, n_open in ((10, 3), (512, 64), (7, 1)):
        bins = packing.BestFit(capacity, n_open)
        load, last = {}, {}
        for k in range(3_000):
            size = rnd.randint(0, capacity)
            b = bins.put(size)
            load[b] = load.get(b, 0) + size
            last[b] = k
            assert load[b] <= capacity and bins.n_open <= n_open
        assert sum(load.values()) <= capacity * len(load)


def _best_fit_slow(sizes, capacity, n_open):
    """Best fit by search: the open container with least room that holds the item; the fullest closes."""
    bins, out = [], []  # open: [free, number], later pushed ones are taken first among equals
    made = 0
    for s in sizes:
        fit = [b for b in bins if b[0] >= s]
        if fit:
            best = min(b[0] for b in fit)
            b = [x for x in bins if x[0] == best][-1]
            bins.remove(b)
        else:
            if len(bins) == n_open:
                least = min(b[0] for b in bins)
                bins.remove([x for x in bins if x[0] == least][-1])
            b = [capacity, made]
            made += 1
        b = [b[0] - s, b[1]]
        out.append(b[1])
        if b[0]:
            bins.append(b)
    return out


def test_best_fit_equals_search():
    rnd = random.Random(3)
    for _ in range(60):
        capacity, n_open = rnd.randint(1, 40), rnd.randint(1, 6)
        sizes = [rnd.randint(0, capacity) for _ in range(80)]
        bins = packing.BestFit(capacity, n_open)
        assert [bins.put(s) for s in sizes] == _best_fit_slow(sizes, capacity, n_open)


def test_pack_whole(spark):
    d = spark.createDataFrame([(k, k % 37) for k in range(500)] + [(1000, 95), (1000, 95), (None, 5), (7, None)], "doc_id long, n long")
    rows = packing.pack(d, [("p", 30), ("q", 64)], "doc_id", "n", 3, open_bins=8).toPandas()
    for name, cap in (("p", 30), ("q", 64)):
        g = rows[rows.profile_name == name]
        assert g.groupby("container_id").n_units.sum().max() <= cap
        assert g.n_units.sum() == sum(k % 37 for k in range(500)) + 195
        assert (g[g.n_units < cap].groupby(g.doc_id).size() >= 1).all()
        whole = g[(g.doc_id < 1000) & (g.piece_no > 0)]
        assert set(whole.doc_id) == {float(k) for k in range(500) if k % 37 > cap}
    assert packing.pack(d.limit(0), [("p", 30)], "doc_id", "n", 1).count() == 0
