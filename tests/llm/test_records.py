import random

import numpy as np
import pytest

from docstruct.llm import names as N
from docstruct.llm import near_duplicates as D
from docstruct.llm import ocr as O


# problem 3 ------------------------------------------------------------------------------------------------------
def _slow(rows):
    out = set()
    for a, ta, ua in rows:
        for b, tb, ub in rows:
            if a is not None and b is not None and a < b:
                for x, y in ((ta, tb), (ua, ub)):
                    if x and y:
                        u, v = D.words_of(x), D.words_of(y)
                        if u and 10 * len(u & v) >= 7 * len(u | v):
                            out.add((a, b))
    return out


@pytest.mark.parametrize("bucket,block,listed,chunk", [(8_000, 16_000, 1 << 22, 1_000), (2, 16_000, 1 << 22, 3), (2, 3, 1 << 22, 1), (2, 3, 40, 2)])
def test_pairs_equal_brute_force(spark, bucket, block, listed, chunk):
    rnd = random.Random(8)
    base = [[rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 2) for _ in range(rnd.randint(1, 14))] for _ in range(25)]

    def text():
        w = list(rnd.choice(base))
        if rnd.random() < 0.6:
            w[rnd.randrange(len(w))] = rnd.choice(["New", "Ä", "x1"])
        rnd.shuffle(w)
        return rnd.choice([" ", ", "]).join(w)

    rows = [(k, text() if rnd.random() < 0.9 else None, text() if rnd.random() < 0.8 else "") for k in range(160)] + [(500, "a", "..."), (501, "A!", None)]
    d = spark.createDataFrame(rows + rows[:7], "ref_id long, raw_text string, title string")
    got = [tuple(r) for r in D.similar_pairs(d, "ref_id", ["raw_text", "title"], bucket_rows=bucket, block_rows=block, listed=listed, chunk_rows=chunk).collect()]
    assert len(got) == len(set(got)) and set(got) == _slow(rows)


def test_bounds_reach_the_rows():
    """Small bounds make the rows of parted buckets and of blocks, not only the plain ones."""
    sets = D.Sets([0] * 40, [f"a b c d e f g w{k}" for k in range(40)])
    counts = D.WordCounts(np.unique(sets.h), np.full(len(np.unique(sets.h)), 40), 1)
    n = [D._prefix_rows(sets, np.ones(40, bool), counts, 7, 10, *x).num_rows for x in ((100, 100), (2, 100), (2, 10))]
    assert n[0] < n[1] < n[2] and n[2] == 4 * n[1]


def test_key_with_several_texts(spark):
    one, other, near = "a b c d e f g h i j", "k l m n o p q r s t", "k l m n o p q r s u"
    d = spark.createDataFrame([(1, one, None), (1, other, None), (2, one, None), (3, near, None)], "ref_id long, raw_text string, title string")
    for _ in range(3):
        assert {tuple(r) for r in D.similar_pairs(d, "ref_id", ["raw_text", "title"]).collect()} == {(1, 2), (1, 3)}


def test_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(70_000))
    d = spark.createDataFrame([(1, long, None), (2, long + " more", None), (3, "w1 w2", None)], "ref_id long, raw_text string, title string")
    assert [tuple(r) for r in D.similar_pairs(d, "ref_id", ["raw_text", "title"]).collect()] == [(1, 2)]


def test_hot_copies_and_empty(spark):
    d = spark.createDataFrame([(k, "same words in all of them", None) for k in range(60)], "ref_id long, raw_text string, title string")
    assert D.similar_pairs(d, "ref_id", ["raw_text", "title"]).count() == 60 * 59 // 2
    assert D.similar_pairs(d.limit(0), "ref_id", ["raw_text", "title"]).count() == 0


# problem 6 ------------------------------------------------------------------------------------------------------
def test_forms():
    same = ["Karl-Heinz C. Gocatedeez", "Gocatedeez, Karl-Heinz C.", "GOCATEDEEZ, Karl-Heinz C.", " Dr. Karl-Heinz C. Gocatedeez "]
    assert len({N.form(s) for s in same}) == 1
    assert N.form("Nacahova JL") == N.form("J.-L. Nacahova") == N.form("Nacahova, J.-L.")
    assert N.form("The Alpine Parsing Inst.") == N.form("Institute of Alpine Parsing") == N.form("Alpine Parsing Institute (API)")
    assert N.form("et al.") == N.form("Et al") == N.form("...") == ""


LINKED = [["Emre Libugazeez", "LIBUGAZEEZ, Emre", "Libugzaeez, Emre", "E. Libugazeez", "Libugazeez E", " Emre Libugazeez"], ["William L. Dekitipan", "William Dekitipan", "Bill Dekitipan", "William L. Dekitpan"], ["Sven Dekitipan"], ["Gabriele Tipefeco", "Tipefeco, G."], ["Özge Nubavire", "Ozge Nubavire"], ["Alpine Corpus Consortium", "Alpine Corpsu Consortium", "The Alpine Corpus Consort."], ["Alpine Corpus Institute"]]


def test_links(spark):
    authors = [[n for n in group] + ["et al.", None, " "] for group in LINKED] + [None, []]
    d = spark.createDataFrame([(k, a) for k, a in enumerate(authors)] * 2, "ref_id long, authors array<string>")
    # the surnames among many others, as in a corpus, so that given names are the frequent words
    others = [f"{g} {x}o{y}e{x}u" for g in ("Emre", "William", "Sven", "Gabriele", "Özge", "Bill") for x in "BGHJRSV" for y in "bz"]
    d = d.unionByName(spark.createDataFrame([(100 + k, [n]) for k, n in enumerate(others)], d.schema))
    g = spark.createDataFrame([("William", "Bill"), (None, "x")], "given_name string, short_form string")
    got = {tuple(r) for r in N.linked_names(d, "authors", g).collect() if {r[0], r[1]} & {n for group in LINKED for n in group}}
    assert got == {(a, b) for group in LINKED for a in group for b in group if a < b}
    assert N.linked_names(d.limit(0), "authors", g).count() == 0


def _naive_linkage(nodes, edges, least):
    """Average linkage, one pair at a time; of equal ones the lesser names first."""
    groups = {n: [n] for n in nodes}
    s = {frozenset(e[:2]): e[2] for e in edges}
    while True:
        best = None
        for a in groups:
            for b in groups:
                if a < b:
                    m = round(sum(s.get(frozenset((x, y)), 0) for x in groups[a] for y in groups[b]) / len(groups[a]) / len(groups[b]), 9)
                    if m >= least and (best is None or (-m, a, b) < best):
                        best = (-m, a, b)
        if best is None:
            return {n: g for g, ns in groups.items() for n in ns}
        groups[best[1]] += groups.pop(best[2])


@pytest.mark.parametrize("seed", [1, 2])
def test_average_linkage(spark, seed):
    rnd = random.Random(seed)
    nodes = [f"n{k:02}" for k in range(30)]
    edges = [(a, b, rnd.randint(36, 100) / 100) for a in nodes for b in nodes if a < b and rnd.random() < 0.12]
    want = _naive_linkage(nodes, edges, 0.42)
    got = {r.node: r.group_id for r in N.linked_groups(spark.createDataFrame(edges, "a string, b string, s double")).collect()}
    assert {n: got.get(n, n) for n in nodes} == want
    assert N.linked_groups(spark.createDataFrame([], "a string, b string, s double")).count() == 0


def _some_forms():
    rnd = random.Random(4)
    surnames = ["".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(30)]
    given = ["anna", "boris", "clara", "daniel", "emma"]
    out = set()
    for _ in range(150):
        w = list(rnd.choice(surnames))
        if rnd.random() < 0.3:
            w[rnd.randrange(len(w))] = "x"
        full = rnd.random() < 0.6
        out.add(N.form(("%s %s" if full else "%s. %s") % (rnd.choice(given)[: None if full else 1].capitalize(), "".join(w).capitalize())))
    return sorted(out | {N.form("Alpine Corpus Institute"), N.form("ACI")} - {""})


@pytest.mark.parametrize("hot", [0, 3, 300])
def test_join_equals_brute_force(spark, hot):
    forms = _some_forms()
    d = spark.createDataFrame([(f,) for f in forms], "form string")
    st = N._statistics(d, spark.createDataFrame([], "given_name string, short_form string"))
    vectors = [{h: w for h, w, _ in N.vector(f, st)} for f in forms]
    want = {(a, b) for k, a in enumerate(forms) for m, b in enumerate(forms) if k < m and N.cosine(vectors[k], vectors[m]) >= N.LEAST_COSINE}
    got = [(r.a, r.b) for r in N._joined(d, spark.sparkContext.broadcast(st), hot=hot).collect()]
    assert len(want) > 30 and len(got) == len(set(got)) and set(got) == want


def test_large_bucket_in_blocks(monkeypatch):
    monkeypatch.setattr(N, "BLOCK_FORMS", 7)
    rnd = random.Random(5)
    packed = [np.array(sorted((h, 0.3) for h in rnd.sample(range(40), 8)), N._PAIR).tobytes() for _ in range(50)]
    sets = [set(np.frombuffer(x, N._PAIR)["h"].tolist()) for x in packed]
    got = [(i, j) for p, q in N._near_in_bucket(packed, 0.9) for i, j in zip(p.tolist(), q.tolist())]
    assert sorted(got) == [(i, j) for i in range(50) for j in range(i + 1, 50) if len(sets[i] & sets[j]) * np.float32(np.float16(0.3)) ** 2 >= 0.43]


@pytest.mark.parametrize("block", [7, 512])
def test_pairs_of_many_buckets_equal_brute_force(monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_FORMS", block)
    rnd = random.Random(8)
    rows = [(b, {h: 0.6 * rnd.random() for h in rnd.sample(range(30), rnd.randint(1, 10))}) for b in range(40) for _ in range(rnd.choice([1, 2, 5, 20, 40]))]
    packed = [np.array(list(v.items()), N._PAIR).tobytes() for _, v in rows]
    vectors = [{int(h): float(w) for h, w in np.frombuffer(x, N._PAIR)} for x in packed]
    want = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i][0] == rows[j][0] and N.cosine(vectors[i], vectors[j]) >= 0.3]
    got = sorted((i, j) for p, q in N._near_in_buckets(np.array([b for b, _ in rows]), packed, 0.3) for i, j in zip(p.tolist(), q.tolist()))
    assert len(want) > 100 and got == want


def test_bucket_rows_do_not_grow_with_the_corpus():
    # 2,000 or 200,000 forms expected for each n-gram and letter: no more rows than features, where pairs of features were hundreds
    for k in (1, 100):
        st = N.Statistics({"n:": 20_000 * k, "l:e": 20_000 * k, "l:l": 20_000 * k, "w:emre": 1000 * k}, 2000 * k, {})
        f = N.form("Emre Libugazeez")
        keys = [b for b, _ in N._bucket_rows(f, st, N.LEAST_COSINE, N.HOT_FORMS)]
        parts = -(-2000 * k // N.HOT_FORMS)
        assert len(keys) == len(set(keys)) <= parts * len(N.vector(f, st))


def test_short_forms_are_learned(spark):
    given = ["Konrad", "Radko", "Sven", "Uma", "Boris", "Hana", "Emre", "Zoltan"]
    names = [f"{g} Tar{k:02}mo".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(40) for g in (("Konrad", "Radko") if k % 4 == 0 else (given[k % 8],))]
    forms = spark.createDataFrame([(N.form(n),) for n in names], "form string")
    st = N._statistics(forms, spark.createDataFrame([], "given_name string, short_form string"))
    assert st.full("radko") == st.full("konrad") and st.full("sven") == "sven"


def test_every_surname_and_pair_counts_for_short_forms(spark, monkeypatch):
    # each surname has more than 30 given names; Konrad and Radko share some of them
    rnd = random.Random(6)
    word = lambda k: "".join("bdfgklmnprst"[k // 12**i % 12] + "aeiou"[k // 5**i % 5] for i in range(3))
    given = [word(k) + "n" for k in range(7, 207)]
    pairs = {(f"{word(1000 + 7 * s)}x", g) for s in range(80) for g in [*rnd.sample(given, 33), *(("konrad", "radko") if s % 7 == 0 else ())]}
    forms = spark.createDataFrame([(" ".join(sorted(p)) + "|",) for p in pairs], "form string")
    st = spark.sparkContext.broadcast(N.Statistics({"n:": len(pairs)} | {f"w:{g}": 1000 for _, g in pairs}, 1, {}))
    assert list(N._short_forms(forms, st)) == [("konrad", "radko")]
    monkeypatch.setattr(N, "LISTED", 1)
    assert list(N._short_forms(forms, st)) == [("konrad", "radko")]


# problem 2 ------------------------------------------------------------------------------------------------------
LEX = O.Lexicon({w: 100 for w in "our domain-agnostic regression confirms the lattice of stable kernels in every classifier without labels detector kernel-map journal".split()})


def test_misread():
    for t, w in {"c1assifier": "classifier", "confirrns": "confirms", "stab1e": "stable", "jourrial": "journal", "defector": "detector", "laftlce": "lattice"}.items():
        assert LEX.misread(t)[0] == w
    for t in ("classifier", "Tofosada", "v3", "of", "domain-agnostic"):
        assert LEX.misread(t) is None


def test_cuts():
    assert LEX.is_cut("classi", "fier") and LEX.is_cut("con", "firms") and LEX.is_cut("classi", "f1er")
    assert not LEX.is_cut("domain", "agnostic") and not LEX.is_cut("kernel", "map")
    assert LEX.is_cut("labe", None) and not LEX.is_cut("domain", None)


def test_lines_are_labelled():
    lines = ["our stable classi-", "- 38 -", "Vivapari: a stable lattice 38", "fier confirms the lattice", "38."]
    seen = O.observe(lines, {2}, None, LEX)
    states = O.LineModel().label(seen)
    assert states == [O.BREAK, O.NUMBER, O.HEADER, O.BODY, O.BODY]
    assert O.join_lines(lines, states) == "our stable classifier confirms the lattice 38."


def test_ocr_tables(spark):
    clean = "Our domain-agnostic regression confirms the lattice of stable kernels in every classifier without labels. "
    scan = "Our domain-\nagnostic regres-\nHEAD: A STABLE LATTICE\n12\nsion conf1rms the lattice of stable\nkernels in every classifier."
    sections = [(k, k, 0, [clean * 3], "text") for k in range(30)] + [(100, 50, 0, [scan, None, "", clean], "ocr"), (101, 50, 1, [scan.replace("12", "13")], "ocr"), (102, 51, 0, None, "ocr")]
    s = spark.createDataFrame([(a, p, c, d) for a, p, _, c, d in sections], "section_id long, paper_id long, contents array<string>, layer string")
    page = [("Notes", 36.0, 8.0, 0, 0), ("on", 36.0, 8.0, 0, 0), ("Our", 60.0, 10.0, 1, 0), ("stable", 60.0, 10.0, 1, 0), ("classi-", 60.0, 10.0, 1, 0), ("fier", 72.0, 10.0, 1, 1), ("conf1rms", 72.0, 10.0, 1, 1), (None, 72.0, 10.0, 1, 1), ("", 72.0, 10.0, 1, 1), ("labels.", 84.0, 10.0, 1, 2), ("7", 756.0, 8.0, 2, 0)]
    w = spark.createDataFrame([(k + 1, 50, 1, b, ln, k, t, 10.0, y, 9.0, h) for k, (t, y, h, b, ln) in enumerate(page)] * 2, "word_id long, paper_id long, page_number int, block_idx int, line_idx int, word_idx int, text string, x double, y double, width double, height double")
    r = O.OcrRepair(s, w)
    got = {tuple(x) for x in r.found().collect()}
    want = {("contents", a, 0, k) for a in (100, 101) for k in ("break", "misread", "furniture")} | {("word", k, 0, "furniture") for k in (1, 2, 11)} | {("word", 5, 0, "break"), ("word", 7, 0, "misread")}
    assert got == want
    text = {(x.section_id, x.item_no): x.text for x in r.paragraphs().collect()}
    assert text[100, 0] == "Our domain-agnostic regression confirms the lattice of stable kernels in every classifier."
    empty = O.OcrRepair(s.limit(0), w.limit(0))
    assert empty.found().count() == 0


def test_rare_words_are_repair_targets(spark):
    usual = "every classifier confirms the regular lattice of stable kernels in the northern regime. "
    text = [(k, k, [usual * 3], "text") for k in range(40)] + [(50 + k, 50 + k, [x], "text") for k, x in enumerate(["a quaternion", "latfice"])]
    scans = [usual.replace("every", "evcry"), "the quatcrnion", "the Tofosada", "the latfice", "the quatern1on"]
    rows = text + [(100 + k, 100 + k, [x], "ocr") for k, x in enumerate(scans)]
    s = spark.createDataFrame(rows, "section_id long, paper_id long, contents array<string>, layer string")
    w = spark.createDataFrame([(1, 100, 1, 0, 0, 0, "quatcrnion", 1.0, 60.0, 9.0, 10.0), (2, 100, 1, 0, 0, 1, "latfice", 9.0, 60.0, 9.0, 10.0)], "word_id long, paper_id long, page_number int, block_idx int, line_idx int, word_idx int, text string, x double, y double, width double, height double")
    r = O.OcrRepair(s, w)
    assert "quaternion" not in r.lexicon.value
    # a word counted once is found again and repaired; a right word that is rare is none, though near a usual one
    assert {tuple(x)[:3] for x in r.found().filter("noise_kind = 'misread'").collect()} == {("contents", 100, 0), ("contents", 101, 0), ("contents", 104, 0), ("word", 1, 0)}
    got = {x.section_id: x.text for x in r.paragraphs().collect()}
    assert (got[101], got[102], got[103], got[104]) == ("the quaternion", "the Tofosada", "the latfice", "the quaternion") and got[100].startswith("every ")


def test_a_line_of_one_word_may_break_again():
    seen = [(4, 0, 2), (4, 0, 2), (4, 0, 0)]
    out = O._page_noise([[1], [2], [3, 4]], [["class-"], ["if1-"], ["er", "c1assifier"]], seen, [O.BREAK, O.BREAK, O.BODY], LEX)
    assert [x[0] for x in out if x[2] == "break"] == [1, 2]
    assert [x[:1] + x[3:] for x in out if x[2] == "misread"] == [(1, "classif1er", 0, 5), (2, "classif1er", 5, 8), (3, "classif1er", 8, O._NO_END), (4, "c1assifier", None, None)]
