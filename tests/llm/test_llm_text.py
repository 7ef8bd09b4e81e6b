import random

import pytest

from docstruct.llm import confusables as C
from docstruct.llm import garbled as E
from docstruct.llm import splitting as P
from docstruct.llm.sentences import sentence_ends, sentences


# problem 1 ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("text,want", [
    ("еach", "each"), ("Réѕumé", "Résumé"), ("Bведение", "Введение"), ("Αbstract", "Abstract"), ("warm‐up", "warm-up"), ("conﬁrms", "confirms"), ("⼿法", "手法"), ("Ｆｉｇ．", "Fig."),
    ("a​b­c", "abc"), ("12. Tuned　x", "12. Tuned x"), ("é", "é"), ("данныx", "данных"), ("", ""),
])
def test_consistent(text, want):
    assert C.consistent(text) == want and C.consistent(want) == want


@pytest.mark.parametrize("text", ["Ведомости", "σ² ≤ α", "手法：（実験）。", "“x” – ‘y’ …", "พลัง กำลัง", "परिचय", "مقدمة", "naïve\ncafé", "10 μm"])
def test_no_case(text):
    assert C.consistent(text) == text


def test_skeletons(spark):
    assert C.skeleton("еach") == C.skeleton("each") == C.skeleton("e​ach")
    d = spark.createDataFrame([("each",), ("еach",), ("each",), (None,), ("",), ("other",)], "text string")
    assert [tuple(r) for r in C.skeleton_groups(d, [], "text").collect()] == [("each", 2, 3, "each")]
    rows = C.consistent_items(d.selectExpr("1L AS section_id", "0 AS item_no", "text"), ["section_id", "item_no"], "text").collect()
    assert sum(r.is_changed for r in rows) == 1 and len(rows) == 6


def test_look_alikes_by_corpus(spark):
    usual = [(k, f"copy the data of a model {k}") for k in range(5)] + [(10 + k, "нос и рост, данные и модель") for k in range(5)]
    cases = {20: ("the dɑta here", "the data here"), 21: ("сору the model", "copy the model"), 22: ("дaнные и мοдель", "данные и модель"), 23: ("դ of а model", None), 24: ("рoст и hoc", None)}
    none = [(30, "kapı of the model"), (31, "нос и рост а не"), (32, "the ο of model"), (33, "σ² and ν of a model"), (34, None), (35, "")]
    rows = usual + [(k, t) for k, (t, _) in cases.items()] + none
    d = spark.createDataFrame([(k, None, [t]) for k, t in rows], "section_id long, title string, contents array<string>")
    got = {r.section_id: (r.is_changed, r.consistent_text) for r in C.section_forms(d).collect()}
    for k, (_, want) in cases.items():
        assert got[k][0] and want in (None, got[k][1]), got[k]
    assert got[23][1] == "դ of a model"
    assert not any(got[k][0] for k, t in usual + none if t)


# problem 4 ------------------------------------------------------------------------------------------------------
def _check(text, cap, overlap):
    spans = P.split_text(text, cap, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for k, (s, e) in enumerate(spans):
        assert 0 < e - s <= cap
        if k:
            assert s == spans[k - 1][1] - overlap and e > spans[k - 1][1]
    return spans


def test_split_properties():
    rnd = random.Random(4)
    for _ in range(300):
        text = "".join(rnd.choice(["word", " ", ". A", "\n", "\n\n", "- x", "é", "中。", ", "]) for _ in range(rnd.randint(1, 200)))
        cap = rnd.randint(2, 60)
        _check(text, cap, rnd.randint(0, cap - 1))
    _check("x" * 100_000, 3000, 200)


def test_split_is_natural():
    text = "One two three. " * 10 + "\n\n" + "Four five. " * 10
    assert all(text[e - 1].isspace() for _, e in _check(text, 160, 0)[:-1])
    assert _check("a b\n\nc d", 5, 0)[0] == (0, 5)
    assert P.split_text("short", 10, 2) == [(0, 5)]


def test_split_follows_the_tree():
    part = lambda n: "Some words. " * n
    text = "# A\n" + part(5) + "\n## A.1\n" + part(5) + "\n# B\n" + part(2) + "\n- x\n  - y\n- z"
    cuts = [text[s:e] for s, e in P.split_text(text, 90, 0)]
    assert "".join(cuts) == text and [c[:5] for c in cuts] == ["# A\nS", "## A.", "# B\nS"]
    # an opened section's end is not joined with the next section
    text = "# A\n" + part(12) + "\n# B\n" + part(1)
    assert any(text[s:].startswith("# B") for s, _ in P.split_text(text, 80, 0))
    items = "- one " + "a" * 30 + "\n  - sub " + "b" * 20 + "\n- two " + "c" * 30
    assert [items[s:e][:5] for s, e in P.split_text(items, 70, 0)] == ["- one", "- two"]


def test_split_rows(spark):
    d = spark.createDataFrame([(1, 0, "a " * 50), (1, 1, None), (2, 0, ""), (3, 0, "b")], "section_id long, item_no int, text string")
    rows = P.split_oversized(d, ["section_id", "item_no"], "text", 30, 5).collect()
    assert {r.section_id for r in rows} == {1} and max(len(r.piece) for r in rows) <= 30


def test_skeletons_by_the_public_table(spark):
    table = C.prototypes(spark)
    for a, b in (("Ꭺpple", "Apple"), ("ꓮꓐꓚ", "ABC"), ("ⲟld", "old"), ("ꜱmall", "small"), ("0ne", "One"), ("1t", "It"), ("modern", "modem"), ("раураl", "paypal")):
        assert C.skeleton(a, table) == C.skeleton(b, table)
    assert C.skeleton("apple", table) != C.skeleton("apples", table)


def test_words_wholly_of_look_alikes():
    assert C.consistent("раураl") == "paypal" and C.consistent("The раураl site") == "The paypal site"
    assert C.consistent("ΑΒС") != "ΑΒС"
    assert C.consistent("Новая рacа") == "Новая раса"


def test_found_by_class(spark):
    d = spark.createDataFrame([(1, 0, "plain data"), (2, 0, "d\u0430ta here"), (3, 0, "da\u200bta"), (4, 0, "a\u00a0b"), (5, 0, None), (6, 0, ""), (7, 0, "Новая")], "section_id long, item_no int, text string")
    got = C.found_items(C.consistent_items(d, ["section_id", "item_no"], "text"), ["section_id", "item_no"])
    assert sorted(r.section_id for r in got.collect()) == [2, 3, 4]


# problem 5 ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("parts", [
    ["Our tensor per Dr. Calder on page 2.", " The J. R. Ri argues.", " At approx. 22.5 ms.", " Our “Does it hold?” was asked.", " It ends etc.", " eSort x.", " See Fig. 25.", "  The end.", "Every x at 9 p.m"],
    ["The note reads: “Our north.”", " eSort late.", " (A b.)", " Code v4.8 is at https://r.invalid/s.git and run.6.txt.", " The x.[27]", " Next."],
    ["Das ist z. B. im Lauf Nr. 38.", " Das am 28. Mai.", " Es gilt u. a.", " Die Regel d. h. binnen 3 Tagen."],
    ["La note : « Le mo. »", " Un x selon M. Tavel à la p. 13."],
    ["Общий в 2024 г. и позже.", " Новая и др.", " Этот т. е. на 39.", " Второй «Новая.»", " Этот"],
    ["記録：「第二の実験。」", "このモデルは図8.2で。", "（小さな。）", "次は？", "終"],
    ["यह पृ. 29 के है।", " दूसरा डॉ. वेल है।", " “हमारा है।”", " नया"],
    ["ตัวแปลงขนาดตาม Fig. 3 นี้", " วิธีการใหม่ในปี พ.ศ. 2519 นั้น", " “แบบจำลอง”"],
    ["3.84 1.12 4.5"], ["¿La codificación? ", "¡Sí! "],
    ['He said "Stop. Go now." and left.', " More."], ["(see above. Also below. Both hold) and stopped.", " End."], ['"First.', ' Second."', " Third."],
    ["1. First item.", " 2. Second item.", " 3. Third."], ["1. A one.", " 1. Sub one.", " 2. Sub two.", " 2. B two."], ["A (b.", " C is open."],
])
def test_sentences(parts):
    text = "".join(parts)
    ends, at = [], 0
    for p in parts:
        at += len(p.rstrip()) if p != parts[-1] else len(p)
        ends.append(at)
        at += len(p) - len(p.rstrip()) if p != parts[-1] else 0
    assert sentence_ends(text) == ends


def test_sentence_properties(spark):
    rnd = random.Random(6)
    for _ in range(500):
        t = "".join(rnd.choice(["Ab ", "cd", ". ", "? ", "”", "“", "(", ")", "\n", "。", "e.g. ", "3.5", " ", "​"]) for _ in range(rnd.randint(0, 30)))
        e = sentence_ends(t)
        assert e == sorted(set(e)) and (not t.strip() or e[-1] == len(t))
    d = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, "  "), (4, "")], "k long, text string")
    assert sorted(tuple(r) for r in sentences(d, ["k"], "text").collect()) == [(1, 0, 0, 4), (1, 1, 5, 9)]
    assert len(sentence_ends("Word " * 200_000 + ".")) == 1


# problem 9 ------------------------------------------------------------------------------------------------------
def test_undo_is_the_inverse():
    text = "Über größere Maße — „so“"
    for written, read in (("utf_8", "cp1252"), ("utf_8", "cp437"), ("utf_8", "mac_roman"), ("cp1252", "mac_roman"), ("cp1252", "cp1251")):
        raw = text.encode(written)
        seen = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in raw)
        assert E.undo_step(seen, written, read) == text
    for plain in ("FUNDAÇÃO DE AÇÕES", "Exhibits ┬ 3 ┴ 4", "© 2012 – •"):
        assert E.undo_step(plain, "utf_8", "cp1252") is None


def test_find_garbled(spark):
    rnd = random.Random(7)
    words = "Der Kläger rügt die Gebühr für das Verfahren über größere Beträge gemäß der Übung".split()
    good = [" ".join(rnd.choice(words) for _ in range(12)) for _ in range(300)]
    bad = {3: ("utf_8", "cp1252"), 50: ("utf_8", "cp437"), 120: ("cp1252", "mac_roman"), 200: ("utf_8", "cp1252")}
    lines = [g if k not in bad else g.encode(bad[k][0]).decode(bad[k][1], "replace") for k, g in enumerate(good)]
    lines[250] = "verk�rzt"
    docs = [(k // 10, "\n".join(lines[k : k + 10]), "s") for k in range(0, 300, 10)] + [(900, None, None), (901, "", "s"), (902, "plain ascii", None)]
    rows = E.find_garbled(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert {r.doc_id * 10 + r.line_no for r in rows} == set(bad) | {250}
    for r in rows:
        k = r.doc_id * 10 + r.line_no
        assert r.is_restored == (k != 250) and (k == 250 or r.restored == good[k])
    assert E.find_garbled(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
