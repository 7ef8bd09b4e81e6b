import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docstruct.functions import text as X


def test_suffix_hyphens(spark, one):
    pairs = {f"data{s}": f"data-{s}" for s in X.HYPHEN_SUFFIXES if s != "dependent"}
    rows = spark.createDataFrame(list(pairs.items()), "a string, b string")
    got = rows.select("a", "b", X.suffix_hyphens(rows.a).alias("r")).collect()
    assert [r.r for r in got] == [r.b for r in got]
    for a, b in {"contextawarebased": "context-aware-based", "independent": "in-dependent", "DATABASED": "DATABASED", "data-based": "data-based", "": ""}.items():
        assert one(X.suffix_hyphens, a) == b
    assert one(X.suffix_hyphens, None) is None


def test_number_strips(one):
    for a, b in {"2.": "", "3.1 Setup": "1 Setup", "1 Introduction": "Introduction", "Intro": "Intro"}.items():
        assert one(X.strip_title_number, a) == b
    for a, b in {"Results in v2. final": "Results in v final", "1 Introduction": "1 Introduction", "a\n2. b 3.": "a\n b 3."}.items():
        assert one(X.strip_first_number, a) == b


@pytest.mark.parametrize("t,want", [("Figure 1: x", True), ("FIG. 4. x", True), ("Table 2. x", True), ("Algorithm 1: x", True), ("Listing 1: x", True), ("Appendix Figure A1: x", True), ("Table B2. x", True), ("The figure shows", False), ("See Figure 1", False), ("1. Introduction", False), ("Abstract", False)])
def test_captions(one, t, want):
    assert one(X.is_caption, t) is want


def test_normalize_and_spacing(one):
    assert one(X.normalize_for_matching, "  Hello,  World! ") == "hello world"
    assert one(X.normalize_for_matching, "α + β = γ") == "α β γ"
    assert one(X.sentence_spacing, "a.(b)  c.ä") == "a. (b) c.ä"


def test_density(one):
    assert one(X.math_density, "This is a normal sentence.") == 0.0
    assert one(X.math_density, "f ( x ) = a b c d e f g h i j k") == pytest.approx(0.3)
    assert one(X.math_density, "x ≤ y and 1/2") == pytest.approx(0.5)
    assert one(X.math_density, "") == 0.0


def test_latex(one):
    assert one(X.latex_to_math_tags, "Inline $a$ and display $$b$$") == 'Inline <math>a</math> and display <math display="block">b</math>'
    assert one(X.unicode_math_to_latex, "α <math>α + β</math> ≤ <math display=\"block\">x² + y₃</math>") == 'α <math>\\alpha + \\beta</math> ≤ <math display="block">x^{2} + y_{3}</math>'


def test_trigrams(spark, one):
    assert one(X.trigrams, "ab") == ["ab"]
    assert one(X.trigrams, "") == []
    d = spark.createDataFrame([("the quick brown fox", "the quikc brown fox")], "a string, b string")
    assert d.select(X.trigram_jaccard(d.a, d.b)).first()[0] == pytest.approx(0.6190476190476191)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdeflinvdr-. "), max_size=30), min_size=1, max_size=20))
def test_suffix_hyphens_only_inserts(spark, texts):
    d = spark.createDataFrame([(t + "driven",) for t in texts], "t string")
    for r in d.select("t", X.suffix_hyphens(d.t).alias("r")).collect():
        assert r.r.replace("-", "") == r.t.replace("-", "")
