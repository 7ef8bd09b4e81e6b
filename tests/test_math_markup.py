import random
import time

import pytest

from docstruct.operators import math_markup as M

GOLDEN = {
    "The variable α represents the learning rate.": "The <math>variable α represents the learning rate</math>.",
    "We have a ≤ b.": "We have <math>a ≤ b</math>.",
    "The learning rate α converges when x^2 ≤ β": "The learning <math>rate α converges when x^2</math> <math>≤</math> <math>β</math>",
    "where α ≤ β for all cases": "<math>where α</math> <math>≤</math> <math>β for all cases</math>",
    "where f(x) = ax + b represents the model": "where <math>f(x)</math> = ax + b represents the model",
    "where sin(x) + cos(θ) = 1": "where <math>sin(x)</math> + <math>cos(θ)</math> = 1",
    "compute x^2 + y^2": "compute <math>x^2</math> + <math>y^2</math>",
    "element x_i for i in S": "element <math>x_i for i in S</math>",
    "the ratio a/b approaches zero": "the ratio <math>a/b approaches zero</math>",
    "minimize ||w|| subject to constraints": "<math>minimize ||w|| subject to constraints</math>",
    "the value f(x) where α = 3": "the value <math>f(x) where</math> <math>α</math> = 3",
    "compute log(n) time": "compute <math>log(n) time</math>",
    "the sum ∑ of all values": "the <math>sum ∑ of all values</math>",
    "Given f(x) = ax + b": "Given <math>f(x)</math> = ax + b",
    "we have x ∈ S": "we have <math>x ∈ S</math>",
}
SAME = ["the rate 1/2 holds", "with p < 0.05 significance level was observed", "published in 2019/2020 and later in 2021/2022", "n = 50 participants were recruited", "from 01/15/2023 onwards", "as shown in (a) and discussed in (b)", "see method(s) for details", "", None]


@pytest.mark.parametrize("text,want", list(GOLDEN.items()) + [(t, t) for t in SAME])
def test_mark_math(text, want):
    assert M.mark_math(text) == want


def test_long_text_ends():
    assert M.mark_math("= " + "word " * 20_000).endswith("word ")


def _slow(needle, hay):
    grams = lambda s: {s[k : k + 3] for k in range(len(s) - 2)} or {s}
    best, where = 0.0, None
    if not needle or not hay:
        return None
    import math

    for size in range(max(1, math.floor(len(needle) * 0.7)), min(len(hay), math.ceil(len(needle) * 1.3)) + 1):
        for k in range(len(hay) - size + 1):
            a, b = grams(needle), grams(hay[k : k + size])
            s = len(a & b) / len(a | b)
            if s > best:
                best, where = s, (k, k + size)
    return where if best >= 0.4 else None


def test_best_alignment():
    rnd = random.Random(5)
    for _ in range(150):
        n = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 12)))
        h = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 30)))
        assert M.best_alignment(n, h) == _slow(n, h)


def test_has_alignment():
    rnd = random.Random(6)
    for _ in range(400):
        letters = "abcde "[: rnd.randint(2, 6)]
        n = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14)))
        h = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        assert M.has_alignment(n, h) == (_slow(n, h) is not None)


def _slow_nearest(block, paragraphs):
    grams = lambda s: {s[k : k + 3] for k in range(len(s) - 2)} or ({s} if s else set())
    best, where = 0.0, None
    for k, p in enumerate(paragraphs):
        a, b = grams(block), grams(p)
        score = len(a & b) / len(a | b) if a | b else 0.0
        if score < 0.4 and _slow(block, p):
            score = 0.4
        if score >= 0.4 and score > best:
            best, where = score, k
    return where


def test_nearest_paragraphs():
    rnd = random.Random(7)
    some = lambda most: "".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, most)))
    for _ in range(120):
        blocks, paragraphs = [some(14) for _ in range(4)], [some(30) for _ in range(rnd.randint(0, 5))]
        assert M.nearest_paragraphs(blocks, paragraphs) == [_slow_nearest(b, paragraphs) for b in blocks]


def test_long_page_ends(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9))) for _ in range(500)]
    texts = [" ".join(rnd.choice(words) for _ in range(300)) for _ in range(40)]
    blocks = spark.createDataFrame([(1, 1, k, t) for k, t in enumerate(texts)], "paper_id long, page_number int, block_idx int, text string")
    page = spark.createDataFrame([(1, 1, "\n\n".join(t.replace("e", "é") for t in texts))], "paper_id long, page_number int, text string")
    began = time.time()
    got = {r.block_idx: r.math_text for r in M.align_paragraphs(page, blocks).collect()}
    assert got == {k: t.replace("e", "é") for k, t in enumerate(texts)}
    assert time.time() - began < 40  # a search for windows in every unlike pair takes minutes
