import json

import pytest
from pyspark.sql import functions as F

from docstruct import cli
from docstruct.operators import math_markup, references
from docstruct.plans import model_steps
from docstruct.plans.corpus import Corpus
from docstruct.sources import formats


@pytest.mark.parametrize("text,want", [
    ('[{"title": "a", "year": 2020, "other": {"x": 1}}]', ["a"]), ('Here: [{"title": "a"}, {"authors": ["b"]}] done', ["a", None]), ("[]", []),
    ('[{"title": 5}]', []), ('[{"authors": ["a", 3]}]', []), ('[{"doi": {"x": 1}}]', []), ('{"title": "a"}', []), ('[{"year": 2020.5}]', []),
    ('[{"year": 99999999999}]', []), ('[{"title": "a"}] and [{"title": "b"}]', []), ("[3]", []), ("none", []), ("", []), (None, []),
])
def test_reference_types(one, text, want):
    assert [r["title"] for r in one(references.parse_references, text)] == want


@pytest.mark.parametrize("text,want", [('["A", "B"]', ["A", "B"]), ('Sure: ["A"] ok', ["A"]), ('["A", 3]', []), ('["A"] and ["B"]', []), ('["A", null]', []), ("no", []), (None, [])])
def test_title_list_types(one, text, want):
    assert one(references.parse_title_list, text) == want


def _page(lines, number):
    words = "".join(f'<block><line><word xMin="50" yMin="{y}" xMax="{50 + 8 * len(t)}" yMax="{y + 10}">{t}</word></line></block>' for y, t in lines)
    return f'<page width="612" height="792">{words}</page>'


PAGES = [[(60, "Abstract"), (200, "We study x_i and more of it here in a long line of text for width"), (400, "1. Introduction"), (700, "The ∑ of all α ≤ β holds in this rather long line of text here")], [], [(60, "Method goes on in a line of text that is long enough to be kept whole"), (700, "7. References")], [(60, "[1] A. Author. A work of some length, in a journal, 2020, pp. 1-9."), (700, "End of the bibliography, which is again a long line of text here.")]]


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "p1.xhtml").write_text("<doc>" + "".join(_page(p, k) for k, p in enumerate(PAGES)) + "</doc>")
    big = {"Abstract", "1. Introduction", "7. References"}
    pages = "".join(f'<page number="{k + 1}">' + "".join(f'<text font="{1 if t in big else 0}">{t}</text>' for _, t in p) + "</page>" for k, p in enumerate(PAGES))
    (tmp_path / "p1.xml").write_text('<fontspec id="0" size="10" family="Times"/><fontspec id="1" size="14" family="Times-Bold"/>' + pages)
    (tmp_path / "p1.info").write_text("Title: x\nPages: 4\nPage size: 612 x 792 pts\n")
    for k in (1, 3, 4):
        (tmp_path / f"p1-{k}.jpg").write_bytes(b"image")
    return tmp_path


def test_from_sources(spark, folder):
    xhtml = formats.read_whole(spark, f"{folder}/*.xhtml")
    assert formats.layout_pages(xhtml).count() == 4
    c = Corpus.from_sources(xhtml, formats.read_whole(spark, f"{folder}/*.xml"), formats.read_whole(spark, f"{folder}/*.info")).text_area()
    assert {(r.page_number, r.title) for r in c.titles.collect()} == {(1, "Abstract"), (1, "Introduction"), (3, "References")}
    assert c.pages.count() == 3  # a page without words is none
    assert [r.title for r in c.sections().orderBy("place").collect()] == ["Abstract", "Introduction", "References"]
    assert c.references_text().first()["text"].startswith("7. References\n[1] A. Author")


def _model():
    """A stub; made in a function, so that it goes to the workers by value."""
    titles_prompt, references_prompt = model_steps.ASK_TITLES, model_steps.ASK_REFERENCES

    def answer(prompt, content):
        if prompt == titles_prompt:
            assert len(content) == 2  # the images of pages 1 and 3
            return '["Abstract", "Introduction", "References", "Method goes on in a line of text that is long enough to be kept whole"]'
        if prompt == references_prompt:
            return 'Here: [{"title": "A work", "year": 2020, "authors": ["A. Author"]}]'
        return "The $\\alpha$ text"

    return answer


def test_command_line(spark, folder, monkeypatch):
    monkeypatch.setattr(cli.importlib, "import_module", lambda name: type("M", (), {"answer": staticmethod(_model())}))
    out = folder / "out.json"
    read = lambda: json.loads(next(out.glob("part-*")).read_text())
    cli.main(["-p", str(folder), "-o", str(out), "--no-llm"])
    assert [s["title"] for s in read()] == ["Abstract", "Introduction", "References"] and "math_contents" in read()[1]
    cli.main(["-p", str(folder), "-o", str(out), "--no-math-markup", "--extract-references", "--model", "m:answer"])
    got = read()
    assert got["references"] == [{"authors": ["A. Author"], "title": "A work", "year": 2020}]
    assert any(s["title"].startswith("Method goes on") for s in got["sections"]) and not any("math_contents" in s for s in got["sections"])
    with pytest.raises(SystemExit) as e:
        cli.main(["-p", str(folder / "none")])
    assert e.value.code == 255
    with pytest.raises(SystemExit):
        cli.main(["-p", str(folder), "-o", "x.txt"])


def test_model_markup(spark):
    dense = "∑ ∏ ∫ ≤ ≥ ± × ÷ → ∑ ∏ ∫ the sum over all terms"
    blocks = spark.createDataFrame([(1, 1, 0, dense), (1, 1, 1, "a = b where x"), (1, 2, 0, "plain words only")], "paper_id long, page_number int, block_idx int, text string")
    figures = spark.createDataFrame([(1, 1, b"x"), (1, 2, b"y")], "paper_id long, page_number int, image binary")
    asked = model_steps.model_markup(blocks, figures, lambda p, c: "∑ ∏ ∫ ≤ ≥ ± × ÷ → ∑ ∏ ∫ the sum over $terms$")
    got = {r.block_idx: r.math_text for r in asked.collect()}
    assert "<math>terms</math>" in got[0] and 2 not in got
    failed = model_steps.model_markup(blocks, figures, lambda p, c: 1 / 0)
    assert failed.count() == 0


def test_align_paragraphs(spark):
    texts = spark.createDataFrame([(1, 1, "The first paragraph with <math>x</math> in it.\n\nAnother one about trees.")], "paper_id long, page_number int, text string")
    blocks = spark.createDataFrame([(1, 1, 0, "The first paragraph with x in it."), (1, 1, 1, "Another one about trees"), (1, 1, 2, "α = β unlike all"), (1, 2, 0, "α = β no text here")], "paper_id long, page_number int, block_idx int, text string")
    got = {(r.page_number, r.block_idx): r.math_text for r in math_markup.align_paragraphs(texts, blocks).collect()}
    assert got[1, 0].startswith("The first paragraph with <math>") and got[1, 1] == "Another one about trees." and "<math>" in got[1, 2] and (2, 0) not in got


def test_empty_info_is_an_error(spark):
    d = spark.createDataFrame([(" ",)], "t string")
    with pytest.raises(Exception, match="printed nothing"):
        d.select(formats.checked_info(F.col("t"))).collect()
