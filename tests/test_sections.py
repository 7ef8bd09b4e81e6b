from itertools import product

from docstruct.operators import fonts, references, sections
from docstruct.sinks import export


def _merged(spark, rows):
    return spark.createDataFrame(rows, "paper_id long, ord long, text string, section string, block_type string")


def test_hyphen_chain(spark):
    rows = [(1, 0, "foo-", "A", "Body"), (1, 1, "bar-", "B", "Body"), (1, 2, "baz.", "C", "Body"), (1, 3, "q", "C", "Body"), (1, 4, "tail-", "D", "Body")]
    got = sections.merge_hyphen_chains(_merged(spark, rows)).orderBy("ord").collect()
    assert [(r.section, r.text) for r in got] == [("C", "foobarbaz."), ("C", "q")]


def _model(events):
    """Indexes as an insertion-ordered table gives them."""
    index, seen = {}, {}
    for s, kind in events:
        if kind == "Body":
            if s not in seen:
                index[s] = len(index)
                seen[s] = True
        elif s not in index:
            index[s] = len(index)
    return index


def test_section_index(spark):
    seqs = [[(s, k) for s, k in zip(ss, ks)] for n in (1, 2, 3, 4) for ss in product("AB", repeat=n) for ks in product(("Body", "Caption"), repeat=n)]
    rows = [(p, o, f"t{o}", s, k) for p, seq in enumerate(seqs) for o, (s, k) in enumerate(seq)]
    got = {(r.paper_id, r.title): r["index"] for r in sections.section_rows(_merged(spark, rows)).collect()}
    for p, seq in enumerate(seqs):
        assert {s: got[p, s] for s in {s for s, _ in seq}} == _model(seq)


def test_json_leaves_out_empty_captions(spark):
    m = _merged(spark, [(1, 0, "Text.", "Abstract", "Body"), (1, 1, "Figure 1: x", "Abstract", "Caption"), (1, 2, "More.", "Intro", "Body")])
    s = sections.section_rows(m)
    j = export.sections_json(s).first()["json"]
    assert j == '[{"index":0,"title":"Abstract","contents":["Text."],"captions":["Figure 1: x"]},{"index":1,"title":"Intro","contents":["More."]}]'
    assert export.sections_json(sections.with_captions(s)).first()["json"].count("captions") == 0


def test_assign_sections(spark):
    lines = spark.createDataFrame([(1, 1, 0, 0, "x"), (1, 1, 1, 0, "1. Introduction"), (1, 2, 0, 0, "Introduction"), (1, 2, 1, 0, "Method"), (2, 1, 0, 0, "y")], "paper_id long, page_number int, block_idx int, line_idx int, text string")
    titles = spark.createDataFrame([(1, 1, "Introduction"), (1, -1, "method")], "paper_id long, page_number int, title string")
    got = {(r.paper_id, r.page_number, r.block_idx): r.section for r in sections.assign_sections(lines, titles).collect()}
    assert got == {(1, 1, 0): "Abstract", (1, 1, 1): "Introduction", (1, 2, 0): "Introduction", (1, 2, 1): "Method", (2, 1, 0): "Content"}


def test_merge_titles(spark):
    font = [(1, k, p, t) for k, (p, t) in enumerate([(1, "Abstract"), (1, "Introduction"), (3, "Method"), (5, "Conclusion"), (6, "References")])]
    listed = [(1, k, t) for k, t in enumerate(["abstract", "Introduction", "Related Work", "Method", "Conclusion", "References", "Appendix"])]
    got = references.merge_titles(spark.createDataFrame(font, "paper_id long, ord long, page_number int, title string"), spark.createDataFrame(listed, "paper_id long, pos long, title string"), 1, 3)
    assert [(r.page_number, r.title) for r in got.orderBy("part", "ord").collect()] == [(1, "Abstract"), (1, "Introduction"), (3, "Method"), (5, "Conclusion"), (6, "References"), (-1, "Related Work"), (-1, "Appendix")]


def test_references_json(spark, one):
    size = lambda t: len(one(references.parse_references, t))
    assert size('[{"title":"a","year":2001,"x":1}]') == 1
    assert size('Here: [{"title":"a"}] end') == 1
    assert size('[{"title":"a","year":"soon"}]') == 0
    assert size("none") == 0 and size("") == 0 and size(None) == 0
    assert one(references.parse_title_list, 'ok ["A","B"]') == ["A", "B"]


def test_font_titles(spark):
    texts = [(1, 1, k, f, t) for k, (f, t) in enumerate([(3, "A Paper"), (2, "Abstract"), (1, "body text here that is long"), (2, "1. Introduction"), (2, "12"), (1, "more of the body text"), (3, "Big")])]
    specs = [(1, 1, 10.0, ""), (1, 2, 12.0, "Bold"), (1, 3, 20.0, "")]
    got = fonts.section_titles(spark.createDataFrame(texts, "paper_id long, page_number int, ord long, font_id int, text string"), spark.createDataFrame(specs, "paper_id long, font_id int, size double, family string"))
    assert [r.title for r in got.orderBy("ord").collect()] == ["Abstract", "Introduction"]
