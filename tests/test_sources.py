from pyspark.sql import functions as F

from docstruct.sources import formats
from docstruct.streaming import paragraphs


def test_info_map(one):
    m = one(formats.info_map, "Title: a: b\nPage size: 612 x 792 pts\nTitle: c\nnothing\n")
    assert m == {"title": "c", "page_size": "612 x 792 pts", "page_width": "612", "page_height": "792"}


def test_layout_words(spark):
    html = '<doc><page width="612" height="792"><block><line><word xmin="1" ymin="2" xmax="4" ymax="6">A&amp;b</word><word xMin="5" yMin="2" xMax="6" yMax="6"> c </word></line></block></page><page width="612" height="792"></page></doc>'
    rows = formats.layout_words(spark.createDataFrame([("p", html)], "path string, text string")).collect()
    assert [(r.page_number, r.word_idx, r.text, r.x, r.width) for r in rows] == [(1, 0, "A&b", 1.0, 3.0), (1, 1, "c", 5.0, 1.0)]


def test_font_xml(spark):
    xml = '<page number="3"><fontspec id="2" size="12" family="X"/><text font="2"><b>Intro</b> &amp; x</text></page>'
    rows = formats.font_xml(spark.createDataFrame([("p", xml)], "path string, text string")).collect()
    assert [(r.kind, r.page_number, r.font_id, r.text) for r in rows] == [("font", 3, 2, None), ("text", 3, 2, "Intro & x")]


def test_figure_page(one):
    assert one(formats.figure_page, "/a-1/x-12.jpg") == 12
    assert one(formats.figure_page, "/a/x.jpg") is None


def test_stream_equals_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "databased x.\n\nFigure 1: y"), (2, None), (3, "")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    s = paragraphs.paragraph_rows(paragraphs.read_stream(spark, str(tmp_path / "in"), docs.schema))
    paragraphs.write_stream(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    key = lambda rows: sorted(map(tuple, rows))
    assert key(spark.read.parquet(str(tmp_path / "out")).collect()) == key(paragraphs.paragraph_rows(docs).collect())
    assert spark.read.parquet(str(tmp_path / "out")).filter(F.col("is_caption")).count() == 1
