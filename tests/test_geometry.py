from docstruct.functions import geometry as G
from docstruct.operators import layout

RECTS = {"a": (0, 0, 10, 10), "b": (5, 5, 15, 15), "c": (15, 15, 25, 25), "d": (0, 0, 5, 5), "e": (20, 5, 25, 10), "f": (5, 20, 10, 25)}


def _pair(spark, p, q, fn):
    row = [tuple(map(float, RECTS[p] + RECTS[q]))]
    d = spark.createDataFrame(row, "ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double")
    return d.select(fn(G.Rect.of("a"), G.Rect.of("b")).alias("r")).first()["r"]


def test_overlap(spark):
    assert {(p, q): _pair(spark, p, q, G.overlaps) for p, q in ("ab", "ad", "ac", "ae", "af", "bc", "bd", "be", "bf")} == {("a", "b"): True, ("a", "d"): True, ("a", "c"): False, ("a", "e"): False, ("a", "f"): False, ("b", "c"): False, ("b", "d"): False, ("b", "e"): False, ("b", "f"): False}


def test_iou_is_symmetric_and_cover_is_not(spark):
    assert _pair(spark, "a", "b", G.iou) == _pair(spark, "b", "a", G.iou) == 25 / 175
    assert _pair(spark, "a", "c", G.iou) == 0
    assert _pair(spark, "d", "a", G.covered) and not _pair(spark, "a", "d", G.covered)


def _words(spark, rows):
    return spark.createDataFrame([(*r[:6], *map(float, r[6:])) for r in rows], "paper_id long, page_number int, block_idx int, line_idx int, word_idx int, text string, x double, y double, width double, height double")


def test_lines_and_blocks_fold(spark):
    w = _words(spark, [(1, 1, 0, 0, 0, "data", 0, 0, 10, 5), (1, 1, 0, 0, 1, "dri-", 11, 0, 10, 5), (1, 1, 0, 1, 0, "ven", 0, 6, 10, 5), (1, 1, 0, 1, 1, " ", 20, 6, 1, 5), (1, 1, 0, 1, 1, None, 20, 6, 1, 5), (1, 1, 0, 2, 0, "end-", 0, 12, 9, 5), (1, 1, 0, 2, 0, "end-", 0, 12, 9, 5)])
    b = layout.blocks(layout.lines(w)).collect()
    assert [(r.text, r.n_lines) for r in b] == [("data driven end-", 3)]
    assert layout.lines(w.limit(0)).count() == 0


def test_ruling_tables(spark):
    rows = [(1, 0.0, float(y), float(200 + k), float(y), 612.0, 792.0) for k, y in enumerate((10, 20, 30))] + [(1, 0.0, 400.0, 300.0, 400.0, 612.0, 792.0), (1, 5.0, 0.0, 5.0, 500.0, 612.0, 792.0), (2, 0.0, 1.0, 600.0, 1.0, 612.0, 792.0)]
    rows += [(3, 0.0, float(y), 600.0, float(y), 612.0, 792.0) for y in (1, 400, 790)]
    d = spark.createDataFrame(rows, "page_id long, x1 double, y1 double, x2 double, y2 double, page_width double, page_height double")
    assert [tuple(r) for r in layout.ruling_tables(d).collect()] == [(1, 0.0, 10.0, 202.0, 30.0)]
