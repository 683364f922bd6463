"""What must not come back: steps that make a row of every pixel or word, or shuffle them, where a document's row tells the result."""

import numpy as np
import pytest

from pagemill import registry
from pagemill.operators import tiles as T
from pagemill.sources import views as V

registry.load()
SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_page_that_reads_empty_page_is_not_blank(spark, tmp_path):
    rows = [(1, "(empty page)", "en", "s", 12), (2, "a\n" * 8 + "b", "en", "s", 17), (3, "c", "en", "s", 1), (4, "", "en", "s", 0), (5, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["blank_sheets"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(3, 2), (4, 1)}
    assert "Aggregate" not in plan(got) and "Join" not in plan(got)


@pytest.mark.parametrize(("name", "none"), [("region_stats", ("Join", "Generate")), ("ink_unruled", ("Join", "Generate", "Aggregate"))])
def test_rasters_stay_rows(spark, name, none):
    told = plan(registry.QUERIES[name](spark, SF))
    assert [n for n in none if n in told] == []


def test_tiles_of_a_size_are_labelled_together():
    one = np.array([[1, 0, 1], [1, 1, 1], [0, 0, 0]], bool)
    two = np.array([[0, 1, 0], [0, 0, 1], [0, 0, 1]], bool)
    assert T._labels(np.stack([one, two])).tolist() == [[[0, -1, 0], [0, 0, 0], [-1, -1, -1]], [[-1, 1, -1], [-1, -1, 5], [-1, -1, 5]]]


def test_pixels_of_tiles_stay_in_their_tile(spark):
    rasters = spark.createDataFrame([(1, 3, 2, [0, None, 200, 100, 0, 0]), (2, 0, 5, []), (3, 1, 1, None)], "doc_id long, width int, height int, data array<int>")
    ink = T.projection(T.tiled(rasters, 2))
    assert "pos" not in plan(ink) and {tuple(r) for r in ink.collect()} == {(1, "x", 0, 2), (1, "x", 1, 1), (1, "x", 2, 1), (1, "y", 0, 1), (1, "y", 1, 3)}


def shuffles(spark, name):
    """Shuffles where no side of a join is small enough to be sent to all tasks, and what they are of."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return [line.split("Exchange ")[1] for line in told.splitlines() if "Exchange " in line]


@pytest.mark.parametrize("name", ["layer_lines", "ocr_segments", "excel_grid"])
def test_words_of_dealt_documents_are_not_shuffled(spark, name):
    got = shuffles(spark, name)
    assert got and all(s.startswith("hashpartitioning(doc_id#") and "REPARTITION_BY_NUM" in s for s in got)


def test_words_are_dealt_by_pages_before_they_become_glyphs(spark):
    told = shuffles(spark, "glyphs_in_box")
    assert sum("page_number" in s for s in told) == 2 and sum("REPARTITION_BY_COL" in s for s in told) == 1


def test_second_readings_meet_their_lines_without_shuffled_words(spark):
    told = plan(registry.QUERIES["reread_lines"](spark, SF))
    assert [n for n in ("Join", "Aggregate", "Window", "Sort") if n in told] == []


def test_words_are_placed_in_their_texts_and_empty_lines_have_none(spark):
    texts = ["a b  c\n\n d e", "", None, " \n \n", "\n".join(f"w{i}  x ü€😀 y" for i in range(20)), "\n\nq", "x "]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = []
    for doc, text in enumerate(texts):
        on = {}
        for line_no, line in enumerate((text or "").split("\n")):
            at = 0
            for w in line.split(" "):
                if w:
                    page = line_no // 8 + 1
                    want.append((doc, page, line_no, on.get(page, 0), w, 72.0 + 6 * at))
                    on[page] = on.get(page, 0) + 1
                at += len(w) + 1
    got = [tuple(r) for r in V.items_of(documents).select("doc_id", "page_number", "line_no", "item_idx", "str", "x").collect()]
    assert sorted(got) == want
    flat = [(r.doc_id, r.page_number, r.line_no, r.first + k, w.str, 72.0 + 6 * w.at) for r in V.worded_lines_of(documents).collect() for k, w in enumerate(r.words)]
    assert sorted(flat) == want


def test_a_page_meets_as_one_row_for_its_table(spark):
    from pyspark.sql import functions as F

    from pagemill.operators import layout as L

    got = registry.QUERIES["excel_grid"](spark, SF)
    assert [n for n in ("Aggregate", "Sort", "Join") if n in plan(got)] == []
    items = V.items_of(spark.read.parquet(f"{SF}/documents.parquet"))
    same = L.table_cells(items.withColumn("y", F.col("y") - 3.5 * (F.col("item_idx") % 5)))
    assert same.exceptAll(got).isEmpty() and got.exceptAll(same).isEmpty()
    assert L._anchors(np.array([5.0, 1.0, 3.0, 3.5, 9.0, 3.0]), 2.0).tolist() == [1.0, 3.5, 9.0] and len(L._anchors(np.zeros(0), 2.0)) == 0


@pytest.mark.parametrize("name", ["font_choices", "candidate_fonts", "char_fonts"])
def test_texts_are_read_once_for_their_fonts(spark, name):
    told = plan(registry.QUERIES[name](spark, SF))
    assert told.count("ArrowEvalPython") == 1 and "Join" not in told


def test_fonts_that_can_encode_a_character(spark):
    from pagemill.operators import edits as E

    wanted = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "d"), (1, "a"), (2, "a"), (3, "x")], "page long, char string")
    drew = spark.createDataFrame([(1, "a", "F2"), (1, "b", "F3"), (1, "d", "F1"), (2, "a", "F9")], "page long, char string, font string")
    fonts = spark.createDataFrame([(1, "F1", 2, ["a", "b"]), (1, "F2", 1, ["a", "b", "c"]), (1, "F4", 0, ["d", "a"]), (2, "F9", 0, [])], "page long, font string, place int, encodable array<string>")
    got = E.chosen_fonts(wanted, drew, fonts, ["page"])
    assert sorted((r.page, r.char, r.font) for r in got.collect()) == [(1, "a", "F2"), (1, "b", "F2"), (1, "c", "F2"), (1, "d", "F4"), (2, "a", None), (3, "x", None)]


@pytest.mark.parametrize("name", ["row_neighbours", "row_room", "alone_lines"])
def test_fields_beside_lines_are_no_union(spark, name):
    """Spark 4.1 takes a union of equally dealt parts for dealt alike, and then lost rows of a page (at sf0.1 a third of row_neighbours differed)."""
    assert "Union" not in plan(registry.QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["text_regions", "tiled_projection"])
def test_rasters_of_texts_are_no_rows(spark, name):
    """A raster is as wide as its text's longest line for all of its lines, so it may be a thousand times the text."""
    told = plan(registry.QUERIES[name](spark, SF))
    assert [n for n in ("array_repeat", "flatten", "data#") if n in told] == []


def test_texts_are_drawn_a_few_tiles_at_a_time(spark):
    import pyarrow as pa

    texts = ["ab c\n\n d\U0001f600e", "", None, "\n\n", "x" * 9 + "\n" + "y z" * 40]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    draw = T.text_tiles(documents, 5, 2).draw
    got = {}
    for b in draw([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})]):
        for r in b.to_pylist():
            raster = got.setdefault(r["doc_id"], np.full((r["height"], r["width"]), -1))
            raster[r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"]] = np.array(r["data"]).reshape(r["h"], r["w"])
    want = {k: [[0 if c != " " else 255 for c in line.ljust(max(map(len, text.split("\n"))))] for line in text.split("\n") for _ in range(2)] for k, text in enumerate(texts) if (text or "").strip("\n")}
    assert {k: v.tolist() for k, v in got.items()} == want
    large = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["x" * 20_000 + "\n" * 1000]})
    sizes = [len(b.column("data").values) for b in draw([large])]
    assert sum(sizes) == 20_000 * 2002 and max(sizes) < T._PIXELS + 25
