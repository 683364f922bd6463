"""Every registered query against its SQL on the smallest tables, and those without SQL against plain loops."""

import json

import duckdb
import pytest

from pagemill import registry
from pagemill.operators import edits as E
from pagemill.operators import layout as L
from pagemill.operators import pixels as X

registry.load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLAIN = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, oracle, name):
    got = registry.QUERIES[name](spark, SF)
    want = oracle.execute(registry.ORACLES[name])
    cols = sorted(x[0] for x in want.description)
    at = [[x[0] for x in want.description].index(c) for c in cols]
    assert sorted(got.columns) == cols
    kinds = {x[0]: str(x[1]) for x in want.description}
    assert {c: kinds[c] for c, t in got.dtypes if t in PLAIN and PLAIN[t] != kinds[c]} == {}
    own = sorted(str(tuple(r[c] for c in cols)) for r in got.collect())
    assert own == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall()) and own


def test_paragraphs_of_hand_worked_pages(spark):
    row = lambda i, x, y, w, page=1, size=10.0, bold=False: (1, page, i, float(x), float(y), float(w), size, bold)
    rows = [row(0, 80, 700, 420), row(1, 60, 686, 440), row(2, 60, 672, 440), row(3, 60, 658, 200)]  # indented and justified
    rows += [row(4, 256, 600, 100)]  # a centred title
    rows += [row(0, 60, 700, 100, 2), row(1, 300, 700, 90, 2), row(2, 60, 686, 110, 2, bold=True)]  # two fields of a row, then a heavier line
    got = {(r.page_number, tuple(r.lines)): r for r in L.paragraphs(spark.createDataFrame(rows, "doc_id long, page_number long, line long, x double, y double, width double, size double, bold boolean")).collect()}
    assert set(got) == {(1, (0, 1, 2, 3)), (1, (4,)), (2, (0,)), (2, (1,)), (2, (2,))}
    body = got[1, (0, 1, 2, 3)]
    assert (body.align, body.indent, body.x, body.width, body.gap) == ("justify", 20.0, 60.0, 440.0, 14.0)
    assert got[1, (4,)].align == "center" and got[2, (1,)].align == "left"


def test_layer_lines_of_fragments(spark):
    frag = lambda i, s, x, y, w, font="A": (1, 1, i, s, float(x), float(y), float(w), font, 10.0, 0.0, float(x), float(y), 1.0)
    rows = [frag(0, "Hello", 10, 100, 30), frag(1, "wor", 43, 101, 18), frag(2, "ld", 61, 100, 12, "B"), frag(3, "ld", 61.5, 100, 12, "B"), frag(4, "far", 120, 100, 18), frag(5, "漢", 10, 80, 10), frag(6, "字", 20, 80, 10)]
    schema = "doc_id long, page_number long, item_idx long, str string, x double, y double, width double, font string, size double, angle double, along double, across double, hs double"
    got = [(r.text, r.x, r.width, r.font) for r in L.layer_lines(spark.createDataFrame(rows, schema)).orderBy("line").collect()]
    assert got == [("Hello world", 10.0, 63.0, "A"), ("far", 120.0, 18.0, "A"), ("漢字", 10.0, 20.0, "A")]


def test_lines_with_blanks_scripts_and_angles(spark):
    frag = lambda i, s, x, y, w, angle=0.0, size=10.0: (1, 1, i, s, float(x), float(y), float(w), "A", size, angle, float(x), float(y), 1.0)
    rows = [frag(0, "up", 10, 50, 12, 90.0), frag(1, "Name", 10, 100, 24), frag(2, "   ", 34, 100, 80), frag(3, "Date", 114, 100, 24), frag(4, " ", 5, 100, 3)]  # a wide blank doesn't join cells
    rows += [frag(5, "漢", 10, 80, 10), frag(6, "字", 25, 80, 10)]  # no space between ideographs
    rows += [frag(7, "a", 10, 60, 6), frag(8, "a", 10.9, 60, 6), frag(9, "a", 11.5, 60, 6)]  # both compared with the one kept
    rows += [frag(10, "wide", 100, 40, 100), frag(11, "back", 110, 40, 20)]  # far behind the line's end
    schema = "doc_id long, page_number long, item_idx long, str string, x double, y double, width double, font string, size double, angle double, along double, across double, hs double"
    got = [(r.line, r.text, r.angle) for r in L.layer_lines(spark.createDataFrame(rows, schema)).orderBy("line").collect()]
    assert got == [(0, "up", 90.0), (1, "Name", 0.0), (2, "Date", 0.0), (3, "漢字", 0.0), (4, "aa", 0.0), (5, "wide", 0.0), (6, "back", 0.0)]


def test_paragraphs_by_plain_loops(spark):
    """Every line of random pages goes where a search over all open paragraphs puts it."""
    import random

    rng = random.Random(5)
    rows = []
    for page in range(30):
        y = 700.0
        for k in range(14):
            size = rng.choice([10.0, 10.0, 10.0, 11.0, 16.0])
            rows.append((1, page, k, rng.choice([60.0, 60.0, 66.0, 80.0, 300.0]), y, rng.choice([200.0, 240.0, 60.0]), size, rng.random() < 0.1, rng.choice(["layer"] * 9 + ["ocr"]), 5.0 if rng.random() < 0.05 else 0.0))
            y -= rng.choice([0.0, 12.0, 12.0, 14.0, 30.0])

    def fits(own, gap, r):
        a, em = own[-1], r["size"]
        d = a["y"] - r["y"]
        body = a["x"] if len(own) == 1 else min(o["x"] for o in own[1:])
        left = abs(r["x"] - body) <= 1.5 * em or (len(own) == 1 and abs(r["x"] - a["x"]) <= 3 * em and r["x"] <= a["x"] + 0.2 * em)
        side = abs(r["x"] + r["end"] - a["x"] - a["end"]) <= 2 * em or abs(r["end"] - a["end"]) <= em
        ended = len(own) > 1 and not side and a["end"] - body < 0.6 * (max(o["end"] for o in own) - body)
        alike = a["bold"] == r["bold"] and a["origin"] == r["origin"] and abs(a["size"] - em) <= 0.12 * max(a["size"], em)
        return alike and 0.9 * em <= d <= 2.3 * em and (len(own) == 1 or abs(d - gap) <= 0.2 * em) and min(a["end"], r["end"]) > max(a["x"], r["x"]) and (left or side) and not ended

    names = ["doc_id", "page_number", "line", "x", "y", "width", "size", "bold", "origin", "angle"]
    want = set()
    for page in range(30):
        lines = [dict(zip(names, r, strict=True)) | {"end": r[3] + r[5]} for r in rows if r[1] == page]
        drafts = [[o] for o in lines if o["angle"]]
        for r in sorted((o for o in lines if not o["angle"]), key=lambda o: (-o["y"], o["x"], o["line"])):
            near = [(d[-1]["y"] - r["y"], k) for k, d in enumerate(drafts) if not d[0]["angle"] and fits(d, d[0]["y"] - d[1]["y"] if len(d) > 1 else 0, r)]
            if near:
                drafts[min(near)[1]].append(r)
            else:
                drafts.append([r])
        want |= {(page, tuple(o["line"] for o in d)) for d in drafts}
    df = spark.createDataFrame(rows, "doc_id long, page_number long, line long, x double, y double, width double, size double, bold boolean, origin string, angle double")
    got = L.paragraphs(df).collect()
    assert {(r.page_number, tuple(r.lines)) for r in got} == want and len(got) == len(want)
    assert {r.align for r in got} >= {"left", "justify"}


def test_objects_of_two_files(spark):
    from pagemill.operators import objects as O

    schema = "doc_id long, ref string, obj_no long, subtype string, type string, smask_ref string, mask_ref string, contents_ref string, last_filter string, size_bytes long, is_stream boolean"
    rows = [(1, "1 0 R", 1, "Image", None, "2 0 R", None, None, None, 10, True), (1, "2 0 R", 2, "Image", None, None, None, None, None, 20, True), (2, "2 0 R", 2, "Image", None, None, None, None, None, 30, True)]
    rows += [(1, "3 0 R", 3, None, "Sig", None, None, "4 0 R", None, 5, False), (1, "4 0 R", 4, None, None, None, None, None, None, 7, True), (2, "4 0 R", 4, None, None, None, None, None, None, 50, True), (2, "5 0 R", 5, None, "Font", None, None, None, None, 9, False)]
    o = spark.createDataFrame(rows, schema)
    assert sorted((r.doc_id, r.obj_no) for r in O.image_candidates(o).collect()) == [(1, 1), (2, 2)]
    assert [(r.doc_id, r.obj_no) for r in O.signature_contents(o).collect()] == [(1, 4)]
    b = {r.doc_id: r for r in O.breakdown(o).collect()}
    assert (b[1].signature, b[1].content, b[1].signatures) == (12, 0, 1) and (b[2].content, b[2].signature, b[2].fonts, b[2].other) == (50, 0, 1, 9)


def test_fonts_of_two_files(spark):
    from pagemill.operators import fonts as O

    wanted = spark.createDataFrame([(1, 1, "A", "xyz"), (2, 2, "A", "xyz")], "doc_id long, id long, font string, chars string")
    there = spark.createDataFrame([(1, "1 0 R", "A", ["x"], 0), (2, "1 0 R", "A", ["x", "y"], 0), (2, "2 0 R", "ABCDEF+A", ["x", "y", "z"], 1)], "doc_id long, ref string, name string, encodable array<string>, place int")
    assert sorted(tuple(r) for r in O.resolved(wanted, there).collect()) == [(1, 1, "1 0 R", 1.5), (2, 2, "2 0 R", 3.0)]


def test_anchors_are_not_gaps(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([100.0, 99.0, 97.0, 96.0, 90.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(L.fold_anchors(F.col("v"), F.lit(2.0))).collect()] == [[100.0, 97.0, 90.0], []]


def test_replay(spark):
    log = [("set", "a"), ("set", "b"), ("set", "b"), ("undo", ""), ("redo", ""), ("undo", ""), ("set", "c"), ("redo", ""), ("undo", ""), ("undo", ""), ("undo", "")]
    rows = [(1, i, *x) for i, x in enumerate(log)] + [(2, 0, "set", "x"), (2, 1, "reset", "y"), (2, 2, "undo", "")]
    got = {r.session: (r.value, r.undo, r.redo) for r in E.replay(spark.createDataFrame(rows, "session long, seq int, action string, value string")).collect()}
    assert got == {1: ("", 0, 2), 2: ("y", 0, 0)}


def test_typesetting(spark):
    from pyspark.sql import functions as F

    def lines(text, width, **kw):
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        return [r.text for r in E.typeset_lines(df, width, **kw).orderBy("line").collect()]

    assert lines("one two three", 42.0) == ["one two", "three"]
    assert lines("abcdefghij x\n\nend ", 24.0) == ["abcd", "efgh", "ij x", "", "end"]
    assert lines("a abcdefghij", 24.0) == ["a", "abcdefghij"]  # only a word that starts a line is cut
    assert lines("漢字漢字漢", 12.0) == ["漢字", "漢字", "漢"]
    assert lines("abcdefgh", 24.0, indent=12.0) == ["ab", "cdef", "gh"]
    for line in lines("the quick brown fox jumps over the lazy dog " * 5, 100.0):
        assert 6 * len(line) <= 100
    rows = E.typeset_lines(spark.createDataFrame([(1, "aa bb cc dd"), (2, None), (3, "")], "doc_id long, text string"), 50.0, align="center").collect()
    assert sorted((r.doc_id, r.text, r.x, r.width) for r in rows) == [(1, "aa bb cc", 1.0, 48.0), (1, "dd", 19.0, 12.0), (3, "", 25.0, 0.0)]
    scale = spark.createDataFrame([("abcdefghij",), ("abc",), ("x" * 100,)], "t string").select(E.condensed(F.col("t"), F.lit(54.0), 6.0)).collect()
    assert [r[0] for r in scale] == [0.9, 1.0, 0.8]


def test_change_plans(spark):
    from pyspark.sql import functions as F

    def plan(old, new, right, push=0.0, glyphs=None):
        glyphs = [(c, 10.0 + 6 * i, 6.0) for i, c in enumerate(old)] if glyphs is None else glyphs
        df = spark.createDataFrame([(glyphs, old, new)], "g array<struct<c:string,x:double,w:double>>, old string, new string")
        got = df.select(E.line_plan(F.col("g"), F.col("old"), F.col("new"), lambda t: 6.0 * F.char_length(t), F.lit(right), push).alias("p")).first().p
        return got and got.asDict()

    old = "Total: 100 EUR"
    assert plan(old, "Total: 100  EUR", 200.0)["noop"]
    p = plan(old, "Total: 2500 EUR", 200.0)
    assert (p["middle"], p["start"], p["delta"], p["squeeze"], p["push"], p["tail"]) == ("25", 52.0, 6.0, 1.0, 0.0, list("00 EUR"))
    assert (p["gone_x"], p["gone_w"]) == (52.9, pytest.approx(93.1 - 52.9))
    assert plan(old, "Total: 25000000 EUR", 110.0)["squeeze"] == 0.75
    pushed = plan(old, "Total: 2500 EUR", 97.0, 10.0)
    assert (pushed["squeeze"], pushed["push"]) == (1.0, 3.0)
    assert plan("", "x", 10.0) is None
    assert plan("ab", "x", 10.0, glyphs=[("q", 0.0, 6.0)]) is None  # the glyphs say something else
    assert plan("ab", "a b", 99.0) is None  # nothing but spacing changed
    end = plan(old, "Total: 100 USD", 200.0)
    assert end["middle"].strip() == "USD" and end["delta"] == 0.0 and end["tail"] == []
    gone = plan("one two three", "one three", 200.0)
    assert (gone["middle"].strip(), gone["delta"]) == ("", -24.0)


def test_predictors():
    rows = [[10, 20, 30, 40], [11, 22, 33, 44], [5, 6, 7, 8], [200, 100, 50, 25], [9, 9, 9, 9]]
    out, before = b"", [0] * 4
    for kind, row in enumerate(rows):
        coded = []
        for x, v in enumerate(row):
            left, up, corner = (row[x - 1] if x else 0), before[x], (before[x - 1] if x else 0)
            p = left + up - corner
            paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            coded.append((v - [0, left, up, (left + up) // 2, paeth][kind]) % 256)
        out += bytes([kind, *coded])
        before = row
    assert X.unfilter(out, 4, 5, 1) == bytes(v for r in rows for v in r)
    assert X.unfilter(out[:4], 4, 2, 1) == b""


def test_regions_and_strokes(spark):
    from pyspark.sql import functions as F

    white, ink = 0xFFFFFF, 0x0A0A0A
    data = [ink if 15 <= y < 20 and 20 <= x < 30 else white - 0x050505 for y in range(40) for x in range(60)]
    images = spark.createDataFrame([(1, 60, 40, data)], "doc_id long, wide int, high int, data array<int>")
    boxes = spark.createDataFrame([(1, 0, 18.0, 13.0, 14.0, 9.0, 3), (1, 1, 0.0, 0.0, 60.0, 40.0, 3), (1, 2, 90.0, 0.0, 5.0, 5.0, 3)], "doc_id long, key int, left double, top double, width double, height double, pad int")
    got = {r.key: r for r in X.regions(images, boxes).collect()}
    assert (got[0].ground, got[0].spread, got[0].ink, got[0].ink_share) == ([255] * 3, 0.0, [0] * 3, 50 / 126)
    assert got[1].ground == [255] * 3 and got[1].ink_share == 50 / 2400  # no ring: white
    assert (got[2].ink, got[2].ink_share) == (None, 0.0)
    mask = [3 < y < 6 and 4 <= x < 34 for y in range(10) for x in range(38)]
    ruled = [y == 2 or x == 3 or (y, x) == (5, 5) for y in range(10) for x in range(8)]
    m = spark.createDataFrame([(1, 38, mask), (2, 8, ruled), (3, 1, [True, True])], "doc_id long, wide int, mask array<boolean>")
    assert {r.doc_id: r.stroke for r in X.stroke_width(m).collect()}[1] == 2 * 60 / 64
    left = {r.doc_id: r.n for r in X.unruled(m).select("doc_id", F.size(F.filter("mask", lambda v: v)).alias("n")).collect()}
    assert left == {1: 0, 2: 1, 3: 0}


def test_inpainting():
    import numpy as np

    flat = np.full((40, 60, 3), 250, np.uint8)
    flat[15:20, 20:30] = 0
    stats = {"bg": [255.0] * 3, "spread": 0.0}
    patch = X.inpaint(flat, 18, 13, 14, 9, stats)
    assert patch["uniform"] and patch["pixels"].shape == (9, 14, 3) and (patch["pixels"] == 250).all()
    ramp = np.repeat(np.arange(60)[None, :, None] * 4, 40, 0).repeat(3, 2).astype(np.uint8)
    px = X.inpaint(ramp, 20, 10, 10, 10, {"bg": [98.0] * 3, "spread": 60.0})["pixels"].astype(int)
    assert abs(px[5, :, 0] - np.arange(20, 30) * 4).max() <= 12
    assert X.inpaint(flat, 0, 0, 60, 40, {"bg": [1.0, 2.0, 3.0], "spread": 0.0})["color"] == [1.0, 2.0, 3.0]


def test_office_files(spark, tmp_path):
    import io
    import zipfile

    from pagemill.sources import sinks

    word = sinks.docx_bytes([("title", "T"), ("break", ""), ("page", "Page 2"), ("heading", "<H>"), ("bold", "b"), ("body", "x & y")])
    assert "x &amp; y" in zipfile.ZipFile(io.BytesIO(word)).read("word/document.xml").decode()
    cells = spark.createDataFrame([(1, 1, 0, 0, "a"), (1, 1, 1, 2, "b"), (1, 3, 0, 0, "c")], "doc_id long, page_number long, row long, col long, value string")
    book = zipfile.ZipFile(io.BytesIO(sinks.xlsx_files(cells).first().content))
    assert 'name="_About" sheetId="3"' in book.read("xl/workbook.xml").decode() and len([n for n in book.namelist() if "sheets/" in n]) == 3
    files = spark.createDataFrame([("z", "b.txt", b"2"), ("z", "a.txt", b"1")], "archive string, name string, content binary")
    z = zipfile.ZipFile(io.BytesIO(sinks.zip_files(files).first().content))
    assert z.namelist() == ["a.txt", "b.txt"] and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    assert json.dumps(z.read("b.txt").decode()) == '"2"'


def test_edit_steps_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from pagemill.streaming import sessions

    rows = [(1, 1, "a", 0), (1, 2, "a", 500), (1, 3, "a", 5000), (1, 4, "b", 5100), (2, 5, "a", 100), (9, 6, "z", 90_000_000)]
    src = spark.createDataFrame(rows, "session long, event_id long, k string, at_ms long").withColumn("at", F.timestamp_millis(F.col("at_ms") + 10_000)).drop("at_ms").coalesce(1)
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")).withWatermark("at", "1 second")
    q = sessions.edit_steps(stream, 1200).writeStream.format("memory").queryName("steps").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.session, r.k, r.started_ms, r.changes) for r in spark.table("steps").collect())
    assert got[:2] == [(1, "a", 10_000, 2), (1, "a", 15_000, 1)]


def test_lines_and_their_changes_need_no_shuffle(spark):
    """Lines are told inside their document's row, and what changed in them is found by comparing pieces (F10, F13, F27)."""
    from pyspark.sql import functions as F

    for name in ("line_diff", "line_change_plan"):
        assert "Aggregate" not in registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString(), name
    rows = [("", ""), ("", "x"), ("same", "same"), ("a  b\tc", "ab c"), ("abcabc", "abcxabc"), ("aaaa", "aa"), ("é漢😀 z", "é漢😀😀 z"), ("x" * 1000 + "y", "x" * 1000 + "z"), ("  lead", "lead tail ")]

    def kept(a, b):
        a, b = "".join(a.split()), "".join(b.split())
        most = min(len(a), len(b))
        p = next((i for i in range(most) if a[i] != b[i]), most)
        s = next((i for i in range(most - p) if a[len(a) - 1 - i] != b[len(b) - 1 - i]), most - p)
        return p, s, len(a) - p - s, b[p : len(b) - s]

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i long, a string, b string")
    got = df.select("i", E.change(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()
    assert [(r.c.prefix, r.c.suffix, r.c.removed, r.c.middle) for r in got] == [kept(a, b) for a, b in rows]


def test_plan_of_glyphs_of_several_characters(spark):
    """A ligature drawn as one glyph spells two letters, but is none of the new text's."""
    from pyspark.sql import functions as F

    glyph = lambda c, i: (c, 6.0 * i, 6.0)
    line = [glyph(c, i) for i, c in enumerate(["o", "fi", "  ", "z"])]
    df = spark.createDataFrame([(line, "ofi z", "ofi y")], "g array<struct<c:string,x:double,w:double>>, old string, new string")
    p = df.select(E.line_plan(F.col("g"), F.col("old"), F.col("new"), lambda t: 6.0 * F.char_length(t), F.lit(1000.0)).alias("p")).first().p
    assert (p.noop, p.kept_before, p.kept_after, p.middle, p.start) == (False, 1, 0, "fi y", 6.0)


def test_worded_lines_need_no_shuffle(spark):
    """Lines and their words are told inside their document's row (F12)."""
    assert "Aggregate" not in registry.QUERIES["words_text"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_widths_of_texts_without_a_row_for_each_character(spark):
    """A text stays one row (F21); widths of other files and of several characters count for nothing, characters without one take the default."""
    from pagemill.operators import fonts as O

    plan = registry.QUERIES["text_width"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(split(" not in plan.replace("posexplode", "")
    texts = spark.createDataFrame([(1, 0, "F", "aéa b", 10.0), (1, 1, "F", "", 10.0), (2, 0, "F", "aa", 12.0), (3, 0, "G", "ab", 1.0), (3, 0, "H", "b", 1.0)], "doc_id long, line long, font string, text string, size double")
    widths = spark.createDataFrame([(1, "F", "a", 500), (1, "F", "é", None), (1, "F", " b", 7), (2, "F", "a", 250), (3, "H", "b", 2000)], "doc_id long, font string, char string, width int")
    got = {(r.doc_id, r.line): r.width for r in O.text_width(texts, widths, ["doc_id", "line"]).collect()}
    assert got == {(1, 0): 40.0, (2, 0): 6.0, (3, 0): 4.0}


def test_nearest_glyph_by_words(spark):
    """Each word is one row, not one for each of its glyphs (F22)."""
    plan = registry.QUERIES["nearest_glyph_color"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 2


def test_decoded_images_by_small_batches(spark):
    """However many images a batch brings, few are held and handed on at once (F11)."""
    import zlib

    raw = zlib.compress(bytes(range(4)))
    images = spark.range(600).coalesce(1).selectExpr("id AS doc_id", "4 AS width", "1 AS height", "1 AS channels", "1 AS predictor").withColumn("content", _lit(raw))
    seen = X.decoded(images).mapInArrow(lambda bs: bs, "doc_id long, width int, height int, data array<int>")
    rows = seen.collect()
    assert len(rows) == 600 and all(list(r["data"]) == [0, 1, 2, 3] for r in rows)
    assert X.IMAGES < 600


def test_images_are_unfiltered_together():
    """Images of one width share the steps of their diagonals; each gets what it would get alone (F13)."""
    import random

    rnd = random.Random(13)
    images = [(bytes(v for _ in range(h) for v in (rnd.randrange(6), *(rnd.randrange(256) for _ in range(w * c)))), w, h, c) for w, h, c in ((4, 5, 1), (4, 1, 1), (4, 9, 1), (2, 3, 3), (4, 2, 3), (1, 1, 1))]
    images += [(images[2][0][:44], 4, 9, 1), (images[2][0][:20], 4, 9, 1), (b"", 4, 9, 1)]

    def alone(raw, w, h, c):
        n, rows, above = w * c, [], [0] * (w * c)
        if len(raw) <= (h - 1) * (n + 1):
            return b""
        raw = raw.ljust(h * (n + 1), b"\0")
        for y in range(h):
            kind, own = raw[y * (n + 1)], []
            for i, v in enumerate(raw[y * (n + 1) + 1 : (y + 1) * (n + 1)]):
                a, b, k = own[i - c] if i >= c else 0, above[i], above[i - c] if i >= c else 0
                near = min((abs(b - k), 0, a), (abs(a - k), 1, b), (abs(a + b - 2 * k), 2, k))[2]
                own.append((v + {1: a, 2: b, 3: (a + b) // 2, 4: near}.get(kind, 0)) % 256)
            rows += own
            above = own
        return bytes(rows)

    assert X.unfiltered(images) == [alone(*i) for i in images]


def _lit(b):
    from pyspark.sql import functions as F

    return F.lit(bytearray(b))
