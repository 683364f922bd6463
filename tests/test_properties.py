"""Laws that hold for any input, and the edge cases of selections, names and sizes."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import text as T
from pagemill.operators import edits as E
from pagemill.operators import objects as O
from pagemill.operators import pages as P
from pagemill.operators import pixels as X
from pagemill.operators import spatial as S
from pagemill.sources import views as V


def pages_by_hand(said, total):
    said = said.strip()
    if not said:
        return list(range(1, total + 1))
    out = set()
    for part in filter(None, (p.strip() for p in said.split(","))):
        ends = [e.strip() for e in part.split("-")]
        if len(ends) > 2 or not all(e.isdigit() and 1 <= int(e) <= total for e in ends):
            return None
        out |= set(range(min(map(int, ends)), max(map(int, ends)) + 1))
    return sorted(out)


def test_selections(spark):
    cases = [(s, n) for s in ("", ",", "5", "1-3, 5", "9-7", "0", "3-99", "a", "1 - 2", "-", "1-", "1-2-3", "2,2", " 7 ", "999999999999") for n in (0, 1, 5, 10)]
    rows = spark.createDataFrame(cases, "said string, total int").select("said", "total", T.page_range(F.col("said"), F.col("total")).alias("p")).collect()
    assert {(r.said, r.total): r.p for r in rows} == {c: pages_by_hand(*c) for c in cases}


def test_split_then_merge_is_identity(spark):
    files = spark.createDataFrame([(1, 7, "a"), (2, 1, "b"), (3, 0, "c")], "doc_id long, total int, name string")
    parts = P.split_every(files, 3)
    assert sorted((r.doc_id, r.part, r.page_number) for r in parts.collect()) == [(1, 1, 1), (1, 1, 2), (1, 1, 3), (1, 2, 4), (1, 2, 5), (1, 2, 6), (1, 3, 7), (2, 1, 1)]
    back = P.merge(parts.withColumn("merged", F.col("doc_id")), ordinal="part")
    assert all(r.new_page == r.page_number for r in back.collect())


def test_four_turns_and_permutations(spark):
    pages = spark.createDataFrame([(1, k, 90 * (k % 4)) for k in range(1, 6)], "doc_id long, page_number long, angle int")
    turned = pages
    for _ in range(4):
        turned = P.rotate(turned, 90)
    assert sorted(turned.collect()) == sorted(pages.collect())
    orders = spark.createDataFrame([(1, [5, 4, 3, 2, 1, 5, 9])], "doc_id long, new_order array<long>")
    got = sorted((r.new_page, r.page_number) for r in P.reorder(pages, orders).collect())
    assert got == [(1, 5), (2, 4), (3, 3), (4, 2), (5, 1), (6, 5)]


def test_breakdown_adds_up(spark):
    rows = [(1, "1 0 R", 1, "Image", None, "2 0 R", None, None, "DCTDecode", 10), (1, "2 0 R", 2, "Image", None, None, None, None, "FlateDecode", 20), (1, "3 0 R", 3, None, "Sig", None, None, "4 0 R", None, 5), (1, "4 0 R", 4, None, None, None, None, None, None, 7), (1, "5 0 R", 5, "Form", "XObject", None, None, None, None, 9)]
    o = spark.createDataFrame(rows, "doc_id long, ref string, obj_no long, subtype string, type string, smask_ref string, mask_ref string, contents_ref string, last_filter string, size_bytes long")
    b = O.breakdown(o).first()
    assert (b.total, b.image, b.font, b.signature, b.content, b.metadata, b.other) == (51, 30, 0, 12, 0, 0, 9)
    assert sum(r.share for r in O.shares(O.breakdown(o)).collect()) == pytest.approx(1)
    assert [r.obj_no for r in O.image_candidates(o).collect()] == [1]
    assert O.breakdown(o.limit(0)).count() == 0


def test_replaced_text_is_found_no_more(spark):
    lines = spark.createDataFrame([(1, 1, "L1", "A (b) a.b"), (1, 1, "L2", "x"), (1, 2, "L3", "A.B")], "doc_id long, page_number long, line_id string, text string")
    edits = spark.createDataFrame([(1, 1, "E1", ["L2"], "new a.b A.b")], "doc_id long, page_number long, edit_id string, line_ids array<string>, text string")
    found = {(r.target, r.hits) for r in E.find(lines, edits, "a.b").collect()}
    assert found == {("L1", 1), ("L3", 1), ("E1", 2)}
    new = E.replace_all(lines, edits, "a.b", "$0\\")
    assert {r.text for r in new.collect()} == {"A (b) $0\\", "$0\\", "new $0\\ $0\\"}
    assert E.find(new.select("doc_id", "page_number", F.col("target").alias("line_id"), "text"), edits.limit(0), "a.b").count() == 0
    assert E.find(lines, edits, "").count() == 0 and E.find(lines, edits, "a.b", True).count() == 2


def test_sizes_names_and_boxes(spark):
    n = [0, 1023, 1024, 1536, 1048575, 1048576, 1073741824]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in n], "n long").select(T.format_bytes(F.col("n"))).collect()]
    assert got == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1024.0 KB", "1.0 MB", "1.00 GB"]
    one = spark.range(1)
    name = T.build_filename(F.lit("{name}_{n}.{N}/{total}"), F.lit("a"), F.lit(1234), F.lit(999), "png")
    assert one.select(name).first()[0] == "a_1234.1234/999.png"
    for turn in (0, 90, 180, 270, -90):
        v = G.viewport(*(F.lit(float(x)) for x in (10, 20, 110, 220)), F.lit(turn), F.lit(1.5))
        box = G.mapped_box(F.col("m"), *(F.lit(float(x)) for x in (30, 40, 50, 60)))
        r = one.select(v["m"].alias("m"), v["width"].alias("w")).withColumn("b", box).select("w", "b", G.mapped_box(G.inverted(F.col("m")), *(F.col(f"b.{c}") for c in ("left", "top", "width", "height"))).alias("back")).first()
        assert tuple(r.back) == pytest.approx((30, 40, 50, 60)) and r.w == (150 if turn % 180 == 0 else 300)
    assert one.select(G.hex_rgb(F.lit("#1af"))).first()[0] == [17, 170, 255]


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.integers(1, 4), st.integers(1, 3))
def test_unfiltering_never_fails(raw, width, channels):
    n = width * channels + 1
    out = X.unfilter(raw, width, 3, channels)
    assert len(out) in (0, 3 * (n - 1))


def words(alphabet, most, n, seed):
    rng = random.Random(seed)
    return ["", alphabet * 3] + ["".join(rng.choices(alphabet, k=rng.randrange(most + 1))) for _ in range(n)]


@pytest.mark.parametrize("width", [6, 13, 30, 60])
def test_typeset_lines_fit_and_lose_nothing(spark, width):
    said = words("ab \n漢", 80, 150, width)
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    lines = {}
    for r in E.typeset_lines(df, float(width)).orderBy("doc_id", "line").collect():
        lines.setdefault(r.doc_id, []).append(r.text)
    for k, text in enumerate(said):
        assert "".join("".join(lines[k]).split()) == "".join(text.split())
        # Only a word that comes after others is wider than a line.
        assert all(6 * len(x) <= width or " " not in x for x in lines[k])


def test_change_plans_rebuild_the_text(spark):
    pairs = list(zip(words("abc ", 20, 300, 1), words("abc ", 20, 300, 2), strict=True)) + [("a b c", "a  b c"), ("ab", "a b")]
    glyphs = F.transform(E.chars(F.col("old")), lambda c, i: F.struct(c.alias("c"), (6.0 * i).alias("x"), F.lit(6.0).alias("w")))
    df = spark.createDataFrame(pairs, "old string, new string").withColumn("g", glyphs)
    plan = E.line_plan(F.col("g"), F.col("old"), F.col("new"), lambda t: 6.0 * F.char_length(t), F.lit(1000.0))
    for r in df.withColumn("p", plan).collect():
        old, new, p = r.old, r.new, r.p
        if p is None or p.noop:
            assert "".join(old.split()) == "".join(new.split()) or not old.split()
            continue
        ink = [c for c in old if c != " "]
        kept = ink[: p.kept_before] + [c for c in p.middle if c != " "] + ink[len(ink) - p.kept_after :]
        assert "".join(kept) == "".join(new.split())


def test_pages_count_their_items(spark):
    docs = spark.createDataFrame([(0, "a  b\n\n c" + "\n" * 5 + "\nd"), (1, ""), (2, None), (3, " \nx")], "doc_id long, text string")
    got = {(r.doc_id, r.page_number): r.n for r in V.counted_pages_of(docs).collect()}
    assert got == {(0, 1): 3, (0, 2): 1, (0, 3): 0, (1, 1): 0, (3, 1): 1, (3, 2): 0}


def test_removed_glyphs_are_joined_once(spark):
    schema = "doc_id long, page_number long, item_idx long, p long, x double, y double, w double, size double"
    glyphs = spark.createDataFrame([(d, p, 0, k, 6.0 * k, 10.0, 6.0, 0.0) for d in (1, 2) for p in (1, 2) for k in range(4)], schema)
    rects = spark.createDataFrame([(1, 1, 5.0, 9.0, 11.0, 2.0), (1, 1, 5.0, 9.0, 11.0, 2.0), (1, 1, 20.0, 50.0, 9.0, 9.0), (2, 2, 0.0, 0.0, 99.0, 99.0)], "doc_id long, page_number long, x double, y double, w double, h double")
    left = S.removed(glyphs, rects)
    got = sorted((r.doc_id, r.page_number, r.p) for r in left.collect())
    assert got == [(1, 1, 0), (1, 1, 3)] + [(d, p, k) for d, p in ((1, 2), (2, 1)) for k in range(4)]
    assert left._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
