"""Queries on page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import layout as L
from ..registry import query
from ..sources import sinks
from ..sources import views as V

LINES = V.ITEMS + """,
lines AS (SELECT doc_id, page_number, CAST(floor(y + 0.5) AS BIGINT) AS yk, string_agg(str, ' ' ORDER BY item_idx) AS text, min(item_idx) AS first_idx, max(font_size) AS size
  FROM text_items GROUP BY doc_id, page_number, floor(y + 0.5)),
medians AS (SELECT doc_id, page_number, list_sort(list(font_size))[CAST(count(*) // 2 + 1 AS BIGINT)] AS median FROM text_items WHERE font_size > 0 GROUP BY doc_id, page_number)"""
KIND = "CASE WHEN size >= median * 1.6 THEN 'heading' WHEN size >= median * 1.3 THEN 'bold' ELSE 'body' END"


@query(f"WITH {LINES} SELECT doc_id, page_number, yk, text FROM lines")
def line_text(spark: SparkSession, d: str) -> DataFrame:
    return L.line_text(V.items(spark, d)).select("doc_id", "page_number", "yk", "text")


@query(f"WITH {LINES} SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY yk DESC) AS text FROM lines GROUP BY doc_id, page_number")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return sinks.page_text(V.items(spark, d))


@query(f"""WITH {LINES}, texts AS (SELECT doc_id, page_number, trim(string_agg(text, chr(10) ORDER BY yk DESC)) AS text FROM lines GROUP BY doc_id, page_number)
SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS text FROM texts WHERE text <> '' GROUP BY doc_id""")
def doc_plain_text(spark: SparkSession, d: str) -> DataFrame:
    return sinks.plain_text(sinks.page_text(V.items(spark, d)))


@query(f"WITH {LINES} SELECT doc_id, page_number, median FROM medians")
def upper_median_font(spark: SparkSession, d: str) -> DataFrame:
    return L.upper_median(V.items(spark, d))


@query(f"WITH {LINES} SELECT doc_id, page_number, trim(text) AS text, arg_max(size, first_idx) AS size FROM lines GROUP BY doc_id, page_number, trim(text)")
def line_max_size(spark: SparkSession, d: str) -> DataFrame:
    return L.by_text(L.line_text(V.items(spark, d)))


@query(f"WITH {LINES} SELECT doc_id, page_number, {KIND} AS kind, count(*) AS n FROM lines JOIN medians USING (doc_id, page_number) GROUP BY ALL")
def heading_class(spark: SparkSession, d: str) -> DataFrame:
    lines = L.page_lines(V.items(spark, d))
    return lines.groupBy("doc_id", "page_number", L.heading(F.col("size"), F.col("median")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


MARKDOWN = LINES + f""",
sized AS (SELECT doc_id, page_number, trim(text) AS text, yk, first_value(size) OVER (PARTITION BY doc_id, page_number, trim(text) ORDER BY first_idx DESC) AS size FROM lines WHERE trim(text) <> ''),
md AS (SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY yk DESC) AS seq,
  CASE {KIND} WHEN 'heading' THEN '### ' || text WHEN 'bold' THEN '**' || text || '**' ELSE text END AS md FROM sized JOIN medians USING (doc_id, page_number))"""


@query(f"WITH {MARKDOWN} SELECT * FROM md")
def markdown_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.markdown(V.items(spark, d))


@query(f"""WITH {MARKDOWN}, {V.SHEETS}, lines_md AS (SELECT doc_id, page_number, string_agg(md || chr(10) || chr(10), '' ORDER BY seq) AS md FROM md GROUP BY doc_id, page_number),
pages_md AS (SELECT doc_id, page_number, '## Page ' || page_number || chr(10) || chr(10) || coalesce(md, '_(empty)_' || chr(10) || chr(10)) AS md FROM all_pages LEFT JOIN lines_md USING (doc_id, page_number))
SELECT doc_id, '# doc' || doc_id || chr(10) || chr(10) || string_agg(md, '' ORDER BY page_number) AS md FROM pages_md GROUP BY doc_id""")
def markdown_docs(spark: SparkSession, d: str) -> DataFrame:
    return sinks.markdown_docs(L.markdown(V.items(spark, d)), V.pages_of(V.read(spark, d, "documents")))


@query(f"WITH {V.ITEMS}, {V.SHEETS} SELECT doc_id, page_number FROM all_pages WHERE (doc_id, page_number) NOT IN (SELECT (doc_id, page_number) FROM text_items)")
def blank_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Sheets of pages without items, told from the number of items of each page: a page that reads `(empty page)` isn't one."""
    return sinks.blank_sheets(V.counted_pages_of(V.read(spark, d, "documents")))


@query(f"""WITH {LINES}, {V.SHEETS}, body AS (SELECT doc_id, page_number, yk, {KIND} AS kind, trim(text) AS text FROM lines JOIN medians USING (doc_id, page_number) WHERE trim(text) <> ''),
parts AS (SELECT doc_id, 0 AS page_number, 0 AS place, 0 AS down, 'title' AS kind, 'doc' || doc_id AS text FROM all_pages GROUP BY doc_id
  UNION ALL SELECT doc_id, page_number, 1, 0, 'break', '' FROM all_pages WHERE page_number > 1
  UNION ALL SELECT doc_id, page_number, 2, 0, 'page', 'Page ' || page_number FROM all_pages
  UNION ALL SELECT doc_id, page_number, 3, -yk, kind, text FROM body)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, place, down) AS seq, kind, text FROM parts""")
def docx_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return sinks.docx_paragraphs(L.page_lines(V.items(spark, d)), V.pages_of(V.read(spark, d, "documents")))


@query(f"WITH {V.SHEETS} SELECT doc_id, count(*) AS pages FROM all_pages GROUP BY doc_id")
def page_count(spark: SparkSession, d: str) -> DataFrame:
    return V.pages_of(V.read(spark, d, "documents")).groupBy("doc_id").agg(F.count_distinct("page_number").alias("pages"))


GRID = LINES + """,
drifting AS (SELECT * REPLACE (y - 3.5 * (item_idx % 5) AS y) FROM text_items),
ys AS (SELECT DISTINCT doc_id, page_number, y FROM drifting),
table_rows AS (
  SELECT doc_id, page_number, max(y) AS anchor, greatest(2, any_value(median) * 0.5) AS tol, 0 AS row FROM ys JOIN medians USING (doc_id, page_number) GROUP BY doc_id, page_number
  UNION ALL
  SELECT r.doc_id, r.page_number, (SELECT max(y) FROM ys WHERE ys.doc_id = r.doc_id AND ys.page_number = r.page_number AND ys.y < r.anchor - r.tol) AS anchor, r.tol, r.row + 1
  FROM table_rows r WHERE EXISTS (SELECT 1 FROM ys WHERE ys.doc_id = r.doc_id AND ys.page_number = r.page_number AND ys.y < r.anchor - r.tol)),
xs AS (SELECT DISTINCT doc_id, page_number, x FROM text_items),
table_cols AS (
  SELECT doc_id, page_number, min(x) AS anchor, greatest(8, any_value(median) * 1.5) AS tol, 0 AS col FROM xs JOIN medians USING (doc_id, page_number) GROUP BY doc_id, page_number
  UNION ALL
  SELECT c.doc_id, c.page_number, (SELECT min(x) FROM xs WHERE xs.doc_id = c.doc_id AND xs.page_number = c.page_number AND xs.x > c.anchor + c.tol) AS anchor, c.tol, c.col + 1
  FROM table_cols c WHERE EXISTS (SELECT 1 FROM xs WHERE xs.doc_id = c.doc_id AND xs.page_number = c.page_number AND xs.x > c.anchor + c.tol))"""


def _drifting(spark: SparkSession, d: str) -> DataFrame:
    """Words whose heights drift within a row and on to the next, so that a row's anchor is told from the row above."""
    return V.items(spark, d).withColumn("y", F.col("y") - 3.5 * (F.col("item_idx") % 5))


@query(f"WITH RECURSIVE {GRID} SELECT doc_id, page_number, CAST(row AS BIGINT) AS row, anchor FROM table_rows")
def excel_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = L.table_rows(_drifting(spark, d)).select("doc_id", "page_number", F.posexplode("rows").alias("row", "anchor"))
    return rows.withColumn("row", F.col("row").cast("long"))


@query(f"WITH RECURSIVE {GRID} SELECT doc_id, page_number, CAST(col AS BIGINT) AS col, anchor FROM table_cols")
def excel_cols(spark: SparkSession, d: str) -> DataFrame:
    cols = L.table_rows(V.items(spark, d)).select("doc_id", "page_number", F.posexplode("cols").alias("col", "anchor"))
    return cols.withColumn("col", F.col("col").cast("long"))


@query(f"""WITH RECURSIVE {GRID},
in_row AS (SELECT i.doc_id, i.page_number, i.item_idx, i.str, i.x, CAST(max(r.row) AS BIGINT) AS row FROM drifting i JOIN table_rows r ON i.doc_id = r.doc_id AND i.page_number = r.page_number AND r.anchor >= i.y GROUP BY ALL),
in_col AS (SELECT i.doc_id, i.page_number, i.x, arg_min(c.col, abs(i.x - c.anchor) * 1000 + c.col / 1000.0) AS col FROM xs i JOIN table_cols c ON i.doc_id = c.doc_id AND i.page_number = c.page_number GROUP BY ALL)
SELECT doc_id, page_number, row, CAST(col AS BIGINT) AS col, trim(string_agg(str, ' ' ORDER BY x, item_idx)) AS value FROM in_row JOIN in_col USING (doc_id, page_number, x) GROUP BY ALL""")
def excel_grid(spark: SparkSession, d: str) -> DataFrame:
    lower = lambda i: i.withField("y", i["y"] - 3.5 * (i["item_idx"] % 5))
    return L.page_cells(V.page_items_of(V.dealt(spark, d)).withColumn("items", F.transform("items", lower)))


@query(f"""WITH {V.SHEETS}, sheets AS (SELECT doc_id, page_number, left('Page ' || page_number, 31) AS sheet FROM all_pages
  UNION ALL SELECT DISTINCT doc_id, 1000000000, '_About' FROM all_pages)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS ordinal, sheet FROM sheets""")
def workbook_sheets(spark: SparkSession, d: str) -> DataFrame:
    return sinks.workbook_sheets(V.pages_of(V.read(spark, d, "documents")))


@query(f"""WITH {V.BOXES}, {V.SHEETS}, own AS (SELECT doc_id, page_number, max(x + w) AS w, max(y) AS h FROM line_boxes GROUP BY doc_id, page_number),
sizes AS (SELECT doc_id, page_number, coalesce(w, 612) AS w, coalesce(h, 792) AS h FROM all_pages LEFT JOIN own USING (doc_id, page_number))
SELECT doc_id, page_number, CAST(10 AS DOUBLE) AS slide_w, 10 / (first_value(w) OVER p / first_value(h) OVER p) AS slide_h FROM sizes WINDOW p AS (PARTITION BY doc_id ORDER BY page_number)""")
def slide_catalog(spark: SparkSession, d: str) -> DataFrame:
    """A slide for each page; blank ones are of letter size."""
    own = V.boxes_of(V.items(spark, d)).groupBy("doc_id", "page_number").agg(F.max(F.col("x") + F.col("w")).alias("w"), F.max("y").alias("h"))
    every = V.pages_of(V.read(spark, d, "documents")).join(own, ["doc_id", "page_number"], "left")
    return sinks.slides(every.select("doc_id", "page_number", F.coalesce("w", F.lit(612.0)).alias("w"), F.coalesce("h", F.lit(792.0)).alias("h")))


@query(f"""WITH {V.ITEMS} SELECT doc_id, page_number, item_idx, x + 0.5 * y AS along_2, y AS across, CASE WHEN font_size > 0 THEN font_size END AS size, CAST(0 AS DOUBLE) AS angle, CAST(1 AS DOUBLE) AS hs FROM text_items""")
def fragments(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("font_size")
    runs = V.items(spark, d).withColumn("t", F.array(size, F.lit(0.0), F.lit(0.0), size, "x", "y")).select("doc_id", "page_number", "item_idx", "str", "y", "t")
    return L.fragments(runs).select("doc_id", "page_number", "item_idx", (F.col("along") + 0.5 * F.col("y")).alias("along_2"), "across", "size", "angle", "hs")


LAYER = V.ITEMS + """,
drawn AS (SELECT doc_id, page_number, line_no, item_idx, str, x + CASE WHEN x >= 300 THEN 20 ELSE 0 END AS along, y AS across, width, font_size AS size, CASE WHEN item_idx % 5 = 3 THEN 'Alt' WHEN font_size > 12 THEN 'Head' ELSE 'Body' END AS font,
  CASE WHEN item_idx % 2 = 0 THEN 1.25e0 ELSE 1 END AS hs, line_no % 5 = 4 AS turned FROM text_items WHERE item_idx % 13 <> 12),
gaps AS (SELECT *, min(item_idx) OVER (PARTITION BY doc_id, page_number, turned) AS seen, along - lag(along + width) OVER (PARTITION BY doc_id, page_number, line_no ORDER BY along) AS gap FROM drawn),
numbered AS (SELECT *, sum(CASE WHEN gap > 1.25 * size THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number, line_no ORDER BY along) AS run FROM gaps),
by_font AS (SELECT doc_id, page_number, line_no, run, font, sum(length(regexp_replace(str, '[^\\p{L}\\p{N}]', '', 'g')) * 100 + length(str)) AS weight, min(along) AS first, string_agg(str, '' ORDER BY along) AS chars, sum(hs * length(str)) / sum(length(str)) AS hs FROM numbered GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, line_no, run ORDER BY weight DESC, first) AS place, CASE WHEN font = 'Head' THEN 'H' ELSE 'B' END AS base FROM by_font),
bases AS (SELECT doc_id, page_number, line_no, run, base, min(ranked.place) AS top, any_value(base) || ':' || string_agg(chars, '' ORDER BY ranked.place) AS said FROM ranked GROUP BY doc_id, page_number, line_no, run, base),
fonts AS (SELECT doc_id, page_number, line_no, run, string_agg(said, ';' ORDER BY top) AS fonts FROM bases GROUP BY ALL),
layer AS (SELECT doc_id, page_number, line_no, run, turned, seen, string_agg(str, ' ' ORDER BY along) AS text, min(along) AS start, max(along + width) - min(along) AS width, arg_min(across, along) AS across, max(size) AS size FROM numbered GROUP BY ALL)"""


@query(f"""WITH {LAYER} SELECT l.doc_id, l.page_number, row_number() OVER (PARTITION BY l.doc_id, l.page_number ORDER BY seen, line_no, run) - 1 AS line, text, CASE WHEN turned THEN -across ELSE start END AS x, CASE WHEN turned THEN start ELSE across END AS y, CAST(CASE WHEN turned THEN 90 ELSE 0 END AS DOUBLE) AS angle,
  floor(l.width * 1e6 + 0.5) / 1e6 AS width, size, r.font, CAST(CASE WHEN abs(r.hs - 1) < 0.01 THEN 1 ELSE floor(r.hs * 1000 + 0.5) / 1000 END AS DOUBLE) AS h_scale, CASE WHEN r.font = 'Head' THEN 0.8e0 ELSE 0.9e0 END AS ascent, CASE WHEN r.font = 'Alt' THEN -0.2e0 ELSE -0.3e0 END AS descent, fonts
FROM layer l JOIN ranked r USING (doc_id, page_number, line_no, run) JOIN fonts USING (doc_id, page_number, line_no, run) WHERE place = 1""")
def layer_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of fragments. Every fifth line stands upright; words are drawn twice, followed by blanks, in vertical fonts, widened, and set apart from 300 points on."""
    i, size = F.col("item_idx"), F.col("font_size")
    along, turned = F.col("x") + F.when(F.col("x") >= 300, 20).otherwise(0), F.col("line_no") % 5 == 4
    font = F.when(i % 13 == 12, "Vert").when(i % 5 == 3, "Alt").when(size > 12, "Head").otherwise("Body")
    part = lambda k, str_, x, w: F.struct(F.lit(k).alias("k"), str_.alias("str"), x.alias("along"), w.alias("width"))
    own = part(0, F.col("str"), along, F.col("width"))
    twice = F.when(i % 7 == 0, part(1, F.col("str"), along + 0.5, F.col("width")))
    blank = F.when(i % 3 == 1, part(2, F.lit("  "), along + F.col("width"), F.lit(6.0)))
    runs = V.items(spark, d).select("doc_id", "page_number", i, "y", size, font.alias("font"), turned.alias("turned"), F.inline(F.array_compact(F.array(own, twice, blank))))
    wide, none = size * F.when(i % 2 == 0, 1.25).otherwise(1.0), F.lit(0.0)
    t = F.when(F.col("turned"), F.array(none, wide, -size, none, -F.col("y"), "along")).otherwise(F.array(wide, none, none, size, "along", "y"))
    runs = runs.select("doc_id", "page_number", (i * 4 + F.col("k")).alias("item_idx"), "str", t[4].alias("x"), t[5].alias("y"), "width", "font", t.alias("t"))
    each = [("Alt", "B", 0.9, -0.9, False), ("Body", "B", 0.9, -0.3, False), ("Head", "H", 9.9, -0.3, False), ("Vert", "V", 0.9, -0.3, True)]
    fonts = V.dealt(spark, d).select("doc_id", F.inline(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("font", "base_font", "ascent", "descent", "vertical"), f, strict=True))) for f in each))))
    lines = L.layer_lines(L.fragments(runs), fonts)
    said = F.array_join(F.transform("fonts", lambda f: F.concat_ws(":", f["base_font"], f["chars"])), ";")
    return lines.select("doc_id", "page_number", "line", "text", "x", "y", "angle", text.rounded(F.col("width"), 10**6).alias("width"), "size", "font", "h_scale", "ascent", "descent", said.alias("fonts"))


@query()
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of line boxes; compared with hand-worked pages and plain loops in the tests."""
    boxes = V.boxes_of(V.items(spark, d))
    return L.paragraphs(boxes.select("doc_id", "page_number", F.col("yk").alias("line"), "x", "y", F.col("w").alias("width"), F.col("font_size").alias("size"), (F.col("font_size") > 16).alias("bold")))


@query(f"""WITH {LINES} SELECT doc_id, page_number, list_reduce(list(trim(text) ORDER BY yk DESC),
  lambda out, t: CASE WHEN right(out, 1) = '-' AND regexp_matches(t, '^[a-z]') THEN left(out, length(out) - 1) || t WHEN regexp_matches(right(out, 1), '{text.CJK}') AND regexp_matches(left(t, 1), '{text.CJK}') THEN out || t ELSE out || ' ' || t END) AS text
FROM lines GROUP BY doc_id, page_number""")
def join_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = L.line_text(V.items(spark, d)).withColumn("down", -F.col("yk"))
    return lines.groupBy("doc_id", "page_number").agg(text.join_lines(L.in_order(F.trim("text"), "down")).alias("text"))


@query(f"""WITH {V.BOXES} SELECT doc_id, page_number, list_sort(list(x))[CAST(floor(count(*) * 0.1) AS BIGINT) + 1] AS left_margin, list_sort(list(x + w))[CAST(floor(count(*) * 0.9) AS BIGINT) + 1] AS right_margin, max(x + w) AS text_right
FROM line_boxes GROUP BY doc_id, page_number""")
def page_margins(spark: SparkSession, d: str) -> DataFrame:
    return L.margins(V.boxes_of(V.items(spark, d)))


ROOM = V.BOXES + """,
both_boxes AS (SELECT * FROM line_boxes UNION ALL SELECT doc_id, page_number, yk + 2000, x + w + 30, y + 3, w, h, font_size FROM line_boxes WHERE yk % 3 = 0),
row_pairs AS (SELECT a.doc_id, a.page_number, a.yk, count(*) AS n, min(b.x) FILTER (WHERE b.x >= a.x + a.w - 0.5) AS next_x FROM both_boxes a JOIN both_boxes b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND a.yk <> b.yk AND abs(b.y - a.y) < 0.6 * greatest(a.font_size, b.font_size) GROUP BY ALL),
rights AS (SELECT doc_id, page_number, max(x + w) AS text_right FROM both_boxes GROUP BY ALL),
roomy AS (SELECT a.doc_id, a.page_number, a.yk, n IS NULL AS alone, greatest(0.0, coalesce(next_x - 0.5 * font_size, text_right) - (x + w)) AS room FROM both_boxes a LEFT JOIN row_pairs USING (doc_id, page_number, yk) JOIN rights USING (doc_id, page_number))"""


def _two_columns(spark: SparkSession, d: str) -> DataFrame:
    """The line boxes, and for every third of them a field further right on its row.

    Both come from one row. A union of the boxes with their fields is taken for dealt by document as its parts are, and Spark 4.1 then loses rows of a page in plans that use it several times.
    """
    b = V.boxes_of(V.items(spark, d))
    rest = [c for c in b.columns if c not in L.PAGE]
    moved = {"yk": F.col("yk") + 2000, "x": F.col("x") + F.col("w") + 30, "y": F.col("y") + 3}
    own, more = F.struct(*rest), F.struct(*(moved.get(c, F.col(c)).alias(c) for c in rest))
    return b.select(*L.PAGE, F.inline(F.when(F.col("yk") % 3 == 0, F.array(own, more)).otherwise(F.array(own))))


@query(f"WITH {ROOM} SELECT doc_id, page_number, yk, CAST(room AS DOUBLE) AS room FROM roomy")
def row_room(spark: SparkSession, d: str) -> DataFrame:
    return L.row_room(_two_columns(spark, d)).select("doc_id", "page_number", "yk", "room")


@query(f"WITH {ROOM} SELECT doc_id, page_number, count(*) AS lines, count(*) FILTER (WHERE alone) AS alone FROM roomy GROUP BY ALL")
def alone_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.row_room(_two_columns(spark, d)).groupBy("doc_id", "page_number").agg(F.count(F.lit(1)).alias("lines"), F.count_if("alone").alias("alone"))


@query(f"""WITH {V.BOXES}, bands AS (SELECT *, CASE WHEN w > font_size * 0.5 THEN font_size * 0.08 ELSE 0 END AS inset FROM line_boxes)
SELECT doc_id, page_number, yk, floor((x + inset) * 1e6 + 0.5) / 1e6 AS rx, floor(greatest(0.5, w - inset * 2) * 1e6 + 0.5) / 1e6 AS rw, floor(font_size * 0.34 * 1e6 + 0.5) / 1e6 AS rh, floor((x - font_size * 0.12) * 1e6 + 0.5) / 1e6 AS cx, floor((w + font_size * 0.24) * 1e6 + 0.5) / 1e6 AS cw FROM bands""")
def line_bands(spark: SparkSession, d: str) -> DataFrame:
    b = V.boxes_of(V.items(spark, d))
    c = {k: F.col(k) for k in ("x", "y", "w", "font_size")}
    flat = F.lit(0.0)
    removed = geometry.removal_band(c["x"], c["y"], flat, c["w"], c["font_size"])
    covered = geometry.cover_band(c["x"], c["y"], flat, c["w"], c["font_size"], F.lit(0.8), F.lit(-0.2))
    r6 = lambda v: text.rounded(v, 10**6)
    return b.select("doc_id", "page_number", "yk", r6(removed["x"]).alias("rx"), r6(removed["w"]).alias("rw"), r6(removed["h"]).alias("rh"), r6(covered["x"]).alias("cx"), r6(covered["w"]).alias("cw"))


@query(f"""WITH {V.BOXES}, a AS (SELECT *, (yk % 7 * 15 - 45)::DOUBLE AS angle FROM line_boxes), u AS (SELECT *, cos(radians(angle)) AS ux, sin(radians(angle)) AS uy, CASE WHEN w > font_size * 0.5 THEN font_size * 0.08e0 ELSE 0 END AS inset FROM a),
b AS (SELECT *, x + ux * inset AS bx, y + uy * inset AS by_, greatest(0.5e0, w - inset * 2) AS len, font_size * 0.18e0 AS lo, font_size * 0.52e0 AS hi FROM u),
c AS (SELECT doc_id, page_number, yk, [bx - uy * lo, bx - uy * lo + ux * len, bx - uy * hi, bx - uy * hi + ux * len] AS xs, [by_ + ux * lo, by_ + ux * lo + uy * len, by_ + ux * hi, by_ + ux * hi + uy * len] AS ys FROM b)
SELECT doc_id, page_number, yk, floor(list_min(xs) * 1e5 + 0.5) AS x, floor(list_min(ys) * 1e5 + 0.5) AS y, floor((list_max(xs) - list_min(xs)) * 1e5 + 0.5) AS w, floor((list_max(ys) - list_min(ys)) * 1e5 + 0.5) AS h FROM c""")
def turned_bands(spark: SparkSession, d: str) -> DataFrame:
    """Where slanted lines are taken away, in hundred-thousandths of a point."""
    b = V.boxes_of(V.items(spark, d)).withColumn("angle", (F.col("yk") % 7 * 15 - 45).cast("double"))
    own = b.select("doc_id", "page_number", "yk", geometry.removal_band(*(F.col(c) for c in ("x", "y", "angle", "w", "font_size"))).alias("b"))
    return own.select("doc_id", "page_number", "yk", *(F.floor(F.col(f"b.{c}") * 1e5 + 0.5).cast("double").alias(c) for c in "xywh"))
