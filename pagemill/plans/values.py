"""Queries on single values: sizes, names, scripts, colours, boxes and moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import edits as E
from ..operators import layout as L
from ..operators import pages as P
from ..registry import query
from ..sources import views as V

_r6 = lambda c: text.rounded(c, 10**6)


@query(f"WITH {V.ITEMS} SELECT doc_id, page_number, item_idx, CASE WHEN item_idx % 4 = 3 THEN 0 ELSE font_size END AS size FROM text_items")
def font_size(spark: SparkSession, d: str) -> DataFrame:
    s, none, k = F.col("font_size"), F.lit(0.0), F.col("item_idx") % 4
    t = F.when(k == 0, F.array(s, none, none, s)).when(k == 1, F.array(s, none, none, none)).when(k == 2, F.array(-2 * s, none, none, -s)).otherwise(F.array(none, s, s, none))
    return V.items(spark, d).select("doc_id", "page_number", "item_idx", text.run_size(t).alias("size"))


def _misread(name: str) -> str:
    return name.encode("cp949").decode("latin-1")


NAMES = ("바탕체", "굴림", "Arial", "맑은 고딕Bold", "똠방각하")
#: Names as they come, and as they should be.
READ = [(_misread(n), n) for n in NAMES] + [("caf\xe9", "caf\xe9"), ("\xc7\xd1한", "\xc7\xd1한"), ("\xa1\xa1", "\xa1\xa1"), ("", "")]


@query("SELECT p_partkey, CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN '{b}'" for i, (_, b) in enumerate(READ)) + " END AS name FROM part")
def font_name_repair(spark: SparkSession, d: str) -> DataFrame:
    said = F.get(F.array(*(F.lit(a) for a, _ in READ)), (F.col("p_partkey") % 9).cast("int"))
    return V.read(spark, d, "part").select("p_partkey", text.repaired_name(said).alias("name"))


FONTS = ("Plain", "Plain-Bold", "Courier", "Georgia", _misread("바탕체"), "ABCDEF+" + _misread("똠방Bold"))


@query("""WITH f AS (SELECT p_partkey, p_partkey % 6 AS k, ['Plain', 'Plain-Bold', 'Courier', 'Georgia', '바탕체', '똠방Bold'][p_partkey % 6 + 1] AS shown FROM part)
SELECT p_partkey, shown, p_partkey % 3 = 0 OR k IN (1, 5) AS bold, p_partkey % 5 = 0 AS italic, CASE WHEN k = 2 OR p_partkey % 7 = 1 THEN 'mono' WHEN k IN (3, 4) OR p_partkey % 7 = 2 THEN 'serif' ELSE 'sans' END AS family FROM f""")
def font_flags(spark: SparkSession, d: str) -> DataFrame:
    """Fonts whose flags or style say more than their names, and whose names tell something once they are read right."""
    k = F.col("p_partkey")
    name = F.get(F.array(*map(F.lit, FONTS)), (k % 6).cast("int"))
    font = text.describe_font(name, F.when(k % 3 == 0, True), k % 5 == 0, F.when(k % 7 == 1, "monospace").when(k % 7 == 2, "serif"))
    told = V.read(spark, d, "part").select("p_partkey", font.alias("f"))
    return told.select("p_partkey", F.col("f.display_name").alias("shown"), "f.bold", "f.italic", "f.family")


@query(f"""WITH {V.ITEMS}, t AS (SELECT doc_id, page_number, CASE WHEN item_idx % (1 + doc_id % 4) = 0 THEN translate(str, 'aeiou', '가나다라마') ELSE str END AS str FROM text_items),
s AS (SELECT doc_id, page_number, CAST(sum(length(regexp_replace(str, '[^가-힣]', '', 'g'))) AS BIGINT) AS hangul, CAST(sum(length(regexp_replace(str, '[^\\p{{L}}\\p{{N}}]', '', 'g'))) AS BIGINT) AS letters, count(*) FILTER (WHERE NOT regexp_matches(str, '[^\\x20-\\x7e\\x{{a0}}-\\x{{ff}}{text.WINDOWS_EXTRA}]')) AS plain FROM t GROUP BY ALL)
SELECT doc_id, page_number, plain, coalesce(hangul / nullif(letters, 0) > 0.25, false) AS korean FROM s""")
def page_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Words of Windows characters only, and whether a page is mostly Hangul."""
    said = F.when(F.col("item_idx") % (1 + F.col("doc_id") % 4) == 0, F.translate("str", "aeiou", "가나다라마")).otherwise(F.col("str"))
    words = V.items(spark, d).select("doc_id", "page_number", said.alias("str"))
    sums = words.groupBy("doc_id", "page_number").agg(F.count_if(text.all_windows(F.col("str"))).alias("plain"), F.sum(F.regexp_count("str", F.lit(text.HANGUL))).alias("h"), F.sum(text.letters(F.col("str"))).alias("n"))
    return sums.select("doc_id", "page_number", "plain", text.mostly_hangul(F.col("h"), F.col("n")).alias("korean"))


@query(f"WITH {V.BOXES} SELECT doc_id, page_number, min(x) - 3 AS x, min(y) - 3 AS y, max(x + w) - min(x) + 6 AS w, max(y + h) - min(y) + 6 AS h FROM line_boxes GROUP BY doc_id, page_number")
def rect_union(spark: SparkSession, d: str) -> DataFrame:
    b = V.boxes_of(V.items(spark, d)).groupBy("doc_id", "page_number").agg(geometry.union_of(*map(F.col, "xywh")).alias("u"))
    return b.select("doc_id", "page_number", F.inline(F.array(geometry.expanded(F.col("u"), 3.0))))


@query(f"""WITH {V.BOXES}, t AS (SELECT *, (doc_id % 4) * 90 AS turn FROM line_boxes)
SELECT doc_id, page_number, yk, CASE turn WHEN 0 THEN 2 * x WHEN 90 THEN 2 * y WHEN 180 THEN 2 * (612 - x) ELSE 2 * (792 - y) END AS "left", CASE turn WHEN 0 THEN 2 * (792 - y) WHEN 90 THEN 2 * x WHEN 180 THEN 2 * y ELSE 2 * (612 - x) END AS top,
  CAST(CASE turn WHEN 0 THEN -30 WHEN 90 THEN 60 WHEN 180 THEN 150 ELSE -120 END AS DOUBLE) AS rotation FROM t""")
def text_frames(spark: SparkSession, d: str) -> DataFrame:
    view = geometry.viewport(*(F.lit(float(v)) for v in (0, 0, 612, 792)), (F.col("doc_id") % 4) * 90, F.lit(2.0))
    at = V.boxes_of(V.items(spark, d)).withColumn("m", view["m"])
    f = geometry.text_frame(F.col("m"), F.col("x"), F.col("y"), F.lit(30.0))
    return at.select("doc_id", "page_number", "yk", f["left"].alias("left"), f["top"].alias("top"), _r6(f["rotation"]).alias("rotation"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN repeat(CAST(floor(p_size / 50e0 * 255 + 0.5) AS BIGINT) || ',', 2) || CAST(floor(p_size / 50e0 * 255 + 0.5) AS BIGINT) WHEN 1 THEN CAST(floor(p_size / 50e0 * 255 + 0.5) AS BIGINT) || ',0,255'
  WHEN 2 THEN CAST(floor((1 - p_size / 50e0) * 0.5e0 * 255 + 0.5) AS BIGINT) || ',128,0' ELSE '0,0,0' END AS key FROM part""")
def color_spaces(spark: SparkSession, d: str) -> DataFrame:
    """Gray, RGB and CMYK colours, and one that is none of them."""
    k, v = F.col("p_partkey") % 4, F.col("p_size") / F.lit(50.0)
    one = lambda *c: F.array(*(x if not isinstance(x, float) else F.lit(x) for x in c))
    color = F.when(k == 0, one(v)).when(k == 1, one(v, 0.0, 1.0)).when(k == 2, one(v, 0.0, 1.0, 0.5)).otherwise(one(v, v))
    return V.read(spark, d, "part").select("p_partkey", geometry.color_key(geometry.as_rgb(color)).alias("key"))


@query("""WITH e AS (SELECT event_id, event_id % 4 AS way, CASE WHEN event_id % 3 = 0 THEN 10 ELSE 1 END AS step, (user_id % 4) * 90 AS turn FROM events), m AS (SELECT *, CASE way WHEN 0 THEN -step WHEN 1 THEN step ELSE 0 END AS dx, CASE way WHEN 2 THEN -step WHEN 3 THEN step ELSE 0 END AS dy FROM e)
SELECT event_id, CAST(CASE turn WHEN 0 THEN dx WHEN 90 THEN dy WHEN 180 THEN -dx ELSE -dy END AS DOUBLE) AS x, CAST(CASE turn WHEN 0 THEN -dy WHEN 90 THEN dx WHEN 180 THEN dy ELSE -dx END AS DOUBLE) AS y FROM m""")
def nudges(spark: SparkSession, d: str) -> DataFrame:
    """Arrow keys on turned pages as moves on the page; ten points with shift."""
    way, step = F.col("event_id") % 4, F.when(F.col("event_id") % 3 == 0, 10.0).otherwise(1.0)
    view = geometry.viewport(*(F.lit(float(v)) for v in (0, 0, 612, 792)), (F.col("user_id") % 4) * 90, F.lit(1.0))
    dx = F.when(way == 0, -step).when(way == 1, step).otherwise(0.0)
    dy = F.when(way == 2, -step).when(way == 3, step).otherwise(0.0)
    moved = V.read(spark, d, "events").withColumn("m", view["m"]).select("event_id", geometry.moved_on_page(F.col("m"), dx, dy).alias("by"))
    return moved.select("event_id", (F.col("by.x") + 0.0).alias("x"), (F.col("by.y") + 0.0).alias("y"))


@query(f"""WITH {V.BOXES}, b AS (SELECT *, (doc_id % 4) * 90 AS turn, CAST(yk % 9 * 11 - 40 AS DOUBLE) AS dx, CAST(yk % 7 * 13 - 30 AS DOUBLE) AS dy, yk % 2 = 0 AS resize, yk % 3 = 0 AS keep FROM line_boxes),
d AS (SELECT *, CASE turn WHEN 0 THEN x WHEN 90 THEN y WHEN 180 THEN 612 - x - w ELSE 792 - y - h END AS l, CASE turn WHEN 0 THEN 792 - y - h WHEN 90 THEN x WHEN 180 THEN y ELSE 612 - x - w END AS t, CASE WHEN turn % 180 = 0 THEN w ELSE h END AS bw, CASE WHEN turn % 180 = 0 THEN h ELSE w END AS bh FROM b),
s AS (SELECT *, CASE WHEN resize THEN greatest(6, bw + dx) ELSE bw END AS nw, CASE WHEN resize THEN CASE WHEN keep THEN greatest(6, bw + dx) / (bw / greatest(1, bh)) ELSE greatest(6, bh + dy) END ELSE bh END AS nh, CASE WHEN resize THEN l ELSE l + dx END AS nl, CASE WHEN resize THEN t ELSE t + dy END AS nt FROM d)
SELECT doc_id, page_number, yk, floor(CASE turn WHEN 0 THEN nl WHEN 90 THEN nt WHEN 180 THEN 612 - nl - nw ELSE 612 - nt - nh END * 1e4 + 0.37) AS x, floor(CASE turn WHEN 0 THEN 792 - nt - nh WHEN 90 THEN nl WHEN 180 THEN nt ELSE 792 - nl - nw END * 1e4 + 0.37) AS y,
  floor(CASE WHEN turn % 180 = 0 THEN nw ELSE nh END * 1e4 + 0.37) AS w, floor(CASE WHEN turn % 180 = 0 THEN nh ELSE nw END * 1e4 + 0.37) AS h FROM s""")
def drags(spark: SparkSession, d: str) -> DataFrame:
    """Boxes moved and resized on turned pages, some with their shape held, in ten-thousandths of a point, cut at 0.63, where no exact fraction of theirs lies."""
    yk, view = F.col("yk"), geometry.viewport(*(F.lit(float(v)) for v in (0, 0, 612, 792)), (F.col("doc_id") % 4) * 90, F.lit(1.0))
    boxes = V.boxes_of(V.items(spark, d)).withColumn("m", view["m"])
    to = geometry.dragged(F.col("m"), *(F.col(c) for c in "xywh"), (yk % 9 * 11 - 40).cast("double"), (yk % 7 * 13 - 30).cast("double"), yk % 2 == 0, yk % 3 == 0)
    return boxes.select("doc_id", "page_number", "yk", to.alias("to")).select("doc_id", "page_number", "yk", *(F.floor(F.col(f"to.{c}") * 1e4 + 0.37).cast("double").alias(c) for c in "xywh"))


@query(f"""WITH {V.SHEETS}, e AS (SELECT event_id, user_id AS doc_id, event_id % 7 + 1 AS page_number FROM events)
SELECT event_id, doc_id, page_number FROM e WHERE (doc_id, page_number) IN (SELECT (doc_id, page_number) FROM all_pages)""")
def edits_on_pages(spark: SparkSession, d: str) -> DataFrame:
    """Edits of pages that their file has."""
    edits = V.read(spark, d, "events").select("event_id", F.col("user_id").alias("doc_id"), (F.col("event_id") % 7 + 1).alias("page_number"))
    return E.on_pages(edits, V.pages_of(V.read(spark, d, "documents"))).select("event_id", "doc_id", "page_number")


@query("""WITH i AS (SELECT p_partkey, p_size * 37 + 20 AS w, (p_partkey % 50 + 1) * 41 AS h FROM part)
SELECT p_partkey, CAST(ceil(w * least(160e0 / w, 220e0 / h)) AS BIGINT) AS small_w, CAST(ceil(h * least(160e0 / w, 220e0 / h)) AS BIGINT) AS small_h, (2500 - w) / 2e0 AS x, (2500 - h) / 2e0 AS y FROM i""")
def thumbnails(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of thumbnails, and where a picture stands in the middle of a page."""
    w, h = F.col("p_size") * 37 + 20, (F.col("p_partkey") % 50 + 1) * 41
    small, at = geometry.thumbnail(w, h, 160, 220), geometry.centred(w, h, F.lit(2500.0), F.lit(2500.0))
    return V.read(spark, d, "part").select("p_partkey", small["w"].alias("small_w"), small["h"].alias("small_h"), at["x"].alias("x"), at["y"].alias("y"))


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ko' WHEN 1 THEN 'es' ELSE lang END AS ui FROM documents),
l AS (SELECT doc_id, CASE ui WHEN 'ko' THEN ['kor', 'eng'] WHEN 'es' THEN ['spa'] ELSE ['eng'] END AS codes FROM d), o(code, label) AS (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in text.OCR_LANGUAGES.items()) + """),
x AS (SELECT doc_id, unnest(codes) AS code, generate_subscripts(codes, 1) AS pos FROM l) SELECT doc_id, string_agg(label, ', ' ORDER BY pos) AS labels FROM x JOIN o USING (code) GROUP BY doc_id""")
def ocr_languages(spark: SparkSession, d: str) -> DataFrame:
    """The languages that recognition starts with, by their labels."""
    i = F.col("doc_id")
    ui = F.when(i % 3 == 0, "ko").when(i % 3 == 1, "es").otherwise(F.col("lang"))
    table = F.create_map(*(F.lit(x) for kv in text.OCR_LANGUAGES.items() for x in kv))
    return V.read(spark, d, "documents").select("doc_id", F.array_join(F.transform(text.first_languages(ui), lambda c: F.try_element_at(table, c)), ", ").alias("labels"))


CATEGORIES = ("organize", "convert", "extract", "secure", "ocr")


@query("""WITH t AS (SELECT p_partkey, p_partkey // 100 AS shelf, CASE p_size % 6 WHEN 0 THEN 'ocr' WHEN 1 THEN 'secure' WHEN 2 THEN 'organize' WHEN 3 THEN 'convert' WHEN 4 THEN 'extract' ELSE 'none' END AS category FROM part)
SELECT shelf, category, string_agg(p_partkey, ',' ORDER BY p_partkey) AS members, CAST(CASE category WHEN 'organize' THEN 1 WHEN 'convert' THEN 2 WHEN 'extract' THEN 3 WHEN 'secure' THEN 4 ELSE 5 END AS BIGINT) AS place FROM t WHERE category <> 'none' GROUP BY ALL""")
def tool_groups(spark: SparkSession, d: str) -> DataFrame:
    """Tools of each shelf of a hundred by category."""
    kind, k = F.get(F.array(*map(F.lit, ("ocr", "secure", "organize", "convert", "extract", "none"))), (F.col("p_size") % 6).cast("int")), F.col("p_partkey").cast("long")
    own = P.grouped(V.read(spark, d, "part").select(k.alias("k"), F.floor(k / 100).alias("shelf"), kind.alias("kind")), "kind", "k", list(CATEGORIES), "shelf")
    return own.select("shelf", "category", F.array_join("values", ",").alias("members"), "place")


@query("""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 2 > 0 THEN ' a, b ,' || lang ELSE '' END AS keywords, make_timestamp(2020, 1, 1, CAST(doc_id % 24 AS BIGINT), 30, 5.25) AS created FROM documents)
SELECT doc_id, CASE WHEN keywords = '' THEN '' ELSE 'a|b|' || trim(string_split(keywords, ',')[3]) END AS keywords, CASE WHEN doc_id % 3 > 0 THEN strftime(created, '%Y-%m-%dT%H:%M:%S.') || '250Z' END AS created, '2026-01-02T03:04:05.000Z' AS modified FROM f""")
def metadata_write(spark: SparkSession, d: str) -> DataFrame:
    """Metadata written with a time, and read again; some files have no date of creation."""
    i = F.col("doc_id")
    at = F.make_timestamp_ntz(F.lit(2020), F.lit(1), F.lit(1), F.pmod(i, F.lit(24)).cast("int"), F.lit(30), F.lit(5.25))
    files = V.read(spark, d, "documents").select("doc_id", F.when(i % 2 > 0, F.concat(F.lit(" a, b ,"), "lang")).alias("keywords"), F.when(i % 3 > 0, at).alias("created"))
    written = P.written_metadata(files, F.lit("2026-01-02 03:04:05").cast("timestamp_ntz"))
    return P.read_metadata(written.withColumn("keywords", F.array_join("keywords", "|"))).select("doc_id", "keywords", "created", "modified")


@query(f"""WITH {V.ITEMS}, p AS (SELECT DISTINCT doc_id, page_number FROM text_items), t AS (SELECT doc_id, max(page_number) AS total FROM p GROUP BY doc_id),
o AS (SELECT doc_id, page_number, CASE WHEN total > 1 AND page_number = 1 THEN 2 WHEN total > 1 AND page_number = 2 THEN 1 ELSE page_number END AS place FROM p JOIN t USING (doc_id))
SELECT doc_id, string_agg(page_number, ',' ORDER BY place) AS pages FROM o WHERE page_number % 3 <> doc_id % 3 GROUP BY doc_id""")
def kept_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages after the first was moved down by one and every third was taken away; files without any left are not written."""
    pages = V.items(spark, d).select("doc_id", "page_number").distinct()
    order = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list("page_number")).alias("o")).select("doc_id", F.posexplode(P.swapped(F.col("o"), F.lit(0), 1)).alias("place", "page_number"))
    kept = P.kept_order(order.withColumn("removed", F.col("page_number") % 3 == F.col("doc_id") % 3))
    return kept.select("doc_id", F.array_join("new_order", ",").alias("pages"))


@query("SELECT doc_id, left(text, 20000) AS shown, left('Page ' || source || lang || doc_id, 31) AS sheet, length(text) > 20000 AS more FROM documents")
def limits(spark: SparkSession, d: str) -> DataFrame:
    """What a preview and a sheet's name show of longer texts."""
    return V.read(spark, d, "documents").select("doc_id", F.left("text", F.lit(20_000)).alias("shown"), F.left(F.concat(F.lit("Page "), "source", "lang", "doc_id"), F.lit(31)).alias("sheet"), (F.char_length("text") > 20_000).alias("more"))


@query(f"WITH {V.EDITS}, n AS (SELECT *, lead(at_ms) OVER (PARTITION BY session ORDER BY at_ms, event_id) AS after FROM edit_log) SELECT session, event_id, at_ms, at_ms + 3600000 AS runs_ms FROM n WHERE after IS NULL OR after - at_ms >= 3600000")
def debounced_edits(spark: SparkSession, d: str) -> DataFrame:
    return E.debounced(V.edit_log_of(V.read(spark, d, "events")).select("session", "event_id", "at_ms"), 3_600_000)


@query(f"""WITH {V.ITEMS}, s AS (SELECT doc_id, page_number, sum(width) / sum(length(str) * (5 + doc_id % 3)) AS r FROM text_items GROUP BY ALL)
SELECT doc_id, page_number, floor(CASE WHEN r / 1.1e0 > 0.85 AND r / 1.1e0 < 1.2 THEN r / 1.1e0 ELSE 1 END * 1e9 + 0.5) / 1e9 AS tracking FROM s""")
def letter_spacing(spark: SparkSession, d: str) -> DataFrame:
    r = V.items(spark, d).groupBy("doc_id", "page_number").agg((F.sum("width") / F.sum(F.char_length("str") * (5 + F.col("doc_id") % 3))).alias("r"))
    return r.select("doc_id", "page_number", text.rounded(E.tracking(F.col("r"), F.lit(1.1)), 10**9).alias("tracking"))


@query(f"WITH {V.ITEMS} SELECT count(DISTINCT (doc_id, page_number)) AS pages, count(DISTINCT doc_id) AS files, count(*) AS words, CAST(sum(length(str)) AS BIGINT) AS letters FROM text_items")
def totals(spark: SparkSession, d: str) -> DataFrame:
    """What the whole corpus holds, summed from pages to files to all."""
    pages = V.items(spark, d).groupBy(*L.PAGE).agg(F.count(F.lit(1)).alias("w"), F.sum(F.char_length("str")).alias("n"))
    files = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("p"), F.sum("w").alias("w"), F.sum("n").alias("n"))
    return files.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pages"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("w"), F.lit(0)).alias("words"), F.sum("n").alias("letters"))
