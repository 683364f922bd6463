"""Queries on fonts, widths and joined runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fonts as O
from ..registry import query
from ..sources import views as V

WINDOWS = " ".join(f"WHEN {k} THEN {v}" for k, v in O.WINDOWS.items())


@query(f"""WITH c AS (SELECT p_partkey, p_partkey % 256 AS code, CASE p_partkey % 3 WHEN 0 THEN 'WinAnsiEncoding' WHEN 1 THEN 'StandardEncoding' ELSE 'Other' END AS e FROM part)
SELECT p_partkey, CAST(CASE WHEN code BETWEEN 32 AND 126 THEN CASE WHEN e = 'StandardEncoding' AND code = 39 THEN 8217 WHEN e = 'StandardEncoding' AND code = 96 THEN 8216 ELSE code END WHEN e = 'WinAnsiEncoding' THEN CASE WHEN code >= 160 THEN code ELSE CASE code {WINDOWS} END END END AS BIGINT) AS point FROM c""")
def base_encoding(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    e = F.when(k % 3 == 0, "WinAnsiEncoding").when(k % 3 == 1, "StandardEncoding").otherwise("Other")
    return V.read(spark, d, "part").select("p_partkey", O.code_point(k % 256, e).cast("long").alias("point"))


@query(f"""WITH {V.ITEMS}, c AS (SELECT doc_id, page_number, line_no, font_size, unnest(string_split(str, '')) AS ch FROM text_items)
SELECT doc_id, page_number, line_no, sum(CASE WHEN ch IN ('e', 't', 'a') THEN 450 + doc_id % 5 * 10 WHEN ch = 'i' THEN 250 + doc_id % 3 ELSE 1000 END) * any_value(font_size) / 1000 AS width FROM c GROUP BY doc_id, page_number, line_no""")
def text_width(spark: SparkSession, d: str) -> DataFrame:
    """All files name their font alike, but its widths differ."""
    key = ["doc_id", "page_number", "line_no"]
    lines = V.lines(spark, d).select(*key, F.replace("line", F.lit(" "), F.lit("")).alias("text"), F.col("font_size").alias("size"), F.lit("F").alias("font"))
    i = F.col("doc_id")
    each = F.array(*(F.struct(F.lit("F").alias("font"), F.lit(c).alias("char"), (250 + i % 3 if c == "i" else 450 + i % 5 * 10).alias("width")) for c in "etai"))
    return O.text_width(lines, V.read(spark, d, "documents").select("doc_id", F.inline(each)), key)


@query(f"""WITH {V.ITEMS}, s AS (SELECT doc_id, page_number, sum(width) AS a, sum(length(str) * (3 + doc_id % 6)) AS n FROM text_items GROUP BY ALL)
SELECT doc_id, page_number, CASE WHEN a / n > 0.6 AND a / n < 1.6 AND abs(a / n - 1) > 0.015 THEN a / n ELSE 1.0e0 END AS ratio FROM s""")
def spacing_ratio(spark: SparkSession, d: str) -> DataFrame:
    samples = V.items(spark, d).select("doc_id", "page_number", F.col("width").alias("actual"), (F.char_length("str") * (3 + F.col("doc_id") % 6)).alias("nominal"))
    return O.spacing_ratio(samples, ["doc_id", "page_number"])


@query("""WITH w AS (SELECT doc_id, doc_id * 10 AS id, CASE doc_id % 3 WHEN 0 THEN 'ABCDEF+Serif' WHEN 1 THEN 'Serif' ELSE 'Sans' END AS font, regexp_extract_all(text, '(?s).') AS chars FROM documents),
d AS (SELECT doc_id, '1 0 R' AS ref, 'ABCDEF+Serif' AS name, list_filter(list_distinct(chars), lambda c: (unicode(c) + doc_id) % 2 = 0) AS enc, 0 AS place FROM w UNION ALL SELECT doc_id, '2 0 R', 'GHIJKL+Serif', list_filter(list_distinct(chars), lambda c: unicode(c) % 3 > 0), 1 FROM w UNION ALL SELECT doc_id, '3 0 R', 'Sans', list_filter(list_distinct(chars), lambda c: unicode(c) % 5 > doc_id % 4), 2 FROM w),
s AS (SELECT doc_id, id, ref, place, len(list_filter(chars, lambda c: list_contains(enc, c))) + CASE WHEN font = name THEN 0.5e0 ELSE 0 END AS score FROM w JOIN d USING (doc_id) WHERE regexp_replace(font, '^[A-Z]{6}\\+', '') = regexp_replace(name, '^[A-Z]{6}\\+', '')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY score DESC, place) AS k FROM s) SELECT doc_id, id, ref, score FROM r WHERE k = 1""")
def font_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Every file has fonts of the same names, each with other characters; whole texts are wanted."""
    i = F.col("doc_id")
    font = F.when(i % 3 == 0, "ABCDEF+Serif").when(i % 3 == 1, "Serif").otherwise("Sans")
    docs = V.read(spark, d, "documents").where("text IS NOT NULL")
    wanted = docs.select("doc_id", (i * 10).alias("id"), font.alias("font"), F.col("text").alias("chars"))
    some = F.array_distinct(F.split("text", ""))
    kinds = (("1 0 R", "ABCDEF+Serif", lambda c: (F.ascii(c) + i) % 2 == 0), ("2 0 R", "GHIJKL+Serif", lambda c: F.ascii(c) % 3 > 0), ("3 0 R", "Sans", lambda c: F.ascii(c) % 5 > i % 4))
    there = docs.select("doc_id", F.inline(F.array(*(F.struct(F.lit(r).alias("ref"), F.lit(n).alias("name"), F.filter(some, f).alias("encodable"), F.lit(k).alias("place")) for k, (r, n, f) in enumerate(kinds)))))
    return O.resolved(wanted, there)


@query(f"""WITH {V.ITEMS}, r AS (SELECT *, x - CASE WHEN item_idx % 4 = 1 THEN 5 ELSE 0 END AS along FROM text_items),
e AS (SELECT *, greatest(0, max(along + width) OVER (PARTITION BY doc_id, page_number, line_no ORDER BY along, item_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS e, lag(str) OVER (PARTITION BY doc_id, page_number, line_no ORDER BY along, item_idx) AS b FROM r)
SELECT doc_id, page_number, line_no, string_agg(CASE WHEN b IS NOT NULL AND along - e > 0.15 * font_size THEN ' ' || str ELSE str END, '' ORDER BY along, item_idx) AS text FROM e GROUP BY ALL""")
def joined_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth word is moved up against the one before it."""
    runs = V.items(spark, d).select("doc_id", "page_number", "line_no", F.col("item_idx").alias("n"), "str", (F.col("x") - F.when(F.col("item_idx") % 4 == 1, 5).otherwise(0)).alias("along"), "width", F.col("font_size").alias("size"))
    return O.joined(runs, ["doc_id", "page_number", "line_no"])


@query(f"""WITH {V.ITEMS}, p AS (SELECT *, CASE WHEN item_idx % 3 = 1 THEN '' ELSE ' ' END AS sep FROM text_items),
l AS (SELECT doc_id, page_number, line_no, string_agg(CASE WHEN item_idx % 11 = 5 THEN '' ELSE sep || str END, '' ORDER BY item_idx) AS line FROM p GROUP BY ALL)
SELECT doc_id, page_number, line_no, line, string_agg(str, '|' ORDER BY item_idx) AS words FROM p JOIN l USING (doc_id, page_number, line_no) GROUP BY ALL""")
def words_lines(spark: SparkSession, d: str) -> DataFrame:
    """The input of `words_text`: lines whose own text runs some words together and lacks others."""
    return _worded(spark, d).select("doc_id", "page_number", "line_no", "line", F.array_join("words", "|").alias("words"))


def _worded(spark: SparkSession, d: str) -> DataFrame:
    """Lines and their words, told inside their document's row."""
    i = lambda k: F.col("first") + k
    said = F.transform("words", lambda w, k: F.when(i(k) % 11 == 5, "").otherwise(F.concat(F.when(i(k) % 3 == 1, "").otherwise(" "), w)))
    lines = V.lines(spark, d).select("doc_id", "page_number", "line_no", "first", V.words_of("line").alias("words"))
    return lines.select("doc_id", "page_number", "line_no", F.array_join(said, "").alias("line"), "words")


@query(f"""WITH {V.ITEMS}, p AS (SELECT *, CASE WHEN item_idx % 3 = 1 THEN '' ELSE ' ' END AS sep FROM text_items),
l AS (SELECT doc_id, page_number, line_no, string_agg(CASE WHEN item_idx % 11 = 5 THEN '' ELSE sep || str END, '' ORDER BY item_idx) AS line, list(str ORDER BY item_idx) AS words FROM p GROUP BY ALL),
f AS (SELECT doc_id, page_number, line_no, list_reduce(words, lambda s, w: CASE WHEN instr(substr(line, s.at), w) > 0
    THEN {{'out': CASE WHEN s.out = '' THEN w WHEN s.found AND NOT regexp_matches(substr(line, s.at, instr(substr(line, s.at), w) - 1), '\\s') THEN s.out || w ELSE s.out || ' ' || w END, 'at': s.at + instr(substr(line, s.at), w) - 1 + length(w), 'found': true}}
    ELSE {{'out': CASE WHEN s.out = '' THEN w ELSE s.out || ' ' || w END, 'at': s.at, 'found': false}} END, {{'out': '', 'at': CAST(1 AS BIGINT), 'found': false}}) AS s FROM l)
SELECT doc_id, page_number, line_no, s.out AS text FROM f""")
def words_text(spark: SparkSession, d: str) -> DataFrame:
    return _worded(spark, d).select("doc_id", "page_number", "line_no", O.words_text(F.col("line"), F.col("words")).alias("text"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' WHEN lang = 'de' THEN 'de' ELSE 'en,' || lang END AS first, CASE WHEN lang = 'de' THEN 'fr' WHEN lang = 'fr' THEN 'de' ELSE 'de,fr,' || lang END AS second FROM documents")
def language_toggle(spark: SparkSession, d: str) -> DataFrame:
    own = F.col("lang")
    one = O.toggled(F.when(own == "de", F.array(F.lit("de"))).otherwise(F.array(F.lit("en"))), own)
    two = O.toggled(F.array(F.lit("de"), F.lit("fr")), own)
    return V.read(spark, d, "documents").select("doc_id", F.array_join(one, ",").alias("first"), F.array_join(two, ",").alias("second"))


@query(f"""WITH {V.BOXES}, g AS (SELECT *, abs(lag(y) OVER (PARTITION BY doc_id, page_number ORDER BY y DESC) - y) AS gap FROM line_boxes) SELECT doc_id, page_number, floor(avg(gap) * 1e6 + 0.5) / 1e6 AS gap FROM g GROUP BY ALL""")
def line_gaps(spark: SparkSession, d: str) -> DataFrame:
    b = V.boxes_of(V.items(spark, d)).select("doc_id", "page_number", (-F.col("yk")).alias("n"), "x", "y", F.lit(0.0).alias("angle"))
    return O.line_gap(b).withColumn("gap", F.floor(F.col("gap") * 1e6 + 0.5) / 1e6)


@query("SELECT doc_id, doc_id % 23 IN (0, 21, 22) AS change_only, octet_length(encode(text)) AS bytes, lang <> 'en' AS unsaved FROM documents")
def edit_eligible(spark: SparkSession, d: str) -> DataFrame:
    """Change-only edits, bytes of a data URL, and whether metadata differ from what was saved. Of 23 edits three keep all, each other one breaks one condition."""
    k = F.col("doc_id") % 23
    but = lambda n, usual, other: F.when(k == n, other).otherwise(usual)
    edit = F.struct(
        but(1, "original", "sans").alias("font"), but(2, "left", "center").alias("align"), but(3, but(21, 12.0, 12.009), 12.02).alias("size"), but(4, but(22, "#a0b1c2", "#A0B1C2"), "#a0b1c3").alias("color"),
        but(5, F.lit(True), F.lit(False)).alias("bold"), but(6, F.lit(False), F.lit(True)).alias("italic"), but(7, 1.0, 1.02).alias("h_scale"), but(8, 72.0, 72.1).alias("x"), but(9, 700.0, 690.0).alias("y"), but(10, 100.0, 101.0).alias("width"),
        but(11, "a line", "two\nlines").alias("text"), (k == 12).alias("wrap"), but(13, 0.0, 90.0).alias("rotation"), (k == 14).alias("hidden"),
    )
    line = F.struct(
        but(15, "layer", "ocr").alias("origin"), (k == 16).alias("covered"), but(17, 1, 2).alias("lines"), F.when(k != 18, 72.0).alias("x"), F.lit(700.0).alias("y"), F.lit(100.0).alias("width"), F.lit(12.0).alias("size"), F.lit("#A0b1c2").alias("color"),
        F.lit(True).alias("bold"), F.lit(False).alias("italic"), F.lit(1.0).alias("h_scale"), but(19, 0, 90).alias("rotation"),
    )
    ok = O.change_only(edit, F.when(k != 20, line))
    url = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8")))
    size = F.octet_length(F.unbase64(F.substring_index(url, ",", -1))).cast("long")
    saved = F.struct(F.lit("en").alias("lang"), F.col("source").alias("source"))
    return V.read(spark, d, "documents").select("doc_id", ok.alias("change_only"), size.alias("bytes"), (~F.struct("lang", "source").eqNullSafe(saved)).alias("unsaved"))
