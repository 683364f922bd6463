"""Queries on files and their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import pages as P
from ..registry import query
from ..sources import views as V

TOTALS = V.SHEETS + """,
files AS (SELECT doc_id, max(page_number) AS total, 'doc' || doc_id AS name FROM all_pages GROUP BY doc_id)"""
PAGES = V.SHEETS + """,
pages_ AS (SELECT doc_id, page_number FROM all_pages)"""
SELECTIONS = ("", ",", "5", "1-3, 5", "9-7", "0", "3-99", "a", "1 - 2", "2,1,2", "1-2-3", " 1 , 2 ")
SAID = ", ".join(f"({k}, '{s}')" for k, s in enumerate(SELECTIONS))
RANGES = ("1-3; 5", "1;2;1", "1-2;x", ";", "2-1; 1")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return V.files_of(V.read(spark, d, "documents")).withColumn("name", F.concat(F.lit("doc"), "doc_id"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return V.pages_of(V.read(spark, d, "documents"))


def _range_sql(files: str) -> str:
    """Pages of selections: `files` has (id columns, said, total)."""
    return f"""parts AS (SELECT *, unnest(list_filter(list_transform(string_split(said, ','), lambda p: trim(p)), lambda p: p <> '')) AS part FROM {files}),
bounds AS (SELECT *, TRY_CAST(trim(string_split(part, '-')[1]) AS BIGINT) AS a, TRY_CAST(trim(string_split(part, '-')[-1]) AS BIGINT) AS b, regexp_full_match(part, '[0-9]+( *- *[0-9]+)?') AS ok FROM parts),
wrong AS (SELECT DISTINCT doc_id, k FROM bounds WHERE NOT ok OR a IS NULL OR b IS NULL OR a < 1 OR b < 1 OR a > total OR b > total),
chosen AS (SELECT DISTINCT doc_id, k, unnest(range(least(a, b), greatest(a, b) + 1)) AS page_number FROM bounds WHERE (doc_id, k) NOT IN (SELECT (doc_id, k) FROM wrong)
  UNION SELECT doc_id, k, unnest(range(1, total + 1)) FROM {files} WHERE trim(said) = '')"""


@query(f"WITH {TOTALS}, asked AS (SELECT * FROM files, (VALUES {SAID}) s(k, said)), {_range_sql('asked')} SELECT doc_id, CAST(k AS BIGINT) AS k, page_number FROM chosen")
def page_range_expand(spark: SparkSession, d: str) -> DataFrame:
    asked = _files(spark, d).select("doc_id", "total", F.posexplode(F.array(*map(F.lit, SELECTIONS))).alias("k", "said"))
    return asked.select("doc_id", F.col("k").cast("long").alias("k"), F.explode(text.page_range(F.col("said"), F.col("total")).cast("array<long>")).alias("page_number"))


@query(f"WITH {TOTALS} SELECT doc_id, (p - 1) // 2 + 1 AS part, name || '_part_' || ((p - 1) // 2 + 1) || '.pdf' AS name, p AS page_number FROM (SELECT *, unnest(range(1, total + 1)) AS p FROM files)")
def split_every(spark: SparkSession, d: str) -> DataFrame:
    return P.split_every(_files(spark, d), 2)


RANGES_SQL = ", ".join(f"({k}, '{r}')" for k, r in enumerate(RANGES))


@query(f"""WITH {TOTALS}, given AS (SELECT f.doc_id, f.total, f.name, r.ranges FROM files f JOIN (VALUES {RANGES_SQL}) r(k, ranges) ON f.doc_id % {len(RANGES)} = r.k),
split_up AS (SELECT *, list_filter(list_transform(string_split(ranges, ';'), lambda p: trim(p)), lambda p: p <> '') AS groups FROM given),
asked AS (SELECT doc_id, total, name, unnest(groups) AS said, generate_subscripts(groups, 1) AS k FROM split_up), {_range_sql('asked')},
bad AS (SELECT DISTINCT doc_id FROM wrong)
SELECT doc_id, CAST(k AS BIGINT) AS part, 'doc' || doc_id || '_part_' || k || '.pdf' AS name, page_number FROM chosen WHERE doc_id NOT IN (SELECT doc_id FROM bad)""")
def split_ranges(spark: SparkSession, d: str) -> DataFrame:
    said = F.get(F.array(*map(F.lit, RANGES)), F.pmod("doc_id", F.lit(len(RANGES))).cast("int"))
    return P.split_ranges(_files(spark, d).withColumn("ranges", said))


@query(f"WITH {PAGES} SELECT doc_id % 10 AS merged, doc_id, page_number, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id, page_number) AS new_page FROM pages_")
def merge_pages(spark: SparkSession, d: str) -> DataFrame:
    own = _pages(spark, d).select(F.pmod("doc_id", F.lit(10)).alias("merged"), "doc_id", "page_number")
    return P.merge(own)


@query(f"WITH {PAGES} SELECT doc_id, page_number, CAST(CASE WHEN page_number IN (1, 3) THEN ((doc_id % 4) * 90 + 270) % 360 ELSE (doc_id % 4) * 90 END AS BIGINT) AS angle FROM pages_")
def rotate_pages(spark: SparkSession, d: str) -> DataFrame:
    own = _pages(spark, d).select("doc_id", "page_number", (F.pmod("doc_id", F.lit(4)) * 90).alias("angle"))
    return P.rotate(own, 270, F.col("page_number").isin(1, 3))


@query(f"""WITH {PAGES}, orders AS (SELECT doc_id, list_concat(list_reverse(range(1, total + 1)), [1]) AS o FROM (SELECT doc_id, max(page_number) AS total FROM pages_ GROUP BY doc_id)),
wanted AS (SELECT doc_id, unnest(o) AS page_number, generate_subscripts(o, 1) AS new_page FROM orders),{V.ITEMS},
counts AS (SELECT doc_id, page_number, count(*) AS n FROM text_items GROUP BY doc_id, page_number)
SELECT doc_id, page_number, CAST(new_page AS BIGINT) AS new_page, coalesce(n, 0) AS n FROM wanted JOIN pages_ USING (doc_id, page_number) LEFT JOIN counts USING (doc_id, page_number)""")
def reorder_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages from the last to the first and the first once more, with how many items each has."""
    pages = V.counted_pages_of(V.read(spark, d, "documents"))
    orders = _files(spark, d).select("doc_id", F.concat(F.reverse(F.sequence(F.lit(1).cast("long"), "total")), F.array(F.lit(1).cast("long"))).alias("new_order"))
    return P.reorder(pages, orders).select("doc_id", "page_number", "new_page", "n")


@query(f"""WITH {PAGES}, t AS (SELECT *, max(page_number) OVER (PARTITION BY doc_id) AS total FROM pages_)
SELECT doc_id, page_number, replace(replace(replace(replace('{{name}}-{{n}}_{{N}}of{{total}}', '{{name}}', 'doc' || doc_id), '{{n}}', lpad('' || page_number, CAST(greatest(length('' || total), length('' || page_number)) AS INT), '0')), '{{N}}', '' || page_number), '{{total}}', '' || total) || '.png' AS filename FROM t""")
def build_filename(spark: SparkSession, d: str) -> DataFrame:
    both = _files(spark, d).select("doc_id", "total", F.explode(F.sequence(F.lit(1).cast("long"), "total")).alias("page_number"))
    return both.select("doc_id", "page_number", text.build_filename(F.lit("{name}-{n}_{N}of{total}"), F.concat(F.lit("doc"), "doc_id"), F.col("page_number"), F.col("total"), "png").alias("filename"))


@query(r"SELECT page_id, regexp_replace(url, '\.[^/.]+$', '') AS stem FROM pages")
def strip_extension(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "pages").select("page_id", text.strip_extension(F.col("url")).alias("stem"))


SIZES = "(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_partkey * 137 WHEN 2 THEN p_partkey * 10007 ELSE p_partkey * 7654321 END)"


@query(f"""WITH s AS (SELECT p_partkey, CAST({SIZES} AS BIGINT) AS n FROM part)
SELECT p_partkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{{:.1f}}', floor(n / 1024 * 10 + 0.5) / 10) || ' KB' WHEN n < 1073741824 THEN format('{{:.1f}}', floor(n / 1048576 * 10 + 0.5) / 10) || ' MB' ELSE format('{{:.2f}}', floor(n / 1073741824 * 100 + 0.5) / 100) || ' GB' END AS said FROM s""")
def format_bytes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("long")
    n = F.when(k % 4 == 0, F.col("p_size").cast("long")).when(k % 4 == 1, k * 137).when(k % 4 == 2, k * 10007).otherwise(k * 7654321)
    return V.read(spark, d, "part").select("p_partkey", text.format_bytes(n).alias("said"))


@query("""WITH i AS (SELECT p_partkey, p_size * 37 + 20 AS w, (p_partkey % 50 + 1) * 41 AS h FROM part),
s AS (SELECT *, CASE WHEN w > h THEN 841.89e0 ELSE 595.28e0 END AS pw, CASE WHEN w > h THEN 595.28e0 ELSE 841.89e0 END AS ph FROM i)
SELECT p_partkey, pw AS page_w, ph AS page_h, floor(w * least((pw - 40) / w, (ph - 40) / h) * 1e6 + 0.5) / 1e6 AS fit_w, floor(h * greatest((pw - 40) / w, (ph - 40) / h) * 1e6 + 0.5) / 1e6 AS fill_h,
  CAST(CASE WHEN w <= 1000 AND h <= 1000 THEN w ELSE greatest(1, floor(w * least(1000e0 / w, 1000e0 / h) + 0.5)) END AS BIGINT) AS small_w, CAST(CASE WHEN w <= 1000 AND h <= 1000 THEN h ELSE greatest(1, floor(h * least(1000e0 / w, 1000e0 / h) + 0.5)) END AS BIGINT) AS small_h,
  CAST(ceil(w * (150 / 72e0)) AS BIGINT) AS px_w FROM s""")
def fit_dimensions(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("p_size") * 37 + 20, (F.col("p_partkey") % 50 + 1) * 41
    page = geometry.page_size(w, h, "a4", "auto")
    fit, fill = (geometry.draw_size(w, h, page["w"], page["h"], 20, k) for k in ("fit", "fill"))
    small = geometry.clamped(w, h, 1000)
    r6 = lambda v: text.rounded(v, 10**6)
    return V.read(spark, d, "part").select("p_partkey", page["w"].alias("page_w"), page["h"].alias("page_h"), r6(fit["w"]).alias("fit_w"), r6(fill["h"]).alias("fill_h"), small["w"].alias("small_w"), small["h"].alias("small_h"), F.ceil(w * F.lit(150 / 72)).alias("px_w"))


@query("""SELECT p_partkey, CAST(least(greatest(coalesce(nullif(p_size * 31 - 31, 0), 150), 36), 1200) AS BIGINT) AS dpi, least(greatest(p_size / 40e0, 0.1), 1) AS quality, CAST(greatest(p_size - 20, 0) AS BIGINT) AS margin, CAST(least(greatest(p_size * 8, 4), 200) AS BIGINT) AS font FROM part""")
def option_clamps(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    return V.read(spark, d, "part").select("p_partkey", text.clamp(n * 31 - 31, 36, 1200, 150).cast("long").alias("dpi"), text.clamp(n / 40, 0.1, 1.0).alias("quality"), F.greatest(n - 20, F.lit(0)).cast("long").alias("margin"), text.clamp(n * 8, 4, 200).cast("long").alias("font"))


@query("""SELECT doc_id, coalesce(source, '') AS title, coalesce(CASE WHEN doc_id % 3 > 0 THEN lang END, '') AS author, list_transform(string_split(CASE WHEN doc_id % 5 > 0 THEN source || ' , ' || lang || ',x' ELSE '' END, ','), lambda k: trim(k))[1] AS first_keyword,
  CASE WHEN doc_id % 5 > 0 THEN 3 ELSE 0 END AS keywords FROM documents""")
def metadata_read(spark: SparkSession, d: str) -> DataFrame:
    docs = V.read(spark, d, "documents")
    files = docs.select("doc_id", F.col("source").alias("title"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("author"), F.when(F.col("doc_id") % 5 > 0, F.concat("source", F.lit(" , "), "lang", F.lit(",x"))).alias("keywords"))
    read = P.read_metadata(files).withColumn("k", P.keyword_list(F.col("keywords")))
    return read.select("doc_id", "title", "author", F.coalesce(F.get("k", F.lit(0)), F.lit("")).alias("first_keyword"), F.size("k").alias("keywords"))


@query("""SELECT page_id, lower(url) LIKE '%.html' OR page_id % 7 = 0 AS accepted FROM pages""")
def file_accept(spark: SparkSession, d: str) -> DataFrame:
    mime = F.when(F.col("page_id") % 7 == 0, "text/html")
    return V.read(spark, d, "pages").select("page_id", P.accepted(F.col("url"), mime, ".html", "text/html").alias("accepted"))


@query(f"""WITH {TOTALS} SELECT doc_id, total FROM files WHERE doc_id % 4 IN (0, 1) AND total >= 2""")
def convertible_files(spark: SparkSession, d: str) -> DataFrame:
    status = F.get(F.array(*map(F.lit, ("ready", "done", "error", "pending"))), F.pmod("doc_id", F.lit(4)).cast("int"))
    files = _files(spark, d).withColumn("status", status)
    return files.where(F.col("status").isin("ready", "done") & text.page_range(F.lit("1-2"), F.col("total")).isNotNull()).select("doc_id", "total")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'ko' WHEN doc_id % 5 = 2 AND lang IN ('en', 'es') THEN lang WHEN lang = 'es' THEN 'es' WHEN doc_id % 3 = 0 THEN 'ko' WHEN doc_id % 3 = 1 THEN 'es' ELSE 'en' END AS ui FROM documents""")
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    zone = F.get(F.array(*map(F.lit, ("Asia/Seoul", "America/Argentina/Salta", "Europe/Berlin"))), F.pmod(i, F.lit(3)).cast("int"))
    ui = text.language(F.when(i % 5 == 1, "KO-kr"), F.when(i % 5 == 2, F.col("lang")), F.concat("lang", F.lit("-XX")), zone, {"Asia/Seoul": "ko", "Asia/Pyongyang": "ko"})
    return V.read(spark, d, "documents").select("doc_id", ui.alias("ui"))
