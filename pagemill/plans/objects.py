"""Queries on stored objects and fonts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import objects as O
from ..registry import query
from ..sources import views as V


def _objects(spark: SparkSession, d: str) -> DataFrame:
    return V.objects_of(V.read(spark, d, "part"))


CANDIDATES = V.OBJECTS + """,
candidates AS (SELECT * FROM pdf_objects o WHERE subtype = 'Image' AND NOT EXISTS (SELECT 1 FROM pdf_objects m WHERE m.doc_id = o.doc_id AND (m.smask_ref = o.ref OR m.mask_ref = o.ref)))"""
KINDS = V.OBJECTS + """,
kinds AS (SELECT *, CASE WHEN NOT is_stream THEN CASE WHEN type = 'Sig' THEN 'signature' END WHEN subtype = 'Image' THEN 'image' WHEN type IN ('Font', 'FontDescriptor') OR subtype IN ('CIDFontType0C', 'CIDFontType2', 'Type1C', 'OpenType') THEN 'font' WHEN subtype = 'XML' OR type = 'Metadata' THEN 'metadata'
  WHEN type = 'Sig' OR EXISTS (SELECT 1 FROM pdf_objects s WHERE s.doc_id = o.doc_id AND s.contents_ref = o.ref AND s.type IN ('Sig', 'DocTimeStamp')) THEN 'signature' WHEN subtype IS NULL AND type IS NULL THEN 'content' END AS kind FROM pdf_objects o),
sums AS (SELECT doc_id, CAST(sum(size_bytes) + 7000 AS BIGINT) AS total, """ + ", ".join(f"CAST(coalesce(sum(size_bytes) FILTER (WHERE kind = '{k}'), 0) AS BIGINT) AS {k}" for k in ("image", "font", "signature", "content", "metadata")) + """,
  count(*) FILTER (WHERE kind = 'image') AS images, count(*) FILTER (WHERE kind = 'font' OR NOT is_stream AND type = 'Font') AS fonts, count(*) FILTER (WHERE NOT is_stream AND type = 'Sig') AS signatures FROM kinds GROUP BY doc_id),
broken AS (SELECT *, greatest(0, total - image - font - signature - content - metadata) AS other FROM sums)"""


def _broken(spark: SparkSession, d: str) -> DataFrame:
    """Files are 7000 bytes larger than their objects."""
    objects = _objects(spark, d)
    return O.breakdown(objects, objects.groupBy("doc_id").agg((F.sum("size_bytes") + 7000).alias("total")))


@query(f"WITH {CANDIDATES} SELECT doc_id, obj_no, size_bytes FROM candidates")
def image_candidates_anti(spark: SparkSession, d: str) -> DataFrame:
    return O.image_candidates(_objects(spark, d)).select("doc_id", "obj_no", "size_bytes")


@query(f"WITH {V.OBJECTS} SELECT doc_id, obj_no, size_bytes FROM pdf_objects o WHERE EXISTS (SELECT 1 FROM pdf_objects s WHERE s.doc_id = o.doc_id AND s.contents_ref = o.ref AND s.type = 'Sig')")
def signature_semi(spark: SparkSession, d: str) -> DataFrame:
    return O.signature_contents(_objects(spark, d)).select("doc_id", "obj_no", "size_bytes")


@query(f"WITH {KINDS} SELECT * FROM broken")
def structure_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d)


@query(f"""WITH {KINDS}, rows AS (SELECT doc_id, total, kind, bytes, CASE kind WHEN 'signature' THEN 0 WHEN 'font' THEN 1 WHEN 'image' THEN 2 WHEN 'content' THEN 3 WHEN 'metadata' THEN 4 ELSE 5 END AS i FROM broken UNPIVOT (bytes FOR kind IN (signature, font, image, content, metadata, other)))
SELECT doc_id, kind, bytes, bytes / total AS share, row_number() OVER (PARTITION BY doc_id ORDER BY bytes DESC, i) AS place FROM rows WHERE bytes > 0""")
def breakdown_share(spark: SparkSession, d: str) -> DataFrame:
    return O.shares(_broken(spark, d))


@query(f"""WITH {CANDIDATES}, n AS (SELECT *, size_bytes * (obj_no % 13) // 10 AS new_size, CASE last_filter WHEN 'DCTDecode' THEN 'jpeg' WHEN 'FlateDecode' THEN 'flate' ELSE 'other' END AS kind FROM candidates)
SELECT doc_id, count(*) AS found, count(*) FILTER (WHERE kind <> 'other' AND new_size < size_bytes) AS replaced, CAST(coalesce(sum(size_bytes - new_size) FILTER (WHERE kind <> 'other' AND new_size < size_bytes), 0) AS BIGINT) AS saved,
  count(*) FILTER (WHERE kind = 'jpeg') AS jpeg, count(*) FILTER (WHERE kind = 'flate') AS flate, count(*) FILTER (WHERE kind = 'other') AS skipped FROM n GROUP BY doc_id""")
def recompress_stats(spark: SparkSession, d: str) -> DataFrame:
    new = F.floor(F.col("size_bytes") * (F.col("obj_no") % 13) / 10)
    return O.recompress_stats(O.image_candidates(_objects(spark, d)), new)


@query(f"WITH {KINDS} SELECT doc_id, CASE WHEN signature > total * 0.3 THEN 'signatures' WHEN font > total * 0.3 THEN 'fonts' ELSE 'other' END AS reason, (total - image * 0.5) / total > 0.8 AS poor FROM broken")
def poor_result_reason(spark: SparkSession, d: str) -> DataFrame:
    b = _broken(spark, d)
    return b.select("doc_id", O.reason(F.col("total"), F.col("signature"), F.col("font")).alias("reason"), ((F.col("total") - F.col("image") * 0.5) / F.col("total") > 0.8).alias("poor"))


@query("SELECT p_partkey, first_value(p_partkey) OVER (PARTITION BY p_partkey % 5, p_type ORDER BY p_partkey) AS kept FROM part")
def duplicate_streams(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("long")
    streams = V.read(spark, d, "part").select((k % 5).alias("doc_id"), k.alias("obj_no"), F.col("p_type").alias("content"))
    return O.distinct_streams(streams).select(F.col("obj_no").alias("p_partkey"), "kept")


@query("""WITH o AS (SELECT p_partkey % 5 AS doc_id, p_partkey % 11 + 1 AS page_number, p_partkey AS op_idx, 80 + p_partkey % 8 AS opcode, CASE WHEN p_partkey % 9 > 0 THEN p_name END AS name FROM part),
t AS (SELECT *, max(page_number) OVER (PARTITION BY doc_id) AS total FROM o)
SELECT doc_id, page_number, row_number() OVER w AS number, 'doc' || doc_id || '_p' || lpad('' || page_number, CAST(length('' || total) AS INT), '0') || '_img' || row_number() OVER w || '.png' AS filename FROM t WHERE opcode IN (85, 86) AND name IS NOT NULL WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY op_idx)""")
def image_catalog(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("long")
    ops = V.read(spark, d, "part").select((k % 5).alias("doc_id"), (k % 11 + 1).alias("page_number"), k.alias("op_idx"), (80 + k % 8).alias("opcode"), F.when(k % 9 > 0, F.col("p_name")).alias("name"))
    return O.image_catalog(ops, F.concat(F.lit("doc"), "doc_id"))


FONTS = ("ABCDEF+Times-Bold", "Courier", "NotoSansCJK-It", "GHIJKL+MalgunGothic", "H2gtrB", "Sans Serif", "", "Batang,b", "ABCDE+Georgia-Italic", "Menlo-i")
FONT = "(CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FONTS)) + " END)"


@query(f"""WITH f AS (SELECT p_partkey, {FONT} AS base, regexp_replace({FONT}, '^[A-Z]{{6}}\\+', '') AS shown FROM part)
SELECT p_partkey, CASE WHEN shown = '' THEN '—' ELSE shown END AS shown, CASE WHEN regexp_matches(shown, '{text.MONO}', 'i') THEN 'mono' WHEN NOT regexp_matches(shown, 'sans', 'i') AND regexp_matches(shown, '{text.SERIF}', 'i') THEN 'serif' ELSE 'sans' END AS family,
  regexp_matches(shown, '{text.BOLD}', 'i') AS bold, regexp_matches(shown, '{text.ITALIC}', 'i') AS italic, regexp_matches(base, '{text.KOREAN_FONT}', 'i') AS korean FROM f""")
def font_describe(spark: SparkSession, d: str) -> DataFrame:
    base = F.get(F.array(*map(F.lit, FONTS)), (F.col("p_partkey") % 10).cast("int"))
    own = V.read(spark, d, "part").select("p_partkey", base.alias("base")).withColumn("f", text.describe_font(F.col("base")))
    return own.select("p_partkey", F.col("f.display_name").alias("shown"), "f.family", "f.bold", "f.italic", text.prefers_korean(F.lit("abc"), F.col("base"), F.lit(False)).alias("korean"))


@query(f"""WITH {V.ITEMS} SELECT doc_id, page_number, count(*) FILTER (WHERE item_idx % 50 = 7) AS images, count(*) FILTER (WHERE item_idx % 50 > 9 AND item_idx % 50 < 30) AS visible, count(*) FILTER (WHERE item_idx % 50 BETWEEN 31 AND 44) AS invisible, count(*) AS total,
  CASE WHEN max(item_idx) < 5 THEN CASE WHEN count(*) > 4 THEN 'scan' ELSE 'blank' END WHEN count(*) FILTER (WHERE item_idx % 50 BETWEEN 31 AND 44) > 0 AND count(*) FILTER (WHERE item_idx % 50 BETWEEN 31 AND 44) >= 4 * count(*) FILTER (WHERE item_idx % 50 > 9 AND item_idx % 50 < 30) THEN 'ocr-layer'
  WHEN count(*) FILTER (WHERE item_idx % 50 = 7) > 0 THEN 'mixed' ELSE 'text' END AS kind FROM text_items GROUP BY doc_id, page_number""")
def page_kind(spark: SparkSession, d: str) -> DataFrame:
    """Every 50 items: an image, text, a saved state with a hidden mode and text in it, and back."""
    i = F.col("item_idx") % 50
    op = F.when(i == 7, "image").when(i == 9, "save").when((i > 9) & (i < 30), "text").when(i == 30, "mode").when((i > 30) & (i < 45), "text").when(i == 45, "restore").otherwise("path")
    ops = V.items(spark, d).select("doc_id", "page_number", F.col("item_idx").alias("op_idx"), op.alias("op"), F.when(i == 30, 3).alias("arg"))
    chars = F.when(F.col("total") > 5, F.col("total")).otherwise(0)
    return O.page_kind(O.count_operators(ops).withColumn("chars", chars)).drop("chars")
