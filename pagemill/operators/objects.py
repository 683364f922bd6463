"""Stored objects of files: image candidates, signatures, sizes by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What marks a font stream.
FONT_TYPES = ("Font", "FontDescriptor")
FONT_SUBTYPES = ("CIDFontType0C", "CIDFontType2", "Type1C", "OpenType")
SIGNATURES = ("Sig", "DocTimeStamp")


def companions(objects: DataFrame, file: str = "doc_id") -> DataFrame:
    """References to alpha channels, for each file: what some object of it names as its mask."""
    return objects.select(file, F.explode(F.array_compact(F.array("smask_ref", "mask_ref"))).alias("ref")).distinct()


def image_candidates(objects: DataFrame, file: str = "doc_id") -> DataFrame:
    """References count inside their file only."""
    return objects.where("subtype = 'Image'").join(companions(objects, file), [file, "ref"], "left_anti")


def signed(objects: DataFrame, file: str = "doc_id") -> DataFrame:
    """References to what some signature of the file names as its contents."""
    return objects.where(F.col("type").isin(*SIGNATURES) & F.col("contents_ref").isNotNull()).select(file, F.col("contents_ref").alias("ref")).distinct()


def signature_contents(objects: DataFrame, file: str = "doc_id") -> DataFrame:
    return objects.join(signed(objects, file), [file, "ref"], "left_semi")


def category(is_signature: Column) -> Column:
    """The first that fits: image, font, metadata, signature, untyped content, other."""
    t, s = F.col("type"), F.col("subtype")
    font = t.isin(*FONT_TYPES) | s.isin(*FONT_SUBTYPES)
    return (
        F.when(s == "Image", "image").when(font, "font").when((s == "XML") | (t == "Metadata"), "metadata")
        .when((t == "Sig") | is_signature, "signature").when(s.isNull() & t.isNull(), "content").otherwise("other")
    )


def breakdown(objects: DataFrame, totals: DataFrame | None = None, file: str = "doc_id") -> DataFrame:
    """One row for each file: bytes and counts by kind; `other` is what no kind takes of the file's size.

    Only streams have a kind; signature dictionaries count with their own bytes, font dictionaries in the
    number of fonts only. totals: (file, total) sizes of the files; without it the objects' sum.
    Without a column `is_stream` all objects but signatures are streams.
    """
    if "is_stream" not in objects.columns:
        objects = objects.withColumn("is_stream", ~F.coalesce(F.col("type").isin(*SIGNATURES), F.lit(False)))
    flagged = objects.join(signed(objects, file).withColumn("signed", F.lit(True)), [file, "ref"], "left")
    dictionary, signature = ~F.col("is_stream"), F.col("type").isin(*SIGNATURES)
    kind = F.when(dictionary, F.when(signature, "signature")).otherwise(category(F.coalesce("signed", F.lit(False))))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("size_bytes"))), F.lit(0))
    kinds = ("image", "font", "signature", "content", "metadata")
    out = flagged.withColumn("kind", kind).groupBy(file).agg(
        F.sum("size_bytes").alias("total"), *(of(k).alias(k) for k in kinds), F.count_if(F.col("kind") == "image").alias("images"),
        F.count_if((F.col("kind") == "font") | (dictionary & (F.col("type") == "Font"))).alias("fonts"), F.count_if(dictionary & signature).alias("signatures"),
    )
    if totals is not None:
        out = out.drop("total").join(totals.select(file, "total"), file)
    return out.withColumn("other", F.greatest(F.lit(0), F.col("total") - sum(F.col(k) for k in kinds)))


def shares(broken: DataFrame) -> DataFrame:
    """Rows (doc_id, kind, bytes, share, place): kinds that hold something, the largest first."""
    kinds = ("signature", "font", "image", "content", "metadata", "other")
    rows = broken.select("doc_id", "total", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("bytes"), F.lit(i).alias("i")) for i, k in enumerate(kinds))))).where("bytes > 0")
    order = Window.partitionBy("doc_id").orderBy(F.desc("bytes"), "i")
    return rows.select("doc_id", "kind", "bytes", (F.col("bytes") / F.col("total")).alias("share"), F.row_number().over(order).cast("long").alias("place"))


def filter_kind(last: Column) -> Column:
    return F.when(last == "DCTDecode", "jpeg").when(last == "FlateDecode", "flate").otherwise("other")


def recompress_stats(candidates: DataFrame, new_size: Column) -> DataFrame:
    """What recompression would do: an image is replaced only by fewer bytes; other filters are skipped."""
    kind = filter_kind(F.col("last_filter"))
    won = (kind != "other") & (new_size < F.col("size_bytes"))
    return candidates.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(won).alias("replaced"), F.coalesce(F.sum(F.when(won, F.col("size_bytes") - new_size)), F.lit(0)).alias("saved"),
        F.count_if(kind == "jpeg").alias("jpeg"), F.count_if(kind == "flate").alias("flate"), F.count_if(kind == "other").alias("skipped"),
    )


def reason(total: Column, signature: Column, font: Column) -> Column:
    return F.when(signature > total * 0.3, "signatures").when(font > total * 0.3, "fonts").otherwise("other")


def image_catalog(operations: DataFrame, base: Column) -> DataFrame:
    """operations: (doc_id, page_number, op_idx, opcode, name). Painted images (opcodes 85 and 86), numbered on each page and named."""
    painted = operations.where(F.col("opcode").isin(85, 86) & F.col("name").isNotNull())
    order = Window.partitionBy("doc_id", "page_number").orderBy("op_idx")
    pages = operations.groupBy("doc_id").agg(F.max("page_number").alias("total"))
    n = painted.join(pages, "doc_id").withColumn("number", F.row_number().over(order).cast("long"))
    p, all_ = F.col("page_number").cast("string"), F.length(F.col("total").cast("string"))
    return n.select("doc_id", "page_number", "number", F.concat(base, F.lit("_p"), F.lpad(p, F.greatest(all_, F.length(p)), F.lit("0")), F.lit("_img"), "number", F.lit(".png")).alias("filename"))


def distinct_streams(objects: DataFrame, content: str = "content") -> DataFrame:
    """Each object with the first object of equal bytes, by digest."""
    same = Window.partitionBy("doc_id", F.sha2(F.col(content).cast("binary"), 256)).orderBy("obj_no")
    return objects.withColumn("kept", F.first("obj_no").over(same))


def page_kind(pages: DataFrame) -> DataFrame:
    """pages: (..., chars, images, visible, invisible, total) of each page. What sort of page it is."""
    kind = F.when(F.col("chars") == 0, F.when(F.col("total") > 4, "scan").otherwise("blank")).when((F.col("invisible") > 0) & (F.col("invisible") >= 4 * F.col("visible")), "ocr-layer").when(F.col("images") > 0, "mixed").otherwise("text")
    return pages.withColumn("kind", kind)


#: Text rendering modes that draw nothing.
INVISIBLE = (3, 7)


def count_operators(operations: DataFrame) -> DataFrame:
    """operations: (doc_id, page_number, op_idx, op, arg); op is save, restore, mode (arg), text, image or another. Counts for each page.

    The rendering mode is a stack: an array folded with the operations of the page in their order.
    """
    state = "struct<mode:int,stack:array<int>,images:bigint,visible:bigint,invisible:bigint>"
    start = F.struct(F.lit(0).alias("mode"), F.array().cast("array<int>").alias("stack"), *(F.lit(0).cast("long").alias(k) for k in ("images", "visible", "invisible"))).cast(state)

    def step(s: Column, o: Column) -> Column:
        top = F.coalesce(F.get(s["stack"], F.size(s["stack"]) - 1), F.lit(0))
        hidden = s["mode"].isin(*INVISIBLE)
        one = lambda name, when: (s[name] + F.when(when, 1).otherwise(0)).alias(name)
        mode = F.when(o["op"] == "restore", top).when(o["op"] == "mode", F.coalesce(o["arg"], F.lit(0))).otherwise(s["mode"])
        stack = F.when(o["op"] == "save", F.concat(s["stack"], F.array(s["mode"]))).when(o["op"] == "restore", F.slice(s["stack"], F.lit(1), F.greatest(F.size(s["stack"]) - 1, F.lit(0)))).otherwise(s["stack"])
        return F.struct(mode.cast("int").alias("mode"), stack.alias("stack"), one("images", o["op"] == "image"), one("visible", (o["op"] == "text") & ~hidden), one("invisible", (o["op"] == "text") & hidden)).cast(state)

    ops = operations.groupBy("doc_id", "page_number").agg(F.sort_array(F.collect_list(F.struct("op_idx", "op", F.col("arg").cast("int").alias("arg")))).alias("ops"))
    return ops.withColumn("s", F.aggregate("ops", start, step)).select("doc_id", "page_number", "s.images", "s.visible", "s.invisible", F.size("ops").cast("long").alias("total"))
