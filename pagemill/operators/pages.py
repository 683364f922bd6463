"""Pages of files as rows: merging, splitting, turning, reordering and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import page_range


def merge(pages: DataFrame, ordinal: str = "doc_id", group: str = "merged") -> DataFrame:
    """Pages of the files of each group, file after file, numbered anew.

    Files' numbers of pages are summed up before their pages are numbered, so a group of many files meets as one row
    for each file only.
    """
    file = (group, ordinal)
    files = pages.groupBy(*file).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(*file, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy(*file).orderBy("page_number"))
    return pages.withColumn("__own", own).join(starts, list(file)).withColumn("new_page", (F.col("__start") + F.col("__own")).cast("long")).drop("__start", "__own")


def split_every(files: DataFrame, every: int) -> DataFrame:
    """files: (doc_id, total, name). Rows (doc_id, part, name, page_number): runs of `every` pages."""
    pages = files.where("total >= 1").select("doc_id", "name", F.explode(F.sequence(F.lit(1), F.col("total").cast("int"))).alias("page_number"))
    part = F.floor((F.col("page_number") - 1) / every) + 1
    return pages.select("doc_id", part.alias("part"), F.concat("name", F.lit("_part_"), part, F.lit(".pdf")).alias("name"), F.col("page_number").cast("long").alias("page_number"))


def split_ranges(files: DataFrame) -> DataFrame:
    """files: (doc_id, total, name, ranges). One part for each range between semicolons; none at all if any is wrong or empty."""
    said = F.filter(F.transform(F.split("ranges", ";"), lambda r: F.trim(r)), lambda r: r != "")
    groups = files.withColumn("groups", F.transform(said, lambda r: page_range(r, F.col("total"))))
    good = groups.where(F.forall("groups", lambda g: F.coalesce(F.size(g) > 0, F.lit(False))))
    parts = good.select("doc_id", "name", F.posexplode("groups").alias("k", "pages"))
    return parts.select("doc_id", (F.col("k") + 1).cast("long").alias("part"), F.concat("name", F.lit("_part_"), F.col("k") + 1, F.lit(".pdf")).alias("name"), F.explode(F.col("pages").cast("array<long>")).alias("page_number"))


def rotate(pages: DataFrame, by: int, chosen: Column | None = None) -> DataFrame:
    turned = F.pmod(F.col("angle") + by, F.lit(360))
    return pages.withColumn("angle", turned if chosen is None else F.when(chosen, turned).otherwise(F.col("angle")))


def reorder(pages: DataFrame, orders: DataFrame) -> DataFrame:
    """orders: (doc_id, new_order array). Pages in the given order; those left out go, repeated ones come again."""
    wanted = orders.select("doc_id", F.posexplode("new_order").alias("pos", "page_number")).select("doc_id", (F.col("pos") + 1).cast("long").alias("new_page"), F.col("page_number").cast("long").alias("page_number"))
    return wanted.join(pages, ["doc_id", "page_number"])


def read_metadata(files: DataFrame) -> DataFrame:
    """Missing texts are empty, dates are ISO 8601 or null."""
    texts = ("title", "author", "subject", "keywords", "creator", "producer")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return files.withColumns({c: F.coalesce(c, F.lit("")) for c in texts if c in files.columns} | {c: iso(c) for c in ("created", "modified") if c in files.columns})


def keyword_list(keywords: Column) -> Column:
    return F.when(keywords == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(keywords, ","), lambda k: F.trim(k)))


def accepted(name: Column, mime: Column, extension: str = ".pdf", kind: str = "application/pdf") -> Column:
    return F.coalesce(mime == kind, F.lit(False)) | F.lower(name).endswith(extension)


def written_metadata(files: DataFrame, now: Column | None = None) -> DataFrame:
    """Files with keywords as a list (trimmed; none of an empty text) and the time of writing as their modification."""
    return files.withColumns({"keywords": keyword_list(F.coalesce("keywords", F.lit(""))), "modified": F.current_timestamp() if now is None else now})


def kept_order(pages: DataFrame) -> DataFrame:
    """pages: (doc_id, page_number, place, removed). Rows (doc_id, new_order) of the pages that stay, by place; a file must keep one at least, or it is left out."""
    left = pages.where("NOT removed").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "page_number"))), lambda s: s["page_number"]).alias("new_order"))
    return left.where(F.size("new_order") > 0)


def swapped(order: Column, at: Column, by: int) -> Column:
    """A list with the element at a place (from 0) moved by one; as it is at its ends."""
    to = at + by
    inside = (at >= 0) & (at < F.size(order)) & (to >= 0) & (to < F.size(order))
    return F.when(inside, F.transform(order, lambda v, i: F.when(i == at, F.get(order, to)).when(i == to, F.get(order, at)).otherwise(v))).otherwise(order)


def grouped(rows: DataFrame, category: str, value: str, order: list[str], *within: str) -> DataFrame:
    """Rows (within, category, values, place): values by category, of each group named by `within`, in the order they come (by `value`), categories in a fixed order, unknown ones left out."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(category))
    return rows.where(place > 0).groupBy(*within, category).agg(F.sort_array(F.collect_list(value)).alias("values")).select(*within, F.col(category).alias("category"), "values", place.alias("place"))
