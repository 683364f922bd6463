"""Results as texts, Markdown, Word paragraphs, sheets and slides, and writers of the files themselves."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import layout as L


def page_text(items: DataFrame) -> DataFrame:
    """The lines of each page from the top, one a line."""
    lines = L.line_text(items).withColumn("down", -F.col("yk"))
    return lines.groupBy("doc_id", "page_number").agg(F.array_join(L.in_order("text", "down"), "\n").alias("text"))


def plain_text(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Trimmed pages that aren't empty, joined in order."""
    full = pages.withColumn("text", F.trim("text")).where("text != ''")
    return full.groupBy("doc_id").agg(F.array_join(L.in_order("text", "page_number"), separator).alias("text"))


def markdown_docs(md: DataFrame, every_page: DataFrame | None = None) -> DataFrame:
    """every_page: (doc_id, page_number); pages of it without a line say so."""
    pages = md.groupBy("doc_id", "page_number").agg(F.array_join(L.in_order(F.concat("md", F.lit("\n\n")), "seq"), "").alias("md"))
    if every_page is not None:
        pages = every_page.join(pages, ["doc_id", "page_number"], "left")
    pages = pages.select("doc_id", "page_number", F.concat(F.lit("## Page "), F.col("page_number"), F.lit("\n\n"), F.coalesce("md", F.lit("_(empty)_\n\n"))).alias("md"))
    return pages.groupBy("doc_id").agg(F.concat(F.lit("# doc"), F.col("doc_id"), F.lit("\n\n"), F.array_join(L.in_order("md", "page_number"), "")).alias("md"))


def blank_sheets(pages: DataFrame) -> DataFrame:
    """pages: (doc_id, page_number, n items). The sheets of pages without items."""
    return pages.where("n = 0").select("doc_id", "page_number")


def sheet_cells(cells: DataFrame, pages: DataFrame) -> DataFrame:
    """Cells of all pages' sheets; a page without items has one that says so. pages: (doc_id, page_number, n items)."""
    zero = F.lit(0).cast("long")
    return cells.unionByName(blank_sheets(pages).select("doc_id", "page_number", zero.alias("row"), zero.alias("col"), F.lit("(empty page)").alias("value")))


def docx_paragraphs(lines: DataFrame, every_page: DataFrame) -> DataFrame:
    """Rows (doc_id, seq, kind, text) of a Word document: title, then for each page, blank ones too, a break (but the first), its number, and its lines."""
    body = lines.withColumn("text", F.trim("text")).where("text != ''").select("doc_id", "page_number", "yk", L.heading(F.col("size"), F.col("median")).alias("kind"), "text")
    pages = every_page.select("doc_id", "page_number")
    row = lambda df, place, down, kind, text: df.select("doc_id", "page_number", F.lit(place).alias("place"), down.cast("long").alias("down"), kind.alias("kind"), text.alias("text"))
    none, zero = F.lit(""), F.lit(0)
    titles = row(pages.where("page_number = 1").select("doc_id", F.lit(0).cast("long").alias("page_number")), 0, zero, F.lit("title"), F.concat(F.lit("doc"), F.col("doc_id")))
    parts = titles.union(row(pages.where("page_number > 1"), 1, zero, F.lit("break"), none)).union(row(pages, 2, zero, F.lit("page"), F.concat(F.lit("Page "), F.col("page_number")))).union(row(body, 3, -F.col("yk"), F.col("kind"), F.col("text")))
    order = Window.partitionBy("doc_id").orderBy("page_number", "place", "down")
    return parts.select("doc_id", F.row_number().over(order).cast("long").alias("seq"), "kind", "text")


def workbook_sheets(pages: DataFrame) -> DataFrame:
    """A sheet for each page, blank ones too, names cut at 31 characters, and `_About` last."""
    named = pages.select("doc_id", "page_number", F.left(F.concat(F.lit("Page "), F.col("page_number")), F.lit(31)).alias("sheet"))
    about = pages.where("page_number = 1").select("doc_id", F.lit(1 << 62).alias("page_number"), F.lit("_About").alias("sheet"))
    return named.union(about).select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number")).cast("long").alias("ordinal"), "sheet")


def slides(sizes: DataFrame, width: float = 10.0) -> DataFrame:
    """A slide for each page, as wide as given and as high as the first page's shape tells."""
    w = Window.partitionBy("doc_id").orderBy("page_number")
    return sizes.select("doc_id", "page_number", F.lit(width).alias("slide_w"), (width / (F.first("w").over(w) / F.first("h").over(w))).alias("slide_h"))


_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{}</Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_REL = '<Relationship Id="rId{}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/>'


def _zipped(files: dict[str, str], method: int = zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name), data, method)
    return out.getvalue()


def docx_bytes(rows: list[tuple[str, str]]) -> bytes:
    """A Word file of (kind, text) paragraphs."""
    style = {"title": ('<w:pStyle w:val="Heading1"/><w:jc w:val="center"/>', "<w:b/>"), "page": ('<w:pStyle w:val="Heading2"/>', ""), "heading": ('<w:pStyle w:val="Heading3"/>', ""), "bold": ("", "<w:b/>"), "body": ("", '<w:sz w:val="22"/>')}
    said = []
    for kind, text in rows:
        if kind == "break":
            said.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        else:
            p, r = style[kind]
            said.append(f'<w:p><w:pPr>{p}</w:pPr><w:r><w:rPr>{r}</w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>')
    body = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{"".join(said)}</w:body></w:document>'
    kind = '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'
    return _zipped({"[Content_Types].xml": _TYPES.format(kind), "_rels/.rels": _RELS.format(_REL.format(1, "officeDocument", "word/document.xml")), "word/document.xml": body})


def xlsx_bytes(sheets: list[tuple[str, list[list[str]]]]) -> bytes:
    """An Excel file of (name, rows of cells) sheets, with strings in place."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    files, types = {}, '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    for k, (_, rows) in enumerate(sheets, 1):
        cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in r) + "</row>" for r in rows)
        files[f"xl/worksheets/sheet{k}.xml"] = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>'
        types += f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
    names = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, (n, _) in enumerate(sheets, 1))
    book = f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>'
    rels = _RELS.format("".join(_REL.format(k, "worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(sheets) + 1)))
    return _zipped({"[Content_Types].xml": _TYPES.format(types), "_rels/.rels": _RELS.format(_REL.format(1, "officeDocument", "xl/workbook.xml")), "xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, **files})


def docx_files(paragraphs: DataFrame) -> DataFrame:
    """Rows (doc_id, content): the Word file of each document, from `docx_paragraphs`."""

    def one(doc: pd.DataFrame) -> pd.DataFrame:
        doc = doc.sort_values("seq")
        return pd.DataFrame({"doc_id": [doc["doc_id"].iat[0]], "content": [docx_bytes(list(zip(doc["kind"], doc["text"], strict=True)))]})

    return paragraphs.groupBy("doc_id").applyInPandas(one, "doc_id long, content binary")


def xlsx_files(cells: DataFrame) -> DataFrame:
    """Rows (doc_id, content): the Excel file of each document, from `layout.table_cells`."""

    def one(doc: pd.DataFrame) -> pd.DataFrame:
        sheets = []
        for page, own in doc.groupby("page_number", sort=True):
            grid = [[""] * (int(own["col"].max()) + 1) for _ in range(int(own["row"].max()) + 1)]
            for r, c, v in zip(own["row"], own["col"], own["value"], strict=True):
                grid[int(r)][int(c)] = v
            sheets.append((f"Page {page}"[:31], grid))
        sheets.append(("_About", [["Cells found by their places on the page."]]))
        return pd.DataFrame({"doc_id": [doc["doc_id"].iat[0]], "content": [xlsx_bytes(sheets)]})

    return cells.groupBy("doc_id").applyInPandas(one, "doc_id long, content binary")


def zip_files(files: DataFrame, by: str = "archive") -> DataFrame:
    """files: (archive, name, content). Rows (archive, content): uncompressed zip files, names in order."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("name")
        return pd.DataFrame({by: [part[by].iat[0]], "content": [_zipped(dict(zip(part["name"], part["content"], strict=True)), zipfile.ZIP_STORED)]})

    return files.groupBy(by).applyInPandas(one, f"{by} string, content binary")


def write_text(pages: DataFrame, path: str, each_page: bool = False) -> None:
    """Texts by document, one file each page or each document's pages in one row of its partition."""
    out = pages if each_page else plain_text(pages)
    out.write.partitionBy(*(["doc_id", "page_number"] if each_page else ["doc_id"])).mode("overwrite").text(path)
