"""Secret scans by multipart credential linking, in DataFrame functions only.

Strong spans (`assign`, `access`, `hex`) are always reported. Weak candidates are an account name
(`ident`), a mixed-case key (`key`) and an address (`url`). A weak candidate is reported only when
a complementary part lies in the same scope and at most `reach` code points away. Scopes are the
stretches between blank lines. Complements: identifiers (`access`, `ident`) with secrets (`assign`,
`hex`, `key`), and addresses with either.

The interval join runs as two as-of passes over the parts of a document, ordered by position: the
running latest end of each role before a candidate, and the running earliest start after it. A
document with many parts so costs a sort, never all pairs of its parts.

Positions come without a Python function: a pattern's matches and the gaps between them alternate,
so a start is the running sum of their lengths in code points. `split` and `regexp_extract_all`
run the same Java pattern, hence one more gap than matches.

Defined cases: a null text is an empty one; a text without spans gives one row with counts of zero
and the digest of the empty string; rows repeated in the input are repeated in the output; ties in
position go by kind in the order listed; only the id and text columns are read, so further columns
of any name neither clash nor matter; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import repeat, text_or_empty

#: The base patterns and the least lengths of what they find.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Weak candidates. A key is a whole run of 20 or more with a digit, a small and a capital letter.
IDENT = r"""(?i:user(?:_?name)?|login|account(?:_?id)?|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
KEY = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}"
URL = r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+"
BREAK = r"\n[\x20\t\r]*\n\s*"

#: Kinds in the order that ties take.
KINDS = ("assign", "access", "hex", "ident", "key", "url")
BASE = KINDS[:3]
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": r"[0-9a-f]{16,}", "ident": IDENT, "key": KEY, "url": URL, "break": BREAK}
ROLE = {"access": "id", "ident": "id", "assign": "secret", "hex": "secret", "key": "secret", "url": "endpoint"}
WANTS = {"id": ("secret", "endpoint"), "secret": ("id", "endpoint"), "endpoint": ("id", "secret")}
MARK = "[SECRET]"


def _found(text: Column, kind: str) -> Column:
    """A row for each match: kind, number, length of the gap before it, its length, and whether it counts."""
    pattern = F.lit(PATTERNS[kind])
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    enough = (lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST["assign"]) if kind == "assign" else (lambda m: F.char_length(m) >= LEAST[kind]) if kind in LEAST else (lambda m: F.lit(True))
    row = lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.char_length(z["gap"]).alias("gap"), F.char_length(z["match"]).alias("length"), enough(z["match"]).alias("counts"))
    rows = F.transform(F.arrays_zip(F.slice(F.split(text, PATTERNS[kind], -1), 1, F.size(matches)).alias("gap"), matches.alias("match")), row)
    return F.when(F.regexp_like(text, pattern), rows).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,length:int,counts:boolean>>"))


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, copies, kind, start, end) of all candidates, and one of kind `doc` for each different document."""
    text = text_or_empty(text_col)
    doc = F.array(F.struct(F.lit("doc").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(0).alias("length"), F.lit(True).alias("counts")))
    weak = F.concat(*(_found(F.col("t"), k) for k in KINDS[3:]))
    found = (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
        .select("doc_id", F.sha2("t", 256).alias("text_hash"), "t", F.concat(doc, *(_found(F.col("t"), k) for k in BASE)).alias("base"), weak.alias("weak"))
        .select("doc_id", "text_hash", "base", F.when(F.size("weak") > 0, F.concat("weak", _found(F.col("t"), "break"))).otherwise(F.col("weak")).alias("weak"))
        .groupBy("doc_id", "text_hash")
        .agg(F.count(F.lit(1)).alias("copies"), F.first(F.concat("base", "weak")).alias("parts"))
        .select("doc_id", "text_hash", "copies", F.inline("parts"))
    )
    so_far = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("length")).over(so_far)
    return found.withColumn("end", end).where("counts").select("doc_id", "text_hash", "copies", "kind", (F.col("end") - F.col("length")).alias("start"), "end")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """Rows (doc_id, text_hash, copies, kind, start, end) of the reported spans, and one of kind `doc` for each document."""
    doc, kind = ("doc_id", "text_hash"), F.col("kind")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), kind)
    before = Window.partitionBy(*doc).orderBy("start", "end", rank).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*doc).orderBy(F.desc("start"), F.desc("end"), F.desc(rank)).rowsBetween(Window.unboundedPreceding, -1)
    is_base = kind.isin(*BASE)
    role = reduce(lambda c, k: c.when(kind == k, ROLE[k]), KINDS, F.when(F.lit(False), "")).otherwise(None)
    placed = parts(docs, id_col, text_col).withColumns({
        "role": role,
        "scope": F.coalesce(F.count_if(kind == "break").over(before), F.lit(0)),
        "inside": F.coalesce(F.max(F.when(is_base, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(is_base, F.col("start"))).over(after) < F.col("end"), F.lit(False)),
    }).where(is_base | (kind == "doc") | ((kind != "break") & ~F.col("inside")))
    scope = (*doc, "scope")
    left = Window.partitionBy(*scope).orderBy("start", "end", rank).rowsBetween(Window.unboundedPreceding, -1)
    right = Window.partitionBy(*scope).orderBy(F.desc("start"), F.desc("end"), F.desc(rank)).rowsBetween(Window.unboundedPreceding, -1)
    near = lambda r: F.coalesce(F.max(F.when(F.col("role") == r, F.col("end"))).over(left) >= F.col("start") - reach, F.lit(False)) | F.coalesce(F.min(F.when(F.col("role") == r, F.col("start"))).over(right) <= F.col("end") + reach, F.lit(False))
    near_by = placed.withColumns({f"by_{r}": near(r) for r in WANTS})
    linked = reduce(lambda c, r: c | ((F.col("role") == r) & (F.col(f"by_{WANTS[r][0]}") | F.col(f"by_{WANTS[r][1]}"))), WANTS, F.lit(False))
    return near_by.where(is_base | (kind == "doc") | linked).select(*doc, "copies", "kind", "start", "end")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, and `found`, an array of (start, rank, kind, end) in order."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    found = spans(docs, id_col, text_col, reach).groupBy("doc_id", "text_hash", "copies").agg(F.sort_array(F.collect_list(F.when(F.col("kind") != "doc", F.struct("start", rank.alias("rank"), "kind", "end")))).alias("found"))
    return repeat(found, "copies")


def report(scanned: DataFrame) -> DataFrame:
    """Counts, digest of the strong spans and the list of all, from `scan`."""
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", *(count(k) for k in BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"), *(count(k) for k in KINDS[3:]))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200, mark: str = MARK) -> DataFrame:
    """docs with every reported span of the text replaced by a mark (overlapping ones by one mark); all rows stay, a null text stays null."""
    doc = ("doc_id", "text_hash")
    before = Window.partitionBy(*doc).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        spans(docs, id_col, text_col, reach)
        .where("kind != 'doc'")
        .withColumn("past", F.coalesce(F.max("end").over(before), F.lit(0)))
        .where("end > past")
        .groupBy(*doc)
        .agg(F.sort_array(F.collect_list(F.struct(F.greatest("start", "past").cast("int").alias("start"), F.col("end").cast("int").alias("end"), (F.col("start") < F.col("past")).alias("goes_on")))).alias("cuts"))
    )
    # Fixed-width code units, so that a piece is cut out without walking the text from its start.
    piece = lambda a, b: F.decode(F.substring(F.col("__units"), 4 * a + 1, 4 * (b - a)), "UTF-32")
    kept = F.transform("__cuts", lambda s, i: F.concat(piece(F.when(i == 0, 0).otherwise(F.get("__cuts", i - 1)["end"]), s["start"]), F.when(s["goes_on"], "").otherwise(mark)))
    last = F.element_at("__cuts", -1)["end"]
    cleaned = F.concat(F.array_join(kept, ""), piece(last, F.char_length(text_col)))
    keys = cuts.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("cuts").alias("__cuts"))
    there = docs.withColumn("__own", F.sha2(text_or_empty(text_col), 256)).join(keys, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left")
    return there.withColumn("__units", F.when(F.col("__cuts").isNotNull(), F.encode(text_col, "UTF-32"))).withColumn(text_col, F.when(F.col("__cuts").isNotNull(), cleaned).otherwise(F.col(text_col))).select(*docs.columns)
