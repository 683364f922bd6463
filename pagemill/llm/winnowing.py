"""Document fingerprints by winnowing, in DataFrame functions only.

A text's code points (lower case, without white space) are taken in runs of `k`, every run is hashed, and
of every `window` runs in a row the least hash is chosen, the rightmost of equal ones. The chosen ones keep
their position (the number of their first code point). Two texts that share `window + k - 1` code points
in a row share a chosen hash, in any script, with spaces or without; runs shorter than `k` are never compared.

A mark is one number: 33 bits of the run's hash above its place, which is counted from the end, so the
least number of a window is the rightmost of its least hashes; runs whose hashes agree in these bits are
equal ones. Minima over 4, 16, ... neighbours come each from four of the former. Texts are cut into pieces
of bounded length that overlap by one window, so arrays don't grow with a text. Runs are hashed one by
one (a hash that rolls would need a sum over the array before each run).

The edited text's marks are put together from those of its parts. A mark of a text is chosen from a window
on that its place and the mark before tell, so marks that windows inside a part choose are known; only
the windows across the cut are hashed anew.

Rows are dealt by ranges of ids, every range with the first document of the next one as a guest, so that
each document meets the next in its own task.

Defined cases: a null text is an empty one; no code points give no marks; fewer than `k` give one run
of all of them, fewer than `window` runs one window; equal texts have equal fingerprints (as have
texts that differ in case or white space only); a final sigma is as any other, so that a part reads
alike by itself; likeness is the Jaccard index of the chosen hashes, 1 for two texts without any; repeated
rows stay; null ids come after all others; only the id and text columns are read; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

K = 16
WINDOW = 32
_AT = (1 << 31) - 1
_PIECE = 1024


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _bound(x: Column, f) -> Column:
    """f of a value that is computed once. A column would be put into the inner lambdas and computed for each run."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def points(text: Column) -> Column:
    """Lower-case code points without white space, four bytes each."""
    out = F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3"))
    for blank in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(blank), F.lit(""))
    return F.encode(out, "UTF-32")


def place(mark: Column) -> Column:
    return (_AT - mark.bitwiseAND(_AT)).cast("int")


def _count(p: Column) -> Column:
    return (F.octet_length(p) / 4).cast("int")


def _part(p: Column, start: Column | int, n: Column | int) -> Column:
    return F.substring(p, start * 4 + 1, (F.lit(n) if isinstance(n, int) else n) * 4)


def _packed(p: Column, start: Column, k: int) -> Column:
    """A number for each run of a piece that begins at `start` of its text."""
    first, runs = (_AT - start).cast("long"), F.greatest(_count(p) - k, F.lit(0)).cast("long")
    one = lambda v, i: F.xxhash64(F.substring(p, i * 4 + 1, F.lit(4 * k))).bitwiseAND(-1 << 31).bitwiseOR(v)
    return F.transform(F.sequence(first, first - runs, F.lit(-1).cast("long")), one)


def _minima(r: Column, window: int) -> Column:
    """The least number of every `window` neighbours, of fewer the least of all."""
    steps, wide = [], 1
    while wide < window:
        steps.append([min(j * wide, window - wide) for j in range(1, min(4, -(-window // wide)))])
        wide += steps[-1][-1]

    def next_(a: Column, left: list[list[int]]) -> Column:
        if not left:
            return F.slice(a, F.lit(1), F.size(r) - (window - 1))
        return _bound(F.transform(a, lambda x, i: F.least(x, *(F.get(a, i + j) for j in left[0]))), lambda b: next_(b, left[1:]))

    return F.when(F.size(r) >= window, next_(r, steps)).otherwise(F.array(F.array_min(r)))


def marks_of(p: Column, k: int, window: int) -> Column:
    """The marks of points, in order."""
    reach = k + window - 1
    piece = lambda s: _bound(_part(p, s, _PIECE + reach - 1), lambda x: _bound(_packed(x, s, k), lambda r: F.array_distinct(_minima(r, window))))
    starts = F.sequence(F.lit(0), F.greatest(_count(p) - reach, F.lit(0)), F.lit(_PIECE))
    return F.when(F.octet_length(p) > 0, F.array_distinct(F.flatten(F.transform(starts, piece)))).otherwise(_none())


def _inside(marks: Column, last: Column, window: int) -> Column:
    """Of a text's marks those that a window beginning at `last` or before chooses."""
    def begins(m: Column, i: Column) -> Column:
        before = F.get(marks, i - 1)
        return F.when(i == 0, 0).when(m < before, place(m) - (window - 1)).otherwise(place(before) + 1)

    return F.filter(marks, lambda m, i: begins(m, i) <= last)


def _joined(one: Column, marks_one: Column, a: Column, two: Column, marks_two: Column, b: Column, k: int, window: int) -> Column:
    """The marks of the first a points of one text and the first b of another, from the marks of both texts."""
    reach = k + window - 1
    first = F.greatest(a - (reach - 1), F.lit(0))
    across = F.concat(_part(one, first, a - first), _part(two, 0, F.least(b, F.lit(reach - 1))))
    short = (a < reach) & (b < reach)
    moved = lambda marks, by: F.transform(marks, lambda m: m - by)
    own = F.when(a >= reach, _inside(marks_one, a - reach, window)).otherwise(_none())
    new = F.when(b >= reach, moved(_inside(marks_two, b - reach, window), a)).otherwise(_none())
    middle = _bound(across, lambda x: F.when((_count(x) >= reach) | short, moved(marks_of(x, k, window), first)).otherwise(_none()))
    return F.array_distinct(F.concat(own, middle, new))


def with_marks(df: DataFrame, text_col: str, to: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """df with the column `to`: the marks of the text, array<long>; `place` tells where a mark is, its upper bits are the hash."""
    return df.withColumn(to, _bound(points(text_or_empty(text_col)), lambda p: marks_of(p, k, window)))


def hashes(marks: Column) -> Column:
    return F.array_distinct(F.transform(marks, lambda m: F.shiftright(m, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of different hashes."""
    return _bound(F.size(F.array_intersect(a, b)), lambda both: F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(1.0))


def digest(marks: Column) -> Column:
    return F.sha2(F.array_join(marks.cast("array<string>"), ","), 256)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunks: int | None = None) -> DataFrame:
    """Rows (doc_id, text, guest, chunk), dealt by chunk: stretches of ascending ids, each with the first of the next stretch as its guest.

    The bounds of the stretches are approximate quantiles of the ids; they and the first id of each
    stretch, `chunks` numbers (four for each shuffle partition), are all that the driver sees.
    """
    spark = docs.sparkSession
    chunks = chunks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / chunks for i in range(1, chunks)] or [0.5], 10_000)).first()[0]
    bounds = sorted(set(cuts or []))
    said = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    # Binary search for the number of bounds that aren't above the id.
    steps = F.array(*(F.lit(1 << s) for s in reversed(range(max(1, len(bounds)).bit_length()))))
    chunk = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(said, at + s - 1) <= F.col("doc_id")), at + s).otherwise(at)))
    firsts = ids.groupBy(chunk.alias("chunk")).agg(F.min("doc_id").alias("first")).orderBy("chunk").collect()
    before = [(firsts[i].first, firsts[i - 1].chunk) for i in range(len(firsts))]
    guests = spark.createDataFrame([(f is None, f or 0, c) for f, c in before], "none boolean, first long, to int")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    there = own.join(F.broadcast(guests), (F.col("doc_id").isNull() == F.col("none")) & (F.coalesce("doc_id", F.lit(0)) == F.col("first")), "left")
    place = lambda g, c: F.struct(F.lit(g).alias("guest"), c.cast("int").alias("chunk"))
    return there.select("doc_id", "text", F.inline(F.when(F.col("to").isNull(), F.array(place(False, chunk))).otherwise(F.array(place(False, chunk), place(True, F.col("to")))))).repartition("chunk")


def edited_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_marks, marks, edited_marks).

    The edited text is the text with its last half replaced by as much of the next document's text.
    """
    dealt = with_marks(with_next(docs, id_col, text_col), "text", "marks", k, window)
    order = Window.partitionBy("chunk").orderBy("guest", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    # A guest ends a range: it is there for the one before it only.
    rows = dealt.withColumns({"after": F.lead("text").over(order), "after_marks": F.lead("marks").over(order)}).where("NOT guest")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumns({"n_chars": n, "kept": F.left("text", n - half), "new": F.left("after", half)})
    # What lambdas refer to is computed before them, once for each row.
    parts = _bound(F.struct(points(F.col("kept")).alias("one"), points(F.col("new")).alias("two")), lambda z: F.struct(z["one"].alias("one"), _count(z["one"]).alias("a"), z["two"].alias("two"), _count(z["two"]).alias("b")))
    edited = _bound(parts, lambda z: _joined(z["one"], F.col("marks"), z["a"], z["two"], F.col("after_marks"), z["b"], k, window))
    out = rows.withColumns({"edited_sha256": F.sha2(F.concat("kept", "new").cast("binary"), 256), "edited_marks": edited})
    # Computed once, before several columns are drawn from them.
    told = _bound(F.struct("marks", "edited_marks", "after_marks"), lambda m: _bound(hashes(m["marks"]), lambda h: F.struct(
        digest(m["marks"]).alias("fingerprint"), digest(m["edited_marks"]).alias("edited_fingerprint"), likeness(h, hashes(m["edited_marks"])).alias("near_edited"), likeness(h, hashes(m["after_marks"])).alias("near_next"),
        F.size(m["marks"]).cast("long").alias("n_marks"), m["marks"].alias("marks"), m["edited_marks"].alias("edited_marks"),
    )))
    return out.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", F.inline(F.array(told)))


def report(found: DataFrame) -> DataFrame:
    return found.drop("marks", "edited_marks")
