"""Recognised words: acceptance, segments, doubtful runs, weights and statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.arrays import bound
from ..functions.text import hangul_share, letters
from .spatial import not_covered

#: Confidence tiers, glyphs that are table rules, and stroke ratios of bold text.
LOW, FAIR, GOOD = 60, 60, 80
RULES = r"^[|│¦｜\[\]]+$"
BOLD_RATIO, BOLD_RATIO_HANGUL = 0.128, 0.092
#: Words below the one are read again, in lines whose mean is at least the other.
DOUBT, LINE_LEAST = 70, 50
LINE = ("doc_id", "page_number", "line_no")


def accepted(text: Column, confidence: Column, width: Column, height: Column, points: Column | None = None) -> Column:
    """Segments worth keeping: confident enough for the letters they hold, and of some size. points: the size of the text; what is under five must be three letters at least, and sure."""
    n = letters(text)
    sharp = F.lit(True) if points is None else ~((points < 5) & ((confidence < 80) | (n <= 2)))
    return sharp & (F.trim(text) != "") & (confidence >= 45) & ~((confidence < 65) & (n <= 1)) & (n > 0) & (width >= 3) & (height >= 4)


def tier(confidence: Column) -> Column:
    return F.when(confidence >= GOOD, "good").when(confidence >= FAIR, "fair").otherwise("low")


def stats(words: DataFrame) -> DataFrame:
    """For each document: words, doubtful words, and the mean over its pages of the pages' confidences."""
    pages = words.groupBy("doc_id", "page_number").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") < LOW).alias("low"), F.sum("confidence").alias("s"))
    return pages.groupBy("doc_id").agg(F.sum("n").alias("words"), F.sum("low").alias("low"), F.sum(F.col("s") / F.col("n")).alias("total"), F.count(F.lit(1)).alias("pages")).select("doc_id", "words", "low", (F.col("total") / F.greatest(F.lit(1), "pages")).alias("confidence"))


def segments(words: DataFrame) -> DataFrame:
    """Lines cut at table rules and wide gaps. Rows (*LINE, segment, text, confidence, x0, y0, x1, y1)."""
    is_rule = F.trim("text").rlike(RULES)
    full = words.where(F.trim("text") != "")
    line = Window.partitionBy(*LINE)
    order = line.orderBy("x0", "item_idx")
    # A rule between two words: the last rule's middle before a word lies past the word before it.
    at = full.withColumn("rule", is_rule).withColumn("middle", F.when(F.col("rule"), (F.col("x0") + F.col("x1")) / 2))
    heights = F.sort_array(F.collect_list(F.when(~F.col("rule"), F.col("y1") - F.col("y0"))).over(line))
    seen = at.withColumns({"h": F.get(heights, F.floor(F.size(heights) / 2).cast("int")), "last_rule": F.max("middle").over(order.rowsBetween(Window.unboundedPreceding, -1))}).where("NOT rule")
    end = F.lag("x1").over(order)
    cut = end.isNull() | F.coalesce((F.col("last_rule") > end) & (F.col("last_rule") < F.col("x0")), F.lit(False)) | (F.col("x0") - end > 1.6 * F.col("h"))
    numbered = seen.withColumn("cut", cut.cast("int")).withColumn("segment", F.sum("cut").over(order) - 1)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("x0", "item_idx", F.trim("text").alias("t")))), lambda s: s["t"])
    return numbered.groupBy(*LINE, "segment").agg(F.array_join(texts, " ").alias("text"), F.avg("confidence").alias("confidence"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def doubtful_runs(words: DataFrame, below: float = DOUBT, line_least: float = LINE_LEAST) -> DataFrame:
    """Runs of neighbouring doubtful words in lines that are confident on the whole: what to read again."""
    full = words.where(F.trim("text") != "")
    line = Window.partitionBy(*LINE)
    at = full.withColumns({"line_confidence": F.avg("confidence").over(line), "n": F.row_number().over(line.orderBy("x0", "item_idx"))}).where(F.col("line_confidence") >= line_least)
    low = at.where((F.col("confidence") < below) & ~F.trim("text").rlike(RULES))
    runs = low.withColumn("run", F.col("n") - F.row_number().over(line.orderBy("n")))
    return runs.groupBy(*LINE, "run").agg(F.count(F.lit(1)).alias("words"), F.min("n").cast("long").alias("first"), F.avg("confidence").alias("confidence"), F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("run")


def adopted(old: Column, new: Column) -> Column:
    """Whether a second reading replaces a run."""
    return new >= old + 5


_MERGED = ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType()), StructField("text", StringType()), StructField("confidence", DoubleType()), StructField("new", BooleanType())]))


@F.arrow_udf(_MERGED)
def merged(words: pa.Array, second: pa.Array) -> pa.Array:
    """Each line's words (text, confidence, x0, x1), none of them blank and in order, with its doubtful runs replaced where those of a second reading are surer.

    What is left are (first, last, text, confidence, new), first and last being the places, from 1, of the words
    that it stands for. A word of the second reading belongs to the run that holds over half of its width, and
    therefore its middle: by middles it is found among the line's others in a sorted order.
    """
    flat = lambda a: dict(zip((f.name for f in a.type.value_type), a.flatten().flatten(), strict=True))
    numbers = lambda d, *names: [d[n].to_numpy(zero_copy_only=False).astype(np.float64) for n in names]
    mean = lambda of, v, n: np.bincount(of, np.nan_to_num(v), n) / np.bincount(of, ~np.isnan(v), n)
    lengths = lambda a: pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    w, s, n, lines = flat(words), flat(second), lengths(words), len(words)
    (sure, x0, x1), (its, s0, s1) = numbers(w, "confidence", "x0", "x1"), numbers(s, "confidence", "x0", "x1")
    line, s_line = np.repeat(np.arange(lines), n), np.repeat(np.arange(lines), lengths(second))
    with np.errstate(invalid="ignore", divide="ignore"):
        low = np.flatnonzero((mean(line, sure, lines)[line] >= LINE_LEAST) & (sure < DOUBT))
        low = low[~pc.match_substring_regex(w["text"].take(pa.array(low)), RULES).to_numpy(zero_copy_only=False).astype(bool)]
        begins = np.append(True, (np.diff(low) > 1) | (np.diff(line[low]) > 0))[: len(low)]
        start, run = np.flatnonzero(begins), np.cumsum(begins) - 1
        first, last, runs = low[start], low[np.append(start[1:], len(low))[: len(start)] - 1], len(start)
        reach = lambda f, v: f.reduceat(v[low], start) if runs else np.zeros(0)
        r0, r1, doubt = reach(np.fmin, x0), reach(np.fmax, x1), mean(run, sure[low], runs)
        # Among the middles of a line's words: how many lie before a run, and how many before its end. What rounding may hide is taken in as well.
        middle, slack = (s0 + s1) / 2, lambda x: 1e-9 * (1 + np.abs(x))
        order = np.lexsort((middle, s_line))
        middle, m_line, m = middle[order], s_line[order], len(order)

        def before(at: np.ndarray) -> np.ndarray:
            mixed = np.lexsort((np.append(middle, at), np.append(m_line, line[first])))
            out, is_run = np.zeros(runs, np.int64), mixed >= m
            out[mixed[is_run] - m] = np.cumsum(~is_run)[is_run]
            return out

        a, b = before(r0 - slack(r0)), before(r1 + slack(r1))
        many = np.maximum(b - a, 0)
        r = np.repeat(np.arange(runs), many)
        q = order[np.arange(len(r)) - np.repeat(np.cumsum(many) - many - a, many)]
        inside = (np.minimum(r1[r], s1[q]) - np.maximum(r0[r], s0[q])) * 2 > s1[q] - s0[q]
        r, q = r[inside], q[inside]
        again = mean(r, its[q], runs)
        new = adopted(doubt, again)
    r, q = r[new[r]], q[new[r]]
    said = s["text"].take(pa.array(q))
    by = pc.sort_indices(pa.table([pa.array(r), pa.array(s0[q]), pa.array(s1[q]), said], ["r", "s0", "s1", "said"]), [(k, "ascending") for k in ("r", "s0", "s1", "said")])
    ends = np.append(0, np.cumsum(np.bincount(r, minlength=runs)[new])).astype(np.int32)
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), said.take(by)), pa.scalar(" ", said.type))
    kept = np.ones(len(line), bool)
    kept[low[new[run]]] = False
    kept[first[new]] = True
    kept = np.flatnonzero(kept)
    at = np.searchsorted(kept, first[new])
    source, end, confidence, is_new = kept.copy(), kept.copy(), sure[kept], np.zeros(len(kept), bool)
    source[at], end[at], confidence[at], is_new[at] = len(line) + np.arange(len(at)), last[new], again[new], True
    place = lambda i: pa.array((i - (np.cumsum(n) - n)[line[i]] + 1).astype(np.int32))
    rows = [place(kept), place(end), pa.concat_arrays([w["text"], texts]).take(pa.array(source)), pa.array(confidence, from_pandas=True), pa.array(is_new)]
    ends = np.append(0, np.cumsum(np.bincount(line[kept], minlength=lines))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(rows, _MERGED.elementType.names))


def reread(words: DataFrame, second: DataFrame) -> DataFrame:
    """Rows (*LINE, words, confidence, replaced): each line's words in order, (text, parts, x0, x1, h), with the runs that a second reading makes surer replaced by it.

    words: (*LINE, item_idx, text, confidence, x0, x1, y0, y1); second: (*LINE, text, confidence, x0, x1), words of another
    reading. `parts` are the words that stood in a word's place before; a line's confidence is the mean of its words', a
    replaced run counting once. Lines meet as arrays, their words are not joined.
    """
    of = lambda df, order, *cols: df.where(F.trim("text") != "").groupBy(*LINE).agg(F.sort_array(F.collect_list(F.struct(*order, F.trim("text").alias("text"), "confidence", *cols))).alias("of"))
    own = of(words, ("x0", "item_idx"), "x1", (F.col("y1") - F.col("y0")).alias("h")).withColumnRenamed("of", "own")
    both = own.join(of(second, ("x0", "x1")), list(LINE), "left")
    return told(both.withColumn("left", merged("own", "of")))


def told(lines: DataFrame) -> DataFrame:
    """As `reread`, from lines with their words (`own`) and what is left of them (`left`)."""
    said = lambda m: F.slice("own", m["first"], m["last"] - m["first"] + 1)
    each = F.transform("left", lambda m: F.struct(m["first"].cast("long").alias("n"), m["text"].alias("text"), F.transform(said(m), lambda w: w["text"]).alias("parts"), F.array_min(F.transform(said(m), lambda w: w["x0"])).alias("x0"), F.array_max(F.transform(said(m), lambda w: w["x1"])).alias("x1"), F.array_max(F.transform(said(m), lambda w: w["h"])).alias("h"), m["new"].alias("new"), m["confidence"].alias("confidence")))
    mean = F.aggregate("left", F.lit(0.0), lambda a, m: a + m["confidence"]) / F.size("left")
    return lines.select(*LINE, each.alias("words"), mean.alias("confidence"), replaced(F.col("left")).alias("replaced"))


def replaced(left: Column) -> Column:
    return F.size(F.filter(left, lambda m: m["new"])).cast("long")


def respaced(line: Column, words: Column) -> Column:
    """The text of a line's words, as `reread` gives them, spaced as the line's own text was where what stood there is found in it one after another, else by the gap between the words."""
    heights = F.sort_array(F.transform(words, lambda w: w["h"]))
    high = F.coalesce(F.nullif(F.get(heights, F.floor(F.size(words) / 2).cast("int")), F.lit(0.0)), F.lit(1.0))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), F.lit(0).alias("end"), F.lit(None).cast("double").alias("x1"))

    def found(w: Column, at: Column) -> Column:
        """Where a word's first part begins and its last one ends, searched from `at` on; 0 where one isn't there."""
        none = F.struct(at.alias("at"), F.lit(0).alias("first"), F.lit(0).alias("last"))

        def part(s: Column, p: Column) -> Column:
            here = F.call_function("locate", p, line, s["at"])
            end = here + F.char_length(p)
            return F.struct(F.when(here > 0, end).otherwise(s["at"]).cast("int").alias("at"), F.when((s["first"] == 0) & (s["at"] == at), here).otherwise(s["first"]).cast("int").alias("first"), F.when(here > 0, end).otherwise(0).cast("int").alias("last"))

        return F.aggregate(w["parts"], none, part)

    def step(s: Column, w: Column) -> Column:
        def told(f: Column) -> Column:
            hit = (f["first"] > 0) & (f["last"] > 0)
            between = F.substring(line, s["end"], F.greatest(f["first"] - s["end"], F.lit(0)))
            apart = F.when(hit & (s["end"] > 0), between.rlike(r"\s")).otherwise(F.coalesce(w["x0"] - s["x1"] > 0.25 * high, F.lit(False)))
            return F.struct(F.concat(s["out"], F.when(apart & s["x1"].isNotNull(), " ").otherwise(""), w["text"]).alias("out"), F.when(hit, f["last"]).otherwise(s["at"]).cast("int").alias("at"), F.when(hit, f["last"]).otherwise(0).cast("int").alias("end"), w["x1"].cast("double").alias("x1"))

        return bound(found(w, s["at"]), told)

    return F.aggregate(words, start, step, lambda s: s["out"])


def weights(lines: DataFrame) -> DataFrame:
    """lines: (doc_id, page_number, ..., text, size, stroke). `bold`: clearly heavier than the page's text, or over its script's bar."""
    page = Window.partitionBy("doc_id", "page_number")
    enough = (letters(F.col("text")) >= 3) & (F.col("stroke") > 0)
    middle = lambda a: F.get(a, F.floor(F.size(a) / 2).cast("int"))
    strokes = F.sort_array(F.collect_list(F.when(enough, F.col("stroke"))).over(page))
    sizes = F.sort_array(F.collect_list("size").over(page))
    at = lines.withColumns({"m": middle(strokes), "body": middle(sizes)})
    absolute = F.when(hangul_share(F.col("text")) >= 0.2, BOLD_RATIO_HANGUL).otherwise(BOLD_RATIO)
    factor = F.when(F.col("size") >= F.col("body") * 1.5, 1.25).otherwise(1.4)
    relative = F.when(F.col("m") > 0, F.greatest(F.col("m") * factor, F.lit(0.085))).otherwise(absolute)
    return at.withColumn("bold", enough & (F.col("stroke") > F.least(absolute, relative))).drop("m", "body")


def legible_on_dark(luminance: Column, confidence: Column) -> Column:
    """Lines read in dark regions that are worth keeping."""
    return (luminance < 110) & (confidence >= 55)


def without_dark(lines: DataFrame, dark: DataFrame) -> DataFrame:
    """lines and dark: (doc_id, page_number, group, line, x, y, w, h, ...). Ordinary lines that no line read in a dark region covers, and those lines, in groups after the others."""
    left = not_covered(lines, dark, of_smaller=True)
    return left.withColumn("dark", F.lit(False)).unionByName(dark.withColumn("dark", F.lit(True)))


def beside_layer(layer: DataFrame, read: DataFrame, paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A page's own lines with what recognition adds to them: lines it read (`line`, in boxes) that no own line covers.

    paragraphs: (doc_id, page_number, paragraph, lines) of the lines read. They keep the lines that are left, in order;
    one without any goes. Rows of lines carry `origin`; lines of an earlier reading (origin ocr) are replaced.
    """
    own = layer.where("origin != 'ocr'")
    new = not_covered(read, own).withColumn("origin", F.lit("ocr"))
    flat = paragraphs.select("doc_id", "page_number", "paragraph", F.posexplode("lines").alias("pos", "line")).join(new.select("doc_id", "page_number", "line"), ["doc_id", "page_number", "line"], "left_semi")
    kept = flat.groupBy("doc_id", "page_number", "paragraph").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]).alias("lines"))
    return own.unionByName(new), kept


def latest_states(log: DataFrame) -> DataFrame:
    """log: (doc_id, page_number, at_ms, event_id, state). The state that each page's recognition is in."""
    return log.groupBy("doc_id", "page_number").agg(F.max_by("state", F.struct("at_ms", "event_id")).alias("state"), F.max("at_ms").alias("at_ms"))
