"""Second readings of doubtful runs."""

from pyspark.sql import functions as F

from pagemill.operators import ocr as O

WORDS = "doc_id long, page_number long, line_no long, item_idx long, text string, confidence double, x0 double, y0 double, x1 double, y1 double"
SECOND = "doc_id long, page_number long, line_no long, text string, confidence double, x0 double, x1 double"


def line(no, words):
    """words: (text, confidence, x0, x1)."""
    return [(1, 1, no, k, t, float(c), float(a), 0.0, float(b), 10.0) for k, (t, c, a, b) in enumerate(words)]


def read(spark, words, second, texts):
    got = O.reread(spark.createDataFrame(words, WORDS), spark.createDataFrame([(1, 1, n, t, float(c), float(a), float(b)) for n, t, c, a, b in second], SECOND))
    lines = spark.createDataFrame([(1, 1, n, t) for n, t in texts.items()], "doc_id long, page_number long, line_no long, line string")
    rows = got.join(lines, list(O.LINE)).select("line_no", O.respaced(F.col("line"), F.col("words")).alias("text"), "confidence", "replaced").collect()
    return {r.line_no: (r.text, round(r.confidence, 3), r.replaced) for r in rows}


def test_runs_are_replaced_where_surer(spark):
    words = line(1, [("The", 90, 0, 30), ("qu1ck", 60, 40, 80), ("brwn", 50, 90, 120), ("fox", 95, 130, 160), ("jmps", 60, 170, 200)])
    words += line(2, [("low", 40, 0, 30), ("line", 20, 40, 70)])  # too doubtful on the whole
    words += line(3, [("한", 90, 0, 10), ("굴", 60, 10, 20), ("은", 90, 20, 30), ("x", 95, 60, 70)])
    words += line(4, [("a", 90, 0, 10), ("|", 30, 20, 22), ("b", 90, 30, 40), (" ", 10, 50, 60)])  # a rule isn't read again
    words += line(5, [("one", 80, 0, 30), ("tw0", 60, 33, 60), ("three", 80, 60, 90), ("four", 90, 93, 120)])
    second = [(1, "quick", 90, 41, 79), (1, "brown", 80, 88, 119), (1, "jumps", 64, 170, 200), (1, "fix", 99, 130, 160), (2, "lower", 99, 0, 30), (3, "글", 99, 10, 20), (4, "l", 99, 20, 22), (5, "two", 66, 33, 60), (5, "", 99, 35, 40)]
    texts = {1: "The qu1ckbrwn  fox jmps", 2: "low line", 3: "한굴은 x", 4: "a | b", 5: "onethree four"}
    assert read(spark, words, second, texts) == {
        1: ("The quick brown fox jmps", round((90 + 85 + 95 + 60) / 4, 3), 1),  # 64 isn't five points surer than 60
        2: ("low line", 30.0, 0),
        3: ("한글은 x", round((90 + 99 + 90 + 95) / 4, 3), 1),
        4: ("a | b", 70.0, 0),
        # What stood there isn't found in the line: the gaps decide for it and what follows it.
        5: ("one twothree four", round((80 + 66 + 80 + 90) / 4, 3), 1),
    }


def test_a_word_belongs_to_the_run_that_holds_most_of_it(spark):
    words = line(1, [("aa", 60, 0, 20), ("bb", 95, 20, 40), ("cc", 60, 40, 60), ("dd", 95, 60, 80)])
    second = [(1, "AA", 99, 8, 24), (1, "CC", 99, 31, 48), (1, "far", 99, 90, 99)]
    assert read(spark, words, second, {1: "aa bb cc dd"}) == {1: ("AA bb cc dd", round((99 + 95 + 60 + 95) / 4, 3), 1)}
