import numpy as np

from pagemill.llm import quality as Q


def test_features():
    said = lambda *xs: np.unique([__import__("xxhash").xxh32_intdigest(x) % Q.BUCKETS for x in xs]).tolist()
    assert Q.features(None).tolist() == Q.features("").tolist() == Q.features(" \n").tolist() == []
    assert Q.features("Ab, cd").tolist() == said(b"ab", b"cd", b"<", b">,")
    assert set(said(b"<", b">***", b"=0>3")) <= set(Q.features("x*** y*** z***").tolist())
    assert len(Q.features("word " * 100_000)) < 10


def test_fit_finds_thresholds_and_weights():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(3000):
        bad, worse = rng.random() < 0.3, rng.random() < 0.2
        rows.append(np.unique([*rng.integers(100, 4000, 30), *([1] if bad else []), *([2] if worse else [])]))
        grades.append(0 if worse else 1 if bad else 2)
    m = Q.fit_rows(rows, np.array(grades))
    assert m.weights[2] < m.weights[1] < -1 and (np.diff(m.thresholds) > 0).all()
    above = m.above(np.array([m.weights[r].sum() for r in rows], float))
    assert (above[:, 0] >= above[:, 1]).all()
    assert ((above > 0.5).sum(1) == grades).mean() > 0.98


def test_gradient_step_lowers_the_loss():
    rows = [np.array([k % 3, 10 + k % 5]) for k in range(200)]
    grades = np.array([k % 3 for k in range(200)])
    m = Q.fit_rows(rows, grades, steps=200)
    above = m.above(np.array([m.weights[r].sum() for r in rows], float))
    p = np.column_stack([1 - above[:, 0], above[:, 0] - above[:, 1], above[:, 1]])
    assert -np.log(p[np.arange(200), grades]).mean() < 0.5 * np.log(3)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    odd = spark.createDataFrame([(None, None, 1), (1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    more = spark.createDataFrame([(90001, None), (None, "some text"), (90002, "the and of " * 30000)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(more)
    held = labels.where("doc_id % 3 != 0").unionByName(odd)
    got = {r.doc_id: r for r in Q.rate(table, held).collect()}
    assert len(got) == 4003 and all(0 <= r.expected_grade <= 2 and r.keep == (r.tail_probability >= 0.5) for r in got.values())
    test = labels.where("doc_id % 3 = 0 AND doc_id < 4000").collect()
    clean = [got[r.doc_id].keep for r in test if r.quality and not r.toxic]
    junk = [got[r.doc_id].keep for r in test if not r.quality and not r.toxic]
    toxic = [got[r.doc_id].keep for r in test if r.toxic]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.15 and np.mean(toxic) < 0.35
    none = Q.rate(table.limit(5), labels.limit(0)).collect()
    assert len(none) == 5 and all(r.keep and r.tail_probability == 0.5 for r in none)
    assert Q.rate(table.limit(0), labels).count() == 0


def test_repeated_and_clashing_rows(spark):
    docs = spark.createDataFrame([(k % 40, f"good text {k % 40}" if k % 2 else f"bad junk {k % 40}", 1, "x") for k in range(200)], "doc_id long, text string, grade int, keep string")
    labels = spark.createDataFrame([(k % 40, k % 2, 0, "y") for k in range(120)] + [(0, 1, 0, "y"), (1, 1, 1, "y")], "doc_id long, quality int, toxic int, text string")
    got = Q.rate(docs, labels).collect()
    assert len(got) == 200 and len({(r.doc_id, r.tail_probability) for r in got}) == 40
    model = Q.fit(docs, labels.select("doc_id", Q.grade(labels.quality, labels.toxic).alias("grade")))
    once = Q.fit(docs.dropDuplicates(["doc_id"]), labels.select("doc_id", Q.grade(labels.quality, labels.toxic).alias("grade")).groupBy("doc_id").agg({"grade": "min"}).withColumnRenamed("min(grade)", "grade"))
    assert (model.weights == once.weights).all() and (model.thresholds == once.thresholds).all()
