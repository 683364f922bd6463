"""The queries of this subpackage: thin forms of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import divergence, hnsw, importance, language_id, language_model, mixing, packing, quality, secret_scan, simhash, top_k, url_filter, winnowing
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents")))


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_pages(table(spark, sf_dir, "pages"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.report(winnowing.edited_next(table(spark, sf_dir, "documents")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).takes()


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_hnsw, op3_packing, op4_quality, op5_simhash, op6_url_filter, op7_winnowing, op8_language_id, op9_mixing, op10_language_model, op11_importance, op12_top_k, op13_divergence)}

#: Checksums by a table of 256 steps, made here by eight divisions of each byte.
_OP11 = r"""
WITH steps AS (SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS s FROM range(256) t(i)),
texts AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 't', row_number() OVER (), 0, coalesce(text, '') FROM benchmark),
words AS (SELECT side, r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT side, r, array_to_string(w[i : i + k], ' ') AS feature FROM words, range(3) n(k), unnest(range(1, len(w) - k + 1)) u(i)),
often AS (SELECT side, r, feature, count(*) AS n FROM runs GROUP BY ALL),
known AS (SELECT DISTINCT feature FROM often),
hashed AS (SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(hex(feature)) // 2 + 1), lambda i: ('0x' || hex(feature)[2 * i - 1 : 2 * i])::BIGINT)), lambda c, b: xor(c // 256, s[(xor(c % 256, b) + 1)::BIGINT])), 4294967295) % 10000 AS bucket FROM known, steps),
entries AS (SELECT side, r, bucket, sum(n) AS n FROM often JOIN hashed USING (feature) GROUP BY ALL),
sums AS (SELECT bucket, sum(CASE WHEN side = 'd' THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN side = 't' THEN n ELSE 0 END)::DOUBLE AS t FROM entries GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM sums),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM entries JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM words LEFT JOIN weights USING (r) WHERE side = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, n_words::BIGINT AS n_words, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM placed"""

_OP12 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p QUALIFY rank <= 20"""

_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
g AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN (SELECT lang, term FROM kept) USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (t.n + l.v) AS p, 1 + 1000000000 * (kept.n + 1) // (l.n + l.v) AS q
 FROM g JOIN kept USING (lang) JOIN l USING (lang) JOIN t USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_ AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
 UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_ QUALIFY part = 'pair' OR rank <= 200"""

ORACLES: dict[str, str] = {"op11_importance": _OP11, "op12_top_k": _OP12, "op13_divergence": _OP13}
