"""The registered queries of this subpackage: thin uses of its operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, langid, licenses, mixing, quality, rules, simhash, topk, warc
from .common import held_out, table

QUERY_EVERY = 20


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp", "archive", "offset", "length", "part", "seq")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), keep=["doc_id"], with_ids=False)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    return langid.identify(docs.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = topk.codes(table(spark, sf_dir, "embeddings"))
    return topk.search(codes, codes.filter(F.col("id") % QUERY_EVERY == 0))


OP8_SQL = r"""
WITH d AS (SELECT *, length(bin(size)) * 512 + (size >> greatest(0, length(bin(size)) - 9)::INT) AS class FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
m AS (SELECT max(level) AS level FROM l),
t AS (SELECT *, floor(rate) AS whole, rate - floor(rate) AS more FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM (SELECT w.source, w.source_size, coalesce(least(cap::DOUBLE, m.level * weight), cap::DOUBLE) AS target FROM w, m))),
c AS (SELECT source, class, count(*) AS n, sum(size)::BIGINT AS words, ('0x' || substr(md5('mix-1:' || coalesce(source, '') || ':' || class), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM d GROUP BY source, class),
x AS (SELECT t.source, source_size, target, whole, more, list({'class': class, 'n': n, 'words': words, 'u': u, 'want': 0.0::DOUBLE, 'got': 0.0::DOUBLE, 'out': NULL::DOUBLE[]} ORDER BY class DESC) AS xs FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
f AS (SELECT source, source_size, target, whole, xs, list_reduce(xs, lambda a, x: list_transform([a.want + more * x.words], lambda want: list_transform([CASE WHEN x.words > 0 THEN least(x.n, greatest(0, floor((want - a.got) / (x.words / x.n) + x.u))) ELSE 0 END], lambda k:
  {'class': x.class, 'n': x.n, 'words': x.words, 'u': x.u, 'want': want, 'got': a.got + k * CASE WHEN x.words > 0 THEN x.words / x.n ELSE 0.0 END, 'out': list_append(a.out, k / x.n)})[1])[1],
  {'class': xs[1].class, 'n': xs[1].n, 'words': xs[1].words, 'u': xs[1].u, 'want': 0.0::DOUBLE, 'got': 0.0::DOUBLE, 'out': []::DOUBLE[]}).out AS parts FROM x),
p AS (SELECT source, source_size, target, whole, unnest(list_transform(xs, lambda y: y.class)) AS class, unnest(parts) AS part FROM f),
r AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.part, ('0x' || substr(md5('mix-1:' || coalesce(d.source, '') || ':' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.class = p.class)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN u < part THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r"""

OP10_SQL = """
WITH v AS (SELECT vec_id AS id, embedding AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0),
c AS (SELECT id, list_transform(e, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS code FROM v),
p AS (SELECT q.id AS query_id, n.id AS neighbor_id, list_sum(list_transform(list_zip(q.code, n.code), lambda x: CASE WHEN x[1] = x[2] THEN 0 ELSE 1 END))::INT AS distance FROM c q JOIN c n ON len(q.code) = len(n.code) WHERE q.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM p)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_html_extraction, op2_quality_classifier, op3_quality_rules, op4_simhash_near_dedup, op5_license_scan, op6_warc,
    op7_byte_bpe, op8_source_mixing, op9_language_id, op10_exact_topk,
)}
ORACLE_SQL: dict[str, str] = {"op5_license_scan": licenses.oracle(), "op8_source_mixing": OP8_SQL, "op10_exact_topk": OP10_SQL}
