"""The queries opN_* of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import html_text, kneser_ney, language_id, quality, url_filter
from .common import held_out
from .embedding_join import near_duplicates
from .fingerprints import fingerprints
from .mixing import mix
from .ngram_jaccard import jaccard_components
from .packing import pack


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of documents; labels with crc32(doc_id) mod 5 = 0 are held out."""
    docs, out = _documents(spark, sf_dir), held_out(F.col("doc_id"), 5, 0)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~out)
    return quality.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(_documents(spark, sf_dir), 2048)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return jaccard_components(_documents(spark, sf_dir), w=3, num=90, den=100)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document so that sources weigh 5, 2, 1, repeating, in 150% of all words, none above twice its size."""
    return mix(_documents(spark, sf_dir), weights=(5, 2, 1), share=1.5, repeats=2.0).select("doc_id", "size", "source_size", "target", "taken")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors whose cosine is 0.95 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.95)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of documents; those with crc32(doc_id) mod 4 = 2 are held out."""
    docs, out = _documents(spark, sf_dir), held_out(F.col("doc_id"), 4, 2)
    return language_id.identify(docs, language_id.fit(docs, ~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of documents under a Kneser-Ney model; those with crc32(doc_id) mod 10 = 0 are held out."""
    docs, out = _documents(spark, sf_dir), held_out(F.col("doc_id"), 10, 0)
    scored = kneser_ney.score(docs, kneser_ney.fit(docs, ~out), F.col("doc_id"), out)
    return scored.withColumnsRenamed({"c0": "doc_id", "c1": "held_out"})


#: Fixed rules of op9: verdict, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' urls: fixed rules first, then rules mined from labels."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judge(pages, URL_RULES, url_filter.mine(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical exact digests of documents and of their edited texts."""
    return fingerprints(_documents(spark, sf_dir))


QUERIES = {
    "op1_quality_crf": op1_quality_crf,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_html_extraction": op4_html_extraction,
    "op5_mix_sources": op5_mix_sources,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_url_filter": op9_url_filter,
    "op10_document_fingerprints": op10_document_fingerprints,
}

#: Lower-cases A-Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op3_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) AS sh FROM w
), n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, hash(g) AS g FROM (SELECT doc_id, unnest(sh) AS g FROM s)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, t.b FROM r JOIN t ON t.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, c.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = n.doc_id
""",
    "op5_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0::DOUBLE, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight FROM s),
f AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev, 2 * source_size / weight AS ratio
  FROM w WINDOW o AS (ORDER BY source_size / weight, source)
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, (SELECT min_by(lev, ratio) FROM f WHERE lev < ratio) * weight) AS target FROM f
), g AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.h, d.source, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY source, h) AS tied FROM g
)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN target - whole * source_size > 0 AND upto - tied / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM c
""",
    "op6_embedding_near_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS len FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.len > 0 AND b.len > 0 AND list_dot_product(a.v, b.v) / (a.len * b.len) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM u UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM u JOIN c ON c.a = vec_id
""",
}
