"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from marketlake.llm import byte_bpe, embedding_dedup, fingerprints, html_extract, language_id, line_dedup, packing, periodic_runs, simhash, token_counts, toxicity, url_filter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op6_simhash_near_dedup(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_byte_bpe(spark, sf):
    return byte_bpe.encoded(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op9_token_counts(spark, sf):
    return token_counts.token_counts(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op1_best_fit_packing(spark, sf):
    return packing.packed(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    return language_id.identified(docs, language_id.fitted(docs))


@query
def op4_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    return toxicity.scored(docs, toxicity.fitted(docs, table(spark, sf, "labels")))


@query
def op10_document_fingerprints(spark, sf):
    found = fingerprints.fingerprinted(table(spark, sf, "documents"))
    named = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return found.withColumns(named)


@query
def op2_url_filters(spark, sf):
    return url_filter.judged(table(spark, sf, "pages"))


ORACLES["op2_url_filters"] = url_filter.oracle()


@query
def op3_html_extraction(spark, sf):
    return html_extract.extracted(table(spark, sf, "pages"))


@query
def op7_embedding_near_dedup(spark, sf):
    return embedding_dedup.near_duplicates(table(spark, sf, "embeddings"))


#: Every pair of a label compared; the query's own recall is measured in the tests.
ORACLES["op7_embedding_near_dedup"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (SELECT * FROM v WHERE label IS NOT NULL AND list_count(e) = len(e) AND list_inner_product(e, e) > 0 AND isfinite(list_inner_product(e, e))),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {embedding_dedup.COSINE}),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_ AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least_ c ON c.x = vec_id LEFT JOIN degree d ON d.x = vec_id"""


@query
def op11_line_dedup(spark, sf):
    found = line_dedup.deduplicated(table(spark, sf, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op11_line_dedup"] = line_dedup.oracle()


@query
def op12_periodic_runs(spark, sf):
    return periodic_runs.periodic_runs(table(spark, sf, "documents"), words_of=periodic_runs.planted).drop("runs", "text")


@query
def op13_embedding_whitening(spark, sf):
    return whitening.whitened(table(spark, sf, "embeddings"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
