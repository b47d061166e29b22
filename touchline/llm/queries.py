"""The operators over their whole tables, one query each, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from touchline.llm import collision_search, licenses, mixing, near_dedup, packing, quality_cnn, quality_rules, token_counts, toxicity, vector_codes, warc, whitening, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op7_best_fit_packing")
def _(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


@query("op10_mixing")
def _(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op1_toxicity")
def _(spark, sf_dir):
    return toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op6_quality_classifier")
def _(spark, sf_dir):
    return quality_cnn.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op8_quality_rules", quality_rules.oracle())
def _(spark, sf_dir):
    return quality_rules.judge(documents(spark, sf_dir))


@query("op3_near_dedup")
def _(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir))


@query("op5_winnowing")
def _(spark, sf_dir):
    return winnowing.edit_likeness(documents(spark, sf_dir))


@query("op2_warc_histories", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to FROM m""")
def _(spark, sf_dir):
    found = warc.archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_token_counts")
def _(spark, sf_dir):
    return token_counts.tokenize_and_count(documents(spark, sf_dir))


@query("op9_license_scan")
def _(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@query("op11_vector_codes", vector_codes.oracle())
def _(spark, sf_dir):
    return vector_codes.compress(embeddings(spark, sf_dir))


@query("op12_nearest_vectors")
def _(spark, sf_dir):
    return collision_search.neighbours(embeddings(spark, sf_dir))


@query("op13_whitening")
def _(spark, sf_dir):
    return whitening.whiten(embeddings(spark, sf_dir))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
