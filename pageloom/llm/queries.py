"""One query per operator, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from . import decontaminate, divergence, embed_dedup, jaccard, line_dedup, mixing, oracles, packing, personal, prefix_trie, quality, secrets, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))[0]


@query(oracles.SECRETS)
def op8_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(_read(spark, sf_dir, "documents"))[0])


@query()
def op7_rank_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.classify_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@query()
def op3_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.classify_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@query()
def op9_scan_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.scan_personal(_read(spark, sf_dir, "documents"))
    return found.withColumn("base", F.sha2("base", 256)).withColumnRenamed("base", "base_sha256")


@query(oracles.JACCARD)
def op10_join_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents"))


@query()
def op2_drop_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op4_find_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@query(oracles.EMBEDDINGS)
def op5_link_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_read(spark, sf_dir, "embeddings"))


@query()
def op6_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(prepare(spark), sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.labelled_urls(pages, _read(spark, sf_dir, "labels")))


@query(oracles.DIVERGENCE)
def op12_audit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_read(spark, sf_dir, "documents"))


@query()
def op13_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_read(spark, sf_dir, "documents"))
    length = F.expr("length(ids) div 4").alias("length")
    return pieces.select("doc_id", "start", length, F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query(oracles.PREFIXES)
def op11_trace_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_read(spark, sf_dir, "conversations"))
