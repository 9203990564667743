"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence_surface.llm.common import table
from evidence_surface.llm.decontamination import decontaminate
from evidence_surface.llm.divergence import divergence
from evidence_surface.llm.exact_dedup import exact_dedup
from evidence_surface.llm.jaccard_join import jaccard_classes
from evidence_surface.llm.language import predict_language
from evidence_surface.llm.line_dedup import line_dedup
from evidence_surface.llm.metric_tree import top_k
from evidence_surface.llm.packing import pack
from evidence_surface.llm.periodic_runs import greatest_run, periodic_runs, planted_repeats, run_lines
from evidence_surface.llm.quality import quality_filter
from evidence_surface.llm.suffix_dedup import suffix_dedup
from evidence_surface.llm.url_filters import filter_urls
from evidence_surface.llm.warc import read_warc, write_warc
from evidence_surface.session import scratch_path

URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
PAGE_URN = "urn:x-page:"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), unit="sentence").select(
        "doc_id",
        F.size("spans").cast("long").alias("n_spans"),
        "n_removed",
        F.to_json("spans").alias("spans"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"),
        F.concat(F.lit(PAGE_URN), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        "url",
        F.col("html").cast("binary").alias("payload"),
    )
    files = write_warc(pages, scratch_path(spark, "warc"))
    page = lambda c: F.substring(c, len(PAGE_URN) + 1, 20).try_cast("long")
    return read_warc(files, with_payload=False).select(
        page(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", planted_repeats(F.col("doc_id"), F.col("text")).alias("text"))
    rows = periodic_runs(docs).withColumn("best", greatest_run(F.col("runs")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(run_lines(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_warc": op5_warc,
    "op6_language": op6_language,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality": op8_quality,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_divergence": op12_source_divergence,
    "op13_exact_top_k": op13_exact_top_k,
}
