"""A corpus from raw documents to packed windows, in five stages.

Each stage takes all documents that the one before kept, and its decisions take effect. `run`
writes each stage's documents to the shared folder and reads them again. All stages but the
last return the columns of `documents`; the last returns the pieces of the packed windows.

Rows are told apart by id and text: nulls, repeated rows and ids with several texts are
handled as the operators define. Columns of any other names pass through all stages but the last,
also those named like the pipeline's own keys; very long texts are handled as the operators
handle them. No SQL states the quality and near-duplicate decisions over
whole tables, so the pipeline is tested against plain versions of its stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence_surface.llm.common import free_name, materialise, normalised_space, table, without
from evidence_surface.llm.decontamination import decontaminate
from evidence_surface.llm.exact_dedup import exact_dedup
from evidence_surface.llm.jaccard_join import jaccard_classes
from evidence_surface.llm.packing import pack
from evidence_surface.llm.quality import quality_filter
from evidence_surface.llm.queries import tokenizer_path

ORACLE_SQL = None


def _keep(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Documents that `decisions` (doc_id, text_key, kept) keep."""
    key = free_name(docs, "text_key_")
    gone = decisions.where(~F.col("kept")).select("doc_id", F.col("text_key").alias(key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    return without(keyed, materialise(gone, "gone"), "doc_id", key).drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, quality_filter(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of equal texts; of its repeated rows one."""
    key = free_name(docs, "text_key_")
    found = exact_dedup(docs).groupBy("doc_id", F.col("text_sha256").alias(key))
    found = materialise(found.agg(F.max("kept").alias("kept"), F.count("*").alias("copies")), "decisions")
    keyed = docs.withColumn(key, F.sha2(normalised_space(F.col("text")), 256))
    rest = without(keyed, found.where(~F.col("kept")), "doc_id", key)
    repeated = found.where(F.col("kept") & (F.col("copies") > 1))
    if repeated.head(1):
        once = without(rest, found.where(F.col("copies") == 1), "doc_id", key).dropDuplicates(["doc_id", key])
        rest = without(rest, repeated, "doc_id", key).unionByName(once)
    return rest.drop(key)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class that links of 0.8 or more join."""
    return _keep(docs, jaccard_classes(docs))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", clean_of_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
