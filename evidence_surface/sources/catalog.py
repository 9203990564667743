"""The list of finished maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.naming import age_from_name, age_label, pdf_path


def map_catalog(names: DataFrame, pdfs: DataFrame, folder: str) -> DataFrame:
    """age_ma, label, path, pdf ('' if there is none), by age.

    `names` has the maps' file `name`, `pdfs` the `pdf` paths that exist.
    """
    path = F.concat(F.lit(f"{folder}/"), F.col("name"))
    listed = names.where(F.col("name").endswith(".html")).select(
        age_from_name(F.col("name")).alias("age_ma"), path.alias("path")
    )
    found = pdfs.select(F.col("pdf").alias("expected"), "pdf").distinct()
    return (
        listed.withColumn("expected", pdf_path(F.col("path")))
        .join(found, "expected", "left")
        .select(
            "age_ma",
            age_label(F.col("age_ma")).alias("label"),
            "path",
            F.coalesce("pdf", F.lit("")).alias("pdf"),
        )
        .orderBy("age_ma", "path")
    )


SCHEMA = "age_ma int, label string, path string, pdf string"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def write_catalog(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").json(path)
