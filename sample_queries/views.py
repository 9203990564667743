"""Evidence points, coast lines and files derived from the sample tables.

The SQL runs unchanged in Spark and in the checking database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence_surface.functions.climate import climate_value

POINTS = """
SELECT point_id, age_ma,
       CAST((site * 7919) % 3600 AS DOUBLE) / 10 - 180 AS lon,
       CAST((site * 104729) % 1200 AS DOUBLE) / 10 - 60 AS lat,
       climate, formation, basin, country, CAST(age_ma AS VARCHAR(10)) AS time
FROM (
  SELECT CAST(c_custkey AS BIGINT) AS point_id,
         CAST(65 + 5 * (c_custkey % 17) AS INT) AS age_ma,
         CASE WHEN c_custkey % 10 = 0 AND c_custkey >= 17
              THEN c_custkey - 17 ELSE c_custkey END AS site,
         CASE WHEN c_custkey % 11 = 0 THEN NULL
              WHEN c_custkey % 13 = 0 THEN 'X'
              WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'H'
              WHEN c_mktsegment = 'FURNITURE' THEN 'S' ELSE 'D' END AS climate,
         concat('F', CAST(c_custkey % 40 AS VARCHAR(10))) AS formation,
         CASE WHEN c_custkey % 19 = 0 THEN '' WHEN c_custkey % 23 = 0 THEN NULL
              ELSE n_name END AS basin,
         r_name AS country
  FROM customer JOIN nation ON c_nationkey = n_nationkey
                JOIN region ON n_regionkey = r_regionkey) t
"""

COAST = """
SELECT CAST(65 + 5 * (line_id % 17) AS INT) AS age_ma, line_id,
       CAST(FLOOR(seq / 5) AS INT) AS part, CAST(seq % 5 AS INT) AS seq,
       CAST((line_id * 37) % 3500 AS DOUBLE) / 10 - 180 + seq AS lon,
       CAST((line_id * 53) % 1200 AS DOUBLE) / 10 - 60 AS lat
FROM (SELECT CAST(FLOOR(o_orderkey / 10) AS BIGINT) AS line_id,
             CAST(o_orderkey % 10 AS INT) AS seq FROM orders) t
"""

FILES = """
SELECT CAST(65 + 5 * n_nationkey AS INT) AS age_ma,
       concat('map_', CAST(65 + 5 * n_nationkey AS VARCHAR(10)),
              '_ma_knn_idw_power4.0_gradient_sharp18.0') AS stem,
       n_nationkey % 3 <> 0 AS has_pdf, n_nationkey % 4 <> 0 AS has_coast
FROM nation
"""

_TABLES = ("customer", "nation", "region", "orders")


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {
        name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in _TABLES if f" {name}" in sql
    }
    for name in used:
        sql = sql.replace(f" {name}", f" {{{name}}}")
    return spark.sql(sql, **used)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points keyed by map_id (the age), with the class number as value."""
    df = _run(spark, sf_dir, POINTS).withColumnRenamed("age_ma", "map_id")
    return df.withColumn("value", climate_value(F.col("climate")))


def coast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, COAST).withColumnRenamed("age_ma", "map_id")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, FILES).withColumnRenamed("age_ma", "map_id")
