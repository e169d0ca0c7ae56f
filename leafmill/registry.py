"""The registered queries of the engine's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import quality
from .queries import binding, books, edits, notices, profiles, rasters, readings, records, scalars, stored, streams, versions, words

FAMILIES = (words, books, scalars, records, stored, profiles, rasters, notices, readings, edits, streams, versions, binding)


def queries() -> dict:
    return {k: v for family in FAMILIES for k, v in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for family in FAMILIES for k, v in family.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))
