"""Corpus checks on documents as they arrive (an extension; the checks are stateless expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import CREDENTIAL


def read_arrivals(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def flag_credentials(documents: DataFrame) -> DataFrame:
    """doc_id and the number of lines that look like credentials; batch and stream alike."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(CREDENTIAL))
    return documents.select("doc_id", F.size(lines).alias("n_lines")).where("n_lines > 0")
