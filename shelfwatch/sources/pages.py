"""Collected responses."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPTIONAL = {"status_code": "int", "headers": "map<string,string>"}


def _complete(df: DataFrame) -> DataFrame:
    for name, kind in OPTIONAL.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Responses: page_id, url, html, and status_code and headers where present (else NULL)."""
    return _complete(spark.read.parquet(path))


def stream_pages(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Responses as they land in a folder."""
    return _complete(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )
