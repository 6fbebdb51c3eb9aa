"""Product outputs: JSON lines and CSV, by site and date.

Writers rebalance by (source, crawl_date) first. AQE then splits a large site over several tasks
and merges small ones, so one site with a third of all rows still writes in parallel and small
sites do not leave a file per task.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.schemas import PRODUCT_DDL

# Text is kept as it is: blanks at the ends, quotes, and "" apart from NULL.
CSV_FORMAT = {
    "header": True, "escape": '"', "nullValue": "\u0000",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def _dated(products: DataFrame, crawl_date: Column | None) -> DataFrame:
    date = F.current_date() if crawl_date is None else crawl_date
    return products.withColumn("crawl_date", F.date_format(date, "yyyy-MM-dd")).hint(
        "rebalance", "source", "crawl_date"
    )


def write_products_json(products: DataFrame, path: str, crawl_date: Column | None = None, mode: str = "append") -> None:
    """JSON lines below source=<site>/crawl_date=<date>."""
    _dated(products, crawl_date).write.mode(mode).option("ignoreNullFields", "false").partitionBy(
        "source", "crawl_date"
    ).json(path)


def write_products_csv(products: DataFrame, path: str, crawl_date: Column | None = None, mode: str = "append") -> None:
    """CSV with a header in every file; images as JSON text."""
    flat = products.withColumn("images", F.to_json("images"))
    _dated(flat, crawl_date).write.mode(mode).options(**CSV_FORMAT).partitionBy("source", "crawl_date").csv(path)


def write_run(products: DataFrame, folder: str) -> None:
    """The whole run as JSON lines and as CSV."""
    products.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/json")
    products.withColumn("images", F.to_json("images")).write.mode("overwrite").options(**CSV_FORMAT).csv(f"{folder}/csv")


def read_products_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{PRODUCT_DDL}, crawl_date string").json(path)


def read_products_csv(spark: SparkSession, path: str, dated: bool = True) -> DataFrame:
    """Products back from CSV; dated for the site and date folders, else for a run's own dump.

    Text may hold line breaks, so a file is read by one task; the writers keep files small.
    """
    schema = (f"{PRODUCT_DDL}, crawl_date string" if dated else PRODUCT_DDL).replace("images array<string>", "images string")
    flat = spark.read.schema(schema).options(**CSV_FORMAT, multiLine=True, enforceSchema=False).csv(path)
    return flat.withColumn("images", F.from_json("images", "array<string>"))
