"""Queries over the given tables, one or more per operator, each with its SQL twin where one exists."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwatch.queries import (
    attempt_queries,
    example_queries,
    extraction_queries,
    lookup_queries,
    product_queries,
    response_queries,
    stream_queries,
    url_queries,
)
from shelfwatch.queries.tables import Tables

MODULES = [
    url_queries, response_queries, attempt_queries, lookup_queries,
    extraction_queries, product_queries, example_queries, stream_queries,
]


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build):
        return lambda spark, sf_dir: build(Tables(spark, sf_dir))

    return {name: bound(build) for m in MODULES for name, (build, _) in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
