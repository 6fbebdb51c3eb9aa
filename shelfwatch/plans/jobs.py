"""The three flows of a crawl, as lazily planned jobs over collected data.

Outputs are tables in a folder. A table that later steps read more than once is written first, so
a lost executor costs a re-run of its tasks and not of the whole flow.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.functions import responses as fr
from shelfwatch.functions import urls as fu
from shelfwatch.operators import attempts as oa
from shelfwatch.operators import examples as ox
from shelfwatch.operators import lookups as ol
from shelfwatch.operators.chain import chain_products, empty_content
from shelfwatch.operators.items import unified
from shelfwatch.operators.nodes import default_template, template_products
from shelfwatch.operators.products import deduplicated, validated
from shelfwatch.sources.product_files import write_products_csv, write_products_json


def search_urls(queries: DataFrame, pages: int, variant: str = "batch") -> DataFrame:
    """One url per (site, query, page) for registered sites.

    queries has site and query. The template table is fixed and broadcast; pages are exploded.
    """
    templates = ol.search_template_table(queries.sparkSession).filter(F.col("variant") == variant).drop("variant")
    base = fu.fill_query(F.col("template"), F.col("query"))
    paged = F.when(
        F.col("suffix").isNull(), fu.page_suffix(base, F.col("page"))
    ).otherwise(F.when(F.col("page") > 1, F.concat(base, "suffix", F.col("page").cast("string"))).otherwise(base))
    return (
        ol.registered_only(queries)
        .join(F.broadcast(templates), "site")
        .withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages))))
        .withColumn("url", paged)
        .drop("template", "suffix")
    )


def search_tasks(queries: DataFrame, pages: int, variant: str = "batch") -> DataFrame:
    """One task per (site, query, page) for registered sites: url, page pattern, start level."""
    urls = search_urls(queries, pages, variant)
    return ol.start_levels(urls.withColumn("page_pattern", fu.page_pattern(F.col("site"), F.col("url"))))


def classified(pages: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Pages with site, page pattern and content verdict.

    In a table without statuses a response counts as 200, since it was stored; a NULL status is a timeout.
    """
    status = F.col("status_code") if "status_code" in pages.columns else F.lit(200)
    named = pages.withColumn("site", fu.site_by_domain(F.col("url")))
    lowered = fr.with_lowered(named, "html")
    return (
        lowered.withColumn("page_pattern", fu.page_pattern(F.coalesce("site", F.lit("")), F.col("url")))
        .withColumn(verdict, fr.text_verdict(status, F.col("html"), F.col("lowered")))
        .drop("lowered")
    )


def content_counts(pages: DataFrame) -> DataFrame:
    """Responses by host, page kind and verdict: how much of a page set is real content."""
    return classified(pages).groupBy(
        fu.host_field(F.col("url")).alias("host"), "page_pattern", "verdict"
    ).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("html")).alias("chars"))


def batch_run(
    spark: SparkSession, pages: DataFrame, attempts: DataFrame, folder: str,
    payloads: DataFrame | None = None, crawl_date: Column | None = None, distinct: bool = False,
) -> dict[str, DataFrame]:
    """Classify pages, extract products by chain, clean, write per site and date, and report.

    pages needs page_id, url, html and render. Pages are scanned twice, once for the verdict table
    and once for extraction: labelling a page again costs less than shuffling its HTML to join the
    table. Every later step reads written tables without HTML. All products are kept unless distinct.
    """
    verdicts = classified(pages)
    verdicts.drop("html").write.mode("overwrite").parquet(f"{folder}/verdicts")
    content = verdicts.filter(F.col("verdict") == "none")
    chain_products(content, payloads, folder=folder).write.mode("overwrite").parquet(f"{folder}/extracted")
    extracted = spark.read.parquet(f"{folder}/extracted")
    clean = validated(unified(extracted, "page_id", "pos"))
    if distinct:
        addresses = labelled_pages(spark, folder)
        clean = clean.join(addresses, "page_id", "left")
        clean = deduplicated(clean, ["page_id", "pos"], page_url="page_url", folder=folder).drop("page_url")
    clean.write.mode("overwrite").parquet(f"{folder}/products")
    products = spark.read.parquet(f"{folder}/products")
    write_products_json(products.drop("page_id", "pos", "is_valid"), f"{folder}/json", crawl_date, "overwrite")
    write_products_csv(products.drop("page_id", "pos", "is_valid"), f"{folder}/csv", crawl_date, "overwrite")
    labelled = spark.read.parquet(f"{folder}/verdicts")
    return {
        "products": products,
        "empty": empty_content(labelled, extracted),
        "stats": oa.attempt_stats(attempts),
        "summary": oa.run_summary(attempts, products),
        "report": oa.site_report(attempts, products),
    }


def labelled_pages(spark: SparkSession, folder: str) -> DataFrame:
    """page_id and page_url of a batch run's pages."""
    return spark.read.parquet(f"{folder}/verdicts").select("page_id", F.col("url").alias("page_url"))


def item_flow(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Pages of known sites to clean, distinct items by selector template; `limit` items of a page, or all."""
    known = pages.withColumn("site", fu.site_by_domain(F.col("url"))).filter(F.col("site").isNotNull())
    typed = known.withColumn("page_type", fu.page_type(F.col("url"))).withColumn(
        "template", default_template(F.col("site"))
    )
    found = template_products(typed.withColumn("page_url", F.col("url")), ["page_id", "page_url"], limit)
    return deduplicated(validated(found), ["page_id", "pos"], page_url="page_url").drop("page_url")


def build_example_sets(
    spark: SparkSession, attempts: DataFrame, states: DataFrame, now: Column, folder: str
) -> DataFrame:
    """Write the example sets of all ready modules and return the readiness report.

    The report has one row per module, a fixed list, so reading it in the driver is bounded.
    """
    report = ox.readiness(attempts, states, now)
    builders = {"strategy_selector": ox.outcome_examples, "initial_tier_selector": ox.level_examples}
    for row in report.filter("ready").select("module", "version").collect():
        if row.module in builders:
            path = f"{folder}/module={row.module}/version={row.version + 1}"
            builders[row.module](attempts).write.mode("overwrite").parquet(path)
    return report
