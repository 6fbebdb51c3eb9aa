"""Crawl analytics on Spark: operators over collected shop pages and fetch-attempt logs."""
