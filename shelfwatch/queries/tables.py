"""Stand-in tables: attempts, responses, shop URLs and shop pages derived from the given tables.

Where a text runs on both engines, one SQL string serves as the Spark view and as the first step
of the SQL twin. Every derived page holds a fixed number of parts, so pages stay small while their
number grows with the data.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.rules import phrases as P
from shelfwatch.rules import sites as R
from shelfwatch.session import ship_package

PARTS_PER_PAGE = 24


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship_package(spark)

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, sql: str, name: str, table: DataFrame | None = None) -> DataFrame:
        """Run a shared SQL text over the named table, or over a frame that stands for it."""
        over_frame = re.sub(rf"\bFROM {name}\b", f"FROM {{{name}}}", sql)
        return self.spark.sql(over_frame, **{name: self(name) if table is None else table})

    def attempts(self) -> DataFrame:
        return self.view(ATTEMPTS, "events")

    def responses(self) -> DataFrame:
        return self.view(RESPONSES, "documents")

    def shop_urls(self) -> DataFrame:
        return self.view(SHOP_URLS, "pages")

    def task_events(self) -> DataFrame:
        return self.view(TASK_EVENTS, "events")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(expr: str, values: list, default: str | None = None) -> str:
    """CASE over small integers: the i-th value for i, else the default."""
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {expr} {whens} ELSE {default if default is not None else values[-1]} END"


ATTEMPTS = """
SELECT event_id, ts, site, concat('https://www.', site, '.com/item/', CAST(user_id AS STRING)) AS url,
       page_pattern, level, cfg, success,
       CASE WHEN success THEN 'none'
            WHEN event_id % 4 = 0 THEN 'http_403' WHEN event_id % 4 = 1 THEN 'http_429'
            WHEN event_id % 4 = 2 THEN 'http_timeout' ELSE 'empty_response' END AS block_type,
       CASE WHEN success THEN 200 WHEN event_id % 4 = 0 THEN 403 WHEN event_id % 4 = 1 THEN 429
            WHEN event_id % 4 = 2 THEN 0 ELSE 200 END AS status_code,
       CASE WHEN event_id % 6 = 0 THEN 'cloudflare' ELSE '' END AS waf_detected,
       CASE event_id % 8 WHEN 0 THEN 'none' WHEN 1 THEN 'playwright' ELSE 'other' END AS render,
       concat('route', CAST(event_id % 3 AS STRING)) AS route,
       event_id % 2 = 0 AS change_ua, event_id % 5 = 0 AS use_cookies,
       event_id % 7 = 0 AS use_human_scroll,
       CAST(event_id % 3 AS INT) AS attempt_index, CAST(event_id % 4 AS INT) AS ip_rotation_count,
       concat('snippet ', CAST(user_id AS STRING)) AS response_snippet,
       value * 100.0 AS latency_ms,
       CASE WHEN level > 1 THEN value * 100.0 / 1000 * 0.001 ELSE 0.0 END AS cost_estimate,
       event_id % 10 = 0 AS llm_decision
FROM (SELECT *, concat('site', CAST(user_id % 30 AS STRING)) AS site,
             CASE event_id % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'detail' WHEN 2 THEN 'review' ELSE 'unknown' END AS page_pattern,
             CAST(1 + event_id % 8 AS INT) AS level, concat('c', CAST(event_id % 8 AS STRING)) AS cfg,
             NOT (event_type = 'error'
                  OR (user_id % 30 = 0 AND event_type IN ('click','view'))
                  OR (user_id % 30 = 1 AND event_type = 'click')) AS success
      FROM events) e
""".strip()

# Phrases planted into document text, chosen so that every rule has rows and most rows have none.
PLANTED = [
    *[p for p in P.INTERSTITIAL_PHRASES],
    *[p for p in P.CHALLENGE_PHRASES if "'" not in p],
    *P.DENIAL_PHRASES,
    *P.LISTING_MARKERS,
    "Cloudflare: Attention Required", "captcha - I am not a robot", "403 Forbidden", "403 denial forbidden",
    "429 Too Many Requests, rate limit", "slow down", "Access Denied, captcha", "request blocked",
    "visid_incap_ imperva", "aws-waf-token", "_datadome", "_px3", "f5_bigip", "sucuri", "_rblz", "fortiweb",
    "captcha data-sitekey=\"k\" hcaptcha", "captcha sitekey=\"k\" turnstile",
    "captcha recaptcha/api.js?render=abc", "captcha <img class=\"captcha\" src=\"a.png\">", "costway.com",
]
RESPONSES = f"""
SELECT doc_id, status_code, is_html, server,
       CASE WHEN doc_id % 61 < {len(PLANTED)} THEN concat(text, ' ', phrase) ELSE text END AS text
FROM (SELECT doc_id, text,
             CASE doc_id % 8 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN NULL
                             WHEN 4 THEN CASE WHEN doc_id % 3 = 0 THEN 451 ELSE 200 END ELSE 200 END AS status_code,
             doc_id % 10 <> 9 AS is_html,
             CASE doc_id % 11 WHEN 0 THEN 'BIG-IP' WHEN 1 THEN 'CF-Ray' WHEN 2 THEN 'Akamai-X-Cache' ELSE 'nginx' END AS server,
             {pick("doc_id % 61", [quoted(p) for p in PLANTED], "''")} AS phrase
      FROM documents) d
""".strip()

# Shop addresses from the crawled ones: hosts get shop names, paths get the shapes shops use.
SITE_OF_PAGE = pick(f"page_id % {len(R.REGISTERED_SITES) + 2}", [quoted(s) for s in R.REGISTERED_SITES], "'example'")
SHOP_PATHS = [
    "/s?k=red", "/dp/B08N5WRWNW", "/search?q=1", "/p/123", "/itm/12345", "/product/9?ref=x", "/ip/toy/55",
    "/Search.html?searchTerm=x", "/a/s/7#top", "/store/5", "/-/A-77", "/sch/i.html?_nkw=bed", "/product-reviews/1",
    "/browse/x", "/c/search",
]
SHOP_URLS = f"""
SELECT page_id, site, url, path, shop_url, html
FROM (SELECT page_id, url, html, site, path,
             CASE WHEN path = '' THEN replace(url, 'example.', concat(site, '.'))
                  ELSE concat('https://', replace(split_part(url, '/', 3), 'example.', concat(site, '.')), path) END AS shop_url
      FROM (SELECT page_id, url, html, {SITE_OF_PAGE} AS site,
                   {pick("page_id % 17", [quoted(p) for p in SHOP_PATHS], "''")} AS path
            FROM pages) a) b
""".strip()

# Task events: five event types stand for the five ledger events.
TASK_EVENTS = """
SELECT event_id, ts, concat('t', CAST(user_id AS STRING)) AS task_id,
       CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'dequeue' WHEN 'purchase' THEN 'success'
                       WHEN 'error' THEN 'failure' ELSE 'retry' END AS event,
       CAST(event_id % 5 AS INT) AS attempt_index, CAST(3 AS INT) AS config_count,
       concat('https://www.site', CAST(user_id % 30 AS STRING), '.com/s?k=', CAST(user_id AS STRING)) AS url,
       concat('site', CAST(user_id % 30 AS STRING)) AS site, 'search' AS page_pattern
FROM events
""".strip()


def page_of(column: str = "p_partkey"):
    return F.floor(F.col(column) / PARTS_PER_PAGE).alias("page_id")


PAGE_SQL = f"CAST(floor(p_partkey / {PARTS_PER_PAGE}.0) AS BIGINT)"


def joined_items(parts: DataFrame, text, sep: str, name: str) -> DataFrame:
    """page_id and the texts of its parts joined in key order; at most PARTS_PER_PAGE per page.

    The shuffle keeps its partition count, as pages read from storage would have many splits; left
    alone, small tables would shrink to one task and the node functions would run in it alone.
    """
    entries = F.sort_array(F.collect_list(F.struct("p_partkey", text.alias("text"))))
    count = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.withColumn("page_id", page_of()).repartition(count, "page_id").groupBy("page_id").agg(
        F.array_join(F.transform(entries, lambda e: e["text"]), sep).alias(name)
    )
