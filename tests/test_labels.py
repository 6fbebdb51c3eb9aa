"""Literal cases for URL and response labels."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from shelfwatch.functions import coerce, urls
from shelfwatch.functions import products as fp
from shelfwatch.functions import responses as fr
from shelfwatch.operators.attempts import pacing

LONG = "x" * 6000


def one(spark, column, **values):
    kinds = {"status": "int", "page": "int"}
    fields = [F.lit(v).cast(kinds.get(k, "string")).alias(k) for k, v in values.items()]
    return spark.range(1).select(*fields).select(column.alias("r")).first()["r"]


VERDICTS = [
    (403, "any", "http_403"), (429, "any", "http_429"), (451, "any", "http_451"), (500, "any", "http_timeout"),
    (None, "", "http_timeout"), (200, "x" * 500, "empty_response"), (200, "x" * 4999, "empty_response"),
    (200, LONG, "none"), (200, LONG + " recaptcha", "captcha"), (200, "recaptcha " * 50, "captcha"),
    (200, LONG + "Are You A Robot", "captcha"), (200, LONG + "just a moment", "cloudflare"),
    (200, LONG + "cf-challenge", "cloudflare"), (200, LONG + "Access Denied", "bot_detected"),
    (200, "data-asin access denied", "none"), (403, "data-asin" + LONG, "http_403"),
    (200, "y" * 100001 + "recaptcha", "none"), (200, "y" * 100001 + "recaptcha enter the characters", "captcha"),
    (200, "costway.com", "none"), (404, "costway.com", "empty_response"),
]


@pytest.mark.parametrize("status, text, expected", VERDICTS)
def test_content_verdict(spark, status, text, expected):
    got = one(spark, fr.text_verdict(F.col("status"), F.col("text"), F.lower("text")), status=status, text=text)
    assert got == expected


def test_content_length_counts_on_its_own(spark):
    verdict = fr.content_verdict(F.col("status"), F.col("text"), F.lower("text"), F.lit(4999))
    assert one(spark, verdict, status=200, text="x" * 2000) == "empty_response"


@pytest.mark.parametrize("text, header, vendor", [
    ("visid_incap_1", "", "incapsula"), ("", "cf-RAY", "cloudflare"), ("__cf_chl_x", "", "cloudflare"),
    ("citrix_netscaler", "", "imperva"), ("", "Akamai-Ghost", "akamai"), ("DataDome", "", "datadome"),
    ("px-captcha", "", "perimeterx"), ("", "BIG-IP", "f5_asm"), ("cloudflare incapsula", "", "incapsula"), ("plain", "nginx", ""),
])
def test_vendor_label(spark, text, header, vendor):
    assert one(spark, fr.vendor_label(F.lower("text"), F.lower("header")), text=text, header=header) == vendor


@pytest.mark.parametrize("status, text, vendor, reason", [
    (403, "403 forbidden access denied", "", "HTTP 403 Forbidden"),
    (200, "access denied 403 denial forbidden", "", "Detected: access denied; Detected: 403 denial"),
    (200, "403 forbidden, too many requests", "", "Detected: 403 forbidden; Detected: too many requests; Detected: slow down".replace("; Detected: slow down", "")),
    (200, "prove you're not a robot, i am not a robot", "cloudflare",
     "Captcha Challenge: prove you're not; Captcha Challenge: i am not a robot; Cloudflare Challenge"),
    (200, "captcha i am not a robot", "", "Captcha Challenge: captcha"),
    (503, "x", "", "HTTP 503 Server Error"), (200, "short", "", "Empty/Minimal Response (5 bytes)"),
    (404, LONG, "", "Generic Block (404)"),
])
def test_block_reason(spark, status, text, vendor, reason):
    column = fr.block_reason(F.col("status"), F.col("text"), F.lower("text"), F.col("vendor"))
    assert one(spark, column, status=status, text=text, vendor=vendor) == reason


@pytest.mark.parametrize("site, url, pattern", [
    ("amazon", "https://www.amazon.com/s?k=x", "search"), ("amazon", "https://www.amazon.com/dp/B08N5WRWNW", "detail"),
    ("amazon", "https://www.amazon.com/DP/b08n5wrwnw", "detail"), ("amazon", "https://www.amazon.com/stores/x", "seller"),
    ("amazon", "https://www.amazon.com/product-reviews/1", "review"), ("nowhere", "https://x/s?k=1", "unknown"),
    ("walmart", "https://www.walmart.com/ip/Toy-1/123", "detail"), ("ebay", "https://www.ebay.com/itm/123", "detail"),
    ("target", "https://www.target.com/", "unknown"), ("wayfair", "https://www.wayfair.com/a/s/1", "search"),
])
def test_page_pattern(spark, site, url, pattern):
    assert one(spark, urls.page_pattern(F.col("site"), F.col("url")), site=site, url=url) == pattern


BASES = ["https://a.example.com/x/y.html?q=1#f", "http://a.example.com", "https://a.example.com/x/"]
HREFS = ["", "/p", "//cdn.example.com/x.js", "https://b.example.com/z", "?q=2", "#top", "rel/page", "../up", "./here",
         "/a/../b", "a?b#c", "mailto:x@example.com", "https://b.example.com", "/p?q#f", "?", "#", "//host", "g;x=1"]


def test_links_resolve_like_urllib(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(rows, "base string, href string")
    got = df.select("base", "href", urls.resolve_link(F.col("base"), F.col("href")).alias("r")).collect()
    assert [(r.base, r.href, r.r) for r in got] == [(b, h, urljoin(b, h)) for b, h in rows]


@pytest.mark.parametrize("pattern, page, url", [
    ("https://x.com/s?k={query}", 1, "https://x.com/s?k=red bed"), ("https://x.com/s?k={query}", 2, "https://x.com/s?k=red bed&page=2"),
    ("https://x.com/find", 1, "https://x.com/find?q=red bed"), ("https://x.com/find?a=1", 3, "https://x.com/find?a=1&q=red bed&page=3"),
    ("https://x.com/{id}/s", 1, "https://x.com/{id}/s?q=red bed"), ("https://x.com/q/{query}", 2, "https://x.com/q/red bed?page=2"),
])
def test_search_from_format(spark, pattern, page, url):
    column = urls.search_from_format(F.col("pattern"), F.lit("q"), F.lit("page"), F.lit("red bed"), F.col("page"))
    assert one(spark, column, pattern=pattern, page=page) == url


@pytest.mark.parametrize("raw, expected", [
    ('{"request_timeout": 45.0, "page_load_timeout": 60}', (45.0, 60.0, [3.0, 8.0], "")),
    ('{"delay_after": "[5, 10]"}', (30.0, 30.0, [5.0, 10.0], "")), ('{"delay_after": [10, 20]}', (30.0, 30.0, [10.0, 20.0], "")),
    ('{"delay_after": ["4", 5], "reasoning": "r"}', (30.0, 30.0, [4.0, 5.0], "r")),
    ('{"invalid": "data"}', (30.0, 30.0, [3.0, 8.0], "")), ('{"request_timeout": null, "page_load_timeout": 9}', (30.0, 30.0, [3.0, 8.0], "")),
    ('{"delay_after": ["x"], "page_load_timeout": 9}', (30.0, 30.0, [3.0, 8.0], "")), ('{"delay_after": {"a": 1}, "page_load_timeout": 9}', (30.0, 30.0, [3.0, 8.0], "")),
    ('{"delay_after": null, "page_load_timeout": 9}', (30.0, 9.0, [3.0, 8.0], "")), ("no json", (30.0, 30.0, [3.0, 8.0], "")),
    ('{"reasoning": 5, "page_load_timeout": 9}', (30.0, 30.0, [3.0, 8.0], "")),
])
def test_threshold_verdict(spark, raw, expected):
    got = one(spark, coerce.threshold_verdict(F.try_parse_json("raw")), raw=raw)
    assert (got.request_timeout, got.page_load_timeout, got.delay_after, got.reasoning) == expected


def test_pacing_branches(spark):
    rows = [("few", 9.0, 0.1, 4), ("failing", 0.0, 0.0, 10), ("slow", 6.0, 0.7, 40), ("fast", 1.0, 0.9, 5), ("fine", 3.0, 1.0, 20)]
    df = spark.createDataFrame(rows, "site string, avg_response_time double, success_rate double, total_requests long")
    got = {r.site: (round(r.request_timeout, 6), r.delay_min, r.delay_max, r.confidence, r.strategy) for r in pacing(df).collect()}
    assert got == {
        "few": (30.0, 3, 8, 0.0, "default"), "failing": (54.0, 4, 12, 0.5, "heuristic_adjusted"),
        "slow": (58.5, 3, 9, 1.0, "heuristic_adjusted"), "fast": (27.0, 3, 8, 0.25, "heuristic_adjusted"),
        "fine": (30.0, 3, 8, 1.0, "heuristic_adjusted"),
    }


def test_field_cleaning(spark):
    assert one(spark, fp.rating_number(F.col("t")), t="4.5 out of 5") == 4.5
    assert one(spark, fp.rating_number(F.col("t")), t="none .") == 0.0
    assert one(spark, fp.review_number(F.col("t")), t="(1,234)") == 1234
    assert one(spark, fp.dollar_amount(F.col("t")), t="was $1,299.99 now $5") == "1299.99"
    assert one(spark, fp.price_number(F.col("t")), t="1.2.3") is None
