"""Label rules against plain Python on random mixes of phrases."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwatch.functions import responses as fr
from shelfwatch.rules import phrases as P
from shelfwatch.sources import product_files
from shelfwatch.operators.items import unified

POOL = [
    *P.LISTING_MARKERS[:2], *P.INTERSTITIAL_PHRASES, *P.CHALLENGE_PHRASES, *P.DENIAL_PHRASES,
    *[w for _, _, _, words in P.REASON_KEYWORDS for w in words], P.SHORT_BODY_EXEMPT, "attention required", "robot", "blocked",
]


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        words = rng.sample(POOL, rng.choice([0, 1, 1, 2, 3]))
        words = [w.upper() if rng.random() < 0.3 else w for w in words]
        filler = "é" * rng.choice([0, 400, 900, 3000, 6000])
        status = rng.choice([200, 200, 200, 200, 404, 403, 429, 451, 500, 599, None])
        rows.append((i, status, " ".join([filler, *words]), rng.choice([0, 4999, 5000, 9000]), rng.choice(["", "cloudflare"])))
    return spark.createDataFrame(rows, "id int, status int, text string, size int, vendor string").withColumn("low", F.lower("text"))


def verdict(status, text, size):
    if status in (403, 429, 451):
        return f"http_{status}"
    if status is None or status >= 500:
        return "http_timeout"
    low = text.lower()
    for words, name in ((P.LISTING_MARKERS, "none"), (P.INTERSTITIAL_PHRASES, "cloudflare"),
                        (P.CHALLENGE_PHRASES, "captcha"), (P.DENIAL_PHRASES, "bot_detected")):
        if any(w in low for w in words):
            return name
    small = len(text) < 1000 or size < 5000
    return "empty_response" if small and not (status == 200 and "costway.com" in low) else "none"


def reason(status, text, vendor):
    status = status or 0
    parts = {403: ["HTTP 403 Forbidden"], 429: ["HTTP 429 Rate Limited"]}.get(status, [])
    parts = list(parts) or ([f"HTTP {status} Server Error"] if status >= 500 else [])
    for _, marker, prefix, words in P.REASON_KEYWORDS:
        for word in words:
            if word in text.lower() and marker not in str(parts):
                parts.append(prefix + word)
    if vendor == "cloudflare":
        parts.append("Cloudflare Challenge")
    if parts:
        return "; ".join(parts)
    return f"Empty/Minimal Response ({len(text)} bytes)" if len(text) < 1000 else f"Generic Block ({status})"


def test_verdicts_and_reasons(cases):
    got = cases.select(
        "*", fr.content_verdict(F.col("status"), F.col("text"), F.col("low"), F.col("size")).alias("v"),
        fr.block_reason(F.coalesce("status", F.lit(0)), F.col("text"), F.col("low"), F.col("vendor")).alias("r"),
        fr.first_indicator(F.col("low")).alias("i"),
    ).collect()
    for row in got:
        assert row.v == verdict(row.status, row.text, row["size"]), row
        assert row.r == reason(row.status, row.text, row.vendor), row
        hits = [m for w, m in P.INDICATORS if w in row.text.lower()]
        assert row.i.message == (hits[0] if hits else ""), row


def test_product_files_keep_empty_and_odd_text(spark, tmp_path):
    rows = [("s", "a,b", 'q"u"o', "line\nbreak", ["x,y", 'z"']), ("s", "", "", "", []), ("t/u", "é", "\\", " pad ", [""])]
    odd = unified(spark.createDataFrame(rows, "source string, title string, price string, seller string, images array<string>"))
    day = F.to_date(F.lit("2024-02-01"))
    product_files.write_products_json(odd, str(tmp_path / "json"), day)
    product_files.write_products_csv(odd, str(tmp_path / "csv"), day)
    want = sorted(rows)
    for back in (product_files.read_products_json(spark, str(tmp_path / "json")), product_files.read_products_csv(spark, str(tmp_path / "csv"))):
        got = sorted((r.source, r.title, r.price, r.seller, r.images) for r in back.collect())
        assert got == want
