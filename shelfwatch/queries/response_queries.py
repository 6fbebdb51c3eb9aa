"""Response labels."""

from pyspark.sql import functions as F

from shelfwatch.functions import responses as fr
from shelfwatch.operators.verdict_store import VerdictStore
from shelfwatch.operators.verdicts import shared_verdicts
from shelfwatch.plans import jobs
from shelfwatch.queries.tables import ATTEMPTS, RESPONSES, Tables, quoted
from shelfwatch.queries.url_queries import _case, _contains
from shelfwatch.rules import phrases as P
from shelfwatch.session import work_folder

BASE = f"WITH d AS ({RESPONSES}), r AS (SELECT *, lower(text) AS t FROM d)"


def _responses(t: Tables):
    return fr.with_lowered(t.responses())


def _has(words, column="t"):
    return _contains(column, words)


def verdict_sql(status, text, low, length):
    plain = [p for p in P.CHALLENGE_PHRASES if p not in P.IGNORED_WHEN_LONG]
    return _case([
        (f"{status} = 403", "'http_403'"), (f"{status} = 429", "'http_429'"), (f"{status} = 451", "'http_451'"),
        (f"{status} IS NULL OR {status} >= 500", "'http_timeout'"),
        (_has(P.LISTING_MARKERS, low), "'none'"), (_has(P.INTERSTITIAL_PHRASES, low), "'cloudflare'"),
        (_has(plain, low), "'captcha'"),
        (f"length({text}) <= {P.LONG_PAGE_CHARS} AND {_has(P.IGNORED_WHEN_LONG, low)}", "'captcha'"),
        (_has(P.DENIAL_PHRASES, low), "'bot_detected'"),
        (f"(length({text}) < 1000 OR {length} < 5000) AND {status} = 200 AND contains({low}, 'costway.com')", "'none'"),
        (f"length({text}) < 1000 OR {length} < 5000", "'empty_response'"),
    ], "'none'")


def content_verdict(t: Tables):
    # Content length stands for the transferred bytes, so it differs from the text length.
    length = F.length(F.col("text")) * 3
    verdict = fr.content_verdict(F.col("status_code"), F.col("text"), F.col("lowered"), length)
    return _responses(t).select("doc_id", verdict.alias("block_type"), fr.is_blocked(verdict).alias("blocked"))


def page_verdict(t: Tables):
    return jobs.classified(t("pages")).select("page_id", "verdict")


def text_verdict(t: Tables):
    return _responses(t).select("doc_id", fr.text_verdict(F.col("status_code"), F.col("text"), F.col("lowered")).alias("block_type"))


def status_verdict(t: Tables):
    return _responses(t).select("doc_id", fr.status_verdict(F.col("status_code"), F.col("text"), F.col("is_html")).alias("block_type"))


def layered_verdict(t: Tables):
    return _responses(t).select("doc_id", fr.layered_verdict(F.col("status_code"), F.col("text"), F.col("lowered"), F.col("is_html")).alias("block_type"))


LAYER_STATUS = [("status_code IN (403, 429, 451)", "'http_' || status_code"), ("status_code >= 500", "'http_5xx'")]


def reasoned_verdict(t: Tables):
    return _responses(t).select("doc_id", fr.reasoned_verdict(F.col("status_code"), F.col("text"), F.col("lowered")).alias("v")).select("doc_id", "v.*")


_REASONED = [
    ("status_code = 403", "http_403", "HTTP 403 forbidden"),
    ("status_code = 429", "http_429", "HTTP 429 rate limited"),
    ("status_code = 451", "http_451", "HTTP 451 unavailable"),
    ("status_code IS NULL OR status_code >= 500", "http_timeout", "Server error or timeout"),
    (_has(["cloudflare", "cf-challenge", "checking your browser"]) + " AND "
     + _has(["attention required", "just a moment"]), "cloudflare", "Cloudflare challenge detected"),
    ("contains(t, 'captcha') AND " + _has(["verify you are human", "i am not a robot"]),
     "captcha", "CAPTCHA challenge detected"),
    (_has(["access denied", "blocked your ip"]), "bot_detected", "Access denied"),
    (_has(["suspicious activity", "unusual traffic"]), "bot_detected", "Suspicious activity"),
    ("length(text) < 500", "empty_response", "Response content too short"),
]
REASONED_TYPE = _case([(c, quoted(n)) for c, n, _ in _REASONED], "'none'")
REASONED_TEXT = _case([(c, quoted(m)) for c, _, m in _REASONED], "'Normal response'")


def first_indicator(t: Tables):
    return _responses(t).select("doc_id", fr.first_indicator(F.col("lowered")).alias("v")).select("doc_id", "v.*")


def _with_headers(t: Tables):
    named = _responses(t).withColumn("headers", F.create_map(F.lit("server"), F.col("server")))
    return fr.with_header_text(named)


def vendor_labels(t: Tables):
    seen = F.col("lowered"), F.col("header_text")
    return _with_headers(t).select(
        "doc_id", fr.vendor_label(*seen).alias("vendor"),
        fr.vendor_label(*seen, P.SHORT_VENDORS).alias("short_vendor"),
    )


def vendor_sql(short=False):
    seen = "lower(concat(text, ' {\"server\":\"', server, '\"}'))"
    rules = [(v, s) for v, s in P.VENDOR_SIGNATURES if not short or v in P.SHORT_VENDORS]
    return _case([(_contains(seen, s), quoted(v)) for v, s in rules], "''")


def block_reasons(t: Tables):
    vendor = fr.vendor_label(F.col("lowered"), F.col("header_text"))
    status = F.coalesce(F.col("status_code"), F.lit(0))
    return _with_headers(t).withColumn("vendor", vendor).select(
        "doc_id", fr.block_reason(status, F.col("text"), F.col("lowered"), F.col("vendor")).alias("reason"))


def _reason_sql():
    """The reasons as a fold: each step looks for the marker in the text so far."""
    steps, last = [], "s0"
    steps.append("""s0 AS (SELECT doc_id, text, t, status, vendor, CASE WHEN status = 403 THEN 'HTTP 403 Forbidden'
        WHEN status = 429 THEN 'HTTP 429 Rate Limited' WHEN status >= 500 THEN concat('HTTP ', status, ' Server Error')
        ELSE '' END AS acc FROM v)""")
    for _, marker, prefix, words in P.REASON_KEYWORDS:
        for w in words:
            name = f"s{len(steps)}"
            add = quoted(prefix + w)
            steps.append(f"""{name} AS (SELECT * REPLACE (CASE WHEN contains(t, {quoted(w)}) AND NOT contains(acc, '{marker}')
                THEN CASE WHEN acc = '' THEN {add} ELSE acc || '; ' || {add} END ELSE acc END AS acc) FROM {last})""")
            last = name
    name = f"s{len(steps)}"
    steps.append(f"""{name} AS (SELECT * REPLACE (CASE WHEN vendor = 'cloudflare'
        THEN CASE WHEN acc = '' THEN 'Cloudflare Challenge' ELSE acc || '; Cloudflare Challenge' END ELSE acc END AS acc) FROM {last})""")
    return f"""{BASE}, v AS (SELECT doc_id, text, t, coalesce(status_code, 0) AS status, {vendor_sql()} AS vendor FROM r),
    {', '.join(steps)}
    SELECT doc_id, CASE WHEN acc <> '' THEN acc WHEN length(text) < 1000
      THEN concat('Empty/Minimal Response (', length(text), ' bytes)') ELSE concat('Generic Block (', status, ')') END AS reason
    FROM {name}"""


def summaries(t: Tables):
    a = t.attempts()
    failed = fr.failure_summary(
        F.col("site"), F.col("page_pattern"), F.col("level"), F.col("render"), F.col("route"),
        F.col("ip_rotation_count"), F.col("block_type"), F.col("waf_detected"), F.col("latency_ms"), F.col("status_code"))
    passed = fr.success_summary(
        F.col("site"), F.col("page_pattern"), F.col("level"), F.col("render"), F.col("route"), F.col("latency_ms"))
    return a.select("event_id", F.when(F.col("success"), passed).otherwise(failed).alias("summary"))


SUMMARY_SQL = f"""
WITH a AS ({ATTEMPTS})
SELECT event_id, CASE WHEN success
  THEN concat('Site: ', site, ' (', page_pattern, ') | Tier ', level, ' ', render, ' via ', route, ' | Success | ',
              format('{{:.0f}}', latency_ms), 'ms')
  ELSE concat('Site: ', site, ' (', page_pattern, ') | Failed at Tier ', level, ' using ', render, ' via ', route,
              CASE WHEN ip_rotation_count > 0 THEN concat(' | Tried ', ip_rotation_count + 1, ' IPs before giving up') ELSE '' END,
              ' | Result: ', block_type, CASE WHEN waf_detected <> '' THEN ' | WAF Detected: ' || waf_detected ELSE '' END,
              ' | Response Time: ', format('{{:.0f}}', latency_ms), 'ms',
              CASE WHEN status_code <> 0 THEN concat(' | HTTP Status: ', status_code) ELSE '' END) END AS summary
FROM a
"""


def header_digests(t: Tables):
    headers = F.create_map(
        F.lit("content-type"), F.lit("text/html"), F.lit("server"), F.col("server"), F.lit("set-cookie"), F.col("text"))
    status = F.when(F.col("doc_id") % 9 == 0, F.lit(302)).otherwise(F.col("status_code"))
    return t.responses().select("doc_id", fr.header_digest(headers, status).alias("h")).select(
        "doc_id", *[F.coalesce(F.col("h")[k], F.lit("")).alias(k)
                    for k in ("content_type", "server", "set_cookie", "redirect", "cf_challenge")])


HEADER_SQL = f"""{BASE} SELECT doc_id, 'text/html' AS content_type, server, left(text, 200) AS set_cookie,
  CASE WHEN doc_id % 9 = 0 THEN 'Location header present' ELSE '' END AS redirect,
  CASE WHEN doc_id % 9 <> 0 AND status_code = 403 THEN 'Challenge page suspected' ELSE '' END AS cf_challenge FROM r"""


def challenge_labels(t: Tables):
    return _responses(t).select("doc_id", fr.challenge_label(F.col("status_code"), F.col("text"), F.col("lowered")).alias("label"))


LABEL_SQL = f"""{BASE} SELECT doc_id, CASE WHEN status_code = 200 AND {_has(P.CHALLENGE_LABEL_PHRASES)} THEN
  {_case([
      ("contains(text, 'data-sitekey') AND NOT contains(t, 'recaptcha') AND contains(t, 'hcaptcha')", "'hcaptcha'"),
      ("contains(text, 'data-sitekey')", "'recaptcha-v2'"),
      ("contains(text, 'sitekey') AND contains(t, 'turnstile')", "'turnstile'"),
      ("contains(text, 'sitekey')", "'recaptcha-v2'"),
      ("regexp_matches(text, 'recaptcha/api\\.js\\?render=[a-zA-Z0-9_-]+')", "'recaptcha-v3'"),
      (' OR '.join(f"regexp_matches(text, {quoted('(?i)' + r)})" for r in P.IMAGE_LABEL_REGEXES), "'imagecaptcha'"),
  ], "''")} ELSE '' END AS label FROM r"""


def _nullable(t: Tables):
    """Every thirteenth response has no text; the twin has an empty one in its place."""
    return t.responses().withColumn("text", F.when(F.col("doc_id") % 13 != 0, F.col("text")))


def _shared_openings(t: Tables):
    # A third opening is shared on purpose: short openings repeat across documents.
    return t.responses().withColumn(
        "text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.repeat(F.lit("same opening "), F.lit(40)), "text"))
        .otherwise(F.col("text")))


def verdict_sharing(t: Tables):
    return shared_verdicts(_shared_openings(t), "doc_id", P.VERDICT_KEY_CHARS).select("doc_id", "verdict.*")


def stored_verdicts(t: Tables):
    """Two runs over one store: the first over two thirds of the ids, an hour later the second over all responses."""
    store = VerdictStore(t.spark, work_folder(t.spark, "verdict-store"), P.VERDICT_KEY_CHARS)
    r, bound = _shared_openings(t), t("documents").agg((F.max("doc_id") * 2 / 3).alias("b")).first()["b"]
    at = lambda hour: F.to_timestamp(F.lit(f"2024-01-01 {hour:02d}:00:00"))
    store.classify(r.filter(F.col("doc_id") < bound), "doc_id", "1", at(0))
    return store.classify(r, "doc_id", "2", at(1)).select("doc_id", "verdict.*", "origin")


def whole_text_verdicts(t: Tables):
    return shared_verdicts(_nullable(t), "doc_id").select("doc_id", "verdict.*")


SHARING_SQL = f"""WITH d AS ({RESPONSES}),
r AS (SELECT *, lower(text) AS t FROM (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0
      THEN concat(repeat('same opening ', 40), text) ELSE text END AS text) FROM d)),
v AS (SELECT doc_id, status_code, left(text, 500) AS k, {REASONED_TYPE} AS bt, {REASONED_TEXT} AS rs FROM r)
SELECT doc_id, first_value(bt) OVER w AS block_type, first_value(rs) OVER w AS reason FROM v
WINDOW w AS (PARTITION BY status_code, k ORDER BY doc_id)"""


STORED_SQL = SHARING_SQL.replace("AS reason FROM v", """AS reason,
       CASE WHEN first_value(doc_id) OVER w < (SELECT max(doc_id) * 2 / 3 FROM documents) THEN 'stored' ELSE 'new' END AS origin FROM v""")


def samples(t: Tables):
    cuts = [F.length(fr.sample(F.col("html"), use)).alias(use) for use in P.SAMPLE_CHARS]
    return t("pages").select("page_id", *cuts, F.md5(fr.sample(F.col("html"), "strategy")).alias("strategy_md5"))


SAMPLES_SQL = "SELECT page_id, " + ", ".join(
    f"length(left(html, {n}))::INT AS {u}" for u, n in P.SAMPLE_CHARS.items()
) + ", md5(left(html, 500)) AS strategy_md5 FROM pages"


def attempt_costs(t: Tables):
    cost = fr.attempt_cost(F.col("render"), F.col("latency_ms"))
    return t.attempts().select("event_id", F.round(cost, 9).alias("cost"))


def known_verdicts(t: Tables):
    name = F.when(F.col("event_id") % 5 == 0, F.lit("http_5xx")).otherwise(F.col("block_type"))
    return t.attempts().groupBy(fr.known_verdict(name).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def content_counts(t: Tables):
    return jobs.content_counts(t("pages"))


QUERIES = {
    "k01_content_verdict": (content_verdict, f"""{BASE}, v AS (SELECT doc_id, {verdict_sql('status_code', 'text', 't', 'length(text) * 3')} AS b FROM r)
        SELECT doc_id, b AS block_type, b <> 'none' AS blocked FROM v"""),
    "k01_page_verdict": (page_verdict, f"""WITH p AS (SELECT page_id, html, lower(html) AS t, 200 AS s FROM pages)
        SELECT page_id, {verdict_sql('s', 'html', 't', 'length(html)')} AS verdict FROM p"""),
    "k02_text_verdict": (text_verdict, f"{BASE} SELECT doc_id, {verdict_sql('status_code', 'text', 't', 'length(text)')} AS block_type FROM r"),
    "k03_status_verdict": (status_verdict, f"""{BASE} SELECT doc_id, {_case([*LAYER_STATUS,
        ("is_html AND length(text) < 1000", "'empty_response'")], "''")} AS block_type FROM r"""),
    "k04_layered_verdict": (layered_verdict, f"""{BASE} SELECT doc_id, {_case([*LAYER_STATUS,
        ("is_html", verdict_sql('status_code', 'text', 't', 'length(text)'))], "''")} AS block_type FROM r"""),
    "k05_reasoned_verdict": (reasoned_verdict, f"{BASE} SELECT doc_id, {REASONED_TYPE} AS block_type, {REASONED_TEXT} AS reason FROM r"),
    "k06_first_indicator": (first_indicator, f"""{BASE} SELECT doc_id, {_has([w for w, _ in P.INDICATORS])} AS hit,
        {_case([(f"contains(t, {quoted(w)})", quoted(m)) for w, m in P.INDICATORS], "''")} AS message FROM r"""),
    "k07_vendor_labels": (vendor_labels, f"{BASE} SELECT doc_id, {vendor_sql()} AS vendor, {vendor_sql(True)} AS short_vendor FROM r"),
    "k08_block_reasons": (block_reasons, _reason_sql()),
    "k09_summaries": (summaries, SUMMARY_SQL),
    "k10_header_digests": (header_digests, HEADER_SQL),
    "k11_challenge_labels": (challenge_labels, LABEL_SQL),
    "k12_shared_verdicts": (verdict_sharing, SHARING_SQL),
    "k12_whole_text_verdicts": (whole_text_verdicts, f"""WITH r AS (SELECT *, lower(text) AS t FROM (SELECT * REPLACE (
        CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END AS text) FROM ({RESPONSES}) d))
        SELECT doc_id, {REASONED_TYPE} AS block_type, {REASONED_TEXT} AS reason FROM r"""),
    "k12_stored_verdicts": (stored_verdicts, STORED_SQL),
    "k13_samples": (samples, SAMPLES_SQL),
    "k14_attempt_costs": (attempt_costs, f"""WITH a AS ({ATTEMPTS}) SELECT event_id,
        round(CASE WHEN render <> 'none' THEN latency_ms / 1000 * 0.001 ELSE 0.0 END, 9) AS cost FROM a"""),
    "k15_known_verdicts": (known_verdicts, f"""WITH a AS ({ATTEMPTS}) SELECT CASE WHEN event_id % 5 = 0 THEN 'unknown'
        ELSE block_type END AS verdict, count(*) AS n FROM a GROUP BY 1"""),
    "content_counts": (content_counts, f"""WITH p AS (SELECT page_id, url, html, lower(html) AS t, 200 AS s FROM pages)
        SELECT split_part(url, '/', 3) AS host, 'unknown' AS page_pattern,
               {verdict_sql('s', 'html', 't', 'length(html)')} AS verdict, count(*) AS pages,
               sum(length(html))::BIGINT AS chars FROM p GROUP BY 1, 2, 3"""),
}
