"""Labels for collected responses.

Functions take the response text and, where it is needed in lowercase, a separate `lowered`
column. Compute `lowered` once per row with `with_lowered`: the optimizer keeps a non-trivial
projection that is used many times, so a large page is folded once and not once per phrase.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.text import alternation, any_of, first_case
from shelfwatch.rules import phrases as P


def with_lowered(df: DataFrame, text: str = "text", name: str = "lowered") -> DataFrame:
    return df.withColumn(name, F.lower(_text(F.col(text))))


def _text(text: Column) -> Column:
    """A response without a text is an empty one."""
    return F.coalesce(text, F.lit(""))


def content_verdict(status: Column, text: Column, lowered: Column, content_length: Column) -> Column:
    """Verdict name: status rules, listing markers, phrases, then size. "none" is real content."""
    text, lowered = _text(text), _text(lowered)
    challenge = [p for p in P.CHALLENGE_PHRASES if p not in P.IGNORED_WHEN_LONG]
    short = (F.length(text) < P.SHORT_TEXT_CHARS) | (content_length < P.SHORT_BODY_CHARS)
    return first_case(
        [
            (status.isin(403, 429, 451), F.concat(F.lit("http_"), status.cast("string"))),
            (status.isNull() | (status >= 500), F.lit("http_timeout")),
            (any_of(lowered, P.LISTING_MARKERS), F.lit("none")),
            (any_of(lowered, P.INTERSTITIAL_PHRASES), F.lit("cloudflare")),
            (any_of(lowered, challenge), F.lit("captcha")),
            ((F.length(text) <= P.LONG_PAGE_CHARS) & any_of(lowered, P.IGNORED_WHEN_LONG), F.lit("captcha")),
            (any_of(lowered, P.DENIAL_PHRASES), F.lit("bot_detected")),
            (short & ~((status == 200) & lowered.contains(P.SHORT_BODY_EXEMPT)), F.lit("empty_response")),
        ],
        F.lit("none"),
    )


def text_verdict(status: Column, text: Column, lowered: Column) -> Column:
    """content_verdict with the text length as content length."""
    return content_verdict(status, text, lowered, F.length(_text(text)))


def _status_branches(status: Column) -> list:
    return [
        (status.isin(403, 429, 451), F.concat(F.lit("http_"), status.cast("string"))),
        (status >= 500, F.lit("http_5xx")),
    ]


def status_verdict(status: Column, text: Column, is_html: Column) -> Column:
    """Verdict from the status, plus the size of html responses; "" when not blocked."""
    small = is_html & (F.length(_text(text)) < P.SHORT_TEXT_CHARS)
    return first_case([*_status_branches(status), (small, F.lit("empty_response"))], F.lit(""))


def layered_verdict(status: Column, text: Column, lowered: Column, is_html: Column) -> Column:
    """Status rules first, then the content verdict for html; other content is not blocked ("")."""
    return first_case(
        [*_status_branches(status), (is_html, text_verdict(status, text, lowered))], F.lit("")
    )


def is_blocked(verdict: Column) -> Column:
    return ~verdict.isin("none", "")


# Outcomes of the reasoned verdict, by code.
REASONED_OUTCOMES = [
    ("none", "Normal response"),
    ("http_403", "HTTP 403 forbidden"),
    ("http_429", "HTTP 429 rate limited"),
    ("http_451", "HTTP 451 unavailable"),
    ("http_timeout", "Server error or timeout"),
    ("cloudflare", "Cloudflare challenge detected"),
    ("captcha", "CAPTCHA challenge detected"),
    ("bot_detected", "Access denied"),
    ("bot_detected", "Suspicious activity"),
    ("empty_response", "Response content too short"),
]


def reasoned_code(status: Column, text: Column, lowered: Column) -> Column:
    """Code of the reasoned verdict: a small integer, cheap to aggregate and shuffle."""
    text, lowered = _text(text), _text(lowered)
    interstitial = any_of(lowered, P.REASONED_INTERSTITIAL)
    waiting = any_of(lowered, P.REASONED_WAITING)
    human = any_of(lowered, P.REASONED_HUMAN)
    conditions = [
        status == 403,
        status == 429,
        status == 451,
        status.isNull() | (status >= 500),
        interstitial & waiting,
        lowered.contains(P.REASONED_CHALLENGE) & human,
        any_of(lowered, P.REASONED_DENIED),
        any_of(lowered, P.REASONED_UNUSUAL),
        F.length(text) < P.REASONED_SHORT_CHARS,
    ]
    return first_case([(c, F.lit(code)) for code, c in enumerate(conditions, start=1)], F.lit(0))


def reasoned_outcome(code: Column) -> Column:
    """struct(block_type, reason) of a code."""
    rows = [F.struct(F.lit(t).alias("block_type"), F.lit(r).alias("reason")) for t, r in REASONED_OUTCOMES]
    return F.element_at(F.array(*rows), code + 1)


def reasoned_verdict(status: Column, text: Column, lowered: Column) -> Column:
    """struct(block_type, reason) from co-occurring words; reads no phrase on its own as proof."""
    return reasoned_outcome(reasoned_code(status, text, lowered))


def first_indicator(lowered: Column) -> Column:
    """struct(hit, message) of the first indicator in the text."""

    def found(hit, message):
        return F.struct(F.lit(hit).alias("hit"), F.lit(message).alias("message"))

    return first_case([(lowered.contains(w), found(True, m)) for w, m in P.INDICATORS], found(False, ""))


def with_header_text(df: DataFrame, headers: str = "headers", name: str = "header_text") -> DataFrame:
    """Headers (a map) as lowercased JSON text, in a projection of its own."""
    return df.withColumn(name, F.lower(F.coalesce(F.to_json(headers), F.lit(""))))


def vendor_label(lowered: Column, header_text: Column | None = None, vendors: list[str] | None = None) -> Column:
    """First vendor with a signature in the lowercased text or header text, "" for none."""

    def seen(signatures):
        in_text = any_of(lowered, signatures)
        return in_text if header_text is None else any_of(header_text, signatures) | in_text

    rules = [(v, s) for v, s in P.VENDOR_SIGNATURES if vendors is None or v in vendors]
    return first_case([(seen(s), F.lit(v)) for v, s in rules], F.lit(""))


def block_reason(status: Column, text: Column, lowered: Column, vendor: Column) -> Column:
    """Reason text joined with "; ": status, keywords, vendor, else size.

    A keyword adds a reason unless its kind's marker already stands in an earlier reason. Markers
    only enter through the status reason or through keywords that contain them, so every reason
    has a condition of its own and the text is one flat expression.
    """
    status_reason = (
        F.when(status == 403, F.lit("HTTP 403 Forbidden"))
        .when(status == 429, F.lit("HTTP 429 Rate Limited"))
        .when(status >= 500, F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" Server Error")))
    )
    so_far = F.coalesce(status_reason, F.lit(""))
    reasons = [status_reason]
    for _, marker, prefix, keywords in P.REASON_KEYWORDS:
        silent = so_far.contains(marker)
        for word in keywords:
            hit = lowered.contains(word)
            reasons.append(F.when(hit & ~silent, F.lit(prefix + word)))
            if marker in word:
                silent = silent | hit
    reasons.append(F.when(vendor == "cloudflare", F.lit("Cloudflare Challenge")))
    size = F.length(text)
    fallback = F.when(
        size < P.SHORT_TEXT_CHARS,
        F.concat(F.lit("Empty/Minimal Response ("), size.cast("string"), F.lit(" bytes)")),
    ).otherwise(F.concat(F.lit("Generic Block ("), status.cast("string"), F.lit(")")))
    return F.coalesce(F.nullif(F.concat_ws("; ", *reasons), F.lit("")), fallback)


def failure_summary(
    site: Column, pattern: Column, level: Column, render: Column, route: Column, rotations: Column,
    reason: Column, vendor: Column, latency_ms: Column, status: Column,
) -> Column:
    """One-line summary of a failed attempt, parts joined with " | "."""
    return F.concat_ws(
        " | ",
        F.format_string("Site: %s (%s)", site, pattern),
        F.format_string("Failed at Tier %d using %s via %s", level, render, route),
        F.when(rotations > 0, F.format_string("Tried %d IPs before giving up", rotations + 1)),
        F.concat(F.lit("Result: "), reason),
        F.when(vendor != "", F.concat(F.lit("WAF Detected: "), vendor)),
        F.concat(F.lit("Response Time: "), F.bround(latency_ms, 0).cast("bigint").cast("string"), F.lit("ms")),
        F.when(status != 0, F.concat(F.lit("HTTP Status: "), status.cast("string"))),
    )


def success_summary(
    site: Column, pattern: Column, level: Column, render: Column, route: Column, latency_ms: Column,
) -> Column:
    """One-line summary of a successful attempt."""
    return F.concat_ws(
        " | ",
        F.format_string("Site: %s (%s)", site, pattern),
        F.format_string("Tier %d %s via %s", level, render, route),
        F.lit("Success"),
        F.concat(F.bround(latency_ms, 0).cast("bigint").cast("string"), F.lit("ms")),
    )


def header_digest(headers: Column, status: Column) -> Column:
    """Kept headers as a map: content type, server, cookie cut to 200, and notes by status."""

    def kept(name):
        return F.coalesce(F.element_at(headers, name), F.lit(""))

    digest = F.create_map(
        F.lit("content_type"), kept("content-type"),
        F.lit("server"), kept("server"),
        F.lit("set_cookie"), F.left(kept("set-cookie"), F.lit(200)),
    )
    empty = F.create_map().cast("map<string,string>")
    note = (
        F.when(status.isin(301, 302, 303, 307, 308),
               F.create_map(F.lit("redirect"), F.lit("Location header present")))
        .when(status == 403, F.create_map(F.lit("cf_challenge"), F.lit("Challenge page suspected")))
        .otherwise(empty)
    )
    return F.map_concat(F.when(headers.isNotNull(), digest).otherwise(empty), note)


def challenge_label(status: Column, text: Column, lowered: Column) -> Column:
    """Kind of challenge on a status-200 page, "" for none. A label only; nothing is captured."""
    by_attribute = (
        F.when(lowered.contains("recaptcha"), F.lit("recaptcha-v2"))
        .when(lowered.contains("hcaptcha"), F.lit("hcaptcha"))
        .otherwise(F.lit("recaptcha-v2"))
    )
    by_key = F.when(lowered.contains("turnstile"), F.lit("turnstile")).otherwise(F.lit("recaptcha-v2"))
    kind = first_case(
        [
            (text.contains("data-sitekey"), by_attribute),
            (text.contains("sitekey"), by_key),
            (text.rlike(r"recaptcha/api\.js\?render=[a-zA-Z0-9_-]+"), F.lit("recaptcha-v3")),
            (text.rlike(alternation(P.IMAGE_LABEL_REGEXES, ignore_case=True)), F.lit("imagecaptcha")),
        ],
        F.lit(""),
    )
    return F.when((status == 200) & any_of(lowered, P.CHALLENGE_LABEL_PHRASES), kind).otherwise(F.lit(""))


def sample(text: Column, use: str) -> Column:
    """Text cut to the length its use allows."""
    return F.left(text, F.lit(P.SAMPLE_CHARS[use]))


def attempt_cost(render: Column, latency_ms: Column) -> Column:
    """Seconds times 0.001 when a renderer was used, else 0."""
    return F.when(render != "none", latency_ms / 1000 * 0.001).otherwise(F.lit(0.0))


def known_verdict(name: Column) -> Column:
    """Verdict name itself when it is a known one, else unknown."""
    return F.when(name.isin(P.VERDICT_NAMES), name).otherwise(F.lit("unknown"))
