"""Phrase lists behind the response labels. All are fixed values; order matters where noted."""

# Markers of a real listing page; any of them ends the verdict with "none".
LISTING_MARKERS = [
    "s-item__title", "data-listingid", "ebay.com/itm/",
    "data-asin", "data-item-id", "product-title",
]

# Interstitial phrases, tested before the challenge phrases.
INTERSTITIAL_PHRASES = [
    "cloudflare", "checking your browser", "cf-challenge", "attention required!", "just a moment",
]

# Challenge phrases.
CHALLENGE_PHRASES = [
    "are you a robot", "prove you're not a robot", "i am not a robot", "verify you are human",
    "complete the captcha", "enter the characters", "type the letters", "recaptcha", "hcaptcha",
    "cf-challenge", "checking your browser",
]
# Challenge phrases ignored on very long pages, and the length that counts as long.
IGNORED_WHEN_LONG = ["recaptcha", "hcaptcha"]
LONG_PAGE_CHARS = 100000

# Denial phrases.
DENIAL_PHRASES = [
    "access denied", "blocked your ip", "suspicious activity", "unusual traffic",
    "automated requests", "please verify", "security check failed",
]

# Lengths below which a text or a body is short, and the mark of a site that is exempt.
SHORT_TEXT_CHARS = 1000
SHORT_BODY_CHARS = 5000
SHORT_BODY_EXEMPT = "costway.com"

# First indicator found decides the message.
INDICATORS = [
    ("captcha", "captcha detected"),
    ("robot", "robot check detected"),
    ("blocked", "blocked detected"),
    ("cf-challenge", "cloudflare challenge"),
    ("access denied", "access denied"),
]

# Protection vendors in order, each with its signatures (case-insensitive).
VENDOR_SIGNATURES = [
    ("incapsula", ["incapsula", "incapsula_incident_id", "_incap_", "visid_incap_"]),
    ("cloudflare", ["cloudflare", "cf-ray", "__cf_chl_", "cloudflare-ray"]),
    ("imperva", ["imperva", "incapsula", "_incapsula_resource", "citrix_netscaler"]),
    ("akamai", ["akamai", "akamai-ghost", "akamai-x-cache"]),
    ("aws_waf", ["aws-waf", "awswaf", "aws-waf-token"]),
    ("datadome", ["datadome", "datadome_cookie", "_datadome"]),
    ("perimeterx", ["perimeterx", "px-captcha", "_px3"]),
    ("f5_asm", ["f5 asm", "big-ip", "f5_bigip"]),
    ("sucuri", ["sucuri", "sucuri-cloudproxy", "_sucuri"]),
    ("reblaze", ["reblaze", "_rblz"]),
    ("fortiweb", ["fortiweb", "fortiweb-cloud"]),
    ("radware", ["radware"]),
    ("的光芒", ["的光芒", "customcaptcha", "recaptcha"]),
]
# The short vendor list of the framework path.
SHORT_VENDORS = ["incapsula", "cloudflare", "imperva", "akamai", "datadome", "perimeterx", "f5_asm"]

# Keyword kinds of the reason text: kind, marker that silences it, prefix, keywords.
REASON_KEYWORDS = [
    ("403", "403", "Detected: ", ["403 forbidden", "access denied", "403 denial", "forbidden"]),
    ("429", "429", "Detected: ", ["429 too many", "rate limit", "too many requests", "slow down"]),
    ("captcha", "captcha", "Captcha Challenge: ",
     ["captcha", "prove you're not", "i am not a robot", "complete the captcha"]),
]

# Phrases that open the challenge label.
CHALLENGE_LABEL_PHRASES = [
    "captcha", "are you a robot", "prove you're not", "i am not a robot", "verify you are human",
    "complete the captcha", "recaptcha", "hcaptcha", "cf-challenge", "checking your browser",
    "type the characters", "enter the code", "enter the letters", "type the text", "image captcha",
]
# Image patterns of the challenge label.
IMAGE_LABEL_REGEXES = [
    r"""<input[^>]+type=["']image["'][^>]*src=["'][^"']+["']""",
    r"""<img[^>]+class=["'][^"']*captcha[^"']*["'][^>]*src=["'][^"']+["']""",
    r"""<img[^>]+id=["'][^"']*captcha[^"']*["'][^>]*src=["'][^"']+["']""",
    r"data:image/[^;]+;base64,[a-zA-Z0-9+/=]+",
]

# Verdict names that map to themselves.
VERDICT_NAMES = [
    "none", "http_403", "http_429", "http_451", "http_timeout",
    "captcha", "cloudflare", "bot_detected", "empty_response", "unknown",
]

# Sample lengths in characters, by use.
SAMPLE_CHARS = {
    "selectors": 8000, "extract": 50000, "verdict": 3000, "thresholds": 2000,
    "url_format": 5000, "strategy": 500, "failed_snippet": 1000, "snippet": 2000,
}
VERDICT_KEY_CHARS = 500

# Word groups of the reasoned verdict, in the order of its rules; below REASONED_SHORT_CHARS a text is empty.
REASONED_INTERSTITIAL = ["cloudflare", "cf-challenge", "checking your browser"]
REASONED_WAITING = ["attention required", "just a moment"]
REASONED_CHALLENGE = "captcha"
REASONED_HUMAN = ["verify you are human", "i am not a robot"]
REASONED_DENIED = ["access denied", "blocked your ip"]
REASONED_UNUSUAL = ["suspicious activity", "unusual traffic"]
REASONED_SHORT_CHARS = 500
