"""Table schemas. Missing text is "" and missing numbers are 0, as the writers of these logs do."""

PRODUCT_COLUMNS = [
    "source", "url", "title", "price", "currency", "rating", "review_count", "brand",
    "description", "images", "availability", "asin", "seller", "shipping", "category",
    "extracted_at",
]

PRODUCT_TYPES = {"rating": "double", "review_count": "int", "images": "array<string>"}

# price stays text because it may carry a currency; price_number() gives the decimal.
PRODUCT_DDL = ", ".join(f"{c} {PRODUCT_TYPES.get(c, 'string')}" for c in PRODUCT_COLUMNS)

# One row per fetch attempt. The fetch configuration is one opaque struct.
FETCH_CONFIG_DDL = (
    "struct<route string, render string, change_ua boolean, use_cookies boolean, "
    "use_human_scroll boolean, delay_after array<double>>"
)
ATTEMPT_DDL = f"""
    trace_id string, timestamp timestamp, site string, page_pattern string, url string,
    block_type string, response_snippet string, response_headers map<string,string>,
    status_code int, full_html_size bigint, level int, fetch_config {FETCH_CONFIG_DDL},
    success boolean, latency_ms double, cost_estimate double, attempt_index int,
    llm_decision boolean, ip_rotation_count int, waf_detected string, human_friendly_summary string
"""

# Flat keys of one line of the attempt log.
ATTEMPT_LINE_DDL = """
    trace_id string, timestamp string, site string, page_pattern string, url string,
    block_type string, response_snippet string, response_headers map<string,string>,
    status_code int, full_html_size bigint, strategy_tier int, strategy_proxy string,
    strategy_render string, strategy_change_ua boolean, strategy_use_cookies boolean,
    strategy_use_human_scroll boolean, strategy_delay_after array<double>,
    success boolean, latency_ms double, cost_estimate double, attempt_index int,
    llm_decision boolean, ip_rotation_count int, waf_detected string, human_friendly_summary string
"""
