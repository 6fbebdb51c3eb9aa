"""Example-set modules and pacing limits. Fixed values."""

# Module, minimum rows, minimum new rows, seconds between builds, example set.
MODULES = [
    ("strategy_selector", 50, 10, 3600, "strategy_selection"),
    ("initial_tier_selector", 30, 5, 7200, "initial_tier"),
    ("selector_extractor", 20, 5, 1800, "selector_extraction"),
    ("block_detector", 30, 5, 3600, "block_detection"),
    ("threshold_optimizer", 20, 5, 1800, "threshold_optimization"),
    ("url_discoverer", 15, 3, 3600, "url_discovery"),
    ("human_behavior_generator", 10, 3, 7200, "human_behavior"),
    ("profile_generator", 10, 3, 7200, "profile_generation"),
]

# Pacing defaults (seconds) and the history lengths.
REQUEST_TIMEOUT = 30.0
PAGE_LOAD_TIMEOUT = 30.0
DELAY_RANGE = (3, 8)
RESPONSE_TIMES_KEPT = 50
ATTEMPTS_KEPT = 20
CACHE_SECONDS = 86400
SHORT_CACHE_SECONDS = 3600
