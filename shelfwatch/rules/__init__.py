"""Rule tables: sites, phrases, selectors and limits, kept as plain data."""
