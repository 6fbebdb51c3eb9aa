"""Field cleaning for extracted products."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def price_digits(text: Column) -> Column:
    """Digits and dots of a price text."""
    return F.regexp_replace(text, r"[^0-9.]", "")


def price_number(text: Column) -> Column:
    """Price as DECIMAL(18,2), NULL when the text is no number."""
    return F.nullif(price_digits(text), F.lit("")).try_cast("decimal(18,2)")


def dollar_amount(text: Column) -> Column:
    """First dollar amount in a text, commas dropped, "" for none."""
    return F.replace(F.regexp_extract(text, r"\$([0-9,]+\.?[0-9]*)", 1), F.lit(","), F.lit(""))


def whole_and_fraction(whole: Column, fraction: Column) -> Column:
    """whole.fraction when the fraction node exists, else the whole part."""
    return F.concat_ws(".", whole, fraction)


def rating_number(text: Column) -> Column:
    """First decimal in a rating text, 0.0 for none."""
    return F.coalesce(F.regexp_extract(text, r"([0-9.]+)", 1).try_cast("double"), F.lit(0.0))


def review_number(text: Column) -> Column:
    """First grouped integer in a review text, 0 for none."""
    digits = F.replace(F.regexp_extract(text, r"([0-9,]+)", 1), F.lit(","), F.lit(""))
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def tidy_title(title: Column) -> Column:
    """Title trimmed and cut to 200 characters."""
    return F.left(F.trim(title), F.lit(200))


def image_list(src: Column, lazy_src: Column) -> Column:
    """Zero or one image: src, else the lazy-load source."""
    found = F.nullif(F.coalesce(F.nullif(src, F.lit("")), lazy_src), F.lit(""))
    return F.array_compact(F.array(found))
