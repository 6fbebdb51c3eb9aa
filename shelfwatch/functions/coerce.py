"""Typed reading of JSON verdicts, with defaults.

A verdict is JSON text of an object. Missing fields take their default. A field of the wrong kind
makes the verdict invalid, and each verdict type says what it keeps then. Text that is no JSON
object reads as an empty object. The functions take the parsed VARIANT; `with_verdict` parses the
text once per row in a projection of its own.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.rules import modules as M
from shelfwatch.rules.selectors import TEMPLATE_FIELDS


def with_verdict(df: DataFrame, json: str, verdict: Callable[[Column], Column], name: str = "verdict") -> DataFrame:
    """Add a typed verdict read from a JSON text column."""
    parsed = df.withColumn("_raw", F.try_parse_json(json))
    return parsed.withColumn(name, verdict(F.col("_raw"))).drop("_raw")


def _field(raw: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(raw, f"$.{name}", kind)


def _kind(raw: Column, name: str) -> Column:
    """Kind of a field's value, "" when the field is missing."""
    return F.coalesce(F.schema_of_variant(_field(raw, name)), F.lit(""))


def _text_ok(raw: Column, name: str) -> Column:
    return _kind(raw, name).isin("", "STRING")


def _text(raw: Column, name: str, default: str) -> Column:
    return F.when(_kind(raw, name) == "STRING", _field(raw, name, "string")).otherwise(F.lit(default))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def selector_verdict(raw: Column) -> Column:
    """Template fields; when any field is no text, the site alone is kept."""
    defaults = {"site": "", "page_type": "search", **dict.fromkeys(TEMPLATE_FIELDS, "")}
    valid = _all([_text_ok(raw, n) for n in defaults])
    site = _text(raw, "site", "")
    return F.struct(*[
        (site if n == "site" else F.when(valid, _text(raw, n, d)).otherwise(F.lit(d))).alias(n)
        for n, d in defaults.items()
    ])


def block_verdict(raw: Column) -> Column:
    """block_type, reasoning and suggested_action; text fields are kept even beside a bad one."""
    defaults = {"block_type": "unknown", "reasoning": "", "suggested_action": "retry_same"}
    return F.struct(*[_text(raw, n, d).alias(n) for n, d in defaults.items()])


def threshold_verdict(raw: Column) -> Column:
    """Timeouts, delay range and reasoning; any bad field gives all defaults.

    Numbers may come as text. The delay may be a list or a list written as JSON text, and an empty
    one takes its default.
    """

    def number(name, default):
        there = _kind(raw, name) != ""
        return F.when(there, _field(raw, name, "double")).otherwise(F.lit(default))

    as_text = _kind(raw, "delay_after") == "STRING"
    delay = F.when(as_text, F.try_parse_json(_field(raw, "delay_after", "string"))).otherwise(
        _field(raw, "delay_after")
    )
    default_delay = F.array(*[F.lit(float(d)) for d in M.DELAY_RANGE])
    # Missing, JSON null, zero and [] all count as empty; unreadable text does not.
    empty = (
        (_kind(raw, "delay_after") == "")
        | F.coalesce(F.schema_of_variant(delay) == "VOID", F.lit(False))
        | F.coalesce(F.try_variant_get(delay, "$", "string").isin("[]", "{}", "0", "0.0", "false", ""), F.lit(False))
    )
    values = F.try_variant_get(delay, "$", "array<double>")
    readable = values.isNotNull() & F.forall(F.coalesce(values, default_delay), lambda x: x.isNotNull())
    request = number("request_timeout", M.REQUEST_TIMEOUT)
    load = number("page_load_timeout", M.PAGE_LOAD_TIMEOUT)
    valid = request.isNotNull() & load.isNotNull() & (empty | readable) & _text_ok(raw, "reasoning")
    return F.struct(
        F.when(valid, request).otherwise(F.lit(M.REQUEST_TIMEOUT)).alias("request_timeout"),
        F.when(valid, load).otherwise(F.lit(M.PAGE_LOAD_TIMEOUT)).alias("page_load_timeout"),
        F.when(valid & ~empty, values).otherwise(default_delay).alias("delay_after"),
        F.when(valid, _text(raw, "reasoning", "")).otherwise(F.lit("")).alias("reasoning"),
    )


def url_format_verdict(raw: Column) -> Column:
    """URL format fields; well-formed fields are kept even beside a bad one."""
    defaults = {"site": "", "search_url_pattern": "", "search_param": "q", "page_param": "page",
                "product_url_pattern": ""}
    scripted = F.coalesce(_field(raw, "uses_js_rendering", "boolean"), F.lit(True))
    return F.struct(
        *[_text(raw, n, d).alias(n) for n, d in defaults.items()], scripted.alias("uses_js_rendering")
    )
