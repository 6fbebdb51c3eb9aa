"""Products from JSON: ld+json blocks of a page and captured API payloads.

All of it is row-local. JSON is parsed to VARIANT and walked with array functions, so neither
duplicates within a page nor nested payloads need a shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.urls import is_product_api, site_by_brand
from shelfwatch.operators.items import item, item_rows, no_items

# Comments and scripts are taken as whole tokens, so a script inside a comment is no script and a
# comment mark inside a script is no comment.
TOKEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script"
LD_JSON = (
    r"""(?is)^<script\b[^>]*\stype\s*=\s*(?-i:"application/ld\+json"|'application/ld\+json'|"""
    r"""application/ld\+json(?=[\s>]))[^>]*>(.*)</script$"""
)
PAYLOAD_KEYS = ["products", "items", "results"]
# Steps walked in turn, each only where the ones before left something unsettled. The last is the
# JSON parser's own nesting limit, so a walk always ends.
WALK_DEPTHS = [4, 32, 1000]


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: Column, path: str) -> Column:
    """The value at path if it is text, NULL for any other kind."""
    found = _get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", _get(v, path))


def _elements(v: Column) -> Column:
    return _get(v, "$", "array<variant>")


def _offer(v: Column) -> Column:
    """The offers object, or the first of an offers list."""
    return F.coalesce(_get(v, "$.offers[0]", "variant"), _get(v, "$.offers", "variant"))


def _images(v: Column, with_list: bool) -> Column:
    found = _text(v, "$.image")
    if with_list:
        found = F.coalesce(found, _text(v, "$.image[0]"))
    return F.array_compact(F.array(F.nullif(found, F.lit(""))))


def _is_product(v: Column) -> Column:
    return F.coalesce(_text(v, "$['@type']") == "Product", F.lit(False))


def _json_ld_candidates(html: Column, url: Column) -> Column:
    """All named products of a page's ld+json blocks, repeats included.

    A block that is no JSON is skipped whole; a list element that is no product is skipped alone.
    """
    # Most pages have no such block; a byte search spares them the regex.
    tokens = F.when(html.contains("ld+json"), F.regexp_extract_all(html, F.lit(TOKEN), 0)).otherwise(
        F.array().cast("array<string>")
    )
    blocks = F.filter(tokens, lambda b: b.rlike(LD_JSON))
    parsed = F.transform(blocks, lambda b: F.try_parse_json(F.regexp_extract(b, LD_JSON, 1)))
    entries = F.flatten(F.transform(parsed, lambda v: F.coalesce(_elements(v), F.array(v))))

    def product(v):
        price = F.coalesce(_get(_offer(v), "$.price"), F.lit(""))
        currency = F.coalesce(_get(_offer(v), "$.priceCurrency"), F.lit(""))
        return item(
            url=url,
            title=F.coalesce(_get(v, "$.name"), F.lit("")),
            price=F.when((price != "") & (currency != ""), F.concat_ws(" ", currency, price)).otherwise(price),
            brand=F.coalesce(_text(v, "$.brand"), _text(v, "$.brand.name"), F.lit("")),
            images=_images(v, with_list=True),
        )

    return F.filter(F.transform(F.filter(entries, _is_product), product), lambda p: p["title"] != "")


def with_first(df: DataFrame, items: str, field: str) -> DataFrame:
    """Drop from an array column the items that repeat an earlier item's field.

    The list of values is a projection of its own: inside the lambda it would be built again for
    every item. It is named twice there, because the optimizer folds in what is named once.
    """
    return (
        df.withColumn("_values", F.transform(items, lambda x: x[field]))
        .withColumn(items, F.filter(items, lambda x, i: (i < F.size("_values")) & (
            F.array_position("_values", x[field]) == i + 1)))
        .drop("_values")
    )


def with_json_ld(pages: DataFrame, name: str, where: Column | None = None) -> DataFrame:
    """Pages with an array of items from their ld+json blocks, first per name."""
    found = _json_ld_candidates(F.col("html"), F.col("url"))
    if where is not None:
        found = F.when(where, found).otherwise(no_items())
    return with_first(pages.withColumn(name, found), name, "title")


def json_ld_products(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Product rows of all pages from their ld+json blocks."""
    keep = keep or ["page_id"]
    found = with_json_ld(pages.select(*keep, "url", "html"), "items").drop("html")
    return item_rows(found, "items", site_by_brand(F.col("url")), keep)


def _state(v: Column, done: bool) -> Column:
    return F.struct(v.alias("v"), F.lit(done).alias("done"))


def _descend(at: Column) -> Column:
    """One step down from a place in a payload: into the first payload key there is, else a
    product is done, else into the elements of a list. Places that are done stay as they are."""
    v = at["v"]
    inside = [_get(v, f"$.{key}", "variant") for key in PAYLOAD_KEYS]
    elements = F.coalesce(_elements(v), F.array().cast("array<variant>"))
    step = F.when(at["done"], F.array(_state(v, True)))
    for inner in inside:
        step = step.when(inner.isNotNull(), F.array(_state(inner, False)))
    return step.when(_is_product(v), F.array(_state(v, True))).otherwise(
        F.transform(elements, lambda e: _state(e, False))
    )


def _walk(places: Column, steps: Column) -> Column:
    return F.aggregate(steps, places, lambda acc, _: F.flatten(F.transform(acc, _descend)))


def _payload_item(v: Column) -> Column:
    return item(
        url=F.coalesce(_text(v, "$.url"), F.lit("")),
        title=F.coalesce(_get(v, "$.name"), F.lit("")),
        price=F.coalesce(_get(_offer(v), "$.price"), F.lit("")),
        images=_images(v, with_list=False),
    )


def with_payload_items(payloads: DataFrame, name: str) -> DataFrame:
    """Payloads with an array of items found below products, items and results keys.

    A usual payload settles within a few steps. Only one that has not goes on, up to the parser's
    nesting limit, so no depth is cut off. Each walk is a projection of its own, so what it found
    is not computed again by the next.
    """
    parsed = F.array_compact(F.array(F.try_parse_json("body")))
    df = payloads.withColumn("_found", F.transform(parsed, lambda v: _state(v, False)))
    for depth in WALK_DEPTHS:
        steps = F.when(F.forall("_found", lambda at: at["done"]), F.array().cast("array<int>")).otherwise(
            F.sequence(F.lit(1), F.lit(depth))
        )
        df = df.withColumn("_found", _walk(F.col("_found"), steps))
    return df.withColumn(name, F.transform("_found", lambda at: _payload_item(at["v"]))).drop("_found")


def product_payloads(responses: DataFrame) -> DataFrame:
    """Captured responses that may hold products: JSON content, product address, non-empty body.

    Expects url, content_type and body. An empty JSON value counts as an empty body.
    """
    filled = ~F.trim("body").isin("", "null", "{}", "[]", '""', "0", "false")
    return responses.filter(
        F.col("content_type").contains("json") & is_product_api(F.col("url")) & filled
    )


def payload_products(payloads: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Product rows of all payloads."""
    keep = keep or ["page_id"]
    found = with_payload_items(payloads.select(*keep, "body"), "items").drop("body")
    return item_rows(found, "items", F.lit("unknown"), keep)
