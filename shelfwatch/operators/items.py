"""The common shape of extracted items and its way into product rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.schemas import PRODUCT_COLUMNS, PRODUCT_TYPES

ITEM_FIELDS = {
    "url": "string", "title": "string", "price": "string", "brand": "string", "asin": "string",
    "rating": "double", "review_count": "int", "images": "array<string>",
}
ITEM_DDL = "struct<" + ",".join(f"{n}:{t}" for n, t in ITEM_FIELDS.items()) + ">"


def empty_value(kind: str) -> Column:
    if kind == "double":
        return F.lit(0.0)
    if kind == "int":
        return F.lit(0)
    if kind == "array<string>":
        return F.array().cast(kind)
    return F.lit("")


def item(**fields: Column) -> Column:
    """An item struct; fields not given are empty."""
    return F.struct(*[
        fields.get(n, empty_value(t)).cast(t).alias(n) for n, t in ITEM_FIELDS.items()
    ])


def no_items() -> Column:
    return F.array().cast(f"array<{ITEM_DDL}>")


def unified(products: DataFrame, *extra: str) -> DataFrame:
    """The full product schema from whatever product columns are there, plus extra columns."""
    have = set(products.columns)
    kinds = {c: PRODUCT_TYPES.get(c, "string") for c in PRODUCT_COLUMNS}
    filled = [
        (F.coalesce(F.col(c).cast(t), empty_value(t)) if c in have else empty_value(t).cast(t)).alias(c)
        for c, t in kinds.items()
    ]
    return products.select(*extra, *filled)


def item_rows(pages: DataFrame, items: str, source: Column, keep: list[str]) -> DataFrame:
    """One product row per item, with the page's kept columns and the item's position.

    The outer form keeps the optimizer from adding a size filter below, which would run the whole
    extraction a second time; pages without items drop out right after.
    """
    rows = pages.select(*keep, source.alias("source"), F.posexplode_outer(items).alias("pos", "_item")).filter(
        F.col("_item").isNotNull()
    )
    return unified(rows.select(*keep, "pos", "source", "_item.*"), *keep, "pos")


def merged(*parts: DataFrame) -> DataFrame:
    """Union of product tables by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
