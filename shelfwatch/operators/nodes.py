"""Products from HTML nodes, by selector template or by site profile.

Node selection is the one step Catalyst has no expression for. It runs as an Arrow function that
sees only the columns it needs, parses a page once for both kinds of rules, and hands back raw
text; trimming to numbers, prices and addresses is Catalyst work on the result.
"""

from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwatch.functions import products as fp
from shelfwatch.functions.text import first_case
from shelfwatch.operators import dom
from shelfwatch.operators.items import item, item_rows
from shelfwatch.rules import selectors as S

RAW_FIELDS = ["title", "price", "fraction", "rating", "reviews", "src", "lazy_src", "link", "product_id"]
RAW_ARROW = pa.list_(pa.struct([(f, pa.string()) for f in RAW_FIELDS]))
_RAW_TYPE = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in RAW_FIELDS]))
NODES_TYPE = T.StructType([
    T.StructField("css", _RAW_TYPE), T.StructField("profile", _RAW_TYPE), T.StructField("error", T.StringType()),
])
TEMPLATE_DDL = "struct<" + ",".join(f"{f}:string" for f in S.TEMPLATE_FIELDS) + ">"


def _raw(**fields):
    return {f: fields.get(f) for f in RAW_FIELDS}


def template_nodes(root, url: str, template: dict) -> list:
    """Raw fields of the items of a page under a selector template."""
    items = dom.select(root, template["list_container"]) if template["list_container"] else []
    if not items and template["product_selector"]:
        items = dom.select(root, template["product_selector"])
    if not items:
        items = dom.select(root, "li, div")
    used = {f: d if template[f] is None else template[f] for f, d in S.MISSING_SELECTORS.items()}
    if not all(used.values()):
        return []  # an empty selector matches nothing it could be applied to
    rows = []
    for node in items:
        inner = list(node.walk())
        part = {f: dom.first(inner, s) for f, s in used.items()}
        price, image, link = part["price_selector"], part["image_selector"], part["link_selector"]
        fraction = None
        if price is not None and template["price_fraction_selector"]:
            fraction = dom.first(inner, template["price_fraction_selector"])
        href = link.attrs.get("href", "") if link is not None else ""
        attribute = template["product_id_attribute"]
        rows.append(_raw(
            title=_text(part["title_selector"]), price=_text(price), fraction=_text(fraction),
            rating=_text(part["rating_selector"]), reviews=_text(part["review_count_selector"]),
            src=image.attrs.get("src") if image is not None else None,
            lazy_src=image.attrs.get("data-src") if image is not None else None,
            link=urljoin(url, href) if href else None,
            product_id=node.attrs.get(attribute, "") if attribute else None,
        ))
    return rows


def _text(node):
    return None if node is None else node.text()


def profile_nodes(root, url: str, site: str) -> list:
    """Raw fields of all items of a page under its site's profile."""
    profile = S.SITE_PROFILES.get(site)
    if profile is None:
        return []
    item_sel, link_sel, title_sel, title_alt, price_sel, price_alt, prefix = profile
    image_sel = S.PROFILE_IMAGE_SELECTORS.get(site, "img")
    rows, seen = [], set()
    for node in dom.select(root, item_sel):
        inner = list(node.walk())
        image = dom.first(inner, image_sel)
        src = image.attrs.get("src") if image is not None else None
        lazy = image.attrs.get("data-src") if image is not None and site not in S.SRC_ONLY_IMAGES else None
        if not link_sel and site == "target":
            href = node.attrs.get("href", "").split("#")[0].split("?")[0]
            if not href or href in seen:
                continue
            seen.add(href)
            spans = (n.content() for n in dom.select(node, title_alt))
            title = node.attrs.get("aria-label") or next((t for t in spans if len(t) > 10), "")
            box = node.closest(("li", "div", "section"))
            rows.append(_raw(title=title, price=box.content() if box is not None else "", src=src,
                             lazy_src=lazy, link=prefix + href))
            continue
        title = _first_content(inner, title_sel, title_alt)
        price = _first_content(inner, price_sel, price_alt)
        identity = node.attrs.get("data-asin", "") if site == "amazon" else None
        link = dom.first(inner, link_sel) if link_sel else None
        if identity is not None:
            address = prefix + identity if identity else ""
        elif link is None:
            address = ""
        else:
            href = link.attrs.get("href", "")
            address = (prefix + href if prefix else urljoin(url, href)).split("?")[0]
        rows.append(_raw(title=title, price=price, src=src, lazy_src=lazy, link=address, product_id=identity))
    return rows


def _first_content(nodes, *selectors):
    for selector in selectors:
        found = dom.first(nodes, selector) if selector else None
        if found is not None:
            return found.content()
    return ""


@F.arrow_udf(NODES_TYPE)
def page_nodes(html: pa.Array, url: pa.Array, site: pa.Array, template: pa.Array) -> pa.Array:
    """Raw nodes of each page under its template (css) and its site's profile; NULL html gives NULL.

    A page that cannot be parsed or read gives no nodes and says why in `error`; the others go on.
    """
    css, profile, errors, present = [], [], [], []
    for page, address, name, rules in zip(html, url, site, template):
        text = page.as_py()
        present.append(text is not None)
        if text is None:
            css.append(None)
            profile.append(None)
            errors.append(None)
            continue
        found, failed = {"css": [], "profile": []}, []
        base, rules = address.as_py() or "", rules.as_py()
        try:
            root = dom.parse(text)
        except Exception as e:  # noqa: BLE001  any markup may come in; one page must not end the job
            failed.append(f"parse: {type(e).__name__}: {e}")
        else:
            for part, select in (("css", lambda: template_nodes(root, base, rules) if rules else []),
                                 ("profile", lambda: profile_nodes(root, base, name.as_py()))):
                try:
                    found[part] = select()
                except Exception as e:  # noqa: BLE001  such as a selector outside the supported set
                    failed.append(f"{part}: {type(e).__name__}: {e}")
        css.append(found["css"])
        profile.append(found["profile"])
        errors.append("; ".join(failed) or None)
    return pa.StructArray.from_arrays(
        [pa.array(css, RAW_ARROW), pa.array(profile, RAW_ARROW), pa.array(errors, pa.string())],
        names=["css", "profile", "error"], mask=pa.array([not p for p in present]),
    )


def template_struct(fields: dict) -> Column:
    return F.struct(*[F.lit(fields.get(f)).cast("string").alias(f) for f in S.TEMPLATE_FIELDS])


def default_template(site: Column) -> Column:
    """Default selectors of a site as a struct, without a join."""
    branches = [(site == s, template_struct(t)) for s, t in S.DEFAULT_TEMPLATES.items() if s]
    return first_case(branches, template_struct(S.DEFAULT_TEMPLATES[""]))


def template_items(raw: Column, url: Column, limit: int | None = None) -> Column:
    """Items from raw template nodes, the first `limit` or all; kept when there is a title or a price."""
    if limit is not None:
        raw = F.slice(raw, 1, limit)

    def clean(r):
        return item(
            url=F.coalesce(r["link"], url),
            title=F.coalesce(r["title"], F.lit("")),
            price=F.when(r["price"].isNull(), F.lit("")).otherwise(fp.whole_and_fraction(r["price"], r["fraction"])),
            rating=fp.rating_number(F.coalesce(r["rating"], F.lit(""))),
            review_count=fp.review_number(F.coalesce(r["reviews"], F.lit(""))),
            images=fp.image_list(r["src"], r["lazy_src"]),
            asin=F.coalesce(r["product_id"], F.lit("")),
        )

    return F.filter(F.transform(raw, clean), lambda p: (p["title"] != "") | (p["price"] != ""))


def profile_items(raw: Column, site: Column) -> Column:
    """Items from raw profile nodes, with the site's price and row rules."""
    is_target = site == "target"

    def clean(r):
        return item(
            url=r["link"],
            title=F.when(is_target, F.left(r["title"], F.lit(200))).otherwise(r["title"]),
            price=F.when(is_target, fp.dollar_amount(r["price"])).otherwise(fp.price_digits(r["price"])),
            images=fp.image_list(r["src"], r["lazy_src"]),
            asin=F.coalesce(r["product_id"], F.lit("")),
        )

    def kept(p):
        return (
            (p["title"] != "")
            & ((site != "ebay") | (p["url"] != ""))
            & ((site != "amazon") | (p["asin"] != ""))
            & ((site != "target") | (F.length(p["title"]) > 5))
        )

    return F.filter(F.transform(raw, clean), kept)


def with_nodes(pages: DataFrame, html: Column | None = None, css: bool = True, profile: bool = True) -> DataFrame:
    """Pages with a `nodes` struct. Expects url, html, and site and template columns where used."""
    site = F.coalesce("site", F.lit("")) if profile else F.lit("")
    template = F.col("template") if css else F.lit(None).cast(TEMPLATE_DDL)
    return pages.withColumn("nodes", page_nodes(F.col("html") if html is None else html, "url", site, template))


def template_products(pages: DataFrame, keep: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Product rows by selector template: the first `limit` items of a page, or all."""
    keep = keep or ["page_id"]
    found = with_nodes(pages, profile=False).select(
        *keep, "site", template_items(F.col("nodes.css"), F.col("url"), limit).alias("items")
    )
    return item_rows(found, "items", F.col("site"), keep)


def profile_products(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Product rows by site profile."""
    keep = keep or ["page_id"]
    found = with_nodes(pages, css=False).select(
        *keep, "site", profile_items(F.col("nodes.profile"), F.col("site")).alias("items")
    )
    return item_rows(found, "items", F.col("site"), keep)


def resolved_templates(keys: DataFrame, cached: DataFrame, stored: DataFrame) -> DataFrame:
    """Template of each (site, page_type): a fresh cached row, else the stored one, else the default.

    cached holds (site, page_type, template struct) rows that are still fresh. Stored rows count
    only where has_sample is true. The chosen row is taken whole: a NULL field stays missing.
    """
    c = cached.select("site", "page_type", F.col("template").alias("_cached"))
    s = stored.select("site", "page_type", F.col("template").alias("_stored"))
    chosen = F.coalesce("_cached", F.when(F.col("has_sample"), F.col("_stored")), default_template(F.col("site")))
    return (
        keys.join(c, ["site", "page_type"], "left")
        .join(s, ["site", "page_type"], "left")
        .withColumn("origin", F.when(F.col("_cached").isNotNull(), F.lit("cached"))
                    .when(F.col("has_sample") & F.col("_stored").isNotNull(), F.lit("stored"))
                    .otherwise(F.lit("default")))
        .withColumn("template", chosen)
        .drop("_cached", "_stored")
    )
