"""Extraction chain: per page, the first step that reaches its site's minimum wins.

Steps that read the page itself are row-local, so the chain is one narrow pass over the pages:
ld+json items first, then nodes for the pages where those fell short. HTML is gone before the only
join, which brings in payload counts when a payload table is given.
"""

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from shelfwatch.functions.text import first_case
from shelfwatch.functions.urls import site_by_domain
from shelfwatch.operators.items import item_rows, merged, no_items, unified
from shelfwatch.operators.nodes import default_template, profile_items, template_items, with_nodes
from shelfwatch.operators.structured import with_json_ld
from shelfwatch.rules import sites as R
from shelfwatch.schemas import PRODUCT_COLUMNS, PRODUCT_DDL
from shelfwatch.session import work_folder


def minimums(site: Column) -> dict[str, Column]:
    """Minimum count per step for a site; NULL where the site's chain has no such step."""
    rows = R.chain_rows()
    out = {}
    for i, step in enumerate(R.CHAIN_STEPS, start=1):
        by_value: dict = {}
        for row in rows:
            by_value.setdefault(row[i], []).append(row[0])
        branches = [(site.isin(names), F.lit(v).cast("int")) for v, names in by_value.items()]
        out[step] = first_case(branches, F.lit(R.DEFAULT_CHAIN[step]).cast("int"))
    return out


FEW_CHAIN_ROWS = 100_000  # rows of a chain table that may be broadcast


def fixed_steps(site: Column) -> Column:
    """The fixed chain of a site as an array of (place, step, least), in order."""
    least = minimums(site)
    return F.filter(F.array(*[F.struct(F.lit(n).alias("place"), F.lit(s).alias("step"), least[s].alias("least")) for n, s in enumerate(R.CHAIN_STEPS)]),
                    lambda s: s["least"].isNotNull())


def with_steps(pages: DataFrame, chains: DataFrame) -> DataFrame:
    """Pages with `_chain`, the steps of their site in order, out of rows (site, place, step, least).

    Rows without a site are the chain of all sites that have none of their own; without such rows
    those have no step. Steps of one place go by name.
    """
    step = F.struct(F.col("place").cast("int").alias("place"), "step", F.col("least").cast("int").alias("least"))
    own = chains.filter("site IS NOT NULL").groupBy(F.col("site").alias("_chain_site")).agg(F.sort_array(F.collect_list(step)).alias("_own"))
    own = F.broadcast(own) if chains.limit(FEW_CHAIN_ROWS + 1).count() <= FEW_CHAIN_ROWS else own
    other = chains.filter("site IS NULL").select(step.alias("s")).select("s.*").collect()  # the steps of one chain
    other = [F.struct(F.lit(r.place).alias("place"), F.lit(r.step).alias("step"), F.lit(r.least).alias("least")) for r in sorted(other)]
    kind = own.schema["_own"].dataType
    joined = pages.join(own, pages["site"] == own["_chain_site"], "left")
    return joined.withColumn("_chain", F.coalesce("_own", F.array(*other).cast(kind))).drop("_own", "_chain_site")


def winning_steps(
    pages: DataFrame, payloads: DataFrame | None = None, keep: list[str] | None = None, limit: int | None = None,
    chains: DataFrame | None = None, feeds: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """One row per page: the winning step, its method and its items (those of payloads and feeds stay apart).

    pages has page_id, url and html, optionally site and template. payloads holds product rows by
    page_id. limit caps the template items of a page, none by default.

    chains gives the steps of the sites as data, rows (site, place, step, least); without it the fixed ones hold.
    A step is one of R.CHAIN_STEPS or a name in feeds, whose frames hold product rows by page_id from
    anywhere else. The first step with at least `least` rows wins; an unknown one never does.
    """
    keep, feeds = keep or ["page_id"], feeds or {}
    if "site" not in pages.columns:
        pages = pages.withColumn("site", site_by_domain(F.col("url")))
    if "template" not in pages.columns:
        pages = pages.withColumn("template", default_template(F.col("site")))
    if chains is None:
        pages = pages.withColumn("_chain", fixed_steps(F.coalesce("site", F.lit(""))))
    else:
        pages = with_steps(pages, chains)
    chain = F.col("_chain")

    def first_of(counts: dict[str, Column]) -> Column:
        """The first step of the chain that reaches its least count, NULL if none does."""
        reached = lambda s: reduce(lambda a, b: a | b, [(s["step"] == n) & (c >= s["least"]) for n, c in counts.items()], F.lit(False))
        return F.get(F.filter(chain, lambda s: F.coalesce(reached(s), F.lit(False))), F.lit(0))

    ld = F.exists(chain, lambda s: s["step"] == "json_ld")
    local = with_json_ld(pages, "_ld", where=ld)
    # A page is parsed only where a step on its nodes can still win: not if ld+json does, before all of them.
    served = first_of({"json_ld": F.size("_ld")})["place"]
    on_nodes = F.exists(chain, lambda s: s["step"].isin("profile", "css") & (served.isNull() | (s["place"] < served)))
    local = with_nodes(local, F.when(on_nodes, F.col("html"))).select(
        *keep, "url", "site", "_chain", "_ld",
        F.coalesce(profile_items(F.col("nodes.profile"), F.coalesce("site", F.lit(""))), no_items()).alias("_profile"),
        F.coalesce(template_items(F.col("nodes.css"), F.col("url"), limit), no_items()).alias("_css"),
    )
    counts = {"json_ld": F.size("_ld"), "profile": F.size("_profile"), "payload": F.lit(0), "css": F.size("_css")}
    apart = ({} if payloads is None else {"payload": payloads}) | feeds
    for n, (name, rows) in enumerate(apart.items()):
        of = rows.groupBy("page_id").agg(F.count(F.lit(1)).alias(f"_count{n}"))
        local = local.join(of, "page_id", "left")
        counts[name] = F.coalesce(f"_count{n}", F.lit(0))
    items = {"json_ld": F.col("_ld"), "profile": F.col("_profile"), "css": F.col("_css")}
    won = F.col("strategy")
    named = local.withColumn("strategy", F.coalesce(first_of(counts)["step"], F.lit("none")))
    methods = R.CHAIN_METHODS | {name: "feed" for name in feeds}
    return named.select(
        *keep, "url", "site", "strategy",
        first_case([(won == s, F.lit(m)) for s, m in methods.items()], F.lit("none")).alias("method"),
        first_case([(won == s, i) for s, i in items.items()], no_items()).alias("items"),
        first_case([(won == s, c) for s, c in counts.items()], F.lit(0)).cast("int").alias("product_count"),
    )


def chain_products(
    pages: DataFrame, payloads: DataFrame | None = None, keep: list[str] | None = None,
    limit: int | None = None, folder: str | None = None, chains: DataFrame | None = None, feeds: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Product rows of the winning steps, with strategy and method.

    With payloads or feeds the winners are needed twice: for their own items, and to pick the pages whose
    rows there count. They are written below `folder` or the shared work folder first, without
    HTML, so pages are extracted once.
    """
    keep = keep or ["page_id"]
    apart = ({} if payloads is None else {"payload": payloads}) | (feeds or {})
    winners = winning_steps(pages, payloads, keep, limit, chains, feeds)
    if apart:
        path = work_folder(pages.sparkSession, "chain", folder)
        winners.write.parquet(path)
        winners = pages.sparkSession.read.parquet(path)
    columns = [*dict.fromkeys([*keep, "strategy", "method"])]
    parts = [item_rows(winners, "items", F.coalesce("site", F.lit("unknown")), columns)]
    for name, rows in apart.items():
        chosen = winners.filter(F.col("strategy") == name).select(*columns)
        rows = rows if "pos" in rows.columns else rows.withColumn("pos", F.lit(None).cast("int"))
        parts.append(unified(rows.join(chosen, "page_id"), *columns, "pos"))
    return merged(*parts) if apart else parts[0]


def empty_content(pages: DataFrame, products: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages judged to be content, fetched by a plain renderer, that gave no product.

    Expects verdict and render on pages.
    """
    plain = F.col("render").isin("none", "playwright", "cloudscraper")
    return (
        pages.filter((F.col("verdict") == "none") & plain)
        .join(products.select(key).distinct(), key, "left_anti")
        .withColumn("block_type", F.lit("empty_content"))
    )


class Extractors:
    """User extraction functions by (site, kind): pages in, product rows out.

    A frame function takes its site's pages as a DataFrame and returns product rows. A Python
    function takes (html, url) and returns product dicts; all of those run in one pass over the
    pages, in Arrow batches, or from SQL as a table function. A page on which a Python function raises, or
    gives what is no product, has no products; with `errors` one row says why. Sites without an entry go to the template step.
    """

    def __init__(self):
        self._frames: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {}
        self._functions: dict[tuple[str, str], Callable[[str, str], list[dict]]] = {}

    def register(self, site: str, kind: str, extract: Callable[[DataFrame], DataFrame]) -> None:
        self._frames[(site, kind)] = extract

    def register_python(self, site: str, kind: str, extract: Callable[[str, str], list[dict]]) -> None:
        self._functions[(site, kind)] = extract

    def _of_kind(self, kind: str) -> dict[str, Callable[[str, str], list[dict]]]:
        return {site: f for (site, k), f in self._functions.items() if k == kind}

    def run(self, pages: DataFrame, kind: str = "list", errors: bool = False) -> DataFrame:
        """Products of all registered sites' pages. pages has page_id, site, url and html.

        With errors the column error is NULL for products, and a page that failed has one row with its reason.
        """
        functions, extra = self._of_kind(kind), ["error"] if errors else []
        parts = []
        for (site, k), f in self._frames.items():
            if k == kind:
                found = f(pages.filter(F.col("site") == site))
                parts.append(unified(found.withColumn("error", F.lit(None).cast("string")) if errors else found, "page_id", *extra))
        if functions:
            found = _python_products(pages.filter(F.col("site").isin(list(functions))), functions)
            parts.append(found.select("page_id", "error", *PRODUCT_COLUMNS) if errors else found.filter("error IS NULL").drop("error"))
        if not parts:
            none = pages.limit(0).select("page_id", F.lit(None).cast("string").alias("error"))
            return unified(none, "page_id", *extra)
        return merged(*parts)

    def register_sql(self, spark: SparkSession, name: str, kind: str = "list") -> None:
        """Make the Python functions of a kind a table function `name`(site, url, html), for LATERAL over pages.

        It gives the product columns and error; a site without a function gives no row.
        """
        spark.udtf.register(name, _table_function(self._of_kind(kind)))


def _found(function: Callable[[str, str], list[dict]], html: str, url: str, arrow: pa.Schema) -> list[dict]:
    """The products a function finds on a page as rows of `arrow`, or one row with the error."""
    missing = {"rating": 0.0, "review_count": 0, "images": []}
    empty = {n: missing.get(n, "") for n in arrow.names}
    try:
        rows = [empty | found | {"error": None} for found in function(html, url)]
        return pa.RecordBatch.from_pylist(rows, schema=arrow).to_pylist()
    except Exception as e:  # noqa: BLE001  user code: one page must not end the job
        return [empty | {"error": f"{type(e).__name__}: {e}"}]


def _table_function(functions: dict[str, Callable[[str, str], list[dict]]]):
    schema = StructType.fromDDL(f"{PRODUCT_DDL}, error string")
    arrow = to_arrow_schema(schema)

    class Products:
        @staticmethod
        def analyze(site: AnalyzeArgument, url: AnalyzeArgument, html: AnalyzeArgument) -> AnalyzeResult:
            for name, given in (("site", site), ("url", url), ("html", html)):
                if not isinstance(given.dataType, StringType):
                    raise ValueError(f"{name} must be a string and is {given.dataType.simpleString()}")
            return AnalyzeResult(schema)

        def eval(self, site: str, url: str, html: str):
            if site in functions:
                for row in _found(functions[site], html, url, arrow):
                    yield tuple(row[n] for n in arrow.names)

    return udtf(Products, useArrow=True)


def _python_products(pages: DataFrame, functions: dict[str, Callable[[str, str], list[dict]]]) -> DataFrame:
    kind = pages.schema["page_id"].dataType.simpleString()
    own = to_arrow_schema(StructType.fromDDL(f"{PRODUCT_DDL}, error string"))
    whole = to_arrow_schema(StructType.fromDDL(f"page_id {kind}, {PRODUCT_DDL}, error string"))

    def batches(it):
        for batch in it:
            rows = [{"page_id": page["page_id"]} | row for page in batch.to_pylist()
                    for row in _found(functions[page["site"]], page["html"], page["url"], own)]
            yield pa.RecordBatch.from_pylist(rows, schema=whole)

    return pages.select("page_id", "site", "url", "html").mapInArrow(batches, f"page_id {kind}, {PRODUCT_DDL}, error string")
