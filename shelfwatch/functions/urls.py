"""URL labels, search-address building and link resolution."""

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shelfwatch.functions.text import alternation, any_of, first_case
from shelfwatch.rules import sites as R


def _no_string() -> Column:
    return F.lit(None).cast("string")


def site_by_domain(url: Column, domains: dict | None = None, host_only: bool = False) -> Column:
    """First site with a domain inside the lowercased URL, else NULL.

    host_only tests the host part alone, so a domain quoted in a query string does not count.
    """
    text = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")) if host_only else url)
    rules = domains or R.SITE_DOMAINS
    return first_case([(any_of(text, d), F.lit(s)) for s, d in rules.items()], _no_string())


def site_by_brand(url: Column, brands: list[str] | None = None, default: str = "unknown") -> Column:
    """First brand written as "<brand>." inside the URL, case-sensitive."""
    brands = brands or R.BRANDS_SHORT
    return first_case([(url.contains(b + "."), F.lit(b)) for b in brands], F.lit(default))


def site_by_name(url: Column, given: Column, override: bool = False) -> Column:
    """Site guessed from bare names. By default a given site wins; with override the guess wins."""
    guess = first_case([(url.contains(n), F.lit(n)) for n in R.BARE_NAMES], _no_string())
    given = F.nullif(given, F.lit(""))
    ordered = [guess, given] if override else [given, guess]
    return F.coalesce(*ordered, F.lit(""))


def site_from_host(url: Column) -> Column:
    """Last host label once ".com", ".co" and ".org" are removed."""
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    for suffix in (".com", ".co", ".org"):
        host = F.replace(host, F.lit(suffix), F.lit(""))
    return F.element_at(F.split(host, r"\."), -1)


def host_field(url: Column) -> Column:
    """Third slash-separated field of the URL."""
    return F.split_part(url, F.lit("/"), F.lit(3))


def page_pattern(site: Column, url: Column, rules: dict | None = None) -> Column:
    """Page pattern by the site's ordered regex groups; unknown for no hit or no rules.

    Regexes are constants, so each group compiles once per task. An outer CASE on the site keeps
    a row from trying other sites' groups.
    """
    unknown = F.lit("unknown")
    per_site = []
    for name, groups in (rules or R.URL_PATTERNS).items():
        hits = [(url.rlike(alternation(rx, ignore_case=True)), F.lit(p)) for p, rx in groups]
        per_site.append((site == name, first_case(hits, unknown)))
    return first_case(per_site, unknown)


def page_type(url: Column) -> Column:
    """detail or search, from the lowercased URL; search when nothing matches."""
    text = F.lower(url)
    return first_case(
        [
            (text.rlike(alternation(R.DETAIL_TYPE_REGEXES)), F.lit("detail")),
            (text.rlike(alternation(R.SEARCH_TYPE_REGEXES)), F.lit("search")),
        ],
        F.lit("search"),
    )


def page_suffix(url: Column, page: Column, param: Column | None = None) -> Column:
    """Append the page parameter from page 2 on, with & when the URL already has a query."""
    param = F.lit("page") if param is None else param
    sep = F.when(url.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    add = (page > 1) & (url != "") & (F.coalesce(param, F.lit("")) != "")
    return F.when(add, F.concat(url, sep, param, F.lit("="), page.cast("string"))).otherwise(url)


def fill_query(template: Column, query: Column) -> Column:
    """Put the query into a template, spaces as plus signs."""
    return F.replace(template, F.lit("{query}"), F.replace(query, F.lit(" "), F.lit("+")))


def search_from_format(pattern: Column, param: Column, page_param: Column, query: Column, page: Column) -> Column:
    """Search URL from a format row: fill the placeholder, or append the search parameter."""
    sep = F.when(pattern.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    appended = F.concat(pattern, sep, param, F.lit("="), query)
    filled = F.replace(pattern, F.lit("{query}"), query)
    only_query = ~F.replace(pattern, F.lit("{query}"), F.lit("")).rlike(r"[{}]")
    has_braces = pattern.contains("{") & pattern.contains("}")
    base = (
        F.when(has_braces & only_query, filled)
        .when(has_braces, F.concat(pattern, F.lit("?"), param, F.lit("="), query))
        .otherwise(appended)
    )
    return page_suffix(base, page, page_param)


def detail_url(asin: Column) -> Column:
    return F.concat(F.lit("https://www.amazon.com/dp/"), asin)


def trim_url(url: Column) -> Column:
    """Drop query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def on_host(prefix: Column, href: Column) -> Column:
    """Put a relative address on a site's host, without its query and fragment."""
    return F.concat(prefix, trim_url(href))


@F.pandas_udf(StringType())
def _join_links(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else urljoin(b, h) for b, h in zip(base, href)], dtype=object)


def resolve_link(base: Column, href: Column) -> Column:
    """Resolve a link against its page.

    Absolute addresses, "//host", "/path", "?query", "#fragment" and the empty link are resolved
    in Catalyst. Only dot segments and relative paths reach the Arrow function, which sees NULL
    for all other rows.
    """
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    plain_base = origin != ""
    dotted = href.rlike(r"(^|/)\.\.?(/|$|[?#])")
    absolute = href.rlike(r"^https?://[^/?#]+/") & ~dotted
    from_host = href.startswith("/") & ~href.startswith("//") & ~dotted
    no_fragment = F.regexp_replace(base, r"#.*$", "")
    no_query = F.regexp_replace(base, r"[?#].*$", "")
    other_scheme = href.rlike(r"^(mailto|javascript|tel|data):")
    known = (href == "") | (plain_base & (absolute | from_host | other_scheme
                                          | href.rlike(r"^//[^/?#]+/.*[^?#]$") & ~dotted
                                          | href.rlike(r"^#.") | href.rlike(r"^\?[^#]+$")))
    rest = _join_links(F.when(~known, base), F.when(~known, href))
    return (
        F.when(href == "", base)
        .when(~known, rest)
        .when(absolute | other_scheme, href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#"), F.concat(no_fragment, href))
        .otherwise(F.concat(no_query, href))
    )


def is_product_api(url: Column) -> Column:
    return any_of(F.lower(url), R.PRODUCT_API_WORDS)
