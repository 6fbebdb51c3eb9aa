"""URL labels, predicates and generation."""

from pyspark.sql import functions as F

from shelfwatch.functions import urls as fu
from shelfwatch.operators import lookups as ol
from shelfwatch.plans import jobs
from shelfwatch.queries.tables import SHOP_URLS, Tables, pick, quoted
from shelfwatch.rules import sites as R

BASE = f"WITH u AS ({SHOP_URLS})"


def _case(branches, default):
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {default} END"


def _contains(column, words):
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


DOMAIN_SQL = _case([(_contains("lower(shop_url)", d), quoted(s)) for s, d in R.SITE_DOMAINS.items()], "NULL")


def site_from_url(t: Tables):
    return t.shop_urls().select("page_id", "shop_url", fu.site_by_domain(F.col("shop_url")).alias("detected"))


def coarse_site(t: Tables):
    url = F.col("shop_url")
    return t.shop_urls().select(
        "page_id", fu.site_by_brand(url).alias("short_list"),
        fu.site_by_brand(url, default="").alias("short_empty"),
        fu.site_by_brand(url, R.BRANDS_LONG, "").alias("long_list"),
    )


def _brand_sql(brands, default):
    return _case([(f"contains(shop_url, '{b}.')", quoted(b)) for b in brands], quoted(default))


def guessed_site(t: Tables):
    given = F.when(F.col("page_id") % 3 == 0, F.lit("given")).otherwise(F.lit(""))
    return t.shop_urls().select(
        "page_id", fu.site_by_name(F.col("shop_url"), given).alias("given_wins"),
        fu.site_by_name(F.col("shop_url"), given, override=True).alias("guess_wins"),
    )


_GUESS = _case([(f"contains(shop_url, '{n}')", quoted(n)) for n in R.BARE_NAMES], "NULL")
_GIVEN = "CASE WHEN page_id % 3 = 0 THEN 'given' END"


def site_from_host(t: Tables):
    return t.shop_urls().select(
        "page_id", fu.site_from_host(F.col("shop_url")).alias("host_site"),
        fu.site_from_host(F.col("url")).alias("plain_host_site"),
    )


def _host_site_sql(column):
    host = f"split_part(split_part(split_part({column}, '/', 3), '?', 1), '#', 1)"
    cut = f"replace(replace(replace({host}, '.com', ''), '.co', ''), '.org', '')"
    return f"list_extract(string_split({cut}, '.'), -1)"


def host_field(t: Tables):
    return t.shop_urls().groupBy(fu.host_field(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


def page_pattern(t: Tables):
    return t.shop_urls().select(
        "page_id", "site", fu.page_pattern(F.col("site"), F.col("shop_url")).alias("page_pattern")
    )


def _group_sql(regexes):
    return "(" + " OR ".join(f"regexp_matches(shop_url, {quoted('(?i)' + r)})" for r in regexes) + ")"


PATTERN_SQL = _case(
    [(f"site = {quoted(s)} AND {_group_sql(rx)}", quoted(p))
     for s, groups in R.URL_PATTERNS.items() for p, rx in groups], "'unknown'")


def page_type(t: Tables):
    return t.shop_urls().select("page_id", fu.page_type(F.col("shop_url")).alias("page_type"))


def _any_regex(regexes):
    return "(" + " OR ".join(f"regexp_matches(lower(shop_url), {quoted(r)})" for r in regexes) + ")"


# Search requests: a query text per part, its site by key; two keys in 33 have no registered site.
REQUEST_SITE = pick(f"p_partkey % {len(R.REGISTERED_SITES) + 2}", [quoted(s) for s in R.REGISTERED_SITES], "'other'")
REQUESTS = f"SELECT p_partkey, p_name AS query, {REQUEST_SITE} AS site FROM part"


def _requests(t: Tables):
    return t.view(REQUESTS, "part")


def search_urls(t: Tables):
    return jobs.search_urls(_requests(t), 3).select("p_partkey", "site", "page", "url")


def spider_urls(t: Tables):
    multi = jobs.search_urls(_requests(t), 2, "multi").withColumn("variant", F.lit("multi"))
    single = jobs.search_urls(_requests(t), 2, "spider").withColumn("variant", F.lit("spider"))
    return multi.unionByName(single).select("variant", "p_partkey", "site", "page", "url")


def _values(rows):
    def lit(v):
        return "NULL" if v is None else quoted(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


BATCH_VALUES = _values(list(R.BATCH_SEARCH_TEMPLATES.items()))
SPIDER_VALUES = _values(
    [("multi", s, u, "&page=") for s, u in R.SPIDER_SEARCH_TEMPLATES.items()]
    + [("spider", s, u, R.SPIDER_PAGE_SUFFIXES.get(s, "&page=")) for s, u in R.SPIDER_SEARCH_TEMPLATES.items()])

SEARCH_SQL = f"""
WITH r AS ({REQUESTS}), tpl(site, template) AS ({BATCH_VALUES}),
b AS (SELECT p_partkey, r.site, replace(template, '{{query}}', replace(query, ' ', '+')) AS base
      FROM r JOIN tpl ON r.site = tpl.site)
SELECT p_partkey, site, page, CASE WHEN page = 1 THEN base
       WHEN position('?' IN base) > 0 THEN base || '&page=' || page ELSE base || '?page=' || page END AS url
FROM b, (SELECT unnest([1, 2, 3])::INT AS page) g
"""
SPIDER_SQL = f"""
WITH r AS ({REQUESTS}), tpl(variant, site, template, suffix) AS ({SPIDER_VALUES}),
b AS (SELECT variant, p_partkey, r.site, suffix, replace(template, '{{query}}', replace(query, ' ', '+')) AS base
      FROM r JOIN tpl ON r.site = tpl.site)
SELECT variant, p_partkey, site, page, CASE WHEN page = 1 THEN base ELSE base || suffix || page END AS url
FROM b, (SELECT unnest([1, 2])::INT AS page) g
"""


def url_formats(t: Tables):
    return ol.url_formats(_requests(t).select("p_partkey", "site"))


FORMATS_CTE = f"f(site, pattern, param, page_param, product_pattern, js) AS ({_values(R.URL_FORMATS)})"
FORMATS_SQL = f"""
WITH r AS ({REQUESTS}), {FORMATS_CTE}
SELECT r.p_partkey, r.site,
       coalesce(pattern, 'https://www.' || r.site || '.com/search?q={{query}}') AS search_url_pattern,
       coalesce(param, 'q') AS search_param, coalesce(page_param, 'page') AS page_param,
       coalesce(product_pattern, '') AS product_url_pattern, coalesce(js, true) AS uses_js_rendering
FROM r LEFT JOIN f ON r.site = f.site
"""


def format_urls(t: Tables):
    formats = ol.url_formats(_requests(t))
    # Some formats lose their placeholder so that the parameter has to be appended.
    pattern = F.when(F.col("p_partkey") % 4 == 1, F.replace("search_url_pattern", F.lit("{query}"), F.lit("x"))).when(
        F.col("p_partkey") % 4 == 2, F.lit("https://plain.example.com/find")
    ).otherwise(F.col("search_url_pattern"))
    page = (F.col("p_partkey") % 3 + 1).cast("int")
    return formats.select(
        "p_partkey", page.alias("page"),
        fu.search_from_format(pattern, F.col("search_param"), F.col("page_param"), F.col("query"), page).alias("url"),
    )


FORMAT_URL_SQL = f"""
WITH r AS ({REQUESTS}), {FORMATS_CTE},
a AS (SELECT r.p_partkey, query, coalesce(param, 'q') AS param, p_partkey % 3 + 1 AS page,
             coalesce(pattern, 'https://www.' || r.site || '.com/search?q={{query}}') AS pattern
      FROM r LEFT JOIN f ON r.site = f.site),
b AS (SELECT p_partkey, page, CASE p_partkey % 4
        WHEN 1 THEN replace(pattern, '{{query}}', 'x') || '&' || param || '=' || query
        WHEN 2 THEN 'https://plain.example.com/find?' || param || '=' || query
        ELSE replace(pattern, '{{query}}', query) END AS base FROM a)
SELECT p_partkey, page::INT AS page, CASE WHEN page > 1 THEN base || '&page=' || page ELSE base END AS url FROM b
"""


def detail_urls(t: Tables):
    return t("part").select("p_partkey", fu.detail_url(F.col("p_partkey").cast("string")).alias("url"))


def trimmed_urls(t: Tables):
    url = F.col("shop_url")
    return t.shop_urls().select(
        "page_id", fu.trim_url(url).alias("trimmed"),
        fu.on_host(F.lit("https://www.lowes.com"), F.col("path")).alias("hosted"),
    )


def _links(t: Tables):
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    return t("pages").select("page_id", "url", F.posexplode(hrefs).alias("pos", "href"))


def resolved_links(t: Tables):
    return _links(t).select(
        "page_id", "href", fu.resolve_link(F.col("url"), F.col("href")).alias("link"))


def resolved_relative_links(t: Tables):
    shapes = [F.col("href"), F.concat(F.lit("..") , "href"), F.concat(F.lit("?x="), "page_id"), F.lit("#top"),
              F.concat(F.lit("//cdn.example.com"), "href"), F.substr("href", F.lit(2)), F.lit("")]
    varied = F.element_at(F.array(*shapes), ((F.col("page_id") + F.col("pos")) % len(shapes) + 1).cast("int"))
    return _links(t).withColumn("href", varied).select(
        "page_id", "pos", "url", "href", fu.resolve_link(F.col("url"), F.col("href")).alias("link"))


# Every href of the pages is a path from the host, so each shape has a plain form.
RELATIVE_SQL = """WITH h AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages),
  l AS (SELECT page_id, url, unnest(hs) AS h, unnest(range(len(hs))) AS pos FROM h),
  p AS (SELECT *, (page_id + pos) % 7 AS shape, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin, split_part(url, '#', 1) AS whole,
        regexp_replace(url, '[?#].*$', '') AS path FROM l)
SELECT page_id, pos::INT AS pos, url,
  CASE shape WHEN 0 THEN h WHEN 1 THEN '..' || h WHEN 2 THEN '?x=' || page_id WHEN 3 THEN '#top' WHEN 4 THEN '//cdn.example.com' || h
    WHEN 5 THEN substr(h, 2) ELSE '' END AS href,
  CASE shape WHEN 0 THEN origin || h
    WHEN 1 THEN origin || regexp_replace(substr(regexp_extract(path, '^.*/'), length(origin) + 1), '[^/]+/$', '') || substr(h, 2) WHEN 2 THEN path || '?x=' || page_id WHEN 3 THEN whole || '#top'
    WHEN 4 THEN split_part(url, ':', 1) || '://cdn.example.com' || h WHEN 5 THEN regexp_extract(path, '^.*/') || substr(h, 2) ELSE url END AS link
FROM p"""


def product_api_urls(t: Tables):
    return t.shop_urls().filter(fu.is_product_api(F.col("shop_url"))).select("page_id", "shop_url")


def registered_sites(t: Tables):
    return ol.registered_only(_requests(t)).groupBy("site").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "u01_site_from_url": (site_from_url, f"{BASE} SELECT page_id, shop_url, {DOMAIN_SQL} AS detected FROM u"),
    "u02_coarse_site": (coarse_site, f"""{BASE} SELECT page_id, {_brand_sql(R.BRANDS_SHORT, 'unknown')} AS short_list,
        {_brand_sql(R.BRANDS_SHORT, '')} AS short_empty, {_brand_sql(R.BRANDS_LONG, '')} AS long_list FROM u"""),
    "u03_guessed_site": (guessed_site, f"""{BASE} SELECT page_id, coalesce({_GIVEN}, {_GUESS}, '') AS given_wins,
        coalesce({_GUESS}, {_GIVEN}, '') AS guess_wins FROM u"""),
    "u04_site_from_host": (site_from_host, f"""{BASE} SELECT page_id, {_host_site_sql('shop_url')} AS host_site,
        {_host_site_sql('url')} AS plain_host_site FROM u"""),
    "u05_host_field": (host_field, "SELECT split_part(url, '/', 3) AS host, count(*) AS n FROM pages GROUP BY 1"),
    "u06_page_pattern": (page_pattern, f"{BASE} SELECT page_id, site, {PATTERN_SQL} AS page_pattern FROM u"),
    "u07_page_type": (page_type, f"""{BASE} SELECT page_id, CASE WHEN {_any_regex(R.DETAIL_TYPE_REGEXES)} THEN 'detail'
        ELSE 'search' END AS page_type FROM u"""),
    "u08_search_urls": (search_urls, SEARCH_SQL),
    "u09_spider_urls": (spider_urls, SPIDER_SQL),
    "u10_url_formats": (url_formats, FORMATS_SQL),
    "u11_format_urls": (format_urls, FORMAT_URL_SQL),
    "u12_detail_urls": (detail_urls, "SELECT p_partkey, 'https://www.amazon.com/dp/' || p_partkey AS url FROM part"),
    "u13_trimmed_urls": (trimmed_urls, f"""{BASE} SELECT page_id, split_part(split_part(shop_url, '#', 1), '?', 1) AS trimmed,
        'https://www.lowes.com' || split_part(split_part(path, '#', 1), '?', 1) AS hosted FROM u"""),
    "u14_resolved_links": (resolved_links, """
        WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
        SELECT page_id, href, regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS link
        FROM l"""),
    "u14_resolved_relative_links": (resolved_relative_links, RELATIVE_SQL),
    "u15_product_api_urls": (product_api_urls, f"""{BASE} SELECT page_id, shop_url FROM u
        WHERE {_contains('lower(shop_url)', R.PRODUCT_API_WORDS)}"""),
    "u16_registered_sites": (registered_sites, f"""WITH r AS ({REQUESTS}) SELECT site, count(*) AS n FROM r
        WHERE site IN ({', '.join(quoted(s) for s in R.REGISTERED_SITES)}) GROUP BY site"""),
}
