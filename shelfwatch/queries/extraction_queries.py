"""Product extraction from JSON and HTML built out of the part table."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwatch.functions import products as fp
from shelfwatch.functions.responses import with_lowered
from shelfwatch.operators import chain, nodes, structured
from shelfwatch.operators.items import merged, unified
from shelfwatch.plans import jobs
from shelfwatch.queries.response_queries import verdict_sql
from shelfwatch.queries.tables import PAGE_SQL, PARTS_PER_PAGE, SHOP_URLS, Tables, joined_items, page_of, pick, quoted
from shelfwatch.queries.url_queries import REQUEST_SITE, _contains
from shelfwatch.rules import sites as R
from shelfwatch.rules import selectors as S
from shelfwatch.session import rule_table, work_folder


def _k() -> Column:
    return F.col("p_partkey")


def _key_text(before: str, after: str) -> Column:
    return F.concat(F.lit(before), _k().cast("string"), F.lit(after))


# ---- JSON ------------------------------------------------------------------------------------


def _json_entry() -> Column:
    """One JSON product per part; kind, name, offer, brand and image forms vary by key."""
    price = F.when(_k() % 2 == 0, _key_text('"price":"', '.5"')).otherwise(_key_text('"price":', ""))
    currency = F.when(_k() % 7 == 0, F.lit("")).when(_k() % 2 == 0, F.lit(',"priceCurrency":"USD"')).otherwise(
        F.lit(',"priceCurrency":"EUR"'))
    offer = F.concat(F.lit("{"), price, currency, F.lit("}"))
    offers = F.when(_k() % 2 == 0, offer).otherwise(F.concat(F.lit("["), offer, F.lit(',{"price":1}]')))
    brand = F.when(_k() % 3 == 0, F.concat(F.lit(',"brand":"'), "p_brand", F.lit('"'))).when(
        _k() % 3 == 1, F.concat(F.lit(',"brand":{"name":"'), "p_brand", F.lit('"}'))).otherwise(F.lit(""))
    image = F.when(_k() % 5 == 0, _key_text(',"image":["a', '.png","b.png"]')).when(
        _k() % 5 == 1, _key_text(',"image":"c', '.png"')).otherwise(F.lit(""))
    kind = F.when(_k() % 11 == 0, F.lit("Thing")).otherwise(F.lit("Product"))
    name = F.when(_k() % 13 == 0, F.lit("")).otherwise(F.col("p_name"))
    return F.concat(
        F.lit('{"@type":"'), kind, F.lit('","name":"'), name, F.lit('","offers":'), offers, brand, image,
        _key_text(',"url":"https://shop.example.com/', '"}'))


def _ld_pages(t: Tables):
    body = joined_items(t("part"), _json_entry(), ",", "ld")
    html = F.concat(
        F.lit('<html><head><script type="application/ld+json">[5,'), "ld",
        F.lit("]</script><SCRIPT type='application/ld+json'>{broken</script></head></html>"))
    url = F.when(F.col("page_id") % 2 == 0, F.lit("https://www.ebay.com/sch/i.html")).otherwise(
        F.lit("https://www.shop.example.com/s"))
    return body.select("page_id", url.alias("url"), html.alias("html"))


def json_ld(t: Tables):
    return structured.json_ld_products(_ld_pages(t)).select(
        "page_id", "pos", "source", "title", "price", "brand", F.array_join("images", ",").alias("image"))


_PRICE_ONLY = "CASE WHEN p_partkey % 2 = 0 THEN p_partkey || '.5' ELSE p_partkey::VARCHAR END"
LD_CTE = f"""named AS (SELECT *, {PAGE_SQL} AS page_id, row_number() OVER (PARTITION BY {PAGE_SQL}, p_name ORDER BY p_partkey) AS r
      FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0),
  ld AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) - 1 AS pos, p_name AS title, p_partkey,
         CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN 'USD ' ELSE 'EUR ' END || {_PRICE_ONLY} AS price,
         CASE WHEN p_partkey % 3 < 2 THEN p_brand ELSE '' END AS brand,
         CASE p_partkey % 5 WHEN 0 THEN 'a' || p_partkey || '.png' WHEN 1 THEN 'c' || p_partkey || '.png' ELSE '' END AS image
         FROM named WHERE r = 1)"""


def _payloads(t: Tables):
    """One payload per page; the products lie below different wrappers, some very deep."""
    body = joined_items(t("part"), _json_entry(), ",", "items")
    wrapped = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('{"total":1,"products":['), "items", F.lit("]}")))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit('{"@type":"Product","items":{"results":[['), "items", F.lit("],3]}}")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.repeat(F.lit('{"items":['), F.lit(20)), "items", F.repeat(F.lit("]}"), F.lit(20))))
        .otherwise(F.concat(F.lit('{"data":{"products":['), "items", F.lit("]}}")))
    )
    return body.select("page_id", wrapped.alias("body"))


def payload_products(t: Tables):
    return structured.payload_products(_payloads(t)).select(
        "page_id", "pos", "source", "url", "title", "price", F.array_join("images", ",").alias("image"))


PAYLOAD_CTE = f"""pay AS (SELECT {PAGE_SQL} AS page_id, p_partkey, 'https://shop.example.com/' || p_partkey AS url,
      row_number() OVER (PARTITION BY {PAGE_SQL} ORDER BY p_partkey) - 1 AS pos,
      CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS title, {_PRICE_ONLY} AS price,
      CASE WHEN p_partkey % 5 = 1 THEN 'c' || p_partkey || '.png' ELSE '' END AS image
      FROM part WHERE p_partkey % 11 <> 0 AND {PAGE_SQL} % 4 <> 3)"""


def api_products(t: Tables):
    """Item-to-product mapping on unwrapped payload rows: one product object per row."""
    rows = t("part").select(_k().alias("page_id"), _json_entry().alias("body"))
    return structured.payload_products(rows).select("page_id", "title", "price", "url")


def payload_filter(t: Tables):
    responses = t.shop_urls().select(
        "page_id", F.col("shop_url").alias("url"),
        F.when(F.col("page_id") % 3 == 0, F.lit("text/html")).otherwise(F.lit("application/json; charset=utf-8")).alias("content_type"),
        F.when(F.col("page_id") % 4 == 0, F.lit("[]")).when(F.col("page_id") % 4 == 1, F.lit("")).otherwise(F.lit('{"items":[]}')).alias("body"))
    return structured.product_payloads(responses).select("page_id", "url")


# ---- HTML ------------------------------------------------------------------------------------


def _gap() -> Column:
    """Parts that lack the field their site's row rule asks for."""
    return _k() % 17 == 0



def _amazon_item() -> Column:
    return F.when(_gap(), _key_text('<li data-asin="', '"><h2></h2></li>')).otherwise(F.concat(
        _key_text('<li data-asin="', '">'), _key_text('<h2><a href="/dp/', '?x=1"><span> '), F.col("p_name"),
        _key_text(' </span></a></h2><span class="a-price-whole">', '</span><span class="a-price-fraction">50</span>'),
        F.lit('<i class="a-icon-star-small"><span class="a-icon-alt">4.5 out of 5</span></i>'),
        _key_text('<span class="a-size-small a-link-normal">1,234</span><img class="s-image" src="', '.png"></li>')))


def _walmart_item() -> Column:
    return F.when(_gap(), F.lit('<div class="search-result-gridview-item"></div>')).otherwise(F.concat(
        _key_text('<div class="search-result-gridview-item"><div class="search-result-product-title"><a href="ip/', '"><span>'),
        F.col("p_name"), _key_text('</span></a></div><span class="price-main-block"><span>$', '</span></span>'),
        _key_text('<img class="search-result-image" data-src="', '.jpg"><span class="search-result-star-rating">3</span>'),
        _key_text('<span class="search-result-review-count">(', ')</span></div>')))


def _plain_item() -> Column:
    return F.when(_gap(), F.lit('<li class="product"></li>')).otherwise(F.concat(
        F.lit('<li class="product new"><h2>'), F.col("p_name"),
        _key_text('</h2><b class="price">$', '</b>'),
        _key_text('<a href="https://shop.example.com/product/', '">see</a></li>')))


def _site_of(kinds: list[str]) -> Column:
    index = (F.floor(_k() / 24) % len(kinds)).cast("int")
    return F.element_at(F.array(*[F.lit(k) for k in kinds]), index + 1)


def _html_pages(t: Tables, kinds: dict[str, Column]):
    """Pages whose site cycles over the kinds; all parts of a page share its site."""
    site = _site_of(list(kinds))
    item = None
    for name, markup in kinds.items():
        item = F.when(site == name, markup) if item is None else item.when(site == name, markup)
    body = joined_items(t("part"), item, "", "items")
    names = F.array(*[F.lit(k) for k in kinds])
    named = F.element_at(names, (F.col("page_id") % len(kinds)).cast("int") + 1)
    return body.select(
        "page_id", named.alias("site"), F.concat(F.lit("https://www."), named, F.lit(".com/search?q=x")).alias("url"),
        F.concat(F.lit('<html><body><ul class="s-result-list">'), "items", F.lit("</ul></body></html>")).alias("html"))


def _template_pages(t: Tables):
    pages = _html_pages(t, {"amazon": _amazon_item(), "walmart": _walmart_item(), "shop": _plain_item()})
    return pages.withColumn("template", nodes.default_template(F.col("site")))


def template_products(t: Tables):
    return nodes.template_products(_template_pages(t), limit=S.ITEMS_PER_PAGE).select(
        "page_id", "pos", "source", "url", "title", "price", "rating", "review_count", "asin",
        F.array_join("images", ",").alias("image"))


TEMPLATE_SQL = f"""
WITH n AS (SELECT *, {PAGE_SQL} AS page_id, row_number() OVER (PARTITION BY {PAGE_SQL} ORDER BY p_partkey) AS r,
           {PAGE_SQL} % 3 AS s FROM part)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY p_partkey) - 1)::INT AS pos,
  CASE s WHEN 0 THEN 'amazon' WHEN 1 THEN 'walmart' ELSE 'shop' END AS source,
  CASE s WHEN 0 THEN 'https://www.amazon.com/dp/' || p_partkey || '?x=1' WHEN 1 THEN 'https://www.walmart.com/ip/' || p_partkey
         ELSE 'https://shop.example.com/product/' || p_partkey END AS url, p_name AS title,
  CASE s WHEN 0 THEN p_partkey || '.50' ELSE '$' || p_partkey END AS price,
  CASE s WHEN 0 THEN 4.5 WHEN 1 THEN 3.0 ELSE 0.0 END::DOUBLE AS rating,
  CASE s WHEN 0 THEN 1234 WHEN 1 THEN p_partkey ELSE 0 END::INT AS review_count,
  CASE s WHEN 0 THEN p_partkey::VARCHAR ELSE '' END AS asin,
  CASE s WHEN 0 THEN p_partkey || '.png' WHEN 1 THEN p_partkey || '.jpg' ELSE '' END AS image
FROM n WHERE r <= 20 AND p_partkey % 17 <> 0"""


def capped_counts(t: Tables):
    """Items per page under the cap, counted before any row rule."""
    raw = nodes.with_nodes(_template_pages(t), profile=False)
    return raw.select("page_id", F.size(F.slice("nodes.css", 1, S.ITEMS_PER_PAGE)).alias("items"))


def all_counts(t: Tables):
    """All template items of each page; a tenth of the pages is followed by markup no parser accepts."""
    broken = _template_pages(t).withColumn("html", F.when(F.col("page_id") % 10 == 3, F.lit("<p><![foo[bar]]>")).otherwise(F.col("html")))
    return nodes.with_nodes(broken, profile=False).select(
        "page_id", F.size("nodes.css").alias("items"), F.col("nodes.error").isNotNull().alias("failed"))


def _profile_pages(t: Tables):
    def listing(before, link, title, price, image='<img src="k.png">'):
        return F.concat(before, link, title, price, F.lit(image), F.lit("</div>"))

    name = F.col("p_name")
    kinds = {
        "ebay": listing(_key_text('<div data-listingid="', '">'),
                        F.when(_gap(), F.lit("")).otherwise(_key_text('<a href="/itm/', '?h=1">x</a>')),
                        F.concat(F.lit("<h3> "), name, F.lit(" </h3>")), _key_text('<b class="s-price">US $', '.50</b>')),
        "target": listing(
            F.lit('<div class="card">'),
            F.when(_k() % 2 == 0, F.concat(_key_text('<a href="/p/item-', '?x=1#f" aria-label="'), name, F.lit(' deluxe edition"></a>')))
            .otherwise(F.concat(_key_text('<a href="/p/item-', '#f"><i>new</i><span>'), name, F.lit(" deluxe edition</span></a>"))),
            F.when(_gap(), _key_text('<a href="/p/item-', '">again</a>')).otherwise(F.lit("")),
            _key_text("<b>now $1,", ".99 was $5</b>")),
        "amazon": listing(F.when(_gap(), F.lit('<div data-asin="">')).otherwise(_key_text('<div data-asin="', '">')),
                          F.concat(F.lit('<span class="a-text-normal">'), name, F.lit("</span>")), F.lit(""),
                          _key_text('<span class="a-price"><span class="a-offscreen">$', '.50</span></span>'),
                          '<img class="s-image" src="k.png">'),
        "walmart": listing(_key_text('<div data-item-id="', '">'), _key_text('<a href="/ip/', '?x">'),
                           F.concat(F.lit("<span>"), name, F.lit("</span></a>")),
                           _key_text('<b itemprop="price">$', '.50</b>'), '<img data-src="k.png">'),
        "kohls": listing(_key_text('<div data-product-id="', '">'), _key_text('<a href="/p/', '?x=2">y</a>'),
                         F.when(_gap(), F.lit("")).otherwise(F.concat(F.lit('<b class="product-title">'), name, F.lit("</b>"))),
                         _key_text('<b class="price">$', '.50</b>'), '<img data-src="k.png">'),
        "homedepot": listing(_key_text('<div data-item-id="', '">'), _key_text('<a href="/p/', '?x=2">y</a>'),
                             F.concat(F.lit('<b data-testid="product-title">'), name, F.lit("</b>")),
                             _key_text('<b data-testid="product-price">$', '.50</b>'), "<img>"),
    }
    return _html_pages(t, kinds)


def profile_products(t: Tables):
    return nodes.profile_products(_profile_pages(t)).select(
        "page_id", "source", "url", "title", "price", "asin", F.array_join("images", ",").alias("image"))


PROFILE_SQL = f"""
WITH n AS (SELECT *, {PAGE_SQL} AS page_id, {PAGE_SQL} % 6 AS s FROM part)
SELECT page_id, CASE s WHEN 0 THEN 'ebay' WHEN 1 THEN 'target' WHEN 2 THEN 'amazon' WHEN 3 THEN 'walmart' WHEN 4 THEN 'kohls' ELSE 'homedepot' END AS source,
  CASE s WHEN 0 THEN 'https://www.ebay.com/itm/' WHEN 1 THEN 'https://www.target.com/p/item-' WHEN 2 THEN 'https://www.amazon.com/dp/'
         WHEN 3 THEN 'https://www.walmart.com/ip/' WHEN 4 THEN 'https://www.kohls.com/p/' ELSE 'https://www.homedepot.com/p/' END || p_partkey AS url,
  CASE WHEN s = 1 THEN p_name || ' deluxe edition' ELSE p_name END AS title,
  CASE WHEN s = 1 THEN '1' || p_partkey || '.99' ELSE p_partkey || '.50' END AS price,
  CASE WHEN s = 2 THEN p_partkey::VARCHAR ELSE '' END AS asin,
  CASE WHEN s = 0 THEN 'k.png' WHEN s = 2 THEN 'k.png' WHEN s = 4 THEN 'k.png' ELSE '' END AS image
FROM n WHERE NOT (p_partkey % 17 = 0 AND s IN (0, 2, 4))"""


# ---- Chain -----------------------------------------------------------------------------------


def _chain_inputs(t: Tables):
    """Pages of one shop in five kinds: ld+json, profile, payload, template, and empty."""
    kind = F.floor(_k() / 24) % 5
    first = _k() % 24 == 0
    ld = joined_items(t("part").filter((kind == 0) | ((kind == 1) & first)), _json_entry(), ",", "ld")
    profile = F.concat(
        _key_text('<div data-product-id="', '">'), _key_text('<a href="/p/', '">y</a><b class="product-title">'),
        F.col("p_name"), _key_text('</b><b class="price">$', '</b></div>'))
    markup = F.when(kind == 1, profile).when(kind == 3, _plain_item()).otherwise(F.lit(""))
    body = joined_items(t("part"), markup, "", "items")
    pages = body.join(ld, "page_id", "left").select(
        "page_id", F.lit("https://www.kohls.com/search.jsp").alias("url"),
        F.concat(F.lit('<html><script type="application/ld+json">['), F.coalesce("ld", F.lit("")), F.lit("]</script><ul>"),
                 "items", F.lit("</ul></html>")).alias("html"))
    in_payload = t("part").filter(kind == 2)
    body = joined_items(in_payload, _json_entry(), ",", "items")
    payloads = structured.payload_products(
        body.select("page_id", F.concat(F.lit('{"products":['), "items", F.lit("]}")).alias("body")))
    return pages, payloads


def chain_steps(t: Tables):
    pages, payloads = _chain_inputs(t)
    return chain.winning_steps(pages, payloads, limit=S.ITEMS_PER_PAGE).select("page_id", "strategy", "method", "product_count")


def chain_products(t: Tables):
    pages, payloads = _chain_inputs(t)
    return chain.chain_products(pages, payloads, limit=S.ITEMS_PER_PAGE).select("page_id", "strategy", "title", "price")


CHAIN_CTE = f"""{LD_CTE}, x AS (SELECT *, {PAGE_SQL} AS page_id, {PAGE_SQL} % 5 AS kind,
      row_number() OVER (PARTITION BY {PAGE_SQL} ORDER BY p_partkey) AS r FROM part),
  cand AS (
    SELECT page_id, 'json_ld' AS strategy, title, price, 3 AS least, 1 AS rank FROM ld WHERE page_id % 5 = 0
    UNION ALL SELECT page_id, 'profile', p_name, p_partkey::VARCHAR, 5, 2 FROM x WHERE kind = 1
    UNION ALL SELECT page_id, 'payload', CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END, {_PRICE_ONLY}, 10, 3 FROM x
              WHERE kind = 2 AND p_partkey % 11 <> 0
    UNION ALL SELECT page_id, 'css', p_name, '$' || p_partkey, 3, 4 FROM x WHERE kind = 3 AND r <= 20 AND p_partkey % 17 <> 0),
  won AS (SELECT page_id, strategy, count(*) AS n FROM cand GROUP BY page_id, strategy, least HAVING count(*) >= least)"""
CHAIN_STEPS_SQL = f"""WITH {CHAIN_CTE}, p AS (SELECT DISTINCT page_id FROM x)
SELECT p.page_id, coalesce(strategy, 'none') AS strategy,
  CASE strategy WHEN 'json_ld' THEN 'html_json' WHEN 'profile' THEN 'html_nodes' WHEN 'css' THEN 'html_nodes'
                WHEN 'payload' THEN 'api_json' ELSE 'none' END AS method, coalesce(n, 0) AS product_count
FROM p LEFT JOIN won ON won.page_id = p.page_id"""


# A caller's own chains: another order and other minimums, a step of its own, and a chain for all other sites.
OWN_CHAINS = [("kohls", 1, "profile", 5), ("kohls", 2, "css", 5), ("kohls", 3, "payload", 1), ("kohls", 4, "json_ld", 20),
              ("shop1", 1, "json_ld", 23), ("shop1", 2, "feed", 4), ("shop1", 3, "unheard", 0), ("shop1", 4, "json_ld", 1),
              (None, 1, "payload", 10), (None, 2, "feed", 3), (None, 9, "json_ld", 1)]


def _own_chain_inputs(t: Tables):
    pages, payloads = _chain_inputs(t)
    site = F.when(F.col("page_id") % 3 == 0, F.lit("kohls")).when(F.col("page_id") % 3 == 1, F.lit("shop1")).otherwise(F.lit("shop2"))
    chains = rule_table(t.spark, OWN_CHAINS, "site string, place int, step string, least int")
    feed = unified(t("part").filter("p_size > 40").select(
        page_of(), F.col("p_name").alias("title"), F.lit("").alias("price"), F.lit("feed").alias("source")), "page_id")
    return pages.withColumn("site", site), payloads, chains, {"feed": feed}


def own_chain_steps(t: Tables):
    pages, payloads, chains, feeds = _own_chain_inputs(t)
    return chain.winning_steps(pages, payloads, limit=S.ITEMS_PER_PAGE, chains=chains, feeds=feeds).select("page_id", "strategy", "method", "product_count")


def own_chain_products(t: Tables):
    pages, payloads, chains, feeds = _own_chain_inputs(t)
    found = chain.chain_products(pages, payloads, limit=S.ITEMS_PER_PAGE, chains=chains, feeds=feeds)
    return found.select("page_id", "strategy", "method", "title")


OWN_CHAIN_CTE = f"""{LD_CTE}, x AS (SELECT *, {PAGE_SQL} AS page_id, {PAGE_SQL} % 5 AS kind,
      row_number() OVER (PARTITION BY {PAGE_SQL} ORDER BY p_partkey) AS r FROM part),
  cand AS (SELECT page_id, 'json_ld' AS step, 'html_json' AS method, title FROM ld WHERE page_id % 5 = 0 OR (page_id % 5 = 1 AND p_partkey % {PARTS_PER_PAGE} = 0)
    UNION ALL SELECT page_id, 'profile', 'html_nodes', p_name FROM x WHERE kind = 1 AND page_id % 3 = 0
    UNION ALL SELECT page_id, 'payload', 'api_json', CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END FROM x WHERE kind = 2 AND p_partkey % 11 <> 0
    UNION ALL SELECT page_id, 'css', 'html_nodes', p_name FROM x WHERE kind = 3 AND r <= 20 AND p_partkey % 17 <> 0
    UNION ALL SELECT page_id, 'feed', 'feed', p_name FROM x WHERE p_size > 40),
  chains(site, place, step, least) AS (VALUES {', '.join(f"({quoted(s) if s else 'NULL'}, {p}, {quoted(n)}, {c})" for s, p, n, c in OWN_CHAINS)}),
  pg AS (SELECT DISTINCT page_id, CASE page_id % 3 WHEN 0 THEN 'kohls' WHEN 1 THEN 'shop1' END AS site FROM x),
  n AS (SELECT page_id, step, count(*) AS n FROM cand GROUP BY 1, 2),
  won AS (SELECT pg.page_id, c.step, n.n FROM pg JOIN chains c ON c.site IS NOT DISTINCT FROM pg.site JOIN n ON n.page_id = pg.page_id AND n.step = c.step
          WHERE n.n >= c.least QUALIFY row_number() OVER (PARTITION BY pg.page_id ORDER BY c.place) = 1)"""
OWN_CHAIN_STEPS_SQL = f"""WITH {OWN_CHAIN_CTE} SELECT pg.page_id, coalesce(won.step, 'none') AS strategy,
    CASE won.step WHEN 'json_ld' THEN 'html_json' WHEN 'payload' THEN 'api_json' WHEN 'feed' THEN 'feed' WHEN 'css' THEN 'html_nodes'
                  WHEN 'profile' THEN 'html_nodes' ELSE 'none' END AS method, coalesce(won.n, 0)::INT AS product_count
    FROM pg LEFT JOIN won USING (page_id)"""


def chain_rules(t: Tables):
    """Minimum counts of each request's site."""
    sites = t.view(f"SELECT p_partkey, {REQUEST_SITE} AS site FROM part", "part")
    least = chain.minimums(F.col("site"))
    return sites.select("p_partkey", *[F.coalesce(c, F.lit(-1)).alias(s) for s, c in least.items()])


def empty_content(t: Tables):
    pages = jobs.classified(t("pages")).withColumn(
        "render", F.when(F.col("page_id") % 4 == 0, F.lit("other")).otherwise(F.lit("none")))
    products = t("part").select(F.when(F.col("p_size") > 30, _k()).otherwise(-1).alias("page_id"))
    return chain.empty_content(pages, products).select("page_id", "block_type")


# ---- Fields ----------------------------------------------------------------------------------


def price_digits(t: Tables):
    text = F.concat(F.lit("US $"), F.col("p_retailprice").cast("string"), F.when(_k() % 5 == 0, F.lit(" 1.2")).otherwise(F.lit(" each")))
    number = fp.price_number(text)
    return t("part").select("p_partkey", fp.price_digits(text).alias("price"), number.cast("double").alias("price_num"))


def dollar_amounts(t: Tables):
    text = F.concat("text", F.lit(" only $1,"), F.col("doc_id").cast("string"), F.lit(".50 or $3"))
    return t("documents").select("doc_id", fp.dollar_amount(text).alias("amount"))


def cleaned_fields(t: Tables):
    size = F.col("p_size").cast("string")
    fraction = F.when(_k() % 3 > 0, F.lpad(size, 2, "0"))
    rating = F.when(_k() % 4 == 0, F.lit("no rating")).otherwise(F.concat(F.lit("rated "), size, F.lit(".5 of 5.0")))
    reviews = F.when(_k() % 5 == 0, F.lit("none yet")).otherwise(F.concat(F.lit("(1,"), F.lpad(size, 3, "0"), F.lit(" reviews)")))
    src = F.when(_k() % 4 == 0, F.lit("")).when(_k() % 4 == 1, F.lit(None).cast("string")).otherwise(F.lit("s.png"))
    lazy = F.when(_k() % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("lazy.png"))
    return t("part").select(
        "p_partkey", fp.whole_and_fraction(_k().cast("string"), fraction).alias("price"),
        fp.rating_number(rating).alias("rating"), fp.review_number(reviews).alias("review_count"),
        fp.tidy_title(F.concat(F.lit("  "), F.repeat("p_name", _k().cast("int") % 30), F.lit(" "))).alias("title"),
        F.array_join(fp.image_list(src, lazy), ",").alias("image"))


CLEANED_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_partkey || '.' || lpad(p_size::VARCHAR, 2, '0') ELSE p_partkey::VARCHAR END AS price,
  CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE p_size + 0.5 END::DOUBLE AS rating,
  CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1000 + p_size END::INT AS review_count,
  left(trim('  ' || repeat(p_name, (p_partkey % 30)::INT) || ' '), 200) AS title,
  CASE WHEN p_partkey % 4 > 1 THEN 's.png' WHEN p_partkey % 3 = 0 THEN '' ELSE 'lazy.png' END AS image FROM part"""


# ---- Templates -------------------------------------------------------------------------------

KEYS_SQL = f"SELECT site, p_type AS page_type, max(p_partkey) AS hi FROM (SELECT *, {REQUEST_SITE} AS site FROM part) x GROUP BY 1, 2"


def resolved_templates(t: Tables):
    keys = t.view(KEYS_SQL, "part")

    def rows(condition, prefix):
        named = nodes.template_struct({}).withField("title_selector", F.concat(F.lit(prefix), F.col("hi").cast("string")))
        return keys.filter(condition).select("site", "page_type", named.alias("template"))

    resolved = nodes.resolved_templates(
        keys.withColumn("has_sample", F.col("page_type") != "MEDIUM"), rows("page_type = 'SMALL'", "cached "),
        rows("page_type IN ('SMALL', 'MEDIUM', 'LARGE')", "stored "))
    return resolved.select("site", "page_type", "origin", F.col("template.title_selector").alias("title_selector"),
                           F.col("template.price_selector").alias("price_selector"))


def _default_sql(field, site="site"):
    branches = " ".join(
        f"WHEN {quoted(s)} THEN {quoted(v[field]) if field in v else 'NULL'}" for s, v in S.DEFAULT_TEMPLATES.items() if s)
    rest = S.DEFAULT_TEMPLATES[""]
    return f"CASE {site} {branches} ELSE {quoted(rest[field]) if field in rest else 'NULL'} END"


RESOLVED_SQL = f"""WITH k AS ({KEYS_SQL}), o AS (SELECT *, CASE page_type WHEN 'SMALL' THEN 'cached' WHEN 'LARGE' THEN 'stored' ELSE 'default' END AS origin FROM k)
SELECT site, page_type, origin, CASE WHEN origin = 'default' THEN {_default_sql('title_selector')} ELSE origin || ' ' || hi END AS title_selector,
  CASE WHEN origin = 'default' THEN {_default_sql('price_selector')} END AS price_selector FROM o"""


def default_templates(t: Tables):
    sites = t.view(f"SELECT site, count(*) AS n FROM (SELECT {REQUEST_SITE} AS site FROM part) x GROUP BY 1", "part")
    return sites.select("site", "n", nodes.default_template(F.col("site")).alias("t")).select("site", "n", "t.*")


# ---- Shapes ----------------------------------------------------------------------------------


def unified_items(t: Tables):
    some = t("part").select(F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), "p_partkey",
                            F.col("p_retailprice").cast("string").alias("price"))
    return unified(some, "p_partkey").withColumn("images", F.size("images"))


def strategy_union(t: Tables):
    ld = structured.json_ld_products(_ld_pages(t)).withColumn("strategy", F.lit("json_ld"))
    api = structured.payload_products(_payloads(t)).withColumn("strategy", F.lit("payload"))
    return merged(ld, api).groupBy("page_id", "strategy").agg(F.count(F.lit(1)).alias("products"))


def first_links(t: Tables):
    """First occurrence of every link of a page, with its place among the first ones."""
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    pages = t("pages").select("page_id", F.transform(hrefs, lambda h: F.struct(h.alias("href"))).alias("links"))
    first = structured.with_first(pages, "links", "href")
    return first.select("page_id", F.posexplode_outer("links").alias("pos", "l")).filter("l IS NOT NULL").select(
        "page_id", "pos", "l.href")


FIRST_LINKS_SQL = """WITH h AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages),
  l AS (SELECT page_id, unnest(hs) AS href, unnest(range(len(hs))) AS i FROM h),
  f AS (SELECT page_id, href, min(i) AS i FROM l GROUP BY 1, 2)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS pos, href FROM f"""


def python_rules(t: Tables):
    """User code as an extractor: page headings become products."""
    extractors = chain.Extractors()

    def headings(html: str, url: str) -> list[dict]:
        start = html.find("<h1>")
        end = html.find("</h1>", start)
        return [{"source": "shop", "url": url, "title": html[start + 4:end]}] if start >= 0 else []

    extractors.register_python("shop", "list", headings)
    pages = t("pages").withColumn("site", F.when(F.col("page_id") % 2 == 0, F.lit("shop")).otherwise(F.lit("other")))
    return extractors.run(pages).select("page_id", "source", "url", "title", "price")


def sql_rules(t: Tables):
    """The same kind of code called from SQL, where pages without a heading are errors."""

    def headings(html: str, url: str) -> list[dict]:
        start, end = html.index("<h1>"), html.index("</h1>")
        return [{"source": "shop", "url": url, "title": html[start + 4:end]}]

    extractors = chain.Extractors()
    extractors.register_python("shop", "list", headings)
    extractors.register_sql(t.spark, "shop_products")
    # The site comes from a name without an h1 for a fifth of the pages.
    return t.view("""SELECT p.page_id, x.source, x.url, x.title, x.rating, x.error FROM (
        SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'shop' ELSE 'other' END AS site, url,
               CASE WHEN page_id % 5 = 0 THEN replace(html, '<h1>', '<h2>') ELSE html END AS html FROM pages) p,
        LATERAL shop_products(p.site, p.url, p.html) x""", "pages")


def item_flow(t: Tables):
    pages = _html_pages(t, {"amazon": _amazon_item(), "walmart": _walmart_item()})
    return jobs.item_flow(pages.drop("site"), S.ITEMS_PER_PAGE).select("page_id", "source", "title", "price", "url", "is_valid")


def batch_products(t: Tables):
    """Products of a whole batch run over the chain pages; a marker makes every page real content."""
    pages, payloads = _chain_inputs(t)
    pages = pages.select("page_id", "url", F.concat("html", F.lit("product-title")).alias("html"), F.lit("none").alias("render"))
    out = jobs.batch_run(t.spark, pages, t.attempts(), work_folder(t.spark, "batch"), payloads)
    return out["products"].select("page_id", "title", "price", "is_valid")


QUERIES = {
    "batch_products": (batch_products, f"""WITH {CHAIN_CTE.replace("r <= 20 AND ", "")} SELECT cand.page_id, title,
        CASE WHEN length(title) >= 5 AND NOT regexp_matches(price, '[0-9]') THEN '' ELSE price END AS price, length(title) >= 5 AS is_valid
        FROM cand JOIN won ON won.page_id = cand.page_id AND won.strategy = cand.strategy"""),
    "e01_json_ld": (json_ld, f"""WITH {LD_CTE} SELECT page_id, pos::INT AS pos, CASE WHEN page_id % 2 = 0 THEN 'ebay' ELSE 'unknown' END AS source,
        title, price, brand, image FROM ld"""),
    "e02_template_products": (template_products, TEMPLATE_SQL),
    "e03_profile_products": (profile_products, PROFILE_SQL),
    "e04_payload_products": (payload_products, f"""WITH {PAYLOAD_CTE} SELECT page_id, pos::INT AS pos, 'unknown' AS source, url, title, price, image FROM pay"""),
    "e05_payload_filter": (payload_filter, f"""WITH u AS ({SHOP_URLS}) SELECT page_id, shop_url AS url FROM u
        WHERE page_id % 3 <> 0 AND page_id % 4 > 1 AND {_contains('lower(shop_url)', R.PRODUCT_API_WORDS)}"""),
    "e06_chain_steps": (chain_steps, CHAIN_STEPS_SQL),
    "e06_chain_products": (chain_products, f"""WITH {CHAIN_CTE} SELECT cand.page_id, cand.strategy, title, price FROM cand
        JOIN won ON won.page_id = cand.page_id AND won.strategy = cand.strategy"""),
    "f04_own_chain_steps": (own_chain_steps, OWN_CHAIN_STEPS_SQL),
    "f04_own_chain_products": (own_chain_products, f"""WITH {OWN_CHAIN_CTE} SELECT cand.page_id, cand.step AS strategy, method, title FROM cand
        JOIN won ON won.page_id = cand.page_id AND won.step = cand.step"""),
    "e06_chain_rules": (chain_rules, f"""SELECT p_partkey, CASE site WHEN 'ebay' THEN 5 WHEN 'amazon' THEN -1 ELSE 3 END::INT AS json_ld,
        5 AS profile, CASE WHEN site IN ('amazon', 'menards', 'other') THEN -1 ELSE 10 END::INT AS payload, 3 AS css
        FROM (SELECT p_partkey, {REQUEST_SITE} AS site FROM part) x"""),
    "e07_price_digits": (price_digits, """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice::VARCHAR || '1.2' ELSE p_retailprice::VARCHAR END AS price,
        CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE round(p_retailprice, 2) END AS price_num FROM part"""),
    "e08_dollar_amounts": (dollar_amounts, """SELECT doc_id, replace(regexp_extract(text || ' only $1,' || doc_id || '.50 or $3',
        '\\$([0-9,]+\\.?[0-9]*)', 1), ',', '') AS amount FROM documents"""),
    "e09_e13_cleaned_fields": (cleaned_fields, CLEANED_SQL),
    "e14_resolved_templates": (resolved_templates, RESOLVED_SQL),
    "e15_default_templates": (default_templates, f"""SELECT site, n, {', '.join(f'{_default_sql(f)} AS {f}' for f in S.TEMPLATE_FIELDS)}
        FROM (SELECT site, count(*) AS n FROM (SELECT {REQUEST_SITE} AS site FROM part) x GROUP BY 1) y"""),
    "e16_capped_items": (capped_counts, f"SELECT {PAGE_SQL} AS page_id, least(20, count(*))::INT AS items FROM part GROUP BY 1"),
    "e16_all_items": (all_counts, f"""SELECT {PAGE_SQL} AS page_id, CASE WHEN {PAGE_SQL} % 10 = 3 THEN 0 ELSE count(*) END::INT AS items,
        {PAGE_SQL} % 10 = 3 AS failed FROM part GROUP BY {PAGE_SQL}"""),
    "e17_empty_content": (empty_content, f"""WITH p AS (SELECT page_id, html, lower(html) AS t, 200 AS s FROM pages)
        SELECT page_id, 'empty_content' AS block_type FROM p WHERE {verdict_sql('s', 'html', 't', 'length(html)')} = 'none'
        AND page_id % 4 <> 0 AND page_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 30)"""),
    "e18_unified_items": (unified_items, """SELECT p_partkey, '' AS source, '' AS url, p_name AS title, p_retailprice::VARCHAR AS price, '' AS currency,
        0.0::DOUBLE AS rating, 0 AS review_count, p_brand AS brand, '' AS description, 0 AS images, '' AS availability, '' AS asin,
        '' AS seller, '' AS shipping, '' AS category, '' AS extracted_at FROM part"""),
    "e19_api_products": (api_products, f"""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS title,
        {_PRICE_ONLY} AS price, 'https://shop.example.com/' || p_partkey AS url FROM part WHERE p_partkey % 11 <> 0"""),
    "w10_first_links": (first_links, FIRST_LINKS_SQL),
    "x1_strategy_union": (strategy_union, f"""WITH {LD_CTE}, {PAYLOAD_CTE} SELECT page_id, 'json_ld' AS strategy, count(*) AS products FROM ld GROUP BY 1
        UNION ALL SELECT page_id, 'payload', count(*) FROM pay GROUP BY 1"""),
    "f1_python_rules": (python_rules, """SELECT page_id, 'shop' AS source, url, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS title, '' AS price
        FROM pages WHERE page_id % 2 = 0 AND contains(html, '<h1>')"""),
    "f1_sql_rules": (sql_rules, """WITH p AS (SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN replace(html, '<h1>', '<h2>') ELSE html END AS html FROM pages
        WHERE page_id % 2 = 0), q AS (SELECT *, contains(html, '<h1>') AND contains(html, '</h1>') AS ok FROM p)
        SELECT page_id, CASE WHEN ok THEN 'shop' ELSE '' END AS source, CASE WHEN ok THEN url ELSE '' END AS url,
          CASE WHEN ok THEN regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) ELSE '' END AS title, 0.0::DOUBLE AS rating,
          CASE WHEN NOT ok THEN 'ValueError: substring not found' END AS error FROM q"""),
    "item_flow": (item_flow, f"""WITH n AS (SELECT *, {PAGE_SQL} AS page_id, row_number() OVER (PARTITION BY {PAGE_SQL} ORDER BY p_partkey) AS r,
        {PAGE_SQL} % 2 AS s FROM part)
        SELECT page_id, CASE s WHEN 0 THEN 'amazon' ELSE 'walmart' END AS source, p_name AS title,
          CASE s WHEN 0 THEN p_partkey || '.50' ELSE '$' || p_partkey END AS price,
          CASE s WHEN 0 THEN 'https://www.amazon.com/dp/' || p_partkey || '?x=1' ELSE 'https://www.walmart.com/ip/' || p_partkey END AS url,
          true AS is_valid FROM n WHERE r <= 20 AND p_partkey % 17 <> 0"""),
}
