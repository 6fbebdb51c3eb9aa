"""Node selection, structured data and the chain on literal pages."""

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import chain, dom, nodes, structured

PAGE = """<html><body><ul id="main" class="list wide"><li class="product a" data-asin="1"><h2>One &amp; <b>two</b></h2>
<span class="price">$5</span><script>var x = "<li>";</script></li><li class="other"><h2>Three</h2><br><img src=a.png></li></ul>
<div class="card"><p>unclosed <div itemtype="http://schema.org/Product">inner</div></body>"""


@pytest.mark.parametrize("selector, count", [
    ("li", 2), ("li.product", 1), ("#main > li", 2), ("ul li h2", 2), ("body > li", 0), ("[data-asin]", 1),
    ("[data-asin='1']", 1), ('[class*="wid"]', 1), ("div[itemtype*='Product']", 1), ("h2, span", 3), ("li.product.a", 1),
    (".list.wide .price", 1), ("img[src=a.png]", 1), ("[class*='']", 0),
    ("li.product + li", 1), ("h2 ~ img", 1), ("h2 + img", 0), ("[class^=list]", 1), ("[class$='wide']", 1),
    ("[class~=wide]", 1), ("[class~=wid]", 0), ("ul li.other > h2 ~ br + img", 1), ("h2 > b, h2 + span", 2),
])
def test_selectors(selector, count):
    assert len(dom.select(dom.parse(PAGE), selector)) == count


def test_text_skips_scripts_and_joins_stripped_strings():
    item = dom.first(dom.parse(PAGE).walk(), "li.product")
    assert item.text() == "One &two$5"
    assert item.content().startswith("One & two")


@pytest.mark.parametrize("selector", ["a:hover", "a ! b", ""])
def test_unsupported_selectors_raise(selector):
    with pytest.raises(ValueError):
        dom.compile_selector(selector)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, site string, url string, html string").withColumn(
        "template", nodes.default_template(F.col("site")))


def test_template_cap_and_fallbacks(spark):
    many = "<ul>" + "".join(f"<li class='product'><h2>Item {i}</h2></li>" for i in range(100)) + "</ul>"
    rows = [(1, "shop", "https://x/", many), (2, "shop", "https://x/", ""), (3, "shop", "https://x/", "<div><h3>loose</h3><div>"),
            (4, "shop", "https://x/", "<li class='product'><h2>unclosed<li class='product'><h2>next")]
    got = nodes.template_products(pages(spark, rows)).groupBy("page_id").count().collect()
    assert {r.page_id: r["count"] for r in got} == {1: 100, 3: 1, 4: 2}
    assert nodes.template_products(pages(spark, rows[:1]), limit=20).count() == 20


def test_a_bad_page_fails_alone(spark):
    rows = [(1, "shop", "https://x/", "<p><![foo[bar]]>"), (2, "shop", "https://x/", "<li class='product'><h2>fine</h2></li>")]
    assert [r.page_id for r in nodes.template_products(pages(spark, rows)).collect()] == [2]
    errors = {r.page_id: r.error for r in nodes.with_nodes(pages(spark, rows)).select("page_id", "nodes.error").collect()}
    assert errors[1].startswith("parse: ") and errors[2] is None


def test_a_raising_function_skips_its_page(spark):
    def rule(html, url):
        if "bad" in html:
            raise ValueError(html)
        return [{"title": html}]

    extractors = chain.Extractors()
    extractors.register_python("shop", "list", rule)
    rows = [(1, "shop", "u", "bad"), (2, "shop", "u", "good")]
    assert [(r.page_id, r.title) for r in extractors.run(pages(spark, rows)).collect()] == [(2, "good")]


def test_empty_template_finds_nothing(spark):
    df = pages(spark, [(1, "ebay", "https://x/", "<li><h2>a</h2></li>")])
    empty = nodes.template_struct(dict.fromkeys(nodes.S.TEMPLATE_FIELDS, ""))
    assert nodes.template_products(df.withColumn("template", empty)).count() == 0


def test_json_ld_shapes(spark):
    html = """<script type="application/ld+json">{"@type":"Product","name":"Solo","offers":[],"brand":7,"image":["i.png"]}</script>
    <script data-x="1" type='application/ld+json'>[3, null, "s", {"@type":["Product"],"name":"list type"},
      {"@type":"Product","name":"Solo","offers":{"price":"9"}}, {"@type":"Product","name":"Two","offers":{"price":9.50,"priceCurrency":"USD"},
      "brand":{"name":"B"},"image":{"url":"x"}}]</script><script type="text/javascript">{"@type":"Product","name":"no"}</script>
    <!-- <script type="application/ld+json">{"@type":"Product","name":"commented"}</script> -->
    <script>if (a <!--b) {}</script><script data-type="application/ld+json">{"@type":"Product","name":"other attribute"}</script>
    <script type="application/ld+json; v=1">{"@type":"Product","name":"other type"}</script>
    <script async type=application/ld+json>{"@type":"Product","name":"Three","offers":null}</SCRIPT>"""
    df = spark.createDataFrame([(1, "https://www.ebay.com/x", html)], "page_id long, url string, html string")
    got = [(r.pos, r.source, r.title, r.price, r.brand, r.images) for r in structured.json_ld_products(df).orderBy("pos").collect()]
    assert got == [(0, "ebay", "Solo", "", "", ["i.png"]), (1, "ebay", "Two", "USD 9.5", "B", []),
                   (2, "ebay", "Three", "", "", [])]


def deep(levels):
    return '{"items":' * levels + '{"@type":"Product","name":"deep"}' + "}" * levels


@pytest.mark.parametrize("body, names", [
    ('{"products":[{"@type":"Product","name":"a"},{"x":1},[{"results":{"@type":"Product","name":"b"}}]]}', ["a", "b"]),
    ('{"products":null,"items":[{"@type":"Product","name":"hidden"}]}', []),
    ('{"@type":"Product","name":"top","items":[]}', []), ("[]", []), ("broken", []), ("5", []),
    ('{"products":[],"products":{"@type":"Product","name":"last key"}}', ["last key"]), (deep(3), ["deep"]), (deep(30), ["deep"]), (deep(300), ["deep"]),
])
def test_payload_walk(spark, body, names):
    df = spark.createDataFrame([(1, body)], "page_id long, body string")
    assert [r.title for r in structured.payload_products(df).orderBy("pos").collect()] == names


def test_target_profile(spark):
    html = """<section><a href="/p/one?x#y" aria-label="First long title"></a> $1,234.5 <a href="/p/one#z" aria-label="again, same"></a></section>
    <li><a href="/-/A-2"><span>short</span><div>Second longer title</div></a><b>$7</b></li><a href="/p/three" aria-label="tiny"></a>"""
    df = spark.createDataFrame([(1, "target", "https://www.target.com/s", html)], "page_id long, site string, url string, html string")
    got = [(r.url, r.title, r.price) for r in nodes.profile_products(df).orderBy("pos").collect()]
    assert got == [("https://www.target.com/p/one", "First long title", "1234.5"),
                   ("https://www.target.com/-/A-2", "Second longer title", "7")]


def test_chain_parses_leftover_pages_once(spark):
    df = spark.createDataFrame([(1, "https://www.kohls.com/x", "<p>no items</p>")], "page_id long, url string, html string")
    winners = chain.winning_steps(df)
    plan = winners._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    assert winners.first().strategy == "none"


def test_unregistered_site_uses_default_chain(spark):
    df = spark.createDataFrame([("menards",), ("ebay",), ("amazon",), ("x",)], "site string")
    got = {r[0]: tuple(r)[1:] for r in df.select("site", *chain.minimums(F.col("site")).values()).collect()}
    assert got == {"menards": (3, 5, None, 3), "ebay": (5, 5, 10, 3), "amazon": (None, 5, None, 3), "x": (3, 5, None, 3)}


def test_user_extractors(spark):
    found = chain.Extractors()
    found.register_python("a", "list", lambda html, url: [{"title": html}, {"title": "second", "rating": 2.5}])
    found.register_python("b", "list", lambda html, url: [{"title": "from b", "images": ["x"]}])
    found.register("c", "list", lambda pages: pages.select("page_id", F.upper("html").alias("title")))
    rows = [(1, "a", "u", "one"), (2, "b", "u", "two"), (3, "c", "u", "three"), (4, "d", "u", "four")]
    df = spark.createDataFrame(rows, "page_id long, site string, url string, html string")
    got = sorted((r.page_id, r.title, r.rating, r.images) for r in found.run(df).collect())
    assert got == [(1, "one", 0.0, []), (1, "second", 2.5, []), (2, "from b", 0.0, ["x"]), (3, "THREE", 0.0, [])]
    assert found.run(df, "detail").count() == 0


def test_stray_and_unclosed_tags():
    root = dom.parse("<div><p>a</b></i><br/><span/>b</div>c</div><p>d")
    assert [n.tag for n in root.walk()] == ["div", "p", "br", "span", "p"]
    assert dom.first(root.walk(), "div").text() == "ab" and root.text() == "abcd"
    deep = dom.parse("<li><a>x</b></i>" * 20000)  # nothing here is ever closed
    assert sum(1 for _ in deep.walk()) == 40000


def test_chains_as_data(spark, tmp_path):
    """Order, minimums, a caller's own step, unknown steps, a chain for all other sites, and none at all."""
    entry = lambda n: '{"@type":"Product","name":"item %d"}' % n
    html = '<script type="application/ld+json">[%s]</script>' % ",".join(entry(n) for n in range(4))
    data = pages(spark, [(i, site, "https://x.example/", h) for i, (site, h) in enumerate(
        [("a", html), ("a", ""), ("b", html), ("b", "<p>"), ("c", html), (None, html), ("d", html), ("d", None)])])
    feed = spark.createDataFrame([(i, f"fed {k}", "feed") for i in (0, 1, 3, 5, 7) for k in range(2)], "page_id long, title string, source string")
    rows = [("a", 2, "json_ld", 4), ("a", 1, "feed", 3), ("a", 3, "feed", 2), ("b", 1, "feed", 1), ("b", 1, "json_ld", 1), ("c", 1, "json_ld", 5),
            ("d", 1, "nothing of the kind", 0), ("d", 2, "css", 1), ("d", 3, "payload", 0), (None, 1, "json_ld", 1)]
    ddl = "site string, place int, step string, least int"
    steps = lambda rows, **kw: {r.page_id: (r.strategy, r.method, r.product_count) for r in chain.winning_steps(data, chains=spark.createDataFrame(rows, ddl), **kw).collect()}
    ld, fed, none = ("json_ld", "html_json", 4), ("feed", "feed", 2), ("none", "none", 0)
    assert steps(rows, feeds={"feed": feed}) == {0: ld, 1: fed, 2: ld, 3: fed, 4: none, 5: ld, 6: ("payload", "api_json", 0), 7: ("payload", "api_json", 0)}
    assert steps([r for r in rows if r[0]])[5] == none
    assert set(steps([]).values()) == {none}
    out = chain.chain_products(data, chains=spark.createDataFrame(rows, ddl), feeds={"feed": feed}, folder=str(tmp_path))
    got = {}
    for r in out.collect():
        got.setdefault((r.page_id, r.strategy), set()).add(r.title)
    items = {f"item {n}" for n in range(4)}
    assert got == {(0, "json_ld"): items, (1, "feed"): {"fed 0", "fed 1"}, (2, "json_ld"): items, (3, "feed"): {"fed 0", "fed 1"}, (5, "json_ld"): items}


def test_fixed_chains_as_rows_give_the_same(spark):
    """The fixed minimums, handed in as rows, change nothing."""
    from shelfwatch.rules import sites as R

    rows = [(site, n, step, least) for site, *mins in R.chain_rows() for n, (step, least) in enumerate(zip(R.CHAIN_STEPS, mins, strict=True)) if least is not None]
    rows += [(None, n, step, least) for n, (step, least) in enumerate(R.DEFAULT_CHAIN.items()) if least is not None]
    entry = lambda n: '{"@type":"Product","name":"item %d"}' % n
    made = lambda n: '<script type="application/ld+json">[%s]</script>' % ",".join(entry(k) for k in range(n))
    sites = ["ebay", "amazon", "walmart", "menards", "kohls", "elsewhere", None]
    data = pages(spark, [(i * 10 + n, s, "https://x.example/", made(n)) for i, s in enumerate(sites) for n in (0, 2, 3, 4, 5)])
    table = spark.createDataFrame(rows, "site string, place int, step string, least int")
    a, b = (sorted(map(tuple, chain.winning_steps(data, chains=c).select("page_id", "strategy", "product_count").collect())) for c in (None, table))
    assert a == b and {x[1] for x in a} == {"json_ld", "none"}


def test_extractors_from_sql_and_as_frames(spark):
    """Both forms give the same rows; code that fails or gives no products says so on its page alone."""
    def own(html, url):
        return {"many": [{"title": f"t{i}", "rating": i, "images": ["a"]} for i in range(3)], "none": [], "bad": [{"rating": "five"}]}[html]

    extractors = chain.Extractors()
    extractors.register_python("a", "list", own)
    extractors.register_python("b", "detail", own)
    extractors.register_sql(spark, "own_products")
    extractors.register_sql(spark, "own_details", "detail")
    rows = [(1, "a", "u", "many"), (2, "a", "u", "none"), (3, "a", "u", "bad"), (4, "a", "u", "else"), (5, "b", "u", "many"), (6, None, "u", "many"), (7, "a", None, None)]
    data = spark.createDataFrame(rows, "page_id long, site string, url string, html string")
    columns = ["page_id", "title", "rating", "images", "source", "error"]
    sql = spark.sql("SELECT p.page_id, x.* FROM {p} p, LATERAL own_products(p.site, p.url, p.html) x", p=data).select(*columns)
    frame = extractors.run(data, errors=True).select(*columns)
    got = sorted(map(tuple, sql.collect()), key=repr)
    assert got == sorted(map(tuple, frame.collect()), key=repr)
    assert [(g[0], g[1], g[5] is None) for g in got] == [(1, "t0", True), (1, "t1", True), (1, "t2", True), (3, "", False), (4, "", False), (7, "", False)]
    assert "KeyError" in got[4][5] and extractors.run(data).count() == 3
    assert spark.sql("SELECT count(*) FROM {p} p, LATERAL own_details(p.site, p.url, p.html) x", p=data).first()[0] == 3
    assert extractors.run(data.filter("false"), errors=True).count() == 0
    with pytest.raises(Exception, match="must be a string"):
        spark.sql("SELECT * FROM {p} p, LATERAL own_products(p.site, p.page_id, p.html) x", p=data).collect()
