"""Product cleaning, typed verdicts, and the readers and writers."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.functions import coerce
from shelfwatch.operators import products as op
from shelfwatch.operators.items import unified
from shelfwatch.queries.tables import ATTEMPTS, RESPONSES, Tables, quoted
from shelfwatch.queries.url_queries import REQUEST_SITE
from shelfwatch.rules.selectors import DEFAULT_TEMPLATES, TEMPLATE_FIELDS
from shelfwatch.session import work_folder
from shelfwatch.sources import attempt_log, pages, product_files
from shelfwatch.sources.templates import TemplateTable

# Two copies of every part. A third of all rows share one address, ids repeat within a source.
COPIES = """
SELECT p_partkey, copy, concat('s', CAST(p_partkey % 3 AS STRING)) AS source,
       CASE WHEN p_partkey % 3 = 0 THEN 'https://hot.example.com/' WHEN p_partkey % 10 = 1 THEN ''
            ELSE concat('https://shop.example.com/', CAST(p_partkey % 500 AS STRING)) END AS url,
       CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('a', CAST(p_partkey % 700 AS STRING)) END AS asin,
       p_name AS title, concat('2024-01-0', CAST(copy AS STRING), 'T', CAST(p_partkey % 10 AS STRING)) AS extracted_at
FROM part, (SELECT 1 AS copy UNION ALL SELECT 2) c
""".strip()


def copies(t: Tables):
    doubled = t("part").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    key = F.col("p_partkey")
    return doubled.select(
        "p_partkey", "copy", F.concat(F.lit("s"), key % 3).alias("source"),
        F.when(key % 3 == 0, F.lit("https://hot.example.com/")).when(key % 10 == 1, F.lit(""))
        .otherwise(F.concat(F.lit("https://shop.example.com/"), key % 500)).alias("url"),
        F.when(key % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("a"), key % 700)).alias("asin"),
        F.col("p_name").alias("title"),
        F.concat(F.lit("2024-01-0"), "copy", F.lit("T"), key % 10).alias("extracted_at"))


def deduplicated(t: Tables):
    return op.deduplicated(copies(t), ["p_partkey", "copy"]).select("p_partkey", "copy", "source", "url", "asin")


DEDUP_SQL = f"""WITH RECURSIVE c AS ({COPIES}),
  rounds AS (
    SELECT p_partkey, copy, source, url, asin, extracted_at, FALSE AS kept FROM c
    UNION ALL
    SELECT p_partkey, copy, source, url, asin, extracted_at, first AS kept FROM (
      SELECT *, bool_or(first) OVER (PARTITION BY source, asin) AS by_id, bool_or(first) OVER (PARTITION BY url) AS by_url FROM (
        SELECT *, (asin = '' OR row_number() OVER (PARTITION BY source, asin ORDER BY extracted_at, p_partkey, copy) = 1)
              AND (url = '' OR row_number() OVER (PARTITION BY url ORDER BY extracted_at, p_partkey, copy) = 1) AS first
        FROM rounds WHERE NOT kept) a) b
    WHERE first OR NOT ((asin <> '' AND by_id) OR (url <> '' AND by_url)))
SELECT p_partkey, copy, source, url, asin FROM rounds WHERE kept"""


def validated(t: Tables):
    key = F.col("p_partkey")
    rows = t("part").select(
        "p_partkey",
        F.when(key % 9 == 0, F.lit("abc")).when(key % 9 == 1, F.lit("")).otherwise(F.col("p_name")).alias("title"),
        F.when(key % 4 == 0, F.lit("call us")).otherwise(F.col("p_retailprice").cast("string")).alias("price"))
    return op.validated(rows)


VALIDATED_SQL = """WITH r AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'abc' WHEN 1 THEN '' ELSE p_name END AS title,
    CASE WHEN p_partkey % 4 = 0 THEN 'call us' ELSE p_retailprice::VARCHAR END AS price FROM part)
SELECT p_partkey, title, CASE WHEN length(title) >= 5 AND NOT regexp_matches(price, '[0-9]') THEN '' ELSE price END AS price,
    length(title) >= 5 AS is_valid FROM r"""


def by_source(t: Tables):
    return op.by_source(copies(t))


# ---- Verdict JSON, one per attempt; every fifth has a field of the wrong kind ------------------


def _json(t: Tables, *parts):
    a = t.attempts()
    return a.select("event_id", F.concat(*parts).alias("raw"))


def _id(*before_after):
    before, after = before_after
    return F.concat(F.lit(before), F.col("event_id").cast("string"), F.lit(after))


def selector_verdicts(t: Tables):
    raw = F.concat(
        F.lit('{"site":"'), F.col("site"), F.lit('"'),
        F.when(F.col("event_id") % 5 == 0, F.lit(',"price_selector":5')).otherwise(F.lit(',"price_selector":".p"')),
        _id(',"title_selector":"h', '"'), F.when(F.col("event_id") % 3 == 0, F.lit(',"page_type":"detail"')).otherwise(F.lit("")),
        F.lit(',"unknown_key":[1]}'))
    text = F.when(F.col("event_id") % 11 == 0, F.lit("not json")).otherwise(raw)
    return coerce.with_verdict(t.attempts().select("event_id", text.alias("raw")), "raw", coerce.selector_verdict, "v").select("event_id", "v.*")


SELECTOR_SQL = f"""WITH a AS ({ATTEMPTS}), r AS (SELECT event_id, site AS s, event_id % 11 <> 0 AS j, event_id % 11 <> 0 AND event_id % 5 <> 0 AS ok FROM a)
SELECT event_id, CASE WHEN j THEN s ELSE '' END AS site, CASE WHEN ok AND event_id % 3 = 0 THEN 'detail' ELSE 'search' END AS page_type,
  {', '.join(f"CASE WHEN ok THEN 'h' || event_id ELSE '' END AS {f}" if f == 'title_selector'
             else f"CASE WHEN ok THEN '.p' ELSE '' END AS {f}" if f == 'price_selector' else f"'' AS {f}" for f in TEMPLATE_FIELDS)} FROM r"""


def block_verdicts(t: Tables):
    raw = F.concat(
        F.lit('{"reasoning":'), F.when(F.col("event_id") % 5 == 0, F.lit("null")).otherwise(_id('"because ', '"')),
        F.when(F.col("event_id") % 3 > 0, F.concat(F.lit(',"block_type":"'), "block_type", F.lit('"'))).otherwise(F.lit("")),
        F.when(F.col("event_id") % 4 == 0, F.lit(',"suggested_action":"skip"')).otherwise(F.lit("")), F.lit("}"))
    return coerce.with_verdict(t.attempts().select("event_id", raw.alias("raw")), "raw", coerce.block_verdict, "v").select("event_id", "v.*")


BLOCK_SQL = f"""WITH a AS ({ATTEMPTS}) SELECT event_id, CASE WHEN event_id % 3 > 0 THEN block_type ELSE 'unknown' END AS block_type,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE 'because ' || event_id END AS reasoning,
  CASE WHEN event_id % 4 = 0 THEN 'skip' ELSE 'retry_same' END AS suggested_action FROM a"""


def threshold_verdicts(t: Tables):
    e = F.col("event_id")
    request = F.when(e % 7 == 0, F.lit('"request_timeout":"soon"')).when(e % 7 == 1, F.lit('"request_timeout":"45.5"')).otherwise(
        _id('"request_timeout":', ""))
    delay = (F.when(e % 6 == 0, F.lit(',"delay_after":[5,10.5]')).when(e % 6 == 1, F.lit(',"delay_after":"[4, 9]"'))
             .when(e % 6 == 2, F.lit(',"delay_after":"four"')).when(e % 6 == 3, F.lit(',"delay_after":[]'))
             .when(e % 6 == 4, F.lit(',"delay_after":7')).otherwise(F.lit("")))
    raw = F.concat(F.lit("{"), request, delay, F.lit(',"reasoning":"r"}'))
    v = coerce.with_verdict(t.attempts().select("event_id", raw.alias("raw")), "raw", coerce.threshold_verdict, "v")
    return v.select("event_id", "v.request_timeout", "v.page_load_timeout", "v.reasoning",
                    F.element_at("v.delay_after", 1).alias("delay_min"), F.element_at("v.delay_after", 2).alias("delay_max"))


THRESHOLD_SQL = f"""WITH a AS ({ATTEMPTS}), r AS (SELECT event_id, event_id % 6 AS d, event_id % 7 <> 0 AND event_id % 6 NOT IN (2, 4) AS ok FROM a)
SELECT event_id, CASE WHEN NOT ok THEN 30.0 WHEN event_id % 7 = 1 THEN 45.5 ELSE event_id END::DOUBLE AS request_timeout, 30.0::DOUBLE AS page_load_timeout,
  CASE WHEN ok THEN 'r' ELSE '' END AS reasoning, CASE WHEN ok AND d = 0 THEN 5.0 WHEN ok AND d = 1 THEN 4.0 ELSE 3.0 END::DOUBLE AS delay_min,
  CASE WHEN ok AND d = 0 THEN 10.5 WHEN ok AND d = 1 THEN 9.0 ELSE 8.0 END::DOUBLE AS delay_max FROM r"""


def url_format_verdicts(t: Tables):
    e = F.col("event_id")
    raw = F.concat(
        F.lit('{"site":"'), F.col("site"), F.lit('"'), F.when(e % 3 == 0, F.lit(',"search_param":"k"')).otherwise(F.lit("")),
        F.when(e % 4 == 0, F.lit(',"uses_js_rendering":false')).otherwise(F.lit("")),
        _id(',"search_url_pattern":"https://x/', '?q={query}"'), F.lit("}"))
    return coerce.with_verdict(t.attempts().select("event_id", raw.alias("raw")), "raw", coerce.url_format_verdict, "v").select("event_id", "v.*")


URL_FORMAT_SQL = f"""WITH a AS ({ATTEMPTS}) SELECT event_id, site, 'https://x/' || event_id || '?q={{query}}' AS search_url_pattern,
  CASE WHEN event_id % 3 = 0 THEN 'k' ELSE 'q' END AS search_param, 'page' AS page_param, '' AS product_url_pattern,
  event_id % 4 <> 0 AS uses_js_rendering FROM a"""


# ---- Readers and writers ---------------------------------------------------------------------


def read_pages(t: Tables):
    p = pages.read_pages(t.spark, f"{t.sf_dir}/pages.parquet")
    return p.select("page_id", "url", F.length("html").alias("chars"), F.coalesce("status_code", F.lit(-1)).alias("status"))


def _log_lines(t: Tables):
    """Attempt lines as text: some lack keys, some are blank, some are broken."""
    line = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("trace_id"), "site", "page_pattern", "url", "success", "latency_ms",
        F.when(F.col("event_id") % 3 > 0, F.col("status_code")).alias("status_code"),
        F.when(F.col("event_id") % 5 > 0, F.col("level")).alias("strategy_tier"),
        F.when(F.col("event_id") % 7 > 0, F.col("waf_detected")).alias("waf_detected"),
        F.when(F.col("event_id") % 2 > 0, F.create_map(F.lit("server"), F.lit("x"))).alias("response_headers")))
    e = F.col("event_id")
    return t.attempts().select(F.when(e % 13 == 0, F.lit("")).when(e % 17 == 0, F.lit('{"site": broken')).otherwise(line).alias("value"))


def read_log(t: Tables):
    folder = work_folder(t.spark, "log")
    _log_lines(t).write.option("compression", "none").text(f"{folder}/session_1.jsonl")
    lines = attempt_log.read_attempts(t.spark, f"{folder}/session_1.jsonl", pattern="*")
    return lines.select(
        F.coalesce("trace_id", F.lit("")).alias("trace_id"), F.coalesce("site", F.lit("")).alias("site"), "status_code",
        "strategy_tier", "waf_detected", F.size("response_headers").alias("headers"),
        F.col(attempt_log.CORRUPT).isNotNull().alias("bad"))


READ_LOG_SQL = f"""WITH a AS ({ATTEMPTS}), r AS (SELECT *, event_id % 17 = 0 AS bad FROM a WHERE event_id % 13 <> 0)
SELECT CASE WHEN bad THEN '' ELSE event_id::VARCHAR END AS trace_id, CASE WHEN bad THEN '' ELSE site END AS site,
  CASE WHEN bad OR event_id % 3 = 0 THEN 0 ELSE status_code END::INT AS status_code,
  CASE WHEN bad OR event_id % 5 = 0 THEN 1 ELSE level END::INT AS strategy_tier,
  CASE WHEN bad OR event_id % 7 = 0 THEN '' ELSE waf_detected END AS waf_detected,
  CASE WHEN bad OR event_id % 2 = 0 THEN 0 ELSE 1 END::INT AS headers, bad FROM r"""


def append_log(t: Tables):
    folder = work_folder(t.spark, "append")
    a = t.attempts().select(F.col("event_id").cast("string").alias("trace_id"), "site", "success", "latency_ms")
    attempt_log.append_attempts(a.filter("success"), folder)
    attempt_log.append_attempts(a.filter("NOT success"), folder)
    back = attempt_log.with_file_place(attempt_log.read_attempts(t.spark, folder))
    # Each task wrote its rows in the order of the table, one file each, so ids rise along a file's lines.
    before = F.lag(F.col("trace_id").cast("long")).over(Window.partitionBy("_file").orderBy("_block", "_line"))
    placed = back.withColumn("rises", F.coalesce(before < F.col("trace_id").cast("long"), F.lit(True)))
    return placed.groupBy("site", "success").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("latency_ms"), 3).alias("latency_ms"), F.min("rises").alias("in_line_order"))


def recorded_attempts(t: Tables):
    r = t.responses().select(
        "text", "status_code", F.col("doc_id").cast("int").alias("attempt_index"), F.lit("shop").alias("site"),
        F.lit("search").alias("page_pattern"), F.concat(F.lit("https://shop/"), "doc_id").alias("url"),
        F.lit(None).cast("int").alias("level"), F.lit(None).cast("map<string,string>").alias("headers"))
    made = attempt_log.recorded(r, F.lit("none"), F.lit(True), F.lit(1.5), F.lit(0.0))
    return made.select(
        "attempt_index", "url", "status_code", "strategy_tier", "full_html_size", F.md5("response_snippet").alias("snippet"),
        F.size("response_headers").alias("headers"), F.length("trace_id").alias("id_length"),
        F.length("timestamp").alias("time_length"))


def _products(t: Tables):
    key = F.col("p_partkey")
    return unified(t("part").select(
        F.concat(F.lit("s"), key % 5).alias("source"), F.col("p_name").alias("title"),
        F.col("p_retailprice").cast("string").alias("price"), F.col("p_brand").alias("brand"), key.cast("string").alias("asin"),
        F.when(key % 2 == 0, F.array(F.concat(F.lit("i,\""), key), F.lit("j"))).alias("images"),
        F.concat("p_type", F.lit(', "quoted"')).alias("description")))


def _read_back(df):
    return df.select("source", "title", "price", "brand", "asin", "description", F.array_join("images", "|").alias("images"),
                     "rating", "crawl_date")


READ_BACK_SQL = """SELECT 's' || (p_partkey % 5) AS source, p_name AS title, p_retailprice::VARCHAR AS price, p_brand AS brand,
  p_partkey::VARCHAR AS asin, p_type || ', "quoted"' AS description,
  CASE WHEN p_partkey % 2 = 0 THEN 'i,"' || p_partkey || '|j' ELSE '' END AS images, 0.0::DOUBLE AS rating"""


def json_products(t: Tables):
    folder = work_folder(t.spark, "products-json")
    product_files.write_products_json(_products(t), folder, F.to_date(F.lit("2024-02-01")))
    return _read_back(product_files.read_products_json(t.spark, folder))


def csv_products(t: Tables):
    folder = work_folder(t.spark, "products-csv")
    product_files.write_products_csv(_products(t), folder, F.to_date(F.lit("2024-02-01")))
    back = product_files.read_products_csv(t.spark, folder)
    return _read_back(back)


def run_dump(t: Tables):
    folder = work_folder(t.spark, "run")
    product_files.write_run(_products(t), folder)
    back = product_files.read_products_json(t.spark, f"{folder}/json")
    from_csv = product_files.read_products_csv(t.spark, f"{folder}/csv", dated=False)
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n")).join(
        from_csv.groupBy("source").agg(F.count(F.lit(1)).alias("n_csv")), "source")


TEMPLATES = f"SELECT site, p_type AS page_type, max(p_partkey) AS hi FROM (SELECT *, {REQUEST_SITE} AS site FROM part) x GROUP BY 1, 2"


def template_table(t: Tables):
    table = TemplateTable(t.spark, work_folder(t.spark, "templates"))
    keys = t.view(TEMPLATES, "part")

    def rows(df, text):
        fields = [F.concat(F.lit(text), F.col("hi")).alias(f) if f == "title_selector" else F.lit("").alias(f) for f in TEMPLATE_FIELDS]
        return df.select("site", "page_type", *fields)

    table.save(rows(keys, "first "))
    table.save(rows(keys.filter("page_type = 'SMALL'"), "second "))
    table.delete(keys.filter("page_type = 'PROMO'"))
    return table.all().select("site", "page_type", "title_selector")


def template_sites(t: Tables):
    table = TemplateTable(t.spark, work_folder(t.spark, "templates"))
    keys = t.view(TEMPLATES, "part")
    table.save(keys.select("site", "page_type", *[F.lit("").alias(f) for f in TEMPLATE_FIELDS]))
    return table.sites()


def stored_back(t: Tables):
    """Three runs over one table: the first without some keys, one in the same day, one a day and a half hour later."""
    table, keys, out = TemplateTable(t.spark, work_folder(t.spark, "templates")), t.view(TEMPLATES, "part"), []
    flagged = keys.select("*", (F.col("hi") % 4 == 0).alias("has_sample"), (F.col("hi") % 5 == 0).alias("force"))
    runs = [(1, "2024-01-01 00:00:00", flagged.filter(F.col("hi") % 3 > 0).drop("force")), (2, "2024-01-01 01:00:00", flagged.drop("force")),
            (3, "2024-01-02 00:30:00", flagged)]
    for n, now, asked in runs:
        made = [F.concat(F.lit(f"run {n} "), F.col("hi")).alias(f) if f == "title_selector" else F.lit("").alias(f) for f in TEMPLATE_FIELDS]
        generated = keys.filter(F.col("hi") % 7 > 0).select("site", "page_type", *made)
        answer = table.resolve(asked, generated, F.to_timestamp(F.lit(now)))
        out.append(answer.select(F.lit(n).alias("run"), "site", "page_type", "origin", F.col("template.title_selector").alias("title")))
    last = table.all().select(F.lit(4).alias("run"), "site", "page_type", F.lit("table").alias("origin"), F.col("title_selector").alias("title"))
    return reduce(DataFrame.unionByName, [*out, last])


def _stored_back_sql() -> str:
    """Of each run the key's origin and title; a NULL default title reads as such on both sides."""
    made = lambda n: f"CASE WHEN hi % 7 > 0 THEN 'run {n} ' || hi ELSE {_DEFAULT_TITLE} END"
    new = "CASE WHEN hi % 7 > 0 THEN 'generated' ELSE 'default' END"
    return f"""WITH k AS ({TEMPLATES}),
  r AS (SELECT *, hi % 3 > 0 AS early, CASE WHEN hi % 5 = 0 THEN TRUE WHEN hi % 3 = 0 THEN FALSE ELSE hi % 4 <> 0 END AS anew FROM k),
  o AS (SELECT 1 AS run, site, page_type, {new} AS origin, {made(1)} AS title FROM r WHERE early
    UNION ALL SELECT 2, site, page_type, CASE WHEN early THEN 'cached' ELSE {new} END, CASE WHEN early THEN {made(1)} ELSE {made(2)} END FROM r
    UNION ALL SELECT 3, site, page_type, CASE WHEN anew THEN {new} WHEN early THEN 'stored' ELSE 'cached' END,
        CASE WHEN anew THEN {made(3)} WHEN early THEN {made(1)} ELSE {made(2)} END FROM r)
SELECT * FROM o UNION ALL SELECT 4, site, page_type, 'table', title FROM o WHERE run = 3"""


_DEFAULT_TITLE = " ".join(
    ["CASE site", *[f"WHEN {quoted(s)} THEN {quoted(d['title_selector'])}" for s, d in DEFAULT_TEMPLATES.items() if s and d.get("title_selector")],
     f"ELSE {quoted(DEFAULT_TEMPLATES['']['title_selector'])} END"])


QUERIES = {
    "v1_validated": (validated, VALIDATED_SQL),
    "v2_deduplicated": (deduplicated, DEDUP_SQL),
    "v3_selector_verdicts": (selector_verdicts, SELECTOR_SQL),
    "v4_block_verdicts": (block_verdicts, BLOCK_SQL),
    "v5_threshold_verdicts": (threshold_verdicts, THRESHOLD_SQL),
    "v6_url_format_verdicts": (url_format_verdicts, URL_FORMAT_SQL),
    "a09_products_by_source": (by_source, f"WITH c AS ({COPIES}) SELECT source, count(*) AS products FROM c GROUP BY 1"),
    "s01_read_pages": (read_pages, "SELECT page_id, url, length(html)::INT AS chars, -1 AS status FROM pages"),
    "s02_s04_read_log": (read_log, READ_LOG_SQL),
    "s03_l3_append_log": (append_log, f"WITH a AS ({ATTEMPTS}) SELECT site, success, count(*) AS n, round(sum(latency_ms), 3) AS latency_ms, TRUE AS in_line_order FROM a GROUP BY 1, 2"),
    "s05_recorded_attempts": (recorded_attempts, f"""WITH r AS ({RESPONSES}) SELECT doc_id::INT AS attempt_index, 'https://shop/' || doc_id AS url,
    coalesce(status_code, 0)::INT AS status_code, 1 AS strategy_tier, length(text)::BIGINT AS full_html_size, md5(left(text, 2000)) AS snippet,
    0 AS headers, 12 AS id_length, 26 AS time_length FROM r"""),
    "s06_json_products": (json_products, f"{READ_BACK_SQL}, '2024-02-01' AS crawl_date FROM part"),
    "s07_csv_products": (csv_products, f"{READ_BACK_SQL}, '2024-02-01' AS crawl_date FROM part"),
    "s08_run_dump": (run_dump, "SELECT 's' || (p_partkey % 5) AS source, count(*) AS n, count(*) AS n_csv FROM part GROUP BY 1"),
    "s09_template_table": (template_table, f"""WITH k AS ({TEMPLATES}) SELECT site, page_type,
        CASE page_type WHEN 'SMALL' THEN 'second ' ELSE 'first ' END || hi AS title_selector FROM k WHERE page_type <> 'PROMO'"""),
    "e14_s09_stored_back": (stored_back, _stored_back_sql()),
    "s09_template_sites": (template_sites, f"WITH k AS ({TEMPLATES}) SELECT DISTINCT site FROM k"),
}
