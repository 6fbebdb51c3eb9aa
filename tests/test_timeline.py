"""Ordered operators against plain windows, with a key that owns a third of all rows."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwatch.operators import timeline as tl
from shelfwatch.operators.products import deduplicated, with_keys
from shelfwatch.operators.verdicts import shared_verdicts


@pytest.fixture(scope="module")
def rows(spark):
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 40))
    # Several rows share a time; some hours are crowded and others empty.
    second = F.floor(F.pow(F.rand(7), 3) * 90000).cast("int")
    return spark.range(0, 3000, 1, 4).select(
        F.col("id").alias("n"), hot.alias("key"), F.timestamp_seconds(second).alias("ts"), (F.rand(3) * 100).alias("v"),
        (F.rand(5) < 0.3).alias("is_value"),
    ).persist()


def order():
    return W.partitionBy("key").orderBy("ts", "n")


def table(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("ranges", [1, 8, 150])
def test_positions(rows, ranges):
    got = tl.positions(rows, ["key"], "ts", "n", "p", ranges)
    assert table(got, "n", "p") == table(rows.withColumn("p", F.row_number().over(order())), "n", "p")


@pytest.mark.parametrize("ranges", [1, 8, 150])
@pytest.mark.parametrize("n", [2, 50])
def test_rolling_mean(rows, ranges, n):
    got = tl.rolling_mean(rows, ["key"], "ts", "n", "v", n, "m", ranges)
    want = rows.withColumn("m", F.avg("v").over(order().rowsBetween(-(n - 1), 0)))
    rounded = F.round("m", 8).alias("m")
    assert table(got, "n", rounded) == table(want, "n", rounded)


@pytest.mark.parametrize("newest", [True, False])
def test_top_rows(rows, newest):
    order = [F.desc("ts"), F.desc("n")] if newest else ["ts", "n"]
    want = rows.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(*order))).filter("r <= 20")
    assert table(tl.top_rows(rows, ["key"], ["ts", "n"], 20, newest, "r", 4), "n", "r") == table(want, "n", "r")


@pytest.mark.parametrize("ttl", [None, 900])
@pytest.mark.parametrize("ranges", [8, 150])
def test_as_of(rows, ttl, ranges):
    values = rows.filter("is_value")
    got = tl.as_of(rows.select("n", "key", "ts"), values, ["key"], "ts", "n", "v", ttl, "found", ranges)
    before = order().rowsBetween(W.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("is_value"), F.struct("ts", "v")), ignorenulls=True).over(before)
    fresh = F.lit(True) if ttl is None else (F.unix_timestamp("ts") - F.unix_timestamp(F.col("s.ts"))) < ttl
    want = rows.withColumn("s", seen).withColumn("found", F.when(fresh, F.col("s.v")))
    key = lambda r: (r[0], -1.0 if r[1] is None else r[1])
    assert sorted(map(key, got.select("n", "found").collect())) == sorted(map(key, want.select("n", "found").collect()))


def test_ranges_stay_even(spark):
    """One key has nine tenths of the rows, all within an hour; the other keys have no times."""
    hot = F.col("id") % 10 > 0
    df = spark.range(0, 40000, 1, 8).select(
        F.col("id").alias("n"), F.when(hot, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 3)).alias("key"),
        F.when(hot, F.timestamp_seconds(F.col("id") % 3600)).alias("ts"))
    dealt = tl.in_ranges(df, ["key"], "ts", "n", 16)
    sizes = [r["count"] for r in dealt.groupBy("_range").count().collect()]
    assert sum(sizes) == 40000 and max(sizes) < 2 * 40000 / 16
    untimed = tl.in_ranges(df.withColumns({"key": F.lit("one"), "ts": F.lit(None).cast("timestamp")}), ["key"], "ts", "n", 16)
    sizes = [r["count"] for r in untimed.groupBy("_range").count().collect()]
    assert sum(sizes) == 40000 and max(sizes) < 2 * 40000 / 16
    p = F.row_number().over(order())
    assert table(tl.positions(df, ["key"], "ts", "n", "p", 16), "n", "p") == table(df.withColumn("p", p), "n", "p")


def test_timelines_of_empty_tables(rows):
    none = rows.filter("false")
    assert tl.positions(none, ["key"], "ts", "n").count() == 0
    assert tl.rolling_mean(none, ["key"], "ts", "n", "v", 3).count() == 0
    assert tl.as_of(none, none, ["key"], "ts", "n", "v").count() == 0


def test_hot_limits_run_in_map_tasks(rows):
    plan = tl.top_rows(rows, ["key"], ["ts", "n"], 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Partial") >= 2 and "WindowGroupLimit" in plan


def test_dedup_against_a_seen_set(spark):
    data = [(i, f"s{i % 2}", "" if i % 5 == 0 else f"u{i % 7}", "" if i % 4 == 0 else f"a{i % 9}", f"t{(i * 7) % 30:02d}")
            for i in range(200)]
    df = spark.createDataFrame(data, "n int, source string, url string, asin string, extracted_at string")
    got = {r.n for r in deduplicated(df, ["n"]).collect()}
    ids, urls, want = set(), set(), set()
    for row in sorted(data, key=lambda r: (r[4], r[0])):
        if (row[3] and (row[1], row[3]) in ids) or (row[2] and row[2] in urls):
            continue
        ids.add((row[1], row[3]))
        urls.add(row[2])
        want.add(row[0])
    assert got == want


def test_dedup_of_chained_keys_and_page_addresses(spark):
    data = [("A", "u1", "a1", 1), ("B", "u1", "a2", 2), ("C", "u2", "a2", 3), ("D", "p", "", 4), ("E", "p", "", 5), ("F", "q", "", 6), ("G", "q", "", 7)]
    df = spark.createDataFrame([(n, "s", u, a, t, "p") for n, u, a, t in data], "n string, source string, url string, asin string, extracted_at int, page_url string")
    assert {r.n for r in deduplicated(df, ["n"], page_url="page_url").collect()} == {"A", "C", "D", "E", "F"}
    assert deduplicated(df.filter("false"), ["n"]).count() == 0


def in_order(data):
    """(n, source, url, asin, place): what a pass in order keeps."""
    seen, kept = set(), set()
    for n, source, url, asin, _ in sorted(data, key=lambda r: (r[4], r[0])):
        keys = {k for k in (("url", url) if url else None, ("id", source, asin) if asin else None) if k}
        if not keys & seen:
            seen |= keys
            kept.add(n)
    return kept


@pytest.mark.parametrize("settle", [0, 5, 60, 100_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_settles_groups_of_any_size(spark, seed, settle):
    """Random graphs of keys from loose to one large group, in one pass, by groups and in rounds alone."""
    rng = random.Random(seed)
    data = [(i, f"s{rng.randrange(2)}", rng.choice(["", f"u{rng.randrange(90)}"]), rng.choice(["", f"a{rng.randrange(60)}"]), f"t{rng.randrange(40):02d}")
            for i in range(150)]
    chain = [(1000 + i, "c", f"v{(i + 1) // 2}", f"b{i // 2}", f"t{i:03d}") for i in range(11)]
    df = spark.createDataFrame(data + chain, "n int, source string, url string, asin string, extracted_at string")
    assert {r.n for r in deduplicated(df, ["n"], settle=settle).collect()} == in_order(data + chain)


def test_long_chains_take_few_writes(spark, tmp_path):
    """Each row shares a key with the one before and the one after, urls and asins in turn."""
    data = [(i, "s", f"u{(i + 1) // 2}", f"a{i // 2}", i) for i in range(10_000)]
    df = spark.createDataFrame(data, "n int, source string, url string, asin string, extracted_at int").repartition(4)
    kept = deduplicated(df, ["n"], folder=str(tmp_path))
    assert [r.n for r in kept.orderBy("n").collect()] == list(range(0, 10_000, 2))
    assert len(list((tmp_path / "shelfwatch").iterdir())) == 2
    # Two chains as groups of their own, found by halving links: some twenty tables instead of hundreds.
    folder = tmp_path / "groups"
    chains = spark.createDataFrame(data[:600] + [(n + 20_000, "z", f"z{u}", a, t) for n, _, u, a, t in data[:600]], df.schema)
    assert deduplicated(chains, ["n"], folder=str(folder), settle=600).count() == 600
    assert len(list((folder / "shelfwatch").iterdir())) < 30


def test_dedup_against_known_rows(spark):
    data = [(1, "s", "u1", "a1", 1), (2, "s", "u2", "", 2), (3, "s", "", "a3", 3), (4, "s", "u1", "a4", 4), (5, "s", "", "", 5)]
    df = spark.createDataFrame(data, "n int, source string, url string, asin string, extracted_at int")
    known = with_keys(df.filter("n <= 3"), ["n"])
    again = spark.createDataFrame([(6, "s", "u9", "a1", 1), (7, "s", "u2", "a7", 1), (8, "s", "u8", "a7", 2), (9, "s", "u8", "", 3)], df.schema)
    assert {r.n for r in deduplicated(again, ["n"], known=known).collect()} == {8}


def test_shared_verdict_of_first_response(spark):
    opening = "o" * 500
    data = [(3, 200, opening + " captcha i am not a robot"), (1, 200, opening), (2, 200, opening + " access denied"),
            (4, None, opening), (5, 200, "access denied" + opening)]
    df = spark.createDataFrame(data, "id long, status_code int, text string")
    got = {r.id: r.verdict.block_type for r in shared_verdicts(df, "id", 500).collect()}
    assert got == {1: "none", 2: "none", 3: "none", 4: "http_timeout", 5: "bot_detected"}
    own = {r.id: r.verdict.block_type for r in shared_verdicts(df, "id").collect()}
    assert own == {1: "none", 2: "bot_detected", 3: "captcha", 4: "http_timeout", 5: "bot_detected"}


def test_missing_keys_and_times_keep_their_rows(spark):
    data = [(1, None, 5), (2, None, 3), (3, "a", None), (4, "a", 1), (5, None, None)]
    df = spark.createDataFrame(data, "n int, key string, second int").withColumn("ts", F.timestamp_seconds("second"))
    got = {r.n: (r.key, r.p) for r in tl.positions(df, ["key"], "ts", "n", "p", 3).collect()}
    assert got == {1: ("", 3), 2: ("", 2), 3: ("a", 1), 4: ("a", 2), 5: ("", 1)}
    means = {r.n: r.m for r in tl.rolling_mean(df.withColumn("v", F.col("n") * 1.0), ["key"], "ts", "n", "v", 2, "m", 3).collect()}
    assert means == {5: 5.0, 2: 3.5, 1: 1.5, 3: 3.0, 4: 3.5}
    found = {r.n: r.n_before for r in tl.as_of(df, df, ["key"], "ts", "n", "n", None, "n_before", 3).collect()}
    assert found == {5: None, 2: 5, 1: 2, 3: None, 4: 3}
