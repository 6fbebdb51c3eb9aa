"""Verdicts kept over runs: equal to one run over all, with only new texts classified."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators.verdict_store import VerdictStore, key_filter, maybe_among
from shelfwatch.operators.verdicts import shared_verdicts

RESPONSE = "id long, status_code int, text string"


def at(hours):
    return F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * hours))


@pytest.fixture
def responses(spark):
    rng = random.Random(4)
    parts = ["access denied", "captcha i am not a robot", "just a moment cloudflare", "x" * 600, "plain words", ""]
    rows = [(i, rng.choice([200, 403, None, 503]), None if i % 17 == 0 else "o" * rng.choice([0, 40]) + rng.choice(parts) + rng.choice(["", " y" * 300])) for i in range(120)]
    return spark.createDataFrame(rows, RESPONSE).repartition(3)


@pytest.mark.parametrize("bits", [1 << 20, 8])
@pytest.mark.parametrize("chars", [None, 40])
def test_runs_equal_one_run(spark, tmp_path, responses, chars, bits):
    """Also where the filter is so small that it takes nearly every text for a known one."""
    store = VerdictStore(spark, str(tmp_path / "store"), chars, bits=bits)
    run = lambda rows, name, hours: {r.id: (r.verdict.block_type, r.origin) for r in store.classify(rows, "id", name, at(hours), str(tmp_path)).collect()}
    want = {r.id: r.verdict.block_type for r in shared_verdicts(responses, "id", chars).collect()}
    first = run(responses.filter("id < 70"), "a", 0)
    assert first == {i: (v, "new") for i, v in want.items() if i < 70}
    keys = {(r.status_code, (r.text or "")[:chars]) for r in responses.filter("id < 70").collect()}
    second = run(responses, "b", 1)
    assert {i: v for i, (v, _) in second.items()} == want
    for r in responses.collect():
        assert second[r.id][1] == ("stored" if (r.status_code, (r.text or "")[:chars]) in keys else "new")
    stored = store.all().count()
    assert run(responses, "b", 1) == second and store.all().count() == stored  # repeated
    assert {o for _, o in run(responses, "c", 2).values()} == {"stored"}
    assert {o for _, o in run(responses, "d", 24).values()} == {"stored", "new"}  # the first run's verdicts are a day old
    assert run(responses.filter("false"), "e", 2) == {}


def test_filter_has_no_false_no(spark):
    keys = spark.range(500).selectExpr("CAST(id % 3 AS INT) AS status", "CAST(id AS STRING) AS key")
    for bits in (1 << 10, 1 << 20):
        bloom = key_filter(keys, bits)
        asked = keys.unionByName(spark.range(10_000, 12_000).selectExpr("1 AS status", "CAST(id AS STRING) AS key"))
        got = maybe_among(asked, bloom, bits)
        assert got.join(keys, ["status", "key"]).filter("NOT maybe").count() == 0
        wrong = got.join(keys, ["status", "key"], "left_anti").filter("maybe").count()
        assert wrong < (1200 if bits == 1 << 10 else 10)
