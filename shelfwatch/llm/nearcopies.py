"""Near copies for the pipeline: groups of texts that share at least 0.8 of their five-word shingles.

Candidates agree in one of 25 bands of five minhashes, which two sets alike by 0.8 miss with odds of one in
20,000. Every candidate is then compared exactly, by the Jaccard share of its two shingle sets, in a join.

Bands with few members are compared in pairs. In crowded bands every member is first compared with a few
leaders, so a large group of near copies costs about its size. What is still in several groups there is joined
exactly by rare shingles: in one order of all shingles, rarest first (by counts in a table of fixed size), two sets alike by
LEAST have a first common shingle so early in both that the rest of each, from it on, can hold what they must
share. Only pairs that meet at such places are candidates. Texts that share most of their words but not enough meet late
and are no candidates at all, however many they are; no pair that is alike enough is missed.

Defined results: words, lower case and repeated rows as in `simhash`; a text under five words has one shingle,
so it is alike to equal texts alone; NULL and empty texts are equal.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.llm.common import saved, text_key, text_of, whole_rows
from shelfwatch.llm.components import components

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 25, 5
CROWD = 24  # members of a band, beyond which leaders are compared first
LEADERS = 4
COUNTERS = 1 << 18  # places of the table of shingle counts
SEED = 42
_odd = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS + SHINGLE, 2), np.uint64)
PLACES, FACTORS, SHIFTS = _odd[:SHINGLE, 0] * np.uint64(2) + np.uint64(1), _odd[SHINGLE:, :1] * np.uint64(2) + np.uint64(1), _odd[SHINGLE:, 1:]


def shingles(text: bytes) -> np.ndarray:
    """The sorted set of shingle hashes; never empty."""
    words = text.lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    many = len(words) - SHINGLE + 1
    out = np.zeros(many, np.uint64)
    for i in range(SHINGLE):
        out += hashes[i : i + many] * PLACES[i]
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    return np.unique(out)


def bands(shingle_set: np.ndarray) -> list[int]:
    """One key per band, as longs."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingle_set), 1024):  # bounded memory for very long texts
        least = np.minimum(least, (shingle_set[None, i : i + 1024] * FACTORS + SHIFTS).min(1))
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).astype(np.int64).tolist()


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key, node (names the shingle set), n (its size), bands."""

    def run(batches):
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for text in batch["text"].cast(pa.binary()):
                own = shingles(text.as_py())
                nodes.append(xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), SEED))
                sizes.append(len(own))
                keys.append(bands(own))
            yield pa.record_batch(
                [batch["doc_id"], batch["key"], pa.array(np.array(nodes, np.uint64).astype(np.int64)), pa.array(sizes, pa.int32()),
                 pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "key", "node", "n", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, node long, n int, bands array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = [shingles(t.as_py()).astype(np.int64) for t in batch["text"].cast(pa.binary())]
            yield pa.record_batch([batch["node"], pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return rows.mapInArrow(run, "node long, shingles array<long>")


def shingle_sets(wanted: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles of the `wanted` nodes, written. Only texts of these are read again."""
    at = nodes.join(wanted, "node").select("node", F.col("k.doc_id").alias("_id"), F.col("k.key").alias("_key"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), text_of().alias("text"))
    found = rows.join(at, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["key"] == F.col("_key"))).groupBy("node").agg(F.first("text").alias("text"))
    return saved(_sets(found.select("node", "text")), "shingle-sets")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are alike by LEAST."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("c"), (F.size("sa") + F.size("sb")).alias("n"))
    return common.filter(F.col("c") >= F.lit(LEAST) * (F.col("n") - F.col("c")) - 1e-9).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """As `compared`, with the sets of the pairs' nodes made first."""
    pairs = saved(pairs.select("a", "b").distinct(), "near-candidates")
    return compared(pairs, shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, nodes))


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often shingles fall on each of COUNTERS places: sums of one array a task."""

    def run(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            codes = batch["shingles"].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            counts += np.bincount((codes % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(counts[used])], ["at", "n"])

    counts = np.zeros(COUNTERS, np.int64)
    for r in sets.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    return counts


def rare_places(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """key, node, n, room: the rarest shingles of each set, and how many shingles of it stand from there on.

    Of n shingles, those up to place (1 - LEAST) * n: a set alike by LEAST shares at least LEAST * n.
    """
    send = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        counts = send.value
        for batch in batches:
            out = [[], [], [], []]
            for node, own in zip(batch["node"].to_pylist(), batch["shingles"], strict=True):
                codes = own.values.to_numpy(zero_copy_only=False)
                order = np.lexsort((codes, counts[(codes.view(np.uint64) % np.uint64(COUNTERS)).astype(np.int64)]))
                first = codes[order[: int((1 - LEAST) * len(codes) + 1e-9) + 1]]
                for column, values in zip(out, (first, np.full(len(first), node), np.full(len(first), len(codes)), len(codes) - np.arange(len(first))), strict=True):
                    column.append(values)
            if out[0]:
                key, nodes, n, room = (np.concatenate(c) for c in out)
                yield pa.record_batch([pa.array(key), pa.array(nodes), pa.array(n, pa.int32()), pa.array(room, pa.int32())], ["key", "node", "n", "room"])

    return sets.mapInArrow(run, "key long, node long, n int, room int")


def across(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (key, node, n, root) those of keys in several groups, beside the largest (most), and apart from them all but each key's largest group."""
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("many"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("many", "root")).alias("most"), F.count("*").alias("groups")).filter("groups > 1")
    open_rows = placed.join(largest.select("key", F.col("most.root").alias("most")), "key")
    return open_rows, open_rows.filter("root <> most")


def far_links(nodes_left: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between nodes (node, root) of different roots, by all pairs that meet at early enough rare shingles."""
    sets = shingle_sets(nodes_left.select("node"), docs, nodes)
    places = rare_places(sets, shingle_counts(sets)).join(nodes_left, "node")
    # The smaller of two sets must stand even earlier; which of them is smaller the pair decides.
    every, rest = across(saved(places, "rare-places"))
    x, y = rest.alias("x"), every.alias("y")
    share = F.lit(LEAST / (1 + LEAST)) * (F.col("x.n") + F.col("y.n")) - 1e-9
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & (F.least("x.room", "y.room") >= share)
    pairs = x.join(y, on).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return compared(saved(pairs.distinct(), "near-candidates"), sets)


def _paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of different members of one band whose sizes allow LEAST."""
    x, y = left.alias("x"), right.alias("y")
    fits = F.least("x.n", "y.n") >= F.lit(LEAST) * F.greatest("x.n", "y.n") - 1e-9
    on = (F.col("x.key") == F.col("y.key")) & fits & (F.col("x.node") != F.col("y.node"))
    return x.join(y, on).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def clustered(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, key, root: rows of one root are one group of near copies."""
    own = saved(signed(docs), "shingle-bands")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    nodes = own.groupBy("node").agg(F.min(order).alias("k"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = saved(nodes, "shingle-nodes")
    keys = saved(nodes.select(F.explode("bands").alias("key"), "node", "n"), "band-keys")
    lead = [F.min(F.struct(F.xxhash64("node", F.lit(i)), F.col("node"), F.col("n"))).alias(f"l{i}") for i in range(LEADERS)]
    groups = saved(keys.groupBy("key").agg(F.count("*").alias("many"), *lead).filter("many > 1"), "band-groups")
    some = keys.join(groups.filter(F.col("many") <= crowd).select("key"), "key")
    full = saved(keys.join(groups.filter(F.col("many") > crowd).select("key"), "key"), "band-crowds")
    leaders = groups.filter(F.col("many") > crowd).select("key", F.explode(F.array_distinct(F.array(*[F.struct(f"l{i}.node", f"l{i}.n") for i in range(LEADERS)]))).alias("l"))
    leaders = leaders.select("key", "l.node", "l.n")
    links = saved(verified(_paired(some, some).filter("a < b").unionByName(_paired(leaders, full)), docs, nodes), "near-links")
    roots = saved(components(links), "near-roots")
    # Bands whose members are still in several groups.
    placed = full.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    left = saved(across(placed)[0].select("node", "root").distinct(), "near-left")
    more = far_links(left, docs, nodes)
    roots = components(links.unionByName(more))
    rooted = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return own.select("doc_id", "key", "node").join(rooted, "node").select("doc_id", "key", "root")


def survivors(docs: DataFrame) -> DataFrame:
    """One row of each group, with all columns of `docs`: its smallest id, then its smallest text hash."""
    groups = clustered(docs)
    # The aggregate combines before the shuffle, so a group of a third of all rows is no load.
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    kept = groups.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("_kept_id"), F.col("k.key").alias("_kept_key"))
    rows = whole_rows(docs)
    same = rows["_id"].eqNullSafe(F.col("_kept_id")) & (rows["_key"] == F.col("_kept_key"))
    nth = F.row_number().over(Window.partitionBy("_kept_id", "_kept_key").orderBy("_key"))
    return rows.join(kept, same).withColumn("_nth", nth).filter("_nth = 1").select("_doc.*")
