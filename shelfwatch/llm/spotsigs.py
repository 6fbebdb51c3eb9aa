"""Document fingerprints by spot signatures.

A common word (the anchor) followed by a chain of content words is a spot; the hashed spots of a text are
its set of signatures, and the sorted set is its fingerprint. Likeness is the Jaccard share of two sets; a
pair whose set lengths alone rule the threshold out is not compared. Near-duplicates are found by a join on
rare signatures within length partitions.

Defined results: NULL texts are empty; a text without any spot has one signature, the hash of its whole
word sequence, so equal texts are always alike and no set is empty; an empty table gives no rows. With one
document, the next one is itself. A very long text has a long set; sets are gone through element by element.
"""

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.llm.common import saved, small, steps, text_of, words_of
from shelfwatch.llm.components import components
from shelfwatch.llm.nearcopies import LEADERS, across

# Common words of English, French, German and Spanish.
ANCHORS = """
the of and to a in is that it for was on with as be by this are at from or an not have has but they he she his her
de la le et les des en un du une que pour est par qui dans avec sur pas au ce il ne se plus
der die und den von zu das mit sich auf für ist im nicht dem ein eine als auch es an werden aus er hat
el y los del las por con no su una para al lo como más pero sus o este sí porque
""".split()
CHAIN = 2  # content words after an anchor
NOT_WORD = "[^\\p{L}\\p{N}]+"
BLOCK = 1024  # groups of rows without an id
RANGES_PER_PARTITION = 2  # ranges of ids for each shuffle partition
SAMPLED = 64  # rows sampled for the bounds of a range
COUNTERS = 1 << 16  # places of the table of signature counts
CROWD = 1  # sets outside the largest group at a signature, for each signature of a set there, beyond which differences are compared
TURNS = 3  # rounds, the last of which compares all that still meet
HUB_SHARDS = 8  # shards of a hub's members


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted set of spot hashes. Linear in the text: content words are found once, then looked up."""

    def of(words: Column) -> Column:
        common = sorted(set(ANCHORS))
        content = F.filter(steps(F.size(words)), lambda i: ~F.get(words, i).isin(common))

        def spot(places: Column, j: Column, at: Column) -> Column:
            before = F.get(words, at - 1)
            chained = [F.get(words, F.get(places, j + k)) for k in range(1, chain)]
            whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in chained], F.lit(True))
            # The word before is an anchor if the content word before this one is not it.
            anchored = (at > 0) & ((j == 0) | (F.get(places, j - 1) < at - 1))
            return F.when(anchored & whole, F.xxhash64(before, F.get(words, at), *chained))

        def sets(places: Column) -> Column:
            spots = F.array_compact(F.transform(places, lambda at, j: spot(places, j, at)))
            return F.when(F.size(spots) > 0, F.array_sort(F.array_distinct(spots))).otherwise(F.array(F.xxhash64(words)))

        return _let(content, sets)

    return _let(words_of(F.lower(text), NOT_WORD), of)


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once: a one-element array's transform."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.hex(s))), ",")


def likeness(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard share of two sets; 0 without a comparison where the lengths rule the threshold out."""
    shortest, longest = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    share = common / (F.size(a) + F.size(b) - common)
    return F.when(shortest < F.lit(threshold) * longest, F.lit(0.0)).otherwise(share)


def _bounds(keys: DataFrame) -> list[tuple]:
    """(doc_id, hash) at the edges of ranges of about equal row count, out of a sample of SAMPLED rows a range."""
    ranges = RANGES_PER_PARTITION * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = SAMPLED * ranges / max(1, keys.count())
    some = keys if share >= 1 else keys.sample(share, 7)
    own = sorted((r["doc_id"], r["hash"]) for r in some.collect())
    step = max(1, len(own) // ranges)
    return sorted(set(own[step::step]))


def _listed(rows: list[tuple]) -> Column:
    """A fixed list of (doc_id, hash) as an array literal."""
    return F.from_json(F.lit(json.dumps([{"doc_id": i, "hash": h} for i, h in rows])), "array<struct<doc_id:bigint,hash:bigint>>")


def _range_of(key: Column, bounds: list[tuple]) -> Column:
    """How many bounds are at or below the key, by a search in two steps."""
    width = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    below = lambda rows: F.size(F.filter(rows, lambda b: b <= key))
    inner = F.array(*[_listed(g) for g in groups]) if groups else F.array(_listed([]))
    at = below(_listed([g[0] for g in groups]))
    return F.when(at == 0, 0).otherwise((at - 1) * width + below(F.get(inner, at - 1)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by ascending doc_id, after the last the first.

    Texts are shuffled once, into ranges of about equal row count by (doc_id, text hash), however the ids are spread. The
    first row of every range also goes to the range before it as a guest, so there is one guest a range. Rows of one id
    follow each other by text hash; rows without an id come in one group per text hash remainder.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("hash", F.xxhash64("text"))
    keys = own.filter("doc_id IS NOT NULL").select("doc_id", "hash")
    bounds = _bounds(keys)
    key = F.struct("doc_id", "hash")
    firsts = keys.groupBy(_range_of(key, bounds).alias("b")).agg(F.min(key).alias("first")).orderBy("b").collect()  # one row a range
    following = [(r["b"], *firsts[(n + 1) % len(firsts)]["first"]) for n, r in enumerate(firsts)]
    starts = F.from_json(F.lit(json.dumps([{"_b": b, "_id": i, "_hash": h} for b, i, h in following])), "array<struct<_b:int,_id:bigint,_hash:bigint>>")
    starts = F.broadcast(docs.sparkSession.range(1).select(F.inline(starts)))
    guest = own.join(starts, (F.col("doc_id") == F.col("_id")) & (F.col("hash") == F.col("_hash"))).select("_b", "doc_id", "hash", "text", F.lit(True).alias("_guest"))
    block = F.when(F.col("doc_id").isNull(), F.lit(-1) - F.pmod("hash", F.lit(BLOCK)).cast("int")).otherwise(_range_of(key, bounds))
    rows = own.select(block.alias("_b"), "doc_id", "hash", "text", F.lit(False).alias("_guest"))
    window = Window.partitionBy("_b").orderBy("_guest", F.col("doc_id").asc_nulls_first(), "hash")
    every = rows.unionByName(guest).withColumn("next_text", F.lead("text").over(window))
    return every.filter("NOT _guest").select("doc_id", "text", F.coalesce("next_text", "text").alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many of the following text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def with_edit(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, with their likenesses; near_class is the smallest doc_id that likeness reaches."""
    pairs = with_next(docs).select("doc_id", "text", "next_text", edited(F.col("text"), F.col("next_text")).alias("changed"))
    sets = pairs.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"),
        signatures(F.col("text")).alias("a"), signatures(F.col("changed")).alias("b"), signatures(F.col("next_text")).alias("c"),
    )
    rows = saved(sets.select(
        "doc_id", "n_chars", "edited_sha256", F.xxhash64("a").alias("fp"), F.col("a").alias("sigs"), F.col("b").alias("edited_sigs"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    ), "signature-sets")
    linked = saved(near_classes(rows.select("fp", "sigs")), "signature-classes")
    ids = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    placed = ids.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("first").alias("near_class")), "root").select(F.col("fp").alias("named_fp"), "near_class")
    return rows.join(named, F.col("fp") == F.col("named_fp")).select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        "near_edited", "near_next", "near_class")


def classes(docs: DataFrame) -> DataFrame:
    """fp, sigs, doc_id, docs: one row per different set, with its smallest id and its number of documents."""
    sets = docs.select("doc_id", signatures(text_of()).alias("sigs"))
    return sets.groupBy("sigs").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("docs")).select(F.xxhash64("sigs").alias("fp"), "*")


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """a, b, likeness: pairs of class representatives (hashes of their sets) at or above the threshold."""
    return near_sets(saved(docs.select(signatures(text_of()).alias("sigs")).select(F.xxhash64("sigs").alias("fp"), "sigs"), "signature-sets"), threshold)


def near_sets(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """a, b, likeness: the pairs of different sets (fp, sigs) alike by the threshold. Repeated sets count once; pass a written table.

    Every pair is a row, so of many sets alike there are many: `near_classes` groups them without.
    """
    early = early_signatures(rows, threshold)
    return _compared(_meeting(early, early, threshold), rows, threshold)


def early_signatures(rows: DataFrame, threshold: float) -> DataFrame:
    """fp, n, key, room, part, d: the signatures by which sets alike by the threshold meet; only those that several sets have.

    All sets are put in one order, rare signatures first by counts in a table of fixed size. Sets alike by t have their first
    common signature among the first size - ceil(t * size) + 1 of both, and so early that what is left of each
    from there on (room) can hold all they must share. Their lengths differ by no more than the factor t, so they lie in the
    same or the next length partition (part; bounds grow by 1 / t). Here d, the size of the list, is the set's own, n.
    """
    n = F.size("sigs")
    first = n - F.ceil(F.lit(threshold) * n - 1e-9).cast("int") + 1
    return _early(rows.select("fp", n.alias("n"), "sigs", first.alias("first")), lambda s: s, ["fp", "n"], threshold).withColumn("d", F.col("n"))


def _early(lists: DataFrame, named, kept: list[str], threshold: float) -> DataFrame:
    """`kept`, key, room, part: of each list (sigs) the `first` rarest, each with the key it is `named` by; only keys in several rows."""
    place = lambda s: F.pmod(named(s), F.lit(COUNTERS)).cast("int")
    spread = lists.select("*", F.explode("sigs").alias("sig")).groupBy(place(F.col("sig")).alias("at")).agg(F.count("*").alias("n"))
    counts = [0] * COUNTERS
    for r in spread.collect():  # COUNTERS rows at most
        counts[r["at"]] = r["n"]
    table = F.from_json(F.lit(json.dumps(counts)), "array<bigint>")
    ordered = F.array_sort(F.transform("sigs", lambda s: F.struct(F.get(table, place(s)).alias("of"), s.alias("sig"))))
    part = F.floor(F.log("n") / F.lit(-1.0) / F.log(F.lit(threshold)) + 1e-9).cast("int")
    early = lists.withColumn("many", F.size("sigs")).select("*", F.posexplode(F.slice(ordered, F.lit(1), F.col("first"))).alias("r", "s"))
    early = early.select(*kept, named(F.col("s.sig")).alias("key"), (F.col("many") - F.col("r")).alias("room")).distinct()
    # Most rare signatures belong to one set alone.
    shared = early.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1").select("key")
    return saved(early.join(shared, "key", "left_semi").withColumn("part", part), "early-signatures")


def _meeting(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """a, b: sets that meet early enough at a signature, of lengths that fit; of different roots where rows have one.

    Two sets are alike by t if no more than (1 - t) / (1 + t) of their lengths' sum is in one of them alone. So their lists, of
    d signatures each, must share half of what d adds up to beyond that; lists are the sets or how they differ from a third one.
    """
    x = left.alias("x")
    y = right.withColumn("part", F.explode(F.array(F.col("part") - 1, "part", F.col("part") + 1))).alias("y")
    fits = F.least("x.n", "y.n") >= F.lit(threshold) * F.greatest("x.n", "y.n") - 1e-9
    least = (F.col("x.d") + F.col("y.d") - F.lit((1 - threshold) / (1 + threshold)) * (F.col("x.n") + F.col("y.n"))) / 2 - 1e-9
    other = F.col("x.root") != F.col("y.root") if "root" in left.columns else F.col("x.fp") != F.col("y.fp")
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & other & fits & (F.least("x.room", "y.room") >= least)
    return saved(x.join(y, on).select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct(), "signature-pairs")


def _sets_of(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """fp, sigs of the `wanted` sets."""
    return rows.join(small(wanted), F.col("fp") == F.col("wanted"), "left_semi").groupBy("fp").agg(F.first("sigs").alias("sigs"))


def _compared(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct(), rows)
    compared = pairs.join(sets.select(F.col("fp").alias("a"), F.col("sigs").alias("sa")), "a").join(
        sets.select(F.col("fp").alias("b"), F.col("sigs").alias("sb")), "b")
    return compared.select("a", "b", likeness(F.col("sa"), F.col("sb"), threshold - 1e-9).alias("likeness")).filter(F.col("likeness") >= F.lit(threshold) - 1e-9)


def _differences(members: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """hub, fp, root, n, d, first, over, sigs: of members (hub, fp, root) the signatures in which a set differs from those that over half of its hub's members have."""
    members = saved(members, "crowd-members")
    own = saved(members.join(_sets_of(members.select(F.col("fp").alias("wanted")).distinct(), rows), "fp"), "crowd-sets")
    half = own.groupBy("hub").agg((F.count("*") / 2).alias("half"))
    held = own.select("hub", F.explode("sigs").alias("sig")).groupBy("hub", "sig").agg(F.count("*").alias("many")).join(half, "hub").filter("many > half")
    # A hub stands in several shards, as one may have very many members.
    middle = held.groupBy("hub").agg(F.collect_list("sig").alias("middle")).select("hub", "middle", F.explode(steps(F.lit(HUB_SHARDS))).alias("shard"))
    both = own.withColumn("shard", F.pmod(F.xxhash64("fp"), F.lit(HUB_SHARDS)).cast("int")).join(middle, ["hub", "shard"], "left")
    n, middle = F.size("sigs"), F.coalesce("middle", F.array().cast("array<bigint>"))
    differs = F.concat(F.array_except("sigs", middle), F.array_except(middle, "sigs"))
    first = F.floor(F.lit((1 - threshold) / threshold) * n + 1e-9).cast("int") + 1
    over = F.size(differs) - F.lit((1 - threshold) / (1 + threshold)) * n
    return saved(both.select("hub", "fp", "root", n.alias("n"), F.size(differs).alias("d"), first.alias("first"), over.alias("over"), differs.alias("sigs")), "set-differences")


def _group_links(open_rows: DataFrame, rows: DataFrame, threshold: float, crowd: float) -> DataFrame:
    """a, b: links by which all alike sets that meet in the open rows (of `across`) hang together.

    Keys are compared in pairs where these are no more than the signatures of their members. Members of others meet anew by their differences from the signatures that most
    of them have; keys with one hub, a member of the largest group, are taken together. A set's difference is d
    signatures, its length n, and over = d - n * (1 - t) / (1 + t). Alike sets share at least half the sum of their overs of their
    differences. Where that sum is 0 or less, the two are alike, and both to the member of least over too, which links them.
    All others share a difference, and one among the (1 - t) / t * n + 1 rarest of each, as the d of alike sets are no more
    than the sets' difference apart. Sets that have most signatures in common thus meet only where they also lack, or add,
    the same; where these are many again, they are taken apart once more.
    """
    found = []
    for turn in range(TURNS):
        every = saved(open_rows, "open-signatures")
        hub = F.min(F.struct(F.col("root") != F.col("most"), F.xxhash64("fp"), F.col("fp"))).alias("h")
        crowds = every.groupBy("key").agg(F.count_if(F.col("root") != F.col("most")).alias("many"), F.avg("n").alias("n"), hub).filter(F.col("many") > F.lit(crowd) * F.col("n"))
        crowds = saved(crowds.select("key", F.col("h.fp").alias("hub")), "signature-crowds")
        last = turn == TURNS - 1 or crowds.isEmpty()
        rest = every.filter("root <> most")
        found.append(_meeting(rest if last else rest.join(crowds, "key", "left_anti"), every, threshold))
        if last:
            break
        apart = _differences(every.join(crowds, "key").select("hub", "fp", "root").distinct(), rows, threshold)
        least = apart.groupBy("hub").agg(F.min(F.struct("over", "fp")).alias("l"))
        near = apart.join(small(least), "hub").filter(F.col("over") + F.col("l.over") <= 1e-9).filter(F.col("fp") != F.col("l.fp"))
        found.append(near.select(F.least("fp", "l.fp").alias("a"), F.greatest("fp", "l.fp").alias("b")))
        open_rows = across(_early(apart, lambda s: F.xxhash64("hub", s), ["fp", "n", "d", "root"], threshold))[0]
    return _compared(saved(reduce(DataFrame.unionByName, found).distinct(), "signature-pairs"), rows, threshold).select("a", "b")


def near_classes(rows: DataFrame, threshold: float = 0.8, crowd: float = CROWD) -> DataFrame:
    """node, root: sets (fp) that hang together by likeness, each with the smallest fp it reaches; sets without a link are left out.

    At every signature the sets meet a few leaders first. Only where several groups are left are their other
    members compared, across groups and with the largest one as the second side alone; where they are a crowd they
    meet by their differences from one of them (`_group_links`), so many sets that are nearly alike cost about their number.
    """
    early = early_signatures(rows, threshold)
    lead = [F.min(F.struct(F.xxhash64("fp", F.lit(i)), F.col("fp"), F.col("n"), F.col("d"), F.col("room"), F.col("part"))).alias(f"l{i}") for i in range(LEADERS)]
    leaders = early.groupBy("key", F.col("part").alias("_part")).agg(*lead).select("key", F.explode(F.array_distinct(F.array(
        *[F.struct(f"l{i}.fp", f"l{i}.n", f"l{i}.d", f"l{i}.part", f"l{i}.room") for i in range(LEADERS)]))).alias("l")).select("l.fp", "l.n", "l.d", "l.part", "key", "l.room")
    links = saved(_compared(_meeting(leaders, early, threshold), rows, threshold).select("a", "b"), "signature-links")
    roots = saved(components(links), "signature-roots")
    placed = saved(early.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "d", "part", "key", "room", F.coalesce("root", "fp").alias("root")), "placed-signatures")
    return components(links.unionByName(_group_links(across(placed)[0], rows, threshold, crowd)))
