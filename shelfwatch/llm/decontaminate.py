"""Benchmark decontamination by templates.

Numbers (in digits or words), the units after them and names (capitalised words, but for a fixed list of common words) become typed
placeholders that remember their values. Rolling windows of the remaining template are hashed and joined to the windows of the
benchmark's templates. On each diagonal (document place - item place) the placeholder values of both sides
must correspond one to one; then a question with other names and numbers is the same question. A document
holds an item if consistent diagonals cover enough of the item's windows. A second channel takes the plain
lowered words the same way, for copies in other case; the better channel counts.

Defined results: a very long text gives a row per window like any other, of its hash and place. NULL and empty texts and items have no windows; an item shorter than a window has one window
of its own length; a window of nearly only placeholders is no evidence unless the item has no other; repeated
rows are one document; items with one id, or without one, are one item's texts. An empty table on either side gives no rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import BROADCAST_ROWS, saved, small, text_of, whole_rows, words_of
from shelfwatch.llm.spotsigs import ANCHORS

WINDOW = 8
BROADCAST_BYTES = 32 << 20  # of the words of items' windows
LEAST_LITERAL = 4  # words of a window that are no placeholder
LEAST_SHARE = 0.25  # of an item's windows
# Units that follow a number.
UNITS = ("kg|g|mg|lb|lbs|km|cm|mm|m|mi|mile|miles|meter|meters|metre|metres|foot|feet|inch|inches|hour|hours|hr|minute|minutes|min|"
         "second|seconds|day|days|week|weeks|month|months|year|years|dollar|dollars|cent|cents|euro|euros|percent|liter|liters|litre|litres|"
         "ml|mph|kmh|degrees")
# Words that are no names where a sentence begins with them, besides the anchors of `spotsigs`.
COMMON = ANCHORS + """
i we you me him them us my your our their its who whom whose what when where which why how if then than there these those each every
all both some any many much more most no none only just also so because although though while since until after before during between
about over under into out up down were been had did do does can could will would should may might must one two three four five six
seven eight nine ten first second third next last finally later now today yesterday tomorrow suppose find calculate compute
determine let given assume consider say says said
""".split()
# Numbers in words, alone or with a hyphen (twenty-five).
NUMBER_WORDS = ("(?:(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)(?:-(?:one|two|three|four|five|six|seven|eight|nine))?"
                "|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|hundred|thousand|dozen)")
MARK = "\u0001"
JOIN = "\u0002"  # stands for a point or comma between digits, so that 1,200 is one number
NAME, NUMBER, UNIT = MARK + "n", MARK + "d", MARK + "u"


def tokens(text: Column) -> Column:
    """Lowered words in order; a placeholder is its mark followed by its value."""
    bare = F.regexp_replace(F.translate(text, MARK + JOIN, "  "), r"(?<=\d)[.,](?=\d)", JOIN)
    common = "|".join(sorted(set(COMMON)))
    names = F.regexp_replace(bare, rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?!(?iu:{common})(?![\p{{L}}\p{{N}}]))\p{{Lu}}\p{{L}}*", f" {NAME}$0")
    numbers = F.regexp_replace(names, rf"(\d[\d\x02]*|(?<![\p{{L}}\p{{N}}\x01])(?i:{NUMBER_WORDS})(?![\p{{L}}\p{{N}}]))(?:\s?((?i:{UNITS})\b|[%$€£]))?", f" {NUMBER}$1 {UNIT}$2 ")
    return words_of(F.lower(numbers), r"[^\p{L}\p{N}\x01\x02%$€£]+")


def plain(text: Column) -> Column:
    """Lowered words in order, without placeholders."""
    return words_of(F.lower(F.translate(text, MARK, " ")), r"[^\p{L}\p{N}]+")


def _hashes(words: Column, channel: int) -> Column:
    """A hash per word, different for each channel; a placeholder's is that of its kind."""
    kind = lambda w: F.when(F.startswith(w, F.lit(MARK)), F.substring(w, 1, 2)).otherwise(w)
    return F.transform(words, lambda w: F.xxhash64(kind(w) if channel == 0 else w, F.lit(channel)))


def _is_slot(w: Column) -> Column:
    return F.startswith(w, F.lit(MARK))


def with_windows(rows: DataFrame, name: str, sizes: list[int]) -> DataFrame:
    """Adds name_s, the hashes of all windows of s words, for each of `sizes`, out of the word hashes in name_1.

    A window's hash comes from those of its first half and its rest, so each size is one pass over arrays that
    are there already, whatever the text's length.
    """
    needed = set(sizes)
    for s in range(max(sizes, default=1), 1, -1):
        if s in needed:
            needed |= {_half(s), s - _half(s)}
    for s in sorted(needed - {1}):
        half, count = _half(s), F.greatest(F.size(f"{name}_1") - (s - 1), F.lit(0))
        first, rest = F.slice(f"{name}_{half}", 1, count), F.slice(f"{name}_{s - half}", F.lit(half + 1), count)
        rows = rows.withColumn(f"{name}_{s}", F.zip_with(first, rest, lambda a, b: F.xxhash64(a, b)))
    return rows


def _half(size: int) -> int:
    """The largest power of two below it."""
    return 1 << (size - 1).bit_length() - 1


def _channels() -> list[tuple[int, object]]:
    return [(0, tokens), (1, plain)]


def item_windows(items: DataFrame, window: int = WINDOW, channel: int = 0, words=tokens) -> DataFrame:
    """channel, size, hash, item_id, n_windows, place, item_words: the windows that are evidence."""
    rows = items.select("item_id", words(text_of()).alias("words")).filter(F.size("words") > 0)
    rows = rows.withColumn("size", F.least(F.size("words"), F.lit(window))).withColumn("h_1", _hashes(F.col("words"), channel))
    rows = with_windows(rows, "h", list(range(1, window + 1)))
    own = F.element_at(F.array(*[F.col(f"h_{s}") for s in range(1, window + 1)]), F.col("size"))
    each = rows.select("item_id", "words", "size", F.posexplode(own).alias("place", "hash"))
    each = each.withColumn("words", F.slice("words", F.col("place") + 1, F.col("size")))
    literal = F.size(F.filter("words", lambda w: ~_is_slot(w)))
    strong = each.withColumn("_strong", literal >= F.least(F.lit(LEAST_LITERAL), F.col("size")))
    # Items are short texts; their own windows are grouped by item.
    counts = strong.groupBy("item_id").agg(F.sum(F.col("_strong").cast("int")).alias("_strong_n"), F.count("*").alias("_all_n"))
    same = F.col("s.item_id").eqNullSafe(F.col("c.item_id"))
    kept = strong.alias("s").join(counts.alias("c"), same).filter("_strong OR _strong_n = 0")
    return kept.select(
        F.lit(channel).alias("channel"), "size", "hash", "s.item_id",
        F.when(F.col("_strong_n") > 0, F.col("_strong_n")).otherwise(F.col("_all_n")).alias("n_windows"), "place", F.col("words").alias("item_words"))


def _bounded(df: DataFrame) -> bool:
    """Few enough rows to be broadcast, and short enough words in them."""
    size = df.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("item_words", " "))).alias("bytes")).first()
    return size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES


def window_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per window of a document that is a window of an item, with the words of both.

    Texts are read in one pass for both channels: a row per window carries its hash and place alone, which meet the items' hashes.
    Only for documents with a hit are the words made again. The hashes are broadcast if items are counted to be few
    and short; else windows are shuffled by hash, and a hash that no item has ends there.
    """
    of_items = [item_windows(items, window, channel, words) for channel, words in _channels()]
    of_items = saved(of_items[0].unionByName(of_items[1]), "item-windows")
    few = _bounded(of_items)
    # Windows shorter than usual exist for the lengths of short items alone.
    sizes = sorted((r["channel"], r["size"]) for r in of_items.select("channel", "size").distinct().collect())  # twice `window` at most
    hashes = of_items.select("hash").distinct()
    own = docs.select("doc_id", text_of().alias("text"))
    made = own.select("doc_id", F.xxhash64("text").alias("_key"), *[_hashes(words(F.col("text")), c).alias(f"c{c}_1") for c, words in _channels()])
    for c, _ in _channels():
        made = with_windows(made, f"c{c}", [size for channel, size in sizes if channel == c])
    # All windows of a text stand in one array, one channel and size after another; no words lie beside what is exploded.
    arrays = [F.col(f"c{c}_{size}") for c, size in sizes]
    length = {f"_n{c}": F.size(f"c{c}_1") for c, _ in _channels()}
    rolled = made.select("doc_id", "_key", *[n.alias(k) for k, n in length.items()], F.posexplode(F.concat(F.array().cast("array<bigint>"), *arrays)).alias("at", "hash"))
    hit = saved(rolled.join(F.broadcast(hashes) if few else hashes, "hash", "left_semi"), "window-hits")
    held = hit.select(F.col("doc_id").alias("_hit_id"), F.col("_key").alias("_hit_key")).distinct()
    again = own.withColumn("_key", F.xxhash64("text"))
    again = again.join(small(held), again["doc_id"].eqNullSafe(F.col("_hit_id")) & (F.col("_key") == F.col("_hit_key")), "left_semi")
    again = again.dropDuplicates(["doc_id", "_key"]).select(F.col("doc_id").alias("_hit_id"), F.col("_key").alias("_hit_key"), *[words(F.col("text")).alias(f"w{c}") for c, words in _channels()])
    hit = hit.join(F.broadcast(of_items) if few else of_items, "hash")
    before, start = F.lit(0), F.lit(0)  # of the arrays that stand before an item's own
    for c, size in sizes:
        start = F.when((F.col("channel") == c) & (F.col("size") == size), before).otherwise(start)
        before = before + F.greatest(F.col(f"_n{c}") - (size - 1), F.lit(0))
    hit = hit.withColumn("at", F.col("at") - start)
    with_words = hit.join(again, hit["doc_id"].eqNullSafe(F.col("_hit_id")) & (F.col("_key") == F.col("_hit_key")))
    words = F.when(F.col("channel") == 0, F.col("w0")).otherwise(F.col("w1"))
    return with_words.select(
        "doc_id", "_key", "channel", "item_id", "n_windows", "place", "at", "item_words", F.slice(words, F.col("at") + 1, F.col("size")).alias("own_words"))


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, _key, item_id, coverage, exact: which document holds which item, by the channel that covers more."""
    hit = window_hits(docs, items, window)
    slots = F.filter(F.arrays_zip(F.col("item_words").alias("i"), F.col("own_words").alias("d")), lambda z: _is_slot(z["i"]))
    pairs = F.transform(slots, lambda z: F.struct(z["i"].alias("i"), z["d"].alias("d")))
    same = F.forall(F.arrays_zip(F.col("item_words").alias("i"), F.col("own_words").alias("d")), lambda z: z["i"].eqNullSafe(z["d"]))
    by = ["doc_id", "_key", "channel", "item_id", "n_windows"]
    # Groups are bounded by an item's length: places and values of one diagonal, as sets.
    lanes = hit.select(*by, "place", (F.col("at") - F.col("place")).alias("lane"), pairs.alias("pairs"), same.alias("same")).groupBy(*by, "lane").agg(
        F.collect_set("place").alias("places"), F.collect_set(F.when(F.col("same"), F.col("place"))).alias("same_places"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    count = lambda f: F.size(F.array_distinct(F.transform("pairs", lambda p: p[f])))
    consistent = (count("i") == F.size("pairs")) & (count("d") == F.size("pairs"))
    # Where values clash, only the windows equal word for word count.
    lanes = lanes.withColumn("good", F.when(consistent, F.col("places")).otherwise(F.col("same_places")))
    whole = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    found = lanes.groupBy(*by).agg(whole("good").alias("covered"), whole("same_places").alias("literal"))
    found = found.filter((F.col("covered") > 0) & (F.col("covered") >= share * F.col("n_windows"))).select(
        "doc_id", "_key", "item_id", (F.col("covered") / F.col("n_windows")).alias("coverage"), (F.col("literal") == F.col("covered")).alias("exact"))
    best = found.groupBy("doc_id", "_key", "item_id").agg(F.max(F.struct("coverage", "exact")).alias("best"))
    return best.select("doc_id", "_key", "item_id", "best.coverage", "best.exact")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(docs, items).select("doc_id", "item_id", "coverage", "exact")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    gone = leaks(docs, items).select(F.col("doc_id").alias("_gone_id"), F.col("_key").alias("_gone_key")).distinct()
    rows = whole_rows(docs)
    same = F.col("_doc.doc_id").eqNullSafe(F.col("_gone_id")) & (F.col("_key") == F.col("_gone_key"))
    return rows.join(small(gone), same, "left_anti").select("_doc.*")
