"""Line dedup by winnowing.

A gram starts at every line and takes following lines until it holds GRAM_WORDS words. In each window of
grams that spans at most RUN_WORDS words (one gram at least) the smallest gram hash is selected, so every run
of whole lines with RUN_WORDS words or more has a selected gram, here and wherever it stands again. Each
selected gram is joined to its first place in the corpus, the match is extended line by line both ways, and
runs of at least RUN_WORDS words are deleted from the later place.

Two later places can have more in common with each other than with the first one. They do only if, on one side,
both matches stop after as many lines before equal lines. Such places are found by a hash of just that; the
shortest long runs around them are joined by their whole content to the first place of the same run. So exactly
the lines go that lie in a run of RUN_WORDS words or more that stands earlier too.

Places are ordered by doc_id (NULL last), text hash, line. A deleted line always has an equal earlier line, and
the first place of a line is never deleted. Lines are equal if they are so without white space at their ends;
they are compared by 64-bit hashes.

Defined results: NULL and empty texts have no run; rows with one id and one text are one document, which
does not repeat itself; of a document that repeats an earlier one whole, nothing is left. An empty table
gives an empty one.
"""

import struct
from bisect import bisect_left, bisect_right

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import saved, steps, text_key, text_of, whole_rows

GRAM_WORDS = 15
RUN_WORDS = 30
PART = 500  # rows that are Python objects at a time
# Run hashes are polynomials of the line hashes.
MODULUS, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687


def lines_of(text: str) -> tuple[list[int], list[int]]:
    """Hash (signed 64 bits) and number of words of each line."""
    hashes, words = [], []
    for line in text.split("\n"):
        hashes.append(xxhash.xxh3_64_intdigest(line.strip().encode()) - (1 << 63))
        words.append(len(line.split()))
    return hashes, words


def anchors(hashes: list[int], words: list[int], gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> list[tuple[int, int]]:
    """(gram hash, first line) of the selected grams."""
    n, ends, grams = len(hashes), [], []
    end = held = 0
    for i in range(n):  # two ends move forward over the lines
        while end < n and held < gram_words:
            held += words[end]
            end += 1
        if held < gram_words:
            break
        ends.append(end)
        grams.append(xxhash.xxh3_64_intdigest(b"".join(h.to_bytes(8, "little", signed=True) for h in hashes[i:end])) - (1 << 63))
        held -= words[i]
    before = [0]
    for w in words:
        before.append(before[-1] + w)
    chosen, queue, head, j = set(), [], 0, 0
    for i in range(len(grams)):
        while j < len(grams) and (j <= i or before[ends[j]] - before[i] <= run_words):
            while len(queue) > head and grams[queue[-1]] > grams[j]:
                queue.pop()
            queue.append(j)
            j += 1
        while queue[head] < i:
            head += 1
        chosen.add(queue[head])
    return [(grams[i], i) for i in sorted(chosen)]


LINES = "doc_id long, key long, hashes array<long>, words array<int>, grams array<long>, places array<int>"


def line_table(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("hashes", pa.list_(pa.int64())), ("words", pa.list_(pa.int32())),
                        ("grams", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part, out = batch.slice(at, PART), []
                for doc_id, key, text in zip(*(part[c].to_pylist() for c in ("doc_id", "key", "text")), strict=True):
                    hashes, words = lines_of(text)
                    chosen = anchors(hashes, words, gram_words, run_words)
                    out.append((doc_id, key, hashes, words, [g for g, _ in chosen], [p for _, p in chosen]))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), text_of().alias("text"))
    return rows.mapInArrow(run, LINES)


def long_runs(hashes: list[int], words: list[int], ats: list[int], run_words: int = RUN_WORDS) -> list[tuple[int, int, int]]:
    """(run hash, first line, last line) of the shortest long runs, from each line and up to each, that hold one of `ats`."""
    before, rolled, powers = [0], [0], [1]
    for h, w in zip(hashes, words, strict=True):
        before.append(before[-1] + w)
        rolled.append((rolled[-1] * BASE + h) % MODULUS)
        powers.append(powers[-1] * BASE % MODULUS)
    spans = {(s, bisect_left(before, before[s] + run_words)) for s in range(len(hashes))}
    spans |= {(bisect_right(before, before[e] - run_words) - 1, e) for e in range(1, len(before)) if before[e] >= run_words}
    ats = sorted(ats)
    return [((rolled[e] - rolled[s] * powers[e - s]) % MODULUS, s, e - 1) for s, e in sorted(spans)
            if e < len(before) and bisect_left(ats, s) < bisect_left(ats, e)]


FOUND = "doc_id long, key long, first int, last int, at int, left long, right long"
_FOUND = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
RUNS = "doc_id long, key long, run long, first int, last int"
_RUNS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _batch(rows: list[tuple], types: list[pa.DataType], ddl: str) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in ddl.split(", ")])


def _side(gram: int, side: int, extent: int, beyond: int) -> int:
    return xxhash.xxh3_64_intdigest(struct.pack("<qiiq", gram, side, extent, beyond)) - (1 << 63)


def _extended(r: dict, run_words: int) -> list[tuple]:
    """Rows of FOUND for the places of one diagonal: its long runs, and per place where and before what its match stops."""
    own, source, shift, out, last = r["own"], r["source"], r["shift"], [], -1
    for at, gram in sorted((p["at"], p["gram"]) for p in r["ats"]):
        if at > last:
            first, last = at, at - 1
            while first > max(0, shift) and own[first - 1] == source[first - 1 - shift]:
                first -= 1
            while last + 1 < min(len(own), len(source) + shift) and own[last + 1] == source[last + 1 - shift]:
                last += 1
            if sum(r["words"][first : last + 1]) >= run_words:
                out.append((r["doc_id"], r["key"], first, last, None, None, None))
        left = _side(gram, 0, at - first, own[first - 1]) if first > 0 else None
        right = _side(gram, 1, last - at, own[last + 1]) if last + 1 < len(own) else None
        if left is not None or right is not None:
            out.append((r["doc_id"], r["key"], None, None, at, left, right))
    return out


def _by_document(left: DataFrame, right: DataFrame, doc_id: str = "doc_id", key: str = "key") -> DataFrame:
    """Inner join of frames with the aliases d and o."""
    return left.alias("d").join(right.alias("o"), F.col(f"d.{doc_id}").eqNullSafe(F.col("o.doc_id")) & (F.col(f"d.{key}") == F.col("o.key")))


def repeated_runs(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, key, first, last: runs of lines (ends included) to delete, one row per match."""
    lines = saved(line_table(docs, gram_words, run_words), "lines")
    once = lines.dropDuplicates(["doc_id", "key"])
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key"), F.col("at"))
    grams = lines.select("doc_id", "key", F.inline(F.arrays_zip(F.col("grams").alias("gram"), F.col("places").alias("at"))))
    grams = grams.select("gram", place.alias("place"))
    # First places meet in a minimum, combined before the shuffle, and go back by a join that can be split.
    firsts = grams.groupBy("gram").agg(F.min("place").alias("source"), F.count("*").alias("n")).filter("n > 1").drop("n")
    matched = grams.join(firsts, "gram").filter("source < place")
    diagonals = matched.select(
        F.col("place.doc_id").alias("doc_id"), F.col("place.key").alias("key"), F.col("source.doc_id").alias("from_id"),
        F.col("source.key").alias("from_key"), F.struct(F.col("place.at").alias("at"), "gram").alias("at"),
        (F.col("place.at") - F.col("source.at")).alias("shift"),
    ).groupBy("doc_id", "key", "from_id", "from_key", "shift").agg(F.collect_set("at").alias("ats"))
    own = _by_document(diagonals, once.select("doc_id", "key", "hashes", "words")).select("d.*", F.col("o.hashes").alias("own"), "o.words")
    both = _by_document(own, once.select("doc_id", "key", "hashes"), "from_id", "from_key").select("d.*", F.col("o.hashes").alias("source"))

    def extend(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PART):
                out = [row for r in batch.slice(start, PART).to_pylist() for row in _extended(r, run_words)]
                if out:
                    yield _batch(out, _FOUND, FOUND)

    found = saved(both.select("doc_id", "key", "shift", "ats", "own", "words", "source").mapInArrow(extend, FOUND), "line-matches")
    more = _longer_elsewhere(found.filter("at IS NOT NULL"), once, run_words)
    return found.filter("at IS NULL").select("doc_id", "key", "first", "last").unionByName(more)


def _longer_elsewhere(places: DataFrame, once: DataFrame, run_words: int) -> DataFrame:
    """doc_id, key, first, last: long runs around places that agree with each other beyond their match with the first place."""
    sides = places.select("doc_id", "key", "at", F.explode(F.array("left", "right")).alias("side")).filter("side IS NOT NULL")
    shared = sides.groupBy("side").agg(F.count("*").alias("n")).filter("n > 1").select("side")
    open_places = sides.join(shared, "side").groupBy("doc_id", "key").agg(F.collect_set("at").alias("ats"))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PART):
                out = [(r["doc_id"], r["key"], *span) for r in batch.slice(start, PART).to_pylist()
                       for span in long_runs(r["hashes"], r["words"], r["ats"], run_words)]
                if out:
                    yield _batch(out, _RUNS, RUNS)

    around = _by_document(open_places, once.select("doc_id", "key", "hashes", "words")).select("d.doc_id", "d.key", "ats", "hashes", "words")
    runs = saved(around.mapInArrow(run, RUNS), "line-runs")
    runs = runs.withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", F.col("first").alias("at")))
    firsts = runs.groupBy("run").agg(F.min("place").alias("source"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return runs.join(firsts, "run").filter("source < place").select("doc_id", "key", "first", "last")


def marked(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """_doc (the row of `docs`), _lines (all), _gone (numbers of the lines to delete)."""
    runs = repeated_runs(docs, gram_words, run_words)
    gone = runs.groupBy(F.col("doc_id").alias("_gone_id"), F.col("key").alias("_gone_key")).agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last")))).alias("_gone"))
    rows = whole_rows(docs)
    same = rows["_id"].eqNullSafe(F.col("_gone_id")) & (F.col("_key") == F.col("_gone_key"))
    return rows.join(gone, same, "left").withColumn("_lines", F.split(text_of("_doc.text"), "\n")).select(
        "_doc", "_lines", F.coalesce("_gone", F.array().cast("array<int>")).alias("_gone"))


def _kept():
    left = F.array_except(steps(F.size("_lines")), "_gone")
    return F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its lines, how many went, and the text that is left."""
    return marked(docs.select("doc_id", "text")).select(
        "_doc.doc_id", F.size("_lines").alias("n_lines"), F.size("_gone").alias("n_deleted"), _kept().alias("text"))


def deduped(docs: DataFrame) -> DataFrame:
    """The documents with repeated runs deleted; those of which nothing is left go. n_chars follows the text."""
    cut = F.when(F.size("_gone") > 0, _kept()).otherwise(F.col("_doc.text"))
    rows = marked(docs).filter((F.size("_gone") == 0) | (F.trim(_kept()) != "")).withColumn("_text", cut)
    new = {"text": F.col("_text"), "n_chars": F.when(F.size("_gone") > 0, F.char_length("_text").cast("long")).otherwise(
        F.col("_doc.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[(new[c] if c in new else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])
