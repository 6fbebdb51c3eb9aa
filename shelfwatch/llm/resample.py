"""Draws the documents most like a target: hashed n-gram weights, noise by id, an exact distributed top share.

Weights: all runs of 1 to 3 words fall into BUCKETS buckets by crc32; a bucket's gain compares its share in the target with
its share in the documents, and a document's weight is the sum over its runs. Counts are arrays of fixed size per
task that Spark adds up. Checksums of runs come from those of their words, since the checksum of two joined texts
is one, shifted by the other's length, xor the other.

Selection: the exact cutoff key is found by weighted median of medians. Each partition gives the median of its
remaining keys and their number; the weighted median of these has at least about a quarter of all remaining keys
on either side, so counting one side discards a guaranteed share. What is left at last, COLLECT keys or four a
partition, is looked at as a whole. Winners alone are then sorted, in ranges, and numbered.

Defined results: NULL and empty texts have no runs and weight 0; texts under LEAST_WORDS words are weighed, never drawn. Every row
is a document of its own, repeated ones too; rows that tie in score and id follow a fixed row number. A NULL id hashes as an
empty one and comes after others. An empty target or empty documents count as zeros. Very long texts go
piece by piece, with the words that runs need across a cut.
"""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import free, saved, text_of
from shelfwatch.operators.timeline import RANGE, in_ranges

BUCKETS = 10_000
LONGEST = 3  # words of a run
LEAST_WORDS = 20
SHARE = 5  # of 100 documents
SEED = 42
COLLECT = 65_536  # keys the driver looks at, at the end of the selection
CHUNK = 300_000  # words at once
KNOWN = 400_000  # words remembered per Python worker
SHIFTS = 64  # text lengths with a table of their own
KEY = ["neg", "nul", "id", "tie"]

_WORDS = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def _shift_tables() -> np.ndarray:
    """tables[n, k, b]: the checksum register with byte b at place k after n zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    out = np.zeros((SHIFTS + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(SHIFTS):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ byte[out[n] & np.uint32(255)]
    return out


class Buckets:
    """Buckets of all runs of words in texts; remembers words with their checksums."""

    def __init__(self):
        self.tables = _shift_tables()
        self.forget()

    def forget(self) -> None:
        known = self

        class Ids(dict):
            def __missing__(self, word):
                known.words.append(word)
                known.facts.append((zlib.crc32(word), zlib.crc32(b" " + word), len(word) + 1))
                self[word] = len(self)
                return self[word]

        self.ids, self.words, self.facts, self.table = Ids(), [], [], np.zeros((0, 3), np.int64)

    def _joined(self, left: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Checksums of texts with checksums `left`, a blank and a word. Words of SHIFTS bytes or more are the caller's."""
        fact = self.table[word]
        n = np.minimum(fact[:, 2], SHIFTS)
        out = fact[:, 1].astype(np.uint32)
        for k in range(4):
            out ^= self.tables[n, k, (left >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def of(self, texts: list[bytes]):
        """Yields (first text, texts, row of each run among them, bucket of each run); adds n_words to self.n_words."""
        self.n_words = np.zeros(len(texts), np.int64)
        held, rows, own, many, first = [], [], [], 0, 0
        for row, text in enumerate(texts):
            words = text.translate(_WORDS).split()
            self.n_words[row] = len(words)
            for at in range(0, len(words), CHUNK):
                part = words[at : at + CHUNK + LONGEST - 1]
                if len(self.ids) > KNOWN:
                    if held:
                        yield self._runs(held, rows, own)
                        held, rows, own, many = [], [], [], 0
                    self.forget()
                held.append(np.fromiter(map(self.ids.__getitem__, part), np.int64, len(part)))
                rows.append(np.full(len(part), row))
                own.append(np.arange(len(part)) < CHUNK)
                many += len(part)
                if many >= CHUNK:
                    yield self._runs(held, rows, own)
                    held, rows, own, many = [], [], [], 0
        if held:
            yield self._runs(held, rows, own)

    def _runs(self, held, rows, own) -> tuple[np.ndarray, np.ndarray]:
        if len(self.table) < len(self.facts):
            self.table = np.concatenate([self.table, np.array(self.facts[len(self.table) :], np.int64)])
        ids, row, own = np.concatenate(held), np.concatenate(rows), np.concatenate(own)
        run, sums = np.flatnonzero(own), self.table[ids, 0].astype(np.uint32)[own]
        out_rows, out = [row[run]], [sums]
        for n in range(1, LONGEST):
            inside = run + n < len(ids)
            inside[inside] = row[run[inside]] == row[run[inside] + n]
            run, sums = run[inside], sums[inside]
            sums = self._joined(sums, ids[run + n])
            for i in np.flatnonzero(self.table[ids[run + n], 2] > SHIFTS):  # long words: the whole run anew
                sums[i] = zlib.crc32(b" ".join(self.words[w] for w in ids[run[i] : run[i] + n + 1]))
            out_rows.append(row[run])
            out.append(sums)
        return np.concatenate(out_rows), np.concatenate(out).astype(np.int64) % BUCKETS


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Runs per bucket over all rows. Each task gives BUCKETS rows at most."""

    def run(batches):
        counts, buckets = np.zeros(BUCKETS, np.int64), Buckets()
        for batch in batches:
            for _, found in buckets.of(batch["text"].cast(pa.binary()).to_pylist()):
                counts += np.bincount(found, minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(counts[used])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    each = docs.select(text_of().alias("text")).mapInArrow(run, "bucket int, n long")
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, in thousandths of a natural logarithm."""
    s, t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and tie, a number of the row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        buckets, base, seen = Buckets(), TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            n, weight = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for rows, found in buckets.of(batch["text"].cast(pa.binary()).to_pylist()):
                n += np.bincount(rows, minlength=len(batch))
                weight += np.bincount(rows, gain[found], len(batch)).astype(np.int64)  # whole numbers below 2 ** 53
            score = weight + np.array([noise(i, seed) for i in batch["doc_id"].to_pylist()], np.int64)
            ties = base + seen + np.arange(len(batch))
            seen += len(batch)
            yield pa.record_batch([batch["doc_id"], *map(pa.array, (buckets.n_words, n, weight, score, ties))],
                                  ["doc_id", "n_words", "n_features", "weight", "score", "tie"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, weight long, score long, tie long")


def _key(values) -> Column:
    return F.struct(*[F.lit(int(v)).cast("int" if c == "nul" else "long").alias(c) for c, v in zip(KEY, values, strict=True)])


def cutoff(keys: DataFrame, k: int, collect: int = COLLECT) -> tuple | None:
    """The k-th smallest of different keys (columns KEY); None if there are fewer."""

    def medians(batches):
        held = [b for b in batches if len(b)]
        if held:
            own = np.stack([np.concatenate([b[c].to_numpy() for b in held]).astype(np.int64) for c in KEY])
            middle = own[:, np.lexsort(own[::-1])[(own.shape[1] - 1) // 2]]
            yield pa.record_batch([pa.array([own.shape[1]], pa.int64()), *[pa.array([v], pa.int64()) for v in middle]], ["n", *KEY])

    left, own = keys.select(*KEY), F.struct(*KEY)
    while True:
        each = left.mapInArrow(medians, "n long, " + ", ".join(f"{c} long" for c in KEY)).collect()  # one row a partition
        total = sum(r["n"] for r in each)
        if k < 1 or k > total:
            return None
        if total <= max(collect, 4 * len(each)):
            return sorted(tuple(r) for r in left.collect())[k - 1]
        below = 0
        for middle, n in sorted((tuple(r[c] for c in KEY), r["n"]) for r in each):
            below += n
            if 2 * below >= total:
                break
        side = own <= _key(middle)
        count = left.filter(side).count()
        # The first column alone lets the scan skip row groups.
        if k <= count:
            left = left.filter(side & (F.col(KEY[0]) <= middle[0]))
        else:
            left, k = left.filter(~side & (F.col(KEY[0]) >= middle[0])), k - count


def drawn(rows: DataFrame, least_words: int = LEAST_WORDS, share: int = SHARE, collect: int = COLLECT) -> DataFrame:
    """All rows and rank: 1, 2, 3... for the drawn ones, else NULL. `rows` is read several times: pass a written table."""
    keyed = rows.select("*", (-F.col("score")).alias("neg"), F.col("doc_id").isNull().cast("int").alias("nul"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"))
    able = keyed.filter(F.col("n_words") >= least_words)
    last = cutoff(able, able.count() * share // 100, collect)
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return keyed.select(*rows.columns, none)
    wins = (F.col("n_words") >= least_words) & (F.struct(*KEY) <= _key(last))
    dealt = in_ranges(keyed.filter(wins), KEY[:2], *KEY[2:])
    names, before, starts = rows.columns, 0, []
    for r in dealt.groupBy(RANGE).count().orderBy(RANGE).collect():  # one row a range
        starts.append((r[RANGE], before))
        before += r["count"]

    def numbered(batches):
        """Partitions hold whole ranges in order."""
        at, n, first = None, 0, dict(starts)
        for batch in batches:
            ranks = []
            for own in batch[RANGE].to_pylist():
                at, n = own, (n + 1 if own == at else 1)
                ranks.append(first[own] + n)
            yield pa.record_batch([*(batch[c] for c in names), pa.array(ranks, pa.int64())], [*names, "rank"])

    ordered = dealt.repartition(len(starts), RANGE).sortWithinPartitions(RANGE, *KEY)
    ranks = ordered.mapInArrow(numbered, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", rank long")
    return ranks.unionByName(keyed.filter(~wins).select(*rows.columns, none))


def resampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The documents whose id is drawn, with all their columns."""
    out = digest_rows(docs, target).filter(F.col("rank").isNotNull())
    ids = out.select(F.col("doc_id").alias(free("drawn_id", docs))).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids[ids.columns[0]]), "left_semi")


def digest_rows(docs: DataFrame, target: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text")
    return drawn(saved(weighed(rows, gains(bucket_counts(rows), bucket_counts(target))), "weights"))


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    return digest_rows(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
