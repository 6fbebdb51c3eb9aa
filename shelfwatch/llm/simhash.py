"""SimHash near-duplicates through Golay-code keys.

A 64-bit fingerprint has three segments (22, 21, 21 bits). With at most two differing bits one segment is
free of errors, and the one after it has at most two. A segment is a 23-bit word of the binary Golay code
(perfect, radius 3); the codewords to which it and its one-bit neighbours decode, six at most, are its
indices, and two words two bits apart share one, since a word between them decodes alike for both. A key is
(segment number, its bits, an index of the next segment). Equal keys are candidates, verified bit by bit.

Keys with few fingerprints are joined in pairs. Those of crowded keys, where pairs would grow with the
square, are linked exactly another way: each is spread to itself and its 64 one-bit neighbours, and all that
meet at one word, 65 at most, are within two bits of each other, so a star links them.

Defined results: NULL and empty texts have fingerprint zero and are linked like any other; equal
fingerprints are one node; a NULL id never names a component unless all its ids are NULL (then it is NULL).
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import saved, text_key, text_of
from shelfwatch.llm.components import components

BITS = 2
SHINGLE = 3
SEED = 42
CROWD = 24  # fingerprints of a key, beyond which they are linked by neighbours instead of in pairs
GENERATOR = 0b110001110101  # fixed value: the code's generator polynomial
SEGMENTS = [(0, 22), (22, 21), (43, 21)]  # first bit, bits


def fingerprint(text: bytes) -> int:
    """A-Z lowered, words between ASCII white space, shingles with repeats; bit set in over half of them."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :], strict=False)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):  # bounded memory for very long texts
        part = hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key, fp (the 64 bits as a long)."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t) for t in batch["text"].cast(pa.binary()).to_pylist()]
            yield pa.record_batch(
                [batch["doc_id"], batch["key"], pa.array(np.array(fps, np.uint64).astype(np.int64))], ["doc_id", "key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, fp long")


class Golay:
    """The (23, 12) code: decoding by syndrome, vectorised."""

    def __init__(self):
        single = []
        for bit in range(23):
            rest = 1 << bit
            for i in range(22, 10, -1):
                if rest >> i & 1:
                    rest ^= GENERATOR << (i - 11)
            single.append(rest)
        self.tables = []
        for at in (0, 8, 16):
            table = np.zeros(256, np.int64)
            for byte in range(256):
                for bit in range(8):
                    if byte >> bit & 1 and at + bit < 23:
                        table[byte] ^= single[at + bit]
            self.tables.append(table)
        self.errors = np.zeros(2048, np.int64)
        words = [0] + [1 << a for a in range(23)] + [1 << a | 1 << b for a in range(23) for b in range(a)]
        words += [1 << a | 1 << b | 1 << c for a in range(23) for b in range(a) for c in range(b)]
        words = np.array(words, np.int64)
        self.errors[self.syndrome(words)] = words

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        a, b, c = self.tables
        return a[words & 255] ^ b[words >> 8 & 255] ^ c[words >> 16 & 255]

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.errors[self.syndrome(words)]) >> 11


def golay_keys(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the different keys of each fingerprint."""
    words = fps.astype(np.uint64)
    parts = [((words >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        j = (i + 1) % 3
        near = np.stack([code.index(parts[j])] + [code.index(parts[j] ^ (1 << b)) for b in range(SEGMENTS[j][1])], axis=1)
        near.sort(axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        row, _ = np.nonzero(new)
        rows.append(row)
        keys.append((np.int64(i) << 34) | (parts[i][row] << 12) | near[new])
    return np.concatenate(rows), np.concatenate(keys)


def keyed(nodes: DataFrame) -> DataFrame:
    """key, fp."""

    def run(batches):
        code = Golay()
        for batch in batches:
            fps = batch["fp"].to_numpy()
            rows, keys = golay_keys(fps, code)
            yield pa.record_batch([pa.array(keys), pa.array(fps[rows])], ["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def near_links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of different fingerprints within two bits."""
    keys = saved(keyed(nodes), "golay-keys")
    groups = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    groups = saved(groups, "golay-groups")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS
    twos = groups.filter("n = 2").select("a", "b").filter(near)
    some = keys.join(groups.filter(f"n > 2 AND n <= {crowd}").select("key"), "key")
    pairs = some.select("key", F.col("fp").alias("a")).join(some.select("key", F.col("fp").alias("b")), "key").filter("a < b").filter(near)
    crowded = keys.join(groups.filter(f"n > {crowd}").select("key"), "key").select("fp").distinct()
    around = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    stars = (
        crowded.select("fp", F.explode(around).alias("word"))
        .groupBy("word").agg(F.collect_list("fp").alias("fps"))  # 65 at most
        .filter("size(fps) > 1")
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    )
    return twos.unionByName(pairs.select("a", "b")).unionByName(stars)


def clustered(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, key, fp, component_id. The fingerprints are written once; texts are read once."""
    own = saved(fingerprints(docs), "fingerprints")
    nodes = saved(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    roots = components(near_links(nodes, crowd))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "key", "fp", "root", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return clustered(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
