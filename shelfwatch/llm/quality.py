"""Quality scores: random-indexing word vectors, pooled, into a small calibrated network.

Words, marks and letter shapes of a text are hashed into BUCKETS fixed buckets, each with a fixed sparse
random index vector. The vector of a bucket is the sum of the index vectors of its neighbours over the whole
corpus: partial sums per partition, added up by Spark, a table of fixed size. A document is the mean and
spread of its vectors, its length and the share of different words. A two-layer network in numpy is fitted on a
bounded sample of labelled rows (labelled.TRAIN_ROWS) and its temperature on a fifth of them.

Defined results: NULL and empty texts pool to zero and are scored like any other; without rows of both labels
every score is 0.5 (predicted 1); repeated rows have equal scores; NULL ids count as not held out; an id labelled
or standing twice is learnt from once (`labelled.training_rows`). A very long text is pooled like any other: its
parts are held at once, the vectors of its different buckets only.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import free, text_of
from shelfwatch.llm.labelled import held_out, training_rows

BUCKETS = 1 << 14
WIDTH = 48
NONZERO = 6
CHUNK = 512  # buckets of one row of partial sums
HIDDEN = 24
KNOWN = 200_000  # parts remembered per Python worker and stream, of 40 bytes at most
SEED = 11

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = b"0123456789"
_MARKS = bytes(i for i in range(33, 127) if i not in _LETTERS + _DIGITS)
_WORDS = bytes(i if i in _LETTERS else 32 for i in range(256))
_ONLY_MARKS = bytes(i if i in _MARKS else 32 for i in range(256))
_SHAPES = bytes(65 if 65 <= i < 91 else 97 if i in _LETTERS else 48 if i in _DIGITS else 32 for i in range(256))


def index_vectors() -> np.ndarray:
    """Fixed: NONZERO entries of +1 or -1 per bucket."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    places = np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, rng.choice(np.array([-1, 1], np.float32), (BUCKETS, NONZERO)), axis=1)
    return out


class _Known(dict):
    """Buckets by part, remembered: most parts of a text have been seen before, and looking up is cheaper than hashing."""

    def __init__(self, salt: int):
        self.salt = salt

    def __missing__(self, part: bytes) -> int:
        bucket = zlib.crc32(part, self.salt) & (BUCKETS - 1)
        if len(part) <= 40:
            if len(self) >= KNOWN:
                self.clear()
            self[part] = bucket
        return bucket


_KNOWN = [(_Known(salt), table) for salt, table in enumerate((_WORDS, _ONLY_MARKS, _SHAPES))]


def streams(text: bytes) -> list[np.ndarray]:
    """Bucket numbers of the words, the runs of marks and the letter shapes, each in order."""
    out = []
    for known, table in _KNOWN:
        parts = text.translate(table).split()
        out.append(np.fromiter(map(known.__getitem__, parts), np.int32, len(parts)))
    return out


def add_contexts(sums: np.ndarray, index: np.ndarray, codes: np.ndarray) -> None:
    """Adds, for neighbours coded a * BUCKETS + b, the index vector of each to the other's sum."""
    pairs, counts = np.unique(codes, return_counts=True)
    for left, right in ((pairs // BUCKETS, pairs % BUCKETS), (pairs % BUCKETS, pairs // BUCKETS)):
        order = np.argsort(left, kind="stable")
        left, right, n = left[order], right[order], counts[order].astype(np.float32)
        for at in range(0, len(left), 100_000):
            l, v = left[at : at + 100_000], index[right[at : at + 100_000]] * n[at : at + 100_000, None]  # noqa: E741
            heads = np.flatnonzero(np.r_[True, l[1:] != l[:-1]])
            sums[l[heads]] += np.add.reduceat(v, heads, axis=0)


def corpus_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors, BUCKETS x WIDTH: the only thing fetched, of a size the input does not change."""

    def partial(batches):
        index, sums = index_vectors(), np.zeros((BUCKETS, WIDTH), np.float32)
        codes, held = [], 0
        for batch in batches:
            for text in batch["text"].cast(pa.binary()).to_pylist():
                for ids in streams(text):
                    if len(ids) > 1:
                        codes.append(ids[:-1].astype(np.int64) * BUCKETS + ids[1:])
                        held += len(ids)
                if held > 2_000_000:
                    add_contexts(sums, index, np.concatenate(codes))
                    codes, held = [], 0
        if codes:
            add_contexts(sums, index, np.concatenate(codes))
        for at in range(0, BUCKETS, CHUNK):
            part = sums[at : at + CHUNK]
            if part.any():
                yield pa.record_batch([pa.array([at], pa.int32()), pa.array([part.tobytes()])], ["at", "sums"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch["at"].to_pylist(), batch["sums"].to_pylist(), strict=True):
                own = np.frombuffer(part, np.float32).astype(np.float64)
                sums[at] = sums[at] + own if at in sums else own
        for at, own in sums.items():
            yield pa.record_batch([pa.array([at], pa.int32()), pa.array([own.astype(np.float32).tobytes()])], ["at", "sums"])

    parts = docs.select(text_of().alias("text")).mapInArrow(partial, "at int, sums binary")
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    for row in parts.repartition(BUCKETS // CHUNK, "at").mapInArrow(total, "at int, sums binary").collect():
        out[row["at"] : row["at"] + CHUNK] = np.frombuffer(row["sums"], np.float32).reshape(-1, WIDTH)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def pooled(text: bytes, vectors: np.ndarray) -> np.ndarray:
    """Per stream the mean of its vectors; over all of them the spread; length and share of different words."""
    parts, every = [], streams(text)
    for ids in every:
        counts = np.bincount(ids, minlength=0) if len(ids) else np.zeros(0, np.int64)
        used = np.flatnonzero(counts)
        weights = (counts[used] / max(1, len(ids))).astype(np.float32)
        own = vectors[used]
        mean = weights @ own
        parts += [mean, np.sqrt(np.maximum(weights @ (own * own) - mean * mean, 0))]
    words = every[0]
    different = len(np.unique(words)) / len(words) if len(words) else 0.0
    return np.concatenate(parts + [np.array([math.log1p(len(words)), different, len(every[1]) / (1 + len(words))], np.float32)]).astype(np.float32)


class Network:
    """Two layers, fitted by Adam; probabilities are calibrated by one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fit: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-3
        z, t = (x - self.mean) / self.scale, y.astype(np.float64)
        self.w = [rng.normal(0, 1 / math.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        rows, step = np.flatnonzero(fit), 0
        for _ in range(max(12, min(60, 400_000 // max(1, len(rows))))):
            rng.shuffle(rows)
            for at in range(0, len(rows), 256):
                own = rows[at : at + 256]
                h = np.tanh(z[own] @ self.w[0] + self.w[1])
                err = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - t[own]) / len(own)
                back = np.outer(err, self.w[2]) * (1 - h * h)
                grads = [z[own].T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ err + 1e-4 * self.w[2], err.sum(keepdims=True)]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        rest = ~fit if (~fit).any() else fit
        logits = self.logits(x[rest])
        loss = lambda c: np.mean(np.logaddexp(0, logits / c) - t[rest] * logits / c)
        self.temperature = min((0.5 * 1.1**k for k in range(30)), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def trained(docs: DataFrame, labels: DataFrame, vectors: np.ndarray) -> Network | None:
    def run(batches):
        for batch in batches:
            rows = [pooled(t, vectors).tobytes() for t in batch["text"].cast(pa.binary()).to_pylist()]
            yield pa.record_batch([pa.array(rows, pa.binary()), batch["label"], batch["turn"]], ["x", "label", "turn"])

    rows = training_rows(docs, labels, "quality").mapInArrow(run, "x binary, label int, turn int").collect()  # TRAIN_ROWS at most
    if len({r["label"] for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r["turn"], r["x"]))  # the same fit whatever the order of tasks
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]).astype(np.float64)
    return Network(x, np.array([r["label"] for r in rows]), np.array([r["turn"] >= 20 for r in rows]))


def scored(docs: DataFrame, labels: DataFrame, name: str = "_score") -> DataFrame:
    """All columns of `docs` and `name`: the chance of label 1."""
    vectors = corpus_vectors(docs)
    network = trained(docs, labels, vectors)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        if network is None:
            return pd.Series(np.full(len(texts), 0.5))
        x = np.stack([pooled(t.encode("utf-8", "surrogatepass"), vectors) for t in texts]) if len(texts) else np.zeros((0, 1))
        return pd.Series(network.scores(x) if len(texts) else np.zeros(0))

    return docs.select("*", score(text_of()).alias(name))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs.select("doc_id", "text"), labels).select(
        "doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject."""
    name = free("_score", docs)
    return scored(docs, labels, name).filter(F.col(name) >= 0.5).drop(name)
