"""Toxicity scores from a weighted lexicon.

Letters that look alike, accents and digits or signs that stand for letters are folded; the folded text is matched in one pass
by an Aho-Corasick automaton of lexicon words and exception phrases. A hit counts at word boundaries (of the
unfolded text) and outside exceptions. The weights are smoothed log-odds of words in a bounded sample of
labelled rows (labelled.TRAIN_ROWS), beside a few fixed seeds. The sum of the weights, and that sum by the
root of the length in words, go through a logistic curve fitted on rows the weights did not see.

Defined results: NULL and empty texts have no hits; an id labelled or standing twice is learnt from once; a very long
text is matched in the same single pass; without rows of both labels the seeds alone score; equal
texts have equal scores; NULL ids count as not held out.
"""

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import text_of
from shelfwatch.llm.labelled import held_out, training_rows

# Seed words with a weight, and phrases in which they are harmless.
SEEDS = {"idiot": 5.0, "moron": 5.0, "stupid": 4.0, "scum": 4.0, "loser": 4.0, "worthless": 4.0, "pathetic": 4.0, "disgusting": 4.0}
EXCEPTIONS = ["trash can", "trash bin", "pathetic fallacy", "loser bracket", "pond scum", "clown fish", "sympathetic"]
# Folds: one character for one, so places stay the same. Look-alikes are folded by sight, so capitals before they are lowered.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
LIKE = dict(zip("аеорсухіјѕԁһαορυνικмтвнѵ", "aeopcyxijsdhaopuvikmtbhv", strict=True))
CAPITALS = dict(zip("АВЕКМНОРСТУХЅІЈΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abekmhopctyxsijabezhikmnoptyx", strict=True))
_ACCENTED = {i: base.lower() for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]
             if (base := unicodedata.normalize("NFD", chr(i))[0]).isascii() and base.isalpha()}
_WIDE = {0xFF01 + i: 0x21 + i for i in range(94)}
_SEEN = str.maketrans(CAPITALS) | _WIDE
_FOLD = str.maketrans(LIKE | DIGITS) | _ACCENTED
_ODD = re.compile("[Ͱ-ԯ！-～]")
_MARKS = re.compile("[\u0300-\u036f]")
_SIGN = re.compile(r"(?<=[^\W_])!(?=[^\W_])")  # stands for a letter between letters or digits alone
_WORD = re.compile(r"[^\W\d_]+")
LEAST_DOCS = 3
LEAST_WEIGHT = 2.0


def lowered(text: str) -> str:
    """Lower case, without combining marks, wide forms narrowed, look-alike capitals folded; same length as `folded` of it."""
    if text.isascii():
        return text.lower()
    text = _MARKS.sub("", text)
    return (text.translate(_SEEN) if _ODD.search(text) else text).lower()


def folded(low: str) -> str:
    if "!" in low:
        low = _SIGN.sub("i", low)
    return low.encode().translate(_BYTES).decode() if low.isascii() else low.translate(_FOLD)


_BYTES = bytes(ord(DIGITS.get(chr(i), chr(i))) if i < 128 else i for i in range(256))


def automaton(lexicon: dict[str, float]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase in EXCEPTIONS:
        out.add_word(phrase, (len(phrase), None))
    for word, weight in lexicon.items():
        out.add_word(word, (len(word), weight))
    out.make_automaton()
    return out


def hits(text: str, machine) -> tuple[float, int]:
    """Sum of weights, hits."""
    low = lowered(text)
    found, safe = [], []
    for end, (n, weight) in machine.iter(folded(low)):
        start = end + 1 - n
        if (start and low[start - 1].isalpha()) or (end + 1 < len(low) and low[end + 1].isalpha()):
            continue
        (safe if weight is None else found).append((start, end, weight))
    kept = [w for s, e, w in found if not any(a <= s and e <= b for a, b, _ in safe)]
    return sum(kept), len(kept)


def features(text: str, machine) -> list[float]:
    weight, count = hits(text, machine)
    words = 1 + text.count(" ") + text.count("\n")
    return [math.log1p(weight), weight / math.sqrt(words), weight / words * 10, math.log1p(count)]


def learnt(sample: DataFrame) -> dict[str, float]:
    """Words by log-odds of the documents that hold them. Counts meet in Spark; what comes back is bounded by the sample."""

    def count(batches):
        out = Counter()
        for batch in batches:
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
                for word in {w for w in _WORD.findall(folded(lowered(text))) if len(w) > 2}:
                    out[word, label] += 1
            if len(out) > 500_000:
                yield _counted(out)
                out = Counter()
        if out:
            yield _counted(out)

    rows = sample.filter("turn >= 30")
    split = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(totals) < 2:
        return {}
    words = rows.select("text", "label").mapInArrow(count, "word string, label int, n long").groupBy("word").agg(split(1).alias("bad"), split(0).alias("good"))
    weight = F.log((F.col("bad") + 0.5) / (totals[1] + 1)) - F.log((F.col("good") + 0.5) / (totals[0] + 1))
    chosen = words.filter(F.col("bad") >= LEAST_DOCS).withColumn("weight", weight).filter(F.col("weight") >= LEAST_WEIGHT)
    return {r["word"]: r["weight"] for r in chosen.select("word", "weight").collect()}


def _counted(out: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array([w for w, _ in out]), pa.array([k for _, k in out], pa.int32()), pa.array(list(out.values()), pa.int64())], ["word", "label", "n"])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias by Newton steps, lightly regularised."""
    z, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w))
        w = w - np.linalg.solve(hess, z.T @ (p - y) + 0.1 * w)
    return w


def scored(docs: DataFrame, labels: DataFrame, name: str = "_score") -> DataFrame:
    """All columns of `docs` and `name`: the chance of label 1."""
    sample = training_rows(docs, labels, "toxic")
    lexicon = SEEDS | learnt(sample)

    def run(batches):
        machine = automaton(lexicon)
        for batch in batches:
            x = [features(t, machine) for t in batch["text"].to_pylist()]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), batch["label"]], ["x", "label"])

    rows = sample.filter("turn < 30").select("text", "label").mapInArrow(run, "x array<double>, label int").collect()  # under TRAIN_ROWS
    if len({r["label"] for r in rows}) == 2:
        curve = _logistic(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows]))
    else:
        curve = np.array([1.0, 1.0, 0.0, 0.0, -3.0])

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = automaton(lexicon)
        for texts in parts:
            x = np.array([features(t, machine) for t in texts]).reshape(-1, len(curve) - 1)
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ curve, -30, 30))))

    return docs.select("*", score(text_of()).alias(name))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs.select("doc_id", "text"), labels).select(
        "doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))
