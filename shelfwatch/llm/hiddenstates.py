"""A hidden Markov language model over words.

Counts: every word of every text is counted, apart for training rows. The OWN commonest words get an emission class each,
all others share CLASSES classes by crc32; the end of a text is a class of its own. States emit classes; within a
class, a word's chance is its count plus one of the class's sum, with one place for words never seen. So the
chances of all words, and one unseen word a class, add up to one in every state.

Training is Baum-Welch: in every round each task runs forward and backward over its texts, many side by side in
numpy, and hands on its expected counts (STATES x classes at most); Spark adds them up. Rounds cover all training
rows. The first model comes from restarts on SEED_DOCS short training texts, which are no more than a start.
The scaled forward recursion then gives the exact likelihood of every text, held-out ones too.

What a text adds to its score for word counts alone is looked up: words counted at least `common` times, KNOWN at most, are
sent to the tasks; all others meet the count table in a join, where no word has more than `common` rows (words over
LONG_WORD bytes, which always go there, are left to the join's own splitting of large partitions).

Defined results: NULL and empty texts are the end alone; a NULL id is not held out; repeated rows each count and
each get a row. Without training rows every count is zero and states emit by class size. Very long texts go
through in blocks of BLOCK words, with the same sums as in one.
"""

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import saved, text_of

STATES = 8
OWN = 16_384  # commonest words, a class each
CLASSES = 16_384  # shared classes
KNOWN = 200_000  # commonest words the tasks hold
LONG_WORD = 64  # bytes beyond which a word is never among them, so their size is bounded
ROUNDS = 3
SEED_DOCS, SEED_WORDS = 384, 2048  # texts for the start, and the most words of one
SEED_ROUNDS, RESTARTS = 12, 2
SMOOTH = 20.0  # pseudo-counts of a state's emissions, by class size
BLOCK = 16_384
RESCALE = 8  # steps between scalings: the chance of so many words is far above the smallest double
CELLS = 300_000  # words side by side in one batch of texts
HELD = 1_000_000  # words buffered before they are sorted by length
SEED = 13
END = 0  # the class of the end


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n (in training rows), many (in all rows)."""

    def run(batches):
        counts = (Counter(), Counter())
        for batch in batches:
            for text, out in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["out"].to_pylist(), strict=True):
                words = text.lower().split()
                for at in range(0, len(words), 1 << 20):
                    counts[out].update(words[at : at + (1 << 20)])
                    if len(counts[0]) + len(counts[1]) > 400_000:
                        yield from _counted(counts)
                        counts = (Counter(), Counter())
        yield from _counted(counts)

    rows = docs.select(text_of().alias("text"), held_out().alias("out")).mapInArrow(run, "word string, n long, many long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("many").alias("many"))


def _counted(counts):
    for out, own in enumerate(counts):
        words = list(own)
        for at in range(0, len(words), 100_000):
            part = words[at : at + 100_000]
            many = np.array([own[w] for w in part], np.int64)
            yield pa.record_batch([pa.array(part, pa.binary()).cast(pa.string()), pa.array(many * (not out)), pa.array(many)], ["word", "n", "many"])


def _least_count(counts: DataFrame, most: int) -> int:
    """The smallest count that at most `most` words (of bounded length) have."""
    step = F.floor(F.log2("many") * 16)
    rows = counts.filter(F.octet_length("word") <= LONG_WORD).groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("many").alias("least"))
    total, least = 0, 1 << 62
    for r in sorted(rows.collect(), key=lambda r: -r["step"]):  # under 1,024 rows
        total += r["words"]
        if total > most:
            break
        least = r["least"]
    return least


class Vocabulary:
    """What the driver knows of the counts: all of a size the parameters bound."""

    def __init__(self, docs: DataFrame, own: int = OWN, known: int = KNOWN, classes: int = CLASSES):
        self.counts = saved(word_counts(docs), "word-counts")
        self.classes, short = classes, F.octet_length("word") <= LONG_WORD
        sums = self.counts.agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("v")).first()
        ends = docs.filter(~held_out()).count()
        self.tokens, self.types = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
        self.ends = ends
        self.common = _least_count(self.counts, known)
        own_least = max(_least_count(self.counts, own), self.common)
        rows = self.counts.filter((F.col("many") >= self.common) & short).collect()  # `known` at most, LONG_WORD bytes each
        rows.sort(key=lambda r: (-r["many"], r["word"]))
        words = [r["word"].encode() for r in rows]
        self.own = [w for w, r in zip(words, rows, strict=True) if r["many"] >= own_least]
        self.words, self.n = words, np.array([r["n"] for r in rows], np.int64)
        # Class sums: own words by themselves, the rest by checksum.
        shared = ~((F.col("many") >= own_least) & short)
        by = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(classes))
        self.mass = np.zeros(1 + len(self.own) + classes, np.float64)
        self.mass[1 : 1 + len(self.own)] = self.n[: len(self.own)] + 1
        for r in self.counts.filter(shared & (F.col("n") > 0)).groupBy(by.alias("by")).agg(F.sum(F.col("n") + 1).alias("mass")).collect():
            self.mass[1 + len(self.own) + r["by"]] = r["mass"]
        self.mass[1 + len(self.own) :] += 1  # the place for unseen words
        self.mass[END] = ends + 1

    def lookup(self) -> tuple:
        """For the tasks: per known word its class, its log10 of count plus one, and whether it is in training rows."""
        own = {w: 1 + i for i, w in enumerate(self.own)}
        base, classes = 1 + len(self.own), self.classes
        kinds = np.array([own.get(w) or base + zlib.crc32(w) % classes for w in self.words], np.int64)
        return self.words, kinds, np.log10(self.n + 1.0), self.n > 0, base, classes


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """row, doc_id, held_out, n_tokens, kinds (the classes as 4-byte numbers), logs and known of known words, rare (the others)."""
    words, kinds, logs, known, base, classes = vocabulary.lookup()
    send = docs.sparkSession.sparkContext.broadcast((b"\n".join(words), kinds, logs, known))
    end_log, end_known = math.log10(vocabulary.ends + 1), int(vocabulary.ends > 0)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        joined, class_of, log_of, is_known = send.value
        place, many = {w: i for i, w in enumerate(joined.split(b"\n"))} if joined else {}, len(class_of)
        # One more entry, for words not held: no class yet, nothing to add.
        class_of, log_of, is_known = (np.append(c, c.dtype.type(0)) for c in (class_of.astype("<i4"), log_of, is_known))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out, rare, ends = [], [], [0]
            for text in batch["text"].cast(pa.binary()):
                own = text.as_py().lower().split()
                found = np.fromiter(map(place.get, own, repeat(many)), np.int64, len(own))
                at = np.flatnonzero(found == many)
                rest = [own[i] for i in at.tolist()]
                codes = np.full(len(own) + 1, END, "<i4")
                codes[:-1] = class_of[found]
                codes[at] = np.fromiter(map(zlib.crc32, rest), np.int64, len(rest)) % classes + base
                out.append((len(own) + 1, codes.tobytes(), float(log_of[found].sum()) + end_log, int(is_known[found].sum()) + end_known))
                rare += rest
                ends.append(len(rare))
            rows = pa.array(row + np.arange(len(batch)))
            row += len(batch)
            n, codes, log, count = zip(*out, strict=True) if out else ((),) * 4
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rare, pa.binary()).cast(pa.string()))
            yield pa.record_batch([rows, batch["doc_id"], batch["out"], pa.array(n, pa.int64()), pa.array(codes, pa.binary()), pa.array(log, pa.float64()),
                                   pa.array(count, pa.int64()), words],
                                  ["row", "doc_id", "held_out", "n_tokens", "kinds", "logs", "known", "rare"])

    rows = docs.select("doc_id", text_of().alias("text"), held_out().alias("out"))
    return saved(rows.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, kinds binary, logs double, known long, rare array<string>"), "encoded-texts")


def _batches(stream):
    """Lists of class arrays of like length, from Arrow batches with a column kinds; longest first in each."""
    held, many = [], 0

    def cut(held):
        held.sort(key=lambda x: -len(x[1]))
        at = 0
        while at < len(held):
            n = max(1, CELLS // len(held[at][1]))
            yield held[at : at + n]
            at += n

    for batch in stream:
        for row, own in zip(batch["row"].to_pylist(), batch["kinds"].to_pylist(), strict=True):
            held.append((row, np.frombuffer(own, "<i4")))
            many += len(held[-1][1])
            if many > HELD:
                yield from cut(held)
                held, many = [], 0
    yield from cut(held)


class Model:
    """start (states), move (states x states), emit (classes x states): all by rows of probabilities.

    Texts come as lists of class arrays, longest first, so those that reach a step are the first ones.
    """

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    def _block(self, texts, first: int, to: int):
        """(codes, emission, alive) of the steps `first` to `to`: steps x texts; how many texts reach a step."""
        codes = np.zeros((to - first, len(texts)), np.int32)
        for i, t in enumerate(texts):
            part = t[first:to]
            codes[: len(part), i] = part
        lengths = np.array([len(t) for t in texts])
        alive = np.searchsorted(-lengths, -np.arange(first, to + 1) - 1, "right").tolist()
        return codes, np.take(self.emit, codes, axis=0), alive

    def _forward(self, emission, alive, state):
        """Forward values of every step, in place of `emission`'s shape, and log scales of each text.

        Values are scaled every RESCALE steps; `state` holds those of the step before, None at the start.
        """
        out, logs, ones = np.zeros_like(emission), np.zeros(emission.shape[1]), np.ones(len(self.start))
        for t in range(len(emission)):
            n = alive[t]
            now = out[t, :n]
            if t or state is not None:
                np.dot(out[t - 1, :n] if t else state[:n], self.move, out=now)
                now *= emission[t, :n]
            else:
                np.multiply(emission[t, :n], self.start, out=now)
            if t % RESCALE == RESCALE - 1 or t == len(emission) - 1:
                total = now @ ones
                now /= total[:, None]
                logs[:n] += np.log(total)
        return out, logs

    def _ended(self, out, alive, logs):
        """Adds what texts that end within the block still have unscaled."""
        for t in np.flatnonzero(np.diff(alive)).tolist():
            if t % RESCALE != RESCALE - 1 and t != len(out) - 1:
                logs[alive[t + 1] : alive[t]] += np.log(out[t, alive[t + 1] : alive[t]].sum(1))

    def log_likelihoods(self, texts, block: int = BLOCK) -> np.ndarray:
        state, logs = None, np.zeros(len(texts))
        for first in range(0, len(texts[0]), block):
            _, emission, alive = self._block(texts, first, min(first + block, len(texts[0])))
            out, more = self._forward(emission, alive, state)
            self._ended(out, alive, more)
            logs, state = logs + more, out[-1]
        return logs

    def add_counts(self, texts, start, move, emit, block: int = BLOCK) -> float:
        """One E-step: adds expected counts, gives the log likelihood."""
        edges, states, total = list(range(0, len(texts[0]), block)), [None], 0.0
        for first in edges[:-1]:  # states at block edges; blocks are run again on the way back
            _, emission, alive = self._block(texts, first, first + block)
            states.append(self._forward(emission, alive, states[-1])[0][-1])
        back = np.ones((len(texts), len(self.start)))  # backward values of a block's last step
        for first, state in zip(edges[::-1], states[::-1], strict=True):
            codes, emission, alive = self._block(texts, first, min(first + block, len(texts[0])))
            ahead, logs = self._forward(emission, alive, state)
            self._ended(ahead, alive, logs)
            total += logs.sum()
            # behind: backward values of a step; emission becomes emission times those, scaled now and then.
            behind, back_move, ones = np.zeros_like(ahead), np.ascontiguousarray(self.move.T), np.ones(len(start))
            behind[-1, : alive[-2]] = back[: alive[-2]]
            for t in range(len(ahead) - 1, -1, -1):
                n, now = alive[t], behind[t]
                if t % RESCALE == 0:
                    emission[t, :n] *= now[:n] / (now[:n] @ ones)[:, None]
                else:
                    emission[t, :n] *= now[:n]
                if t:
                    np.dot(emission[t, :n], back_move, out=behind[t - 1, :n])
                    if alive[t - 1] > n:
                        behind[t - 1, n : alive[t - 1]] = 1.0
            onward = emission
            behind *= ahead
            sums = behind @ ones
            sums[sums == 0] = 1.0  # beyond a text's end
            ahead /= sums[:, :, None]
            for t in np.flatnonzero(np.diff(alive[:-1])).tolist():  # a text's last step has no next one
                ahead[t, alive[t + 1] :] = 0.0
            move += self.move * (ahead[:-1].reshape(-1, len(start)).T @ onward[1:].reshape(-1, len(start)))
            behind /= sums[:, :, None]
            n = alive[0]
            if state is None:
                start += behind[0].sum(0)
            else:
                back = np.ones_like(back)
                back[:n] = onward[0, :n] @ self.move.T
                before = state[:n] / (state[:n] * back[:n]).sum(1, keepdims=True)
                move += self.move * (before.T @ onward[0, :n])
            for k in range(len(start)):
                emit[:, k] += np.bincount(codes.reshape(-1), behind[:, :, k].reshape(-1), len(emit))
        return total

    @classmethod
    def of_counts(cls, start, move, emit, mass):
        """M-step: emissions are smoothed by class size, so no class is impossible."""
        prior = mass / mass.sum()
        emit = emit + SMOOTH * prior[:, None]
        move, start = move + 1.0, start + 1.0
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _first_model(encoded_rows: DataFrame, mass: np.ndarray, states: int) -> Model:
    """Restarts of Baum-Welch on a few short training texts; the likeliest is the start."""
    some = encoded_rows.filter(f"NOT held_out AND n_tokens <= {SEED_WORDS}").orderBy(F.xxhash64("doc_id", "kinds"), "row").limit(SEED_DOCS)
    texts = sorted((np.frombuffer(r["kinds"], "<i4") for r in some.select("kinds").collect()), key=lambda t: (-len(t), t.tobytes()))
    prior, best = mass / mass.sum(), None
    for k in range(RESTARTS if texts else 1):
        rng = np.random.default_rng(SEED + k)
        model = Model(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), None)
        noisy = prior[:, None] * rng.gamma(1.0, 1.0, (len(mass), states))
        model.emit, last = noisy / noisy.sum(0), 0.0
        for _ in range(SEED_ROUNDS if texts else 0):
            start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((len(mass), states))
            last = sum(model.add_counts(texts[at : at + 128], start, move, emit) for at in range(0, len(texts), 128))
            model = Model.of_counts(start, move, emit, mass)
        if best is None or last > best[0]:
            best = (last, model)
    return best[1] if texts else Model.of_counts(np.zeros(states), np.zeros((states, states)), np.zeros((len(mass), states)), mass)


def expected_counts(encoded_rows: DataFrame, model: Model) -> tuple:
    """(start, move, emit, log likelihood) over all training rows: one task's counts have the model's size."""
    states, classes = len(model.start), len(model.emit)
    send = encoded_rows.sparkSession.sparkContext.broadcast(model)
    chunk = 1024  # classes of one row

    def run(stream):
        own, logs = send.value, 0.0
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
        for part in _batches(stream):
            logs += own.add_counts([t for _, t in part], start, move, emit)
        head = np.concatenate([[logs], start, move.reshape(-1)])
        rows = [(-1, head)] + [(at, emit[at : at + chunk].reshape(-1)) for at in range(0, classes, chunk) if emit[at : at + chunk].any()]
        yield pa.record_batch([pa.array([a for a, _ in rows], pa.int32()), pa.array([r.tobytes() for _, r in rows], pa.binary())], ["at", "sums"])

    def total(stream):
        sums: dict = {}
        for batch in stream:
            for at, part in zip(batch["at"].to_pylist(), batch["sums"].to_pylist(), strict=True):
                sums[at] = sums.get(at, 0.0) + np.frombuffer(part)
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["at", "sums"])

    ddl = "at int, sums binary"
    parts = encoded_rows.filter("NOT held_out").select("row", "kinds").mapInArrow(run, ddl)
    head, emit = np.zeros(1 + states + states * states), np.zeros((classes, states))
    for r in parts.repartition(-(-classes // chunk) + 1, "at").mapInArrow(total, ddl).collect():
        own = np.frombuffer(r["sums"])
        if r["at"] < 0:
            head = own
        else:
            emit[r["at"] : r["at"] + chunk] = own.reshape(-1, states)
    return head[1 : 1 + states], head[1 + states :].reshape(states, states), emit, float(head[0])


def trained(encoded_rows: DataFrame, mass: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model and the log likelihood of the training rows before each round; it never falls but for the smoothing."""
    model, logs = _first_model(encoded_rows, mass, states), []
    for _ in range(rounds):
        start, move, emit, log = expected_counts(encoded_rows, model)
        logs.append(log)
        model = Model.of_counts(start, move, emit, mass)
    return model, logs


def likelihoods(encoded_rows: DataFrame, model: Model, mass: np.ndarray) -> DataFrame:
    """row, forward: log10 of the chance of its classes, less the log10 of their sums where words share one."""
    send = encoded_rows.sparkSession.sparkContext.broadcast((model, np.log10(mass)))

    def run(stream):
        own, sums = send.value
        for part in _batches(stream):
            logs = own.log_likelihoods([t for _, t in part]) / math.log(10) - np.array([sums[t].sum() for _, t in part])
            yield pa.record_batch([pa.array([r for r, _ in part], pa.int64()), pa.array(logs)], ["row", "forward"])

    return encoded_rows.select("row", "kinds").mapInArrow(run, "row long, forward double")


def scored(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, own: int = OWN, known: int = KNOWN, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    vocabulary = Vocabulary(docs, own, known, classes)
    rows = encoded(docs, vocabulary)
    model, _ = trained(rows, vocabulary.mass, states, rounds)
    logs = likelihoods(rows, model, vocabulary.mass)
    rare = rows.select("row", F.explode("rare").alias("word"))
    found = rare.join(vocabulary.counts.select("word", "n"), "word").groupBy("row").agg(
        F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.sum((F.col("n") > 0).cast("long")).alias("more_known"))
    whole = rows.drop("kinds", "rare").join(logs, "row").join(found, "row", "left")
    counted = F.col("logs") + F.coalesce("more", F.lit(0.0))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (counted - F.col("n_tokens") * F.lit(math.log10(vocabulary.tokens + vocabulary.types + 1))).alias("base_score"),
        (counted + F.col("forward")).alias("score"))


def digest(docs: DataFrame) -> DataFrame:
    return scored(docs.select("doc_id", "text"))
