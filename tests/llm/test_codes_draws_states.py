"""Vector codes, resampling and the hidden Markov model against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus_help import DATA, frame  # noqa: F401
from test_exact import ODD, asc, docs_of

from shelfwatch.llm import hiddenstates, resample, vectorcodes


def plain_codes(vectors):
    """(vec_id, label, code, error), and the books, by full searches."""
    rows = [(i, lab, [math.floor(4096 * x) for x in v]) for i, lab, v in vectors
            if v and all(x is not None and math.isfinite(x) for x in v)]
    least = {}
    for i, _, v in rows:
        k = (i is None, i or 0)
        least[k] = min(least.get(k, v), v)
    w = len(rows[0][2]) // 8
    cut = lambda v: [tuple(v[p * w : p * w + w]) for p in range(8)]
    books = [[cut(least[k])[p] for k in sorted(least)[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((far(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(6):
        groups = defaultdict(list)
        for _, _, v in rows:
            for p, x in enumerate(cut(v)):
                groups[p, near(p, x)[1]].append(x)
        for (p, e), xs in groups.items():
            books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    out = []
    for i, lab, v in rows:
        found = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(c) for b in books for x in b for c in x).encode()).hexdigest()


@pytest.fixture
def vectors(spark):
    ddl = "vec_id long, embedding array<float>, label int, code string, of string, v long"
    return lambda rows: spark.createDataFrame([(i, v, lab, "x", "y", 1) for i, lab, v in rows], ddl).repartition(3)


@pytest.mark.parametrize("kind", ["ties", "few", "wide", "huge"])
def test_codes_against_full_searches(vectors, kind):
    rng = random.Random(3)
    value = {"ties": lambda: rng.randrange(3) / 4096, "few": rng.random, "wide": lambda: rng.gauss(0, 3), "huge": lambda: rng.choice([1.0, 2.0**40, -(2.0**41)])}[kind]
    rows = [(rng.randrange(200) if kind != "few" else rng.randrange(5), rng.choice([None, 1, 2]), [value() for _ in range(16)]) for _ in range(120)]
    rows += [rows[0], rows[0], (None, None, rows[1][2]), (1, 1, None), (2, 1, []), (3, 1, [float("nan")] * 16), (4, 1, [None] * 16), (5, 1, [float("inf")] * 16)]
    rows = [(i, lab, v and [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]
    want, sha = plain_codes(rows)
    of = defaultdict(int)
    for _, lab, _, e in want:
        of[lab] += e
    got = vectorcodes.digest(vectors(rows)).collect()
    assert {r["codebooks_sha256"] for r in got} == {sha}
    top = vectorcodes.MOST_LONG
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == Counter(
        (i, c, min(e, top), min(sum(min(x, top) for _, m, _, x in want if m == lab), top)) for i, lab, c, e in want)


def test_codes_of_nothing_and_uneven_vectors(vectors):
    assert vectorcodes.digest(vectors([])).count() == 0 and vectorcodes.digest(vectors([(1, 1, None)])).count() == 0
    for rows in ([(1, 1, [0.5] * 12)], [(1, 1, [0.5] * 8), (2, 1, [0.5] * 16)]):
        with pytest.raises(ValueError):
            vectorcodes.digest(vectors(rows))


def test_orchard_finds_the_nearest_with_fewer_distances():
    rng = np.random.default_rng(1)
    for spread in (2, 1000):
        book, x = rng.integers(0, spread, (16, 2)), rng.integers(0, spread, (4000, 2))
        own = vectorcodes.Orchard(book)
        entry, d = own.nearest(x)
        full = ((x[:, None] - book[None]) ** 2).sum(-1)
        assert (entry == full.argmin(1)).all() and (d == full.min(1)).all()
    assert own.measured < 0.75 * full.size


def test_decoded_vectors_are_near(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = vectorcodes.kept(table)
    books = vectorcodes.codebooks(rows)
    back = {r["vec_id"]: r["embedding"] for r in vectorcodes.decoded(vectorcodes.encoded(rows, books), books).collect()}
    errors, sizes = 0.0, 0.0
    for r in table.collect():
        errors += sum((a - b) ** 2 for a, b in zip(r["embedding"], back[r["vec_id"]], strict=True))
        sizes += sum(a * a for a in r["embedding"])
    assert errors < 0.6 * sizes


def plain_runs(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", asc(text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("which", ["table", "odd", "empty", "no target"])
def test_resampling(spark, frame, which):
    rows = docs_of(spark) if which in ("table", "no target") else ODD + [(50 + i, f"w{i} " * 25) for i in range(40)] * 2 if which == "odd" else []
    items = spark.read.parquet(f"{DATA}/benchmark.parquet") if which != "no target" else spark.createDataFrame([(1, None)], "item_id long, text string")
    each = [(i, *plain_runs(t)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, _, b in each:
        s.update(b)
    for r in items.collect():
        t.update(plain_runs(r["text"])[1])
    top, low = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * top / ((s[b] + 1) * low))) for b in range(10000)]
    want, able = [], []
    for i, n, b in each:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in b)
        want.append((i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
        if n >= 20:
            able.append((-want[-1][3], i is None, i or 0, want[-1]))
    able.sort(key=lambda x: x[:3])
    ranks = Counter((w[3], n + 1) for n, w in enumerate(able[: 5 * len(able) // 100]))
    got = [tuple(r) for r in resample.digest(frame(rows), items).collect()]
    assert Counter(g[:4] for g in got) == Counter(want)
    assert Counter((g[:4], g[4]) for g in got if g[4]) == ranks


@pytest.mark.parametrize("seed", [1, 2])
def test_cutoff_is_exact(spark, seed):
    """Rounds of medians down to one key, over uneven partitions and many ties."""
    rng = random.Random(seed)
    keys = [(rng.randrange(4) if n % 3 else 1, n % 2, rng.randrange(5), n) for n in range(500)]
    df = spark.createDataFrame(sorted(keys), "neg long, nul int, id long, tie long").repartition(7, "id")
    for k in (1, 2, 25, 250, 499, 500):
        assert resample.cutoff(df, k, collect=1) == sorted(keys)[k - 1]
    assert resample.cutoff(df, 0) is None and resample.cutoff(df, 501) is None and resample.cutoff(df.filter("false"), 1) is None


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(5)
    texts = ["", "a b c d", "Ünï x " + "y" * 100 + " z q " + "k" * 300] + [" ".join("".join(rng.choice("abAé9-") for _ in range(rng.randrange(1, 80))) for _ in range(60)) for _ in range(9)]
    for chunk, known in ((300_000, 400_000), (7, 20), (1, 3)):
        monkeypatch.setattr(resample, "CHUNK", chunk)
        monkeypatch.setattr(resample, "KNOWN", known)
        buckets, got = resample.Buckets(), [[] for _ in texts]
        for rows, found in buckets.of([x.encode() for x in texts]):
            for r, b in zip(rows.tolist(), found.tolist(), strict=True):
                got[r].append(b)
        assert [sorted(g) for g in got] == [sorted(plain_runs(x)[1]) for x in texts]
        assert buckets.n_words.tolist() == [plain_runs(x)[0] for x in texts]


def test_drawn_documents_keep_their_columns(spark, frame):
    docs = frame([(i, "the benchmark speaks of apples and pears " * 4 if i % 2 else "quite other words stand in here today " * 4) for i in range(100)])
    items = spark.createDataFrame([(1, "apples and pears of the benchmark")], "item_id long, text string")
    out = resample.resampled(docs, items)
    assert out.columns == docs.columns and [r["doc_id"] % 2 for r in out.collect()] == [1] * 5


def plain_base(rows):
    tokens = [re.findall("[^\x20\x09-\x0d]+", asc(t or "")) + [0] for _, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for own, o in zip(tokens, out, strict=True) if not o for w in own)
    n, v = sum(c.values()), len(c)
    return c, [(i, o, len(own), sum(w in c for w in own), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own))
               for (i, _), own, o in zip(rows, tokens, out, strict=True)]


@pytest.mark.parametrize("which", ["table", "odd", "empty", "unlearnt"])
@pytest.mark.parametrize("known", [hiddenstates.KNOWN, 30])
def test_base_scores(spark, frame, which, known):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = {"table": lambda: docs_of(spark), "odd": lambda: ODD, "empty": list, "unlearnt": lambda: [(i, f"a b{i} c") for i in held]}[which]()
    got = hiddenstates.scored(frame(rows), states=3, rounds=1, own=10, known=known, classes=64).collect()
    want = sorted(plain_base(rows)[1], key=repr)
    got = sorted((tuple(r) for r in got), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], abs=1e-6) and math.isfinite(g[6]) and g[6] < 1e-9


def small_model(states=3, classes=5, seed=2):
    rng = np.random.default_rng(seed)
    share = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(shape))
    return hiddenstates.Model(share(states), share(states, states), share(states, classes).T.copy())


def paths(model, text):
    """Every state path with its chance."""
    for path in itertools.product(range(len(model.start)), repeat=len(text)):
        p = model.start[path[0]] * model.emit[text[0], path[0]]
        for a, b, w in zip(path, path[1:], text[1:], strict=False):
            p *= model.move[a, b] * model.emit[w, b]
        yield path, p


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_forward_and_counts_against_all_paths(block):
    model = small_model()
    texts = [np.array(t, np.int32) for t in ([1, 4, 2, 2, 0], [3, 1, 1, 0], [2, 0], [0])]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    total = model.add_counts(texts, start, move, emit, block)
    want = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    logs = []
    for t in texts:
        each = list(paths(model, t))
        whole = sum(p for _, p in each)
        logs.append(math.log(whole))
        for path, p in each:
            want[0][path[0]] += p / whole
            for a, b in zip(path, path[1:], strict=False):
                want[1][a, b] += p / whole
            for s, w in zip(path, t, strict=True):
                want[2][w, s] += p / whole
    assert np.allclose(model.log_likelihoods(texts, block), logs) and total == pytest.approx(sum(logs))
    for g, w in zip((start, move, emit), want, strict=True):
        assert np.allclose(g, w)


def test_rounds_raise_the_likelihood_and_the_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    vocabulary = hiddenstates.Vocabulary(docs, own=500, classes=200)
    rows = hiddenstates.encoded(docs, vocabulary)
    model, logs = hiddenstates.trained(rows, vocabulary.mass, states=4, rounds=3)
    assert logs == sorted(logs)
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1) and model.start.sum() == pytest.approx(1)
    # Counts of a round do not depend on how rows lie in partitions.
    a, b = (hiddenstates.expected_counts(r, model) for r in (rows, rows.repartition(5)))
    assert all(np.allclose(x, y) for x, y in zip(a, b, strict=True))
    assert a[2].sum() == pytest.approx(vocabulary.tokens)
    out = [r for r in hiddenstates.scored(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_chances_of_all_words_add_up(frame):
    """One token after another from a state: known words, and one unseen word a class, are everything."""
    rows = [(i, t) for i, t in enumerate(["a a b c d", "b a", "c e f g h i", "a b"] * 3)]
    vocabulary = hiddenstates.Vocabulary(frame(rows), own=2, known=4, classes=3)
    c, _ = plain_base(rows)
    place = {w.decode(): 1 + k for k, w in enumerate(vocabulary.own)}
    base, mass = 1 + len(place), vocabulary.mass
    share = lambda w: (c[w] + 1) / mass[place.get(w) or base + zlib.crc32(w.encode()) % 3]
    sums = np.zeros(len(mass))
    sums[0] = (c[0] + 1) / mass[0]
    for w in c:
        if w:
            sums[place.get(w) or base + zlib.crc32(w.encode()) % 3] += share(w)
    sums[base:] += 1 / mass[base:]  # the unseen word
    assert len(place) == 2 and np.allclose(sums, 1)
