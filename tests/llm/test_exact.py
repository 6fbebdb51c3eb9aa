"""Operators with an exact definition, against plain Python on the smallest tables and odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from corpus_help import DATA, frame  # noqa: F401

from shelfwatch.llm import packing, queries, secrets, shards, simhash, spotsigs
from shelfwatch.llm.components import components

ODD = [
    (None, None), (None, "a b"), (7, None), (7, ""), (3, "same text here"), (3, "same text here"), (4, "same text here"),
    (9, "É ñ ß MIT License mit license. token = 'abcdefghijkl' AKIAABCDEFGHIJKLMN"), (10, " "), (11, "ǅ İ ſ é <|endoftext|> 'S'll a_b ²"),
    (12, "word " * 30000), (13, "deadbeefdeadbeef" * 3), (1000000, "GNU general public license, general PUBLIC\nlicense"), (14, "secret: token: abcdefghijklmnop"),
]


def docs_of(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.fixture(params=["table", "odd", "empty"])
def rows(request, spark):
    return {"table": lambda: docs_of(spark), "odd": lambda: ODD, "empty": list}[request.param]()


def asc(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_packing(spark, frame, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = packing.packed(frame(rows), queries.tokenizer_path()).collect()
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            want[i, s, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(by) <= total // 2048 + 2


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(queries.tokenizer_path()), random.Random(5)
    encode = packing.WordIds(queries.tokenizer_path())
    alphabet = "abcXYZ019 '\t\n\r.,!_-$%éÉßñÑŒœžŽıİ²ªº×÷€«…’ ́\x85\x1c語Σσς'stremvld"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(4000)]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids == b"".join(x.to_bytes(4, "little") for x in tok.encode(text, add_special_tokens=False).ids), text


@pytest.mark.parametrize("seed", range(6))
def test_filling_and_plan(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 40): rng.randrange(1, 6) for _ in range(6)}
    items = [n for n, c in counts.items() for _ in range(c)]
    best = max(s for k in range(len(items) + 1) for c in set(itertools.combinations(sorted(items), min(k, 4))) if (s := sum(c)) <= 40) if len(items) < 12 else None
    used = packing.best_filling(counts, 40)
    assert all(used[n] <= counts[n] for n in used) and sum(n * c for n, c in used.items()) <= 40
    if best is not None:
        assert sum(n * c for n, c in used.items()) >= best
    placed = Counter()
    for n, first, copies, _, _ in packing.plan(counts, 40):
        assert first == placed[n] or first > placed[n] - 1
        placed[n] = max(placed[n], first + copies)


def test_licenses(spark, frame, rows):
    from shelfwatch.llm import licenses

    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"])
                  for r in licenses.scanned(frame(rows)).collect()), key=repr)
    want = []
    for i, t in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", asc(t or ""))
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            for s in range(len(words)):
                if words[s : s + len(p)] == p:
                    places.append(s)
                    labels.add(label)
        want.append((i, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    assert [g[:6] for g in got] == sorted(want, key=repr)
    for g in got:
        assert set(filter(None, g[5].split(","))) <= set(g[6].split(",")) and 0 <= g[7] <= 1 and (g[7] > 0) == bool(g[6])


def test_long_license_with_a_gap(frame):
    from shelfwatch.llm import licenses

    text = licenses.TEMPLATES[7][1].split()
    changed = " ".join(["filler"] * 5 + text[:8] + ["extra"] + text[8:])
    got = licenses.scanned(frame([(1, changed), (2, "redistribution and use")])).orderBy("doc_id").collect()
    assert got[0]["labels"] == "bsd" and got[0]["score"] > 0.9 and got[1]["labels"] == ""


def plain_signatures(text):
    words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    anchors, content = set(spotsigs.ANCHORS), None
    content = [i for i, w in enumerate(words) if w not in anchors]
    out = set()
    for j in range(len(content) - spotsigs.CHAIN + 1):
        at = content[j]
        if at and words[at - 1] in anchors:
            out.add((words[at - 1], *(words[content[j + k]] for k in range(spotsigs.CHAIN))))
    return out or {tuple(words)}


def test_spot_signatures(spark, frame, rows):
    rows = [(i, t) for i, t in rows if i is not None and (i, t) != (11, ODD[9][1])]
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in spotsigs.with_edit(frame(rows)).collect()}
    order = sorted(rows, key=lambda r: r[0])
    ids = Counter(i for i, _ in rows)
    seen = 0
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        if ids[i] > 1 or ids[order[(k + 1) % len(order)][0]] > 1:
            continue
        r = got[i, len(t), hashlib.sha256(changed.encode()).hexdigest()]
        a, b, c = (plain_signatures(x) for x in (t, changed, following))
        assert len(r["fingerprint"].split(",")) == len(a)
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b)) and r["near_next"] == pytest.approx(len(a & c) / len(a | c))
        seen += 1
    assert len(rows) == 0 or seen > 3


def test_next_over_blocks(frame):
    ids = [0, 1, 1023, 1024, 5000, 2_000_000, 2_000_001, 9_000_000]
    got = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(frame([(i, f"t{i}") for i in ids])).collect()}
    assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}
    assert spotsigs.with_next(frame([(5, "x")])).first()["next_text"] == "x"


def test_spotsigs_pairs(spark, frame):
    rows = docs_of(spark)
    got = {tuple(sorted((r["a"], r["b"]))) for r in spotsigs.near_pairs(frame(rows)).collect()}
    names = {r["fp"]: r["doc_id"] for r in spotsigs.classes(frame(rows)).collect()}
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(plain_signatures(t or "")), i)
    texts = list(sets.items())
    want = {tuple(sorted((i, j))) for (a, i), (b, j) in itertools.combinations(texts, 2) if len(a & b) / len(a | b) >= 0.8}
    assert {tuple(sorted((names[a], names[b]))) for a, b in got} == want


def test_next_over_hashed_ids(spark, frame, monkeypatch):
    """Ids all over 62 bits: one guest a range, and the order of all ids; also where bounds come from a sample."""
    rng = random.Random(2)
    ids = sorted({rng.randrange(1 << 62) for _ in range(1500)})
    for sampled in (spotsigs.SAMPLED, 3):
        monkeypatch.setattr(spotsigs, "SAMPLED", sampled)
        got = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(frame([(i, f"t{i}") for i in rng.sample(ids, len(ids))])).collect()}
        assert got == {i: f"t{j}" for i, j in zip(ids, ids[1:] + ids[:1], strict=True)}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_sets_against_all_pairs(spark, seed):
    """Small sets, sets with one core and much or little of their own, and repeated ones."""
    rng = random.Random(seed)
    core = [rng.randrange(1 << 40) for _ in range(40)]
    sets = [frozenset(rng.sample(range(30), rng.randrange(1, 12))) for _ in range(150)]
    for own in (2, 4, 5, 12):
        sets += [frozenset(core[: 40 - own] + [rng.randrange(1 << 40) for _ in range(own)]) for _ in range(25)]
    rows = [(sorted(s),) for s in sets + sets[:20]]
    df = spark.createDataFrame(rows, "sigs array<bigint>").selectExpr("xxhash64(sigs) AS fp", "sigs")
    names = {r["fp"]: frozenset(r["sigs"]) for r in df.collect()}
    got = {frozenset((names[r["a"]], names[r["b"]])) for r in spotsigs.near_sets(df).collect()}
    want = {frozenset((a, b)) for a, b in itertools.combinations(set(sets), 2) if 10 * len(a & b) >= 8 * len(a | b)}
    assert got == want and len(want) > 10
    roots = {r["node"]: r["root"] for r in spotsigs.near_classes(df).collect()}
    by_fp = {fp: roots.get(fp, fp) for fp in names}
    assert by_fp == clusters(sorted(names), lambda a, b: 10 * len(names[a] & names[b]) >= 8 * len(names[a] | names[b]))


def test_near_classes(spark, frame):
    rows = docs_of(spark)
    sets = {i: frozenset(plain_signatures(t or "")) for i, t in rows}
    root = clusters(sorted(sets), lambda i, j: 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]))
    assert sorted((r["doc_id"], r["near_class"]) for r in spotsigs.with_edit(frame(rows)).collect()) == sorted(root.items())


@pytest.mark.parametrize("crowd", [0, spotsigs.CROWD, 1000])
def test_near_classes_of_a_crowd(spark, monkeypatch, crowd):
    """Sets with most of one core that are seldom alike: the groups of all pairs, with few candidates beside the pairs of a crowd."""
    rng = random.Random(5)
    core = list(range(27))
    sets = {frozenset(rng.sample(core, 27 - k)) | {100 + rng.randrange(10**9) for _ in range(m)} for k, m in [(3, 2), (2, 3), (3, 3)] * 60 + [(2, 2)] * 9}
    # A second crowd around a subset, sets that share what they add, and one set inside all others.
    sets |= {frozenset(core[:14]) | {50, 51, 100 + rng.randrange(10**9)} | set(rng.sample(range(60, 90), 2)) for _ in range(40)} | {frozenset(core[:3])}
    df = spark.createDataFrame([(sorted(x),) for x in sets], "sigs array<bigint>").selectExpr("xxhash64(sigs) AS fp", "sigs")
    names, write, candidates = {r["fp"]: frozenset(r["sigs"]) for r in df.collect()}, spotsigs.saved, []

    def saved(frame, name):
        out = write(frame, name)
        candidates.append(out.count() if name == "signature-pairs" else 0)
        return out

    monkeypatch.setattr(spotsigs, "saved", saved)
    roots = {r["node"]: r["root"] for r in spotsigs.near_classes(df, crowd=crowd).collect()}
    want = clusters(sorted(names), lambda a, b: 10 * len(names[a] & names[b]) >= 8 * len(names[a] | names[b]))
    assert {fp: roots.get(fp, fp) for fp in names} == want and 20 < len(set(want.values())) < len(sets)
    if crowd == spotsigs.CROWD:
        assert sum(candidates) < 16 * len(sets)


def test_secrets(frame, rows):
    got = sorted(((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.scanned(frame(rows)).collect()), key=repr)
    want = []
    for i, t in rows:
        t, found = t or "", []
        for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
            if len(m[2]) >= 12:
                found.append((m.start(), 0, m.end(), "assign"))
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        n = Counter(f[3] for f in found)
        text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))
        want.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_secret_entropy(frame):
    import math

    rng, texts = random.Random(1), []
    for n in (20, 24, 40):
        texts += ["".join(rng.choice("0123456789abcdef") for _ in range(n)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789") for _ in range(n))]
    texts += ["123e4567-e89b-12d3-a456-426614174000", "some-long-hyphenated-words-here", "aaaaaaaaaaaaaaaaaaaaaaa1", "4095893521234567890123"]

    def top(t, w):
        windows = [Counter(t[i : i + w]) for i in range(len(t) - w + 1)]
        return max((-sum(c / w * math.log2(c / w) for c in x.values()) for x in windows), default=0.0)

    got = {r["doc_id"]: r["spans"] for r in secrets.scanned(frame([(i, f"x {t} y") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        allowed = re.fullmatch(secrets.ALLOWED, t) or not re.search("[0-9]", t) or not re.search("[A-Za-z]", t)
        kind = "entropy_hex" if re.fullmatch("[0-9a-f]+", t) else "entropy_text"
        _, w, least = secrets.CLASSES[kind]
        want = not allowed and top(t, w) >= least
        assert (f"{kind}:2:{2 + len(t)}" in got[i]) == want, (t, got[i])


def test_counting_runs_alone_are_allowed(frame):
    """An opening that counts excuses nothing that follows; letters alone and short keys are judged too."""
    rng = random.Random(9)
    of = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    small, big, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    secret = ["abcdef" + of(small + big + digits, 30), "ABCDEF" + of(small + big + digits, 30), digits + of(small + big + digits, 30), of(small + big, 40), "aB3" + of(small + big + digits, 15)]
    plain = [digits * 3, digits + small, small + digits, big + small, digits * 2 + "abcdefghij", "ABCDEFGHIJKLMNOPQRST12", "configurationOption1", "ThisIsTheNameOfSomething", "averylongwordinsmallletters", "short1Key", "an-ordinary-slug-2024"]
    got = {r["doc_id"]: r["spans"] for r in secrets.scanned(frame([(i, f"x {t} y") for i, t in enumerate(secret + plain)])).collect()}
    for i, t in enumerate(secret + plain):
        assert (f"entropy_text:2:{2 + len(t)}" in got[i].split(",")) == (i < len(secret)), (t, got[i])


def test_very_long_candidates(frame):
    texts = ["=" * 60000 + "a1", "0123456789" * 6000 + "g", "ab-" * 30000 + "12", "a1" * 50000]
    got = {r["doc_id"]: r["spans"] for r in secrets.scanned(frame(list(enumerate(texts)))).collect()}
    assert not any("entropy" in got[i] for i in range(4))
    rng = random.Random(5)
    key = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789") for _ in range(100_000))
    assert "entropy_text:0:100000" in secrets.scanned(frame([(0, key)])).first()["spans"].split(",")


def plain_fp(text):
    words = re.findall(r"[^\x20\t-\r]+", asc(text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def clusters(nodes, near):
    """Smallest member reachable, by union of all pairs."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if near(a, b):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_simhash(spark, frame, rows):
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.digest(frame(rows)).collect())
    fps = [(i, plain_fp(t)) for i, t in rows]
    root = clusters(sorted({f for _, f in fps}), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert got == Counter((i, f"{f:016x}", least.get(root[f])) for i, f in fps)


@pytest.mark.parametrize("crowd", [2, 6, 24])
def test_links_of_crowded_keys(spark, crowd):
    rng, fps = random.Random(3), set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    nodes = spark.createDataFrame([(signed(f),) for f in sorted(fps)], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.near_links(nodes, crowd)).collect()}
    want = clusters(sorted(signed(f) for f in fps), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {n: got.get(n, n) for n in want} == want


def test_golay_keys_share_one_up_to_two_bits():
    import numpy as np

    rng, code = random.Random(2), simhash.Golay()
    words = np.array([rng.getrandbits(23) for _ in range(500)], np.int64)
    assert all(int(e).bit_count() <= 3 for e in code.errors[code.syndrome(words)])  # the code is perfect
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(3)))
        rows, keys = simhash.golay_keys(np.array([a, b], np.uint64).astype(np.int64), code)
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50 + i) for i in range(30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 50 for i in [*range(51, 80), 100]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shards(spark, frame, rows):
    recs = shards.records(frame(rows))
    current = shards.first_map(shards.slot_sizes(recs), 16)
    got = shards.placed(recs, current).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append((r["slot"], r["size"]))
        assert 0 <= r["shard"] < 16
    for own in by.values():
        assert sorted(s for s, _ in own) == list(range(len(own)))
    if len(rows) > 100:
        loads = [sum(n for _, n in own) for own in by.values()]
        assert max(loads) - min(loads) <= max(n for own in by.values() for _, n in own)


def test_slot_map_versions(spark, frame, tmp_path):
    recs = shards.records(frame(docs_of(spark)))
    folder = str(tmp_path / "map")
    shards.store_map(shards.first_map(shards.slot_sizes(recs), 4), folder)
    first = {r["vslot"]: r["shard"] for r in shards.read_map(spark, folder).collect()}
    shards.store_map(shards.rebalanced(shards.read_map(spark, folder), 5), folder)
    second = {r["vslot"]: r["shard"] for r in shards.read_map(spark, folder).collect()}
    assert {r["vslot"]: r["shard"] for r in shards.read_map(spark, folder, 1).collect()} == first
    moved = {s for s in first if first[s] != second[s]}
    assert moved and all(second[s] == 4 for s in moved) and len(moved) < len(first) / 2
