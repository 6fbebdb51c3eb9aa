"""Line dedup and decontamination against plain Python; the scoring operators by held-out accuracy; the pipeline."""

import math
import re
import random
import zlib
from collections import Counter, defaultdict

import pytest
from corpus_help import DATA, frame  # noqa: F401
from test_exact import ODD, docs_of

import corpus_pipeline
from shelfwatch.llm import decontaminate, linededup, nearcopies, quality, toxicity

FIRST = "/root/testdata/sf0.01"


def plain_dedup(rows, gram_words=linededup.GRAM_WORDS, run_words=linededup.RUN_WORDS):
    """Numbers of the deleted lines of each different document."""
    docs, grams = {}, {}
    for i, t in rows:
        docs[i, t or ""] = (t or "").split("\n")
    for d, lines in docs.items():
        words, ends = [len(x.split()) for x in lines], {}
        for s in range(len(lines)):
            e = next((e for e in range(s + 1, len(lines) + 1) if sum(words[s:e]) >= gram_words), None)
            if e:
                ends[s] = e
        hashes, _ = linededup.lines_of("\n".join(lines))
        code = dict((p, g) for g, p in linededup.anchors(hashes, words, gram_words, 0))  # windows of one gram: all of them
        chosen = set()
        for s in ends:
            span = [j for j in ends if j >= s and (j == s or sum(words[s : ends[j]]) <= run_words)]
            chosen.add(min(span, key=lambda j: (code[j], j)))
        grams[d] = {(code[s], s) for s in chosen}
    return docs, grams


@pytest.mark.parametrize("which", ["table", "odd", "empty"])
def test_line_dedup(spark, frame, which):
    rows = {"table": lambda: docs_of(spark), "odd": lambda: ODD + [(i, "one two three\n" + " x" * 30 + "\nlast " + str(i)) for i in (20, 21, 22)], "empty": list}[which]()
    docs, grams = plain_dedup(rows)
    key = {(r["doc_id"], r["text"] or ""): r["key"] for r in frame(rows).select("doc_id", "text", linededup.text_key().alias("key")).collect()}
    order = lambda d: (d[0] is None, d[0] or 0, key[d])
    first = {}
    for d, own in grams.items():
        for g, s in own:
            if g not in first or (*order(d), s) < (*order(first[g][0]), first[g][1]):
                first[g] = (d, s)
    gone = defaultdict(set)
    for d, own in grams.items():
        for g, s in own:
            e, a = first[g]
            if (*order(e), a) >= (*order(d), s):
                continue
            x, y = [[z.strip() for z in docs[k]] for k in (d, e)]
            lo, hi = s, s
            while lo > 0 and a - (s - lo) > 0 and x[lo - 1] == y[a - (s - lo) - 1]:
                lo -= 1
            while hi + 1 < len(x) and a + hi + 1 - s < len(y) and x[hi + 1] == y[a + hi + 1 - s]:
                hi += 1
            if sum(len(z.split()) for z in x[lo : hi + 1]) >= linededup.RUN_WORDS:
                gone[d] |= set(range(lo, hi + 1))
    want = Counter((i, len(docs[i, t or ""]), len(gone[i, t or ""]), "\n".join(z for n, z in enumerate(docs[i, t or ""]) if n not in gone[i, t or ""])) for i, t in rows)
    assert Counter((r["doc_id"], r["n_lines"], r["n_deleted"], r["text"]) for r in linededup.report(frame(rows)).collect()) == want
    kept = linededup.deduped(frame(rows))
    assert kept.columns == frame(rows).columns and kept.count() == sum(
        n for (i, t), n in Counter(rows).items() if not gone[i, t or ""] or len(gone[i, t or ""]) < len(docs[i, t or ""]) and any(
            z.strip() for m, z in enumerate(docs[i, t or ""]) if m not in gone[i, t or ""]))


def lines_that_stand_earlier(docs, order, run_words):
    """By definition: the lines of every document that lie in a long run which also stands at an earlier place."""
    gone, each = defaultdict(set), [(d, [z.strip() for z in own]) for d, own in sorted(docs.items(), key=lambda x: order(x[0]))]
    for n, (d, x) in enumerate(each):
        for m, (_, y) in enumerate(each[: n + 1]):
            for shift in range(1 if m == n else 1 - len(y), len(x)):
                run = []
                for i in range(max(0, shift), len(x) + 1):
                    if i < min(len(x), len(y) + shift) and x[i] == y[i - shift]:
                        run.append(i)
                        continue
                    if sum(len(x[j].split()) for j in run) >= run_words:
                        gone[d].update(run)
                    run = []
    return gone


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_repeated_run_goes(spark, frame, seed):
    """Few different lines of very different lengths, so that first places often have less in common than later ones."""
    rng = random.Random(seed)
    pool = [" ".join(f"w{n}x{k}" for k in range(size)) for n, size in enumerate([1, 2, 4, 5, 7, 9, 12, 16, 20, 31])] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    rows += [(None, rows[3][1]), (70, None), (71, ""), rows[5]]
    docs = {(i, t or ""): (t or "").split("\n") for i, t in rows}
    key = {(r["doc_id"], r["text"] or ""): r["key"] for r in frame(rows).select("doc_id", "text", linededup.text_key().alias("key")).collect()}
    gone = lines_that_stand_earlier(docs, lambda d: (d[0] is None, d[0] or 0, key[d]), linededup.RUN_WORDS)
    left = lambda d: "\n".join(z for n, z in enumerate(docs[d]) if n not in gone[d])
    want = Counter((i, len(gone[i, t or ""]), left((i, t or ""))) for i, t in rows)
    assert Counter((r["doc_id"], r["n_deleted"], r["text"]) for r in linededup.report(frame(rows)).collect()) == want


def test_later_places_with_more_in_common(frame):
    line = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    shared, more = line("s", 16), line("m", 25)
    rows = [(0, "\n".join([line("a", 20), shared, line("b", 20)])), (1, "\n".join([line("c", 9), shared, more])), (2, "\n".join([shared, more, line("d", 9)]))]
    assert {r["doc_id"]: r["n_deleted"] for r in linededup.report(frame(rows)).collect()} == {0: 0, 1: 0, 2: 2}


def test_long_passages_go_once(frame):
    rng = random.Random(4)
    line = lambda n: " ".join("w" + str(rng.randrange(10**6)) for _ in range(n))
    passage = [line(20), line(12), line(30)]
    rows = [(i, "\n".join([line(9), *passage, line(9)])) for i in range(6)] + [(9, line(60))]
    left = {r["doc_id"]: r["n_deleted"] for r in linededup.report(frame(rows)).collect()}
    assert left == {0: 0, 1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 9: 0}


ITEM = "On monday Tom gave 3 apples and 12 pears to Mary and then Tom ate 3 of the apples that Mary had kept for 5 days"


def test_templates_with_other_values(spark, frame):
    items = spark.createDataFrame([(1, ITEM, "x"), (2, None, "x"), (3, "", "x"), (4, "tiny item", "x")], "item_id long, text string, _key string")
    docs = [
        (10, "Some words. " + ITEM + " and more."),
        (11, "before " + ITEM.replace("Tom", "Ann").replace(" 3 ", " 8 ").replace("Mary", "Bob") + " after"),
        (12, ITEM.replace("Tom gave 3", "Ann gave 8").replace("12", "4").replace("to Mary", "to Bob").replace("Tom ate 3", "Zed ate 9").replace("that Mary", "that Kim")),
        (13, "nothing of the kind is said here at all, not even about 3 apples"),
        (14, None), (15, ""), (None, "x " + ITEM), (16, "a tiny item here"), (10, "other text"),
    ]
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.report(frame(docs), items).collect()}
    assert set(got) == {(10, 1), (11, 1), (None, 1), (16, 4)} and got[10, 1] and not got[11, 1]
    left = decontaminate.clean(frame(docs), items)
    assert left.columns == frame(docs).columns
    assert sorted(r["doc_id"] for r in left.collect()) == [10, 12, 13, 14, 15]
    assert decontaminate.report(frame(docs), items.filter("false")).count() == 0
    assert decontaminate.report(frame([]), items).count() == 0


def test_names_at_sentence_starts_whole_numbers_and_other_case(spark, frame):
    """Questions with other names and numbers, also at sentence starts, and copies in other case."""
    books = "Anna had 12 books. Ben had 7 books. Anna lost 3 books. Ben found 5 books. Who has more?"
    train = "The train covers 1,200 miles in 3.5 hours and then covers 450.5 miles in 6.5 hours, so how fast is it?"
    items = spark.createDataFrame([(1, books), (2, train), (3, ITEM)], "item_id long, text string")
    swap = lambda t, by: re.sub("|".join(map(re.escape, by)), lambda m: by[m[0]], t)
    docs = [
        (1, '"' + swap(books, {"Anna": "Lily", "Ben": "Max", "12": "31", "7": "44", "3": "9", "5": "2"})),
        (2, swap(train, {"1,200": "900", "3.5": "4", "450.5": "300", "6.5": "7"})),
        (3, "SOME TEXT. " + ITEM.upper()),
        (4, swap(books, {"Ben had": "Max had", "Ben found": "Tim found", "12": "31", "7": "31", "3": "31", "5": "2"})),
        (5, ITEM.lower()),
        (6, "Some other story about miles and hours. Nobody had books."),
    ]
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.report(frame(docs), items).collect()}
    assert got == {(1, 1): False, (2, 2): False, (3, 3): True, (5, 3): True}


def test_numbers_in_words(spark, frame):
    """A question whose numbers are spelled out, changed or not, and as digits."""
    item = "A farmer keeps three goats and twenty-five hens in a barn while seven of the hens lay five eggs every day of the week"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [(1, item), (2, item.replace("three", "seven").replace("seven of", "six of").replace("five eggs", "nine eggs").replace("twenty-five", "forty")),
            (3, item.replace("three", "3").replace("seven", "7").replace("five eggs", "5 eggs").replace("twenty-five", "25")),
            (4, "Three of seven people said that ten goats and five hens were in the barn of the farmer")]
    got = {r["doc_id"]: r["exact"] for r in decontaminate.report(frame(docs), items).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_columns_of_any_name_pass_through(spark, frame):
    """Every stage that keeps columns gives back those it uses names of itself."""
    names = ["_own_key", "_score", "_lines", "_gone", "_nth", "_doc", "_id", "_key", "_kept_id", "_kept_key", "_gone_id", "_gone_key", "key", "node", "root", "words", "label", "hash", "_text"]
    for rows in (ODD, []):
        docs = frame(rows)
        for n, name in enumerate(names):
            docs = docs.withColumn(name, docs["text"] if n % 2 else docs["doc_id"] + n)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns, name
            for r in out.collect():
                for n, c in enumerate(names):
                    if n % 2 == 0:
                        assert r[c] == (None if r["doc_id"] is None else r["doc_id"] + n), (name, c)


def test_one_training_row_an_id(spark):
    """An id that stands many times is learnt from once, so the bound of rows holds."""
    from shelfwatch.llm.labelled import training_rows

    a, b, c = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:3]
    docs = spark.range(5000).selectExpr(f"{a}L AS doc_id", "concat('text ', id % 7) AS text").unionByName(spark.createDataFrame([(b, "x"), (c, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(a, 1), (a, 0), (b, 0), (c, 1), (None, 1)], "doc_id long, toxic int")
    for bound in (3, 1):
        assert training_rows(docs, labels, "toxic", bound).count() == bound
    only = training_rows(docs.filter(f"doc_id = {a}"), labels, "toxic").collect()
    assert len(only) == 1 and only[0]["label"] == 1


def test_big_benchmarks_are_shuffled(spark, frame, monkeypatch):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 1)
    assert [r["doc_id"] for r in decontaminate.report(frame([(1, "a " + ITEM), (2, "b")]), items).collect()] == [1]


def test_leaks_of_the_table(spark):
    """The tables hold no numbers in passages: exact word runs, found in plain Python."""
    docs, items = spark.read.parquet(f"{FIRST}/documents.parquet"), spark.read.parquet(f"{FIRST}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.report(docs, items).collect()}
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    texts = {r["item_id"]: words(r["text"]) for r in items.collect()}
    want = {(d["doc_id"], i) for d in docs.collect() for t in [words(d["text"])] for i, x in texts.items() if x in t}
    assert got == want


def held_out(spark, digest, label):
    docs, labels = spark.read.parquet(f"{FIRST}/documents.parquet"), spark.read.parquet(f"{FIRST}/labels.parquet")
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    rows = digest(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    rows = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) > 80
    return sum(r["predicted"] == truth[r["doc_id"]] for r in rows) / len(rows)


def test_quality_held_out(spark):
    assert held_out(spark, quality.digest, "quality") > 0.93


def test_toxicity_held_out(spark):
    assert held_out(spark, toxicity.digest, "toxic") > 0.93


def test_folds_boundaries_and_exceptions():
    machine = toxicity.automaton({"idiot": 5.0, "trash": 4.0})
    hit = lambda t: toxicity.hits(t, machine)[1]
    assert hit("an IDIOT") == hit("1d10t") == hit("іdiоt$$$") == hit("ｉｄｉｏｔ!") == 1
    assert hit("idiotic") == hit("the trash can") == hit("") == 0 and hit("trash, idiot") == 2


@pytest.mark.parametrize("text", ["sТupid", "SТUРID", "Κill IDIОТ", "idiоТ", "stúpid", "stu\u0301pid", "1d!ot", "ID!0T", "ｓｔｕｐｉｄ", "you idiot!", "мoron", "ΜΟRΟΝ", "m0r0n", "lo5er", "scüm"])
def test_disguised_words_are_found(text):
    machine = toxicity.automaton(toxicity.SEEDS)
    assert toxicity.hits(text, machine)[1] == 1
    low = toxicity.lowered(text)
    assert len(toxicity.folded(low)) == len(low)


@pytest.mark.parametrize("text", ["idiotisch", "wow!!! great", "Идиот", "8 9 10!", "", "losers", "the pond scum"])
def test_plain_words_are_left_alone(text):
    assert toxicity.hits(text, toxicity.automaton(toxicity.SEEDS))[1] == 0


@pytest.mark.parametrize("operator,label", [(quality, "quality"), (toxicity, "toxic")])
def test_scores_of_odd_rows(spark, frame, operator, label):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(i % 20, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (4, None, None)], none.schema)):
        rows = operator.digest(frame(ODD), labels).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert operator.digest(frame([]), none).count() == 0


def test_pooled_vectors_against_loops():
    import numpy as np

    text = b"The cat!! saw the CAT. 12 cats"
    index, sums = quality.index_vectors(), np.zeros((quality.BUCKETS, quality.WIDTH), np.float32)
    want = sums.copy()
    codes = []
    for ids in quality.streams(text):
        for a, b in zip(ids, ids[1:], strict=False):
            want[a] += index[b]
            want[b] += index[a]
        codes.append(ids[:-1].astype(np.int64) * quality.BUCKETS + ids[1:])
    quality.add_contexts(sums, index, np.concatenate(codes))
    assert np.allclose(sums, want)
    words = quality.streams(text)[0]
    got = quality.pooled(text, index)
    assert np.allclose(got[: quality.WIDTH], index[words].mean(0), atol=1e-5) and got[-3] == pytest.approx(math.log1p(len(words)))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    seen = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.columns == docs.columns
            now = {r["doc_id"] for r in out.collect()}
            assert now <= seen and len(now) > len(seen) / 2
            seen, docs = now, out
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()} == seen


def test_stages_on_odd_and_empty_rows(spark, frame):
    for rows in (ODD, []):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame(rows), DATA)
            assert out.count() <= len(rows) + 50
            if name == "near_dedup" and rows:
                assert len({(r["doc_id"], r["text"]) for r in out.collect()}) == out.count()


def test_near_copies_of_five_words(spark, frame):
    """Planted copies and near misses, a crowd and odd rows against all pairs in plain Python."""
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(12):
        base = words(rng.randrange(60, 300))
        rows.append((len(rows), " ".join(base)))
        for share in (0.005, 0.015, 0.04, 0.1):
            rows.append((len(rows), " ".join(w if rng.random() > share else "x" + w for w in base)))
    crowd = words(200)
    for _ in range(60):
        at = rng.randrange(200)
        rows.append((len(rows), " ".join([*crowd[:at], words(1)[0], *crowd[at + 1 :]])))
    rows += [(None, rows[0][1]), (900, ""), (901, None), (902, "a b c"), (903, "A  b c"), (904, "a b d")]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    groups = {}
    for (i, _), r in zip(rows, root, strict=True):
        groups.setdefault(r, []).append((i is None, i))
    want = sorted(min(g)[1] for g in groups.values())
    assert len(want) < len(rows) - 70
    out = corpus_pipeline.near_dedup(spark, frame(rows), DATA)
    assert out.columns == frame(rows).columns and sorted(r["doc_id"] for r in out.collect()) == want


def test_crowds_split_like_pairs(frame):
    """The way over leaders gives the groups of all pairs, also where copies drift away from each other."""
    rng = random.Random(8)
    text, rows = [f"w{rng.randrange(10**6)}" for _ in range(120)], []
    for i in range(40):
        text[rng.randrange(120)] = f"v{i}"
        rows.append((i, " ".join(text)))

    def groups(crowd):
        by = {}
        for r in nearcopies.clustered(frame(rows), crowd).collect():
            by.setdefault(r["root"], set()).add(r["doc_id"])
        return sorted(map(sorted, by.values()))

    assert groups(2) == groups(1000) == [list(range(40))]
