"""Secret scan: fixed patterns, and windowed entropy over candidate strings.

A candidate is a run of SHORT key characters or more with letters and digits, or small and capital letters, in it. Per
character class, a window slides over it with one count per character: each step adds the entering and takes off the
leaving one, so the entropy follows from the last one's sum. A candidate whose highest window entropy reaches its class's
bound is a span, unless the allow-list names it as a whole. One too short for the wide window is judged by a narrower one,
and only if it holds small letters, capitals and digits, as short names often hold two of them.

Defined results: a very long text or candidate is gone through once, by counts of fixed size; NULL texts are empty; empty texts have no spans; equal rows have equal results. Offsets are
code points, ends exclusive.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import steps, text_of

# Kinds in order, patterns and least lengths of the base spans.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_text"]

SHORT = 16
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{SHORT},}}"


def _opening(run: str, least: int) -> str:
    """Matches an opening of `run` of at least that many characters."""
    out = ""
    for c in reversed(run[least:]):
        out = f"(?:{c}{out})?"
    return run[:least] + out


_SMALL = "abcdefghijklmnopqrstuvwxyz"
# Known to be no secrets: identifiers, whole counting runs, numbered words, names of capitalised words. Possessive, so that
# long runs need no stack.
ALLOWED = "|".join([
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    f"(?:{_opening('0123456789', 10)}|{_opening(_SMALL, 6)}|{_opening(_SMALL.upper(), 6)})++[0-9]{{0,4}}",
    r"(?:[A-Za-z]++[/_-])++[0-9]{1,4}", r"[a-z]*+(?:[A-Z][a-z]++)++[0-9]{0,4}",
])
# class: characters, window, least entropy in bits
CLASSES = {
    "entropy_hex": ("0123456789abcdef", 16, 2.9),
    "entropy_text": (_SMALL.upper() + _SMALL + "0123456789+/_=-", 20, 3.7),
}
SHORT_BITS = 3.5  # for text below that window, in one of SHORT characters
BLOCK = 256


def _sums(values: Column) -> Column:
    """Running sums, inclusive. In blocks, so that a text with very many finds stays cheap."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    count = F.size(values)
    blocks = F.transform(steps(F.ceil(count / BLOCK)), lambda b: total(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
    before = F.aggregate(
        blocks, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    )

    def running(sums: Column) -> Column:
        return F.transform(steps(count), lambda i: F.get(sums, F.floor(i / BLOCK).cast("int")) + total(
            F.slice(values, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1)))

    return F.get(F.transform(F.array(before), running), F.lit(0))


def found(text: Column, pattern: str, there: str) -> Column:
    """array<struct<start, end, match>> of the leftmost matches that do not overlap.

    Gaps come from a split at the same matches; starts are running sums of gaps and matches. Texts without
    `there`, a cheaper test, are passed over.
    """
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(pair: Column) -> Column:
        g, m = pair["g"], pair["m"]
        grown = F.transform(m, lambda _, i: (F.char_length(F.get(g, i)) + F.when(i > 0, F.char_length(F.get(m, i - 1))).otherwise(0)).cast("long"))
        return F.transform(F.arrays_zip(_sums(grown).alias("s"), m.alias("m")), lambda z: F.struct(
            z["s"].alias("start"), (z["s"] + F.char_length(z["m"])).alias("end"), z["m"].alias("match")))

    some = F.get(F.transform(F.array(F.struct(gaps.alias("g"), matches.alias("m"))), spans), F.lit(0))
    return F.when(text.rlike(there), some).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,match:string>>"))


def _gain(count: Column, window: int) -> Column:
    """(c + 1) log2 (c + 1) - c log2 c, from a table."""
    value = [0.0, 0.0] + [c * math.log2(c) for c in range(2, window + 2)]
    return F.get(F.array(*[F.lit(value[c + 1] - value[c]) for c in range(window + 1)]), count)


def top_entropy(text: Column, alphabet: str, window: int) -> Column:
    """The highest Shannon entropy, in bits, of any `window` neighbouring characters; 0 for shorter strings."""

    def step(state: Column, i: Column, codes: Column) -> Column:
        enters, leaves = F.get(codes, i), F.when(i >= window, F.get(codes, i - window)).otherwise(-1)
        counts = state["counts"]
        change = F.when(enters == leaves, 0.0).otherwise(
            _gain(F.get(counts, enters), window) - F.coalesce(F.when(leaves >= 0, _gain(F.get(counts, leaves) - 1, window)), F.lit(0.0)))
        moved = F.transform(counts, lambda c, k: c + (k == enters).cast("int") - (k == leaves).cast("int"))
        held = state["held"] + change
        now = F.lit(math.log2(window)) - held / window
        return F.struct(moved.alias("counts"), held.alias("held"),
                        F.when(i >= window - 1, F.greatest(state["best"], now)).otherwise(state["best"]).alias("best"))

    start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("held"), F.lit(0.0).alias("best"))
    # Codes are looked up once per character, so that a step does not walk the string.
    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    best = lambda own: F.aggregate(steps(F.char_length(text)), start, lambda state, i: step(state, i, own), lambda s: s["best"])
    return F.get(F.transform(F.array(codes), best), F.lit(0))


def _kept(spans: Column, keep) -> Column:
    return F.filter(spans, lambda s: keep(s["match"]))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id and one array of spans per kind."""
    text = F.col("text")
    rows = docs.select("doc_id", text_of().alias("text")).select(
        "doc_id",
        _kept(found(text, ASSIGN, r"(?i)passw|secret|token|api_?key"),
              lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 12).alias("assign"),
        _kept(found(text, ACCESS, "AKIA"), lambda m: F.char_length(m) >= 18).alias("access"),
        found(text, r"[0-9a-f]{16,}", r"[0-9a-f]{16}").alias("hex"),
        _kept(found(text, CANDIDATE, CANDIDATE), lambda m: m.rlike("[A-Za-z]") & (m.rlike("[0-9]") | m.rlike("[A-Z]") & m.rlike("[a-z]")) & ~m.rlike(f"^(?:{ALLOWED})$")).alias("candidates"),
    )
    is_hex = lambda m: m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    entropy = lambda m, kind: top_entropy(m, *CLASSES[kind][:2]) >= CLASSES[kind][2]
    alphabet, wide, _ = CLASSES["entropy_text"]
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
    in_text = lambda m: F.when(F.char_length(m) >= wide, entropy(m, "entropy_text")).otherwise(mixed(m) & (top_entropy(m, alphabet, SHORT) >= SHORT_BITS))
    return rows.select(
        "doc_id", "assign", "access", "hex",
        _kept(F.col("candidates"), lambda m: is_hex(m) & entropy(F.lower(m), "entropy_hex")).alias("entropy_hex"),
        _kept(F.col("candidates"), lambda m: ~is_hex(m) & in_text(m)).alias("entropy_text"),
    )


def listed(kinds: list[str]) -> Column:
    """kind:start:end of the spans by start, then kind, comma-joined."""
    def of(order: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    parts = [of(order, kind) for order, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scanned(docs: DataFrame) -> DataFrame:
    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return spans(docs).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(listed(KINDS[:3]).cast("binary"), 256).alias("base_sha256"), listed(KINDS).alias("spans"),
    )
