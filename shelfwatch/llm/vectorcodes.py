"""Vector codes: product quantisation with integer codebooks, entries found by Orchard search.

Components become floor(SCALE * x). A vector is cut into PARTS equal parts; each part position has a codebook of
ENTRIES entries. A round assigns every part to its nearest entry and replaces each entry by the floored mean of
its parts. Sums of a round meet in Spark: a task gives one row per component of a codebook, so what reaches the
driver has the codebooks' size whatever the input's.

Orchard search: every entry has a list of the others by distance. From an entry at distance d, its list is walked;
an entry not visited yet is measured and marked, and if it is closer (or as close, with a lower index) the walk
goes on in its list. It stops at the first one more than 2d away, since nothing beyond can be as close. At
exactly 2d it goes on, so ties go to the lower index as in a full search. Many parts walk at once in numpy.

Defined results: vectors that are NULL, empty or hold NULL or non-finite components are dropped; all others must
have one length, a multiple of PARTS (else ValueError). A repeated vec_id seeds once, by its smallest vector; a NULL vec_id
comes after all others as a seed. With fewer ids than ENTRIES codebooks are shorter; without rows there are none.
Repeated rows are coded each and all count. NULL labels are one label. Components too large for long arithmetic are
computed with exact Python integers, and an error beyond a long is given as the largest long.
"""

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import BROADCAST_ROWS, saved

SCALE = 4096
PARTS = 8
ENTRIES = 16  # 256 at most: a code has one byte a part
ROUNDS = 6
MOST_LONG = (1 << 63) - 1
WHOLE = "decimal(38,0)"


def kept(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label, v: the usable vectors in integers."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & sound)
    return rows.select("vec_id", "label", F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).alias("v"))


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """rows x parts x width; Python integers where squared distances could pass a long."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), parts, -1)
    return _safe(flat)


def _safe(x: np.ndarray) -> np.ndarray:
    # 4 * width * (2 * most) ** 2 must stay below 2 ** 63.
    if x.dtype != object and x.size and max(-int(x.min()), int(x.max())) >= int((2**63 / (16 * x.shape[-1])) ** 0.5) - 1:
        return x.astype(object)
    return x


class Orchard:
    """Nearest entries of one codebook (entries x width)."""

    def __init__(self, book: np.ndarray):
        self.book = book
        apart = ((book[:, None] - book[None]) ** 2).sum(-1)
        others = [sorted((j for j in range(len(book)) if j != i), key=lambda j, i=i: (apart[i, j], j)) for i in range(len(book))]
        self.lists = np.array(others, np.int64).reshape(len(book), -1)
        self.apart = np.take_along_axis(apart, self.lists, 1) if len(book) > 1 else np.zeros((1, 0), np.int64)
        self.measured = 0  # distances computed so far

    def _distances(self, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        self.measured += len(x)
        return ((x - self.book[entries]) ** 2).sum(-1)

    def nearest(self, x: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of x; walks begin at `start`."""
        rows, many = np.arange(len(x)), self.lists.shape[1]
        best = np.zeros(len(x), np.int64) if start is None else start.astype(np.int64)
        near = self._distances(x, best)
        place, seen = np.zeros(len(x), np.int64), np.zeros((len(x), len(self.book)), bool)
        seen[rows, best] = True
        while many and len(rows):
            own = best[rows]
            go = self.apart[own, place[rows]] <= 4 * near[rows]
            rows, own = rows[go], own[go]
            entry = self.lists[own, place[rows]]
            place[rows] += 1
            new = ~seen[rows, entry]
            at, entry = rows[new], entry[new]
            seen[at, entry] = True
            d = self._distances(x[at], entry)
            closer = (d < near[at]) | ((d == near[at]) & (entry < best[at]))
            at = at[closer]
            best[at], near[at], place[at] = entry[closer], d[closer], 0
            rows = rows[place[rows] < many]
        return best, near


def nearest_entries(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows x parts x width the entries and squared distances, rows x parts. Books: entries x parts x width."""
    books = _safe(books)
    if books.dtype == object or x.dtype == object:
        books, x = books.astype(object), x.astype(object)
    found = [Orchard(books[:, p]).nearest(x[:, p]) for p in range(x.shape[1])]
    return np.stack([e for e, _ in found], 1), np.stack([d for _, d in found], 1)


def seeds(rows: DataFrame, entries: int = ENTRIES) -> list[list[int]]:
    """The vectors of the smallest ids, one an id. A task hands on `entries` rows at most."""

    def first(batches):
        least: dict = {}
        for batch in batches:
            ids = batch["vec_id"].to_pylist()
            some = set(sorted({(i is None, i or 0) for i in ids} | set(least))[:entries])
            least = {k: v for k, v in least.items() if k in some}
            for n, i in enumerate(ids):
                k = (i is None, i or 0)
                if k in some:
                    v = batch["v"][n].as_py()
                    least[k] = min(least.get(k, v), v)
        if least:
            yield pa.record_batch([pa.array([None if n else i for n, i in least], pa.int64()), pa.array(list(least.values()), pa.list_(pa.int64()))], ["vec_id", "v"])

    own = rows.select(F.col("vec_id").cast("long"), "v").mapInArrow(first, "vec_id long, v array<long>")
    found = own.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
    return [r["v"] for r in found.collect()]


def _sums(rows: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one assignment the parts per entry (entries x parts) and their sums (entries x parts x width)."""
    entries, parts, width = books.shape

    def run(batches):
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for batch in batches:
            x = _matrix(batch["v"], parts)
            found, _ = nearest_entries(x, books)
            for p in range(parts):
                count[p] += np.bincount(found[:, p], minlength=entries)
                order = np.argsort(found[:, p], kind="stable")
                used, heads = np.unique(found[order, p], return_index=True)
                if len(used):  # the sum of a batch of longs below the bound in _safe fits a long
                    total[p, used] += np.add.reduceat(x[order, p], heads, axis=0).astype(object)
        used = np.flatnonzero(np.repeat(count.reshape(-1), width))
        yield pa.record_batch(
            [pa.array(used, pa.int32()), pa.array(np.repeat(count.reshape(-1), width)[used], pa.int64()),
             pa.array([Decimal(int(v)) for v in total.reshape(-1)[used]], pa.decimal128(38, 0))], ["at", "n", "total"])

    each = rows.select("v").mapInArrow(run, f"at int, n long, total {WHOLE}")
    count, total = np.zeros(parts * entries * width, np.int64), np.zeros(parts * entries * width, object)
    for r in each.groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").cast(WHOLE).alias("total")).collect():
        count[r["at"]], total[r["at"]] = r["n"], int(r["total"])
    return count.reshape(parts, entries, width)[:, :, 0].T, total.reshape(parts, entries, width).transpose(1, 0, 2)


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """entries x parts x width; None without rows."""
    sizes = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if sizes["least"] is None:
        return None
    if sizes["least"] != sizes["most"] or sizes["least"] % parts:
        raise ValueError(f"vectors of {sizes['least']} to {sizes['most']} components; one length, a multiple of {parts}, is needed")
    books = np.array(seeds(rows, entries), np.int64).reshape(-1, parts, sizes["least"] // parts)
    for _ in range(rounds):
        count, total = _sums(rows, books)
        new = books.copy()
        for e, p in zip(*np.nonzero(count), strict=True):
            new[e, p] = [int(t) // int(count[e, p]) for t in total[e, p]]
        books = new
    return books


def books_sha256(books: np.ndarray | None) -> str:
    """Of all components by part, entry and place, joined by commas."""
    flat = [] if books is None else books.transpose(1, 0, 2).reshape(-1).tolist()
    return hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def encoded(rows: DataFrame, books: np.ndarray | None) -> DataFrame:
    """vec_id, label, code (binary, one byte a part), error."""
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            found, d = nearest_entries(_matrix(batch["v"], books.shape[1]), books)
            errors = pa.array([min(int(e), MOST_LONG) for e in d.sum(1)], pa.int64())
            codes = pa.array([r.tobytes() for r in found.astype(np.uint8)], pa.binary())
            yield pa.record_batch([batch["vec_id"], batch["label"], codes, errors], ["vec_id", "label", "code", "error"])

    if books is None:
        return rows.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(0).cast("long").alias("error"))
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long")


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id, embedding: what the codes stand for, in the middle of each integer step."""

    def run(batches):
        parts = books.shape[1]
        for batch in batches:
            found = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(-1, parts)
            x = (books[found, np.arange(parts)[None]].reshape(len(found), -1) + 0.5) / scale
            yield pa.record_batch([batch["vec_id"], pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], ["vec_id", "embedding"])

    return codes.select("vec_id", "code").mapInArrow(run, f"vec_id {dict(codes.dtypes)['vec_id']}, embedding array<float>")


def digest(vectors: DataFrame) -> DataFrame:
    rows = saved(kept(vectors), "vector-parts")  # read once a round
    books = codebooks(rows)
    codes = saved(encoded(rows, books), "vector-codes")
    # Errors meet per label in the map tasks first, so a label on a third of the rows is no load.
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast(WHOLE)).alias("total"))
    sums = sums.select("of", F.least("total", F.lit(MOST_LONG).cast(WHOLE)).cast("long").alias("label_error"))
    sums = F.broadcast(sums) if sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else sums
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same by plain full searches, all rounds spelled out."""
    steps = [f"""k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER () AS rid, embedding AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""p AS MATERIALIZED (SELECT rid, (i - 1) // w AS part, (i - 1) % w AS pos, CAST(floor({SCALE} * CAST(v[i] AS DOUBLE)) AS BIGINT) AS x
        FROM (SELECT rid, v, len(v) // {PARTS} AS w, unnest(range(1, len(v) + 1)) AS i FROM k) u)""",
        f"""b0 AS MATERIALIZED (SELECT part, entry, pos, x FROM p JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k
        QUALIFY entry < {ENTRIES}) s USING (rid))"""]
    for n in range(ROUNDS + 1):
        steps.append(f"""d{n} AS MATERIALIZED (SELECT rid, part, arg_min(entry, {{'d': d, 'e': entry}}) AS entry, min(d) AS d FROM (
        SELECT p.rid, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS d FROM p JOIN b{n} b ON b.part = p.part AND b.pos = p.pos GROUP BY 1, 2, 3) g GROUP BY 1, 2)""")
        if n < ROUNDS:
            steps.append(f"""b{n + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN (
        SELECT p.part, d.entry, p.pos, CAST((sum(p.x) - (sum(p.x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
        FROM p JOIN d{n} d USING (rid, part) GROUP BY 1, 2, 3) m USING (part, entry, pos))""")
    last = ROUNDS
    return "WITH " + ",\n".join(steps) + f""",
        c AS (SELECT rid, string_agg(printf('%02x', CAST(entry AS INT)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM d{last} GROUP BY 1)
        SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{last}) AS codebooks_sha256
        FROM k JOIN c USING (rid)"""


SQL = _sql()
