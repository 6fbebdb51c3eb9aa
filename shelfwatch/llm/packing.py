"""Packing by minimum bin slack.

A document is cut at every full window; what is left over (its remainder, shorter than a window) is
packed. The remainders are known as a multiset of lengths, at most window - 1 different ones. Each step
takes the longest remaining length and finds, by subset sums held in one integer's bits, the lengths that
fill the window closest to its end; backtracking gives how many of each. That filling is used as often as
its lengths last, so the plan has a few rows per length however many documents there are. Only this
histogram and the plan pass through the driver; pieces are ranked and placed by Spark.

Defined results: a NULL or empty text is the end token alone; repeated rows are packed each; a NULL id is
kept; an empty table gives no pieces.
"""

import functools
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.llm.common import saved, small, text_of

WINDOW = 2048
END = 1
RANK_SHARDS = 32  # least number of sub-groups in which pieces of one length are counted
SHARD_PIECES = 1_000_000  # pieces of a sub-group, about, where a length has more
CACHED_WORDS = 400_000  # per Python worker

# Texts of these characters alone are split here as the tokenizer's own rules do; others go to it whole.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-įĲ-ňŊ-ž€¡¿«»–—‘’“”…]*")
_LETTER = "a-zß-öø-ÿā-įĳ-ňŋ-ž"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\\s{_LETTER}0-9]+")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordIds:
    """Token ids of texts as little-endian bytes, with the ids of words seen before kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """As _encoded for single words, in lines of many; a word's last token says that it is the last."""
        out = []
        for at in range(0, len(words), 512):
            ids = self._encoded([" ".join(words[at : at + 512])])[0]
            cuts = (4 * (np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1)).tolist()
            out += [ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        plain = [_WORD.findall(t.lower()) if "<|" not in t and _PLAIN.fullmatch(t) else None for t in texts]
        new = set()
        for words in plain:
            new.update(words or ())
        new = list(new.difference(self.known))
        self.known.update(zip(new, self._words(new), strict=True))
        get = self.known.__getitem__
        out = [self._encoded([t])[0] if w is None else b"".join(map(get, w)) for t, w in zip(texts, plain, strict=True)]
        if len(self.known) > CACHED_WORDS:  # full: this call's new words are not kept
            for w in new:
                del self.known[w]
        return out


@functools.cache
def word_ids(path: str) -> WordIds:
    """One per Python worker, which serves many tasks."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens. Only the last piece is under a window."""
    end = np.asarray([END], "<u4").tobytes()

    def cut(batches):
        encode = word_ids(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for doc_id, ids in zip(part["doc_id"].to_pylist(), encode(part["text"].to_pylist()), strict=True):
                    ids += end
                    for start in range(0, len(ids), 4 * window):
                        own = ids[start : start + 4 * window]
                        out.append((doc_id, start // 4, len(own) // 4, zlib.crc32(own), len(ids) // 4))
                yield pa.record_batch(
                    [pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, PIECES)


def best_filling(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill `room` as far as can be: bounded subset sums, then backtracking."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, k = left - take, k * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] += take
            at -= length * take
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, copies in a sequence, first sequence, offset of the first copy) per use of a length.

    The copies of a length are numbered by rank. Sequences are numbered from 0.
    """
    left, used, rows, sequence = dict(counts), defaultdict(int), [], 0
    while left:
        longest = max(left)
        rest = {n: c for n, c in left.items() if n != longest or c > 1}
        if longest in rest:
            rest[longest] -= 1
        filling = best_filling(rest, window - longest)
        filling[longest] += 1
        times = min(left[n] // c for n, c in filling.items())
        offset = 0
        for n in sorted(filling, reverse=True):
            rows.append((n, used[n], filling[n], sequence, offset))
            offset += n * filling[n]
            used[n] += times * filling[n]
            left[n] -= times * filling[n]
            if not left[n]:
                del left[n]
        sequence += times
    return rows


def ranked(cut: DataFrame, counts: DataFrame, shards: int = RANK_SHARDS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """rank: number of the piece among those of its length, gapless from 0. `counts`: length, count.

    Counted within (length, shard), since one length may hold a third of all pieces or far more than a task
    should sort; their starts are at most window x shards rows and one for every `shard_pieces` pieces.
    """
    shares = counts.select("length", F.greatest(F.lit(shards), F.ceil(F.col("count") / shard_pieces)).alias("_shards"))
    rows = cut.join(F.broadcast(shares), "length").withColumn("_shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "_shards"))
    sizes = rows.groupBy("length", "_shard").agg(F.count("*").alias("_n"))
    start = F.sum("_n").over(Window.partitionBy("length").orderBy("_shard")) - F.col("_n")
    place = F.row_number().over(Window.partitionBy("length", "_shard").orderBy("doc_id", "start", "ids_crc32"))
    starts = small(saved(sizes.select("length", "_shard", start.alias("_start")), "piece-starts"))
    return rows.withColumn("_place", place).join(starts, ["length", "_shard"]).select(
        *cut.columns, (F.col("_start") + F.col("_place") - 1).alias("rank"))


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """The pieces with sequence_id and offset. Tokenises once: the pieces are written before they are counted."""
    cut = saved(pieces(docs, tokenizer, window), "pieces")
    lengths = saved(cut.groupBy("length").count(), "piece-lengths")  # at most `window` rows
    counts = {r["length"]: r["count"] for r in lengths.collect()}
    rows = sorted(plan(counts, window))
    length, first, copies, sequence, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
    keys = (length << 40) + first

    def place(batches):
        for batch in batches:
            n, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(keys, (n << 40) + rank, "right") - 1
            nth = rank - first[at]
            columns = [batch[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            columns += [pa.array(sequence[at] + nth // copies[at]), pa.array(offset[at] + nth % copies[at] * n)]
            yield pa.record_batch(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked(cut, lengths).mapInArrow(place, PIECES + ", sequence_id long, offset long")
