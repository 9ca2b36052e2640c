"""Packing token sequences as a cutting-stock problem.

Documents are tokenised and cut into pieces of at most ``CAPACITY`` ids.  The histogram of piece lengths, in units of
``GRAIN`` ids, is the demand of a cutting-stock problem: a linear program over patterns (which lengths share a sequence),
whose columns a knapsack dynamic program prices.  The rounded patterns become numbered slots, and the pieces, ranked
within their length, take them by arithmetic: what the driver sees is a histogram of at most CAPACITY / GRAIN counts.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, spread, table

CAPACITY, GRAIN, END_ID, SALT_ROWS = 4096, 16, 2, 5000
TOKENIZER = "word_bpe_49k.json"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _class(kinds: str) -> str:
    """The characters of these general categories below U+0250 as the inside of a regular expression class."""
    return "".join(re.escape(c) for c in map(chr, range(0x250)) if unicodedata.category(c)[0] in kinds)


def _known() -> str:
    small = [c for c in map(chr, range(0x250)) if (c < "\x1c" or " " <= c < "\x7f" or c >= "\xa0") and all(x < "\u0250" for x in c.lower())]
    return "".join(map(re.escape, small))


#: Texts of other characters are left to the tokenizer as a whole.  These are in composed form, stay so in lower case, and
#: their categories are old enough to be the same everywhere.
OTHER = re.compile(f"[^{_known()}\u2010-\u2027\u20ac]")
#: The tokenizer's own division of lower-case text: letters, single digits, endings after an apostrophe, the rest.
PARTS = re.compile(f"[{_class('L')}]+|[{_class('N')}]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r \xa0{_class('LN')}]+")


class WordIds(dict):
    """Ids as little-endian 32-bit bytes, from those of the words, digits and signs that the tokenizer divides a text into.

    It never merges across these parts, so each is encoded once and kept, for at most about ``most`` parts; the new
    parts of a text are encoded in one call.
    """

    def __init__(self, path: str, most: int = 300_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.most = Tokenizer.from_file(path), most
        # The same model for parts that are already divided and in lower case.
        self.plain = Tokenizer(self.tok.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def ids(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, parts: list[str]) -> None:
        e = self.plain.encode(" ".join(parts), add_special_tokens=False)
        ids, word = np.array(e.ids, "<u4"), np.array(e.word_ids)
        cuts = np.searchsorted(word, np.arange(len(parts) + 1))
        if len(word) and word[-1] + 1 == len(parts) and (np.diff(cuts) > 0).all():
            data = ids.tobytes()
            self.update((p, data[4 * i : 4 * j]) for p, i, j in zip(parts, cuts[:-1].tolist(), cuts[1:].tolist()))
        else:
            self.update((p, self.ids(p)) for p in parts)

    def text(self, text: str) -> bytes:
        if "<|" in text or OTHER.search(text):
            return self.ids(text)
        parts = PARTS.findall(text.lower())
        if len(self) > self.most:
            self.clear()
        if new := [p for p in set(parts) if p not in self]:
            self.learn(new)
        return b"".join(map(self.__getitem__, parts))


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: the pieces of every row, cut every ``capacity`` ids.

    Null text is empty, whose ids are the end id alone.  Rows with equal doc_id are packed each for itself.
    """

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, end = WordIds(path), np.array([end_id], "<u4").tobytes()
        for part in parts:
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"]):
                data = words.text(text or "") + end
                n = len(data) // 4
                for start in range(0, n, capacity):
                    piece = data[4 * start : 4 * (start + capacity)]
                    rows.append((None if pd.isna(doc_id) else int(doc_id), start, len(piece) // 4, zlib.crc32(piece), n))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInPandas(task, PIECES)


def _price(gain: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best pattern for the given gains (gain[u - 1] for an item of u units): an unbounded knapsack."""
    best, take = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    rev = gain[::-1]  # rev[len - u] is the gain of u
    for c in range(1, room + 1):
        w = min(c, len(gain))
        v = best[c - w : c] + rev[len(gain) - w :]
        j = int(v.argmax())
        best[c], take[c] = (v[j], w - j) if v[j] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    pattern, c = np.zeros(len(gain), np.int64), room
    while c:
        if take[c]:
            pattern[take[c] - 1] += 1
            c -= take[c]
        else:
            c -= 1
    return float(best[room]), pattern


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse of a square matrix by elimination with row pivots."""
    m = len(a)
    both = np.hstack([a.astype(float), np.eye(m)])
    for c in range(m):
        p = c + int(np.abs(both[c:, c]).argmax())
        both[[c, p]] = both[[p, c]]
        both[c] /= both[c, c]
        rest = both[:, c].copy()
        rest[c] = 0.0
        both -= rest[:, None] * both[c]
    return both[:, m:]


def column_generation(demand: np.ndarray, room: int, gap: float = 1e-3, rounds: int = 6000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, covering ``demand[u - 1]`` items of u units exactly.

    Revised simplex on the set-partitioning form: the first basis has a pattern for each length, duals price
    columns, and the search ends when the knapsack shows (Farley's bound) that no solution uses ``gap`` less.
    Fractions are rounded down and what remains, at most one pattern's items for each length, is filled
    largest first.  Products are summed by numpy itself: threaded BLAS and LAPACK calls can hang in a process that has
    forked, as a Spark driver has.
    """
    used = np.flatnonzero(demand)
    if not len(used):
        return []
    units, d = used + 1, demand[used].astype(float)
    m = len(units)
    columns = np.diag(room // units).astype(float)
    inverse = np.diag(1.0 / (room // units))
    times = lambda a, v: (a * v).sum(axis=1)
    x = times(inverse, d)
    for turn in range(rounds):
        duals = inverse.sum(axis=0)
        gain = np.full(int(units[-1]), -1.0)
        gain[units - 1] = duals
        value, pattern = _price(gain, room)
        if value <= 1 + max(gap, 1e-9):
            break
        new = pattern[units - 1].astype(float)
        step = times(inverse, new)
        ok = step > 1e-9
        ratio = np.where(ok, x / np.where(ok, step, 1.0), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * step, 0.0)
        x[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[:, out] = new
        if turn % 200 == 199:  # rounding errors would add up
            inverse = inverted(columns)
            x = np.maximum(times(inverse, d), 0.0)
    counts = np.floor(x + 1e-6).astype(np.int64)
    plans, left = [], demand[used].astype(np.int64).copy()
    for p in range(m):
        a = columns[:, p].astype(np.int64)
        fit = min([int(counts[p]), *(int(left[u] // a[u]) for u in np.flatnonzero(a))])
        if fit > 0:
            plans.append((a, fit))
            left -= a * fit
    while left.any():
        a, free = np.zeros(m, np.int64), room
        for u in range(m - 1, -1, -1):
            a[u] = min(left[u], free // units[u])
            free -= a[u] * units[u]
        fit = min(int(left[u] // a[u]) for u in np.flatnonzero(a))
        plans.append((a, fit))
        left -= a * fit
    whole = []
    for a, n in plans:
        full = np.zeros(len(demand), np.int64)
        full[used] = a
        whole.append((full, n))
    return whole


def slots(plans: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(units, first slot, slot after the last, items a sequence, first sequence) for each length of each pattern."""
    rows, taken, sequence = [], {}, 0
    for a, n in plans:
        for u in np.flatnonzero(a).tolist():
            first = taken.get(u, 0)
            taken[u] = first + int(a[u]) * n
            rows.append((u + 1, first, taken[u], int(a[u]), sequence))
        sequence += n
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (a table that can be read again).

    An empty table stays empty.  Equal rows take different slots.
    """
    spark = pieces.sparkSession
    room = capacity // grain
    pieces = pieces.withColumn("units", F.ceil(F.col("length") / grain).cast("int"))
    demand = np.zeros(room, np.int64)
    for r in pieces.groupBy("units").count().collect():  # at most ``room`` rows
        demand[r["units"] - 1] = r["count"]
    salts = max(1, -(-int(demand.sum()) // salt_rows))
    rows = slots(column_generation(demand, room))
    found = spark.createDataFrame(rows, "units int, first long, after long, each long, sequence long")
    # Rank within a length: within (length, salt) by a window, plus the counts of the salts before it.
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    counts = pieces.groupBy("units", "salt").count()
    before = Window.partitionBy("units").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("units", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("units", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("n", F.row_number().over(within) - 1).join(counts, ["units", "salt"])
    ranked = ranked.withColumn("slot", F.col("n") + F.col("before"))
    # The slot table has a row for each length of each pattern: a few thousand at most, whatever the input.
    at = ranked.join(F.broadcast(found), (ranked["units"] == found["units"]) & (ranked["slot"] >= found["first"]) & (ranked["slot"] < found["after"]))
    at = at.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.floor((F.col("slot") - F.col("first")) / F.col("each"))).cast("long").alias("sequence_id"))
    run = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return at.withColumn("offset", F.coalesce(F.sum("length").over(run), F.lit(0)).cast("long"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut(tokenise(spread(table(spark, sf_dir, "documents")), tokenizer_path()), "pieces"))
