"""Exact substring de-duplication over sorted suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id.

Suffixes are sorted where it matters only.  In every window of LENGTH bytes the substrings of ``GRAM`` bytes with the least
hash are anchors: equal windows have their anchors at equal places, and about one position in sixteen is one.  A first
exchange of anchor hashes keeps those that occur in two documents.  The suffixes at these anchors, with the bytes before
them, are sorted within runs of a few megabytes, front-coded (each entry holds only what differs from the one
before), dealt out by anchor, and merged by a loser tree that carries the length of the prefix each head
shares with the last entry put out: heads are compared from there on, never from the start.  These lengths tell which
neighbours in merged order share the bytes of a window after the anchor, a second order of the bytes before the anchors
tells the same for the other part, and so each window's first document is found by comparing bytes alone.

An anchor that occurs too often for one task leaves this path: each of its windows is a key of its own, runs reduce
their occurrences to the least doc_id, and a plain aggregation finds the least of all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, spread, table

LENGTH, GRAM = 50, 20
RUN_BYTES, BUCKET_ANCHORS, PART_BYTES = 2 << 20, 1 << 20, 6 << 20
PAD = 255  # no UTF-8 text has this byte
LAST = 2**63 - 1  # stands for a null doc_id: it is after every other
WORD = 8  # bytes that are compared at once
MANY, HOT = 64, 1_000_000  # occurrences in a run that flag an anchor; estimated occurrences beyond which it leaves the merge
C1, C2, C3, C4 = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))
C5, C6 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
TABLE = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= C5
    x ^= x >> np.uint64(32)
    return x


def gram_order(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of every GRAM (20) bytes, built from those of 1, 2, 4, 8 and 16: anchors are chosen by it."""
    h = TABLE[data]
    h = h[:-1] * C1 + h[1:]
    four = h[:-2] * C2 + h[2:]
    four ^= four >> np.uint32(15)
    h = four[:-4] * C3 + four[4:]
    h = h[:-8] * C4 + h[8:]
    h ^= h >> np.uint32(13)
    h = h[:-4] * C2 + four[16:]
    h ^= h >> np.uint32(16)
    return h


def gram_names(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each of some places."""
    b = np.zeros((len(at), 24), np.uint8)
    b[:, :GRAM] = np.lib.stride_tricks.sliding_window_view(data, GRAM)[at]
    w = b.view("<u8")
    h = _mix(w[:, 0] * C6 + np.uint64(1))
    h = _mix((h + w[:, 1]) * C6)
    return _mix((h + w[:, 2]) * C6)


def _slide(x: np.ndarray, n: int, best) -> np.ndarray:
    """``best`` over every n neighbours, by doubling."""
    width = 1
    while 2 * width <= n:
        x = best(x[:-width], x[width:])
        width *= 2
    return best(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors: the grams whose hash is least in some window of ``length`` bytes."""
    n = length - GRAM + 1
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_order(data)
    low = _slide(h, n, np.minimum)
    # Of the windows over a position none has a larger least hash than the position's own.
    edge = np.zeros(n - 1, h.dtype)
    high = _slide(np.concatenate([edge, low, edge]), n, np.maximum)
    at = np.flatnonzero(high == h)
    return at, gram_names(data, at)


RUN = "run long, ids binary, sizes binary, data binary"


def runs(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Documents packed into runs of about ``run_bytes``; a larger document is a run of its own.

    run is a digest of the run's documents and of the partition, so a repeated task makes the same runs.
    """

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def end() -> pa.RecordBatch:
            nonlocal made
            made += 1
            key = hashlib.blake2b(f"{part}|{made}|{ids[0]}|{len(ids)}".encode(), digest_size=8).digest()
            data = b"".join(texts)
            row = [(int.from_bytes(key, "little", signed=True),), (np.array(ids, "<i8").tobytes(),), (np.array([len(t) for t in texts], "<i8").tobytes(),), (len(data).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(data, asbytes=True),)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["run", "ids", "sizes", "data"])

        for p in parts:
            for doc_id, text in zip(p.column(0).to_pylist(), p.column(1)):
                t = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if texts and size + len(t) > run_bytes:
                    yield end()
                    ids, texts, size = [], [], 0
                ids.append(LAST if doc_id is None else doc_id)
                texts.append(t)
                size += len(t)
        if texts:
            yield end()

    return docs.select("doc_id", "text").mapInArrow(task, RUN)


def _data(raw: bytes) -> bytes:
    return pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


class Run:
    """One run in memory: bytes, documents and their ends."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes) -> None:
        self.ids, self.sizes = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8")
        self.data = np.frombuffer(_data(data), np.uint8)
        self.ends = np.cumsum(self.sizes)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, hash and document (its place in the run) of the anchors that lie within a document of at least
        LENGTH bytes."""
        at, h = anchors(self.data)
        doc = np.searchsorted(self.ends, at, side="right")
        ok = (at + GRAM <= self.ends[doc]) & (self.sizes[doc] >= LENGTH)
        return at[ok], h[ok], doc[ok]


def _short(h: np.ndarray) -> np.ndarray:
    """46 bits of a hash above two free bits."""
    return (h >> np.uint64(16)) & ~np.uint64(3)


def _pack6(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack6(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def shared_anchors(packed: DataFrame, buckets: int, hot: int = HOT) -> DataFrame:
    """run, shared, hot: the run's anchor hashes (46 bits) that occur in at least two documents anywhere, with the low bit
    set in those that occur too often, and how many of these there are.

    Within a run equal hashes are one entry, with a bit for whether two of its documents have it and one for whether it
    occurs more than MANY times; a run without the latter counts for 8 occurrences, one with it for 1,024.  False
    positives of the shortened hash cost work, nothing else.
    """

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for run, ids, sizes, data in zip(*(c.to_pylist() for c in p.columns)):
                r = Run(ids, sizes, data)
                _, h, doc = r.anchors()
                h, doc_id = _short(h), r.ids[doc]
                o = np.argsort(h, kind="stable")
                h, doc_id = h[o], doc_id[o]
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, int)
                if not len(first):
                    continue
                two = np.maximum.reduceat(doc_id, first) > np.minimum.reduceat(doc_id, first)
                many = np.diff(np.r_[first, len(h)]) > MANY
                h = h[first] | two.astype(np.uint64) | many.astype(np.uint64) << np.uint64(1)
                b = ((h >> np.uint64(2)) * np.uint64(buckets) >> np.uint64(46)).astype(np.int64) if buckets < 1 << 18 else ((h >> np.uint64(2)) % np.uint64(buckets)).astype(np.int64)
                o = np.argsort(b, kind="stable")
                h, b = h[o], b[o]
                cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                ends = np.r_[cuts[1:], len(b)]
                yield pa.RecordBatch.from_arrays([pa.array(b[cuts].astype(np.int32)), pa.array(np.full(len(cuts), run, np.int64)), pa.array([_pack6(h[i:j]) for i, j in zip(cuts, ends)], pa.binary())], names=["bucket", "run", "hashes"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        every = _unpack6(b"".join(pdf["hashes"]))
        ends = np.cumsum([len(x) // 6 for x in pdf["hashes"]])
        key = every & ~np.uint64(3)
        o = np.argsort(key, kind="stable")
        k = key[o]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        times = np.diff(np.r_[first, len(k)])
        two = np.maximum.reduceat(every[o] & np.uint64(1), first) > 0
        weight = np.add.reduceat(np.where(every[o] & np.uint64(2), 1024, 8), first)
        good, often = np.empty(len(key), bool), np.empty(len(key), bool)
        good[o] = np.repeat((times > 1) | two, times)
        often[o] = np.repeat(weight > hot, times)
        out = []
        for run, i, j in zip(pdf["run"], np.r_[0, ends[:-1]], ends):
            if len(hit := (key[i:j] | often[i:j])[good[i:j]]):
                out.append((run, _pack6(hit), int((hit & np.uint64(1)).sum())))
        return pd.DataFrame(out, columns=["run", "shared", "hot"])

    at = packed.mapInArrow(task, "bucket int, run long, hashes binary")
    return at.groupBy("bucket").applyInPandas(meet, "run long, shared binary, hot long")


def contexts(r: Run, at: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each anchor the ``length`` bytes from it on and, backwards, those before it that a window can hold;
    what lies outside of the document is PAD."""
    left = length - GRAM
    out = np.full((len(at), -(-(length + left) // WORD) * WORD), PAD, np.uint8)
    room = (r.ends[doc] - at)[:, None]
    i = np.arange(length)
    out[:, :length] = np.where(i < room, r.data[np.minimum(at[:, None] + i, len(r.data) - 1)], PAD)
    room = (at - (r.ends[doc] - r.sizes[doc]))[:, None]
    i = np.arange(left)
    out[:, length : length + left] = np.where(i < room, r.data[np.maximum(at[:, None] - 1 - i, 0)], PAD)
    return out


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Lengths of the prefixes that sorted rows share with the row before, and the rest of each row."""
    same = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        same[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return same, rows[np.arange(rows.shape[1]) >= same[:, None]].tobytes()


def front_decode(same: np.ndarray, rest: bytes, width: int) -> np.ndarray:
    own = np.arange(width) >= same[:, None]
    out = np.zeros((len(same), width), np.uint8)
    out[own] = np.frombuffer(rest, np.uint8)
    source = np.maximum.accumulate(np.where(own, np.arange(len(same))[:, None], 0), axis=0)
    return np.take_along_axis(out, source, axis=0)


SORTED = "part int, run long, same binary, rest binary, times binary, ids binary, places binary"


def sorted_runs(packed: DataFrame, shared: DataFrame, parts: int) -> DataFrame:
    """Front-coded sorted suffixes of each run at its shared anchors, a row for each part; equal entries are one, with
    the documents and positions that have it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            for run, ids, sizes, data, lists in zip(*(c.to_pylist() for c in p.columns)):
                r = Run(ids, sizes, data)
                at, h, doc = r.anchors()
                good = np.concatenate([_unpack6(x) for x in lists])
                ok = np.isin(_short(h), good)  # too frequent ones are listed with their low bit set
                at, h, doc = at[ok], h[ok], doc[ok]
                if not len(at):
                    continue
                rows = contexts(r, at, doc)
                part = (_mix(h.copy()) % np.uint64(parts)).astype(np.int64)
                words = rows.view(">u8")
                o = np.lexsort((*(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), part))
                rows, part, at, who = rows[o], part[o], at[o], r.ids[doc[o]]
                new = np.r_[True, (rows[1:] != rows[:-1]).any(axis=1) | (part[1:] != part[:-1])]
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                out = []
                for i, j in zip(cuts, np.r_[cuts[1:], len(part)]):
                    first = np.flatnonzero(new[i:j]) + i
                    same, rest = front_code(rows[first])
                    out.append((int(part[i]), run, same.tobytes(), rest, np.diff(np.r_[first, j]).astype("<u4").tobytes(), who[i:j].astype("<i8").tobytes(), at[i:j].astype("<u4").tobytes()))
                types = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in SORTED.split(", ")])

    lists = shared.groupBy("run").agg(F.collect_list("shared").alias("lists"))
    return packed.join(lists, "run").select("run", "ids", "sizes", "data", "lists").mapInArrow(task, SORTED)


def merge(runs_: list[list[tuple[int, ...]]], shared: list[list[int]], width: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs of equally wide word tuples by a loser tree.

    shared[r][i]: how many words entry i of run r shares with entry i - 1.  Each head carries how many words it shares with the
    last entry put out; the head that shares more is the smaller one, and equal heads are compared from there on.
    Returns (run, place) in order, and how many words each shares with the entry before it.
    """
    k = 1
    while k < max(len(runs_), 1):
        k *= 2
    none = len(runs_)  # a run that is over; it loses against every other
    place, known = [0] * (none + 1), [0] * (none + 1)
    heads: list[tuple[int, ...] | None] = [r[0] if r else None for r in runs_] + [None]
    losers = [none] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k if node - k < none and heads[node - k] is not None else none
        a, b = build(2 * node), build(2 * node + 1)
        if a == none or b == none:
            losers[node] = none if a == none or b == none else b
            return b if a == none else a
        x, y, n = heads[a], heads[b], 0
        while n < width and x[n] == y[n]:
            n += 1
        if n < width and y[n] < x[n]:
            a, b = b, a
        known[b] = n
        losers[node] = b
        return a

    order: list[tuple[int, int]] = []
    carried: list[int] = []
    top = build(1) if k > 1 else (0 if none and heads[0] is not None else none)
    while top != none:
        i = place[top]
        order.append((top, i))
        carried.append(known[top] if len(order) > 1 else 0)
        slot, i = top, i + 1
        if i < len(runs_[top]):
            place[top], heads[top], known[top] = i, runs_[top][i], shared[top][i]
        else:
            heads[top], top = None, none
        node = (slot + k) >> 1
        while node:
            other = losers[node]
            if other != none:
                if top == none:
                    losers[node], top = none, other
                else:
                    n, m = known[top], known[other]
                    if n < m:
                        losers[node], top = top, other
                    elif n == m:
                        x, y = heads[top], heads[other]
                        while n < width and x[n] == y[n]:
                            n += 1
                        if n < width and y[n] < x[n]:
                            losers[node], known[top], top = top, n, other
                        else:
                            known[other] = n
            node >>= 1
    return order, carried


def byte_lengths(words: np.ndarray, carried: np.ndarray) -> np.ndarray:
    """How many bytes each row (of big-endian words) shares with the row before, from the whole words they share."""
    out = carried.astype(np.int64) * WORD
    i = np.flatnonzero((carried < words.shape[1]) & (np.arange(len(words)) > 0))
    w = carried[i]
    x = words[i, w].astype(np.uint64) ^ words[i - 1, w].astype(np.uint64)
    for k in range(1, WORD):  # equal leading bytes
        out[i] += x < np.uint64(1 << (64 - 8 * k))
    return out


def repeated(rows: np.ndarray, shared: np.ndarray, owner: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each occurrence (owner: its row of ``rows``, doc: its doc_id) a bit s if the window that starts s bytes before the
    anchor also stands in a document with a smaller doc_id.

    rows are sorted, and shared[i] is how many bytes row i has in common with row i - 1; neighbours with fewer than n part
    the rows into classes of equal first n bytes.  The bytes before the anchors are sorted here to the same end.
    """
    left = length - GRAM
    least = np.full(len(rows), LAST, np.int64)
    np.minimum.at(least, owner, doc)
    after = (rows[:, :length] != PAD).sum(axis=1)
    before = (rows[:, length : length + left] != PAD).sum(axis=1)
    ahead = np.zeros((len(rows), -(-left // WORD) * WORD), np.uint8)
    ahead[:, :left] = rows[:, length : length + left]
    words = ahead.view(">u8")
    back = np.lexsort([words[:, k] for k in range(words.shape[1] - 1, -1, -1)])
    same = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = ahead[back][1:] != ahead[back][:-1]
        same[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), left)
    every, other = np.zeros(len(rows), np.uint32), np.zeros(len(rows), np.uint32)
    behind = np.empty(len(rows), np.int64)
    for s in range(left + 1):
        ok = np.flatnonzero((before >= s) & (after >= length - s))
        if not len(ok):
            continue
        behind[back] = np.cumsum(same < s)
        key = (np.cumsum(shared < length - s) * np.int64(len(rows) + 1) + behind)[ok]
        o = np.argsort(key, kind="stable")
        k = key[o]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        low = np.repeat(np.minimum.reduceat(least[ok][o], first), np.diff(np.r_[first, len(k)]))
        bit = np.uint32(1 << s)
        every[ok] |= bit
        sel = ok[o]
        other[sel[low < least[sel]]] |= bit
    return np.where(doc > least[owner], every[owner], other[owner])


def marks(sorted_: DataFrame) -> DataFrame:
    """run, places, bits: the anchors' positions in the run and their repeated windows."""
    width = -(-(2 * LENGTH - GRAM) // WORD)

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, words, shared = [], [], []
        for same, rest in zip(pdf["same"], pdf["rest"]):
            s = np.frombuffer(same, np.uint8)
            m = front_decode(s, rest, width * WORD)
            rows.append(m)
            words.append(list(map(tuple, m.view(">u8").tolist())))
            shared.append((s // WORD).tolist())
        order, carried = merge(words, shared, width)
        sizes = np.array([len(m) for m in rows])
        start = np.r_[0, np.cumsum(sizes)[:-1]]
        o = np.array(order, np.int64)
        flat = start[o[:, 0]] + o[:, 1]
        carried = np.array(carried, np.int64)
        fresh = (carried < width) | (np.arange(len(flat)) == 0)
        kind = np.cumsum(fresh) - 1  # the class of each entry in merged order
        class_of = np.empty(len(flat), np.int64)
        class_of[flat] = kind
        reps = np.concatenate(rows)[flat[fresh]]
        lengths = byte_lengths(reps.view(">u8"), carried[fresh])
        times = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["times"]])
        doc = np.concatenate([np.frombuffer(x, "<i8") for x in pdf["ids"]])
        bits = repeated(reps, lengths, np.repeat(class_of, times), doc)
        out, at = [], 0
        for run, ids, places in zip(pdf["run"], pdf["ids"], pdf["places"]):
            n = len(ids) // 8
            b, p = bits[at : at + n], np.frombuffer(places, "<u4")
            at += n
            if (b > 0).any():
                out.append((run, p[b > 0].tobytes(), b[b > 0].astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["run", "places", "bits"])

    return sorted_.groupBy("part").applyInPandas(task, "run long, places binary, bits binary")


WINDOWS = "run long, window binary, least long, ids binary, places binary"


def frequent(packed: DataFrame, shared: DataFrame, length: int = LENGTH) -> DataFrame:
    """run, places, bits as of ``marks`` for the anchors that occur too often: their windows, each by its own bytes.

    A run gives one row for each distinct window with its least doc_id; only these two columns are aggregated, with a
    partial result in each task, so no window is too frequent.
    """
    left = length - GRAM

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            for run, ids, sizes, data, lists in zip(*(c.to_pylist() for c in p.columns)):
                r = Run(ids, sizes, data)
                at, h, doc = r.anchors()
                good = np.concatenate([_unpack6(x) for x in lists])
                ok = np.isin(_short(h) | np.uint64(1), good)
                at, doc = at[ok], doc[ok]
                starts, ends = r.ends - r.sizes, r.ends
                places = (at[:, None] - np.arange(left + 1)).ravel()
                doc = np.repeat(doc, left + 1)
                ok = (places >= starts[doc]) & (places + length <= ends[doc])
                places, first = np.unique(places[ok], return_index=True)
                doc_id = r.ids[doc[ok][first]]
                if not len(places):
                    continue
                w = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(r.data, length)[places])
                _, first, which = np.unique(w.view(f"V{length}").ravel(), return_index=True, return_inverse=True)
                o = np.lexsort((places, doc_id, which))
                cuts = np.flatnonzero(np.r_[True, which[o][1:] != which[o][:-1]])
                out = [(run, w[first[which[o[i]]]].tobytes(), int(doc_id[o[i]]), doc_id[o[i:j]].astype("<i8").tobytes(), places[o[i:j]].astype("<u4").tobytes()) for i, j in zip(cuts, np.r_[cuts[1:], len(o)])]
                types = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
                for i in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 10_000]), types)], names=[x.split()[0] for x in WINDOWS.split(", ")])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            out = []
            for run, least, ids, places in zip(*(c.to_pylist() for c in p.columns)):
                hit = np.frombuffer(places, "<u4")[np.frombuffer(ids, "<i8") > least]
                if len(hit):
                    out.append((run, hit.tobytes(), np.ones(len(hit), "<u4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], names=["run", "places", "bits"])

    lists = shared.filter("hot > 0").groupBy("run").agg(F.collect_list("shared").alias("lists"))
    found = cut(packed.join(lists, "run").select("run", "ids", "sizes", "data", "lists").mapInArrow(task, WINDOWS), "suffix-windows")
    least = found.groupBy("window").agg(F.min("least").alias("first"))
    return found.join(least, "window").select("run", "first", "ids", "places").mapInArrow(later, "run long, places binary, bits binary")


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cutting(packed: DataFrame, marked: DataFrame, keep_bytes: bool) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            for ids, sizes, data, places, bits in zip(*(c.to_pylist() for c in p.columns)):
                r = Run(ids, sizes, data)
                gone = np.zeros(len(r.data), bool)
                if places:
                    at = np.concatenate([np.frombuffer(x, "<u4") for x in places]).astype(np.int64)
                    bit = np.concatenate([np.frombuffer(x, "<u4") for x in bits])
                    starts = np.zeros(len(r.data) + LENGTH, np.int32)
                    for s in range(LENGTH - GRAM + 1):
                        starts[at[bit & np.uint32(1 << s) > 0] - s + LENGTH] = 1
                    # A byte goes if one of the LENGTH windows over it starts where a repeated one does.
                    so_far = np.cumsum(starts, dtype=np.int32)
                    gone = so_far[LENGTH:] > so_far[:-LENGTH]
                out, start = [], 0
                for doc_id, size in zip(r.ids.tolist(), r.sizes.tolist()):
                    g, d = gone[start : start + size], r.data[start : start + size]
                    start += size
                    n = int(g.sum())
                    kept = (d[~g] if n else d).tobytes()
                    spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0
                    out.append((None if doc_id == LAST else doc_id, size, n, spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in REPORT.split(", ")])

    m = marked.groupBy("run").agg(F.collect_list("places").alias("places"), F.collect_list("bits").alias("bits"))
    return packed.join(m, "run", "left").select("ids", "sizes", "data", "places", "bits").mapInArrow(task, REPORT)


def remove_repeats(docs: DataFrame, run_bytes: int = RUN_BYTES, bucket_anchors: int = BUCKET_ANCHORS, part_bytes: int = PART_BYTES, keep_bytes: bool = True, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; null without ``keep_bytes``), one row for
    each row of ``docs`` (doc_id, text; other columns are ignored).

    Null text is empty: no bytes, none removed.  Rows with equal doc_id are not compared with each other, each is
    with the smaller ids; rows without doc_id come after all others and are not compared with each other.  Strings
    never cross rows.  An empty table stays empty.
    """
    packed = cut(runs(docs, run_bytes), "suffix-texts", compression="none")
    total = packed.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0] * 3  # texts compress to about a third
    shared = cut(shared_anchors(packed, max(12, -(-total // (16 * bucket_anchors))), hot), "suffix-shared", compression="none")
    marked = cut(marks(sorted_runs(packed, shared, max(12, -(-total // part_bytes)))), "suffix-marks")
    if shared.filter("hot > 0").limit(1).count():
        marked = marked.union(cut(frequent(packed, shared), "suffix-frequent"))
    return cutting(packed, marked, keep_bytes)


OP10_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, o, substr(h, 2 * o + 1, 2 * (4096 + {LENGTH - 1})) AS h FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2, 1), 4096)) AS o FROM d)),
w AS (SELECT doc_id, o + i AS p, substr(h, 2 * i + 1, {2 * LENGTH}) AS w FROM (SELECT doc_id, o, h, unnest(range(0, least(4096, length(h) // 2 - {LENGTH - 1}))) AS i FROM k)),
f AS (SELECT w, min(doc_id) AS first_id FROM w GROUP BY w),
r AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM w JOIN f USING (w) WHERE doc_id > first_id),
g AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM r),
s AS (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS b FROM g GROUP BY doc_id, g),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM s),
x AS (SELECT t.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS z, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM t JOIN d USING (doc_id) GROUP BY t.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN x.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * z + 1) END)) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spread(table(spark, sf_dir, "documents")), keep_bytes=False).drop("kept")
