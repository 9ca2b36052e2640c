"""Near-duplicate detection by MinHash.

Every text becomes the set of its word shingles, hashed to 64 bits.  ``BANDS * ROWS`` universal hash minima make its
signature; texts that agree in all rows of a band meet in a bucket.  Texts with equal sets are one class from the start.
Buckets give candidate links in two ways that never list all pairs of a bucket: first each member is linked with the
bucket's leader, then, only where a bucket still spans several components, the members outside of its largest one are
compared with all others inside one task, in large buckets block by block.  Every candidate that
passes the signature is confirmed on the full shingle sets, and components come from alternating large-star and
small-star rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, spread, table

SHINGLE, BANDS, ROWS, SEED = 5, 40, 5, 20240501
NUM, DEN = 75, 100  # linked: DEN * intersection >= NUM * union
SLACK = 0.13  # a signature may fall short of the threshold by this (more than four standard deviations)
SPLIT, BLOCK = 2000, 1000  # members of a bucket that are compared in one piece, and of a block of a larger one
BLOCK_SHINGLES = 4_000_000  # and shingles of a block, at 8 bytes
SMALL_IDS = 4_000_000  # ids of 8 bytes that may be broadcast

MIX1, MIX2, MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * MIX3
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of byte words, kept for a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(self) >= 500_000:
                self.clear()
            self[word] = found
        return found


def shingles(text: str | None, words: Words, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles.

    bytes.lower() and bytes.split() treat exactly A-Z and the six ASCII white-space characters.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64) * MIX1
    for i in range(n):
        h = mix(h + w[i : len(w) - n + 1 + i] * MIX1)
    return np.unique(h)


class Minima:
    """``bands * rows`` universal hash functions on 32-bit values: (a * x + b) mod 2**32 with a odd."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * MIX1)

    def of(self, h: np.ndarray) -> np.ndarray:
        x = (h >> np.uint64(32)).astype(np.uint32) ^ h.astype(np.uint32)
        best = np.full(len(self.a), 2**32 - 1, np.uint32)
        for at in range(0, len(x), 1024):  # blocks that stay in cache
            part = x[at : at + 1024]
            np.minimum(best, (self.a[:, None] * part[None, :] + self.b[:, None]).min(axis=1), out=best)
        return best

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band; a band's number is part of its key."""
        m = minima.reshape(self.bands, self.rows).astype(np.uint64)
        h = self.salt.copy()
        for i in range(self.rows):
            h = mix(h + m[:, i] * MIX1)
        return h.astype(np.int64)


SIGNED = "doc_id long, n_shingles long, set_key binary, signature binary, bands array<long>"


def sign(docs: DataFrame, minima: Minima, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_key (a 128-bit digest of the set), signature (a byte of each minimum), bands.
    Without shingles the last three are null."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in parts:
            out: list[tuple] = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                h = shingles(text.as_py(), words, size)
                if len(h):
                    m = minima.of(h)
                    out.append((doc_id, len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), m.astype(np.uint8).tobytes(), minima.keys(m)))
                else:
                    out.append((doc_id, 0, None, None, None))
                if len(out) == 2000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "n_shingles", "set_key", "signature", "bands"])

    return docs.select("doc_id", "text").mapInArrow(task, SIGNED)


def few(ids: DataFrame) -> DataFrame:
    """A broadcast hint for a written one-column table of ids, if it is small enough."""
    return F.broadcast(ids) if ids.count() <= SMALL_IDS else ids


def estimate(edges: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """a, b, share: the edges whose signatures agree in at least ``least`` of their positions."""
    sig = signed.select(F.col("doc_id").alias("id"), "signature")
    both = edges.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b")

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint8).reshape(part.num_rows, -1) for i in (2, 3))
            share = (x == y).mean(axis=1)
            ok = np.flatnonzero(share >= least)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ok)), part.column(1).take(pa.array(ok)), pa.array(share[ok])], names=["a", "b", "share"])

    return both.select("a", "b", "sa", "sb").mapInArrow(task, "a long, b long, share double")


def full_sets(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """doc_id, shingles (sorted 64-bit hashes) of the documents in the written one-column table ``ids``."""

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in parts:
            for at in range(0, part.num_rows, 200):
                p = part.slice(at, 200)
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array([shingles(t.as_py(), words, size).tobytes() for t in p.column(1)], pa.binary())], names=["doc_id", "shingles"])

    own = docs.select("doc_id", "text").join(few(ids), "doc_id", "left_semi")
    return cut(own.mapInArrow(sets, "doc_id long, shingles binary"), "minhash-sets", compression="none")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def confirm(edges: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The edges (a, b) whose full shingle sets are similar enough; each set travels once for each edge it is on."""
    both = edges.join(sets.toDF("b", "xb"), "b").join(sets.toDF("a", "xa"), "a")

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ok = []
            for i, (xa, xb) in enumerate(zip(part.column(2), part.column(3))):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (xa, xb))
                n = common(a, b)
                if n and den * n >= num * (len(a) + len(b) - n):
                    ok.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(ok, pa.int64())) for c in (part.column(0), part.column(1))], names=["a", "b"])

    return both.select("a", "b", "xa", "xb").mapInArrow(task, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for the nodes of ``edges`` (a, b): alternating large-star and
    small-star.  Neighbours' minima are aggregated before the join back, so a node with very many links is one row
    on one side of a join that can be split.  Each round is written and read again.
    """
    at = cut(edges.filter("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "stars")

    def mark(e: DataFrame) -> tuple:
        # 64-bit wrap-around sums as an order-free digest of the edges; equal digests: nothing changed.
        r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        return tuple(r)

    before = mark(at)
    while True:
        # Large star: for each u, link its larger neighbours to the least of its neighbourhood.
        both = at.select("u", "v").union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: for each u, link its smaller neighbours and itself to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        at = cut(small, "stars")
        now = mark(at)
        if now == before:
            break
        before = now
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(at.select(F.col("v"), F.col("v")).distinct())


def across(members: DataFrame, nodes: DataFrame, sets: DataFrame, least: float, num: int, den: int, split: int = SPLIT, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """a, b: links between different components of a bucket, enough of them to join all components that any link joins.

    members: bucket, id, comp, n_shingles.  Members outside of a bucket's largest component are compared with all others, by
    signature and then by their full sets, inside one task, and only links leave it.  A pair that shares several
    bands is looked at under the first one.  In a bucket of more than ``split`` members (or so many shingles that
    they fill two blocks) blocks of the former meet blocks of all.
    """
    per = members.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    top = F.max_by(F.struct("comp", "n", "w"), F.struct("n", "comp")).alias("top")
    about = per.groupBy("bucket").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.sum("w").alias("w"), top).filter("comps > 1")
    cuts = lambda n, w: F.ceil(F.greatest(n / block, w / block_shingles)).cast("int")
    large = (F.col("n") > split) | (F.col("w") > 2 * block_shingles)
    about = about.select("bucket", F.col("top.comp").alias("main"), large.alias("large"), cuts(F.col("n"), F.col("w")).alias("alls"), cuts(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("rests"))
    held = cut(members.join(about, "bucket").withColumn("rest", F.col("comp") != F.col("main")), "minhash-open")
    # side: 0 is compared with others, 1 others are compared with it, 2 both.
    zero = F.lit(0)
    groups = held.filter("not large").select("bucket", zero.alias("i"), zero.alias("j"), F.when(F.col("rest"), 2).otherwise(1).alias("side"), "id", "comp", "rest")
    hot = held.filter("large")
    if hot.limit(1).count():
        part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        others = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
        groups = groups.union(hot.filter("rest").select("bucket", part("rests").alias("i"), others("alls").alias("j"), zero.alias("side"), "id", "comp", "rest"))
        groups = groups.union(hot.select("bucket", others("rests").alias("i"), part("alls").alias("j"), F.lit(1).alias("side"), "id", "comp", "rest"))

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["comp", "id", "side"], kind="stable")
        bucket = pdf["bucket"].iloc[0]
        ids, side, rest = (pdf[c].to_numpy() for c in ("id", "side", "rest"))
        sig = np.frombuffer(b"".join(pdf["signature"]), np.uint8).reshape(len(ids), -1)
        bands = np.stack(pdf["bands"].to_list())
        full = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        need = int(np.ceil(least * sig.shape[1]))
        names, code = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
        root = list(range(len(names)))

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for r in np.flatnonzero(side != 1):
            # Of two members outside of the largest component the one with the smaller id is compared with the other.
            o = np.flatnonzero((code != code[r]) & (side != 0) & (~rest | (ids > ids[r])))
            o = o[(sig[o] == sig[r]).sum(axis=1) >= need]
            if not len(o):
                continue
            mine = bands[r][(bands[o] == bands[r]).argmax(axis=1)] == bucket
            for t in o[mine]:
                a, b = find(int(code[r])), find(int(code[t]))
                if a == b:
                    continue
                n = common(full[r], full[t])
                if den * n >= num * (len(full[r]) + len(full[t]) - n):
                    out.append((ids[r], ids[t]))
                    root[a] = b
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    known = nodes.select(F.col("doc_id").alias("id"), "signature", "bands").join(sets.toDF("id", "shingles"), "id")
    pairs = groups.join(known, "id").groupBy("bucket", "i", "j").applyInPandas(task, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, num: int = NUM, den: int = DEN, split: int = SPLIT, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text; other columns are ignored).

    Null, empty and blank texts have no shingles and are linked with nothing.  Rows with equal doc_id
    are each placed by their own text.  A null doc_id is left out of links: its component_id is null and kept false.  An empty table gives an empty result.
    """
    minima, floor = Minima(bands, rows), num / den - SLACK
    docs = docs.select("doc_id", "text")
    signed = cut(sign(docs, minima, size), "minhash-signed")
    # One node for each distinct set: the smallest doc_id that has it.
    classes = cut(signed.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "minhash-classes")
    nodes = cut(signed.join(classes.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi").select("doc_id", "n_shingles", "signature", "bands"), "minhash-nodes", compression="none")
    placed = nodes.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(placed.join(sizes, "bucket"), "minhash-buckets")
    # The leader is the member that meets most others over all its buckets: the text that the copies of a group were made from
    # meets more of them than they meet of each other, so one round of stars joins most of the group.
    central = shared.groupBy("id").agg(F.sum("n").alias("met"))
    lead = shared.join(central, "id").groupBy("bucket").agg(F.max_by("id", F.struct("met", F.xxhash64(F.lit(SEED), "id"))).alias("leader"))
    stars = shared.join(lead, "bucket").filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    # The sets of all that is in some bucket with another, shingled once.
    sets = full_sets(cut(shared.select(F.col("id").alias("doc_id")).distinct(), "minhash-met"), docs, size)
    likely = cut(estimate(stars, nodes, floor), "minhash-likely")
    # First each node's likeliest leader alone, then what still joins different components.
    first = likely.groupBy("b").agg(F.max_by("a", F.struct("share", F.negative("a"))).alias("a")).select("a", "b")
    links = cut(confirm(first, sets, num, den), "minhash-links")
    found = cut(components(links), "minhash-components")

    def label(df: DataFrame, column: str, to: str) -> DataFrame:
        return df.join(found.toDF(column, "_c"), column, "left").withColumn(to, F.coalesce("_c", column)).drop("_c")

    second = label(label(likely.select("a", "b"), "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b")
    second = cut(second, "minhash-second")
    if second.limit(1).count():
        links = cut(links.union(confirm(second, sets, num, den)), "minhash-links")
        found = cut(components(links), "minhash-components")
    members = label(shared.select("bucket", "id"), "id", "comp").join(nodes.select(F.col("doc_id").alias("id"), "n_shingles"), "id")
    third = cut(across(members, nodes, sets, floor, num, den, split, block, block_shingles), "minhash-third")
    if third.limit(1).count():
        links = cut(links.union(third), "minhash-links")
        found = cut(components(links), "minhash-components")
    named = label(classes, "rep", "component_id")
    at = signed.select("doc_id", "n_shingles", "set_key").join(named.select("set_key", "component_id"), "set_key", "left")
    at = at.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return at.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


OP8_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {DEN} * c >= {NUM} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.node),
m AS (SELECT id, min(node) AS component_id FROM r GROUP BY id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m ON m.id = doc_id
"""


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")))
