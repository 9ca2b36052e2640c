"""Exact top-k inner-product search by Fagin's threshold algorithm.

Vectors are dealt into shards of a fixed number of rows; a shard keeps, for each dimension, its rows sorted by that
component.  For a query the lists are read in step from the end that its component's sign favours, each row that
comes up is scored whole, and reading stops as soon as the threshold (the sum of the best products that unread
rows can still have) cannot beat the kth score found, here or in the shards before, ties included.  Queries are dealt
into blocks too, and each block visits each shard, so neither side is ever broadcast or collected whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, table

SHARD_ROWS, BLOCK_ROWS, SCALE, STEP = 8192, 2048, 1024, 64
HITS = "query_id long, vec_id long, score long, high long, low long"
LOW, HIGH = -(2**63), 2**63 - 1


def quantise(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v array<long>: floor(scale * x) with x as double.

    Vectors that are null, empty or hold a null, NaN or infinite component, and rows without vec_id, take no part.
    """
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    fine = F.col("vec_id").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.filter(fine).select("vec_id", F.transform("e", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))


def _pack(rows: DataFrame, key: str, lists: bool = False) -> DataFrame:
    """One row for each ``key`` and dimension: n, d, ids and components as little-endian longs; with ``lists`` the row
    numbers by ascending component for each dimension, so that a shard is sorted once however many blocks visit it."""

    def pack(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        ids, v = pdf["vec_id"].to_numpy("<i8"), np.stack(pdf["v"].to_list()).astype("<i8")
        order = np.argsort(v, axis=0, kind="stable").astype("<i4").tobytes() if lists else None
        return pd.DataFrame([{key: k[0], "d": v.shape[1], "n": len(ids), "ids": ids.tobytes(), "vs": v.tobytes(), "orders": order}])

    return rows.withColumn("d", F.size("v")).groupBy(key, "d").applyInPandas(pack, f"{key} long, d int, n int, ids binary, vs binary, orders binary")


def largest(v: np.ndarray) -> int:
    """The largest absolute value, as an unbounded integer."""
    return max(int(v.max()), -int(v.min())) if v.size else 0


class Shard:
    """A shard's sorted lists: for every dimension the row numbers by ascending component."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, order: np.ndarray | None = None) -> None:
        self.ids, self.v = ids, v
        self.order = np.argsort(v, axis=0, kind="stable") if order is None else order
        self.sorted = np.take_along_axis(v, self.order, axis=0)
        self.most = largest(v)
        self.mark = np.zeros(len(ids), np.int64)
        self.turn = 0

    def type_for(self, q: np.ndarray) -> type:
        """64-bit integers where no sum of products can leave them, else unbounded ones."""
        return np.int64 if self.most * largest(q) * len(q) < 2**63 else object

    def top(self, q: np.ndarray, k: int, own: int, known: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, without the id ``own``; ``known`` are hits of other shards."""
        n, used, kind = len(self.ids), np.flatnonzero(q), self.type_for(q)
        self.turn += 1
        best_s, best_i = np.array([s for s, _ in known or []], object), np.array([i for _, i in known or []], np.int64)
        if not all(-(2**63) <= s < 2**63 for s in best_s):
            kind = object
        best_s = best_s.astype(kind)
        if not len(used):  # every score is 0 and the smallest ids win
            return self._keep(np.concatenate([best_s, np.zeros(n, kind)]), np.concatenate([best_i, self.ids]), k, own)
        up, wide = q[used] > 0, q.astype(kind)
        depth, step = 0, STEP
        keep = list(zip(best_s.tolist(), best_i.tolist()))
        while depth < n:
            stop = min(n, depth + step)
            seen = np.concatenate([self.order[n - stop : n - depth, used[up]].ravel(), self.order[depth:stop, used[~up]].ravel()])
            fresh = np.unique(seen)
            fresh = fresh[self.mark[fresh] != self.turn]
            self.mark[fresh] = self.turn
            s = np.concatenate([best_s, self.v[fresh].astype(kind, copy=False) @ wide])
            i = np.concatenate([best_i, self.ids[fresh]])
            keep = self._keep(s, i, k, own)
            best_s, best_i = np.array([x for x, _ in keep], kind), np.array([x for _, x in keep], np.int64)
            depth, step = stop, step * 2
            if depth < n and len(keep) == k:
                edge = np.where(up, self.sorted[n - depth, used], self.sorted[depth - 1, used]).astype(kind)
                if int((edge * wide[used]).sum()) < best_s[-1]:  # an equal score could still win by a smaller id
                    break
        return keep

    @staticmethod
    def _keep(s: np.ndarray, i: np.ndarray, k: int, own: int) -> list[tuple[int, int]]:
        ok = i != own
        s, i = s[ok], i[ok]
        if s.dtype == object:
            return sorted(zip(s.tolist(), i.tolist()), key=lambda x: (-x[0], x[1]))[:k]
        if len(s) > 4 * k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            s, i = s[s >= edge], i[s >= edge]
        o = np.lexsort((i, -s))[:k]
        return list(zip(s[o].tolist(), i[o].tolist()))


def search(queries: DataFrame, candidates: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for each query's k best candidates (``quantise``d), its own id left out.

    Vectors of different length are never compared.  Repeated vec_ids among the candidates stay apart rows;
    repeated queries are answered once.  Empty inputs give no rows.  Scores are exact integers and ranked as such (up to
    126 bits); one that leaves 64 bits is reported as the nearest long.
    """
    spark = candidates.sparkSession
    candidates = cut(candidates, "topk-vectors")
    queries = cut(queries.dropDuplicates(["vec_id"]), "topk-queries")
    shards = max(1, -(-candidates.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    at = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    packed = cut(_pack(candidates.withColumn("shard", at(shards)), "shard", lists=True), "topk-shards")
    asked = cut(_pack(queries.withColumn("block", at(blocks)), "block"), "topk-blocks")
    # Each pair of a shard and a block is one unit of work; the pairs are named, then joined by key.
    pairs = packed.select("shard", "d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    work = pairs.join(asked.select("block", "d", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs")), ["block", "d"]).join(packed, ["shard", "d"])

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Shards that meet the same block one after the other pass its queries' hits on, so each starts with a bound.
        now, hits = None, {}

        def done() -> pd.DataFrame:
            fit = lambda x: max(LOW, min(x, HIGH))
            rows = [(own, i, fit(s), fit(s >> 63), s & HIGH) for own, best_ in hits.items() for s, i in best_]
            return pd.DataFrame(rows, columns=["query_id", "vec_id", "score", "high", "low"]).astype("int64")

        for part in parts:
            for r in part.itertuples(index=False):
                if now is not None and now != (r.block, r.d):
                    yield done()
                    hits = {}
                now = (r.block, r.d)
                shard = Shard(np.frombuffer(r.ids, "<i8"), np.frombuffer(r.vs, "<i8").reshape(-1, r.d), np.frombuffer(r.orders, "<i4").reshape(-1, r.d))
                for own, q in zip(np.frombuffer(r.q_ids, "<i8").tolist(), np.frombuffer(r.q_vs, "<i8").reshape(-1, r.d)):
                    hits[own] = shard.top(q, k, own, hits.get(own))
        if now is not None:
            yield done()

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = work.select("block", "shard", "d", "ids", "vs", "orders", "q_ids", "q_vs").repartition(n, "block", "shard").sortWithinPartitions("block", "d", "shard")
    return best(dealt.mapInPandas(task, HITS), k)


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query over all shards; each task gives at most k, and the window's rank limit drops the
    others before they are dealt out."""
    w = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantise(table(spark, sf_dir, "embeddings"))
    return search(vectors.filter("vec_id % 100 = 0"), vectors)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
  CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
