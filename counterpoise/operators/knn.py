"""Exact nearest neighbours by blocks.

One kernel serves every size: a product of matrices gives approximate squared distances of a block of queries to a block
of base rows, everything within the rounding error of the kth is kept, and the distances of what is kept are summed
anew from the first dimension to the last.  A base of one block is broadcast and its k rows are final; larger bases and
their queries are packed into blocks that meet by block number, and only k rows for each query and block leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .storage import written

#: Rows and bytes of a base that is broadcast whole, rows of a block beyond.
SMALL, SMALL_BYTES, BLOCK = 20_000, 64 << 20, 4096
CHUNK = 256  # queries at a time


def block_top(qi: np.ndarray, x: np.ndarray, bi: np.ndarray, y: np.ndarray, k: int, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, base's place, distance, rank from 1) of each query's k nearest base rows, ties to the smaller id.

    Rows with a component that is not finite are nobody's neighbour and have none.
    """
    out = []
    if len(y) and len(x):
        fine = np.isfinite(y).all(axis=1)
        yy = np.where(fine[:, None], y, 0.0)
        y2 = np.where(fine, (yy * yy).sum(axis=1), np.inf)
        for at in range(0, len(x), CHUNK):
            v = x[at : at + CHUNK]
            ok = np.isfinite(v).all(axis=1)
            v = np.where(ok[:, None], v, 0.0)
            v2 = (v * v).sum(axis=1)
            a = v2[:, None] + y2[None, :] - 2 * (v @ yy.T)
            if skip_self:
                a[qi[at : at + CHUNK, None] == bi[None, :]] = np.inf
            a[~ok] = np.inf
            kth = np.partition(a, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
            slack = 8 * (x.shape[1] + 4) * np.finfo(float).eps * (v2 + y2[fine].max(initial=0.0))
            r, c = np.nonzero((a <= (kth + 2 * slack)[:, None]) & np.isfinite(a))
            d = np.zeros(len(r))
            for t in range(x.shape[1]):
                d += (v[r, t] - y[c, t]) ** 2
            d = np.sqrt(d)
            o = np.lexsort((bi[c], d, r))
            r, c, d = r[o], c[o], d[o]
            rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
            keep = rank <= k
            out.append((r[keep] + at, c[keep], d[keep], rank[keep]))
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0, int)
    return tuple(np.concatenate(p) for p in zip(*out))


def _ids(values) -> np.ndarray:
    return np.asarray(values) if pd.api.types.is_integer_dtype(values) else np.asarray(values, str)


def nearest(queries: DataFrame, base: DataFrame, k: int, skip_self: bool = False, small: int = SMALL) -> DataFrame:
    """q, j, d, rk: the k nearest base rows of each query (row_id, features), ties to the smaller row_id."""
    q = queries.select(F.col("row_id").alias("q"), F.col("features").cast("array<double>").alias("qf"))
    b = base.select(F.col("row_id").alias("j"), F.col("features").cast("array<double>").alias("bf"))
    hits = f"q {q.schema['q'].dataType.simpleString()}, j {b.schema['j'].dataType.simpleString()}, d double, rk int"
    held = b.limit(small + 1).toPandas() if small else None
    if held is None or len(held) > small or len(held) and len(held) * len(held["bf"].iloc[0]) * 8 > SMALL_BYTES:
        found = _blocked(q, b, k, skip_self, hits)
        w = Window.partitionBy("q").orderBy("d", "j")
        return found.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)
    whole = base.sparkSession.sparkContext.broadcast((held["j"].to_numpy(), np.stack(held["bf"].to_list()) if len(held) else np.empty((0, 0))))

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        j, y = whole.value
        for part in parts:
            if len(part):
                r, c, d, rank = block_top(_ids(part["q"]), np.stack(part["qf"].to_list()), _ids(j), y, k, skip_self)
                yield pd.DataFrame({"q": part["q"].to_numpy()[r], "j": j[c], "d": d, "rk": rank})

    return q.mapInPandas(task, hits)


def _blocked(q: DataFrame, b: DataFrame, k: int, skip_self: bool, hits: str) -> DataFrame:
    def packed(df: DataFrame, key: str) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // BLOCK))

        def pack(at: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([{"block": at[0], "ids": pdf[key].to_list(), "f": np.stack(pdf.iloc[:, 1].to_list()).astype("<f8").tobytes()}])

        kind = df.schema[key].dataType.simpleString()
        return written(df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n))).groupBy("block").applyInPandas(pack, f"block long, ids array<{kind}>, f binary")), n

    qs, _ = packed(q, "q")
    bs, n = packed(b, "j")
    work = qs.toDF("qb", "qi", "qf").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(bs, "block")

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                qi, bi = pd.Series(list(row.qi)), pd.Series(list(row.ids))
                x, y = np.frombuffer(row.qf, "<f8").reshape(len(qi), -1), np.frombuffer(row.f, "<f8").reshape(len(bi), -1)
                r, c, d, rank = block_top(_ids(qi), x, _ids(bi), y, k, skip_self)
                yield pd.DataFrame({"q": qi.to_numpy()[r], "j": bi.to_numpy()[c], "d": d, "rk": rank})

    return work.select("qi", "qf", "ids", "f").mapInPandas(task, hits)


def nearest_one(queries: DataFrame, base: DataFrame, skip_self: bool = False) -> DataFrame:
    return nearest(queries, base, 1, skip_self).select("q", "j", "d")
