"""Tree ensembles, one tree a task.

The training rows of a model are the unit of work: every tree sees all of them (drawn anew).  A block of at most
``BLOCK_BYTES`` is broadcast; a larger one is dealt out once for each tree, in pieces that a task gathers, and gives the same
trees.  What no task can hold is refused: ``distributed_forest`` (MLlib's) is the name for such tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .storage import written

#: Bytes of training data that are broadcast, bytes that a task may gather for one tree, and rows of a piece.
BLOCK_BYTES, TASK_BYTES, PIECE_ROWS = 64 << 20, 1 << 30, 4096

# The names that users type.
CLASSIFIERS = {
    "rf": "rf", "random_forest": "rf", "randomforest": "rf", "extratrees": "extratrees", "extra_trees": "extratrees", "bagged_cart": "bagged_cart", "baggedcart": "bagged_cart",
    "random_subspace_trees": "random_subspace_trees", "rst": "random_subspace_trees", "decision_tree": "decision_tree", "cart": "decision_tree", "distributed_forest": "distributed_forest",
}
# Names of the balanced ensembles.
RIVALS = ("balanced_random_forest", "balanced_bagging", "easy_ensemble", "rus_boost")


def canonical(name: str) -> str:
    key = str(name).strip().lower()
    if key not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {name!r}; known: {', '.join(sorted(set(CLASSIFIERS.values())))}")
    return CLASSIFIERS[key]


@dataclass(frozen=True)
class Plan:
    """How a tree is grown: rows drawn ("boot", "all", "balanced"), features tried at a node and a tree, thresholds."""

    trees: int
    rows: str = "boot"
    node_features: str = "all"
    tree_share: float = 1.0
    random_cuts: bool = False
    depth: int = 30
    boost: int = 0  # boosting rounds within a tree's task
    rate: float = 1.0
    weighted: bool = False


def plan(name: str, trees: int, weighted: bool = False) -> Plan:
    if name in RIVALS:
        return {
            "balanced_random_forest": Plan(trees, "balanced", "sqrt"), "balanced_bagging": Plan(trees, "balanced"),
            "easy_ensemble": Plan(20, "balanced", depth=1, boost=50), "rus_boost": Plan(1, "rus", depth=3, boost=trees, rate=0.5),
        }[name]
    made = {
        "rf": Plan(trees, "boot", "sqrt"), "extratrees": Plan(trees, "all", "sqrt", random_cuts=True), "bagged_cart": Plan(trees, "boot"),
        "random_subspace_trees": Plan(trees, "all", tree_share=0.5), "decision_tree": Plan(1, "all"),
    }[canonical(name)]
    return replace(made, weighted=weighted)


class Tree:
    """A CART classifier on weighted rows (Gini impurity), kept as flat arrays."""

    def __init__(self, p: Plan, rng: np.random.Generator) -> None:
        self.p, self.rng = p, rng
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Tree:
        d = x.shape[1]
        pool = np.arange(d) if self.p.tree_share >= 1 else self.rng.choice(d, max(1, int(self.p.tree_share * d)), replace=False)
        tries = max(1, int(np.sqrt(len(pool)))) if self.p.node_features == "sqrt" else len(pool)
        stack = [(np.arange(len(y)), 0, self._node())]
        while stack:
            rows, depth, at = stack.pop()
            weight, pos = w[rows].sum(), (w[rows] * y[rows]).sum()
            self.value[at] = pos / weight if weight else 0.0
            if depth >= self.p.depth or len(rows) < 2 or pos <= 0 or pos >= weight:
                continue
            best = (1e-12, -1, 0.0)
            for f in self.rng.permutation(pool)[:tries] if tries < len(pool) else pool:
                best = max(best, self._split(x[rows, f], y[rows], w[rows], weight, pos, int(f)), key=lambda b: b[0])
            if best[1] < 0:
                continue
            go = x[rows, best[1]] <= best[2]
            self.feature[at], self.cut[at] = best[1], best[2]
            self.left[at], self.right[at] = self._node(), self._node()
            stack += [(rows[go], depth + 1, self.left[at]), (rows[~go], depth + 1, self.right[at])]
        return self

    def _node(self) -> int:
        for a, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            a.append(v)
        return len(self.value) - 1

    def _split(self, v: np.ndarray, y: np.ndarray, w: np.ndarray, weight: float, pos: float, f: int) -> tuple[float, int, float]:
        parent = pos * (weight - pos) / weight
        if self.p.random_cuts:
            lo, hi = v.min(), v.max()
            if lo == hi:
                return 0.0, -1, 0.0
            cut = self.rng.uniform(lo, hi)
            go = v <= cut
            lw, lp = w[go].sum(), (w[go] * y[go]).sum()
            if not 0 < lw < weight:
                return 0.0, -1, 0.0
            return parent - lp * (lw - lp) / lw - (pos - lp) * (weight - lw - pos + lp) / (weight - lw), f, float(cut)
        o = np.argsort(v, kind="stable")
        s, cw, cp = v[o], np.cumsum(w[o]), np.cumsum(w[o] * y[o])
        i = np.flatnonzero(s[1:] > s[:-1])
        if not len(i):
            return 0.0, -1, 0.0
        lw, lp = cw[i], cp[i]
        rw, rp = weight - lw, pos - lp
        gain = parent - lp * (lw - lp) / np.maximum(lw, 1e-300) - rp * (rw - rp) / np.maximum(rw, 1e-300)
        k = int(gain.argmax())
        return float(gain[k]), f, float((s[i[k]] + s[i[k] + 1]) / 2)

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right = np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.right)
        at = np.zeros(len(x), int)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return np.array(self.value)[at]
            a = at[inner]
            at[inner] = np.where(x[inner, feature[a]] <= cut[a], left[a], right[a])


def _draw(y: np.ndarray, how: str, rng: np.random.Generator) -> np.ndarray:
    if how == "boot":
        return rng.integers(0, len(y), len(y))
    if how == "balanced":
        groups = [np.flatnonzero(y == c) for c in (0, 1)]
        n = min(map(len, groups))
        return np.concatenate([rng.choice(g, n, replace=True) for g in groups]) if n else np.arange(len(y))
    return np.arange(len(y))


class Member:
    """One member of an ensemble: a tree, or a boosted sequence of trees with their votes' weights."""

    def __init__(self, x: np.ndarray, y: np.ndarray, p: Plan, seed: int) -> None:
        rng = np.random.default_rng(seed)
        base = np.ones(len(y))
        if p.weighted:
            for c in (0, 1):
                base[y == c] = len(y) / (2 * max(1, int((y == c).sum())))
        self.boosted = bool(p.boost)
        self.trees: list[tuple[Tree, float]] = []
        if not p.boost:
            rows = _draw(y, p.rows, rng)
            self.trees = [(Tree(p, rng).fit(x[rows], y[rows], base[rows]), 1.0)]
            return
        rows = np.arange(len(y)) if p.rows == "rus" else _draw(y, p.rows, rng)
        bx, by = x[rows], y[rows]
        w = np.full(len(rows), 1.0 / len(rows))
        for _ in range(p.boost):
            take = _draw(by, "balanced", rng) if p.rows == "rus" else np.arange(len(by))
            tree = Tree(p, rng).fit(bx[take], by[take], w[take])
            wrong = (tree.predict(bx) >= 0.5) != by
            err = float(np.clip(w[wrong].sum() / w.sum(), 1e-10, 1 - 1e-10))
            step = p.rate * np.log((1 - err) / err)
            if step <= 0:
                continue
            self.trees.append((tree, step))
            w = w * np.exp(np.where(wrong, step, 0.0))
            w /= w.sum()
            if err <= 1e-9:
                break

    def scores(self, test: np.ndarray) -> np.ndarray:
        if not self.boosted:
            return self.trees[0][0].predict(test)
        votes, total = np.zeros(len(test)), 0.0
        for tree, step in self.trees:
            votes += step * (2.0 * (tree.predict(test) >= 0.5) - 1)
            total += step
        return 1 / (1 + np.exp(-2 * votes / max(total, 1e-12)))


def fit_score(train: DataFrame, test: DataFrame, name: str, trees: int = 50, seed: int = 42, weighted: bool = False) -> DataFrame:
    """row_id, y, score of the test rows: the mean over the members, one member a row of work."""
    if name not in RIVALS and canonical(name) == "distributed_forest":
        return _distributed(train, test, trees, seed, weighted)
    spark = train.sparkSession
    p = plan(name, trees, weighted)
    size = train.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).first()
    if not size["n"]:
        return test.select("row_id", "y", F.lit(0.0).alias("score"))
    bytes_ = size["n"] * (size["d"] + 1) * 8
    if bytes_ > TASK_BYTES:
        raise ValueError(f"{name}: {bytes_} bytes of training rows are more than a tree's task may gather ({TASK_BYTES}); use distributed_forest")
    members = F.explode(F.sequence(F.lit(0), F.lit(p.trees - 1))).alias("member")
    asked = test.select("row_id", "features", "y", members)
    score = _broadcast_members if bytes_ <= BLOCK_BYTES else _gathered_members
    n = max(1, min(p.trees, spark.sparkContext.defaultParallelism))
    return score(train, asked, members, p, seed, n).groupBy("row_id", "y").agg(F.avg("s").alias("score"))


SCORED = "row_id long, y int, s double"


def _broadcast_members(train: DataFrame, asked: DataFrame, members: Column, p: Plan, seed: int, n: int) -> DataFrame:
    rows = train.select("row_id", "features", "y").orderBy("row_id").toPandas()
    block = train.sparkSession.sparkContext.broadcast((np.stack(rows["features"].to_list()).astype(float), rows["y"].to_numpy(int)))

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = block.value
        at, member = None, None
        for part in parts:
            for m in sorted(set(part["member"])):
                if m != at:
                    at, member = m, Member(x, y, p, seed * 100_003 + int(m))
                own = part[part["member"] == m]
                yield pd.DataFrame({"row_id": own["row_id"], "y": own["y"], "s": member.scores(np.stack(own["features"].to_list()).astype(float))})

    return asked.repartition(n, "member").sortWithinPartitions("member", "row_id").mapInPandas(task, SCORED)


def _gathered_members(train: DataFrame, asked: DataFrame, members: Column, p: Plan, seed: int, n: int) -> DataFrame:
    """The training rows in pieces, dealt out once for each member before the rows that it scores."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), PIECE_ROWS):
                own = part.iloc[at : at + PIECE_ROWS]
                x = np.stack(own["features"].to_list()).astype("<f8")
                yield pd.DataFrame([{"ids": own["row_id"].to_numpy("<i8").tobytes(), "labels": own["y"].to_numpy("i1").tobytes(), "piece": x.tobytes()}])

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, member, held = None, None, []
        for part in parts:
            for m, own in part.groupby("member", sort=True):
                if m != at:
                    at, member, held = m, None, []
                pieces = own[own["scored"] == 0]
                held += list(zip(pieces["ids"], pieces["labels"], pieces["piece"]))
                own = own[own["scored"] == 1]
                if not len(own):
                    continue
                if member is None:
                    ids, y = (np.frombuffer(b"".join(h[i] for h in held), t) for i, t in ((0, "<i8"), (1, "i1")))
                    x = np.frombuffer(b"".join(h[2] for h in held), "<f8").reshape(len(ids), -1)
                    held, o = [], np.argsort(ids, kind="stable")
                    member = Member(x[o], y[o].astype(int), p, seed * 100_003 + int(m))
                yield pd.DataFrame({"row_id": own["row_id"], "y": own["y"], "s": member.scores(np.stack(own["features"].to_list()).astype(float))}).astype({"row_id": "int64", "y": "int32"})

    packed = written(train.select("row_id", "features", "y").mapInPandas(pack, "ids binary, labels binary, piece binary"))
    none = lambda t, name: F.lit(None).cast(t).alias(name)
    rows = packed.select(members, F.lit(0).alias("scored"), none("long", "row_id"), none("array<double>", "features"), none("int", "y"), "ids", "labels", "piece")
    asked = asked.select("member", F.lit(1).alias("scored"), "row_id", F.col("features").cast("array<double>").alias("features"), "y", *[none("binary", c) for c in ("ids", "labels", "piece")])
    return rows.union(asked).repartition(n, "member").sortWithinPartitions("member", "scored", "row_id").mapInPandas(task, SCORED)


def _distributed(train: DataFrame, test: DataFrame, trees: int, seed: int, weighted: bool) -> DataFrame:
    """MLlib's random forest: histogram splits over the whole table, for tables that no task can hold."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    c = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(c.values())
    weight = F.when(F.col("y") == 1, n / (2.0 * c.get(1, 1))).otherwise(n / (2.0 * c.get(0, 1))) if weighted else F.lit(1.0)
    model = RandomForestClassifier(featuresCol="v", labelCol="y", weightCol="w", numTrees=trees, maxDepth=20, maxBins=128, featureSubsetStrategy="sqrt", seed=seed)
    fitted = model.fit(train.select(array_to_vector("features").alias("v"), F.col("y").cast("double").alias("y"), weight.alias("w")))
    return positive_scores(fitted.transform(test.withColumn("v", array_to_vector("features"))).withColumn("probability", vector_to_array("probability")), [float(x) for x in range(fitted.numClasses)])


def positive_scores(scored: DataFrame, classes: list[float] | None = None) -> DataFrame:
    """row_id, y, score of class 1 from what a fitted model of any kind left in ``scored``.

    probability (array<double>, by ``classes``): the value of class 1, 0 if the model never saw it; else raw (double, a
    decision value): scaled to [0, 1] over all rows, 0.5 where all are equal; else prediction.
    """
    if "probability" in scored.columns:
        at = classes.index(1.0) if classes and 1.0 in classes else None if classes else 1
        value = F.lit(0.0) if at is None else F.when(F.size("probability") > at, F.get("probability", F.lit(at))).otherwise(0.0)
        return scored.select("row_id", "y", value.alias("score"))
    if "raw" in scored.columns:
        span = scored.agg(F.min("raw").alias("_lo"), F.max("raw").alias("_hi"))
        value = F.when(F.col("_hi") - F.col("_lo") > 1e-12, (F.col("raw") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
        return scored.crossJoin(F.broadcast(span)).select("row_id", "y", value.alias("score"))  # one row
    return scored.select("row_id", "y", F.col("prediction").cast("double").alias("score"))
