"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain; expectation maximisation (Dawid and Skene's model) estimates
how each votes on good and on bad documents from the counts of vote patterns alone; the posterior of a bounded sample
of documents trains a linear scorer over hashed word shapes, words and word pairs, and the scorer decides about every
document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import let, spread, table

BUCKETS, TRAIN_ROWS, KEEP = 2048, 4000, 0.5  # buckets of shapes; as many of words and of pairs follow
AGAIN = "⟳"
GOOD, BAD, ABSTAIN = "1", "0", "2"


def shape(text: Column) -> Column:
    """A text's word shapes: digit runs 0, capital runs 9, single capitals A, other letter runs a; the rest stays.
    A word that the next one repeats gets a mark."""
    t = F.regexp_replace(text, r"(?<!\S)(\S++)(?=\s\1(?!\S))", f"$1{AGAIN}")
    t = F.regexp_replace(t, "[0-9]+", "0")
    t = F.regexp_replace(t, r"\p{Lu}{2,}", "9")
    t = F.regexp_replace(t, r"[\p{Ll}\p{Lo}\p{M}]+", "a")
    return F.regexp_replace(t, r"\p{Lu}", "A")


def shaped(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _words (array of word shapes), _tokens (of the words in lower case) and _lines (of non-blank lines)."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    return docs.withColumn("_words", parts(shape(t))).withColumn("_tokens", parts(F.lower(t))).withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""))


def measured(at: DataFrame) -> DataFrame:
    """The columns of ``shaped`` replaced by what the labellers look at; shares are null without words or lines."""
    n = F.nullif(F.size("_words"), F.lit(0))
    share = lambda test: F.size(F.filter("_words", test)) / n
    lines = F.nullif(F.size("_lines"), F.lit(0))
    return at.withColumns({
        "_n": F.size("_words"),
        "_symbols": share(lambda w: w.rlike(r"[#$%&*~^=<>_@\\]{2,}")),
        "_pipes": share(lambda w: w.isin("|", "•", "·", "/", "\\", "-", "||")),
        "_capitals": share(lambda w: w.startswith("9")),
        "_shouting": share(lambda w: w.contains("!!")),
        "_again": share(lambda w: w.contains(AGAIN)),
        "_plain": share(lambda w: w.isin("a", "Aa", "A", "a.", "a,", "Aa.", "Aa,", "a;", "a:", "a?", "a!", "(a", "a)", "A.", "A,", "'a", "a'", "a'a", "a’a", "a-a")),
        "_ends": F.size(F.filter("_lines", lambda x: F.right(F.rtrim(x), F.lit(1)).isin(*".!?:;…\"”»)"))) / lines,
        "_distinct": F.size(F.array_distinct("_lines")) / lines,
    }).drop("_words", "_tokens", "_lines")


def labellers() -> dict[str, Column]:
    """name -> vote, on the columns of ``measured``; documents without words get only abstentions."""

    def vote(value: str, bad, good=None) -> Column:
        v = F.col(value)
        seen = F.when((F.col("_n") > 0) & bad(v), BAD)
        return (seen if good is None else seen.when((F.col("_n") > 0) & good(v), GOOD)).otherwise(ABSTAIN)

    # What marks junk says nothing about a text without it; only the two measures of prose vote both ways.
    return {
        "symbols": vote("_symbols", lambda v: v > 0.2),
        "pipes": vote("_pipes", lambda v: v > 0.15),
        "capitals": vote("_capitals", lambda v: v > 0.4),
        "shouting": vote("_shouting", lambda v: v > 0.2),
        "again": vote("_again", lambda v: v > 0.25),
        "plain": vote("_plain", lambda v: v < 0.6, lambda v: v > 0.85),
        "ends": vote("_ends", lambda v: v < 0.2, lambda v: v > 0.6),
        "repeats": vote("_distinct", lambda v: v < 0.3),
    }


def votes() -> Column:
    return F.concat(*labellers().values())


@dataclass
class LabelModel:
    """Class prior and, for each labeller, class (bad, good) and vote (0, 1, 2), a probability."""

    prior: np.ndarray
    rates: np.ndarray

    def posterior(self, patterns: list[str]) -> np.ndarray:
        v = np.array([[int(c) for c in p] for p in patterns], int).reshape(len(patterns), self.rates.shape[0])
        log = np.log(self.prior)[None, :] + sum(np.log(self.rates[j][:, v[:, j]]).T for j in range(v.shape[1]))
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(axis=1)


def expectation_maximisation(patterns: list[str], counts: list[int], rounds: int = 100) -> LabelModel:
    """Fit a ``LabelModel`` to counted vote patterns; the start is the majority vote, which also fixes which class is good."""
    v = np.array([[int(c) for c in p] for p in patterns], int)
    w = np.array(counts, float)
    p = 0.5 + 0.49 * np.tanh((v == 1).sum(axis=1) - 2.0 * (v == 0).sum(axis=1))
    for _ in range(rounds):
        post = np.stack([1 - p, p])
        prior = np.clip((post * w).sum(axis=1) + 1, 1e-9, None)
        prior /= prior.sum()
        rates = np.empty((v.shape[1], 2, 3))
        for j in range(v.shape[1]):
            for c in range(2):
                rates[j, c] = [(post[c] * w)[v[:, j] == k].sum() + 1 for k in range(3)]
        rates /= rates.sum(axis=2, keepdims=True)
        model = LabelModel(prior, rates)
        new = model.posterior(patterns)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return model


@dataclass
class Scorer:
    """Linear in the shares of hashed word shapes; ``score`` is the probability of a good document."""

    weights: np.ndarray
    bias: float

    def column(self) -> Column:
        """On the columns of ``shaped``; a document without words scores 0."""
        w = F.split(F.lit(",".join(f"{x:.6g}" for x in self.weights)), ",").cast("array<double>")
        total = F.aggregate(places(len(self.weights) // 3), F.lit(0.0), lambda a, x: a + F.get(w, x))
        n = F.size("_words")
        return F.when(n == 0, 0.0).otherwise(1 / (1 + F.exp(-(total / n + F.lit(float(self.bias))))))


def places(buckets: int = BUCKETS) -> Column:
    """The features of a document, on the columns of ``shaped``: for each word the bucket of its shape, of itself and of the
    pair that it makes with the next."""
    at = lambda part, *of: (F.pmod(F.xxhash64(*of), F.lit(buckets)) + part * buckets).cast("int")
    words = lambda w: F.flatten(F.transform(w, lambda x, i: F.array(at(1, x), at(2, x, F.get(w, i + 1)))))
    return F.concat(F.transform("_words", lambda x: at(0, x)), let(F.col("_tokens"), words))


def train(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, target: np.ndarray, buckets: int = BUCKETS, rounds: int = 150, l2: float = 1e-4, rate: float = 20.0) -> Scorer:
    """Logistic regression on soft targets over ``3 * buckets`` features (document, feature, value), each class with half of the
    weight, by accelerated gradient steps."""
    size = 3 * buckets
    n = max(len(target), 1)
    good = np.clip(target.sum(), 1e-3, None)
    weight = target * (0.5 / good) + (1 - target) * (0.5 / max(n - good, 1e-3))
    # A vote that a share of common shapes decides needs no tiny steps: the shares of a document sum to 1.
    w, b = np.zeros(size), 0.0
    mw, mb = w.copy(), b
    for k in range(rounds):
        z = np.bincount(rows, vals * mw[cols], n) + mb
        g = (1 / (1 + np.exp(-z)) - target) * weight
        nw = mw - rate * (np.bincount(cols, vals * g[rows], size) + l2 * mw)
        nb = mb - rate / 10 * g.sum()
        beta = k / (k + 3)
        mw, mb = nw + beta * (nw - w), nb + beta * (nb - b)
        w, b = nw, nb
    return Scorer(w, b)


@dataclass
class Quality:
    labels: LabelModel
    scorer: Scorer


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, buckets: int = BUCKETS) -> Quality | None:
    """Vote patterns are counted over all documents; the scorer trains on the ``train_rows`` documents of the
    smallest key hashes.  None if no document has a word."""
    at = shaped(docs.select("doc_id", "text"))
    # As many rows as there are vote patterns (3 to the power of the labellers at most), not documents.
    found = measured(at).select(votes().alias("pattern")).groupBy("pattern").count().collect()
    found = [r for r in found if set(r["pattern"]) != {ABSTAIN}]
    if not found:
        return None
    labels = expectation_maximisation([r["pattern"] for r in found], [r["count"] for r in found])
    # The texts of the smallest key hashes: a bound that about twice as many are below is known from their number.
    texts, total = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).filter("length(text) > 0"), sum(r["count"] for r in found)
    below = texts.filter(F.col("h") < int(-(2**63) + 2**64 * min(1.0, 2 * train_rows / total) * 0.999999))
    if total > 2 * train_rows and below.select("h").limit(train_rows).count() == train_rows:
        texts = below
    rows = shaped(spread(texts.orderBy("h", "doc_id", "text").limit(train_rows).drop("h"))).withColumn("at", places(buckets))
    # Arrow keeps the features of a document as one array of 32-bit integers; as objects they would fill the driver.
    held = measured(rows).select(votes().alias("pattern"), "at").filter(F.size("at") > 0).toArrow().combine_chunks()
    if not held.num_rows:
        return None
    at = held["at"].combine_chunks()
    sizes, cols = np.diff(at.offsets.to_numpy()), at.flatten().to_numpy()
    key, n = np.unique(np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * (3 * buckets) + cols, return_counts=True)
    doc = key // (3 * buckets)
    target = labels.posterior(held["pattern"].to_pylist())
    return Quality(labels, train(doc, key % (3 * buckets), 3 * n / sizes[doc], target, buckets))


def score(docs: DataFrame, model: Quality | None, keep: float = KEEP) -> DataFrame:
    """``docs`` with quality_score and kept added (columns of these names are replaced)."""
    docs = docs.drop("quality_score", "kept")
    if model is None:
        return docs.withColumn("quality_score", F.lit(0.0)).withColumn("kept", F.lit(False))
    scored = shaped(docs).withColumn("quality_score", F.round(model.scorer.column(), 6))
    return scored.drop("_words", "_tokens", "_lines").withColumn("kept", F.col("quality_score") >= keep)


def classify(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """Fit on ``docs`` and score them.

    Null, empty and blank texts score 0 and are not kept; repeated rows score alike; an empty table stays empty.
    """
    return score(docs, fit(docs), keep)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spread(table(spark, sf_dir, "documents"))).select("doc_id", "quality_score", "kept")
