"""Column expressions: probabilities, vectors and the seeded uniform variate.

All of them are built-in expressions, so they stay inside the JVM and can be folded, pushed down and pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS, TINY = 1e-6, 1e-12
MODES = ("prob", "logit", "priorcorr", "priorcorr_logit", "rank", "priorcorr_rank")


def uniform(seed: int, tag: str, *parts: Column) -> Column:
    """A variate in [0, 1) from the md5 of seed, tag and parts: the same on every engine and partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def clip01(p: Column) -> Column:
    return clip(p, EPS, 1 - EPS)


def logit(p: Column) -> Column:
    p = clip01(p)
    return F.ln(p / (1 - p))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-clip(z, -50.0, 50.0)))


def prior_correct(p: Column, source: Column, target: Column) -> Column:
    """Move a probability from one class prior to another: its odds times the ratio of the priors' odds."""
    p, source, target = clip01(p), clip01(source), clip01(target)
    odds = p / (1 - p) * (target / (1 - target)) / (source / (1 - source))
    return clip01(odds / (1 + odds))


def blend(s0: Column, s1: Column, alpha: Column, mode: Column, r0: Column | None = None, r1: Column | None = None) -> Column:
    """Blend two scores by the mode's name: sigmoid of averaged logits, average of ranks (r0, r1), else average."""
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha))
    out = F.when(mode.isin("logit", "priorcorr_logit"), sigmoid((1 - a) * logit(s0) + a * logit(s1)))
    if r0 is not None:
        out = out.when(mode.isin("rank", "priorcorr_rank"), (1 - a) * r0 + a * r1)
    return out.otherwise((1 - a) * s0 + a * s1)


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def clean(f: Column) -> Column:
    """Array with null, NaN and infinite components replaced by 0."""
    return F.transform(f, lambda v: F.when(finite(v), v).otherwise(F.lit(0.0)))


def total(f: Column) -> Column:
    return F.aggregate(f, F.lit(0.0), lambda s, v: s + v)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def unit(a: Column) -> Column:
    """The vector at length 1; null if it is shorter than 1e-12 or not finite."""
    n = norm(a)
    return F.when(finite(n) & (n >= TINY), F.transform(a, lambda x: x / n))


def between(a: Column, b: Column, share: Column) -> Column:
    """The point at ``share`` of the way from a to b."""
    return F.zip_with(a, b, lambda x, y: x + share * (y - x))


def within(x: Column, lo: Column, hi: Column) -> Column:
    return F.forall(F.arrays_zip(x.alias("x"), lo.alias("lo"), hi.alias("hi")), lambda t: (t["x"] >= t["lo"]) & (t["x"] <= t["hi"]))


def clip_to(x: Column, lo: Column, hi: Column) -> Column:
    return F.zip_with(F.zip_with(x, lo, lambda a, b: F.greatest(a, b)), hi, lambda a, b: F.least(a, b))


def key(f: Column, decimals: int = 10) -> Column:
    """Rounded coordinates (half to even) as one string: equal points have equal keys."""
    return F.array_join(F.transform(f, lambda v: F.format_number(F.bround(v, decimals) + 0.0, decimals)), ",")


def need(n1: Column, n0: Column, ratio: Column | float) -> Column:
    """How many minority rows are missing for a ratio of minority to majority."""
    r = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    return F.greatest(F.lit(0), F.greatest(n1, F.ceil(r * n0)) - n1).cast("long")


def alpha_ratio(alpha: float, most: int = 100) -> str:
    """"original:shadow" as the closest fraction with a denominator of at most ``most``."""
    from fractions import Fraction

    a = Fraction(min(1.0, max(0.0, alpha))).limit_denominator(most)
    return f"{a.denominator - a.numerator}:{a.numerator}"


def residual(t: Column, u: Column) -> Column:
    """The length of what is left of t without its part along the unit vector u."""
    along = total(F.zip_with(t, u, lambda x, y: x * y))
    return F.get(F.transform(F.array(along), lambda a: norm(F.zip_with(t, u, lambda x, y: x - a * y))), 0)
