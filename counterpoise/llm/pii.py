"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from regular expressions: the base kinds (email, ip, card, phone), which are always reported, and
wider kinds, which are proposals.  For each candidate several labellers vote yes, no or abstain: the form of the text
(regex labellers), lists of words and provider names (gazetteer labellers) and the words before it (context
labellers).  Expectation maximisation over the counts of vote patterns estimates how reliable each labeller is, the
posteriors train a logistic span classifier on the votes and on traits of the span (length, separators, edges, the word
before it), and the classifier decides which proposals are spans.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, let, spread, table

# Kinds in the order in which equal starts are listed, and their patterns.  The patterns match what the
# plain forms in the comments match; possessive quantifiers and look-behinds only keep long runs from being tried from
# every position.  \G (the end of the match before) admits a match that follows another without a gap.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[ -]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
PROPOSED = {
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+)(.-])(?<!\+[0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])",
    "hidden_email": r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,64}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,64}){1,4}",
    "person": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? \p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30}){0,2}",
}
KINDS = (*BASE, *PROPOSED)
#: A cheap test that a text must pass to hold the kind at all.
NEED = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "national_id": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
    "local_phone": lambda t: t.rlike(r"[0-9]{3}[-. ][0-9]{4}"),
    "hidden_email": lambda t: t.rlike(r"[\[(]at[\])]"),
    "person": lambda t: t.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? \p{Lu}"),
}
# Word lists.
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach)\W*(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:ip|address|host|server|from|client)\W*(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:card|visa|mastercard|credit|debit|payment|pan)\W*(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|dial|telefon|téléphone|teléfono)\W*(?:\w+\W+){0,2}$",
    "national_id": r"(?i)(?:ssn|social|security|id|tax|number)\W*(?:\w+\W+){0,2}$",
    "iban": r"(?i)(?:iban|account|konto|compte|cuenta|bank)\W*(?:\w+\W+){0,2}$",
    "local_phone": r"(?i)(?:phone|tel|call|mobile|fax|dial|telefon|téléphone|teléfono)\W*(?:\w+\W+){0,2}$",
    "hidden_email": r"(?i)(?:e-?mail|mail|contact|write|reach)\W*(?:\w+\W+){0,2}$",
    "person": r"(?i)(?:dear|by|from|with|name|signed|patient|contact)\W*(?:\w+\W+){0,2}$",
}
WARNINGS = r"(?i)(?:order|invoice|version|isbn|item|serial|token|hash|build|ref|sku|page|chapter|figure|example)\W*(?:\w+\W+){0,1}$"
GIVEN = r"\b(?:James|John|Robert|Michael|William|David|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Maria|Anna|Peter|Paul|Thomas|Hans|Karl|Pierre|Jean|Marie|Juan|Jose|Carlos|Carmen)\b"
YES, NO, SKIP = 1, 0, 2
LABELLERS = ("form", "checksum", "gazetteer", "context", "warning", "edges")
BEFORE = 40  # code points of context
CHUNK = 512  # elements of an array that are folded at once


def chunks(x: Column) -> Column:
    """An array in slices of CHUNK elements."""
    n = F.size(x)
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / CHUNK).cast("int") - 1, F.lit(0))), lambda b: F.slice(x, b * CHUNK + 1, F.lit(CHUNK)))
    return F.when(n > 0, cuts).otherwise(F.slice(cuts, 1, 0))


def sums_before(x: Column) -> Column:
    """For each element of an integer array the sum of those before it.

    Appending copies an array, so the elements of a slice are summed first and then the slices.
    """
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("got"))
    add = lambda a, v: F.struct((a["at"] + v).alias("at"), F.array_append(a["got"], a["at"]).alias("got"))
    whole = lambda parts, starts: F.flatten(F.transform(parts, lambda p, i: F.transform(p["got"], lambda v: v + F.get(starts, i))))
    return let(F.transform(chunks(x), lambda c: F.aggregate(c, zero, add)), lambda parts: let(F.aggregate(F.transform(parts, lambda p: p["at"]), zero, add, lambda a: a["got"]), lambda starts: whole(parts, starts)))


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match, before, after>> of the leftmost non-overlapping matches, in code points.

    The pieces between the matches and the matches are read by the same pattern; running sums of lengths give places.
    """
    both = F.struct(F.split(text, pattern).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def spans(b: Column) -> Column:
        steps = F.transform(b["m"], lambda m, i: F.length(F.get(b["p"], i)) + F.length(m))

        def span(m: Column, i: Column, at: Column) -> Column:
            p = F.get(b["p"], i)
            s = F.get(at, i) + F.length(p)
            return F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match"), F.right(p, F.lit(BEFORE)).alias("before"), F.left(F.get(b["p"], i + 1), F.lit(1)).alias("after"))

        return let(let(steps, sums_before), lambda at: F.transform(b["m"], lambda m, i: span(m, i, at)))

    return let(both, spans)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes: from the right every second digit is doubled, and nines are cast out."""
    n = F.length(d)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda a, i: a + F.when((n - i) % 2 == 0, F.substring(d, i, F.lit(1)).cast("int")).otherwise(F.pmod(F.substring(d, i, F.lit(1)).cast("int") * 2, F.lit(10)) + F.when(F.substring(d, i, F.lit(1)).cast("int") > 4, 1).otherwise(0)),
    )
    return total % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a base kind stands."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(digits(m)).between(12, 19) & luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def vote(kind: str, x: Column) -> list[Column]:
    """The votes of ``LABELLERS`` on a candidate of this kind."""
    m = x["match"]
    if_ = lambda yes, no=F.lit(False): F.when(yes, YES).when(no, NO).otherwise(SKIP)
    d = digits(m)
    form = {
        "email": if_(m.rlike(r"\.[A-Za-z]{2,}$"), m.rlike(r"\.[0-9]+$")),
        "ip": if_(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), F.lit(True)),
        "card": if_(F.length(d).between(13, 16), F.length(d) > 16),
        "phone": if_(F.length(d).between(10, 13), F.length(d) > 14),
        "national_id": if_(~m.rlike("^(?:000|666|9)"), F.lit(True)),
        "iban": if_(F.length(F.replace(m, F.lit(" "))).between(15, 34), F.lit(True)),
        "local_phone": if_(d.rlike("^[2-9][0-9]{2}[2-9]"), F.lit(True)),
        "hidden_email": if_(m.rlike(r"[A-Za-z]{2,}$"), F.lit(True)),
        "person": if_(m.rlike(r" \p{Lu}\p{Ll}+$")),
    }[kind]
    checksum = {
        "card": if_(luhn(d), F.lit(True)),
        "iban": if_(iban(m), F.lit(True)),
        "national_id": if_(~m.rlike("-00-|-0000$"), F.lit(True)),
    }.get(kind, F.lit(SKIP))
    gazetteer = {
        "email": if_(m.rlike(r"(?i)@(?:gmail|yahoo|hotmail|outlook|icloud|gmx|web|mail[0-9]*|proton)\."), m.rlike(r"(?i)^(?:no-?reply|example|test)@")),
        "ip": if_(m.rlike(r"^(?:10|172|192)\."), m.rlike(r"^(?:0|127|255)\.")),
        "card": if_(d.rlike("^(?:4|5[1-5]|3[47]|6011|2[2-7])"), d.rlike("^0")),
        "phone": if_(m.rlike(r"^\+(?:1|33|34|39|44|49)(?![0-9])")),
        "iban": if_(m.rlike("^(?:AT|BE|CH|DE|ES|FI|FR|GB|IE|IT|LU|NL|PL|PT|SE)"), F.lit(True)),
        "person": if_(m.rlike(GIVEN)),
    }.get(kind, F.lit(SKIP))
    context = if_(x["before"].rlike(CUES[kind]))
    warning = if_(F.lit(False), x["before"].rlike(WARNINGS))
    edges = if_(F.coalesce(x["before"].rlike(r"[\s(\"'<:]$") | (x["before"] == ""), F.lit(True)) & F.coalesce(~x["after"].rlike(r"[\p{L}\p{N}_@#%=]"), F.lit(True)), F.lit(True))
    return [form, checksum, gazetteer, context, warning, edges]


def iban(m: Column) -> Column:
    """ISO 13616: the text with its first four characters last, letters as 10 to 35, leaves 1 modulo 97."""
    s = F.replace(m, F.lit(" "))
    s = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(s, ""), F.lit(0), lambda a, c: F.when(c == "", a).when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97))
    return rest == 1


SPAN = "array<struct<start:int,k:int,end:int,base:boolean,votes:string,traits:string>>"
#: How many values each trait of a span has: its length, its separators, its first and last character, the word before it.
TRAITS = (8, 8, 8, 16)


def traits(x: Column) -> Column:
    """What the span classifier sees beside the votes: a hexadecimal digit for each of ``TRAITS``."""
    m = x["match"]
    long = F.least(F.floor(F.length(m) / 4), F.lit(7))
    has = lambda form, bit: F.when(m.rlike(form), bit).otherwise(0)
    between = has(" ", 1) + has("-", 2) + has(r"\.", 4)
    edge = has("^[0-9]", 1) + has("^[A-Z(+]", 2) + has("[0-9]$", 4)
    word = F.pmod(F.xxhash64(F.lower(F.regexp_extract(x["before"], r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1))), F.lit(TRAITS[-1]))
    return F.concat(*[F.lower(F.hex(t.cast("long"))) for t in (long, between, edge, word)])


def _spans_of(t: Column, k: int, kind: str) -> Column:
    def span(x: Column) -> Column:
        votes = F.concat(*[v.cast("string") for v in vote(kind, x)])
        return F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), F.lit(kind in BASE).alias("base"), votes.alias("votes"), traits(x).alias("traits"))

    got = found(t, (BASE | PROPOSED)[kind])
    return F.transform(F.filter(got, lambda x: valid(kind, x["match"])) if kind in BASE else got, span)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _spans: array<struct<start, k, end, base, votes, traits>>, k being the kind's place in KINDS."""
    t = F.coalesce(F.col(text), F.lit(""))
    groups = [F.when(NEED[kind](t), _spans_of(t, k, kind)).otherwise(F.array().cast(SPAN)) for k, kind in enumerate(KINDS)]
    return docs.withColumn("_spans", F.array_sort(F.concat(*groups)))


# --- the label model: it sees counts of vote patterns, of which there are at most 3 ** 6 for a kind ---


def estimate(patterns: list[tuple[str, float]], rounds: int = 60) -> tuple[float, list[list[list[float]]]]:
    """Prior of a true span and, for each labeller, class (no, yes) and vote, a probability."""
    n = len(LABELLERS)
    post = [1 / (1 + math.exp(-(v.count(str(YES)) - v.count(str(NO)) - 0.5))) for v, _ in patterns]
    prior, rates = 0.5, [[[1 / 3] * 3 for _ in range(2)] for _ in range(n)]
    for _ in range(rounds):
        total = sum(c for _, c in patterns)
        prior = (sum(p * c for p, (_, c) in zip(post, patterns)) + 1) / (total + 2)
        for j in range(n):
            for cls in range(2):
                weight = [1.0] * 3
                for p, (v, c) in zip(post, patterns):
                    weight[int(v[j])] += c * (p if cls else 1 - p)
                rates[j][cls] = [w / sum(weight) for w in weight]
        post = [posterior(v, prior, rates) for v, _ in patterns]
    return prior, rates


def posterior(votes: str, prior: float, rates: list[list[list[float]]]) -> float:
    z = math.log(prior / (1 - prior)) + sum(math.log(r[1][int(v)] / r[0][int(v)]) for v, r in zip(votes, rates))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(votes: str, held: str) -> list[int]:
    """The places of a span's features in the weights: a bias, yes and no of each labeller, the value of each trait."""
    out = [0, *(1 + 2 * j + (v == str(NO)) for j, v in enumerate(votes) if v != str(SKIP))]
    at = 1 + 2 * len(LABELLERS)
    for size, t in zip(TRAITS, held):
        out.append(at + int(t, 16))
        at += size
    return out


def train(groups: list[tuple[str, str, float]], target: list[float], rounds: int = 300, l2: float = 1e-2) -> list[float]:
    """Weights of a logistic classifier over ``features`` for (votes, traits, count) with soft targets."""
    at = [features(v, t) for v, t, _ in groups]
    rows = np.repeat(np.arange(len(at)), [len(a) for a in at])
    cols = np.array([i for a in at for i in a], int)
    y, c = np.array(target), np.array([n for *_, n in groups])
    c = c / max(c.sum(), 1.0)
    w = np.zeros(1 + 2 * len(LABELLERS) + sum(TRAITS))
    for _ in range(rounds):
        e = (1 / (1 + np.exp(-np.bincount(rows, w[cols], len(at)))) - y) * c
        w -= 1.0 * (np.bincount(cols, e[rows], len(w)) + l2 * w)
    return w.tolist()


def fit(spans: DataFrame) -> dict[int, list[float]]:
    """Classifier weights for each kind, from a table with _spans.

    What comes to the driver are counts of (kind, votes, traits): at most 3 ** 6 * 8 * 8 * 8 * 16 for each kind, however
    many spans there are.
    """
    counts = spans.select(F.explode("_spans").alias("s")).groupBy("s.k", "s.votes", "s.traits").count().collect()
    models = {}
    for k in sorted({r["k"] for r in counts}):
        groups = sorted((r["votes"], r["traits"], float(r["count"])) for r in counts if r["k"] == k)
        patterns: dict[str, float] = {}
        for v, _, n in groups:
            patterns[v] = patterns.get(v, 0.0) + n
        prior, rates = estimate(list(patterns.items()))
        belief = {v: posterior(v, prior, rates) for v in patterns}
        models[k] = train(groups, [belief[v] for v, *_ in groups])
    return models


def accepted(s: Column, models: dict[int, list[float]], least: float = 0.5) -> Column:
    """Whether a span stays: base spans always, proposals if the classifier says so."""
    keep = s["base"]
    bound = math.log(least / (1 - least))
    for k, w in models.items():
        if KINDS[k] in BASE:
            continue
        z, at = F.lit(w[0]), 1 + 2 * len(LABELLERS)
        for j in range(len(LABELLERS)):
            c = F.substring(s["votes"], j + 1, 1)
            z = z + F.when(c == str(YES), w[1 + 2 * j]).when(c == str(NO), w[2 + 2 * j]).otherwise(0.0)
        for j, size in enumerate(TRAITS):
            z = z + F.get(F.array(*[F.lit(x) for x in w[at : at + size]]), F.conv(F.substring(s["traits"], j + 1, 1), 16, 10).cast("int"))
            at += size
        keep = keep | ((s["k"] == k) & (z >= bound))
    return keep


def detect(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with spans: array<struct<start, k, end, base, votes, traits>> sorted by start and kind.

    Null and empty texts have no spans; repeated rows each get theirs; existing columns named spans and _spans are replaced.
    The candidates are written once, so the text is searched once however many passes the model makes.
    """
    docs = docs.drop("spans", "_spans")
    held = cut(candidates(docs if keep_text else docs.select("doc_id", "text")).drop(*([] if keep_text else ["text"])), "pii-spans")
    models = fit(held)
    return held.withColumn("spans", F.filter("_spans", lambda s: accepted(s, models))).drop("_spans")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span of ``detect``'s result by its kind in brackets; overlapping spans become one.

    The spans are worked off in slices, each of which takes its part from the head of the text that is left, so the
    time grows with the text and not with its square.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    t = F.col(text)
    start = F.struct(F.lit(0).alias("at"), t.alias("rest"), F.array().cast("array<string>").alias("out"))

    def slice_(a: Column, c: Column) -> Column:
        def step(b: Column, s: Column) -> Column:
            more = F.concat(b["out"], F.substring(a["rest"], b["at"] - a["at"] + 1, s["start"] - b["at"]), F.get(names, s["k"]))
            return F.struct(F.greatest(b["at"], s["end"]).alias("at"), F.when(s["start"] < b["at"], b["out"]).otherwise(more).alias("out"))

        done = F.aggregate(c, F.struct(a["at"].alias("at"), F.lit("").alias("out")), step)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.substring(a["rest"], d["at"] - a["at"] + 1, F.length(a["rest"])).alias("rest"), F.array_append(a["out"], d["out"]).alias("out")))

    whole = F.aggregate(chunks(F.col("spans")), start, slice_, lambda a: F.concat(F.array_join(a["out"], ""), a["rest"]))
    return found.withColumn(text, F.when(F.size("spans") > 0, whole).otherwise(t))


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)], F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(detect(spread(table(spark, sf_dir, "documents")), keep_text=False))
