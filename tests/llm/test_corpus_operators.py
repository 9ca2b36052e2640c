"""The corpus operators against brute force on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.llm import common, decontaminate, html, licences, minhash, packing, pii, quality, suffixes, topk, warc
from counterpoise.llm.queries import ORACLE_SQL, QUERIES

from oracle import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, small, name):
    same(QUERIES[name](spark, small), ORACLE_SQL[name], small)


# --- quality ---


def test_quality_on_held_out_labels(spark, small):
    """No label is used in fitting, so all labelled rows are held out."""
    docs, labels = common.table(spark, small, "documents"), common.table(spark, small, "labels")
    rows = quality.classify(docs).join(labels, "doc_id").select("kept", "quality").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in rows)
    assert right / len(rows) > 0.97
    clean = [r["kept"] for r in rows if r["quality"] == 1]
    assert sum(clean) / len(clean) > 0.98


def test_quality_edges(docs, empty):
    out = quality.classify(docs)
    assert out.count() == docs.count()
    assert not any(r["kept"] for r in out.filter("text is null or trim(text) = ''").collect())
    assert quality.classify(empty).count() == 0


# --- personal data ---

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii_base_spans(spark, docs, empty):
    rng = random.Random(1)
    noise = ["".join(rng.choice("aB1@.+- ()4_%\n9") for _ in range(60)) for _ in range(300)] + ["1" * 500 + "." + "2.3.4", "a.b" * 400 + "@x" + ".y" * 3000, "@" * 50, "+" + "1 " * 50]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(noise)], "doc_id long, text string"))
    got = collections.defaultdict(list)
    for r in pii.report(pii.detect(df)).collect():
        got[r["doc_id"]].append((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]))
        assert len(r["spans"].split(",")) >= r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] or not r["spans"]
    for i, t in [(r["doc_id"], r["text"] or "") for r in df.collect()]:
        spans = base_spans(t)
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans).encode()).hexdigest()
        assert (*[sum(x[3] == k for x in spans) for k in FORMS], digest) in got[i], t[:80]
    assert pii.detect(empty).count() == 0


def test_pii_models_find_more_and_redact(spark):
    rows = [(i, f"Contact: call 415-555-01{i:02d} or write to Dr. Anna Lee, mail me at x{i}@mail2.example.com") for i in range(20)]
    found = pii.detect(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = found.select(F.explode("spans").alias("s")).groupBy("s.k").count().collect()
    assert {pii.KINDS[r["k"]] for r in spans} >= {"email"}
    for r in pii.redact(found).collect():
        assert "@" not in r["text"] and "[EMAIL]" in r["text"]


def test_pii_takes_time_linear_in_the_spans(spark):
    """Many more spans than a slice holds, with a text between them that is longer than a code unit a character."""
    n = 5 * pii.CHUNK + 3
    text = "\U0001f600 ".join(f"a{i}@b{i % 7}.org" for i in range(n))
    found = pii.detect(spark.createDataFrame([(1, text, 7), (2, text[:200], 8)], "doc_id long, text string, _spans int"))
    rows = {r["doc_id"]: r for r in pii.report(found).collect()}
    for i, t in ((1, text), (2, text[:200])):
        want = ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(FORMS["email"], t))
        assert rows[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and rows[i]["spans"] == want
    assert {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}[1] == "\U0001f600 ".join(["[EMAIL]"] * n)


def test_pii_added_spans(spark):
    """Spans of the wider kinds in a corpus that holds plain and doubtful ones: the plain stay, overlaps become one mark."""
    rows = [(i, f"My ssn is 219-09-{1000 + i}. Call 415-555-{1000 + i} or write to jo{i} [at] mail [dot] org.") for i in range(40)]
    rows += [(100 + i, f"Account IBAN DE89370400440532013000 of Dr. Anna Lee, item {i}.") for i in range(40)]
    found = pii.detect(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: [(pii.KINDS[s["k"]], r["text"][s["start"] : s["end"]]) for s in r["spans"]] for r in found.collect()}
    assert ("national_id", "219-09-1003") in got[3] and ("local_phone", "415-555-1003") in got[3] and ("hidden_email", "jo3 [at] mail [dot] org") in got[3]
    assert ("iban", "DE89370400440532013000") in got[105] and ("person", "Dr. Anna Lee") in got[105]
    assert all("219-09" not in r["text"] and "DE89" not in r["text"] for r in pii.redact(found).collect())


def test_pii_runs_no_python(docs):
    plan = pii.candidates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- licences ---


def test_licences(spark, empty):
    mit = "Copyright (c) 2020 Someone\n" + dict((i, t) for i, t in licences.KNOWN)["MIT"]
    full = next(t for i, t in licences.KNOWN if i == "MIT" and len(t) > 500)
    rows = [(0, "Copyright (c) 2020 Someone\n\n" + full.replace("License", "Licence")), (1, "Prose.\nreleased under the mit licence\nMore."), (2, None), (3, ""), (4, "Prose\n\n" + full + "\n\nmore"), (5, "MIT is a school."), (1, "All rights reserved")]
    got = [(r["doc_id"], r["text_license"], r["unit_licenses"], r["n_units"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert (0, "MIT", "MIT", 1) in got and (4, None, "MIT", 1) in got and (2, None, "", 0) in got and (5, None, "", 0) in got
    assert sum(g[0] == 1 and g[2] == "LicenseRef-all-rights-reserved,MIT" for g in got) == 2
    assert licences.scan(empty).count() == 0 and mit
    bsd = next(t for i, t in licences.KNOWN if i == "BSD-3-Clause")
    files = [(1, f"BSD 3-Clause License\n\nCopyright (c) 2021, Someone\nAll rights reserved.\n\n{bsd}\n"), (2, f"Copyright 2021 X. All rights reserved.\n{bsd}"), (3, next(t for i, t in licences.KNOWN if i == "Unlicense"))]
    got = {r["doc_id"]: r["text_license"] for r in licences.scan(spark.createDataFrame(files, "doc_id long, text string")).collect()}
    assert got == {1: "BSD-3-Clause", 2: "BSD-3-Clause", 3: "Unlicense"}


# --- decontamination ---


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def grams(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def best_windows(docs, items):
    out = {}
    for i, t in docs:
        w = words(t)
        for k, item in items:
            v = words(item)
            if not v:
                continue
            for s in range(max(len(w) - len(v), 0) + 1):
                a, b = collections.Counter(grams(w[s : s + len(v)])), collections.Counter(grams(v))
                shared = sum((a & b).values())
                total = sum(a.values()) + sum(b.values()) - shared
                if shared and 100 * shared >= 75 * total and shared / total > (lambda x: x[0] / x[1])(out.get((i, k), (0, 1))):
                    out[i, k] = (shared, total)
    return out


def test_decontamination(spark, docs, empty):
    from conftest_llm import PASSAGE, TEXTS

    changed = PASSAGE.split()
    changed[-1] = "changed"
    items = [(0, PASSAGE), (1, " ".join(changed)), (2, None), (3, ""), (4, "two words"), (5, "x x x x x x x x"), (6, "never seen words of a benchmark item at all")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    more = spark.createDataFrame([(500, "y x x x x x x x x x z"), (501, TEXTS[8] + " " + " ".join(changed) + " tail")], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(more)
    got = {(r["doc_id"], r["item_id"]): (r["shared"], r["total"]) for r in decontaminate.contamination(df, bench).collect()}
    assert got == best_windows([(r["doc_id"], r["text"]) for r in df.collect()], items)
    assert (10, 0) in got and (501, 0) in got and (6, 4) in got
    kept = {r["doc_id"] for r in decontaminate.clean(df, bench).collect()}
    assert not kept & {i for i, _ in got} and len(kept) == len({r["doc_id"] for r in df.collect()} - {i for i, _ in got})
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.contamination(docs, bench.limit(0)).count() == 0


def test_decontamination_needs_no_near_fingerprint(spark):
    """Passages near the bound count, whatever their SimHash differs in and wherever their parts stand."""
    rng, items, texts = random.Random(11), [], []
    new = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    for i in range(410):
        w = new(18 if i < 400 else 60)
        k = (len(w) - 4) // 7
        if i < 400:
            passage = new(k) + w[k:] if i % 2 else w[:-k] + new(k)
        else:  # the halves changed places: no half is where the item has it
            passage = w[30:] + w[:30]
        items.append((i, " ".join(w)))
        texts.append((i, " ".join([*new(40), *passage, *new(40)])))
    found = decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for t, i in zip(texts, items):
        want |= best_windows([t], [i])
    assert len(want) == 410 and {(r["doc_id"], r["item_id"]): (r["shared"], r["total"]) for r in found} == want
    assert any(r["hamming"] > decontaminate.RADIUS for r in found)


def test_decontamination_runs_no_python(spark, small, monkeypatch):
    """Neither the result's plan nor those of the tables written on the way leave the JVM."""
    plans = []
    plain = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(decontaminate, "cut", lambda df, what: plans.append(plain(df)) or common.cut(df, what))
    out = decontaminate.contamination(common.table(spark, small, "documents"), common.table(spark, small, "benchmark"))
    assert len(plans) == 3 and not any(x in p for p in [*plans, plain(out)] for x in ("Python", "Arrow", "Pandas"))


def test_block_index_meets_every_pair_within_the_radius():
    rng = random.Random(2)
    masks, width = set(decontaminate.near_masks()), decontaminate.BITS // decontaminate.BLOCKS
    for _ in range(300):
        bits = rng.sample(range(64), decontaminate.RADIUS)
        x = sum(1 << b for b in bits)
        assert any((x >> (width * b)) & ((1 << width) - 1) in masks for b in range(decontaminate.BLOCKS))


def test_simhash(spark):
    rng = random.Random(3)
    lists = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 7, 40)]
    for lanes in (2, 4):
        rows = spark.createDataFrame([(v,) for v in lists], "h array<long>").select("h", decontaminate.simhash(F.col("h"), lanes).alias("s")).collect()
        for r in rows:
            want = sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in r["h"]) > len(r["h"]))
            assert r["s"] % (1 << 64) == want


# --- html ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="home menu-open">
<header>Site</header><nav><a href="/x">Menu</a></nav><!-- ad <p>no</p> --><div class="ad"><div>Buy</div> now</div><div id="cookie-banner">Cookies</div>
<article><header><h1>Head &amp; line</h1></header><p><b>First</b> block&nbsp;with
   space.<br>Same block<p>Second &lt;b&gt; &#233;</p><ul><li>Item</li></ul><aside>Side</aside><form><p>Name</p></form><div class="comments"><p>Reader</p></div></article><footer>&copy; x</footer></body></html>"""


def test_html_article():
    found = html.blocks(PAGE)
    assert "\n".join(t for t, inside in found if inside) == "Head & line\nFirst block with space. Same block\nSecond <b> é\nItem"
    assert html.blocks("") == [] and html.blocks("<") == [("<", False)] and html.blocks("a < b <p>c") == [("a < b", False), ("c", False)]
    assert html.blocks("<head><title>t</title><body><p class='ad'>Buy<p>Text") == [("Text", False)]
    assert html.blocks('<a title="x>y">k</a>' + "<p " + "a='" * 2000) is not None


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_common_lines():
    rng = random.Random(4)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        got = [x for x, s in zip(a, html.common_lines(a, b)) if s]
        rest = iter(b)
        assert len(got) == lcs(a, b) and all(x in rest for x in got)


def test_html_parts_of_an_article_stay():
    """Headings and parts named after what they are about are text; parts named as adverts, comments or shares are not."""
    body = '<h2 id="related-work">Related work</h2><h2 id="comments">On comments</h2><section id="social-history"><p>History</p></section><p class="ad-hoc">Ad hoc</p><div class="search-results form">Found</div>'
    away = '<div class="ad">Buy</div><div class="x comments">Said</div><div id="disqus_thread">More</div><ul class="share-buttons"><li>Post</ul>'
    found = html.blocks(f"<article><h1>T</h1>{body}{away}</article>")
    assert [t for t, _ in found] == ["T", "Related work", "On comments", "History", "Ad hoc", "Found"]
    assert [t for t, _ in html.blocks(f'<div class="top-menu">M</div><div>{body}</div>{away}')] == ["Related work", "On comments", "History", "Ad hoc"]


@pytest.mark.parametrize("partitions", [1, 4, 200])
def test_html_differencing(spark, partitions):
    page = lambda body: f"<div>Top line</div><div>{body}</div><div>Bottom line</div>"
    rows = [(1, "http://a.org/x/1", page("One")), (2, "http://a.org/x/2?q=1", page("Two")), (3, "http://b.org/1", page("Alone")), (4, None, None), (5, "::bad[", ""), (6, "http://a.org/x/3", PAGE), (6, "http://a.org/x/3", PAGE)]
    rows += [(100 + i, f"http://c.org/{i:03d}", page(f"Text {i}")) for i in range(40)]
    rows += [(200, "http://c.org/007?print=1", page("Text 7")), (201, "http://c.org/020/", page("Text 20 changed"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = [(r["page_id"], r["text"], r["n_chars"]) for r in html.extract(df.coalesce(1)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == len(rows) and (4, "", 0) in got and (5, "", 0) in got and sum(g[0] == 6 and g[1].startswith("Head") for g in got) == 2
    assert (3, "Top line\nAlone\nBottom line", 26) in got and (1, "One", 3) in got
    # The other neighbour of the second page is an article: nothing outside of it is shared.
    assert (2, "Top line\nTwo\nBottom line", 24) in got
    assert all((100 + i, f"Text {i}", len(f"Text {i}")) in got for i in range(40)) and (200, "Text 7", 6) in got and (201, "Text 20 changed", 15) in got
    assert html.extract(df.limit(0)).count() == 0


def test_html_copies_are_no_template():
    """What one neighbour alone shares may be the text of a copy."""
    a, copy, other = (["Top", *body, "Bottom"] for body in (["One", "Two"], ["One", "Two", "Three"], ["Else"]))
    assert html.differenced(a, [copy, other]) == ["One", "Two"] and html.differenced(a, [other]) == ["One", "Two"]
    assert html.differenced(a, []) == a and html.differenced([], [a]) == []


def test_common_lines_of_long_pages():
    """Rows are kept in stretches; the whole of two long pages still meets."""
    a = [str(i % 700) for i in range(4000)]
    got = html.common_lines(["x", *a, "y"], ["z", *a])
    assert got == [False] + [True] * 4000 + [False]


def test_html_pages_with_articles_are_differenced(spark):
    """Every page is aligned with its neighbours; structure then restores what was deleted from an article."""
    page = lambda i: f"<nav>Menu</nav><article><h1>Head {i}</h1><p>Text {i}</p><p>Said by all</p></article><div>Beside</div><footer>{i}</footer>"
    rows = [(i, f"http://a.org/{i:02d}", page(i)) for i in range(20)] + [(30, "http://b.org/1", page(30))]
    rows += [(40 + i, f"http://c.org/{i}", "<nav>Menu</nav><div>Top</div><p>Copied</p>") for i in range(3)]
    got = {r["page_id"]: tuple(r)[2:] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i in [*range(20), 30]:
        text = f"Head {i}\nText {i}\nSaid by all"  # deleted: menu, the last line of the article, the line beside it
        assert got[i] == (text, len(text), *((3, 1) if i < 20 else (0, 0)))
    assert all(got[40 + i][0] == "Top\nCopied" for i in range(3))  # copies on both sides tell nothing


@pytest.mark.parametrize("article", [True, False])
def test_html_query_by_brute_force(spark, monkeypatch, article):
    """Neighbours by sorting, lines as texts: the same deletions on a table, with articles and with those made plain."""
    if not article:
        monkeypatch.setattr(html, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(html, "PATH_PAGES", 2)
    pages = common.table(spark, "/root/testdata/sf0.01", "pages")
    if not article:
        pages = pages.withColumn("html", F.regexp_replace("html", "(</?)article", "$1section"))
        pages = pages.union(pages.filter("page_id % 3 = 0").select(F.explode(F.array([F.col("page_id") + 1000 * k for k in range(1, 6)])), "url", F.concat("html", F.lit("<nav>Printed</nav>"))))
    rows = [(r["page_id"], html.site(r["url"]), html.parts(r["html"] or "")) for r in pages.collect()]
    first = {}
    for i, at, found in sorted(rows):
        first.setdefault(at, found)
    order, want = sorted(first), {}
    for i, at, found in rows:
        n = order.index(at)
        beside = [first[order[m]] for m in (n - 1, n + 1) if 0 <= m < len(order) and order[m][0] == at[0]]
        texts = [[x for x in p if x[1] != html.MARKED] for p in (found, *beside)]
        beside = [p for p, t in zip(beside, texts[1:]) if t != texts[0]]
        gone = [False] * len(found)
        for part in range(3):
            here = [j for j, x in enumerate(found) if x[1] == part]
            sides = [html.common_lines([found[j][0] for j in here], [t for t, k in p if k == part]) for p in beside]
            for j, *s in zip(here, *sides):
                gone[j] = bool(s) and all(s)
        kept = [t for (t, k), g in zip(found, gone) if k == html.ARTICLE or not article and k == html.REST and not g]
        want[i] = "\n".join(kept), sum(gone), sum(g for (_, k), g in zip(found, gone) if k == html.ARTICLE)
    got = {r["page_id"]: (r["text"], r["n_shared"], r["n_restored"]) for r in html.extract(pages).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 0


# --- packing ---


def test_packing(docs, empty, texts):
    path = packing.tokenizer_path()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    rows = packing.pack(common.cut(packing.tokenise(docs, path), "pieces")).collect()
    ids = collections.defaultdict(list)
    for i, t in texts:
        ids[i].append(np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4"))
    assert sum(r["length"] for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for r in rows:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(common.cut(packing.tokenise(empty, path), "pieces")).count() == 0


def test_word_cache_is_exact():
    w = packing.WordIds(packing.tokenizer_path(), most=5)
    for t in ("Hello, WORLD's  çé́   x y\tz", "a\x1cb !\x1c! c", "<|endoftext|> tail<|startoftext|>", "́ lone", "3.14159 " * 20, "ΣΑΣ ΟΔΟΣ", "z" * 500):
        assert w.text(t) == w.ids(t), t


@pytest.mark.parametrize("seed", range(4))
def test_column_generation_covers_the_demand(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 3000)
    demand = np.bincount(lengths, minlength=65)[1:]
    plans = packing.column_generation(demand, 64)
    assert (sum(a * n for a, n in plans) == demand).all()
    assert all((a * np.arange(1, 65)).sum() <= 64 for a, _ in plans)
    used = sum(n for _, n in plans)
    assert used <= 1.01 * lengths.sum() / 64 + 40
    rows = packing.slots(plans)
    for u in range(1, 65):
        spans = sorted((first, after) for unit, first, after, *_ in rows if unit == u)
        assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]][: len(spans)] and (spans[-1][1] if spans else 0) == demand[u - 1]


# --- warc ---


def test_warc(spark, tmp_path):
    big = "<p>" + "equal " * 40
    rows = [(5, "http://a/\r\nX: y", big), (3, "http://b/é", big), (9, None, big), (1, "u", None), (2, "u", "short"), (4, "u", "short"), (7, "u", big + "!"), (7, "u", big + "!"), (None, "n", "x" * 300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    uri = f"file://{tmp_path}/w"
    manifest = warc.write(warc.with_refers(df), uri, roll_bytes=600, shards=2)
    got = warc.read(spark, manifest, uri).collect()
    assert len(got) == len(rows) and len({r["path"] for r in got}) > 1
    for r in got:
        body = next((h or "").encode() for i, _, h in rows if i == r["page_id"])
        assert r["payload_digest"] == hashlib.sha256(body).hexdigest() and r["payload_bytes"] == len(body)
        assert r["record_type"] == ("revisit" if r["page_id"] in (5, 9) else "response") and r["refers_to"] == (3 if r["page_id"] in (5, 9) else None)
        assert r["payload"] == (None if r["record_type"] == "revisit" else body)
    # Every revisit names the record that it repeats, and every file opens with a description of itself.
    names = {r["record_id"]: r for r in got}
    assert len(names) == len(got) and all(names[r["refers_id"]]["page_id"] == r["refers_to"] for r in got if r["record_type"] == "revisit")
    import gzip

    assert all(gzip.open(f).read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for f in (tmp_path / "w").glob("*.warc.gz"))
    assert not (tmp_path / "w/_temporary").exists()
    a, b = (sorted((r["path"], r["sha256"]) for r in spark.read.json(m).collect()) for m in (manifest, warc.write(warc.with_refers(df), f"file://{tmp_path}/v", 600, shards=2)))
    assert a == b
    # A file that no manifest names does not exist for the reader.
    (tmp_path / "w/shard-99999-00000-lost.warc.gz").write_bytes(b"garbage")
    assert warc.read(spark, manifest, uri).count() == len(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


# --- near-duplicates ---


def linked(docs):
    sets = {i: frozenset(grams(words(t))) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(spark, docs, empty, texts):
    rng = random.Random(6)
    from conftest_llm import prose

    base = prose(150, 77).split()
    near = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        near.append((1000 + i, " ".join(w)))
    df = docs.select("doc_id", "text", "kept").union(spark.createDataFrame([(i, t, True) for i, t in near], "doc_id long, text string, kept boolean"))
    want = linked([(i, t) for i, t in [*texts, *near] if i is not None])
    for options in ({}, {"split": 4, "block": 2}, {"block_shingles": 200}):
        got = minhash.near_duplicates(df, **options).collect()
        assert len(got) == df.count()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert minhash.near_duplicates(empty).count() == 0


def test_links_within_buckets_need_no_leader(spark, monkeypatch):
    """Without any leader links, the comparison inside buckets alone must find every component, split groups included."""
    rng = random.Random(8)
    from conftest_llm import prose

    base = prose(120, 5).split()
    rows = []
    for i in range(25):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "estimate", lambda e, s, least: spark.createDataFrame([], "a long, b long, share double"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, split=3, block=2).collect()}
    assert got == linked(rows)


def test_links_in_large_buckets_need_one_band(spark, monkeypatch):
    """Pairs that meet in one band alone are found in buckets above every bound as below."""
    rng = random.Random(12)
    from conftest_llm import prose

    rows = []
    for g in range(6):
        base = prose(60, 40 + g).split()
        for i in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(99)}"
            rows.append((100 * g + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "estimate", lambda e, s, least: spark.createDataFrame([], "a long, b long, share double"))
    for options in ({}, {"split": 2, "block": 1}):
        # One band of one row: whoever meets, meets there and nowhere else.
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, bands=1, rows=1, num=55, **options).collect()}
        if not options:
            want = got
    assert got == want and len(set(want.values())) < len(rows)


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


# --- top-k ---


@pytest.mark.parametrize("shape", ["random", "ties", "zeros", "skew"])
def test_threshold_algorithm(shape):
    rng = np.random.default_rng(1)
    v = rng.integers(-50, 50, (700, 6)) if shape == "random" else rng.integers(0, 2, (700, 6)) if shape == "ties" else np.zeros((700, 6), int) if shape == "zeros" else (rng.pareto(1, (700, 6)) * 20).astype(int)
    v, ids = v.astype(np.int64), rng.permutation(5000)[:700].astype(np.int64)
    shard = topk.Shard(ids, v)
    for r in range(0, 700, 50):
        s = v @ v[r]
        want = sorted((-int(x), int(i)) for x, i in zip(s, ids) if i != ids[r])[:10]
        assert [(-a, b) for a, b in shard.top(v[r], 10, int(ids[r]))] == want


def test_scores_are_exact_for_wide_values(spark):
    """Products past 2**53 and past 2**63, by values of the query as well as of the shard; hits of another shard are kept."""
    rng = np.random.default_rng(3)
    for low, high in ((18, 40), (40, 62), (5, 62)):
        v = rng.integers(-(2**low), 2**low, (300, 8))
        shard, ids = topk.Shard(np.arange(300), v), list(range(300))
        for q in rng.integers(-(2**high), 2**high, (5, 8)):
            s = [sum(int(a) * int(b) for a, b in zip(x, q)) for x in v]
            want = sorted(zip(s, ids), key=lambda x: (-x[0], x[1]))
            assert shard.top(q, 10, -1) == want[:10]
            assert topk.Shard(np.arange(150, 300), v[150:]).top(q, 10, 7, topk.Shard(np.arange(150), v[:150]).top(q, 10, 7)) == [x for x in want if x[1] != 7][:10]
    rows = [(i, [float(2**30) * (i + 1), 1.0]) for i in range(30)]
    q = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r["vec_id"], r["score"]) for r in topk.search(q.filter("vec_id = 0"), q, shard_rows=8).orderBy("rank").collect()]
    assert got == [(i, 2**63 - 1) for i in range(29, 19, -1)]


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(2)
    v = np.zeros((20_000, 3), np.int64)
    v[:, 0] = rng.permutation(20_000)
    shard = topk.Shard(np.arange(20_000), v)
    shard.top(np.array([5, 0, 0]), 10, -1)
    assert (shard.mark == shard.turn).sum() < 1000


def test_search_edges(spark):
    rows = [(i, [float(i % 7), 1.0, -0.5]) for i in range(0, 120)] + [(200, None), (300, [1.0, None, 2.0]), (400, [float("nan"), 0.0, 0.0]), (500, [float("inf"), 0.0, 0.0]), (600, []), (700, [1.0])]
    q = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)))
    got = collections.defaultdict(list)
    for r in topk.search(q.filter("vec_id % 100 = 0"), q, shard_rows=16, block_rows=1).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    fine = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows[:120]}
    for i in (0, 100):
        want = sorted((-sum(a * b for a, b in zip(fine[i], v)), j) for j, v in fine.items() if j != i)[:10]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(want)]
    assert set(got) == {0, 100} or got[700] == []
    assert topk.search(q.limit(0), q.limit(0)).count() == 0


# --- suffixes ---


def removed(docs, length=50):
    first, out = {}, collections.defaultdict(list)
    order = sorted(docs, key=lambda d: (d[0] is None, d[0]))
    for i, t in order:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    for i, t in order:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            f = first[b[p : p + length]]
            if f is not None and (i is None or f < i):
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i].append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize("run_bytes", [1 << 22, 900])
def test_suffixes(spark, docs, empty, texts, run_bytes):
    rng = random.Random(9)
    blocks = ["".join(rng.choice("ab é") for _ in range(45)) for _ in range(6)]
    more = [(2000 + i, "".join(rng.choice(blocks) for _ in range(rng.randint(0, 7)))) for i in range(60)]
    df = docs.select("doc_id", "text", "score").union(spark.createDataFrame([(i, t, 0.0) for i, t in more], "doc_id long, text string, score double"))
    got = collections.defaultdict(list)
    for r in suffixes.remove_repeats(df, run_bytes=run_bytes, bucket_anchors=64, part_bytes=400).collect():
        got[r["doc_id"]].append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
    want = removed([*texts, *more])
    assert {i: sorted(v) for i, v in got.items()} == want
    # Anchors that leave the merge for being frequent: all, those of several runs, none.
    for hot in (0, 16):
        got = collections.defaultdict(list)
        for r in suffixes.remove_repeats(df, run_bytes=run_bytes, bucket_anchors=64, part_bytes=400, hot=hot).collect():
            got[r["doc_id"]].append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
        assert {i: sorted(v) for i, v in got.items()} == want
    assert suffixes.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("runs", [1, 2, 3, 7])
def test_loser_tree_merge(runs):
    rng = random.Random(runs)
    lists = [sorted(tuple(rng.randrange(3) for _ in range(4)) for _ in range(rng.randint(0, 30))) for _ in range(runs)]

    def common(a, b):
        n = 0
        while n < 4 and a[n] == b[n]:
            n += 1
        return n

    shared = [[0, *[common(a, b) for a, b in zip(x, x[1:])]][: len(x)] for x in lists]
    order, carried = suffixes.merge(lists, shared, 4)
    out = [lists[r][i] for r, i in order]
    assert out == sorted(x for v in lists for x in v)
    assert carried == [common(out[k - 1], out[k]) if k else 0 for k in range(len(out))]


def test_byte_lengths():
    rng = np.random.default_rng(5)
    rows = np.unique(rng.integers(0, 2, (300, 24)).astype(np.uint8), axis=0)
    words = rows.view(">u8")
    same = [0] + [next(k for k in range(24) if a[k] != b[k]) for a, b in zip(rows, rows[1:])]
    assert suffixes.byte_lengths(words, np.array([x // 8 for x in same])).tolist() == same


def test_front_coding():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 3, (200, 16)).astype(np.uint8)
    rows = rows[np.lexsort(rows.T[::-1])]
    assert (suffixes.front_decode(*suffixes.front_code(rows), 16) == rows).all()


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 101, 4000).astype(np.uint8)
    data[2500:2600] = data[100:200]
    at, h = suffixes.anchors(data)
    left, right = ({(int(p) - o, int(x)) for p, x in zip(at, h) if o <= p and p + suffixes.GRAM <= o + 50} for o in (130, 2530))
    assert left and {p for p, _ in left} & {p for p, _ in right}
