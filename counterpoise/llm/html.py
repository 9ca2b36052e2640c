"""Main-text extraction from web pages.

Every page is differenced: the paths of a host are put in order, a page is paired with its nearest paths on both sides,
all its text lines, menus and adverts included, are aligned with those of each by a longest common subsequence, and
lines that both share are deleted as template.  (A line that one side alone shares may be the text of a copy; a page at
the end of its host has one side only.)  Structure then checks what was deleted and what was left: the lines of an
article or main element are restored, since two articles of a site may share a sentence, and what is left of menus, headers,
footers, sidebars, forms, adverts, notices and reader comments, or stands beside an article, goes.  Scripts and styles are no
lines.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from math import isqrt
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, spread, table

# One pass over a page: comment, declaration, tag, text, or a lone '<'.
TOKEN = re.compile(r"<!--(?:(?!-->).)*+(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<([A-Za-z/][^>]*+)>|([^<]++)|(<)", re.S)
RAW = frozenset("script style template noscript textarea title svg math iframe object canvas select".split())
RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in RAW}
SKIP = frozenset("nav footer aside form button menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
MAIN = frozenset("article main".split())
#: Class and id names of parts that are no text.  Within an article only CERTAIN ones count, as whole names;
#: elsewhere any, and STRONG ones also as the first or last word of a container's class name.
CERTAIN = frozenset("ad ads advert adverts advertisement advertising sponsored promo sidebar comments commentlist comment-list comments-area comment-form respond disqus disqus_thread share sharing share-buttons social-share newsletter newsletter-signup related-posts related-articles cookie-banner cookie-notice breadcrumb breadcrumbs pagination pager".split())
STRONG = frozenset("ad ads advert adverts advertisement sponsored promo sidebar nav navbar navigation menu footer masthead breadcrumb breadcrumbs cookie cookies consent gdpr comments newsletter pagination".split())
MARKS = CERTAIN | STRONG | frozenset("banner header notice notices alert popup modal sponsor promotion subscribe social comment related widget toolbar login signup search form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ATTR = re.compile(r"([A-Za-z_:][\w:.-]*+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
WORD = re.compile(r"[A-Za-z]+")
SPACE = re.compile(r"\s+")


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LINES = HEADINGS | {"p"}
#: Where a line stands: in a part that is never text, in an article or main element, or in neither.
REST, ARTICLE, MARKED = range(3)
#: Differenced pages are joined by broadcast up to this size; pages of one path that are aligned in one group.
BROADCAST_BYTES = 32 << 20
PATH_PAGES = 10_000


def _marked(name: str, attrs: str, mains: int) -> bool:
    """Whether an element is a part that is never text.  The anchor of a heading (its id) says what it is about, not what it is."""
    if not attrs or name in ("html", "body"):
        return False
    for key, a, b, c in ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key == "class" or key == "id" and name not in HEADINGS:
            names = value.split()
            if any(x in (CERTAIN if mains else MARKS) for x in names):
                return True
            if not mains and key == "class" and name not in LINES and any(w in STRONG for x in names for w in (*WORD.findall(x)[:1], *WORD.findall(x)[-1:])):
                return True
        elif key == "role" and value.strip() in ROLES or key == "aria-hidden" and value == "true" or key == "hidden":
            return True
        elif key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def blocks(page: str) -> list[tuple[str, bool]]:
    """The text blocks of a page in order without those of marked parts, each with whether it stands in an article or main element."""
    return [(t, part == ARTICLE) for t, part in parts(page) if part != MARKED]


def parts(page: str) -> list[tuple[str, int]]:
    """The text blocks of a page in order, each with where it stands."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    skip = ""  # name of the marked element that is being read, with its depth
    depth = mains = 0
    inside = False

    def end() -> None:
        if held:
            if text := SPACE.sub(" ", entities.unescape("".join(held))).strip():
                out.append((text, MARKED if skip else ARTICLE if inside else REST))
            held.clear()

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        if m is None:  # cannot be: every character starts some token
            at += 1
            continue
        at = m.end()
        name = m[2]
        if name is None:
            if text := m[5] or m[6]:
                held.append(text)
            continue
        name, closing = name.lower(), bool(m[1])
        if skip == "p" and name in BLOCK:  # a paragraph also ends where the next block does anything
            end()
            skip = ""
        if skip:
            if name == skip:
                depth += -1 if closing else 0 if m[3].rstrip().endswith("/") else 1
                if depth == 0:
                    end()
                    skip = ""
            elif name in RAW and not closing:
                e = RAW_END[name].search(page, at)
                at = e.end() if e else n
            if name in BLOCK:
                end()
            elif name == "br":
                held.append(" ")
            continue
        if name in RAW and not closing:
            e = RAW_END[name].search(page, at)
            at = e.end() if e else n
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCK:
            end()
        if closing:
            if name in MAIN and mains:
                mains -= 1
                inside = mains > 0
            continue
        if name in VOID:
            continue
        if name in SKIP or name == "header" and not mains or name not in MAIN and _marked(name, m[3], mains):
            end()
            skip, depth = name, 1
        elif name in MAIN:
            mains += 1
            inside = True
    end()
    return out


def common_lines(a: list, b: list) -> list[bool]:
    """For each line of ``a``, whether a longest common subsequence with ``b`` has it (bit-parallel rows).

    Of n rows some 2 sqrt(n) are held at a time: every sqrt(n)th, and those of one stretch between, computed once more.
    """
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    shared = [i < lo or i >= len(a) - hi for i in range(len(a))]
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    where: dict = {}
    for j, line in enumerate(y):
        where[line] = where.get(line, 0) | 1 << j
    keep = [i for i, line in enumerate(x) if line in where]  # other lines are in no common subsequence
    full = (1 << len(y)) - 1
    step = isqrt(len(keep)) + 1

    def rows_from(v: int, start: int, stop: int) -> Iterator[int]:
        """Rows ``start`` to ``stop`` from row ``start``, v."""
        yield v
        for i in keep[start:stop]:
            u = v & where[x[i]]
            v = (v + u | v - u) & full
            yield v

    marks = [v for r, v in enumerate(rows_from(full, 0, len(keep))) if r % step == 0]
    # A zero at bit j of row r: the best length of the first r lines with y[: j + 1] is one more than with y[: j].
    j = len(y)
    length = lambda r, j: j - (rows[r - base] & ((1 << j) - 1)).bit_count()
    r, base, rows = len(keep), len(keep), []
    while r and j:
        if r <= base:  # rows r and r - 1 are wanted
            base = (r - 1) // step * step
            rows = list(rows_from(marks[base // step], base, r))
        if length(r, j) == length(r - 1, j):
            r -= 1
        elif length(r, j) == length(r, j - 1):
            j -= 1
        else:
            shared[lo + keep[r - 1]] = True
            r, j = r - 1, j - 1
    return shared


def template(lines: list, neighbours: list[list]) -> list[bool]:
    """For each line, whether it is shared with every one of the neighbouring pages; without neighbours, none is."""
    shared = [common_lines(lines, n) for n in neighbours]
    return [bool(s) and all(s) for s in zip(*shared)] if shared else [False] * len(lines)


def differenced(lines: list[str], neighbours: list[list[str]]) -> list[str]:
    """The lines that are not shared with every one of the neighbouring pages; without neighbours, all."""
    return [t for t, s in zip(lines, template(lines, neighbours)) if not s]


def aligned(page: tuple[list, bytes], sides: list[tuple[list, bytes]]) -> list[bool]:
    """For each line of a page (lines, where each stands), whether differencing deletes it.

    Articles, marked parts and the rest are aligned with the same of each neighbour, so that a menu in another place cannot
    hide a template line, nor a sentence of a neighbour's article delete one.  A neighbour with just the same lines outside of
    marked parts is a copy and tells nothing.
    """
    split = lambda p, part: [t for t, k in zip(*p) if k == part]
    texts = lambda p: (split(p, ARTICLE), split(p, REST))
    own = texts(page)
    if any(own):
        sides = [p for p in sides if texts(p) != own]
    found = [iter(template(split(page, part), [split(p, part) for p in sides])) for part in (REST, ARTICLE, MARKED)]
    return [next(found[k]) for k in page[1]]


def site(url: str | None) -> tuple[str, str]:
    """Host and path of a URL, in lower case and without scheme, query and fragment."""
    try:
        u = urlsplit((url or "").strip())
        return (u.netloc.rpartition("@")[2].lower(), u.path.rstrip("/").lower()) if u.netloc else ("", u.path.lower())
    except ValueError:
        return "", (url or "").lower()


PARSED = "row binary, page_id long, url string, host string, path string, lines array<string>, keys binary, parts binary"
SHARED = "row binary, n_shared long, n_restored long, kept array<boolean>"


def digests(keys: bytes) -> list[bytes]:
    return [keys[i : i + 8] for i in range(0, len(keys), 8)]


def numbered(parsed: DataFrame) -> DataFrame:
    """host, path, first, pages, i: the paths in order with their numbers, each with its first row and its number of rows.

    The paths are sorted in ranges, so a host may hold any share of them, and numbered throughout by the counts
    of the ranges before (as many numbers as there are partitions); no page text is moved.
    """
    spark = parsed.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    paths = parsed.groupBy("host", "path").agg(F.min_by("row", F.struct("page_id", "row")).alias("first"), F.count("*").alias("pages"))
    order = cut(paths.repartitionByRange(n, "host", "path").sortWithinPartitions("host", "path").withColumn("m", F.monotonically_increasing_id()), "html-order")
    order = order.select("host", "path", "first", "pages", F.shiftright("m", 33).cast("int").alias("part"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("i"))
    before, at = [], 0
    for part, count in sorted(tuple(r) for r in order.groupBy("part").count().collect()):
        before.append((part, at))
        at += count
    order = order.join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part")
    return order.select("host", "path", "first", "pages", (F.col("i") + F.col("before")).alias("i"))


def shared(parsed: DataFrame) -> DataFrame:
    """row, n_shared, n_restored, kept: for each row with template lines their number, how many of them stand in its article and
    stay, and for each of its text lines whether it stays (null: all do).

    Each path's first row is sent to the paths next to it, to each group of those with many pages; only 64-bit digests of
    lines are moved.
    """

    def difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sides, seen = None, {}, (None, None)
        for batch in batches:
            rows = []
            for i, group, side, host, row, keys, where in batch.itertuples(index=False):
                if (i, group) != at:
                    at, sides, seen = (i, group), {}, (None, None)
                if side < 2:
                    sides[side] = host, digests(keys), where
                    continue
                if seen[0] != (keys, where):  # copies come together as a rule
                    gone = aligned((digests(keys), where), [x[1:] for x in sides.values() if x[0] == host])
                    text = ARTICLE if ARTICLE in where else REST
                    kept = [not g for g, k in zip(gone, where) if k == REST] if text == REST else []
                    seen = (keys, where), (sum(gone), sum(g for g, k in zip(gone, where) if k == ARTICLE), None if all(kept) else kept)
                if seen[1][0]:
                    rows.append((row, *seen[1]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SHARED.split(", ")])

    order = numbered(parsed)
    rows = parsed.select("host", "path", "row", "keys", "parts").join(order.drop("pages"), ["host", "path"])
    to = lambda step, side: F.struct((F.col("i") + step).alias("i"), F.lit(side).alias("side"))
    rows = rows.withColumn("to", F.explode(F.when(F.col("row") == F.col("first"), F.array(to(1, 0), to(-1, 1), to(0, 2))).otherwise(F.array(to(0, 2)))))
    many = order.filter(F.col("pages") > PATH_PAGES).select("i", F.ceil(F.col("pages") / PATH_PAGES).alias("groups"))  # a row for PATH_PAGES pages at most
    rows = rows.select("to.i", "to.side", "host", "row", "keys", "parts").join(F.broadcast(many), "i", "left")
    groups = F.coalesce("groups", F.lit(1).cast("long"))
    rows = rows.withColumn("group", F.explode(F.when(F.col("side") == 2, F.array(F.pmod(F.xxhash64("row"), groups))).otherwise(F.sequence(F.lit(0).cast("long"), groups - 1))))
    rows = rows.select("i", "group", "side", "host", "row", "keys", "parts").repartition("i", "group")
    return rows.sortWithinPartitions("i", "group", "side", "keys", "parts").mapInPandas(difference, SHARED).dropDuplicates(["row"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared, n_restored, one row per input row.

    ``n_shared`` counts the lines of the whole page that differencing deletes, ``n_restored`` those of them that stand in its
    article and stay.  Null or empty html gives an empty text; a null url is a host of its own name ''; repeated rows each get
    a row.  Pages of equal host and path (copies, or variants by query) are no neighbours of each other; a page whose host has
    no other path, or only copies of it next to it, keeps its lines, as nothing then tells template from text.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, url, page in zip(batch["page_id"], batch["url"], batch["html"]):
                page_id, page = None if pd.isna(page_id) else int(page_id), page or ""
                found = parts(page)
                where = bytes(k for _, k in found)
                text = ARTICLE if ARTICLE in where else REST
                keys = b"".join(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest() for t, _ in found)
                row = hashlib.blake2b(f"{page_id}\0{url}\0{page}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                rows.append((row, page_id, url, *site(url), [t for t, k in found if k == text], keys, where))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])

    parsed = cut(pages.select("page_id", "url", "html").mapInPandas(parse, PARSED), "html-parsed")
    found = cut(shared(parsed), "html-shared")
    size = found.agg(F.sum(F.greatest(F.size("kept"), F.lit(0)) + 64)).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found.hint("merge")
    text = F.array_join(F.when(F.col("kept").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: F.get("kept", i))), "\n")
    out = parsed.select("row", "page_id", "url", "lines").join(found, "row", "left").withColumn("text", text)
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_shared", "n_restored")]
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), *counts)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spread(table(spark, sf_dir, "pages")))
