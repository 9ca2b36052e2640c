"""Benchmark decontamination, in DataFrame functions only.

A benchmark item is searched for in windows of its own length in words.  Windows are compared exactly: shingles weighted
by how often they occur, the sum of the smaller weights against the sum of the larger.  A window can only be similar
enough if it holds enough of the item's shingles, so windows are cut only where the shared shingles of document and item
stand densely enough; as a window moves, its share grows only where a shared shingle enters at its end, so the first best
window ends with one or starts the document.  All these windows are compared; the 64-bit SimHash of window and item is
reported (``hamming``) and decides nothing.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, spread, table

SHINGLE, NUM, DEN = 5, 75, 100
BITS, BLOCKS, RADIUS = 64, 4, 15
SMALL_SHINGLES = 2_000_000  # rows of at most about 40 bytes
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words between the six ASCII white-space characters, A-Z in lower case."""
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(t, r"[ \t-\r]+"), lambda w: w != "")


def hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def grams(h: Column, size: int = SHINGLE) -> Column:
    """Hash of each shingle from the array of word hashes; fewer words than ``size`` are one shingle, none are none."""
    n = F.size(h)
    each = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)])
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < size, F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), each))


def simhash(h: Column, lanes: int = 4) -> Column:
    """64-bit SimHash of an array of word hashes: bit b is set if more than half of the hashes have it.

    ``lanes`` counters share a long: with 4 of 16 bits, up to 65,535 words count exactly; with 2, any number.
    """
    width = 64 // lanes
    mask = sum(1 << (width * k) for k in range(lanes))
    half = F.size(h)
    out = F.lit(0).cast("bigint")
    for j in range(width):
        total = _lane_sum(h, j, mask)
        for k in range(lanes):
            count = F.shiftrightunsigned(total, width * k).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
            bit = j + width * k
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            out = out.bitwiseOR(F.when(count * 2 > half, F.lit(value).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return out


def _lane_sum(h: Column, j: int, mask: int) -> Column:
    return F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: a + F.shiftrightunsigned(x, j).bitwiseAND(F.lit(mask).cast("bigint")))


def near_masks(width: int = BITS // BLOCKS, most: int = RADIUS // BLOCKS) -> list[int]:
    """All ``width``-bit masks with at most ``most`` bits set: what an index of fingerprints lists an item under."""
    return [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(width), n)]


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, n_words, h (word hashes), g (shingle hashes); items without words are left out."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    h = w.select("item_id", F.size("w").alias("n_words"), hashes(F.col("w")).alias("h"))
    return cut(h.withColumn("g", grams(F.col("h"))), "bench-items")


def _multiset(a: Column, b: Column, da: Column, db: Column) -> Column:
    """Sum of the smaller weights: each shared shingle counts once, and repeated ones as often as both have them."""
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    more = F.aggregate(F.array_intersect(da, db), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)) - 1)
    return F.size(F.array_intersect(a, b)) + more


def _repeated(g: Column) -> Column:
    """The distinct values that an ascending array holds more than once."""
    return F.array_distinct(F.filter(g, lambda x, i: (i > 0) & (F.get(g, i - 1) == x)))


def contamination(docs: DataFrame, benchmark: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, item_id, start_word, n_words, shared, total, hamming: for each document and item with a window similar
    enough (den * shared >= num * total, the weights of intersection and union), the best such window, ties to the first.

    Null and empty texts on either side take no part; an item of fewer than five words is one shingle and is found
    where a window is just these words.  Rows with equal doc_id or item_id are reported as one document or item.
    A document shorter than an item is compared as a whole.
    """
    items = _items(benchmark)
    about = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("g")), F.lit(0)).alias("g"), F.coalesce(F.max("n_words"), F.lit(0)).alias("most")).first()
    docs = docs.select("doc_id", "text")
    if not about["n"]:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start_word int, n_words int, shared int, total int, hamming int")
    lanes = 4 if about["most"] < 1 << 16 else 2
    places = items.select("item_id", "n_words", F.explode("g").alias("gram")).distinct()
    places = F.broadcast(places) if about["g"] <= SMALL_SHINGLES else places
    short = sorted(r["n_words"] for r in items.filter(F.col("n_words") < SHINGLE).select("n_words").distinct().collect())  # at most four values

    h = docs.select("doc_id", hashes(words(F.col("text"))).alias("h"))
    hits = _hits(h, places, SHINGLE, F.col("n_words") >= SHINGLE)
    for n in short:
        hits = hits.union(_hits(h, places, n, F.col("n_words") == n))
    # Rows of one doc_id and length are told apart below, where each is compared: together they only have more windows.
    dense = hits.groupBy("doc_id", "n", "item_id", "n_words").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    dense = dense.withColumn("starts", _starts(num, den)).filter(F.size("starts") > 0)
    windows = cut(dense.groupBy("doc_id", "n").agg(F.collect_list(F.struct("item_id", "n_words", "starts")).alias("windows")), "bench-windows")
    # Texts are read again for the documents with windows; n tells rows of one doc_id apart by their length.
    again = docs.select("doc_id", "text").join(windows.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", hashes(words(F.col("text"))).alias("h")).withColumn("n", F.size("h"))
    cutout = again.join(windows, ["doc_id", "n"]).select("doc_id", "h", F.explode("windows").alias("w")).select("doc_id", "h", "w.item_id", "w.n_words", F.explode("w.starts").alias("start_word"))
    cutout = cutout.withColumn("h", F.slice("h", F.col("start_word") + 1, F.col("n_words")))
    cutout = cut(cutout.withColumn("g", F.array_sort(grams(F.col("h")))), "bench-cutouts")

    full = items.select("item_id", "n_words", F.array_sort("g").alias("ig"), simhash(F.col("h"), lanes).alias("item_sim"))
    pairs = cutout.join(full, ["item_id", "n_words"])
    pairs = pairs.withColumn("dg", _repeated(F.col("g"))).withColumn("di", _repeated(F.col("ig")))
    pairs = pairs.withColumn("shared", _multiset(F.col("g"), F.col("ig"), F.col("dg"), F.col("di")))
    pairs = pairs.withColumn("total", F.size("g") + F.size("ig") - F.col("shared")).filter(F.col("shared") * den >= F.col("total") * num)
    # The best window of each pair: one row for each group and task before anything is dealt out.
    order = F.struct((F.col("shared") / F.col("total")).alias("share"), (-F.col("start_word")).alias("at"), "n_words", "shared", "total", "item_sim", "h")
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(order).alias("m"))
    hamming = F.bit_count(simhash(F.col("m.h"), lanes).bitwiseXOR(F.col("m.item_sim"))).cast("int")
    return best.select("doc_id", "item_id", (-F.col("m.at")).cast("int").alias("start_word"), F.col("m.n_words").cast("int").alias("n_words"), F.col("m.shared").cast("int").alias("shared"), F.col("m.total").cast("int").alias("total"), hamming.alias("hamming"))


def _starts(num: int, den: int) -> Column:
    """From ps, the ascending places of shared shingles: the starts of the windows that end with one and hold enough of them."""
    full = F.greatest(F.col("n_words") - (SHINGLE - 1), F.lit(1))  # shingles of the item
    own = F.least(full, F.greatest(F.col("n") - (SHINGLE - 1), F.lit(1)))  # and of a window
    need = F.ceil((own + full) * num / F.lit(num + den)).cast("int")
    ends = F.filter("ps", lambda p, i: (i + 1 >= need) & (F.get("ps", i + 1 - need) > p - full))
    return F.array_distinct(F.transform(ends, lambda p: F.greatest(F.lit(0), p - full + 1)))


def _hits(h: DataFrame, places: DataFrame, size: int, which: Column) -> DataFrame:
    """doc_id, n, item_id, n_words, p: the places in each document of the shingles of each item."""
    if size == SHINGLE:
        g = F.when(F.size("h") >= size, grams(F.col("h"), size))
    else:
        # An item of fewer words than a shingle is one shingle of all its words.
        one = lambda i: F.xxhash64(F.array_join(F.transform(F.slice("h", i + 1, F.lit(size)), lambda x: x.cast("string")), " "))
        g = F.when(F.size("h") >= size, F.transform(F.sequence(F.lit(0), F.greatest(F.size("h") - size, F.lit(0))), one))
    at = h.select("doc_id", F.size("h").alias("n"), F.posexplode(g).alias("p", "gram"))
    return at.join(places.filter(which), "gram").select("doc_id", "n", "item_id", "n_words", "p")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id has no contamination; rows with a null doc_id are never found and stay."""
    found = cut(contamination(docs, benchmark).select("doc_id").distinct(), "bench-found")
    found = F.broadcast(found) if found.count() <= SMALL_SHINGLES else found
    return docs.join(found, "doc_id", "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")).drop("hamming")


def _words_sql(table_: str, key: str) -> str:
    return f"SELECT {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table_}"


# Every window of an item's length in every document that shares a shingle (or all words of a shorter item) with it.
OP4_SQL = f"""
WITH d AS ({_words_sql('documents', 'doc_id')}), i AS (SELECT item_id, w, len(w) AS n, greatest(len(w) - {SHINGLE - 1}, 1) AS whole FROM ({_words_sql('benchmark', 'item_id')}) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT least(n, {SHINGLE}) AS size FROM i),
dg AS (SELECT doc_id, size, p, array_to_string(list_slice(w, p + 1, p + size), ' ') AS g FROM (SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS p FROM d, sizes)),
ig AS (SELECT item_id, least(n, {SHINGLE}) AS size, array_to_string(list_slice(w, p, p + {SHINGLE - 1}), ' ') AS g, count(*) AS c FROM (SELECT item_id, w, n, unnest(range(1, whole + 1)) AS p FROM i) GROUP BY ALL),
h AS (SELECT dg.doc_id, dg.p, ig.item_id, dg.g, ig.c FROM dg JOIN ig USING (size, g)),
q AS (SELECT DISTINCT h.doc_id, h.item_id, i.n, i.whole, len(d.w) AS m FROM h JOIN i USING (item_id) JOIN d USING (doc_id)),
v AS (SELECT *, unnest(range(0, greatest(m - n, 0) + 1)) AS s FROM q),
x AS (SELECT v.doc_id, v.item_id, v.n, v.whole, v.m, v.s, h.g, least(count(*), any_value(h.c)) AS c FROM v JOIN h ON h.doc_id = v.doc_id AND h.item_id = v.item_id AND h.p >= v.s AND h.p < v.s + v.whole GROUP BY v.doc_id, v.item_id, v.n, v.whole, v.m, v.s, h.g),
y AS (SELECT doc_id, item_id, n, s, sum(c) AS shared, whole + greatest(least(n, m) - {SHINGLE - 1}, 1) - sum(c) AS total FROM x GROUP BY doc_id, item_id, n, s, whole, m)
SELECT doc_id, item_id, CAST(s AS INTEGER) AS start_word, CAST(n AS INTEGER) AS n_words, CAST(shared AS INTEGER) AS shared, CAST(total AS INTEGER) AS total FROM y
WHERE {DEN} * shared >= {NUM} * total QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / total DESC, s) = 1
"""
