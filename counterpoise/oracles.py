"""DuckDB SQL for the registered queries, written from their definitions rather than from the Spark plans."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}


def u(seed: int, tag: str, *parts: str) -> str:
    text = ", ".join([f"'{seed}'", f"'{tag}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"(('0x' || substr(md5(concat_ws('|', {text})), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE)"


def r(x: str, to: str, places: int = 9) -> str:
    return f"round({x}, {places}) + 0.0 AS {to}"


def fsum(f: str) -> str:
    return f"list_reduce(list_prepend(0.0::DOUBLE, {f}), lambda s, x: s + x)"


def points(f: str = "f") -> str:
    return f"{r(fsum(f), 'f_sum')}, {r(f + '[1]', 'f_first')}"


def between(a: str, b: str, lam: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda t: t[1] + {lam} * (t[2] - t[1]))"


def clip01(x: str) -> str:
    return f"greatest(1e-6::DOUBLE, least(1.0::DOUBLE - 1e-6::DOUBLE, {x}))"


def emb(positive: int = 5) -> str:
    return f"""emb AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS f, CASE WHEN label = {positive} THEN 1 ELSE 0 END AS y FROM embeddings),
mi AS (SELECT row_id, f, row_number() OVER (ORDER BY row_id) - 1 AS i FROM emb WHERE y = 1),
ma AS (SELECT row_id, f FROM emb WHERE y = 0),
cnt AS (SELECT count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1,
  greatest(0, greatest(count(*) FILTER (WHERE y = 1), count(*) FILTER (WHERE y = 0)) - count(*) FILTER (WHERE y = 1)) AS need FROM emb)"""


def near(name: str, q: str, base: str, skip: bool, k: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT a.row_id AS q, b.row_id AS j, list_distance(a.f, b.f) AS d,
  row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.f, b.f), b.row_id) AS rk
  FROM {q} a JOIN {base} b ON {'a.row_id <> b.row_id' if skip else 'true'}) WHERE rk <= {k})"""


def draws(tag: str, k: str, base: str = "mi", n: str = "(SELECT n1 FROM cnt)", lo: float = 0.0, hi: float = 1.0, pool: str = "mi", nn: str = "nn") -> str:
    """syn: draw, base_id, partner_id, lam, f"""
    return f"""dr AS (SELECT range AS draw, CAST(floor({u(42, tag + '-a', 'range')} * {n}) AS BIGINT) AS i,
  CAST(floor({u(42, tag + '-k', 'range')} * {k}) AS BIGINT) + 1 AS rk, {lo}::DOUBLE + ({hi}::DOUBLE - {lo}::DOUBLE) * {u(42, tag + '-l', 'range')} AS lam
  FROM range((SELECT need FROM cnt))),
syn AS (SELECT draw, b.row_id AS base_id, p.row_id AS partner_id, lam, {between('b.f', 'p.f', 'lam')} AS f
  FROM dr JOIN {base} b ON b.i = dr.i JOIN {nn} n ON n.q = b.row_id AND n.rk = dr.rk JOIN {pool} p ON p.row_id = n.j)"""


K5 = "greatest(1, least(5, (SELECT n1 FROM cnt) - 1))"
KS = "(least((SELECT n1 FROM cnt), 6) - 1)"
KL = "(least((SELECT n1 FROM cnt), 7) - 1)"
BOX = """bx AS (SELECT pos, lo - 0.01::DOUBLE * greatest(hi - lo, 1e-9::DOUBLE) AS lo, hi + 0.01::DOUBLE * greatest(hi - lo, 1e-9::DOUBLE) AS hi FROM (
  SELECT pos, min(v) AS lo, max(v) AS hi FROM (SELECT unnest(f) AS v, generate_subscripts(f, 1) - 1 AS pos FROM emb) WHERE isfinite(v) GROUP BY pos)),
box AS (SELECT list(lo ORDER BY pos) AS lo, list(hi ORDER BY pos) AS hi FROM bx)"""
CLIP = "list_transform(list_zip({f}, lo, hi), lambda t: least(greatest(t[1], t[2]), t[3]))"
EVENTS = """ev AS (SELECT event_id AS row_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value, CAST(hour(ts) AS DOUBLE) AS hour,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events)"""


def fold(src: str, key: str = "row_id", k: int = 5) -> str:
    return f"""fo AS (SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws('|', '42', 'fold', CAST({key} AS VARCHAR))), {key}) - 1
  + CASE WHEN y = 1 THEN (SELECT count(*) FROM {src} WHERE y = 0) % {k} ELSE 0 END) % {k} + 1 AS INTEGER) AS fold FROM {src})"""


_counts = "SELECT '{n}' AS frame, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1, round(avg(y), 9) + 0.0 AS prior, greatest(count(*) FILTER (WHERE y = 1), count(*) FILTER (WHERE y = 0)) AS target, greatest(count(*) FILTER (WHERE y = 1), count(*) FILTER (WHERE y = 0)) - count(*) FILTER (WHERE y = 1) AS need FROM ({q})"
ORACLE_SQL["class_counts_need"] = " UNION ALL ".join(
    _counts.format(n=n, q=q)
    for n, q in (
        ("emb", "SELECT CASE WHEN label = 5 THEN 1 ELSE 0 END AS y FROM embeddings"), ("docs", "SELECT toxic AS y FROM documents JOIN labels USING (doc_id)"),
        ("events", "SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events"), ("line", "SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 ELSE 0 END AS y FROM lineitem"),
    )
)
ORACLE_SQL["encode_frame"] = f"""WITH {EVENTS} SELECT row_id, {r("CASE WHEN isfinite(value) THEN value END", "value")}, {r("hour", "hour")}, {r("k", "k")},
  CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS event_type FROM ev"""
ORACLE_SQL["binary_labels_two"] = "SELECT CAST(toxic AS VARCHAR) AS label, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic ORDER BY n, toxic LIMIT 1"
ORACLE_SQL["binary_labels_multi"] = "SELECT CAST(label AS VARCHAR) AS label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label ORDER BY count(*) < 10, n, label LIMIT 1"
ORACLE_SQL["bounds_per_dim"] = f"WITH {emb()}, {BOX} SELECT CAST(pos AS INTEGER) AS pos, {r('lo', 'lo')}, {r('hi', 'hi')} FROM bx"
_wide = "list_transform(f, lambda x: x * 1.5)"
ORACLE_SQL["clip_to_bounds"] = f"""WITH {emb()}, {BOX}, w AS (SELECT row_id, {_wide} AS w FROM emb)
SELECT row_id, {r(fsum(CLIP.format(f='w')), 'f_sum')}, len(list_filter(list_zip(w, lo, hi), lambda t: t[1] < t[2] OR t[1] > t[3])) = 0 AS inside FROM w, box"""
ORACLE_SQL["stratified_folds"] = f"WITH {emb()}, {fold('emb')} SELECT row_id, y, fold FROM fo"
ORACLE_SQL["fold_balance"] = f"""WITH li AS (SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d'))) AS row_id,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 ELSE 0 END AS y FROM lineitem), {fold('li')}
SELECT fold, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1 FROM fo GROUP BY fold"""
ORACLE_SQL["fold_standardize"] = f"""WITH {EVENTS}, {fold('ev')}, lg AS (SELECT row_id, fold, 'value' AS "column", value AS v FROM fo UNION ALL SELECT row_id, fold, 'hour', hour FROM fo UNION ALL SELECT row_id, fold, 'k', k FROM fo),
md AS (SELECT t.test, "column", median(v) AS m FROM lg JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS test) t ON t.test <> lg.fold GROUP BY ALL),
st AS (SELECT md.test, lg."column", any_value(m) AS m, avg(coalesce(v, m)) AS mu, stddev_pop(coalesce(v, m)) AS sd FROM lg JOIN md ON md.test <> lg.fold AND md."column" = lg."column" GROUP BY ALL),
z AS (SELECT lg.fold, lg."column", (coalesce(v, m) - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS value FROM lg JOIN st ON st.test = lg.fold AND st."column" = lg."column")
SELECT fold, "column", count(*) AS n, {r('avg(value)', 'mean', 6)}, {r('max(value)', 'top', 6)}, {r('min(value)', 'low', 6)} FROM z GROUP BY ALL"""

ORACLE_SQL["knn_minority"] = f"WITH {emb()}, {near('nn', 'mi', 'mi', True, '5')} SELECT q, j, rk, {r('d', 'd')} FROM nn"
ORACLE_SQL["knn_majority"] = f"WITH {emb()}, {near('nn', 'mi', 'ma', False, '6')} SELECT q, j, rk, {r('d', 'd')} FROM nn"
ORACLE_SQL["nn_distance_ratio"] = f"""WITH {emb()}, {near('a', 'ma', 'mi', False, '1')}, {near('b', 'ma', 'ma', True, '1')}
SELECT q, {r('a.d', 'd_min')}, {r('b.d', 'd_maj')}, {r('b.d / (a.d + 1e-12::DOUBLE)', 'ratio', 6)} FROM a JOIN b USING (q)"""
ORACLE_SQL["local_scale"] = f"WITH {emb()}, {near('nn', 'mi', 'mi', False, '6')} SELECT q, {r('avg(d)', 'scale')} FROM nn GROUP BY q"
_centroid = f"""{near('nn', 'mi', 'ma', False, '6')},
wx AS (SELECT q, 1.0::DOUBLE / (d + 1e-12::DOUBLE) AS w, unnest(ma.f) AS x, generate_subscripts(ma.f, 1) - 1 AS pos FROM nn JOIN ma ON ma.row_id = nn.j),
ce AS (SELECT q, pos, sum(w * x) / sum(w) AS x FROM wx GROUP BY q, pos)"""
ORACLE_SQL["weighted_majority_centroid"] = f"WITH {emb()}, {_centroid} SELECT q, CAST(pos AS INTEGER) AS pos, {r('x', 'x')} FROM ce"
ORACLE_SQL["outward_direction"] = f"""WITH {emb()}, {_centroid}, tg AS (SELECT q, list(x ORDER BY pos) AS t FROM ce GROUP BY q),
v AS (SELECT q, list_transform(list_zip(mi.f, t), lambda z: z[1] - z[2]) AS v FROM tg JOIN mi ON mi.row_id = q),
w AS (SELECT q, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM v)
SELECT q AS draw, {r(fsum('v'), 'f_sum')}, {r('v[1]', 'f_first')}, {r('sqrt(list_inner_product(v, v))', 'length')} FROM w"""

ORACLE_SQL["ros"] = f"WITH {emb()} SELECT range AS draw, row_id AS base_id, {points()} FROM range((SELECT need FROM cnt)) JOIN mi ON mi.i = CAST(floor({u(42, 'ros', 'range')} * (SELECT n1 FROM cnt)) AS BIGINT)"
ORACLE_SQL["smote"] = f"WITH {emb()}, {near('nn', 'mi', 'mi', True, K5)}, {draws('smote', K5)} SELECT draw, base_id, partner_id, {points()} FROM syn"
ORACLE_SQL["simple_smote"] = f"WITH {emb()}, {near('nn', 'mi', 'mi', True, KS)}, {draws('simple', KS, lo=0.05, hi=0.95)} SELECT draw, base_id, partner_id, {points()} FROM syn"
ORACLE_SQL["smote_tomek"] = f"""WITH {emb()}, {near('nn', 'mi', 'mi', True, K5)}, {draws('smote', K5)},
al AS (SELECT row_id, f, y FROM emb UNION ALL SELECT -draw - 1, f, 1 FROM syn), {near('n1', 'al', 'al', True, '1')},
tl AS (SELECT a.q, a.j FROM n1 a JOIN n1 b ON a.j = b.q AND b.j = a.q JOIN al x ON x.row_id = a.q JOIN al z ON z.row_id = a.j WHERE x.y <> z.y)
SELECT row_id, y, {points()} FROM al WHERE row_id NOT IN (SELECT q FROM tl)"""
_danger = f"""{near('nm', 'mi', 'emb', True, '10')}, da AS (SELECT q AS row_id, count(*) FILTER (WHERE y = 0) AS n_maj FROM nm JOIN emb ON emb.row_id = nm.j GROUP BY q HAVING count(*) FILTER (WHERE y = 0) * 2 >= 10 AND count(*) FILTER (WHERE y = 0) < 10)"""
ORACLE_SQL["borderline_danger"] = f"WITH {emb(3)}, {_danger} SELECT row_id, n_maj FROM da"
ORACLE_SQL["borderline_smote"] = f"""WITH {emb(3)}, {_danger}, sd AS (SELECT mi.row_id, f, row_number() OVER (ORDER BY mi.row_id) - 1 AS i FROM mi JOIN da USING (row_id)),
{near('nn', 'sd', 'mi', True, K5)}, {draws('border', K5, base='sd', n='(SELECT count(*) FROM sd)')} SELECT draw, base_id, partner_id, {points()} FROM syn"""
ORACLE_SQL["adasyn"] = f"""WITH {emb()}, {near('na', 'mi', 'emb', True, K5)}, ra AS (SELECT q, count(*) FILTER (WHERE y = 0) / {K5}::DOUBLE AS r FROM na JOIN emb ON emb.row_id = na.j GROUP BY q),
ga AS (SELECT q, CAST(round_even(r / (SELECT sum(r) FROM ra) * (SELECT need FROM cnt), 0) AS INTEGER) AS g FROM ra),
dr AS (SELECT q, unnest(range(1, g + 1)) AS t FROM ga WHERE g > 0), {near('nn', 'mi', 'mi', True, K5)},
dk AS (SELECT q, t, CAST(floor({u(42, 'adasyn-k', 'q', 't')} * {K5}) AS BIGINT) + 1 AS rk, {u(42, 'adasyn-l', 'q', 't')} AS lam FROM dr)
SELECT row_number() OVER (ORDER BY dk.q, t) - 1 AS draw, dk.q AS base_id, nn.j AS partner_id, {points(between('b.f', 'p.f', 'lam'))}
FROM dk JOIN nn ON nn.q = dk.q AND nn.rk = dk.rk JOIN mi b ON b.row_id = dk.q JOIN mi p ON p.row_id = nn.j"""
ORACLE_SQL["mgvae"] = f"""WITH {emb()}, {near('nn', 'mi', 'mi', True, KS)}, {draws('guided', KS, lo=0.05, hi=0.95)}, {BOX},
sq AS (SELECT draw AS row_id, f FROM syn), {near('nj', 'sq', 'ma', False, '1')},
cc AS (SELECT list(x ORDER BY pos) AS c FROM (SELECT pos, avg(x) AS x FROM (SELECT unnest(f) AS x, generate_subscripts(f, 1) AS pos FROM mi) GROUP BY pos)),
sc AS (SELECT median(list_distance(f, c)) AS s FROM mi, cc),
dv AS (SELECT draw, base_id, partner_id, syn.f, list_transform(list_zip(syn.f, ma.f), lambda t: t[1] - t[2]) AS v FROM syn JOIN nj ON nj.q = draw JOIN ma ON ma.row_id = nj.j),
mv AS (SELECT draw, base_id, partner_id, list_transform(list_zip(f, v), lambda t: t[1] + 0.15::DOUBLE * s * (t[2] / sqrt(list_inner_product(v, v)))) AS f FROM dv, sc)
SELECT draw, base_id, partner_id, {points(CLIP.format(f='f'))} FROM mv, box"""

_ladder = f"""{near('nn', 'mi', 'mi', True, KL)}, {draws('ladder', KL, lo=0.05, hi=0.95)}, {BOX},
nb AS (SELECT CAST(round_even(0.40 * need, 0) AS BIGINT) AS n_base, need, need - CAST(round_even(0.40 * need, 0) AS BIGINT) AS n_ladder FROM cnt),
an0 AS (SELECT draw AS row_id, f FROM syn WHERE draw < (SELECT n_base FROM nb)), {near('am', 'an0', 'mi', False, '6')}, {near('aj', 'an0', 'ma', False, '6')},
an1 AS (SELECT row_id, f, (SELECT min(d) FROM am WHERE q = row_id) AS d_min, (SELECT avg(d) FROM am WHERE q = row_id) AS scale, (SELECT min(d) FROM aj WHERE q = row_id) AS d_maj FROM an0),
an AS (SELECT *, d_maj / (d_min + 1e-12::DOUBLE) AS ratio FROM an1 WHERE d_maj > d_min AND d_maj / (d_min + 1e-12::DOUBLE) <= 5.0),
ar AS (SELECT *, row_number() OVER (ORDER BY abs(ratio - 1.35::DOUBLE), scale DESC, row_id) AS anchor_rank FROM an),
aw AS (SELECT q, 1.0::DOUBLE / (d + 1e-12::DOUBLE) AS w, rk, unnest(ma.f) AS x, generate_subscripts(ma.f, 1) AS pos FROM aj JOIN ma ON ma.row_id = aj.j WHERE q IN (SELECT row_id FROM ar)),
tg AS (SELECT q, list(x ORDER BY pos) AS t FROM (SELECT q, pos, sum(w * x ORDER BY rk) / sum(w ORDER BY rk) AS x FROM aw GROUP BY q, pos) GROUP BY q),
ad AS (SELECT ar.*, list_transform(list_zip(t, f), lambda z: z[1] - z[2]) AS v FROM ar JOIN tg ON tg.q = ar.row_id),
ru AS (SELECT anchor_rank, scale, step, frac, list_transform(list_zip(f, v), lambda z: z[1] + frac * (1.05::DOUBLE * scale) * (-(z[2] / sqrt(list_inner_product(v, v))))) AS f
  FROM ad, (SELECT * FROM (VALUES (0, 0.12::DOUBLE), (1, 0.24::DOUBLE), (2, 0.38::DOUBLE), (3, 0.54::DOUBLE)) s(step, frac))),
rb AS (SELECT *, anchor_rank * 4 + step AS row_id FROM ru, box WHERE len(list_filter(list_zip(f, lo, hi), lambda t: t[1] < t[2] OR t[1] > t[3])) = 0),
{near('rm', 'rb', 'mi', False, '1')}, {near('rj', 'rb', 'ma', False, '1')},
rc AS (SELECT rb.*, rm.d AS d_min, rj.d AS d_maj, rj.d / (rm.d + 1e-12::DOUBLE) AS ratio FROM rb JOIN rm ON rm.q = rb.row_id JOIN rj ON rj.q = rb.row_id),
rk AS (SELECT * FROM rc WHERE (d_maj > d_min OR d_maj >= 0.95::DOUBLE * d_min) AND ratio BETWEEN 0.75 AND 5.0 AND d_min <= 2.40::DOUBLE * scale AND least(d_min, d_maj) > greatest(1e-8::DOUBLE, 1e-6::DOUBLE * scale)),
ca AS (SELECT *, row_number() OVER (ORDER BY anchor_rank, step) AS pos FROM rk QUALIFY row_number() OVER (PARTITION BY list_transform(f, lambda x: round_even(x, 10) + 0.0) ORDER BY anchor_rank, step) = 1)"""
ORACLE_SQL["ladder_anchors"] = f"WITH {emb()}, {_ladder} SELECT row_id AS draw, anchor_rank, {r('d_min', 'd_min')}, {r('d_maj', 'd_maj')}, {r('ratio', 'ratio', 6)}, {r('scale', 'scale')} FROM ar"
_cand = f"SELECT row_number() OVER (ORDER BY anchor_rank, step) AS pos, anchor_rank, step, {r('d_min', 'd_min')}, {r('d_maj', 'd_maj')}, {r(fsum('f'), 'f_sum')} FROM ca"
_most = "least({m}, greatest(6 * (SELECT n_ladder FROM nb), (SELECT n_ladder FROM nb)))"
_ranked = "cb AS (SELECT * EXCLUDE (pos), row_number() OVER (ORDER BY anchor_rank, step) AS pos FROM ca)"
for _name, _m in (("ladder_candidates", 8000), ("ladder_candidates_capped", 50)):
    ORACLE_SQL[_name] = f"WITH {emb()}, {_ladder} SELECT * FROM ({_cand}) WHERE pos <= {_most.format(m=_m)}"
_parts = (("0.30", "exp(-abs(ratio - 1.35::DOUBLE))"), ("0.28", "1.0::DOUBLE / (d_min + 1e-12::DOUBLE)"), ("0.45", "coverage"), ("0.15", "greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - abs(frac - 0.40::DOUBLE) / 0.40::DOUBLE))"), ("-0.42", "1.0::DOUBLE / (d_maj + 1e-12::DOUBLE)"), ("-0.06", "1.0::DOUBLE / (coverage + 1e-12::DOUBLE)"))
_score = " + ".join(f"{w}::DOUBLE * CASE WHEN max({x}) OVER () - min({x}) OVER () < 1e-12 THEN 0 ELSE (({x}) - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) END" for w, x in _parts)
_scored = f"""{_ranked}, cv AS (SELECT pos, min(list_distance(cb.f, an0.f)) AS coverage FROM cb, an0 WHERE pos <= {_most.format(m=8000)} GROUP BY pos),
cs AS (SELECT pos, f, coverage, {_score} + 1e-9::DOUBLE * {u(42, 'ladder-tie', 'pos')} AS score FROM cb JOIN cv USING (pos))"""
ORACLE_SQL["ladder_scores"] = f"WITH {emb()}, {_ladder}, {_scored} SELECT pos, {r('coverage', 'coverage')}, {r('score', 'score', 6)} FROM cs"
_unique = """un AS (SELECT *, list_transform(f, lambda x: round_even(x, 10) + 0.0) AS k FROM pa),
uq AS (SELECT part, "at", f FROM un WHERE k NOT IN (SELECT list_transform(f, lambda x: round_even(x, 10) + 0.0) FROM emb) QUALIFY row_number() OVER (PARTITION BY k ORDER BY part, "at") = 1)"""
_final = f'SELECT row_number() OVER (ORDER BY part, "at") - 1 AS draw, part, {points()} FROM (SELECT * FROM uq ORDER BY part, "at" LIMIT (SELECT need FROM cnt))'
ORACLE_SQL["outward_ladder"] = f"""WITH {emb()}, {_ladder}, {_scored},
be AS (SELECT *, row_number() OVER (ORDER BY score DESC, pos) AS "at" FROM cs QUALIFY "at" <= (SELECT n_ladder FROM nb)),
pa AS (SELECT 0 AS part, draw AS "at", f FROM syn WHERE draw < (SELECT need FROM cnt) - (SELECT count(*) FROM be) UNION ALL SELECT 1, "at", f FROM be), {_unique} {_final}"""
_docs = emb().replace(emb().split("\nmi AS")[0], """emb AS (SELECT doc_id AS row_id, [n_chars::DOUBLE, len(regexp_split_to_array(trim(text), ' +'))::DOUBLE,
  CASE lang WHEN 'de' THEN 0.0 WHEN 'en' THEN 1.0 WHEN 'es' THEN 2.0 ELSE 3.0 END::DOUBLE] AS f, toxic AS y FROM documents JOIN labels USING (doc_id)),""")
ORACLE_SQL["outward_ladder_backfill"] = ORACLE_SQL["outward_ladder"].replace(emb(), _docs).replace(_final, f"SELECT part, count(*) AS n, CAST(min(len(f)) AS INTEGER) AS dims FROM ({_final.replace('SELECT row_number', 'SELECT f, row_number')}) GROUP BY part")
ORACLE_SQL["dedup_vs_real"] = f"""WITH {emb()}, pa AS (SELECT 0 AS part, range AS "at", CASE WHEN range % 3 = 0 THEN f ELSE list_transform(f, lambda x: x + 0.5) END AS f
  FROM range((SELECT need FROM cnt)) JOIN mi ON mi.i = CAST(floor({u(42, 'ros', 'range')} * (SELECT n1 FROM cnt)) AS BIGINT)), {_unique} {_final}"""

# --- scores ---
_level = lambda w, tag: f"floor(100 * ({w}::DOUBLE * y + (0.95::DOUBLE - {w}::DOUBLE) * {u(42, tag, 'row_id')})) / 100 + 0.01::DOUBLE"
SC = f"""e0 AS (SELECT vec_id AS row_id, CAST(vec_id % 4 AS INTEGER) AS split, CASE WHEN vec_id % 4 = 3 THEN 0 WHEN label = 5 THEN 1 ELSE 0 END AS y FROM embeddings),
sc AS (SELECT *, {_level('0.25', 'orig')} AS s, {_level('0.35', 'shadow')} AS s1 FROM e0)"""


def corr(p: str) -> str:
    p = clip01(p)
    odds = f"({p} / (1.0::DOUBLE - {p}) * (0.1::DOUBLE / 0.9::DOUBLE) / (0.5::DOUBLE / 0.5::DOUBLE))"
    return clip01(f"{odds} / (1.0::DOUBLE + {odds})")


def logit(p: str) -> str:
    return f"ln({clip01(p)} / (1.0::DOUBLE - {clip01(p)}))"


def rank01(s: str, shift: float = 1.0) -> str:
    return f"""CASE WHEN count(*) OVER (PARTITION BY split) <= 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY split ORDER BY {s}) - 1 + count(*) OVER (PARTITION BY split, {s}) / 2.0::DOUBLE - {shift}) / (count(*) OVER (PARTITION BY split) - 1) END"""


ORACLE_SQL["prior_correct"] = f"WITH {SC} SELECT row_id, {r(corr('s1'), 'p')} FROM sc"
ORACLE_SQL["blend_prob"] = f"WITH {SC} SELECT row_id, split, {r(clip01('0.7::DOUBLE * s + 0.3::DOUBLE * s1'), 's')} FROM sc"
ORACLE_SQL["blend_logit"] = f"WITH {SC} SELECT row_id, split, {r(clip01('1.0::DOUBLE / (1.0::DOUBLE + exp(-(0.7::DOUBLE * ' + logit('s') + ' + 0.3::DOUBLE * ' + logit(corr('s1')) + ')))'), 's')} FROM sc"
ORACLE_SQL["blend_rank"] = f"WITH {SC} SELECT row_id, split, {r(clip01('0.7::DOUBLE * (' + rank01('s') + ') + 0.3::DOUBLE * (' + rank01('s1') + ')'), 's')} FROM sc"
ORACLE_SQL["rank01"] = f"WITH {SC} SELECT row_id, {r(rank01('s'), 'r')}, {r(rank01('s', 0.5), 'r_exact')} FROM sc"
ORACLE_SQL["normalize01"] = f"WITH {SC} SELECT row_id, {r('CASE WHEN max(s) OVER w - min(s) OVER w < 1e-12 THEN 0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END', 'v')} FROM sc WINDOW w AS (PARTITION BY split)"


def ap(src: str, by: str) -> str:
    return f"""ag AS (SELECT {by}, s, sum(y) AS tp, count(*) AS n FROM {src} GROUP BY {by}, s),
ac AS (SELECT {by}, tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY {by}) AS p, sum(n) OVER (PARTITION BY {by}) AS al FROM ag
  WINDOW w AS (PARTITION BY {by} ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ap AS (SELECT {by}, sum(CASE WHEN p > 0 AND p < al THEN tp / p::DOUBLE * (ctp / cn::DOUBLE) END) AS ap FROM ac GROUP BY {by})"""


AUC = """rr AS (SELECT split, y, rank() OVER (PARTITION BY split ORDER BY s) + (count(*) OVER (PARTITION BY split, s) - 1) / 2.0::DOUBLE AS ar FROM sc),
ra AS (SELECT split, sum(CASE WHEN y = 1 THEN ar END) AS sr, sum(y)::DOUBLE AS p, count(*) - sum(y)::DOUBLE AS q FROM rr GROUP BY split),
auc AS (SELECT split, CASE WHEN p > 0 AND q > 0 THEN (sr - p * (p + 1) / 2) / (p * q) END AS auc FROM ra)"""
CM = """cf AS (SELECT split, count(*) FILTER (WHERE y = 1 AND s >= 0.5)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND s >= 0.5)::DOUBLE AS fp, count(*) FILTER (WHERE y = 1 AND s < 0.5)::DOUBLE AS fn, count(*) FILTER (WHERE y = 0 AND s < 0.5)::DOUBLE AS tn FROM sc GROUP BY split),
cm AS (SELECT split, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE tn / (tn + fp) END AS balanced_accuracy,
  CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS mcc, (tp + tn) / (tp + tn + fp + fn) AS accuracy FROM cf)"""
_six = ", ".join(r(c, c) for c in ("f1", "recall", "precision", "balanced_accuracy", "mcc", "accuracy"))


def cal(src: str, by: str) -> str:
    p = clip01("s")
    return f"cal AS (SELECT {by}, avg(({p} - y) * ({p} - y)) AS brier, avg({p}) AS predicted_prior, avg(y) AS true_prior, abs(avg({p}) - avg(y)) AS prior_drift FROM {src} GROUP BY {by})"


def patk(src: str, by: str) -> str:
    return f"""pk0 AS (SELECT {by}, y, row_number() OVER (PARTITION BY {by} ORDER BY s DESC, row_id) AS rn, greatest(1, sum(y) OVER (PARTITION BY {by})) AS k FROM {src}),
pk AS (SELECT {by}, avg(CASE WHEN rn <= k THEN y::DOUBLE END) AS p_at_k FROM pk0 GROUP BY {by})"""


ORACLE_SQL["average_precision"] = f"WITH {SC}, {ap('sc', 'split')} SELECT split, {r('ap', 'ap')} FROM ap"
ORACLE_SQL["roc_auc"] = f"WITH {SC}, {AUC} SELECT split, {r('auc', 'auc')} FROM auc"
ORACLE_SQL["confusion_metrics"] = f"WITH {SC}, {CM} SELECT split, {_six} FROM cm"
ORACLE_SQL["brier"] = f"WITH {SC}, {cal('sc', 'split')} SELECT split, {', '.join(r(c, c) for c in ('brier', 'predicted_prior', 'true_prior', 'prior_drift'))} FROM cal"
ORACLE_SQL["precision_at_k"] = f"WITH {SC}, {patk('sc', 'split')} SELECT split, {r('p_at_k', 'p_at_k')} FROM pk"
ORACLE_SQL["metrics_all"] = f"WITH {SC}, {ap('sc', 'split')}, {AUC}, {CM} SELECT split, {r('ap', 'pr_auc')}, {r('auc', 'roc_auc')}, {_six} FROM ap JOIN auc USING (split) JOIN cm USING (split)"

# Ten steps of alpha (0, 0.25, 0.333333, 0.5, 0.75, 1 for each of two modes).
GRID = f"""{SC}, gr AS (SELECT CAST(row_number() OVER (ORDER BY m, a) - 1 AS INTEGER) AS cand_idx, CASE m WHEN 0 THEN 'prob' ELSE 'priorcorr' END AS mode, a AS alpha
  FROM (SELECT unnest([0, 1]) AS m), (SELECT unnest([0.0, 0.25, 0.333333, 0.5, 0.75, 1.0]::DOUBLE[]) AS a)),
bs AS (SELECT split, cand_idx, row_id, y, round({clip01("(1.0::DOUBLE - alpha) * s + alpha * CASE WHEN mode = 'prob' THEN s1 ELSE " + corr('s1') + " END")}, 9) AS s FROM sc, gr),
{ap('bs', 'split, cand_idx')}, {cal('bs', 'split, cand_idx')}, {patk('bs', 'split, cand_idx')},
gs AS (SELECT split, cand_idx, ap, brier, prior_drift, p_at_k FROM ap JOIN cal USING (split, cand_idx) JOIN pk USING (split, cand_idx))"""
ORACLE_SQL["blend_grid_stats"] = f"WITH {GRID} SELECT split, cand_idx, {', '.join(r(c, c) for c in ('ap', 'brier', 'prior_drift', 'p_at_k'))} FROM gs"
_clipped = clip01("s")
EVAL = f"""{GRID}, oc AS (SELECT split, row_id, y, {_clipped} AS s FROM sc),
ob AS (SELECT split, avg((s - y) * (s - y)) AS brier0 FROM oc GROUP BY split), ok0 AS (SELECT split, y, row_number() OVER (PARTITION BY split ORDER BY s DESC, row_id) AS rn, greatest(1, sum(y) OVER (PARTITION BY split)) AS k FROM oc),
ok AS (SELECT split, avg(CASE WHEN rn <= k THEN y::DOUBLE END) AS p0 FROM ok0 GROUP BY split),
dl AS (SELECT gs.*, ap - (SELECT ap FROM gs g WHERE g.split = gs.split AND g.cand_idx = 2) AS ap_delta, brier - brier0 AS brier_loss, p0 - p_at_k AS p_loss FROM gs JOIN ob USING (split) JOIN ok USING (split)),
ev AS (SELECT cand_idx, avg(ap) AS ap_mean, avg(ap) - 1.96::DOUBLE * stddev_samp(ap) / sqrt(count(ap)) AS ap_lcb, avg(ap_delta) - 1.96::DOUBLE * stddev_samp(ap_delta) / sqrt(count(ap_delta)) AS ap_delta_lcb,
  avg(prior_drift) + 1.96::DOUBLE * stddev_samp(prior_drift) / sqrt(count(*)) AS prior_drift_ucb, avg(brier_loss) + 1.96::DOUBLE * stddev_samp(brier_loss) / sqrt(count(*)) AS brier_ucb,
  avg(p_loss) + 1.96::DOUBLE * stddev_samp(p_loss) / sqrt(count(*)) AS p_loss_ucb FROM dl GROUP BY cand_idx),
ef AS (SELECT *, CASE WHEN prior_drift_ucb > 0.05 THEN 1 ELSE 0 END + CASE WHEN brier_ucb > 0.01 THEN 1 ELSE 0 END + CASE WHEN p_loss_ucb > 0.05 THEN 1 ELSE 0 END AS violations FROM ev)"""
ORACLE_SQL["blend_bounds"] = f"WITH {EVAL} SELECT cand_idx, {', '.join(r(c, c, 8) for c in ('ap_mean', 'ap_lcb', 'ap_delta_lcb', 'prior_drift_ucb', 'brier_ucb', 'p_loss_ucb'))}, CAST(violations AS BIGINT) AS violations FROM ef"
ORACLE_SQL["blend_select"] = f"""WITH {EVAL}, es AS (SELECT ef.*, mode, alpha, violations = 0 AS ok, ef.cand_idx = 2 AS dflt, abs(alpha - 0.333333::DOUBLE) AS far FROM ef JOIN gr USING (cand_idx)),
g AS (SELECT mode, alpha FROM es WHERE ok AND NOT dflt AND ap_delta_lcb > 0 ORDER BY ap_delta_lcb DESC, ap_lcb DESC, far, cand_idx LIMIT 1),
f AS (SELECT mode, alpha FROM es WHERE ok ORDER BY ap_lcb DESC, ap_mean DESC, far, cand_idx LIMIT 1)
SELECT CASE WHEN dk THEN 'prob' WHEN ng > 0 THEN (SELECT mode FROM g) WHEN nf > 0 THEN (SELECT mode FROM f) ELSE 'prob' END AS mode,
  CASE WHEN dk THEN 0.333333::DOUBLE WHEN ng > 0 THEN (SELECT alpha FROM g) WHEN nf > 0 THEN (SELECT alpha FROM f) ELSE 0.333333::DOUBLE END AS alpha,
  CASE WHEN dk THEN 'default_feasible_no_positive_lcb_delta' WHEN ng > 0 THEN 'adapted_positive_lcb_delta' WHEN nf > 0 THEN 'best_feasible_lcb_ap' ELSE 'default_relaxed_or_too_few_samples' END AS reason
FROM (SELECT (SELECT count(*) FROM g) AS ng, (SELECT count(*) FROM f) AS nf, (SELECT ok FROM es WHERE dflt) AND (SELECT count(*) FROM g) = 0 AS dk)"""

# --- parameters ---
ORACLE_SQL["budget_split"] = """WITH p AS (SELECT t AS total, a AS alpha, least(t - 1, greatest(1, CAST(round_even(t * a, 0) AS BIGINT))) AS shadow
  FROM (SELECT unnest([2, 80, 200]::BIGINT[]) AS t), (SELECT unnest([0.0, 0.25, 0.5, 0.3125, 1.0]::DOUBLE[]) AS a)) SELECT total, alpha, total - shadow AS original, shadow FROM p"""
ORACLE_SQL["alpha_ratio"] = "SELECT range / 100.0::DOUBLE AS alpha, CAST((100 - range) // gcd(range, 100) AS VARCHAR) || ':' || CAST(range // gcd(range, 100) AS VARCHAR) AS ratio FROM range(101)"
ORACLE_SQL["alpha_grid"] = "SELECT row_number() OVER (ORDER BY a) - 1 AS i, a AS alpha FROM (SELECT round(range * 0.02::DOUBLE, 6) AS a FROM range(51) UNION SELECT 0.333333::DOUBLE)"
ORACLE_SQL["method_names"] = """SELECT c AS classifier, o AS oversampler, c || '_' || o AS plain, 'blend_' || c || '_' || o AS blended, 'blend_' || c || '_' || o || '_logit' AS fixed
FROM (SELECT unnest(['rf', 'extratrees']) AS c), (SELECT unnest(['smote', 'outward_ladder']) AS o)"""
ORACLE_SQL["job_plan"] = "SELECT kind, n FROM (VALUES ('native', 3::BIGINT), ('oversampler', 27::BIGINT), ('blend', 30::BIGINT), ('rival', 12::BIGINT)) v(kind, n)"

# --- comparison statistics ---
RES = f"""re0 AS (SELECT 'd' || d AS dataset, c AS classifier, s AS seed, f AS fold, m AS method FROM (SELECT unnest(range(25)) AS d), (SELECT unnest(['rf', 'extratrees', 'bagged_cart']) AS c),
  (SELECT unnest([42, 44, 49]) AS s), (SELECT unnest([1, 2, 3, 4, 5]) AS f), (SELECT unnest(['A-1', 'A-2', 'B-1', 'B-2', 'C-1', 'C-2']) AS m)),
re AS (SELECT *, floor(1000 * (0.5::DOUBLE + 0.3::DOUBLE * {u(42, 'result', 'dataset', 'classifier', 'seed', 'fold', 'method')} + CASE WHEN method LIKE 'A%' THEN 0.06::DOUBLE WHEN method LIKE 'B%' THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END)) / 1000 AS pr_auc FROM re0),
me AS (SELECT classifier, dataset, method, avg(pr_auc) AS m FROM re GROUP BY ALL)"""
ORACLE_SQL["block_table"] = f"WITH {RES} SELECT classifier, dataset, " + ", ".join(r(f"avg(pr_auc) FILTER (WHERE method = '{m}')", m.lower().replace("-", "_")) for m in ("A-1", "B-1", "C-1")) + " FROM re GROUP BY ALL"
DEL = f"{RES}, de AS (SELECT o.method, round(b.m - o.m, 9) AS d FROM me o JOIN me b USING (classifier, dataset) WHERE b.method = 'A-1' AND o.method <> 'A-1')"
ORACLE_SQL["wins_losses"] = f"WITH {DEL} SELECT method, {r('avg(d)', 'mean_delta')}, {r('median(d)', 'median_delta')}, count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d = 0) AS ties, count(*) FILTER (WHERE d < 0) AS losses FROM de GROUP BY method"
ORACLE_SQL["friedman_ranks"] = f"""WITH {RES}, m9 AS (SELECT classifier, dataset, method, round(m, 9) AS m FROM me),
fr AS (SELECT *, rank() OVER (PARTITION BY classifier, dataset ORDER BY m DESC) + (count(*) OVER (PARTITION BY classifier, dataset, m) - 1) / 2.0::DOUBLE AS rk FROM m9)
SELECT method, {r('avg(m)', 'mean_pr_auc')}, {r('avg(rk)', 'avg_rank')} FROM fr GROUP BY method"""
WIL = f"""{DEL}, wr AS (SELECT method, d, rank() OVER (PARTITION BY method ORDER BY abs(d)) + (count(*) OVER (PARTITION BY method, abs(d)) - 1) / 2.0::DOUBLE AS rk FROM de WHERE d <> 0),
wi AS (SELECT method, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0.0 END)::DOUBLE AS w_plus FROM wr GROUP BY method)"""
ORACLE_SQL["wilcoxon_w"] = f"WITH {WIL} SELECT method, n, {r('w_plus', 'w_plus')} FROM wi"
ORACLE_SQL["holm"] = f"""WITH {WIL}, hp AS (SELECT method AS code, 1.0::DOUBLE / (1.0::DOUBLE + w_plus) AS p FROM wi), hi AS (SELECT *, row_number() OVER (ORDER BY p, code) AS i, count(*) OVER () AS m FROM hp)
SELECT code, {r('p', 'p')}, round(least(1.0::DOUBLE, max((m - i + 1) * p) OVER (ORDER BY p, code ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) + 0.0 AS holm_p FROM hi"""
TWO = f"""{RES}, mk AS (SELECT dataset, classifier, seed, fold, method, CASE WHEN method = 'B-1' THEN pr_auc + 0.01::DOUBLE ELSE pr_auc END AS pr_auc FROM (
  SELECT * FROM re WHERE NOT (dataset = 'd3' AND method = 'A-1') UNION ALL SELECT * FROM re WHERE dataset = 'd4' AND fold = 1))"""
ORACLE_SQL["signature_diff"] = f"""WITH {TWO}, a AS (SELECT dataset, seed, fold, method, count(*) AS n FROM mk GROUP BY ALL), b AS (SELECT dataset, seed, fold, method, count(*) AS n FROM re GROUP BY ALL)
SELECT dataset, seed, fold, method, a.n AS n_made, b.n AS n_expected, CASE WHEN a.n IS NULL THEN 'expected_only' WHEN b.n IS NULL THEN 'made_only' ELSE 'both' END AS side
FROM a FULL JOIN b USING (dataset, seed, fold, method) WHERE a.n IS DISTINCT FROM b.n"""
ORACLE_SQL["value_diff"] = f"""WITH {TWO} SELECT method, round(a.m - b.m, 9) AS delta FROM (SELECT method, avg(pr_auc) AS m FROM mk GROUP BY method) a
FULL JOIN (SELECT method, avg(pr_auc) AS m FROM re GROUP BY method) b USING (method) ORDER BY abs(delta) DESC NULLS LAST, method LIMIT 20"""
ORACLE_SQL["top_methods"] = f"WITH {RES} SELECT method, {r('avg(pr_auc)', 'mean_pr_auc')} FROM re GROUP BY method ORDER BY avg(pr_auc) DESC, method LIMIT 20"
ORACLE_SQL["result_shape"] = f"""WITH {RES} SELECT count(*) AS n_rows, count(DISTINCT dataset) AS n_datasets, count(DISTINCT method) AS n_methods,
  (SELECT string_agg(seed, ',' ORDER BY seed) FROM (SELECT DISTINCT CAST(seed AS VARCHAR) AS seed FROM re)) AS seeds, CAST(min(fold) AS BIGINT) AS first_fold, CAST(max(fold) AS BIGINT) AS last_fold FROM re"""
ORACLE_SQL["scalar_lookup"] = "SELECT c_name AS code, c_acctbal AS value FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer)"
ORACLE_SQL["tube_residual"] = f"""WITH {emb()}, {BOX}, un AS (SELECT list_transform(hi, lambda x: x / sqrt(list_inner_product(hi, hi))) AS v FROM box),
a AS (SELECT row_id, f, v, list_inner_product(f, v) AS a FROM emb, un)
SELECT row_id, {r('sqrt(list_inner_product(list_transform(list_zip(f, v), lambda t: t[1] - a * t[2]), list_transform(list_zip(f, v), lambda t: t[1] - a * t[2])))', 'residual')} FROM a"""
ORACLE_SQL["positive_scores"] = f"""WITH {emb()}, b AS (SELECT min(f[1]) AS lo, max(f[1]) AS hi FROM emb)
SELECT row_id, 'raw' AS kind, {r('CASE WHEN hi - lo > 1e-12 THEN (f[1] - lo) / (hi - lo) ELSE 0.5 END', 'score')} FROM emb, b
UNION ALL SELECT row_id, 'probability', {r('abs(f[2])', 'score')} FROM emb UNION ALL SELECT row_id, 'one class', 0.0::DOUBLE AS score FROM emb"""
