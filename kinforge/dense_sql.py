"""SQL of dense linear algebra for the oracles: Gauss-Jordan elimination as a recursive query, and what is built on it."""

from __future__ import annotations

from kinforge import lenses as L


def solved(name: str, augmented: str, order: str, by: str = "") -> str:
    """Tables for WITH RECURSIVE: ``name`` (by..., i, j, v) holds the columns from ``order`` on after eliminating the first
    ``order`` ones of the symmetric positive definite system ``augmented`` (by..., i, j, v), rows and columns from 0."""
    key, part = (f"{by}, ", f"{by}, ") if by else ("", "")
    return f"""{name}__steps AS (
  SELECT 0 AS k, {key}i, j, v FROM {augmented}
  UNION ALL
  SELECT k + 1, {key}i, j, CASE WHEN i = k THEN v / kk ELSE v - ik * kj / kk END FROM (
    SELECT *, max(CASE WHEN j = k THEN v END) OVER (PARTITION BY {part}i) AS ik, max(CASE WHEN i = k THEN v END) OVER (PARTITION BY {part}j) AS kj,
      max(CASE WHEN i = k AND j = k THEN v END) OVER ({f"PARTITION BY {by}" if by else ""}) AS kk FROM {name}__steps WHERE k < {order}) WHERE j > k),
{name} AS (SELECT {key}i, j - {order} AS j, v FROM {name}__steps WHERE k = {order})"""


def inverse(name: str, matrix: str, order: str) -> str:
    """Tables for WITH RECURSIVE: ``name`` (i, j, v) is the inverse of the positive definite ``matrix`` (i, j, v)."""
    return f"""{name}__wide AS (SELECT i, j, v::DOUBLE AS v FROM {matrix} UNION ALL SELECT i, j + {order}, (i = j)::INT::DOUBLE FROM {matrix}),
{solved(name, f"{name}__wide", order)}"""


N = "(SELECT count(*) FROM supplier)"
#: g: VanRaden's matrix of the genotype lens, both triangles; me: means that tuning uses, with A22 = I.
GRM = f"""{L.GENO}, {L.FREQ}, z AS (SELECT snp, sample, coalesce(dosage - 2 * p, 0) AS z FROM geno JOIN ok USING (snp)),
  g AS (SELECT a.sample AS i, b.sample AS j, sum(a.z * b.z) / (SELECT sum(2 * p * (1 - p)) FROM ok) AS v FROM z a JOIN z b ON a.snp = b.snp GROUP BY 1, 2)"""


def tuned(a22: str) -> str:
    """Table ``k``: g tuned to the table ``a22`` (i, j, v; all cells) and blended with it."""
    return f"""me AS (SELECT avg(g.v) FILTER (g.i = g.j) AS dg, avg(g.v) FILTER (g.i <> g.j) AS og, avg(a.v) FILTER (g.i = g.j) AS da, avg(a.v) FILTER (g.i <> g.j) AS oa FROM g JOIN {a22} a USING (i, j)),
  k AS (SELECT i, j, 0.95 * (da - (da - oa) / (dg - og) * dg + (da - oa) / (dg - og) * g.v) + 0.05 * a.v AS v FROM g JOIN {a22} a USING (i, j), me)"""


EYE = "eye AS (SELECT i, j, (i = j)::INT::DOUBLE AS v FROM g)"
Y = "y AS (SELECT s_suppkey AS i, s_acctbal / 1000 AS y FROM supplier)"

TUNED = f"WITH {GRM}, {EYE}, {tuned('eye')} SELECT i, j, round(v, 6) + 0.0 AS v FROM k"

GBLUP = f"""WITH RECURSIVE {GRM}, {EYE}, {tuned('eye')}, {Y},
  wide AS (SELECT i, j, 0.4 * v + 0.6 * (i = j)::INT AS v FROM k UNION ALL SELECT i, {N}, y FROM y UNION ALL SELECT i, {N} + 1, 1.0 FROM y),
  {solved("s", "wide", N)},
  mu AS (SELECT sum(v) FILTER (j = 0) / sum(v) FILTER (j = 1) AS mu FROM s),
  w AS (SELECT i AS j, sum(v) FILTER (j = 0) - any_value(mu) * sum(v) FILTER (j = 1) AS w FROM s, mu GROUP BY i)
SELECT i AS idx, round(0.4 * sum(v * w), 5) + 0.0 AS u FROM k JOIN w USING (j) GROUP BY i"""

HE = f"""WITH {GRM}, {Y}, r AS (SELECT i, y - avg(y) OVER () AS r FROM y),
  p AS (SELECT g.i, g.j, v, a.r AS ri, b.r AS rj FROM g JOIN r a ON a.i = g.i JOIN r b ON b.i = g.j),
  vg AS (SELECT sum(v * ri * rj) / sum(v * v) AS vg FROM p WHERE i > j)
SELECT 'u' AS item, round(greatest(vg, 1e-6), 6) AS var FROM vg
UNION ALL SELECT 'e', round(greatest(avg(ri * ri - v * vg), 1e-6), 6) FROM p, vg WHERE i = j"""

APY = f"""WITH RECURSIVE {GRM}, {EYE}, {tuned('eye')}, half AS (SELECT {N} // 2 AS c),
  core AS (SELECT i, j, v FROM k, half WHERE i < c AND j < c),
  {inverse("ci", "core", f"({N} // 2)")},
  p AS (SELECT ci.i, k.j, sum(ci.v * k.v) AS p FROM ci JOIN k ON ci.j = k.i, half WHERE k.j >= c GROUP BY 1, 2),
  m AS (SELECT p.j, greatest(any_value(d.v) - sum(p * k.v), 1e-8) AS m FROM p JOIN k ON k.i = p.i AND k.j = p.j JOIN k d ON d.i = p.j AND d.j = p.j GROUP BY p.j),
  cells AS (SELECT i, j, v FROM ci UNION ALL SELECT a.i, b.i, sum(a.p * b.p / m) FROM p a JOIN p b USING (j) JOIN m USING (j) GROUP BY 1, 2
    UNION ALL SELECT i, j, -p / m FROM p JOIN m USING (j) UNION ALL SELECT j, i, -p / m FROM p JOIN m USING (j) UNION ALL SELECT j, j, 1 / m FROM m)
SELECT i, j, round(sum(v), 5) + 0.0 AS v FROM cells GROUP BY 1, 2"""

HWE = f"""WITH {L.GENO}, c AS (SELECT snp, count_if(dosage = 0)::BIGINT AS n0, count_if(dosage = 1)::BIGINT AS n1, count_if(dosage = 2)::BIGINT AS n2 FROM geno GROUP BY snp),
  t AS (SELECT DISTINCT n0, n1, n2, 2 * least(n0, n2) + n1 AS rare, n0 + n1 + n2 AS n FROM c),
  l AS (SELECT *, h * ln(2) - lgamma(h + 1) - lgamma((rare - h) / 2 + 1) - lgamma((2 * n - rare - h) / 2 + 1) AS l FROM (SELECT *, unnest(range(rare % 2, rare + 1, 2)) AS h FROM t)),
  e AS (SELECT *, exp(l - max(l) OVER w) AS e, max(l) FILTER (h = n1) OVER w - max(l) OVER w AS own FROM l WINDOW w AS (PARTITION BY n0, n1, n2)),
  p AS (SELECT n0, n1, n2, CASE WHEN any_value(n) = 0 THEN 1 ELSE least(1, sum(e) FILTER (e <= exp(own) * (1 + 1e-9)) / sum(e)) END AS p FROM e GROUP BY ALL)
SELECT snp, n0, n1, n2, round(p, 6) AS hwe_p FROM c JOIN p USING (n0, n1, n2)"""

SBLUP = f"""WITH RECURSIVE {L.GENO}, {L.EFFECTS},
  f AS (SELECT snp, avg(dosage) AS mean, var_pop(dosage) * count(dosage) / count(*) AS square FROM geno GROUP BY snp),
  z AS (SELECT snp, sample, coalesce((dosage - mean) / sqrt(square), 0) AS z, beta, snp // 1000 AS block FROM geno JOIN f USING (snp) JOIN beta USING (snp) WHERE square > 0),
  c AS (SELECT (SELECT count(*) FROM part) * 0.7 / 0.3 / {N} AS c),
  wide AS (SELECT a.block, a.sample AS i, b.sample AS j, sum(a.z * b.z) + any_value(c) * {N} * (a.sample = b.sample)::INT AS v FROM z a JOIN z b ON a.snp = b.snp, c GROUP BY a.block, a.sample, b.sample
    UNION ALL SELECT block, sample, {N}, sum(z * beta) FROM z GROUP BY block, sample),
  {solved("s", "wide", N, "block")}
SELECT snp, round((any_value(beta) - sum(z * s.v)) / any_value(c), 9) + 0.0 AS effect FROM z JOIN s ON s.block = z.block AND s.i = z.sample, c GROUP BY snp"""

#: A22 of the genotyped customers, all cells.
A22 = f"""a22 AS (SELECT a.idx AS i, b.idx AS j, CASE WHEN a.idx = b.idx THEN 1.0 WHEN a.sire = b.sire OR a.sire = b.idx OR a.dam = b.idx OR b.sire = a.idx OR b.dam = a.idx THEN 0.5 ELSE 0 END AS v
  FROM ped a JOIN ped b ON a.idx < {N} AND b.idx < {N})"""


def h_inverse(ainv: str) -> str:
    """H^-1 over ``ainv``, the SQL that defines ped and ainv (i, j, v) in a WITH."""
    return f"""{ainv.replace("WITH", "WITH RECURSIVE", 1)}, {GRM}, {A22}, {tuned("a22")}, {inverse("gi", "k", N)}, {inverse("ai", "a22", N)},
  cells AS (SELECT * FROM ainv UNION ALL SELECT * FROM gi UNION ALL SELECT i, j, -v FROM ai),
  h AS (SELECT i, j, round(sum(v), 5) + 0.0 AS v FROM cells GROUP BY 1, 2) SELECT * FROM h WHERE v <> 0"""


def pedigree_blup(pe: bool) -> str:
    """Tables up to b (name, b) and u (id, u, pe): families of two founders and their children are solved in closed form for
    each column of X and for y, with permanent effects absorbed, and the fixed effects by elimination."""
    share = "3.0 / (n + 3.0)" if pe else "1.0"
    return f"""WITH RECURSIVE {L.PHENO}, {L.PED}, x AS (SELECT rec, id, 'mu' AS name, 1.0::DOUBLE AS val FROM pheno UNION ALL
    SELECT rec, id, 'priority_' || priority, 1.0 FROM pheno WHERE priority <> (SELECT min(priority) FROM pheno) UNION ALL SELECT rec, id, 'mon', mon FROM pheno),
  xy AS (SELECT * FROM x UNION ALL SELECT rec, id, 'y', y FROM pheno),
  names AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS c FROM (SELECT DISTINCT name FROM x)),
  own AS (SELECT idx, sire, nn.name, coalesce(s.r, 0) AS r, coalesce(m.n, 0) AS n FROM ped CROSS JOIN (SELECT DISTINCT name FROM xy) nn
    LEFT JOIN (SELECT id, name, sum(val) AS r FROM xy GROUP BY 1, 2) s ON s.id = idx AND s.name = nn.name LEFT JOIN (SELECT id, count(*) AS n FROM pheno GROUP BY 1) m ON m.id = idx),
  eff AS (SELECT *, n * {share} AS ne, r * {share} AS re FROM own),
  kids AS (SELECT sire AS f, name, 1.5 * count(*) / 2 - 2.25 * sum(1 / (ne + 3.0)) AS q, 1.5 * sum(re / (ne + 3.0)) AS t FROM eff WHERE sire IS NOT NULL GROUP BY 1, 2),
  pairs AS (SELECT a.idx AS f, a.name, coalesce(q, 0) AS q, coalesce(t, 0) AS t, a.ne + 1.5 + coalesce(q, 0) AS ms, b.ne + 1.5 + coalesce(q, 0) AS md, a.re + coalesce(t, 0) AS rs, b.re + coalesce(t, 0) AS rd
    FROM eff a JOIN eff b ON b.idx = a.idx + 1 AND b.name = a.name LEFT JOIN kids ON kids.f = a.idx AND kids.name = a.name WHERE a.idx % 4 = 0),
  top AS (SELECT f, name, (rs * md - q * rd) / (ms * md - q * q) AS us, (rd * ms - q * rs) / (ms * md - q * q) AS ud FROM pairs),
  u AS (SELECT idx, eff.name, r, n, CASE WHEN sire IS NOT NULL THEN (re + 1.5 * (t.us + t.ud)) / (ne + 3.0) WHEN idx % 4 = 0 AND p.f IS NOT NULL THEN p.us WHEN idx % 4 = 1 AND p.f IS NOT NULL THEN p.ud ELSE re / (ne + 1.5) END AS u
    FROM eff LEFT JOIN top t ON t.f = sire AND t.name = eff.name LEFT JOIN top p ON p.f = (idx // 4) * 4 AND p.name = eff.name),
  absorbed AS (SELECT *, {"(r - n * u) / (n + 3.0)" if pe else "0.0"} AS pe FROM u),
  cells AS (SELECT a.name AS n1, b.name AS n2, sum(a.val * b.val) AS v FROM x a JOIN xy b USING (rec) GROUP BY 1, 2
    UNION ALL SELECT a.name, b.name, -sum(a.r * (b.u + b.pe)) FROM absorbed a JOIN absorbed b USING (idx) WHERE a.name <> 'y' GROUP BY 1, 2),
  wide AS (SELECT i.c AS i, coalesce(j.c, (SELECT count(*) FROM names)) AS j, sum(v) AS v FROM cells JOIN names i ON i.name = n1 LEFT JOIN names j ON j.name = n2 GROUP BY 1, 2),
  {solved("s", "wide", "(SELECT count(*) FROM names)")},
  b AS (SELECT name, v AS b FROM s JOIN names ON c = i),
  blup AS (SELECT idx, sum(u * CASE WHEN name = 'y' THEN 1 ELSE -b END) AS u, sum(pe * CASE WHEN name = 'y' THEN 1 ELSE -b END) AS pe FROM absorbed LEFT JOIN b USING (name) GROUP BY idx)"""


PBLUP = f"{pedigree_blup(False)} SELECT idx, round(u, 5) + 0.0 AS u FROM blup"
REPEAT = f"""{pedigree_blup(True)}, fit AS (SELECT rec, any_value(id) AS id, sum(val * b) AS fixed FROM x JOIN b USING (name) GROUP BY rec)
SELECT rec, y, round(fixed, 4) AS fixed, round(u, 4) + 0.0 AS u, round(pe, 4) + 0.0 AS pe, round(fixed + u + pe, 4) AS fitted, round(y - fixed - u - pe, 4) + 0.0 AS residual
FROM fit JOIN pheno USING (rec) JOIN blup ON idx = fit.id"""

INBREEDING = f"""WITH RECURSIVE {L.DEEP}, par AS (SELECT idx, sire AS p FROM deep WHERE sire IS NOT NULL UNION ALL SELECT idx, dam FROM deep WHERE dam IS NOT NULL),
  w AS (SELECT idx, idx AS ancestor, 1.0::DOUBLE AS weight FROM deep UNION ALL SELECT w.idx, par.p, w.weight * 0.5 FROM w JOIN par ON w.ancestor = par.idx),
  l AS (SELECT idx, ancestor, sum(weight) AS weight FROM w GROUP BY 1, 2),
  g AS (SELECT idx, 0 AS generation FROM deep WHERE sire IS NULL UNION SELECT d.idx, g.generation + 1 FROM deep d JOIN g ON d.sire = g.idx OR d.dam = g.idx),
  age AS (SELECT idx, max(generation) AS generation FROM g GROUP BY idx),
  steps AS (SELECT 0 AS k, idx, CASE WHEN generation = 0 THEN 1.0::DOUBLE END AS d FROM age
    UNION ALL
    SELECT k + 1, s.idx, CASE WHEN generation = k + 1 THEN 1 - 0.25 * (1 + fs.f) - 0.25 * (1 + fd.f) ELSE s.d END FROM steps s JOIN age USING (idx) JOIN deep USING (idx)
      LEFT JOIN (SELECT l.idx, sum(weight * weight * d) - 1 AS f FROM l JOIN steps t ON t.idx = l.ancestor GROUP BY l.idx HAVING count(*) = count(d)) fs ON fs.idx = deep.sire
      LEFT JOIN (SELECT l.idx, sum(weight * weight * d) - 1 AS f FROM l JOIN steps t ON t.idx = l.ancestor GROUP BY l.idx HAVING count(*) = count(d)) fd ON fd.idx = deep.dam
    WHERE k < (SELECT max(generation) FROM age)),
  d AS (SELECT idx, d FROM steps WHERE k = (SELECT max(generation) FROM age))
SELECT l.idx, round(greatest(0, sum(weight * weight * a.d) - 1), 8) + 0.0 AS f, round(any_value(o.d), 8) AS d FROM l JOIN d a ON a.idx = l.ancestor JOIN d o ON o.idx = l.idx GROUP BY l.idx"""

#: x: the fixed effects' columns, xy: those and y, names: columns by number, of the phenotype lens.
_COLUMNS = f"""{L.PHENO}, {L.PED}, x AS (SELECT rec, id, 'mu' AS name, 1.0::DOUBLE AS val FROM pheno UNION ALL
    SELECT rec, id, 'priority_' || priority, 1.0 FROM pheno WHERE priority <> (SELECT min(priority) FROM pheno) UNION ALL SELECT rec, id, 'mon', mon FROM pheno),
  xy AS (SELECT * FROM x UNION ALL SELECT rec, id, 'y', y FROM pheno),
  names AS (SELECT name, (row_number() OVER (ORDER BY name = 'y', name) - 1)::INT AS c FROM (SELECT DISTINCT name FROM xy)),
  r AS (SELECT id, c, sum(val) AS r FROM xy JOIN names USING (name) GROUP BY 1, 2), n AS (SELECT id, count(*) AS n FROM pheno GROUP BY 1),
  d AS (SELECT *, CASE WHEN sire IS NULL THEN 1.0 ELSE 0.5 END AS d FROM ped),
  t AS (SELECT idx AS k, idx, 1.0 AS c, d FROM d UNION ALL SELECT sire, idx, -0.5, d FROM d WHERE sire IS NOT NULL UNION ALL SELECT dam, idx, -0.5, d FROM d WHERE dam IS NOT NULL),
  ainv AS (SELECT a.k AS i, b.k AS j, sum(a.c * b.c / a.d)::DOUBLE AS v FROM t a JOIN t b USING (idx) GROUP BY 1, 2)"""


def _fixed(sol: str, key: str) -> str:
    """Tables b (c, b): the fixed effects, from the right sides ``rhs`` ({key}, c, v) and their solutions ``sol`` ({key}, c, v)."""
    return f"""cells AS (SELECT a.c AS i, b.c AS j, sum(x.val * z.val) AS v FROM x JOIN names a USING (name) JOIN xy z ON z.rec = x.rec JOIN names b ON b.name = z.name GROUP BY 1, 2
    UNION ALL SELECT a.c, b.c, -sum(a.v * b.v) FROM rhs a JOIN {sol} b USING ({key}) WHERE a.c < (SELECT count(*) - 1 FROM names) GROUP BY 1, 2),
  fwide AS (SELECT i, j, sum(v) AS v FROM cells GROUP BY 1, 2),
  {solved("fs", "fwide", "(SELECT count(*) - 1 FROM names)")},
  b AS (SELECT i AS c, v AS b FROM fs)"""


#: Direct and maternal effects: a family (two founders and their children) is one system of eight equations.
MATERNAL = f"""WITH RECURSIVE {_COLUMNS},
  fam AS (SELECT *, CASE WHEN sire IS NOT NULL THEN sire // 4 WHEN idx % 4 IN (0, 1) THEN idx // 4 ELSE 1000000000 + idx END AS f FROM ped),
  loc AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY sire IS NOT NULL, idx) - 1 AS l FROM fam),
  eq AS (SELECT f, l, idx, 0 AS what FROM loc UNION ALL SELECT f, l + 4, idx, 1 FROM loc),
  mat AS (SELECT a.f, a.l AS i, b.l AS j, (CASE a.what WHEN 0 THEN 1.25 ELSE 5.0 END) * v AS v FROM ainv JOIN eq a ON a.idx = ainv.i JOIN eq b ON b.idx = ainv.j AND b.what = a.what
    UNION ALL SELECT f, l, l, n FROM loc JOIN n ON id = idx
    UNION ALL SELECT c.f, m.l + 4, m.l + 4, n FROM loc c JOIN n ON id = c.idx JOIN loc m ON m.idx = c.dam
    UNION ALL SELECT c.f, c.l, m.l + 4, n FROM loc c JOIN n ON id = c.idx JOIN loc m ON m.idx = c.dam
    UNION ALL SELECT c.f, m.l + 4, c.l, n FROM loc c JOIN n ON id = c.idx JOIN loc m ON m.idx = c.dam),
  rhs AS (SELECT f, l, c, sum(v) AS v FROM (SELECT f, l, c, r AS v FROM loc JOIN r ON id = idx UNION ALL SELECT k.f, m.l + 4, c, r FROM loc k JOIN r ON id = k.idx JOIN loc m ON m.idx = k.dam) GROUP BY ALL),
  ff AS (SELECT DISTINCT f FROM loc), eight AS (SELECT f, unnest(range(8)) AS l FROM ff),
  wide AS (SELECT f, i, j, sum(v)::DOUBLE AS v FROM (
    SELECT * FROM mat UNION ALL SELECT a.f, a.l, b.l, 0 FROM eight a JOIN eight b USING (f) UNION ALL SELECT f, l, l, 1 FROM eight ANTI JOIN eq USING (f, l)
    UNION ALL SELECT f, l, 8 + c, 0 FROM eight, names UNION ALL SELECT f, l, 8 + c, v FROM rhs) GROUP BY ALL),
  {solved("s", "wide", "8", "f")},
  sol AS (SELECT f, i AS l, j AS c, v FROM s),
  {_fixed("sol", "f, l")}
SELECT idx, round(sum(CASE WHEN what = 0 THEN v * coalesce(-b, 1) END), 5) + 0.0 AS u, round(sum(CASE WHEN what = 1 THEN v * coalesce(-b, 1) END), 5) + 0.0 AS mat
FROM eq JOIN sol USING (f, l) LEFT JOIN b USING (c) GROUP BY idx"""

#: Single-step: the genotyped animals and their families are one system, every other family one of four equations.
SINGLE_STEP = f"""WITH RECURSIVE {_COLUMNS}, {GRM}, {A22}, {tuned("a22")}, {inverse("gi", "k", N)}, {inverse("ai", "a22", N)},
  hinv AS (SELECT i, j, sum(v) AS v FROM (SELECT * FROM ainv UNION ALL SELECT * FROM gi UNION ALL SELECT i, j, -v FROM ai) GROUP BY 1, 2),
  fam AS (SELECT *, CASE WHEN sire IS NOT NULL THEN sire // 4 WHEN idx % 4 IN (0, 1) THEN idx // 4 ELSE 1000000000 + idx END AS f0 FROM ped),
  typed AS (SELECT DISTINCT f0 FROM fam WHERE idx < {N}),
  loc AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY idx) - 1 AS l FROM (SELECT fam.*, CASE WHEN typed.f0 IS NULL THEN fam.f0 ELSE -1 END AS f FROM fam LEFT JOIN typed USING (f0))),
  rhs AS (SELECT f, l, c, r AS v FROM loc JOIN r ON id = idx),
  mat AS (SELECT a.f, a.l AS i, b.l AS j, 1.5 * v AS v FROM hinv JOIN loc a ON a.idx = hinv.i JOIN loc b ON b.idx = hinv.j UNION ALL SELECT f, l, l, n FROM loc JOIN n ON id = idx),
  ff AS (SELECT f, count(*) AS size FROM loc GROUP BY f), big AS (SELECT size FROM ff WHERE f = -1),
  small AS (SELECT f, unnest(range(4)) AS l FROM ff WHERE f >= 0),
  cellsA AS (SELECT * FROM mat UNION ALL SELECT a.f, a.l, b.l, 0 FROM small a JOIN small b USING (f) UNION ALL SELECT f, l, l, 1 FROM small ANTI JOIN loc USING (f, l)),
  wideA AS (SELECT f, i, j, sum(v)::DOUBLE AS v FROM (SELECT * FROM cellsA WHERE f >= 0 UNION ALL SELECT f, l, 4 + c, 0 FROM small, names UNION ALL SELECT f, l, 4 + c, v FROM rhs WHERE f >= 0) GROUP BY ALL),
  {solved("sa", "wideA", "4", "f")},
  wideB AS (SELECT i, j, sum(v)::DOUBLE AS v FROM (SELECT i, j, v FROM mat WHERE f = -1 UNION ALL SELECT a.l, b.l, 0 FROM loc a, loc b WHERE a.f = -1 AND b.f = -1
    UNION ALL SELECT l, size + c, 0 FROM loc, names, big WHERE f = -1 UNION ALL SELECT l, size + c, v FROM rhs, big WHERE f = -1) GROUP BY ALL),
  {solved("sb", "wideB", "(SELECT size FROM big)")},
  sol AS (SELECT f, i AS l, j AS c, v FROM sa UNION ALL SELECT -1, i, j, v FROM sb),
  {_fixed("sol", "f, l")}
SELECT idx, round(sum(v * coalesce(-b, 1)), 5) + 0.0 AS u FROM loc JOIN sol USING (f, l) LEFT JOIN b USING (c) GROUP BY idx"""


def _stage(tag: str, terms: list[tuple[int, int, str]], lam: str) -> str:
    """Tables c{tag} (idx, e, a, v): coefficients of the random regression, family by family. ``terms`` are (effect, polynomial)
    with the matrix of the effect, ``lam`` (e, a, b, v) the inverse covariances times the residual variance."""
    order = 4 * len(terms)
    place = "CASE " + " ".join(f"WHEN e = {e} AND a = {a} THEN {4 * k}" for k, (e, a, _) in enumerate(terms)) + " END"
    kinds = " UNION ALL ".join(f"SELECT {e} AS e, {a} AS a, '{kind}' AS kind" for e, a, kind in terms)
    fixed = _fixed(f"sol{tag}", "f, l").replace("cells AS", f"cells{tag} AS").replace("FROM cells", f"FROM cells{tag}").replace("fwide", f"fwide{tag}").replace("fs", f"fs{tag}").replace(" rhs ", f" rhs{tag} ").replace("  b AS (", f"  b{tag} AS (")
    return f"""terms{tag} AS ({kinds}), eq{tag} AS (SELECT f, l + {place} AS l, idx, e, a, kind FROM loc, terms{tag}),
  mat{tag} AS (SELECT x.f, x.l AS i, y.l AS j, lam.v * k.v AS v FROM kin k JOIN eq{tag} x ON x.idx = k.i AND x.kind = k.kind JOIN eq{tag} y ON y.idx = k.j AND y.kind = k.kind AND y.e = x.e JOIN {lam} lam ON lam.e = x.e AND lam.a = x.a AND lam.b = y.a
    UNION ALL SELECT x.f, x.l, y.l, zz.v FROM eq{tag} x JOIN eq{tag} y USING (f, idx) JOIN zz ON zz.id = x.idx AND zz.a = x.a AND zz.b = y.a),
  rhs{tag} AS (SELECT f, l, c, zr.v FROM eq{tag} x JOIN zr ON zr.id = x.idx AND zr.a = x.a),
  all{tag} AS (SELECT f, unnest(range({order})) AS l FROM (SELECT DISTINCT f FROM loc)),
  wide{tag} AS (SELECT f, i, j, sum(v)::DOUBLE AS v FROM (SELECT * FROM mat{tag} UNION ALL SELECT p.f, p.l, q.l, 0 FROM all{tag} p JOIN all{tag} q USING (f)
    UNION ALL SELECT f, l, l, 1 FROM all{tag} ANTI JOIN eq{tag} USING (f, l) UNION ALL SELECT f, l, {order} + c, 0 FROM all{tag}, names UNION ALL SELECT f, l, {order} + c, v FROM rhs{tag}) GROUP BY ALL),
  {solved(f"s{tag}", f"wide{tag}", str(order), "f")},
  sol{tag} AS (SELECT f, i AS l, j AS c, v FROM s{tag}),
  {fixed},
  c{tag} AS (SELECT idx, e, a, sum(v * coalesce(-b, 1)) AS v FROM eq{tag} JOIN sol{tag} USING (f, l) LEFT JOIN b{tag} USING (c) GROUP BY ALL)"""


_REGRESSION = f"""WITH RECURSIVE {_COLUMNS.replace(" UNION ALL SELECT rec, id, 'mon', mon FROM pheno)", ")", 1)},
  fam AS (SELECT *, CASE WHEN sire IS NOT NULL THEN sire // 4 WHEN idx % 4 IN (0, 1) THEN idx // 4 ELSE 1000000000 + idx END AS f FROM ped),
  loc AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY idx) - 1 AS l FROM fam),
  kin AS (SELECT 'a' AS kind, * FROM ainv UNION ALL SELECT 'i', idx, idx, 1 FROM ped),
  lim AS (SELECT min(mon) AS low, max(mon) AS high FROM pheno),
  phi AS (SELECT rec, id, unnest([0, 1]) AS a, unnest([sqrt(0.5::DOUBLE), sqrt(1.5::DOUBLE) * (2 * (mon - low) / (high - low) - 1)]) AS p FROM pheno, lim),
  zz AS (SELECT x.id, x.a, y.a AS b, sum(x.p * y.p) AS v FROM phi x JOIN phi y USING (rec) GROUP BY ALL),
  zr AS (SELECT phi.id, a, c, sum(p * val) AS v FROM phi JOIN xy USING (rec) JOIN names USING (name) GROUP BY ALL)"""
_FIRST = "lam0 AS (SELECT 0 AS e, 0 AS a, 0 AS b, 1.5 AS v UNION ALL SELECT 0, 1, 1, 1.5 UNION ALL SELECT 1, 0, 0, 3.0 UNION ALL SELECT 1, 1, 1, 3.0)"
_U = [(0, 0, "a"), (0, 1, "a")]
#: Coefficients after one refinement: K of the first solution (positive definite, so its floor is idle) takes the place of 0.4 I.
_REFINED = f"""{_REGRESSION}, {_FIRST}, {_stage("1", _U, "lam0")},
  kk AS (SELECT avg(x.v * x.v) AS k00, avg(x.v * y.v) AS k01, avg(y.v * y.v) AS k11 FROM c1 x JOIN c1 y ON x.idx = y.idx AND x.a = 0 AND y.a = 1),
  lam1 AS (SELECT 0 AS e, unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b, unnest([0.6 * k11, -0.6 * k01, -0.6 * k01, 0.6 * k00]) / (k00 * k11 - k01 * k01) AS v FROM kk),
  {_stage("2", _U, "lam1")}"""
RR_COEF = f"{_REFINED} SELECT idx, round(sum(v) FILTER (a = 0), 3) + 0.0 AS c0, round(sum(v) FILTER (a = 1), 3) + 0.0 AS c1 FROM c2 GROUP BY idx"
RR_CURVE = f"""{_REFINED}, times AS (SELECT DISTINCT mon AS t, sqrt(0.5::DOUBLE) AS p0, sqrt(1.5::DOUBLE) * (2 * (mon - low) / (high - low) - 1) AS p1 FROM pheno, lim)
SELECT x.idx, t, round(x.v * p0 + y.v * p1, 2) + 0.0 AS value FROM c2 x JOIN c2 y ON x.idx = y.idx AND x.a = 0 AND y.a = 1, times"""
RR_K = f"""{_REGRESSION}, {_FIRST}, {_stage("1", [*_U, (1, 0, "i"), (1, 1, "i")], "lam0")}
SELECT CASE x.e WHEN 0 THEN 'u' ELSE 'pe' END AS effect, x.a AS "row", y.a AS col, round(avg(x.v * y.v), 5) + 0.0 AS v FROM c1 x JOIN c1 y USING (idx, e) GROUP BY x.e, x.a, y.a"""
