"""Queries over chains of joined pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.operators import folds, joining, pair_scores as P, report
from strandloom.plans.pair_queries import named
from strandloom.plans.views import HITS, hits

QUERIES: dict[str, tuple[Callable, str | None]] = {}

#: LINE families with marks of their pieces, by hit_id % 5, and the query bases that pairs of names must share.
PIECES = ["L1PA2_3end", "L1PA2_5end", "L1M1_orf2", "L1M2_3end", "HAL1"]
ALLOWED = [("L1PA2_3end", "L1PA2_5end", 0), ("L1M1_orf2", "L1M2_3end", 10), ("L1M2_3end", "L1M1_orf2", 0), ("L1PA2_5end", "L1M1_orf2", -1), ("HAL1", "L1M2_3end", 50)]


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of named families, LINEs as pieces, MIRs as a class of their own."""
    h = named(hits(spark, sf_dir))
    name = F.when(F.col("subj_type") == "LINE/L1", F.element_at(F.array(*map(F.lit, PIECES)), (F.col("hit_id") % 5 + 1).cast("int"))).otherwise(F.col("subj_name"))
    kind = F.when(F.col("subj_name").startswith("MIR"), "SINE/MIR").otherwise(F.col("subj_type"))
    return h.withColumns({"subj_name": name, "subj_type": kind, "query_remaining": 20400 - F.col("query_end")})


def allowed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALLOWED, "name_a string, name_b string, threshold long")


def line_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of LINE pieces among the next four hits, in the order of chains (of equal ranges the better one first), and how well they fit."""
    p = P.pairs(pieces(spark, sf_dir), sides=P.SIDES | {"query_remaining": "query_remaining"}, order=folds.order_of_hits()).where("l_type LIKE 'LINE%' AND r_type LIKE 'LINE%'")
    p = P.line_names_fit(p.withColumn("kin", P.line_kin()), allowed(spark))
    return p.select(F.col("l_id").alias("hit_id"), F.col("r_id").alias("partner_id"), P.line_score(F.col("distance"), F.col("kin")).alias("fit"))


def joined_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between pieces of one element."""
    return joining.joined_links(pieces(spark, sf_dir), allowed(spark)).select("hit_id", "partner_id", "pair_score")


def joined_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit with its chain of pieces."""
    return joining.joined_chains(pieces(spark, sf_dir), allowed(spark)).select("hit_id", "chain")


def element_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements, not pieces, and newly covered bases of each class."""
    h = pieces(spark, sf_dir)
    return report.class_coverage(joining.with_heads(h, joining.joined_links(h, allowed(spark))), F.col("is_head"))


def merged_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits after linked neighbours have become one."""
    h = pieces(spark, sf_dir).withColumns({"del": F.col("del_permille") / 10, "ins": F.col("ins_permille") / 10})
    return joining.merged_pieces(h, joining.joined_links(h, allowed(spark))).drop("orientation", "stage")


CASES = """CASE WHEN subj_type = 'SINE/Alu' THEN ['AluSx', 'AluSx1', 'AluY', 'MIR3', 'MIR3b'][1 + hit_id % 5] WHEN subj_type = 'LTR/ERVL' THEN ['MLT1A', 'MSTC', 'THE1B', 'MER21A', 'HERVL-int'][1 + hit_id % 5]
  WHEN subj_type = 'DNA/hAT-Charlie' THEN ['MER5A', 'MER5B', 'Charlie1', 'Charlie1a', 'Tigger1'][1 + hit_id % 5] WHEN subj_type = 'LINE/L1' THEN ['L1PA2_3end', 'L1PA2_5end', 'L1M1_orf2', 'L1M2_3end', 'HAL1'][1 + hit_id % 5] ELSE subj_name END"""
PIECES_SQL = f"""pieces AS (SELECT * REPLACE ({CASES} AS subj_name, CASE WHEN subj_type = 'LTR/ERVL' AND hit_id % 5 < 3 THEN 'LTR/ERVL-MaLR' WHEN subj_type = 'SINE/Alu' AND hit_id % 5 >= 3 THEN 'SINE/MIR' ELSE subj_type END AS subj_type),
  CAST(div_permille AS DOUBLE) / 10 AS div, hit_id % 4 <> 0 AS masked, 20400 - query_end AS query_remaining FROM hits),
allowed(x, y, t) AS (VALUES {", ".join(map(str, ALLOWED))})"""
#: Of a pair of rows l and r with q, c and the names' fit: the LINE score for a distance.
LINE = """CASE WHEN l.orientation <> r.orientation THEN 0e0 ELSE (SELECT CASE WHEN s = 0 THEN 0e0 WHEN adj + q <> 0 THEN s + 1e0 / abs(adj + q) ELSE s + 1e0 / {d} END FROM (SELECT adj, CASE
  WHEN names_fit AND (l.orientation = '+' AND r.subj_start >= l.subj_start - 5 OR l.orientation = 'C' AND l.subj_start >= r.subj_start - 5)
   AND NOT (l.orientation = '+' AND contains(l.subj_name, '_3end') AND (contains(r.subj_name, '_5end') OR l.subj_remaining < 10)
    OR r.orientation = 'C' AND contains(r.subj_name, '_3end') AND (contains(l.subj_name, '_5end') OR r.query_remaining < 10))
   AND (adj = 0 OR adj <= (CAST(3.75 AS DOUBLE) * pow(greatest(l.subj_remaining, r.subj_remaining), CAST(0.48 AS DOUBLE)) - 47) * pow(1 - CAST({d} - 1 AS DOUBLE) / 30, 2) * likeness)
   AND likeness > 0.1 AND -c <= (1 - CAST({d} - 1 AS DOUBLE) / 30) * likeness * greatest(l.subj_remaining, r.subj_remaining) / CAST(1.4 AS DOUBLE) THEN 1e0
  WHEN kin AND c < 33 AND c > -(CAST(2500 AS DOUBLE) * CASE WHEN l.subj_name = r.subj_name THEN 1.5e0 ELSE 1e0 END * (10 - abs(l.div - r.div)) / 10 * (10 - {d}) / 10) THEN 0.5e0
  WHEN kin AND r.query_end > l.query_end AND l.query_end - r.query_start >= 33 AND c < 50 THEN 0.25e0 ELSE 0e0 END AS s FROM (SELECT CASE WHEN q > 0 THEN c - q ELSE c END AS adj,
   CASE WHEN l.div = r.div THEN 1.2e0 ELSE least(1.2e0, least(l.div, r.div) / greatest(l.div, r.div) / CAST(0.65 AS DOUBLE) - (greatest(l.div, r.div) - least(l.div, r.div)) / 100) END AS likeness,
   starts_with(split_part(l.subj_name, '_', 1), CASE split_part(r.subj_name, '_', 1) WHEN 'L1PA2' THEN 'L1PA2' WHEN 'L1M1' THEN 'L1M1' WHEN 'L1M2' THEN 'L1M2' ELSE 'HAL1' END) AS kin))) END"""
PLACED = """placed AS (SELECT *, row_number() OVER w AS rn, row_number() OVER (PARTITION BY query_name, subj_type ORDER BY query_start, query_end DESC, score DESC, hit_id) AS nth,
  greatest(query_start, lag(query_start) OVER w) - least(query_end, lag(query_end) OVER w) - 1 AS gap FROM pieces WINDOW w AS (PARTITION BY query_name ORDER BY query_start, query_end DESC, score DESC, hit_id)),
summed AS (SELECT *, coalesce(sum(gap) FILTER (gap >= 100) OVER w, 0) AS bp, count(*) FILTER (gap >= 100) OVER w AS n FROM placed WINDOW w AS (PARTITION BY query_name ORDER BY rn ROWS UNBOUNDED PRECEDING))"""
PAIRS = """pairs AS (SELECT l, r, r.rn - l.rn AS d, r.nth - l.nth AS cd, least(l.query_end, r.query_end) - greatest(l.query_start, r.query_start) + 1 AS q,
  CASE WHEN l.orientation = 'C' THEN r.subj_end - l.subj_start + 1 ELSE l.subj_end - r.subj_start + 1 END AS c, l.orientation = r.orientation AS strand,
  CAST(2500 AS DOUBLE) * CASE WHEN l.subj_name = r.subj_name THEN 1.5e0 ELSE 1e0 END * (10 - abs(l.div - r.div)) / 10 AS reach,
  coalesce(max(CASE WHEN NOT regexp_matches(r.subj_type, '(?i)^simple|low') THEN r.div END) OVER (PARTITION BY l.query_name, l.rn ORDER BY r.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS most
  FROM summed l JOIN summed r ON l.query_name = r.query_name AND r.rn BETWEEN l.rn + 1 AND l.rn + {ahead} WHERE NOT regexp_matches(l.subj_type, '(?i)^simple|low|dna')),
fitted AS (SELECT p.*, l.subj_name = r.subj_name OR coalesce(CASE WHEN a.t IS NOT NULL THEN a.t = 0 OR a.t > 0 AND q > a.t ELSE b.t = 0 OR b.t > 0 AND q > b.t END, false) AS names_fit
  FROM pairs p LEFT JOIN allowed a ON a.x = l.subj_name AND a.y = r.subj_name LEFT JOIN allowed b ON b.y = l.subj_name AND b.x = r.subj_name)"""
CLOSE = "l.stage = r.stage AND (contains(l.subj_name, r.subj_name) OR contains(r.subj_name, l.subj_name)) AND q >= -10 AND c >= -100 AND (c <= 21 OR q > 0 AND c - q <= 20)"
TAIL = r"regexp_replace(r.subj_name, '(\S+\d)[a-zA-Z]$', '\1')"
GENERIC = f"CASE WHEN NOT strand THEN 0e0 WHEN {CLOSE} THEN 1e0 WHEN starts_with(l.subj_name, {TAIL}) AND c < 33 AND c > -(reach * (15 - d) / 15) THEN 0.5e0 ELSE 0e0 END"
SINE = GENERIC.replace(f"starts_with(l.subj_name, {TAIL})", f"starts_with(l.subj_name, CASE WHEN r.subj_name LIKE 'Alu%' THEN left(r.subj_name, 5) ELSE {TAIL} END)")
NAMES_FIT = "CASE WHEN l.subj_name = r.subj_name THEN 1e0 WHEN l.subj_name IN ('MLT1A', 'THE1B') AND r.subj_name IN ('MLT1A', 'THE1B') THEN 0e0 ELSE 0.5e0 END"
LTR = f"""(SELECT CASE WHEN s > 0 THEN s + 1e0 / d ELSE 0e0 END FROM (SELECT CASE WHEN fit = 0 OR NOT strand THEN 0e0
  WHEN li AND ri AND c <= 111 AND (c >= -1234 OR same AND c >= -5555) THEN 1e0
  WHEN NOT li AND NOT ri AND (l.subj_type = 'LTR/ERVL-MaLR' OR fit = 1) AND m AND c > -(220 - {{cd}} * 20) AND c <= 50 AND ends_least >= 10 THEN 1e0
  WHEN li <> ri AND d <= 2 AND q > -350 AND ends_most <= 33 THEN 1e0
  WHEN fit = 1 AND c > -(reach * (10 - d) / 10) AND (li <> ri OR c < 33 AND m) THEN 0.5e0
  WHEN r.query_end > l.query_end AND (fit = 1 AND l.query_end - r.query_start >= 12 OR l.query_end - r.query_start >= 33) THEN 0.25e0 ELSE 0e0 END AS s
  FROM (SELECT {NAMES_FIT} AS fit, l.subj_name LIKE '%-int' AS li, r.subj_name LIKE '%-int' AS ri, l.masked AND r.masked AS m, l.subj_name = r.subj_name AS same,
   CASE WHEN l.orientation = '+' THEN least(l.subj_remaining, r.subj_start) ELSE least(l.subj_start, r.subj_remaining) END AS ends_least,
   CASE WHEN l.orientation = '+' THEN greatest(l.subj_remaining, r.subj_start) ELSE greatest(l.subj_start, r.subj_remaining) END AS ends_most)))"""
by_class = lambda line, cd, sine: f"CASE WHEN l.subj_type LIKE '%LINE%' THEN {LINE.format(d=line)} WHEN l.subj_type LIKE '%LTR%' THEN {LTR.format(cd=cd)} WHEN {sine} THEN {SINE} ELSE {GENERIC} END"
STOPS = """l.subj_type NOT LIKE '%SINE%' AND r.subj_name NOT LIKE '%-int' AND l.subj_end - l.subj_start > 50 AND most > 2 * l.div AND most > l.div + 10 OR (r.bp - l.bp) * (r.n - l.n) > 10000"""
SKIPS = "r.subj_name NOT LIKE '%-int' AND r.subj_end - r.subj_start > 50 AND most > 2 * r.div AND most > r.div + 10"
LINKED = f"""stopped AS (SELECT *, min(CASE WHEN {STOPS} THEN d END) OVER (PARTITION BY l.query_name, l.rn) AS stop FROM fitted),
scored AS (SELECT l.query_name AS query_name, l.hit_id AS hit_id, r.hit_id AS partner_id, l.rn AS i, r.rn AS j, CASE WHEN (stop IS NULL OR d < stop) AND NOT ({SKIPS})
  THEN {by_class('cd', 'cd', "l.subj_type LIKE '%SINE%' AND l.subj_type NOT LIKE '%Alu%'")} END AS score, {by_class('d', 'd', "l.subj_type LIKE '%SINE%'")} AS rival FROM stopped WHERE l.subj_type = r.subj_type),
able AS (SELECT * FROM (SELECT *, max(rival) OVER (PARTITION BY query_name, j ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM scored) WHERE score > 0 AND (best IS NULL OR best < score)),
choices AS (SELECT query_name, i, row_number() OVER (PARTITION BY query_name ORDER BY i) AS k, list({{'j': j, 'score': score, 'hit_id': hit_id, 'partner_id': partner_id}} ORDER BY j) AS js FROM able GROUP BY query_name, i),
walk AS (SELECT query_name, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, NULL::STRUCT(j BIGINT, score DOUBLE, hit_id BIGINT, partner_id BIGINT) AS made FROM (SELECT DISTINCT query_name FROM choices)
  UNION ALL SELECT query_name, k, CASE WHEN len(ok) > 0 THEN list_append(held, ok[1].j) ELSE held END, ok[1] FROM
   (SELECT query_name, k, held, list_reverse_sort(list_transform(list_filter(js, lambda x: len(list_filter(held, lambda y: y <= x.j)) = 0), lambda x: {{'score': x.score, 'near': -x.j, 'x': x}})) AS ranked,
     list_transform(ranked, lambda x: x.x) AS ok FROM (SELECT c.query_name, c.k, c.js, list_filter(w.taken, lambda y: y > c.i) AS held FROM walk w JOIN choices c ON c.query_name = w.query_name AND c.k = w.k + 1))),
links AS (SELECT made.hit_id AS hit_id, made.partner_id AS partner_id, made.score AS pair_score FROM walk WHERE made IS NOT NULL)"""
ALL = f"WITH RECURSIVE {HITS}, {PIECES_SQL}, {PLACED}, {PAIRS.format(ahead=21)}, {LINKED}"

QUERIES["line_pair_scores"] = (
    line_pair_scores,
    f"WITH {HITS}, {PIECES_SQL}, {PLACED}, {PAIRS.format(ahead=4)} SELECT l.hit_id AS hit_id, r.hit_id AS partner_id, {LINE.format(d='d')} AS fit FROM fitted WHERE l.subj_type LIKE 'LINE%' AND r.subj_type LIKE 'LINE%'",
)
QUERIES["joined_links"] = (joined_links, f"{ALL} SELECT hit_id, partner_id, pair_score FROM links")
QUERIES["joined_chains"] = (
    joined_chains,
    f"""{ALL}, path AS (SELECT hit_id AS root, hit_id FROM hits WHERE hit_id NOT IN (SELECT partner_id FROM links) UNION ALL SELECT p.root, l.partner_id FROM path p JOIN links l ON l.hit_id = p.hit_id)
SELECT hit_id, min(hit_id) OVER (PARTITION BY root) AS chain FROM path""",
)
QUERIES["element_coverage"] = (
    element_coverage,
    f"""{ALL}, n AS (SELECT subj_type, hit_id NOT IN (SELECT partner_id FROM links) AS head, greatest(0, query_end - greatest(query_start - 1,
  coalesce(max(query_end) OVER (PARTITION BY query_name ORDER BY query_start, query_end DESC, hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS new_bp FROM pieces)
SELECT subj_type, count(*) FILTER (head) AS n_hits, CAST(sum(new_bp) AS BIGINT) AS bp FROM n GROUP BY 1""",
)
LEVEL = lambda c, more: f"CAST(format('{{:.2f}}', (CASE WHEN w.div <= x.div THEN (w.qe - w.qs + 1) * w.{c} + (x.qe - x.qs + 1 - q) * x.{c} ELSE (x.qe - x.qs + 1) * x.{c} + (w.qe - w.qs + 1 - q) * w.{c} END + {more}) / greatest(1, w.qe - w.qs + 1 + x.qe - x.qs + 1 - q)) AS DOUBLE)"
MERGED = f"""path AS (SELECT hit_id AS root, hit_id, CAST(1 AS BIGINT) AS k FROM hits WHERE hit_id IN (SELECT hit_id FROM links) AND hit_id NOT IN (SELECT partner_id FROM links) UNION ALL SELECT p.root, l.partner_id, p.k + 1 FROM path p JOIN links l ON l.hit_id = p.hit_id),
x AS (SELECT root, k, path.hit_id, query_start AS qs, query_end AS qe, subj_start AS ss, subj_end AS se, subj_remaining AS rest, subj_name AS name, orientation AS o, stage, score, div, CAST(del_permille AS DOUBLE) / 10 AS del, CAST(ins_permille AS DOUBLE) / 10 AS ins FROM path JOIN pieces p ON p.hit_id = path.hit_id),
w(root, k, hit_id, qs, qe, ss, se, rest, name, o, stage, score, div, del, ins, n, fresh) AS (SELECT root, k, hit_id, qs, qe, ss, se, rest, name, o, stage, score, div, del, ins, 1, true FROM x WHERE k = 1
  UNION ALL SELECT root, k2, CASE WHEN m THEN hit_id ELSE hit2 END, CASE WHEN m THEN least(qs, qs2) ELSE qs2 END, CASE WHEN m THEN greatest(qe, qe2) ELSE qe2 END,
   CASE WHEN NOT m THEN ss2 WHEN far THEN CASE WHEN score < score2 THEN ss2 ELSE ss END ELSE least(ss, ss2) END, CASE WHEN NOT m THEN se2 WHEN far THEN CASE WHEN score < score2 THEN se2 ELSE se END ELSE greatest(se, se2) END,
   CASE WHEN NOT m THEN rest2 WHEN far THEN CASE WHEN score < score2 THEN rest2 ELSE rest END WHEN se < se2 THEN rest2 ELSE rest END, CASE WHEN NOT m OR score < score2 THEN name2 ELSE name END, CASE WHEN m THEN o ELSE o2 END, CASE WHEN m THEN stage ELSE stage2 END,
   CASE WHEN m THEN greatest(score, score2) ELSE score2 END, CASE WHEN m THEN d1 ELSE div2 END, CASE WHEN m THEN d2 ELSE del2 END, CASE WHEN m THEN d3 ELSE ins2 END, CASE WHEN m THEN n + 1 ELSE 1 END, NOT m FROM (
   SELECT *, -q <= 10 AND (qe - qs2 + 1 > 33 OR stage = stage2 AND c >= -100 AND (c <= 20 OR q > 0 AND c - q <= 20) AND d2 <= 50) AS m, greatest(se, se2) - least(ss, ss2) + 1 > 2 * (greatest(qe, qe2) - least(qs, qs2) + 1) AS far FROM (
    SELECT w.*, x.k AS k2, x.hit_id AS hit2, x.qs AS qs2, x.qe AS qe2, x.ss AS ss2, x.se AS se2, x.rest AS rest2, x.name AS name2, x.o AS o2, x.stage AS stage2, x.score AS score2, x.div AS div2, x.del AS del2, x.ins AS ins2, q, c,
     {LEVEL('div', '0')} AS d1, {LEVEL('del', 'CASE WHEN q <= 10 AND c - q <= 0 THEN (q - c) * 100 ELSE 0 END')} AS d2, {LEVEL('ins', 'CASE WHEN q <= 10 AND c - q > 0 THEN (c - q) * 100 ELSE 0 END')} AS d3
    FROM w JOIN x ON x.root = w.root AND x.k = w.k + 1, LATERAL (SELECT least(w.qe, x.qe) - greatest(w.qs, x.qs) + 1 AS q, CASE WHEN w.o = 'C' THEN x.se - w.ss ELSE w.se - x.ss END + 1 AS c)))),
ends AS (SELECT * FROM w QUALIFY coalesce(lead(fresh) OVER (PARTITION BY root ORDER BY k), true))"""
QUERIES["merged_pieces"] = (
    merged_pieces,
    f"""{ALL}, {MERGED} SELECT hit_id, qs AS query_start, qe AS query_end, ss AS subj_start, se AS subj_end, rest AS subj_remaining, name AS subj_name, score, div, del, ins, n AS n_pieces FROM ends
UNION ALL SELECT hit_id, query_start, query_end, subj_start, subj_end, subj_remaining, subj_name, score, div, CAST(del_permille AS DOUBLE) / 10, CAST(ins_permille AS DOUBLE) / 10, 1 FROM pieces WHERE hit_id NOT IN (SELECT hit_id FROM links) AND hit_id NOT IN (SELECT partner_id FROM links)""",
)
