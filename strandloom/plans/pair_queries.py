"""Queries over pairs of neighbouring hits: how well they fit as pieces of one element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from strandloom.functions import scalar as S
from strandloom.operators import pair_scores as P
from strandloom.plans.views import HITS, hits

QUERIES: dict[str, tuple[Callable, str | None]] = {}

#: Families that stand in for each kind of hit, by hit_id % 5.
NAMES = {
    "click": ["AluSx", "AluSx1", "AluY", "MIR3", "MIR3b"],
    "signup": ["MLT1A", "MSTC", "THE1B", "MER21A", "HERVL-int"],
    "purchase": ["MER5A", "MER5B", "Charlie1", "Charlie1a", "Tigger1"],
    "view": ["L1PA2", "L1PA3", "L1M1", "L1M2", "HAL1"],
}
#: Pairs of names and the query bases that they must share.
LINES = [("L1PA2", "L1PA3", 0), ("L1M1", "L1M2", 10), ("L1M2", "L1M1", 0), ("L1PA3", "L1M1", -1), ("HAL1", "L1M2", 50)]


def named(h: DataFrame) -> DataFrame:
    """hits with families of the above names; the first three LTR families are of another class."""
    kind = F.regexp_extract("subj_name", "^[a-z]+", 0)
    name, at = F.col("subj_name"), (F.col("hit_id") % 5 + 1).cast("int")
    for event, families in NAMES.items():
        name = F.when(kind == event, F.element_at(F.array(*map(F.lit, families)), at)).otherwise(name)
    kin = F.when((F.col("subj_type") == "LTR/ERVL") & (F.col("hit_id") % 5 < 3), "LTR/ERVL-MaLR").otherwise(F.col("subj_type"))
    return h.select("*", name.alias("__n"), kin.alias("__t"), (F.col("div_permille") / 10).alias("div"), (F.col("hit_id") % 4 != 0).alias("masked")).drop("subj_name", "subj_type").withColumnsRenamed({"__n": "subj_name", "__t": "subj_type"})


CASES = " ".join(f"WHEN subj_name LIKE '{k}%' THEN {v}[1 + hit_id % 5]" for k, v in NAMES.items())
PAIRS = f"""named AS (SELECT * REPLACE (CASE {CASES} ELSE subj_name END AS subj_name, CASE WHEN subj_type = 'LTR/ERVL' AND hit_id % 5 < 3 THEN 'LTR/ERVL-MaLR' ELSE subj_type END AS subj_type),
  CAST(div_permille AS DOUBLE) / 10 AS div, hit_id % 4 <> 0 AS masked FROM hits),
placed AS (SELECT *, row_number() OVER w AS rn, count(*) FILTER (subj_type LIKE 'LTR%') OVER (w ROWS UNBOUNDED PRECEDING) AS ltrs FROM named
  WINDOW w AS (PARTITION BY query_name ORDER BY query_start, query_end DESC, hit_id)),
pairs AS (SELECT l, r, r.rn - l.rn AS d, r.ltrs - l.ltrs AS ld, least(l.query_end, r.query_end) - greatest(l.query_start, r.query_start) + 1 AS q,
  CASE WHEN l.orientation = 'C' THEN r.subj_end - l.subj_start + 1 ELSE l.subj_end - r.subj_start + 1 END AS c, l.orientation = r.orientation AS strand,
  CAST(2500 AS DOUBLE) * CASE WHEN l.subj_name = r.subj_name THEN CAST(1.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END * (10 - abs(l.div - r.div)) / 10 AS reach
  FROM placed l JOIN placed r ON l.query_name = r.query_name AND r.rn BETWEEN l.rn + 1 AND l.rn + 4)"""
CLOSE = """l.stage = r.stage AND (contains(l.subj_name, r.subj_name) OR contains(r.subj_name, l.subj_name)) AND q >= -10 AND c >= -100 AND (c <= 21 OR q > 0 AND c - q <= 20)"""
TAIL = r"regexp_replace(r.subj_name, '(\S+\d)[a-zA-Z]$', '\1')"
IDS = "l.hit_id AS hit_id, r.hit_id AS partner_id"


def query(sql: str, more: str = ""):
    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(P.pairs(named(hits(spark, sf_dir)))), f"WITH {HITS}, {PAIRS}{', ' + more if more else ''} {sql}")
        return f

    return add


def _of(p: DataFrame, **columns) -> DataFrame:
    return p.select(F.col("l_id").alias("hit_id"), F.col("r_id").alias("partner_id"), *[v.alias(k) for k, v in columns.items()])


@query(f"SELECT {IDS}, CASE WHEN NOT strand THEN 0e0 WHEN {CLOSE} THEN 1e0 WHEN starts_with(l.subj_name, {TAIL}) AND c < 33 AND c > -(reach * (15 - d) / 15) THEN 0.5e0 ELSE 0e0 END AS fit FROM pairs")
def generic_pair_scores(p):
    return _of(p, fit=P.generic_score())


@query(
    f"SELECT {IDS}, CASE WHEN NOT strand THEN 0e0 WHEN {CLOSE} THEN 1e0 WHEN starts_with(l.subj_name, CASE WHEN r.subj_name LIKE 'Alu%' THEN left(r.subj_name, 5) ELSE {TAIL} END) AND c < 33 AND c > -(reach * (15 - d) / 15) THEN 0.5e0 ELSE 0e0 END AS fit,"
    " CASE WHEN strand AND l.subj_name = r.subj_name AND q BETWEEN -1000 AND 21 AND c >= -100 AND (c <= 21 OR q > 0 AND c - q <= 20) THEN CAST(l.score + r.score AS DOUBLE) / d / CASE WHEN r.query_start = l.query_end THEN 1 ELSE r.query_start - l.query_end END ELSE 0e0 END AS refined FROM pairs WHERE l.subj_type LIKE 'SINE%' AND r.subj_type LIKE 'SINE%'"
)
def sine_pair_scores(p):
    return _of(p.where("l_type LIKE 'SINE%' AND r_type LIKE 'SINE%'"), fit=P.sine_score(), refined=P.refined_sine_score())


# of the names above no two share a stem, and of the first three the outer ones don't mix
FIT = "CASE WHEN l.subj_type <> r.subj_type THEN 0e0 WHEN l.subj_name = r.subj_name THEN 1e0 WHEN l.subj_name IN ('MLT1A', 'THE1B') AND r.subj_name IN ('MLT1A', 'THE1B') THEN 0e0 ELSE 0.5e0 END"
LTR = f"""ltr AS (SELECT *, {FIT} AS fit, l.subj_name LIKE '%-int' AS li, r.subj_name LIKE '%-int' AS ri, l.masked AND r.masked AS m, l.subj_name = r.subj_name AS same,
  CASE WHEN l.orientation = '+' THEN least(l.subj_remaining, r.subj_start) ELSE least(l.subj_start, r.subj_remaining) END AS ends_least,
  CASE WHEN l.orientation = '+' THEN greatest(l.subj_remaining, r.subj_start) ELSE greatest(l.subj_start, r.subj_remaining) END AS ends_most
  FROM pairs WHERE l.subj_type LIKE 'LTR%' AND r.subj_type LIKE 'LTR%'),
scored AS (SELECT *, CASE WHEN fit = 0 OR NOT strand THEN 0e0
  WHEN li AND ri AND c <= 111 AND (c >= -1234 OR same AND c >= -5555) THEN 1e0
  WHEN NOT li AND NOT ri AND (l.subj_type = 'LTR/ERVL-MaLR' OR fit = 1) AND m AND c > -(220 - ld * 20) AND c <= 50 AND ends_least >= 10 THEN 1e0
  WHEN li <> ri AND d <= 2 AND q > -350 AND ends_most <= 33 THEN 1e0
  WHEN fit = 1 AND c > -(reach * (10 - d) / 10) AND (li <> ri OR c < 33 AND m) THEN 0.5e0
  WHEN r.query_end > l.query_end AND (fit = 1 AND l.query_end - r.query_start >= 12 OR l.query_end - r.query_start >= 33) THEN 0.25e0 ELSE 0e0 END AS s FROM ltr)"""


@query(f"SELECT {IDS}, fit AS names, CASE WHEN s > 0 THEN s + 1e0 / d ELSE 0e0 END AS fit FROM scored", LTR)
def ltr_pair_scores(p):
    return _of(p.where("l_type LIKE 'LTR%' AND r_type LIKE 'LTR%'"), names=P.ltr_names_fit(), fit=P.ltr_score())


@query(f"SELECT {IDS}, l.orientation = 'C' AND l.subj_start - r.subj_end BETWEEN -74 AND 499 AND l.subj_start - (r.subj_end - r.subj_start + 1 - (l.subj_start - r.subj_end)) > -10 AS fits FROM pairs WHERE strand AND l.subj_type LIKE 'DNA%' AND r.subj_type LIKE 'DNA%'")
def transposon_pairs(p):
    return _of(p.where("l_orientation = r_orientation AND l_type LIKE 'DNA%' AND r_type LIKE 'DNA%'"), fits=P.transposons_fit())


@query(f"SELECT {IDS}, strand AND l.subj_name = r.subj_name AND abs(CASE WHEN l.orientation = 'C' THEN l.subj_start - r.subj_end ELSE r.subj_start - l.subj_end END - r.query_start + l.query_end) < 7000 AS fits FROM pairs")
def congruous_pairs(p):
    return _of(p, fits=P.congruous())


THRESHOLDS = ", ".join(str(t) for t in LINES)


@query(f"""SELECT {IDS}, l.subj_name = r.subj_name OR coalesce(CASE WHEN a.t IS NOT NULL THEN a.t = 0 OR a.t > 0 AND q > a.t ELSE b.t = 0 OR b.t > 0 AND q > b.t END, false) AS fits
  FROM pairs LEFT JOIN allowed a ON a.x = l.subj_name AND a.y = r.subj_name LEFT JOIN allowed b ON b.y = l.subj_name AND b.x = r.subj_name WHERE l.subj_type LIKE 'LINE%' AND r.subj_type LIKE 'LINE%'""", f"allowed(x, y, t) AS (VALUES {THRESHOLDS})")
def line_name_pairs(p):
    allowed = p.sparkSession.createDataFrame(LINES, "name_a string, name_b string, threshold long")
    return _of(P.line_names_fit(p.where("l_type LIKE 'LINE%' AND r_type LIKE 'LINE%'"), allowed), fits=F.col("names_fit"))


def tandem_retention(spark, sf_dir):
    """Tandem repeats kept by copies and score, young and old, with whole bits; scores, copies and periods are derived."""
    copies, score, period = 2 + F.col("hit_id") % 9 / 2, F.col("score") % 60, 1 + F.col("hit_id") % 7
    cols = {f"{k}_{name}": v for name, young in (("young", True), ("old", False)) for k, v in {"kept": S.tandem_kept(copies, score, young), "bits": S.tandem_bits(score, period, young)}.items()}
    return hits(spark, sf_dir).select("hit_id", *[v.alias(k) for k, v in cols.items()])


def _bits(mu: tuple, lam: float) -> str:
    return f"CAST(trunc(((score % 60) * CAST({lam} AS DOUBLE) - ln(CAST({list(mu)} AS DOUBLE[])[1 + hit_id % 7])) / ln(2.0)) AS BIGINT)"


QUERIES["tandem_retention"] = (
    tandem_retention,
    f"WITH {HITS} SELECT hit_id, hit_id % 9 > 4 AND score % 60 >= 20 AS kept_young, {_bits(S.YOUNG_TANDEM[1], S.YOUNG_TANDEM[0])} AS bits_young, hit_id % 9 > 6 AND score % 60 >= 20 AS kept_old, {_bits(S.OLD_TANDEM[1], S.OLD_TANDEM[0])} AS bits_old FROM hits",
)
