"""Queries over the rules of search classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.operators import rule_filters as R
from strandloom.plans.views import HITS, hits

QUERIES: dict[str, tuple[Callable, str | None]] = {}

#: Families that stand in for each kind's, as name#class.
FAMILIES = {
    "cut2": ["L1PA2_3end#LINE/L1", "L1P_orf2#LINE/L1", "L1Md_3end#LINE/L1", "L1M4_orf2#LINE/L1", "L1PA2_3end#LINE/L1"],
    "mirs": ["MIR#SINE/MIR", "L2a#LINE/L2", "L3#LINE/CR1", "MIRb#SINE/MIR", "MER91A#DNA/hAT"],
    "sines": ["B1_Mm#SINE/Alu", "B4A#SINE/B4", "RSINE1#SINE/B4", "MLT2B1#LTR/ERVL", "Ricksha#DNA/MULE", "MER3#DNA/hAT", "MER33#DNA/hAT", "ORR1A1-int#LTR/ERVL-MaLR", "RatSatRep1#Satellite", "RMER17A#LTR/ERVK"],
    "longlib": ["L1MC3_3end#LINE/L1", "L1_Mur2#LINE/L1", "Lx9#LINE/L1", "L1_Mur3#LINE/L1", "L1MC4_3end#LINE/L1"],
    "l1": ["HAL1#LINE/L1", "L1M4_orf2#LINE/L1", "L1MC4_5end#LINE/L1", "L1MC4_3end#LINE/L1", "HAL1b#LINE/L1"],
    "simple": ["(CA)n#Simple_repeat", "(GAAA)n#Simple_repeat", "(A)n#Simple_repeat", "(TTAGGG)n#Simple_repeat", "SAT1#Satellite"],
    "alu": ["AluY#SINE/Alu", "AluSx#SINE/Alu", "FLAM_A#SINE/Alu", "AluJb#SINE/Alu", "AluSx1#SINE/Alu"],
    "cut1": ["MER5A#DNA/hAT", "MIR3#SINE/MIR", "L1PA2#LINE/L1", "BC1#SINE/ID", "U6#snRNA"],
    "alumask": ["AluY#SINE/Alu", "AluSx#SINE/Alu", "AluJb#SINE/Alu", "AluJo#SINE/Alu", "FAM#SINE/Alu"],
    "other": ["PRIMA4-int#LTR/ERV1", "LTR39-int#LTR/ERV1", "LTR38-int#LTR/ERV1", "MLT2#buffer", "Tigger1#DNA/TcMar"],
}
WIDTH = 10


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits dealt to the kinds of search, with families of theirs, near one another."""
    name = F.element_at(F.array(*[F.array(*[F.lit(x) for x in (v * 2)[:WIDTH]]) for v in FAMILIES.values()]), (F.col("hit_id") % 10 + 1).cast("int"))
    whole = F.element_at(name, (F.floor(F.col("hit_id") / 10) % WIDTH + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("hit_id") % 10 + 1).cast("int"))
    start = 1 + F.floor(F.col("query_start") / 20)
    size = F.floor((F.col("query_end") - F.col("query_start")) / 2)
    shift = F.when(F.col("kind").isin("longlib", "l1"), 850).when(F.col("kind") == "other", 470).when(F.col("kind") == "cut2", 90).otherwise(0)
    h = hits(spark, sf_dir).withColumns({"kind": kind, "__w": whole, "query_start": start, "__size": size})
    whole_ = F.col("kind") == "cut1"
    return h.withColumns({
        "subj_name": F.substring_index("__w", "#", 1), "subj_type": F.substring_index("__w", "#", -1), "query_end": F.col("query_start") + F.col("__size"),
        "subj_start": F.when(whole_, F.col("hit_id") % 8 + 1).otherwise(F.col("subj_start") + shift), "subj_end": F.col("subj_end") + shift,
        "subj_remaining": F.when(whole_ | (F.col("kind") == "cut2"), F.col("hit_id") % 25).otherwise(F.col("subj_remaining")), "query_remaining": 1200 - (F.col("query_start") + F.col("__size")),
        "div": F.col("div_permille") / 10, "del": F.col("del_permille") / 10, "ins": F.col("ins_permille") / 10, "overlap": F.when(F.col("hit_id") % 3 == 0, "*"),
    }).drop("__w", "__size")


def rule_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit with the rule by which it goes, or null, and where it starts then."""
    h = ruled(spark, sf_dir).where("kind <> 'cut2'")
    return R.class_filtered(h, clade="rodents", most_div=34.0).select("hit_id", "rule", "query_start")


def line_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends and bodies of LINEs that are cut out: those that go, by rule, and those that take over a body."""
    h = ruled(spark, sf_dir)
    return R.class_filtered(h.withColumn("subj_name", F.element_at(F.array(*[F.lit(x.split("#")[0]) for x in FAMILIES["cut2"]]), (F.col("hit_id") % 5 + 1).cast("int"))).withColumns({"kind": F.lit("cut2"), "div": F.col("div") / 3, "del": F.col("del") / 4, "ins": F.col("ins") / 4}), clade="primates")


LIST = ", ".join("[" + ", ".join(f"'{x}'" for x in (v * 2)[:WIDTH]) + "]" for v in FAMILIES.values())
RULED = f"""w AS (SELECT *, [{', '.join(f"'{k}'" for k in FAMILIES)}][1 + hit_id % 10] AS kind, [{LIST}][1 + hit_id % 10][1 + (hit_id // 10) % {WIDTH}] AS whole FROM hits),
v AS (SELECT hit_id, query_name, orientation, score, kind, whole, split_part(whole, '#', 1) AS name, split_part(whole, '#', 2) AS type, 1 + query_start // 20 AS qs, 1 + query_start // 20 + (query_end - query_start) // 2 AS qe,
  CASE kind WHEN 'longlib' THEN 850 WHEN 'l1' THEN 850 WHEN 'other' THEN 470 WHEN 'cut2' THEN 90 ELSE 0 END AS shift, CASE WHEN kind = 'cut1' THEN hit_id % 8 + 1 ELSE subj_start + shift END AS b, subj_end + shift AS e,
  CASE WHEN kind IN ('cut1', 'cut2') THEN hit_id % 25 ELSE subj_remaining END AS rest, CAST(div_permille AS DOUBLE) / 10 * 100 / (100 - CAST(ins_permille AS DOUBLE) / 10) AS div,
  CAST(del_permille AS DOUBLE) / 10 + CAST(ins_permille AS DOUBLE) / 10 AS gaps, hit_id % 3 = 0 AS star, kind || query_name AS k FROM w WHERE kind <> 'cut2'),
r AS (SELECT *, row_number() OVER o AS rn, lag({{'name': name, 'type': type, 'qs': qs, 'qe': qe, 'score': score, 'b': b}}) OVER o AS p, lead({{'name': name, 'qs': qs, 'qe': qe, 'score': score}}) OVER o AS n FROM v WINDOW o AS (PARTITION BY k ORDER BY qs, qe DESC, score DESC, hit_id))"""


def _any(rules) -> str:
    return "(" + " OR ".join(f"regexp_matches(name, '{p}') AND b > {x} AND e < {y}" + ("" if s is None else f" AND score < {s}") for p, x, y, s in rules) + ")"


OLD = "regexp_matches(name, '(?i)^(L2a|L2b|L3|MIR)') AND p.qe > qs + 33 AND p.type <> type"
WORSE = "(qe - p.qe <= 30 AND (p.score >= 1.05 * score OR qe - p.qe < qs - p.qs AND p.score >= 0.83 * score))"
ENTROPY = """CASE WHEN whole LIKE '(%' THEN (SELECT 16 - 3 * (len(u) - len(u) * coalesce(sum(-f * ln(f)), 0) / ln(4)) FROM (SELECT u, CAST(len(u) - len(replace(u, x, '')) AS DOUBLE) / len(u) AS f FROM (SELECT regexp_extract(whole, '[A-Z]+') AS u), (VALUES ('A'), ('C'), ('G'), ('T')) z(x)) WHERE f > 0 GROUP BY u) ELSE 16 END"""
DECIDED = rf"""d AS (SELECT *,
  CASE WHEN type LIKE 'buffer%' THEN 1 WHEN div > 34 THEN 2 END AS skip,
  CASE kind WHEN 'mirs' THEN CASE WHEN NOT coalesce({OLD}, false) AND name LIKE '%MER91%' AND score < 200 THEN 12 END
   WHEN 'sines' THEN CASE WHEN name LIKE 'MLT2B%' AND n.name LIKE 'Ricksha%' AND qe > n.qs + 50 AND score < n.score THEN 13 WHEN name = 'MER3' AND b > 30 AND e < 125 AND n.name = 'MER33' AND orientation = '+' AND n.qs - qs < 20 THEN 14 END
   WHEN 'longlib' THEN CASE WHEN {_any(R.LONG)} THEN 21 END WHEN 'l1' THEN CASE WHEN score < 425 AND {_any(R.L1)} THEN 21 END
   WHEN 'simple' THEN CASE WHEN contains(whole, 'AAAAA') OR contains(whole, '(A)n') OR contains(whole, 'Satellite') THEN 23
     WHEN NOT (NOT regexp_matches(whole, '\([GA]*\)') AND div + gaps / 1.5 <= {ENTROPY} OR div + gaps < (score - 200) / 50e0 OR div + gaps <= 5) THEN 22 END
   WHEN 'alu' THEN CASE WHEN NOT (name LIKE 'Alu%' AND b < 70 AND e > 185 OR b < 6 AND rest < 5) THEN 24 END
   WHEN 'cut1' THEN CASE WHEN NOT (b < 6 AND rest < 5 AND whole NOT LIKE '%LINE%' OR whole LIKE '%SINE%' AND b < 6 AND rest < 20) THEN 26 WHEN regexp_matches(whole, '^BC[12]\S+SINE') THEN 25 END
   WHEN 'other' THEN CASE WHEN {_any(R.OTHER)} THEN 21 END END AS own,
  CASE kind WHEN 'mirs' THEN CASE WHEN {OLD} AND {WORSE} THEN 10 END
   WHEN 'sines' THEN CASE WHEN name LIKE 'MLT2B%' AND p.name LIKE 'Ricksha%' AND qs < p.qe - 50 AND score < p.score THEN 13 WHEN name = 'MER3' AND b > 30 AND e < 125 AND p.name = 'MER33' AND orientation = 'C' AND qe - p.qe < 20 THEN 14 END END AS given,
  CASE kind WHEN 'mirs' THEN CASE WHEN {OLD} AND NOT {WORSE} AND qs - p.qs <= 30 AND (score >= 1.05 * p.score OR qe - p.qe > qs - p.qs AND score >= 0.83 * p.score) THEN 11 END
   WHEN 'sines' THEN CASE WHEN name LIKE 'B1%' AND p.name LIKE 'B4%' AND qs < p.qe - 50 AND score > 1.5 * p.score AND p.b >= 80 THEN 15 END END AS other,
  CASE WHEN kind = 'sines' THEN CASE WHEN name LIKE 'B4%' AND n.name LIKE 'B1%' AND n.qs < qe - 50 AND n.score > 1.5 * score AND b >= 80 THEN 16
   WHEN whole LIKE '%SINE%' AND b <= 100 THEN CASE WHEN name = 'RSINE1' AND b > 50 AND score < 225 THEN 17 END
   WHEN regexp_matches(name, '^ORR1.*-int') AND star THEN CASE WHEN {_any(R.RODENT_INSIDE)} THEN 18 END
   WHEN name = 'RatSatRep1' AND b > 1150 AND e < 1750 AND div > 16 THEN 19 WHEN score < 225 THEN 20 WHEN score <= 350 AND {_any(R.RODENT)} THEN 21 END END AS instead,
  kind = 'alu' OR kind = 'simple' AND NOT (contains(whole, 'AAAAA') OR contains(whole, '(A)n') OR contains(whole, 'Satellite'))
   OR kind = 'cut1' AND (b < 6 AND rest < 5 AND whole NOT LIKE '%LINE%' OR whole LIKE '%SINE%' AND b < 6 AND rest < 20) AS moves FROM r)"""
WALK = """walk(k, rn, hit_id, rule, before_id, before_rule, start, gone, before_end, stayed) AS (
  SELECT k, CAST(0 AS BIGINT), NULL::BIGINT, NULL::INTEGER, NULL::BIGINT, NULL::INTEGER, NULL::BIGINT, true, NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT k FROM d)
  UNION ALL SELECT k, rn, hit_id, coalesce(rule, CASE WHEN late THEN 28 END), CASE WHEN taken IS NOT NULL THEN last_id END, taken, start, CASE WHEN skip IS NOT NULL THEN true ELSE goes OR late END,
   CASE WHEN skip IS NULL THEN qe END, CASE WHEN skip IS NOT NULL OR goes OR late THEN stayed ELSE qe END FROM (
   SELECT *, skip IS NULL AND NOT goes AND kind IN ('simple', 'alu', 'cut1', 'alumask') AND coalesce(stayed >= qe, false) AS late FROM (
    SELECT *, rule IS NOT NULL AND taken IS NULL AS goes FROM (
     SELECT d.k, d.rn, d.hit_id, d.kind, d.qe, d.skip, w.hit_id AS last_id, w.stayed, CASE WHEN d.skip IS NULL AND NOT w.gone THEN d.other END AS taken,
      CASE WHEN d.skip IS NOT NULL THEN d.skip WHEN d.own IS NOT NULL THEN d.own WHEN NOT w.gone AND d.given IS NOT NULL THEN d.given WHEN w.gone OR d.other IS NULL THEN d.instead END AS rule,
      CASE WHEN d.skip IS NULL AND NOT w.gone AND d.moves AND w.before_end >= d.qs THEN w.before_end + 1 ELSE d.qs END AS start FROM walk w JOIN d ON d.k = w.k AND d.rn = w.rn + 1))))"""
QUERIES["rule_filters"] = (
    rule_filters,
    f"""WITH RECURSIVE {HITS}, {RULED}, {DECIDED}, {WALK}
SELECT w.hit_id AS hit_id, least(w.rule, b.before_rule) AS rule, w.start AS query_start FROM walk w LEFT JOIN walk b ON b.before_id = w.hit_id WHERE w.hit_id IS NOT NULL""",
)
QUERIES["line_bodies"] = (line_bodies, None)
