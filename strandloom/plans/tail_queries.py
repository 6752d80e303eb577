"""Queries over poly-A tails: simple repeats named as tails, SINEs and LINEs near their ends, some linked to the next but one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.operators import folds, tails
from strandloom.plans.views import HITS, hits

QUERIES: dict[str, tuple[Callable, str | None]] = {}

TAILS = ["(A)n", "(T)n", "(CAAA)n", "A-rich", "(TTTTG)n", "T-rich", "(CA)n"]
ELEMENTS = ["AluY", "FLAM_A", "FRAM", "L1PA3", "SVA", "MIR3"]
NAME = "CASE WHEN subj_type = 'Simple_repeat' THEN {tails} WHEN subj_type LIKE '%INE/%' THEN {elements} ELSE subj_name END"
SQL_NAME = NAME.format(tails=f"{TAILS}[1 + hit_id % 7]", elements=f"{ELEMENTS}[1 + hit_id % 6]")


def tailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("hit_id") % n + 1).cast("int"))
    # eight times as dense, so that tails lie beside and in elements
    h = hits(spark, sf_dir).withColumns({"query_start": F.floor(F.col("query_start") / 8) + 1, "query_end": F.floor(F.col("query_start") / 8) + 1 + F.col("query_end") - F.col("query_start")})
    tail = F.col("subj_type") == "Simple_repeat"
    named = F.when(tail, names(TAILS, 7)).when(F.col("subj_type").like("%INE/%"), names(ELEMENTS, 6)).otherwise(F.col("subj_name"))
    h = h.withColumns({
        "subj_name": named, "query_end": F.when(tail, F.col("query_start") + 10 + F.col("hit_id") % 45).otherwise(F.col("query_end")), "subj_remaining": F.col("hit_id") % 41,
        "subj_end": F.col("subj_start") + 10 + F.col("hit_id") % 50, "score": 500 + F.col("hit_id") % 2,
    })
    placed = folds.numbered_rows(h)
    ids = placed.select(F.col("query_name").alias("__q"), F.col("rank").alias("__r"), F.col("hit_id").alias("__i"))
    here = lambda n: (F.col("query_name") == F.col("__q")) & (F.col("rank") + n == F.col("__r"))
    # every hit of a third of all is linked to the next but one
    right = placed.join(ids, here(2), "left").withColumn("right_id", F.when(F.col("hit_id") % 3 == 0, F.col("__i"))).drop("__q", "__r", "__i")
    return right.join(ids, here(-2), "left").withColumn("left_id", F.when(F.col("__i") % 3 == 0, F.col("__i"))).drop("__q", "__r", "__i", "rank")


def tail_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tails with the element that each ends."""
    return tails.attachments(tailed(spark, sf_dir)).drop("rank")


def tailed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits left when tails are part of their elements."""
    return tails.with_tails(tailed(spark, sf_dir)).select("hit_id", "subj_name", "query_start", "query_end", "subj_end", "subj_remaining", "n_tails")


ENDS = "{x}.rest <= CASE WHEN regexp_matches({x}.e, '^(Alu|FLAM)') THEN 32 WHEN regexp_matches({x}.e, '{others}') THEN 25 ELSE -1 END AND t.qe - t.qs < {x}.rest + 30"
PART_FORE = "coalesce(c.b.rid = c.n.id AND c.n.score = c.b.score AND c.n.qs - t.qe < 5 AND c.n.se - c.n.ss < 40, false)"
PART_BACK = "coalesce(c.n.lid = c.b.id AND c.b.score = c.n.score AND c.b.qe - t.qs < 5 AND c.b.se - c.b.ss < 40, false)"
FORWARD = f"a AND c.b.o <> 'C' AND t.qs - c.b.qe < 4 AND {ENDS.format(x='c.b', others='^(FR?AM$|L1|SVA$)')}"
TURNED = f"tt AND c.n.o = 'C' AND c.n.qs - t.qe < 4 AND {ENDS.format(x='c.n', others='^(FR?AM$|L1)')}"
KIND = "STRUCT(id BIGINT, qs BIGINT, qe BIGINT, score BIGINT, o VARCHAR, e VARCHAR, ss BIGINT, se BIGINT, rest BIGINT, lid BIGINT, rid BIGINT)"
#: What the k-th hits x before and after a tail t say: 1 ends the one before, 2 with its cut piece, 3 and 4 the one after, 9 ends the search.
WALK = f"""dense AS (SELECT * REPLACE (query_start // 8 + 1 AS query_start, query_start // 8 + 1 + query_end - query_start AS query_end) FROM hits),
base AS (SELECT * REPLACE ({SQL_NAME} AS subj_name, CASE WHEN subj_type = 'Simple_repeat' THEN query_start + 10 + hit_id % 45 ELSE query_end END AS query_end,
   hit_id % 41 AS subj_remaining, subj_start + 10 + hit_id % 50 AS subj_end, 500 + hit_id % 2 AS score) FROM dense),
linked AS (SELECT *, CASE WHEN hit_id % 3 = 0 THEN lead(hit_id, 2) OVER w END AS right_id, CASE WHEN lag(hit_id, 2) OVER w % 3 = 0 THEN lag(hit_id, 2) OVER w END AS left_id, row_number() OVER w AS rn
  FROM base WINDOW w AS (PARTITION BY query_name ORDER BY query_start, query_end DESC, score DESC, hit_id)),
packed AS (SELECT query_name, rn, CAST({{'id': hit_id, 'qs': query_start, 'qe': query_end, 'score': score, 'o': orientation, 'e': subj_name, 'ss': subj_start, 'se': subj_end, 'rest': subj_remaining, 'lid': left_id, 'rid': right_id}} AS {KIND}) AS t FROM linked),
rows AS (SELECT query_name, rn, t, list(t) OVER (PARTITION BY query_name ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS ahead FROM packed),
walk AS (SELECT DISTINCT query_name, CAST(0 AS BIGINT) AS rn, CAST([] AS {KIND}[]) AS last, CAST([] AS BIGINT[]) AS gone, NULL::STRUCT(tail_id BIGINT, hit_id BIGINT, piece_id BIGINT, query_start BIGINT, query_end BIGINT) AS made FROM rows
  UNION ALL SELECT query_name, rn, CASE WHEN skip THEN last WHEN p IS NULL THEN list_append(last, t)[-4:] ELSE list_append(list_filter(last, lambda z: z.id <> p.x.id AND (NOT p.cut OR z.id <> p.y.id)),
     {{'id': p.x.id, 'qs': lo, 'qe': hi, 'score': p.x.score, 'o': p.x.o, 'e': p.x.e, 'ss': p.x.ss, 'se': p.x.se + p.x.rest, 'rest': CAST(0 AS BIGINT), 'lid': CASE WHEN p.cut AND NOT p.fore THEN p.y.lid ELSE p.x.lid END, 'rid': CASE WHEN p.cut AND p.fore THEN p.y.rid ELSE p.x.rid END}})[-4:] END,
    CASE WHEN p IS NULL THEN gone ELSE list_concat(gone, [p.x.id, CASE WHEN p.cut THEN p.y.id END]) END, CASE WHEN p IS NOT NULL THEN {{'tail_id': t.id, 'hit_id': p.x.id, 'piece_id': CASE WHEN p.cut THEN p.y.id END, 'query_start': lo, 'query_end': hi}} END
   FROM (SELECT *, CASE WHEN p.fore THEN p.x.qs WHEN p.cut THEN p.y.qs ELSE t.qs END AS lo, CASE WHEN NOT p.fore THEN p.x.qe WHEN p.cut THEN p.y.qe ELSE greatest(p.x.qe, t.qe) END AS hi
    FROM (SELECT *, CASE WHEN best.code < 9 THEN {{'x': best.x, 'y': best.y, 'cut': best.code % 2 = 0, 'fore': best.fore}} END AS p FROM (SELECT *, list_filter(list_transform(sides, lambda c: {{'x': CASE WHEN c.fore THEN c.b ELSE c.n END, 'y': CASE WHEN c.fore THEN c.n ELSE c.b END, 'fore': c.fore,
       'code': CASE WHEN c.fore THEN CASE WHEN c.b.rid IS NULL THEN 1 WHEN {PART_FORE} THEN 2 ELSE 9 END WHEN c.back THEN CASE WHEN c.n.lid IS NULL THEN 3 WHEN {PART_BACK} THEN 4 ELSE 0 END ELSE 0 END}}), lambda c: c.code > 0)[1] AS best
     FROM (SELECT *, CASE WHEN skip OR NOT (a OR tt) THEN [] ELSE list_transform(pairs, lambda c: {{'b': c.b, 'n': c.n, 'fore': coalesce({FORWARD}, false), 'back': coalesce({TURNED}, false)}}) END AS sides
     FROM (SELECT *, list_transform([1, 2, 3, 4], lambda k: {{'b': list_reverse(last)[k], 'n': near[k]}}) AS pairs
     FROM (SELECT w.query_name, r.rn, w.last, w.gone, r.t, list_contains(w.gone, r.t.id) AS skip, regexp_matches(r.t.e, '^(\\(A\\)n$|\\(.A{{3,6}}\\)|A-rich)') AS a, regexp_matches(r.t.e, '^(\\(T\\)n$|\\(T{{3,6}}.\\)|T-rich)') AS tt,
       list_filter(r.ahead, lambda z: NOT list_contains(w.gone, z.id)) AS near FROM walk w JOIN rows r ON r.query_name = w.query_name AND r.rn = w.rn + 1))))))),
made AS (SELECT rn, made.tail_id AS tail_id, made.hit_id AS hit_id, made.piece_id AS piece_id, made.query_start AS query_start, made.query_end AS query_end FROM walk WHERE made IS NOT NULL)"""

QUERIES["tail_attachments"] = (tail_attachments, f"WITH RECURSIVE {HITS}, {WALK} SELECT * EXCLUDE (rn) FROM made")
QUERIES["tailed_elements"] = (
    tailed_elements,
    f"""WITH RECURSIVE {HITS}, {WALK}, g AS (SELECT hit_id, max_by(query_start, rn) AS lo, max_by(query_end, rn) AS hi, count(*) AS n FROM made GROUP BY 1)
SELECT b.hit_id, subj_name, coalesce(lo, query_start) AS query_start, coalesce(hi, query_end) AS query_end, CASE WHEN n IS NULL THEN subj_end ELSE subj_end + subj_remaining END AS subj_end, CASE WHEN n IS NULL THEN subj_remaining ELSE 0 END AS subj_remaining, coalesce(n, 0) AS n_tails
FROM base b LEFT JOIN g ON g.hit_id = b.hit_id WHERE b.hit_id NOT IN (SELECT tail_id FROM made) AND b.hit_id NOT IN (SELECT piece_id FROM made WHERE piece_id IS NOT NULL)""",
)
