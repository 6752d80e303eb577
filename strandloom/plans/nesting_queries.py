"""Queries over nested elements, crossing links and cut sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandloom.operators import excision, folds, interval, nesting
from strandloom.plans.views import HITS, hits

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def long_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of which every third is four times as long, so that many lie inside others."""
    wide = F.when(F.col("hit_id") % 3 == 0, 4).otherwise(1)
    return hits(spark, sf_dir).withColumn("query_end", F.col("query_start") + (F.col("query_end") - F.col("query_start")) * wide)


def split_at_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits split where others were inserted."""
    return nesting.split_at_inserts(long_hits(spark, sf_dir))


def untangled_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from each hit to the next of its family, without those that cross."""
    placed = folds.numbered_rows(hits(spark, sf_dir))
    along = Window.partitionBy("query_name", "subj_name").orderBy("rank")
    links = placed.select("query_name", F.col("rank").alias("i"), F.lead("rank").over(along).alias("j"), "hit_id", F.lead("hit_id").over(along).alias("partner_id")).where("j is not null")
    return nesting.untangled(links).select("hit_id", "partner_id")


def cut_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return excision.ledger(interval.truncated(hits(spark, sf_dir).where("subj_type = 'Simple_repeat'")))


def excision_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple repeats as cut ranges, with the places of the letters left."""
    return cut_ranges(spark, sf_dir)


def cut_and_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All other hits on the cut sequence, and their ends lifted back."""
    cuts = cut_ranges(spark, sf_dir)
    there = excision.to_cut(hits(spark, sf_dir).where("subj_type <> 'Simple_repeat'").select("query_name", "hit_id", "query_start", "query_end"), cuts)
    back = excision.lifted(there.select("query_name", "hit_id", F.col("cut_start").alias("query_start"), F.col("cut_end").alias("query_end")), cuts)
    return back.select("hit_id", F.col("query_start").alias("cut_start"), F.col("query_end").alias("cut_end"), "full_start", "full_end")


def lifted_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits found on the cut sequence, lifted to the whole one and split at what was cut out of them."""
    cuts = cut_ranges(spark, sf_dir)
    found = excision.lifted(hits(spark, sf_dir).where("subj_type <> 'Simple_repeat'").select("query_name", "hit_id", "query_start", "query_end"), cuts)
    return excision.fragments(found, cuts).select("hit_id", "full_start", "full_end", "fragment", "frag_start", "frag_end")


LONG = f"""{HITS}, o AS (SELECT * REPLACE (query_start + (query_end - query_start) * CASE WHEN hit_id % 3 = 0 THEN 4 ELSE 1 END AS query_end) FROM hits),
r AS (SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY query_start, query_end DESC, score DESC, hit_id) AS rn FROM o)"""
QUERIES["split_at_inserts"] = (
    split_at_inserts,
    f"""WITH RECURSIVE {LONG},
c AS (SELECT p.hit_id AS pid, n.rn - p.rn AS j, n.query_start AS s, n.query_end AS e, contains(n.subj_name, p.subj_name) AND n.stage = p.stage AS kin FROM r p JOIN r n ON n.query_name = p.query_name AND n.rn > p.rn AND n.query_start <= p.query_end AND n.query_end <= p.query_end
  WHERE NOT EXISTS (SELECT 1 FROM r m WHERE m.query_name = p.query_name AND m.rn > p.rn AND m.rn < n.rn AND m.query_end > p.query_end)),
w(pid, j, qs, qe, ss, se, plus, b, ins) AS (SELECT hit_id, CAST(0 AS BIGINT), query_start, query_end, subj_start, subj_end, orientation <> 'C', NULL::BIGINT, CAST([] AS BIGINT[]) FROM r
  UNION ALL SELECT pid, j, CASE WHEN act = 'head' THEN e + 1 ELSE qs END, CASE WHEN act = 'tail' THEN s - 1 ELSE qe END,
    ss + CASE WHEN act = 'head' AND plus THEN s - qs WHEN act = 'tail' AND NOT plus THEN qe - e ELSE 0 END, se - CASE WHEN act = 'head' AND NOT plus THEN s - qs WHEN act = 'tail' AND plus THEN qe - e ELSE 0 END, plus,
    CASE WHEN act IN ('tail', 'near', 'new') THEN e ELSE b END, CASE act WHEN 'tail' THEN list_filter(ins, lambda x, k: ins[k + k % 2] <= s - 1) WHEN 'near' THEN list_append(ins[:-2], e) WHEN 'new' THEN ins || [s, e] ELSE ins END
   FROM (SELECT c.pid, c.j, c.s, c.e, w.qs, w.qe, w.ss, w.se, w.plus, w.b, w.ins, CASE WHEN c.kin OR c.s < w.qs THEN 'skip' WHEN c.j = 1 AND c.s <= w.qs + 5 THEN 'head' WHEN c.e >= w.qe - 5 THEN 'tail'
     WHEN c.e < w.b THEN 'skip' WHEN c.s < w.b + 5 AND len(w.ins) > 0 THEN 'near' ELSE 'new' END AS act FROM w JOIN c ON c.pid = w.pid AND c.j = w.j + 1 WHERE c.e <= w.qe)),
f AS (SELECT w.*, r.subj_start AS s0, r.subj_end AS e0, r.subj_remaining AS rest, [w.qs] || list_transform(ins, lambda x, k: CASE WHEN k % 2 = 1 THEN x - 1 ELSE x + 1 END) || [w.qe] AS edges,
  coalesce((se - ss + 1) / nullif(CAST(qe - qs + 1 - coalesce(list_sum(list_transform(range(1, len(ins), 2), lambda k: ins[k + 1] - least(ins[k], qe))), 0) AS DOUBLE), 0), 0) AS rate FROM w JOIN r ON r.hit_id = w.pid QUALIFY row_number() OVER (PARTITION BY w.pid ORDER BY w.j DESC) = 1),
p AS (SELECT *, unnest(range(1, len(edges), 2)) AS k FROM f), q AS (SELECT *, edges[k] AS a, edges[k + 1] AS z, k = len(edges) - 1 AS final, CAST(trunc((edges[k + 1] - edges[k]) * rate) AS BIGINT) AS size FROM p),
t AS (SELECT *, coalesce(sum(size + 1) OVER (PARTITION BY pid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, len(ins) = 0 AS whole FROM q)
SELECT pid AS hit_id, a AS query_start, z AS query_end, CAST(CASE WHEN whole THEN ss WHEN plus THEN s0 + done WHEN final THEN ss ELSE e0 - done - size END AS BIGINT) AS subj_start,
 CAST(CASE WHEN whole THEN se WHEN NOT plus THEN e0 - done WHEN final THEN se ELSE s0 + done + size END AS BIGINT) AS subj_end,
 CAST(CASE WHEN whole OR final THEN rest WHEN plus THEN se + rest - (s0 + done + size) ELSE se + rest - (e0 - done) END AS BIGINT) AS subj_remaining, CAST((k + 1) // 2 AS INTEGER) AS piece FROM t""",
)
QUERIES["untangled_links"] = (
    untangled_links,
    f"""WITH RECURSIVE {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY query_start, query_end DESC, score DESC, hit_id) AS rn FROM hits),
l AS (SELECT query_name, rn AS i, lead(rn) OVER w AS j, hit_id, lead(hit_id) OVER w AS partner_id FROM r WINDOW w AS (PARTITION BY query_name, subj_name ORDER BY rn)), m AS (SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY i) AS k FROM l WHERE j IS NOT NULL),
w(query_name, k, hit_id, partner_id, kept, ends) AS (SELECT DISTINCT query_name, CAST(0 AS BIGINT), NULL::BIGINT, NULL::BIGINT, false, CAST([] AS BIGINT[]) FROM m
  UNION ALL SELECT query_name, k, hit_id, partner_id, ok, CASE WHEN ok THEN list_append(ends, j) ELSE ends END FROM (SELECT m.*, w.ends, len(list_filter(w.ends, lambda x: x > m.i AND x < m.j)) = 0 AS ok FROM w JOIN m ON m.query_name = w.query_name AND m.k = w.k + 1))
SELECT hit_id, partner_id FROM w WHERE kept""",
)
CUTS = f"""{HITS}, s AS (SELECT query_name, query_start, query_end, coalesce(max(query_end) OVER (PARTITION BY query_name ORDER BY query_start, query_end DESC, hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM hits WHERE subj_type = 'Simple_repeat'),
cuts AS (SELECT query_name, greatest(query_start, b + 1) AS cut_from, query_end AS cut_to FROM s WHERE query_end > b),
ledger AS (SELECT *, CAST(sum(cut_to - cut_from) OVER (PARTITION BY query_name ORDER BY cut_from) AS BIGINT) AS removed, CAST(cut_to - sum(cut_to - cut_from) OVER (PARTITION BY query_name ORDER BY cut_from) AS BIGINT) AS letter_at FROM cuts),
h AS (SELECT * FROM hits WHERE subj_type <> 'Simple_repeat')"""
there = lambda x: f"(SELECT coalesce(max(CASE WHEN {x} <= cut_to THEN letter_at END), {x} - coalesce(max(removed), 0)) FROM (SELECT * FROM ledger l WHERE l.query_name = h.query_name AND cut_from <= {x} ORDER BY cut_from DESC LIMIT 1))"
back = lambda x: f"{x} + (SELECT CAST(coalesce(sum(cut_to - cut_from), 0) AS BIGINT) FROM ledger l WHERE l.query_name = h.query_name AND letter_at <= {x})"
QUERIES["excision_ledger"] = (excision_ledger, f"WITH {CUTS} SELECT * FROM ledger")
QUERIES["cut_and_restored"] = (
    cut_and_restored,
    f"""WITH {CUTS}, t AS (SELECT query_name, hit_id, {there('h.query_start')} AS cut_start, {there('h.query_end')} AS cut_end FROM h)
SELECT hit_id, cut_start, cut_end, {back('h.cut_start')} AS full_start, {back('h.cut_end')} AS full_end FROM t h""",
)
QUERIES["lifted_fragments"] = (
    lifted_fragments,
    f"""WITH {CUTS}, f AS (SELECT query_name, hit_id, {back('h.query_start')} AS lo, {back('h.query_end')} AS hi FROM h),
m AS (SELECT f.*, cut_from, cut_to, coalesce(lag(cut_to) OVER w + 1, lo) AS a, lead(cut_from) OVER w IS NULL AS final FROM f JOIN ledger l ON l.query_name = f.query_name AND cut_from BETWEEN lo AND hi AND NOT (cut_from = lo AND cut_to = hi) WINDOW w AS (PARTITION BY hit_id ORDER BY cut_from)),
x AS (SELECT hit_id, a AS frag_start, cut_from - 1 AS frag_end FROM m WHERE a <= cut_from - 1 UNION ALL SELECT hit_id, cut_to + 1, hi FROM m WHERE final AND cut_from > lo AND cut_to < hi)
SELECT f.hit_id AS hit_id, lo AS full_start, hi AS full_end, CAST(row_number() OVER (PARTITION BY f.hit_id ORDER BY frag_start) AS INTEGER) AS fragment, coalesce(frag_start, lo) AS frag_start, coalesce(frag_end, hi) AS frag_end FROM f LEFT JOIN x ON x.hit_id = f.hit_id""",
)
