"""Queries over segmental duplications: DNA, LTR and LINE hits as seeds, all else as repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.operators import duplicons
from strandloom.plans.views import HITS, hits

QUERIES: dict[str, tuple[Callable, str | None]] = {}

SEEDS = "subj_type LIKE 'DNA%' OR subj_type LIKE 'LTR%' OR subj_type LIKE 'LINE%'"


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir).where(SEEDS).withColumns({"query_remaining": 20400 - F.col("query_end"), "div": F.col("div_permille") / 10})
    return duplicons.kept_seeds(h, 30)


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).where(f"NOT ({SEEDS})")


def duplicon_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds with their cluster."""
    return duplicons.clustered(seeds(spark, sf_dir))


def duplicon_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with the ranges to which repeats let them grow."""
    wide = duplicons.widened(duplicons.clusters(seeds(spark, sf_dir)), repeats(spark, sf_dir))
    return wide.select(F.col("hit_id").alias("cluster"), "n_seeds", "query_start", "query_end", "range_start", "range_end", "is_orphan")


def duplicon_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges to align anew, with their consensi."""
    return duplicons.ranges(duplicons.widened(duplicons.clusters(seeds(spark, sf_dir)), repeats(spark, sf_dir)).checkpoint())


# a step of the walk gives the k-th seed of every family to the first cluster that takes it
CLUSTERS = f"""seeds AS (SELECT *, 20400 - query_end AS query_remaining, row_number() OVER (PARTITION BY query_name, subj_name, orientation ORDER BY query_start, query_end DESC, hit_id) AS k
  FROM hits WHERE ({SEEDS}) AND score >= 300 AND div_permille < 300),
walk AS (SELECT DISTINCT query_name, subj_name, orientation, CAST(0 AS BIGINT) AS k, NULL::BIGINT AS hit_id, NULL::BIGINT AS cluster,
   CAST([] AS STRUCT(of BIGINT, fin BIGINT, far BIGINT, place BIGINT)[]) AS held FROM seeds
  UNION ALL SELECT query_name, subj_name, orientation, k, hit_id, coalesce(held[pos].of, hit_id), CASE WHEN pos > 0
     THEN list_transform(held, lambda x: CASE WHEN x.of = held[pos].of THEN {{'of': x.of, 'fin': fin, 'far': x.far, 'place': x.place}} ELSE x END)
     ELSE list_append(held, {{'of': hit_id, 'fin': fin, 'far': far, 'place': place}}) END
   FROM (SELECT *, coalesce(list_position(list_transform(held, lambda x: lo - x.fin <= x.far AND begins - x.place > -30), true), 0) AS pos
    FROM (SELECT w.query_name, w.subj_name, w.orientation, s.k, s.hit_id, w.held, s.query_start AS lo, s.query_end AS fin,
      CASE WHEN s.orientation = 'C' THEN s.subj_start ELSE s.subj_remaining END + 7000 AS far, CASE WHEN s.orientation = 'C' THEN -s.subj_end ELSE s.subj_start END AS begins,
      CASE WHEN s.orientation = 'C' THEN -s.subj_start ELSE s.subj_end END AS place
     FROM walk w JOIN seeds s ON s.query_name = w.query_name AND s.subj_name = w.subj_name AND s.orientation = w.orientation AND s.k = w.k + 1))),
found AS (SELECT hit_id, cluster FROM walk WHERE hit_id IS NOT NULL)"""
OVER = lambda lo, hi: f"CASE WHEN b < {lo} AND e > {hi} THEN 0 ELSE least(e, {hi}) - greatest(b, {lo}) + 1 END > 300"
BOUNDS = f"""clusters AS (SELECT cluster, count(*) AS n_seeds, max_by(query_end, k) AS query_end, max_by(query_remaining, k) AS query_remaining FROM found JOIN seeds USING (hit_id) GROUP BY 1),
flanks AS (SELECT cluster, query_name, subj_name, n_seeds, s.query_start AS qs, c.query_end AS qe, greatest(1, s.query_start - CASE WHEN orientation = 'C' THEN subj_remaining ELSE subj_start END + 1) AS lo,
  c.query_end + least(c.query_remaining, CASE WHEN orientation = 'C' THEN subj_start ELSE subj_remaining END) AS hi FROM clusters c JOIN seeds s ON s.hit_id = c.cluster),
blocks AS (SELECT query_name, query_end AS b, lead(query_start) OVER (PARTITION BY query_name ORDER BY query_start, query_end DESC, hit_id) AS e FROM hits WHERE NOT ({SEEDS}) QUALIFY e - b > 1),
limits AS (SELECT f.*, max(e) FILTER ({OVER('lo', 'qs')}) AS l, min(b) FILTER ({OVER('qe', 'hi')}) AS r FROM flanks f LEFT JOIN blocks k ON k.query_name = f.query_name AND b <= hi AND e >= lo GROUP BY ALL),
bounds AS (SELECT cluster, query_name, subj_name, n_seeds, qs AS query_start, qe AS query_end, least(qs, coalesce(l, lo)) AS range_start, greatest(qe, coalesce(r, hi)) AS range_end, range_start = qs AND range_end = qe AS is_orphan FROM limits)"""
RANGES = """runs AS (SELECT *, sum(fresh) OVER (PARTITION BY query_name ORDER BY range_start, range_end DESC, cluster ROWS UNBOUNDED PRECEDING) AS no FROM (SELECT *,
  CASE WHEN range_start <= lag(range_end) OVER (PARTITION BY query_name ORDER BY range_start, range_end DESC, cluster) THEN 0 ELSE 1 END AS fresh FROM bounds WHERE NOT is_orphan)),
spans AS (SELECT query_name, no, min(range_start) AS lo, max(range_end) AS hi FROM runs GROUP BY ALL),
members AS (SELECT query_name, no, subj_name, n_seeds FROM runs UNION ALL
  SELECT b.query_name, min(no), any_value(b.subj_name), any_value(b.n_seeds) FROM bounds b JOIN spans s ON s.query_name = b.query_name AND b.query_start >= lo AND b.query_end <= hi WHERE is_orphan GROUP BY b.cluster, b.query_name)"""

QUERIES["duplicon_clusters"] = (duplicon_clusters, f"WITH RECURSIVE {HITS}, {CLUSTERS} SELECT hit_id, cluster FROM found")
QUERIES["duplicon_bounds"] = (duplicon_bounds, f"WITH RECURSIVE {HITS}, {CLUSTERS}, {BOUNDS} SELECT * EXCLUDE (query_name, subj_name) FROM bounds")
QUERIES["duplicon_ranges"] = (
    duplicon_ranges,
    f"""WITH RECURSIVE {HITS}, {CLUSTERS}, {BOUNDS}, {RANGES} SELECT query_name, lo AS range_start, hi AS range_end, subj_name, count(*) AS n_clusters, CAST(sum(n_seeds) AS BIGINT) AS n_seeds
FROM members JOIN spans USING (query_name, no) GROUP BY ALL""",
)
