"""Queries over hits: intervals, chains, reports, predicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from strandloom.functions import scalar as S
from strandloom.operators import chain, folds, greedy, interval, report
from strandloom.plans.views import HITS, hits, table

QUERIES: dict[str, tuple[Callable, str | None]] = {}
BY = "PARTITION BY query_name ORDER BY query_start, query_end DESC, hit_id"
BEFORE = f"max(query_end) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
LEN = "(query_end - query_start + 1)"
NEW = f"greatest(0, query_end - greatest(query_start - 1, coalesce({BEFORE}, 0)))"
IDS = ["hit_id", "query_name"]


def query(sql: str | None, more: str = ""):
    """Register a function of hits under its name; sql follows the CTE of hits."""

    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(hits(spark, sf_dir)), None if sql is None else f"WITH {'RECURSIVE ' if more.startswith('RECURSIVE') else ''}{HITS}{', ' + more.removeprefix('RECURSIVE ') if more else ''} {sql}")
        return f

    return add


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if c in names else F.col(c) for c in df.columns])


@query(f"SELECT subj_type, count(*) AS n_hits, CAST(sum(new_bp) AS BIGINT) AS bp FROM (SELECT *, {NEW} AS new_bp FROM hits) GROUP BY 1")
def class_coverage(h):
    return report.class_coverage(h)


@query(f"SELECT query_name, CAST(sum(query_end - query_start + 1) AS BIGINT) AS masked_bp, count(*) AS n_ranges FROM (SELECT query_name, query_end, greatest(query_start, b + 1) AS query_start FROM (SELECT *, coalesce({BEFORE}, 0) AS b FROM hits) WHERE query_end > b) GROUP BY 1")
def masked_bp(h):
    return interval.truncated(h).groupBy("query_name").agg(F.sum(report.length()).alias("masked_bp"), F.count(F.lit(1)).alias("n_ranges"))


@query("SELECT hit_id, query_name, CASE WHEN coalesce(pe >= query_start AND ps > score AND pt = stage, false) OR coalesce(ns <= query_end AND nsc > score AND nt = stage, false) THEN '*' END AS overlap FROM (SELECT *, lag(query_end) OVER w AS pe, lag(score) OVER w AS ps, lag(stage) OVER w AS pt, lead(query_start) OVER w AS ns, lead(score) OVER w AS nsc, lead(stage) OVER w AS nt FROM hits WINDOW w AS (" + BY + "))")
def overlap_flags(h):
    return interval.overlap_flag(h).select(*IDS, "overlap")


@query(f"""SELECT hit_id, query_name, CAST(greatest(0, {LEN} - coalesce(CASE WHEN pd <= div_permille THEN greatest(0, pe - query_start + 1) ELSE 0 END, 0) - coalesce(CASE WHEN nd < div_permille THEN greatest(0, query_end - ns + 1) ELSE 0 END, 0)) AS BIGINT) AS charged_bp
FROM (SELECT *, lag(query_end) OVER w AS pe, lag(div_permille) OVER w AS pd, lead(query_start) OVER w AS ns, lead(div_permille) OVER w AS nd FROM kept WINDOW w AS ({BY}))""", more=f"kept AS (SELECT * FROM (SELECT *, coalesce({BEFORE}, 0) AS b FROM hits) WHERE query_end > b)")
def charged_overlaps(h):
    return interval.charged(h).select(*IDS, "charged_bp")


@query(f"SELECT query_name, b + 1 AS gap_start, query_start - 1 AS gap_end FROM (SELECT *, {BEFORE} AS b FROM hits) WHERE query_start > b + 1")
def unique_gaps(h):
    return interval.gaps(h)


@query(f"SELECT query_name, CAST(island AS BIGINT) AS island, min(query_start) AS lo, max(query_end) AS hi, count(*) AS n FROM (SELECT *, sum(f) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN query_start <= {BEFORE} THEN 0 ELSE 1 END AS f FROM hits)) GROUP BY 1, 2")
def overlap_islands(h):
    return interval.islands(h).groupBy("query_name", "island").agg(F.min("query_start").alias("lo"), F.max("query_end").alias("hi"), F.count(F.lit(1)).alias("n"))


@query("SELECT a.hit_id AS left_id, b.hit_id AS right_id, least(a.query_end, b.query_end) - greatest(a.query_start, b.query_start) + 1 AS overlap_bp FROM hits a JOIN hits b ON a.query_name = b.query_name AND a.hit_id < b.hit_id AND a.query_start <= b.query_end AND a.query_end >= b.query_start")
def overlap_pairs(h):
    h = h.select("hit_id", "query_name", "query_start", "query_end")
    return interval.overlap_pairs(h, h).where("l_hit_id < r_hit_id").select(F.col("l_hit_id").alias("left_id"), F.col("r_hit_id").alias("right_id"), "overlap_bp")


@query("""SELECT a.hit_id, a.query_name, b.hit_id AS cover_id, CASE WHEN b.hit_id IS NULL THEN 0 ELSE least(a.query_end, b.query_end) - greatest(a.query_start, b.query_start) + 1 END AS overlap_bp FROM hits a LEFT JOIN (SELECT * FROM hits WHERE subj_type LIKE 'L%') b
ON a.query_name = b.query_name AND a.query_start <= b.query_end AND a.query_end >= b.query_start AND (least(a.query_end, b.query_end) - greatest(a.query_start, b.query_start) + 1) * 1000 >= 900 * (a.query_end - a.query_start + 1)""")
def covered_left(h):
    h = h.select("hit_id", "query_name", "query_start", "query_end", "subj_type")
    return interval.covered_left(h.drop("subj_type"), h.where("subj_type like 'L%'").drop("subj_type"))


@query("SELECT hit_id, query_name, score FROM hits a WHERE NOT EXISTS (SELECT 1 FROM hits b WHERE a.query_name = b.query_name AND b.query_start <= a.query_start AND a.query_end < b.query_end AND a.score < b.score)")
def not_contained(h):
    return interval.not_contained(h.select("hit_id", "query_name", "query_start", "query_end", "score")).select(*IDS, "score")


@query("SELECT hit_id, query_name, query_start FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE a.query_name = b.query_name AND b.rn BETWEEN a.rn - 9 AND a.rn - 1 AND a.stage = b.stage AND b.query_start <= a.query_start AND b.query_end >= a.query_end)", more=f"r AS (SELECT *, row_number() OVER ({BY}) AS rn FROM hits)")
def contained_back(h):
    return interval.contained_within(h).select(*IDS, "query_start")


@query("""SELECT hit_id, t.i AS tail_id, query_start - t.e - 1 AS gap FROM (SELECT *, max(CASE WHEN subj_type = 'Simple_repeat' THEN {'e': query_end, 'i': hit_id} END) OVER (PARTITION BY query_name ORDER BY query_start, hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM hits)
WHERE subj_type <> 'Simple_repeat' AND query_start - t.e - 1 <= 50""")
def nearest_tails(h):
    return interval.nearest(h, "Simple_repeat", 50)


@query(f"SELECT hit_id, query_name, s AS query_start, query_end FROM (SELECT *, greatest(query_start, coalesce(lag(query_end) OVER ({BY}) + 1, query_start)) AS s FROM hits) WHERE s <= query_end")
def blunted(h):
    return interval.blunted(h).select(*IDS, "query_start", "query_end")


@query(f"SELECT hit_id, query_name FROM (SELECT *, {BEFORE} AS b FROM hits) WHERE b IS NULL OR query_end > b")
def beyond_kept(h):
    return interval.beyond_kept(h).select(*IDS)


@query("SELECT hit_id, query_name FROM (SELECT *, row_number() OVER (PARTITION BY query_name, query_start, query_end, score, div_permille ORDER BY hit_id) AS r FROM hits) WHERE r = 1")
def distinct_hits(h):
    return interval.distinct_hits(h).select(*IDS)


@query("SELECT hit_id, query_name FROM (SELECT *, row_number() OVER (PARTITION BY query_name, subj_name, query_start ORDER BY score DESC, hit_id) AS a, row_number() OVER (PARTITION BY query_name, subj_name, query_end ORDER BY score DESC, hit_id) AS b FROM hits) WHERE a = 1 AND b = 1")
def edge_effects(h):
    return interval.edge_effects(h).select(*IDS)


CANDIDATES = f"""r AS (SELECT *, row_number() OVER ({BY}) AS rn FROM hits), pairs AS (SELECT a.query_name, a.hit_id, b.hit_id AS partner_id, b.score - greatest(b.query_start - a.query_end - 1, 0) - abs(a.div_permille - b.div_permille) AS pair_score, b.query_start - a.query_end - 1 AS gap
FROM r a JOIN r b ON a.query_name = b.query_name AND b.rn BETWEEN a.rn + 1 AND a.rn + 21 AND a.subj_name = b.subj_name AND a.orientation = b.orientation AND b.query_start - a.query_end - 1 <= 15000)"""
BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY pair_score DESC, partner_id) AS x, row_number() OVER (PARTITION BY partner_id ORDER BY pair_score DESC, hit_id) AS y FROM pairs) WHERE x = 1 AND y = 1)"""


@query("SELECT * FROM pairs", more=CANDIDATES)
def chain_candidates(h):
    return chain.candidates(h)


@query("SELECT query_name, hit_id, partner_id, pair_score, gap FROM best", more=f"{CANDIDATES}, {BEST}")
def best_partners(h):
    return chain.best_partners(chain.candidates(h))


COMPONENTS = """edges AS (SELECT hit_id AS u, partner_id AS v FROM best UNION SELECT partner_id, hit_id FROM best), reach(id, to_id) AS (SELECT u, u FROM edges UNION SELECT reach.id, edges.v FROM reach JOIN edges ON reach.to_id = edges.u), labels AS (SELECT id, min(to_id) AS component FROM reach GROUP BY id)"""


@query("SELECT id, component FROM labels", more=f"RECURSIVE {CANDIDATES}, {BEST}, {COMPONENTS}")
def chain_components(h):
    return chain.components(chain.best_partners(chain.candidates(h)))


@query("SELECT hit_id, query_name, CAST(dense_rank() OVER (PARTITION BY query_name ORDER BY f) AS INTEGER) AS chain FROM (SELECT *, min({'s': query_start, 'i': hit_id}) OVER (PARTITION BY query_name, c) AS f FROM (SELECT hits.*, coalesce(component, hit_id) AS c FROM hits LEFT JOIN labels ON id = hit_id))", more=f"RECURSIVE {CANDIDATES}, {BEST}, {COMPONENTS}")
def chain_numbers(h):
    return chain.numbered(h, chain.components(chain.best_partners(chain.candidates(h)))).select(*IDS, "chain")


@query("SELECT hit_id, CAST(greatest(0, f - query_end - 1 - covered) AS BIGINT) AS uncovered, most_div FROM (SELECT *, lead(query_start, 5) OVER w AS f, max(div_permille) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS most_div, sum(query_end - query_start + 1) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS covered FROM hits WINDOW w AS (" + BY + ")) WHERE f IS NOT NULL")
def look_ahead(h):
    return chain.between(h)


@query("SELECT a.query_name AS key, a.subj_name AS first_id, b.subj_name AS second_id FROM s a JOIN s b ON a.query_name = b.query_name AND a.lo < b.lo AND b.lo < a.hi AND a.hi < b.hi", more="s AS (SELECT query_name, subj_name, min(query_start) AS lo, max(query_end) AS hi FROM hits GROUP BY 1, 2)")
def interleaved_chains(h):
    spans = h.groupBy(F.col("query_name").alias("key"), F.col("subj_name").alias("id")).agg(F.min("query_start").alias("lo"), F.max("query_end").alias("hi"))
    return chain.interleaved(spans)


@query("SELECT hit_id, last_value(CASE WHEN score > 2000 THEN score END IGNORE NULLS) OVER (PARTITION BY query_name, subj_name ORDER BY query_start, hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS carried FROM hits")
def carried_back(h):
    h = h.withColumn("v", F.when(F.col("score") > 2000, F.col("score")))
    return chain.carried_back(h.withColumn("__k", F.concat_ws("|", "query_name", "subj_name")), "__k", [F.col("query_start"), F.col("hit_id")], "v").select("hit_id", "carried")


@query("SELECT query_name, subj_name, orientation, CAST(piece AS BIGINT) AS piece, min(query_start) AS lo, max(query_end) AS hi, count(*) AS n FROM (SELECT *, sum(f) OVER (w ROWS UNBOUNDED PRECEDING) AS piece FROM (SELECT *, CASE WHEN query_start - lag(query_end) OVER w > 1 OR lag(query_end) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM hits WINDOW w AS (PARTITION BY query_name, subj_name, orientation ORDER BY query_start, hit_id)) WINDOW w AS (PARTITION BY query_name, subj_name, orientation ORDER BY query_start, hit_id)) GROUP BY 1, 2, 3, 4")
def rejoined_pieces(h):
    return chain.rejoined(h).groupBy("query_name", "subj_name", "orientation", "piece").agg(F.min("query_start").alias("lo"), F.max("query_end").alias("hi"), F.count(F.lit(1)).alias("n"))


ID = "(hit_id * 7) % 97"


@query(f"""SELECT hit_id, epoch, CAST(dense_rank() OVER (PARTITION BY query_name ORDER BY f) AS BIGINT) AS new_id FROM (SELECT *, min(n) OVER (PARTITION BY query_name, epoch, id) AS f FROM (SELECT *, CAST(sum(r) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch, row_number() OVER w AS n
FROM (SELECT *, {ID} AS id, CASE WHEN {ID} < lag({ID}) OVER w - 50 AND {ID} < 3 THEN 1 ELSE 0 END AS r FROM hits WINDOW w AS (PARTITION BY query_name ORDER BY query_start, hit_id)) WINDOW w AS (PARTITION BY query_name ORDER BY query_start, hit_id)))""")
def id_epochs(h):
    h = h.withColumn("id", F.expr(ID))
    return chain.epochs(h, "query_name", [F.col("query_start"), F.col("hit_id")], "id").select("hit_id", "epoch", "new_id")


# greedy filters: no SQL; only what they need goes to Python
RANGES = [*IDS, "query_start", "query_end"]
for _value in (30, 80, 98):
    QUERIES[f"mask_level_{_value}"] = ((lambda spark, sf_dir, v=_value: greedy.mask_level(hits(spark, sf_dir).select(*RANGES, "score"), v).select(*IDS, "score")), None)
QUERIES["tail_level_80"] = (lambda spark, sf_dir: greedy.tail_level(hits(spark, sf_dir).select(*RANGES, "score"), 80).select(*IDS, "score"), None)
QUERIES["arrival_level_80"] = (lambda spark, sf_dir: greedy.arrival_level(hits(spark, sf_dir).select(*RANGES, "score"), 80).select(*IDS, "score"), None)
for _mode in greedy.MODES:
    QUERIES[f"resolve_by_{_mode}"] = ((lambda spark, sf_dir, m=_mode: greedy.resolve_overlaps(hits(spark, sf_dir).select(*RANGES, *greedy.MODE_NEEDS[m]), m).select(*RANGES)), None)
QUERIES["merge_chains"] = (lambda spark, sf_dir: greedy.merge_chains(hits(spark, sf_dir)).select(*IDS, "query_start", "query_end", "score", "div_permille"), None)


@query(f"SELECT hit_id, query_name, removed_before, query_start - removed_before AS cut_start FROM (SELECT *, CAST(coalesce(sum(query_end - query_start) OVER (PARTITION BY query_name ORDER BY query_start, hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS removed_before FROM (SELECT hit_id, query_name, query_end, greatest(query_start, b + 1) AS query_start FROM (SELECT *, coalesce({BEFORE}, 0) AS b FROM hits) WHERE query_end > b))")
def excised(h):
    return greedy.excise(interval.truncated(h)).select(*IDS, "removed_before", "cut_start")


# reports
@query(f"""SELECT super, count(*) AS n_hits, CAST(sum(new_bp) AS BIGINT) AS bp FROM (SELECT unnest(CASE WHEN len(o) > 0 THEN o ELSE ['OTHER'] END) AS super, new_bp FROM (SELECT {NEW} AS new_bp, CASE subj_type
  WHEN 'SINE/Alu' THEN ['SINE'] WHEN 'LINE/L1' THEN ['LINE'] WHEN 'DNA/hAT-Charlie' THEN ['DNA', 'DNAHAT'] WHEN 'LTR/ERVL' THEN ['LTR', 'LTRERV'] WHEN 'Simple_repeat' THEN ['SIMPLE'] ELSE [] END AS o FROM hits)) GROUP BY 1""")
def super_classes(h):
    return report.super_classes(h)


@query(f"SELECT CAST(sum(CASE WHEN subj_type NOT IN {report.OTHER_CLASSES} THEN b ELSE 0 END) AS BIGINT) AS interspersed_bp, CAST(sum(b) AS BIGINT) AS total_bp FROM (SELECT subj_type, {NEW} AS b FROM hits)")
def interspersed_total(h):
    n = interval.newly_covered(h)
    return n.agg(F.sum(F.when(~F.col("subj_type").isin(*report.OTHER_CLASSES), F.col("new_bp")).otherwise(0)).alias("interspersed_bp"), F.sum("new_bp").alias("total_bp"))


@query(f"SELECT type, subtype, count(DISTINCT subj_name) AS n_elements, CAST(sum(b) AS BIGINT) AS bp FROM (SELECT *, string_split(subj_type, '/')[1] AS type, coalesce(string_split(subj_type, '/')[2], '-') AS subtype, {NEW} AS b FROM hits) GROUP BY ROLLUP (type, subtype)")
def type_rollup(h):
    return report.rolled_up(h)


@query(f"SELECT query_name, subj_type, CAST(sum(b) AS BIGINT) AS bp, count(*) AS n FROM (SELECT *, {NEW} AS b FROM hits) GROUP BY GROUPING SETS ((query_name), (subj_type), ())")
def grouping_report(h):
    n = interval.newly_covered(h)
    n.createOrReplaceTempView("covered_hits")
    return h.sparkSession.sql("SELECT query_name, subj_type, sum(new_bp) AS bp, count(*) AS n FROM covered_hits GROUP BY GROUPING SETS ((query_name), (subj_type), ())")


@query(f"SELECT subj_type, CAST(sum(CASE WHEN div_permille < 100 THEN b ELSE 0 END) AS BIGINT) AS recent_bp, CAST(sum(CASE WHEN div_permille >= 100 THEN b ELSE 0 END) AS BIGINT) AS old_bp FROM (SELECT *, {NEW} AS b FROM hits) GROUP BY 1")
def lineage_split(h):
    n = interval.newly_covered(h)
    part = lambda c, a: F.sum(F.when(c, F.col("new_bp")).otherwise(0)).alias(a)
    return n.groupBy("subj_type").agg(part(F.col("div_permille") < 100, "recent_bp"), part(F.col("div_permille") >= 100, "old_bp"))


@query(f"SELECT subj_type, subj_name, CAST(sum({LEN}) AS BIGINT) AS bp, CAST(sum(least(div_permille, 700) * {LEN}) AS BIGINT) AS weighted FROM hits GROUP BY 1, 2")
def weighted_divergence(h):
    return report.weighted_divergence(h)


CLASSES = ["SINE/Alu", "LINE/L1", "DNA/hAT-Charlie", "LTR/ERVL", "Simple_repeat"]


@query("SELECT s.div, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN subj_type = '{c}' THEN {LEN} END), 0) AS BIGINT) AS {c.replace('/', '_').replace('-', '_').lower()}" for c in CLASSES) + " FROM (SELECT unnest(range(71)) AS div) s LEFT JOIN hits ON hits.div_permille // 10 = s.div GROUP BY 1")
def divergence_histogram(h):
    return report.divergence_histogram(h, CLASSES)


#: Classes that the graph table renames are put in the place of some of the view's.
RARE = {"SINE/Alu": "SINE/tRNA-Lys?", "LTR/ERVL": "LTR/ERVL-MaLR"}


@query(f"""SELECT grp, div, CAST(sum(l) AS BIGINT) AS bp FROM (SELECT CASE subj_type WHEN 'DNA/hAT-Charlie' THEN 'DNA/hAT' WHEN 'SINE/Alu' THEN CASE WHEN hit_id % 2 = 0 THEN 'SINE/tRNA' ELSE subj_type END ELSE subj_type END AS grp,
  div_permille // 10 AS div, {LEN} AS l FROM hits) WHERE div <= 50 GROUP BY 1, 2""")
def landscape(h):
    for old, new in RARE.items():
        h = h.withColumn("subj_type", F.when((F.col("subj_type") == old) & (F.col("hit_id") % 2 == 0), new).otherwise(F.col("subj_type")))
    return report.landscape(h)


@query("SELECT query_name, subj_name, min(query_start) - 1 AS chrom_start, max(query_end) AS chrom_end, count(*) AS block_count, least(1000, CAST(sum(div_permille) AS BIGINT) // count(*)) AS score, string_agg(CAST(query_end - query_start + 1 AS VARCHAR), ',' ORDER BY query_start, query_end, hit_id) AS block_sizes, string_agg(CAST(query_start - lo AS VARCHAR), ',' ORDER BY query_start, query_end, hit_id) AS block_starts FROM (SELECT *, min(query_start) OVER (PARTITION BY query_name, subj_name) AS lo FROM hits) GROUP BY 1, 2")
def block_records(h):
    return report.block_records(h)


@query("SELECT " + ", ".join(f"max(length(CAST({c} AS VARCHAR))) AS w_{c}" for c in ("score", "query_name", "query_start", "query_end", "subj_name", "subj_type")) + " FROM hits")
def column_widths(h):
    return report.widths(h, ["score", "query_name", "query_start", "query_end", "subj_name", "subj_type"])


@query("""SELECT query_name, subj_name, CAST(cluster AS BIGINT) AS cluster, min(query_start) AS lo, max(query_end) AS hi, count(*) AS n, string_agg(CAST(hit_id AS VARCHAR), ',' ORDER BY hit_id) AS seeds FROM (SELECT *, sum(f) OVER (w ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, CASE WHEN query_start - max(query_end) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 7000 THEN 0 ELSE 1 END AS f FROM hits WINDOW w AS (PARTITION BY query_name, subj_name ORDER BY query_start, hit_id)) WINDOW w AS (PARTITION BY query_name, subj_name ORDER BY query_start, hit_id)) GROUP BY 1, 2, 3""")
def seed_clusters(h):
    return report.seed_clusters(h)


@query("SELECT query_name, count(DISTINCT subj_name) AS n_chains, count(*) AS n_fragments FROM hits GROUP BY 1")
def chain_counts(h):
    return h.groupBy("query_name").agg(F.count_distinct("subj_name").alias("n_chains"), F.count(F.lit(1)).alias("n_fragments"))


# predicates and projections
@query("SELECT hit_id, CAST(CASE WHEN ins_permille < 1000 THEN (div_permille * 1000) // (1000 - ins_permille) ELSE div_permille END AS BIGINT) AS rebased_permille FROM hits WHERE div_permille <= 300")
def rebased_divergence(h):
    return h.where("div_permille <= 300").select("hit_id", F.expr("CASE WHEN ins_permille < 1000 THEN (div_permille * 1000) div (1000 - ins_permille) ELSE div_permille END").cast("long").alias("rebased_permille"))


@query("SELECT hit_id, subj_name FROM hits WHERE NOT contains(subj_name, 'error') AND NOT regexp_matches(subj_type, 'RNA$')")
def buffers_and_rna_out(h):
    return h.where(~F.col("subj_name").contains("error") & ~F.col("subj_type").rlike("RNA$")).select("hit_id", "subj_name")


#: Names of simple repeats, and of families with a rule before mask levels, in the place of the view's.
UNITS, FAMILIES_BEFORE = ["(CA)n", "(GAAA)n", "(A)n", "(TTAGGG)n", "(GA)n", "TTTTTTAAAAA", "Satellite"], ["SVA_A", "SVA_F", "LAVA_B", "AluY"]


@query(f"""SELECT hit_id FROM (WITH n AS (SELECT *, [{', '.join(f"'{u}'" for u in UNITS)}][CAST(hit_id % {len(UNITS)} AS INTEGER) + 1] AS name, div_permille / 10.0 AS d, (del_permille + ins_permille) / 10.0 AS g FROM hits WHERE subj_type = 'Simple_repeat'),
u AS (SELECT *, CASE WHEN name LIKE '(%' THEN regexp_extract(name, '[A-Z]+') ELSE name END AS unit FROM n),
c AS (SELECT *, len(unit) AS l, list_sum([CASE WHEN k > 0 THEN -k * ln(k / len(unit)) ELSE 0.0 END FOR k IN [len(unit) - len(replace(unit, b, '')) FOR b IN ['A', 'C', 'G', 'T']]]) / ln(4) AS e FROM u)
SELECT hit_id FROM c WHERE name NOT IN ('(A)n', 'TTTTTTAAAAA', 'Satellite') AND ((name <> '(GAAA)n' AND name <> '(GA)n' AND d + g / 1.5 <= 16 - 3 * (l - e)) OR d + g < (score - 200) / 50.0 OR d + g <= 5))""")
def simple_retention(h):
    name = F.element_at(F.array(*map(F.lit, UNITS)), (F.col("hit_id") % len(UNITS) + 1).cast("int"))
    kept = S.simple_repeat_kept(name, F.col("div_permille") / 10, (F.col("del_permille") + F.col("ins_permille")) / 10, F.col("score"))
    return h.where((F.col("subj_type") == "Simple_repeat") & kept).select("hit_id")


@query("""SELECT hit_id FROM hits WHERE NOT ((hit_id % 4 IN (0, 1) AND ((subj_start + 700 >= 855 AND subj_end + 700 < 1270) OR (subj_start + 700 >= 1263 AND subj_end + 700 < 1372))) OR (hit_id % 4 = 2 AND score < 500))""")
def pre_mask_filter(h):
    name = F.element_at(F.array(*map(F.lit, FAMILIES_BEFORE)), (F.col("hit_id") % 4 + 1).cast("int"))
    return h.where(~S.pre_mask_drop(name, F.col("subj_start") + 700, F.col("subj_end") + 700, F.col("score"))).select("hit_id")


@query(f"SELECT hit_id FROM hits WHERE score BETWEEN 300 AND 2000 AND {LEN} >= 50 AND div_permille < 250")
def range_filters(h):
    return h.where(F.col("score").between(300, 2000) & (report.length() >= 50) & (F.col("div_permille") < 250)).select("hit_id")


@query("SELECT hit_id, string_split(subj_type, '/')[1] AS class, coalesce(string_split(subj_type, '/')[2], '') AS subclass, CASE WHEN contains(subj_type, '?') THEN 0 ELSE 1 END AS sure FROM hits")
def class_parts(h):
    p = F.split("subj_type", "/")
    return h.select("hit_id", p[0].alias("class"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("subclass"), F.when(F.col("subj_type").contains("?"), 0).otherwise(1).alias("sure"))


@query("SELECT hit_id, regexp_replace(regexp_replace(subj_name, '_(offset)?$', ''), '_[0-9]$', '') AS canonical FROM hits")
def canonical_names(h):
    return h.select("hit_id", F.regexp_replace(F.regexp_replace("subj_name", "_(offset)?$", ""), "_[0-9]$", "").alias("canonical"))


@query("SELECT hit_id, subj_start - ((subj_start - 1) // (2 + hit_id % 5)) * (2 + hit_id % 5) AS unit_start FROM hits WHERE subj_type = 'Simple_repeat'")
def unit_rotation(h):
    return h.where("subj_type = 'Simple_repeat'").select("hit_id", F.expr("subj_start - ((subj_start - 1) div (2 + hit_id % 5)) * (2 + hit_id % 5)").alias("unit_start"))


def _known(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("chr"), F.col("c_custkey")).alias("query_name"))
    return hits(spark, sf_dir).join(names, "query_name", "left_semi").select("hit_id", "query_name")


def _unknown(spark, sf_dir):
    names = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("chr"), F.col("c_custkey")).alias("query_name"))
    return hits(spark, sf_dir).join(names, "query_name", "left_anti").select("hit_id", "query_name")


QUERIES["known_sequences"] = (_known, f"WITH {HITS} SELECT hit_id, query_name FROM hits WHERE query_name IN (SELECT 'chr' || c_custkey FROM customer)")
QUERIES["never_masked"] = (_unknown, f"WITH {HITS} SELECT hit_id, query_name FROM hits WHERE query_name NOT IN (SELECT 'chr' || c_custkey FROM customer WHERE c_custkey % 2 = 0)")


@query("SELECT a.hit_id, b.hit_id AS refined_id, (a.query_end - a.query_start) - (b.query_end - b.query_start) AS lost FROM hits a JOIN hits b ON a.query_name = b.query_name AND a.subj_name = b.subj_name AND a.stage + 5 = b.stage AND (a.query_end - a.query_start) - (b.query_end - b.query_start) <= 10")
def refinements(h):
    a = h.select("hit_id", "query_name", "subj_name", "stage", (F.col("query_end") - F.col("query_start")).alias("n"))
    b = a.select(F.col("hit_id").alias("refined_id"), F.col("query_name").alias("q"), F.col("subj_name").alias("s"), F.col("stage").alias("t"), F.col("n").alias("m"))
    on = (F.col("query_name") == F.col("q")) & (F.col("subj_name") == F.col("s")) & (F.col("stage") + 5 == F.col("t"))
    return a.join(b, on).withColumn("lost", F.col("n") - F.col("m")).where("lost <= 10").select("hit_id", "refined_id", "lost")


@query("SELECT DISTINCT a.hit_id FROM hits a JOIN hits b ON a.query_name = b.query_name AND a.orientation = b.orientation AND a.subj_type = b.subj_type AND a.hit_id <> b.hit_id AND a.query_start <= b.query_end AND a.query_end >= b.query_start AND b.score > 1500")
def seed_reattachment(h):
    h = h.select("hit_id", "query_name", "query_start", "query_end", "orientation", "subj_type", "score")
    return interval.overlap_pairs(h, h.where("score > 1500"), ("query_name", "orientation", "subj_type")).where("l_hit_id <> r_hit_id").select(F.col("l_hit_id").alias("hit_id")).distinct()


@query("SELECT hit_id, query_name, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY score DESC, hit_id) AS r FROM hits) WHERE r <= 10")
def first_ten(h):
    return h.withColumn("r", F.row_number().over(Window.partitionBy("query_name").orderBy(F.desc("score"), "hit_id"))).where("r <= 10").select(*IDS, "r")


@query("SELECT query_name, arg_max(subj_name, {'s': score, 'i': hit_id}) AS best_name FROM hits GROUP BY 1")
def best_names(h):
    return h.groupBy("query_name").agg(F.max_by("subj_name", F.struct("score", "hit_id")).alias("best_name"))


@query("SELECT hit_id, CAST(row_number() OVER (PARTITION BY query_name ORDER BY subj_type, query_start, query_end DESC, div_permille, score DESC, hit_id) AS INTEGER) AS by_class, CAST(row_number() OVER (PARTITION BY query_name ORDER BY orientation DESC, CASE WHEN orientation = 'C' THEN -query_start ELSE query_start END, hit_id) AS INTEGER) AS by_strand FROM hits")
def sort_orders(h):
    a = Window.partitionBy("query_name").orderBy("subj_type", "query_start", F.desc("query_end"), "div_permille", F.desc("score"), "hit_id")
    b = Window.partitionBy("query_name").orderBy(F.desc("orientation"), F.when(F.col("orientation") == "C", -F.col("query_start")).otherwise(F.col("query_start")), "hit_id")
    return h.select("hit_id", F.row_number().over(a).alias("by_class"), F.row_number().over(b).alias("by_strand"))


@query("SELECT subj_name, 'both' AS where_ FROM (SELECT subj_name FROM hits WHERE score > 2000 INTERSECT SELECT subj_name FROM hits WHERE div_permille < 20) UNION ALL SELECT subj_name, 'only_a' FROM (SELECT subj_name FROM hits WHERE score > 2300 EXCEPT SELECT subj_name FROM hits WHERE div_permille < 2)")
def set_operations(h):
    a, b = h.where("score > 2000").select("subj_name"), h.where("div_permille < 20").select("subj_name")
    c, d = h.where("score > 2300").select("subj_name"), h.where("div_permille < 2").select("subj_name")
    return a.intersect(b).withColumn("where_", F.lit("both")).unionByName(c.subtract(d).withColumn("where_", F.lit("only_a")))


@query("SELECT query_name, string_agg(DISTINCT subj_name, ',' ORDER BY subj_name) AS names FROM hits GROUP BY 1")
def alias_sets(h):
    return h.groupBy("query_name").agg(F.array_join(F.array_sort(F.collect_set("subj_name")), ",").alias("names"))


@query("""SELECT id, CAST(dense_rank() OVER (ORDER BY f, id) AS BIGINT) AS new_id FROM (SELECT id, min(query_start) AS f FROM (SELECT CAST(hit_id % 500 AS VARCHAR) AS id, query_start FROM hits WHERE hit_id % 2 = 0 UNION ALL SELECT 't' || (hit_id % 500), query_start FROM hits WHERE hit_id % 2 = 1) GROUP BY 1)""")
def combined_ids(h):
    a = h.where("hit_id % 2 = 0").select((F.col("hit_id") % 500).cast("string").alias("id"), "query_start")
    b = h.where("hit_id % 2 = 1").select(F.concat(F.lit("t"), F.col("hit_id") % 500).alias("id"), "query_start")
    first = a.unionByName(b).groupBy("id").agg(F.min("query_start").alias("f"))  # one row an id
    placed = folds.numbered_rows(first.withColumn("all", F.lit(0)), [F.col("f"), F.col("id")], key="all", at="f", out="new_id", width=256)
    return placed.select("id", F.col("new_id").cast("long").alias("new_id"))


@query("""SELECT a.hit_id, b.hit_id AS other_id, least(a.query_end, b.query_end) - greatest(a.query_start, b.query_start) + 1 AS shared, CASE WHEN a.orientation = 'C' THEN b.subj_end - a.subj_start + 1 ELSE a.subj_end - b.subj_start + 1 END AS cons,
CASE WHEN a.query_start < b.query_start AND a.query_end > b.query_end THEN 0 ELSE greatest(0, least(a.query_end, b.query_end) - greatest(a.query_start, b.query_start) + 1) END AS old_size, a.div_permille > 2 * b.div_permille AND a.div_permille > b.div_permille + 100 AS diverged
FROM r a JOIN r b ON a.query_name = b.query_name AND b.rn = a.rn + 1""", more=f"r AS (SELECT *, row_number() OVER ({BY}) AS rn FROM hits)")
def pair_arithmetic(h):
    w = Window.partitionBy("query_name").orderBy(*interval.by_position())
    n = {c: F.lead(c).over(w) for c in ("hit_id", "query_start", "query_end", "subj_start", "subj_end", "div_permille")}
    h = h.select("*", *[v.alias(f"n_{k}") for k, v in n.items()]).where("n_hit_id is not null")
    c = F.col
    return h.select(
        "hit_id", c("n_hit_id").alias("other_id"),
        S.query_overlap(c("query_start"), c("query_end"), c("n_query_start"), c("n_query_end")).alias("shared"),
        S.consensus_gap(c("orientation"), c("subj_start"), c("subj_end"), c("n_subj_start"), c("n_subj_end")).alias("cons"),
        S.overlap_size(c("query_start"), c("query_end"), c("n_query_start"), c("n_query_end"), legacy=True).cast("long").alias("old_size"),
        S.too_diverged(c("div_permille") / 10, c("n_div_permille") / 10).alias("diverged"),
    )


@query("SELECT hit_id, CASE WHEN score % 4 = 0 THEN 14 WHEN score % 4 = 2 THEN 10 WHEN score % 4 = 3 THEN 7 ELSE 12 END AS chosen, greatest(35, least(53, 35 + 2 * CAST(ceil((30 + hit_id % 30 - 36) / 2.0) AS INTEGER))) || 'g' AS label FROM hits")
def settings(h):
    speed = F.when(F.col("score") % 4 == 0, "s").when(F.col("score") % 4 == 2, "q").when(F.col("score") % 4 == 3, "qq").otherwise("")
    return h.select("hit_id", S.by_speed([14, 12, 10, 7], speed).alias("chosen"), S.gc_label(30 + F.col("hit_id") % 30).alias("label"))
