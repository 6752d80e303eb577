"""Queries over repeat elements, and over scalar functions that earlier ones leave out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from strandloom.functions import scalar as S
from strandloom.operators import elements as E
from strandloom.plans.views import HITS, hits

QUERIES: dict[str, tuple[Callable, str | None]] = {}
W = "PARTITION BY query_name ORDER BY query_start, query_end DESC, hit_id"


def query(sql: str, more: str = ""):
    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(hits(spark, sf_dir)), f"WITH {HITS}{', ' + more if more else ''} {sql}")
        return f

    return add


def cases(values: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


LOW, HIGH = (cases({k: v[i] for k, v in E.SPLITS.items()}, "subj_type") for i in (0, 1))


@query(f"SELECT hit_id, CASE WHEN div_permille * 4 < ({LOW}) * 3 THEN 'X' WHEN div_permille * 4 > ({HIGH}) * 5 THEN '0' ELSE '?' END AS age FROM hits")
def ages(h):
    return E.aged(h)


@query("""SELECT query_name, subj_type, orientation, CAST(run AS BIGINT) AS run, min(query_start) AS lo, max(query_end) AS hi, count(*) AS n FROM (SELECT *, sum(f) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN b - query_start + 1 > 33 OR b >= query_end THEN 0 ELSE 1 END AS f FROM
(SELECT *, max(query_end) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM hits WINDOW w AS (PARTITION BY query_name, subj_type, orientation ORDER BY query_start, query_end DESC, hit_id))) WINDOW w AS (PARTITION BY query_name, subj_type, orientation ORDER BY query_start, query_end DESC, hit_id)) GROUP BY 1, 2, 3, 4""")
def class_runs(h):
    return E.joined_by_class(h).groupBy("query_name", "subj_type", "orientation", "run").agg(F.min("query_start").alias("lo"), F.max("query_end").alias("hi"), F.count(F.lit(1)).alias("n"))


@query("SELECT a.hit_id, count(*) AS n_inserts, min(b.query_start) AS first_at, max(b.query_end) AS last_at FROM hits a JOIN hits b ON a.query_name = b.query_name AND b.query_start > a.query_start + 5 AND b.query_end < a.query_end - 5 AND a.subj_name <> b.subj_name GROUP BY 1")
def foreign_inserts(h):
    return E.inserts(h)


@query("""SELECT a.hit_id, b.hit_id AS partner_id, greatest(0, b.query_start - a.query_end - 1) AS gap FROM r a JOIN r b ON a.query_name = b.query_name AND b.rn BETWEEN a.rn + 1 AND a.rn + 5 AND a.orientation <> b.orientation AND a.subj_type LIKE 'LINE%' AND b.subj_type LIKE 'LINE%'
WHERE greatest(0, b.query_start - a.query_end - 1) <= 20 AND abs(b.subj_start - a.subj_end) <= 175 - 2 * abs(a.div_permille - b.div_permille) - 5 * greatest(0, b.query_start - a.query_end - 1) + CASE WHEN a.subj_name = b.subj_name THEN 50 ELSE 0 END""", more=f"r AS (SELECT *, row_number() OVER ({W}) AS rn FROM hits)")
def inversion_joins(h):
    return E.inversions(h)


@query("SELECT hit_id FROM (SELECT *, coalesce(subj_type NOT LIKE 'SINE%' AND query_start - lag(query_end) OVER w < 30 AND abs(subj_start - lag(subj_start) OVER w) <= 15 AND abs(subj_end - lag(subj_end) OVER w) <= 15, false) AS s FROM hits WINDOW w AS (PARTITION BY query_name, subj_name, orientation ORDER BY query_start, hit_id)) WHERE NOT s")
def tandem_once(h):
    return E.once_in_tandem(h).select("hit_id")


@query(f"SELECT hit_id, query_start, CASE WHEN coalesce(n <= query_end AND m <= 4 AND n > query_start, false) THEN n - 1 ELSE query_end END AS query_end FROM (SELECT *, lead(query_start) OVER w AS n, lead(subj_start) OVER w AS m FROM hits WINDOW w AS ({W}))")
def trimmed_edges(h):
    return E.trimmed_edges(h).select("hit_id", "query_start", "query_end")


FRAMED = ["MLT2A1", "MLT2B1", "MLT2B5", "MLT2C1", "MLT2C2", "MLT2D", "MLT2E", "MLT2F", "L1M1", "MLT2B3"]
# the start above which each is moved, and by how much
MOVES = "(VALUES ('MLT2A1', 270, 108), ('MLT2B1', 265, 47), ('MLT2C1', 220, 166), ('MLT2C2', 275, 95), ('MLT2D', 225, 146), ('MLT2E', 520, -65), ('MLT2F', 550, -100), ('L1M1', -1, 300)) m(n, above, move)"


@query(
    f"SELECT hit_id, s + by_ AS subj_start, e + by_ AS subj_end FROM (SELECT hit_id, s, e, CASE WHEN name = 'MLT2B5' THEN CASE WHEN s > 415 THEN -162 WHEN s > 180 THEN -116 ELSE 0 END WHEN s > above THEN move ELSE 0 END AS by_ FROM (SELECT hit_id, {FRAMED}[1 + hit_id % 10] AS name, subj_start + hit_id % 250 AS s, subj_end + hit_id % 250 AS e FROM hits) LEFT JOIN {MOVES} ON n = name)"
)
def anchored(h):
    at = F.col("hit_id") % 250
    name = F.element_at(F.array(*map(F.lit, FRAMED)), (F.col("hit_id") % 10 + 1).cast("int"))
    h = h.withColumns({"subj_name": name, "subj_start": F.col("subj_start") + at, "subj_end": F.col("subj_end") + at})
    scaffold = h.sparkSession.createDataFrame([("L1M1", 300)], "name string, shift long")
    return E.anchored(h, scaffold).select("hit_id", "subj_start", "subj_end")


@query("SELECT query_name, count(*) - 1 AS n_close, CASE WHEN count(*) > 11 THEN arg_max(subj_type, {'s': s, 'i': hit_id}) ELSE arg_max(subj_name, {'s': s, 'i': hit_id}) END AS name FROM (SELECT *, score % 60 AS s, max(score % 60) OVER (PARTITION BY query_name) AS m FROM hits) WHERE s >= m - 10 GROUP BY 1")
def ambiguous_names(h):
    return E.ambiguous(h.withColumn("score", F.col("score") % 60), ["query_name"], F.col("subj_type"))


@query("SELECT hit_id FROM (SELECT *, (query_end - query_start) // 10 AS step, count(*) OVER (PARTITION BY query_name, subj_name) > 20 AS linked FROM hits) WHERE (linked OR step >= 9) AND step >= CASE WHEN subj_type = 'Simple_repeat' THEN 5 ELSE 10 END")
def small_fragments_out(h):
    linked = F.count(F.lit(1)).over(Window.partitionBy("query_name", "subj_name")) > 20
    h = h.withColumn("linked", linked).withColumn("query_end", F.col("query_start") + F.floor((F.col("query_end") - F.col("query_start")) / 10))
    return E.without_fragments(E.without_lone_fragments(h, F.col("linked"))).select("hit_id")


@query("""SELECT hit_id, CASE WHEN subj_type = 'SINE/Alu' AND subj_start < 70 AND subj_end > 185 THEN true ELSE subj_start < 6 AND subj_remaining < 5 END AS whole_alu,
  CASE split_part(subj_type, '/', 1) WHEN 'LINE' THEN false WHEN 'SINE' THEN subj_start < 6 AND subj_remaining < 20 ELSE subj_start < 6 AND subj_remaining < 5 END AS whole FROM hits""")
def full_length(h):
    name = F.when(F.col("subj_type") == "SINE/Alu", F.concat(F.lit("Alu"), "subj_name")).otherwise(F.col("subj_name"))
    c = F.col
    return h.select("hit_id", E.full_length_alu(name, c("subj_start"), c("subj_end"), c("subj_remaining")).alias("whole_alu"), E.full_length(F.concat(name, F.lit("#"), "subj_type"), c("subj_start"), c("subj_remaining")).alias("whole"))


@query("SELECT hit_id, CAST(r AS BIGINT) AS new_id FROM hits JOIN (SELECT subj_name, dense_rank() OVER (ORDER BY subj_name) AS r FROM (SELECT DISTINCT subj_name FROM hits)) USING (subj_name)")
def translated_ids(h):
    names = h.select("subj_name").distinct()  # as many rows as families
    ids = names.select(F.col("subj_name").alias("old_id"), F.dense_rank().over(Window.orderBy("subj_name")).cast("long").alias("new_id"))
    return E.translated_ids(h, ids).select("hit_id", "new_id")


@query("SELECT hit_id, round((score * 0.12 - ln(1.0 + hit_id % 7)) / ln(2.0), 6) AS bits, round(-9.5 - ln(0.02 / (3000.0 / (100 + hit_id % 900))) / 0.7, 6) AS cut FROM hits")
def score_functions(h):
    return h.select("hit_id", F.round(S.bit_score(F.col("score"), 0.12, 1.0 + F.col("hit_id") % 7), 6).alias("bits"), F.round(S.hmm_threshold(F.lit(-9.5), F.lit(0.7), 100 + F.col("hit_id") % 900), 6).alias("cut"))


@query(r"""SELECT hit_id, format('{:,}', score * 1000 + hit_id) AS grouped,
  CAST(trunc((greatest(subj_start, 50) - 50) * 120 / 350.0 + 500) AS BIGINT) AS moved_begin, CAST(trunc((least(subj_end, 399) - 50) * 120 / 350.0 + 500) AS BIGINT) AS moved_end,
  replace(replace(regexp_replace(replace(subj_name, 'view', 'L1 ,_(view)/x?'), '[\s,_]+', '_', 'g'), '(', ''), ')', '') AS clean FROM hits""")
def text_functions(h):
    begin, end = S.translated(F.col("subj_start"), F.col("subj_end"), F.lit(50), F.lit(399), F.lit(500), F.lit(619))
    clean = S.sanitized(F.regexp_replace("subj_name", "view", "L1 ,_(view)/x?"))
    return h.select("hit_id", F.format_number(F.col("score") * 1000 + F.col("hit_id"), 0).alias("grouped"), begin.alias("moved_begin"), end.alias("moved_end"), clean.alias("clean"))


@query("SELECT query_name, CAST(len(l) AS INTEGER) AS n, l[1] AS first, array_to_string(list_slice(l, 2, 3), ',') AS some FROM (SELECT query_name, list_sort(list(DISTINCT subj_name)) AS l FROM hits GROUP BY 1)")
def list_functions(h):
    g = h.groupBy("query_name").agg(F.array_sort(F.collect_set("subj_name")).alias("l"))
    return g.select("query_name", F.size("l").alias("n"), F.element_at("l", 1).alias("first"), F.array_join(F.slice("l", 2, 2), ",").alias("some"))


@query("SELECT hit_id, CAST(row_number() OVER (PARTITION BY query_name ORDER BY CASE WHEN stage = 50 THEN 0 ELSE 1 END, query_start, stage, hit_id) AS INTEGER) AS final_order, CAST(row_number() OVER (PARTITION BY query_name ORDER BY query_end - query_start DESC, div_permille, subj_name, hit_id) AS INTEGER) AS criterion FROM hits")
def final_orders(h):
    a = Window.partitionBy("query_name").orderBy(F.when(F.col("stage") == 50, 0).otherwise(1), "query_start", "stage", "hit_id")
    b = Window.partitionBy("query_name").orderBy(F.desc(F.col("query_end") - F.col("query_start")), "div_permille", "subj_name", "hit_id")
    return h.select("hit_id", F.row_number().over(a).alias("final_order"), F.row_number().over(b).alias("criterion"))


@query("SELECT hit_id, CASE WHEN 3 > 1 OR query_end <= 2000 THEN 43 ELSE 40 END AS gc, regexp_replace(regexp_replace(subj_name || CASE WHEN hit_id % 3 = 0 THEN '_3end' WHEN hit_id % 3 = 1 THEN '_strong' ELSE '' END, '_(orf2|3end|5end|5endX|3endX)$', ''), '_strong$', '') AS shown FROM hits")
def display_names(h):
    mark = F.when(F.col("hit_id") % 3 == 0, "_3end").when(F.col("hit_id") % 3 == 1, "_strong").otherwise("")
    return h.select("hit_id", S.gc_or_default(F.lit(40), F.lit(3), F.col("query_end")).alias("gc"), E.display_names(F.concat("subj_name", mark)).alias("shown"))


@query("SELECT hit_id, CAST(row_number() OVER (PARTITION BY query_name ORDER BY score, subj_start, hit_id) AS INTEGER) AS place FROM hits")
def consensus_orders(h):
    return h.select("hit_id", F.row_number().over(Window.partitionBy("query_name").orderBy("score", "subj_start", "hit_id")).alias("place"))


@query("""SELECT query_name, CAST(len(k) AS INTEGER) AS n_types, array_to_string(k, ',') AS types, CAST(click AS BIGINT) AS sines, CAST(most AS BIGINT) AS most FROM
(SELECT query_name, list_sort(list(subj_type) FILTER (n > 10 AND subj_type <> 'Unknown')) AS k, coalesce(max(n) FILTER (subj_type = 'SINE/Alu'), 0) AS click, max(n) AS most FROM (SELECT query_name, subj_type, count(*) AS n FROM hits GROUP BY 1, 2) GROUP BY 1) WHERE k IS NOT NULL""")
def composition_maps(h):
    # a map of counts by class: one entry taken, set anew, dropped, and the keys listed
    counts = h.groupBy("query_name", "subj_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("query_name").agg(F.map_from_entries(F.collect_list(F.struct("subj_type", "n"))).alias("m"))
    kept = maps.withColumn("kept", F.map_filter("m", lambda k, v: (v > 10) & (k != "Unknown"))).where(F.size("kept") > 0)
    keys = F.array_sort(F.map_keys("kept"))
    most = F.array_max(F.map_values("m"))
    return kept.select("query_name", F.size("kept").alias("n_types"), F.array_join(keys, ",").alias("types"), F.coalesce(F.try_element_at("m", F.lit("SINE/Alu")), F.lit(0)).alias("sines"), most.alias("most"))
